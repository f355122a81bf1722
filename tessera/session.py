"""Session helpers shared by all operators: tables, shared scratch space, local sessions for tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, weakref.ref] = {}
_local: dict[str, str] = {}
#: Spark's switch for removing a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local folder, on a single machine only (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "at" not in _local:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local["at"] = f"file://{folder}"
    return _local["at"]


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """While it lasts, shuffle files go when their query ends; the session's own choice holds again afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, keeps Parquet pruning.

    The shuffles that made it are removed at once, the files when the application ends or at discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
    with _cleanup(spark):
        df.write.parquet(path)
    _scratch[path] = weakref.ref(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(*written: DataFrame) -> None:
    """Remove tables of materialize() that nothing needs any more."""
    release([df._scratch_path for df in written])


def release(paths: list[str] | None = None) -> None:
    """Remove written scratch tables, all of them by default."""
    for path in list(_scratch if paths is None else paths):
        spark = _scratch.pop(path, lambda: None)()
        if spark is None or spark.sparkContext._jsc is None:
            continue
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be closing; leftover scratch files are harmless
            return


atexit.register(release)
