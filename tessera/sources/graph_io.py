"""Reading and writing memory graphs, vector change logs, message logs, source batches and operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import redact
from tessera.operators.graph import canonical_edges, load_edges, load_nodes
from tessera.operators.vectors import needs_compaction, replay
from tessera.session import materialize

GRAPH_DDL = (
    "nodes array<struct<id:string,content:string,type:string,deprecated:boolean,forgotten:boolean,timestamp:long,evidence:string,source_ref:string>>, "
    "edges array<struct<`from`:string,`to`:string,type:string,bidirectional:boolean>>"
)
BATCH_DDL = "batch_id string, created_at long, redacted boolean, rounds array<struct<ts:long,speaker:string,speaker_id:string,text:string>>"
MESSAGE_DDL = "seq long, msgs array<struct<doc_id:string,msg_index:int,role:string,content:string,timestamp:long,rid:string,channel:string>>, _corrupt string"
OPLOG_DDL = "ts string, event_id string, source string, actor string, op string, request string, result string, tool string, _corrupt string"


def graph_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, nodes, edges of every JSON graph document (one per file); files without a nodes list are left out."""
    rows = spark.read.schema(GRAPH_DDL).option("mode", "PERMISSIVE").json(path, multiLine=True)
    return rows.withColumn("path", F.col("_metadata.file_path")).filter("nodes IS NOT NULL")


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """As graph_documents, for YAML files: each task parses its files. Needs PyYAML on the executors."""
    from collections.abc import Iterator

    import pandas as pd

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for part in parts:
            out = []
            for at, data in zip(part["path"], part["content"], strict=True):
                try:
                    found = yaml.safe_load(data)
                except yaml.YAMLError:
                    found = None
                if isinstance(found, dict) and isinstance(found.get("nodes"), list):
                    out.append((at, json.dumps(found, default=str)))
            yield pd.DataFrame(out, columns=["path", "doc"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(parse, "path string, doc string").select("path", F.from_json("doc", GRAPH_DDL).alias("g")).select("path", "g.nodes", "g.edges")


def graph_tables(documents: DataFrame, node_policy: str = "skip", edge_policy: str = "last_wins") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents, merged in the order of their paths; positions are kept in ord.

    Positions come from the file's place among the sorted paths and the row's place in the file: no global sort of rows.
    """
    paths = documents.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")))
    placed = documents.join(paths, "path")
    order = F.col("file").cast("long") * (1 << 32) + F.col("p")
    nodes = placed.select("file", F.posexplode("nodes").alias("p", "n")).select("n.*", order.alias("ord"))
    edges = placed.select("file", F.posexplode("edges").alias("p", "e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.type").alias("rel_type"), "e.bidirectional", order.alias("ord"))
    kept = load_nodes(nodes, node_policy)
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("deprecated", "forgotten")}
    return kept.withColumns(flags), load_edges(edges, edge_policy)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and canonical edges as two Parquet tables below path; unknown columns are left out."""
    fields = ["node_id", "content", "node_type", "deprecated", "forgotten", "timestamp", "evidence", "source_ref", "metadata", "ord"]
    nodes.select(*[c for c in fields if c in nodes.columns]).write.mode("overwrite").parquet(f"{path}/nodes")
    ordered = edges if "src_ord" in edges.columns else edges.withColumns({"src_ord": F.col("ord"), "dst_ord": F.lit(0)})
    canonical_edges(ordered).write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_graph wrote, bidirectional rows expanded."""
    rows = spark.read.parquet(f"{path}/edges").withColumn("ord", F.lit(0).cast("long"))
    return spark.read.parquet(f"{path}/nodes"), load_edges(rows)


def append_vectors(changes: DataFrame, path: str, seq: int, rows: int = 2048) -> None:
    """One shard group of a change log: (id, embedding, content, deleted) rows under seq, in files of at most `rows`."""
    place = F.monotonically_increasing_id()
    changes.withColumn("pos", place).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{path}/seq={seq}")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The current vectors of a change log."""
    return replay(spark.read.parquet(path))


def compact_vectors(spark: SparkSession, path: str, to: str) -> bool:
    """Rewrites a log that needs it as one baseline at `to`, of a later sequence; whether it did. The old log is not touched."""
    log = spark.read.parquet(path)
    live = materialize(replay(log), "live")
    counts = log.agg(F.count_distinct("seq").alias("shards"), F.count(F.lit(1)).alias("rows"), F.max("seq").alias("seq")).first()
    if not needs_compaction(counts["shards"], counts["rows"], live.count()):
        return False
    append_vectors(live.withColumn("deleted", F.lit(False)), to, counts["seq"] + 1)
    return True


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message rows of a JSON-lines log; corrupt and half lines are skipped. See maintenance.replay_messages for its replay."""
    raw = spark.read.schema(MESSAGE_DDL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.filter("_corrupt IS NULL AND seq IS NOT NULL").select("seq", F.explode("msgs").alias("m")).select("seq", "m.*")


def read_oplog(spark: SparkSession, path: str, tail: int | None = 200, source: str | None = None, op: str | None = None, text: str | None = None) -> DataFrame:
    """The last `tail` rows of a JSON-lines operation log, then filtered by source, op and a substring of the row in any case."""
    raw = spark.read.schema(OPLOG_DDL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.filter("_corrupt IS NULL").drop("_corrupt")
    rows = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(tail) if tail else rows
    keep: Column = F.lit(True)
    if source:
        keep = keep & (F.col("source") == source)
    if op:
        keep = keep & (F.col("op") == op)
    if text:
        keep = keep & F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower()))
    return rows.filter(keep).orderBy("ts", "event_id")


def summarise(value: Column, preview: int = 200) -> Column:
    """A log field cut to its preview, with the length that it had."""
    return F.when(F.length(value) > preview, F.concat(F.left(value, F.lit(preview)), F.lit("…("), F.length(value).cast("string"), F.lit(")"))).otherwise(value)


def write_batches(batches: DataFrame, path: str, hide: bool = True) -> None:
    """Source batches as JSON lines, one folder per batch id, identifiers redacted."""
    shown = batches
    if hide:
        shown = batches.withColumn("rounds", F.transform("rounds", lambda r: r.withField("text", redact(r["text"])).withField("speaker_id", F.lit(None).cast("string")))).withColumn("redacted", F.lit(True))
    shown.withColumn("batch", F.col("batch_id")).write.mode("append").partitionBy("batch").json(path)


def read_batches(spark: SparkSession, path: str, batch_id: str | None = None, newest: int | None = None) -> DataFrame:
    """Source batches, of one id (a partition filter) or the newest ones first."""
    rows = spark.read.schema(f"{BATCH_DDL}, batch string").json(path)
    rows = rows.filter(F.col("batch") == batch_id) if batch_id else rows
    return rows.orderBy(F.desc("created_at"), "batch_id").limit(newest) if newest else rows


def expired(files: DataFrame, days: int, now: Column) -> DataFrame:
    """space, newest of file listings (space, modified) whose newest file is older than so many days."""
    return files.groupBy("space").agg(F.max("modified").alias("newest")).filter(F.col("newest") < now - F.make_interval(days=F.lit(days)))


QUERY_DDL = "queries array<struct<text:string,expected:array<string>,unexpected:array<string>>>"


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """text, expected, unexpected of the queries in JSON graph documents; missing lists are empty, of a text the last one counts."""
    none = F.array().cast("array<string>")
    rows = spark.read.schema(QUERY_DDL).json(path, multiLine=True).select(F.posexplode("queries").alias("at", "q")).select("at", "q.*").filter("text IS NOT NULL")
    last = rows.groupBy("text").agg(F.max_by(F.struct("expected", "unexpected"), "at").alias("r"))
    return last.select("text", F.coalesce("r.expected", none).alias("expected"), F.coalesce("r.unexpected", none).alias("unexpected"))


def graph_with_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, queries) of the same documents."""
    return *graph_tables(graph_documents(spark, path)), labelled_queries(spark, path)


def graph_library(documents: DataFrame) -> DataFrame:
    """path, nodes: the graphs that can be read, with the number of their nodes."""
    return documents.groupBy("path").agg(F.sum(F.size("nodes")).alias("nodes"))


def import_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """graph_tables() that takes all or nothing: ValueError if a node or an edge would be rejected."""
    nodes, edges = graph_tables(documents, "reject", "reject")
    for name, df in (("node", nodes), ("edge", edges)):
        bad = df.filter("reject_reason IS NOT NULL").limit(1).collect()
        if bad:
            raise ValueError(f"{name} rejected: {bad[0].asDict()}")
    return nodes.drop("reject_reason"), edges.drop("reject_reason")


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_vectors(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """Current vectors: of the change log, else of an old single table (id, embedding, content), else none."""
    if there(spark, path):
        return read_vectors(spark, path)
    if legacy and there(spark, legacy):
        return spark.read.parquet(legacy).select("id", "embedding", "content")
    return spark.createDataFrame([], "id string, embedding array<float>, content string")


def adopt_vectors(spark: SparkSession, legacy: str, path: str) -> None:
    """An old single table as the baseline of a new change log."""
    append_vectors(spark.read.parquet(legacy).select("id", "embedding", "content").withColumn("deleted", F.lit(False)), path, 0)


def append_messages(messages: DataFrame, path: str, seq: int) -> None:
    """One line for a batch of messages (doc_id, msg_index, role, content, timestamp, rid, channel), added to a JSON-lines log."""
    fields = ["doc_id", "msg_index", "role", "content", "timestamp", "rid", "channel"]
    rows = messages.groupBy().agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("msgs"))  # a batch is one request
    rows.select(F.lit(seq).cast("long").alias("seq"), "msgs").coalesce(1).write.mode("append").json(path)


def compact_messages(spark: SparkSession, path: str, to: str) -> None:
    """The replayed messages of a log as a snapshot table at `to`; the log is not touched."""
    from tessera.operators.maintenance import replay_messages

    replay_messages(read_messages(spark, path)).write.mode("overwrite").parquet(to)


def current_batches(batches: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Source batches (created_at, milliseconds) younger than so many days; what a purge keeps."""
    return batches.filter(F.col("created_at") >= now_ms - days * 86_400_000)


def write_checkpoint(tables: dict[str, DataFrame], path: str, meta: dict | None = None) -> None:
    """Several tables and, last, a manifest with their names, schemas and row counts; without the manifest a checkpoint is none."""
    import json

    spark, listed = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        listed.append((name, df.schema.json(), spark.read.schema(df.schema).parquet(f"{path}/{name}").count()))
    rows = spark.createDataFrame(listed, "name string, kind string, rows long").withColumn("meta", F.lit(json.dumps(meta or {})))
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, meta) of a checkpoint; ValueError if a table has not the rows that the manifest says."""
    import json

    rows = spark.read.schema("name string, kind string, rows long, meta string").json(f"{path}/manifest").collect()
    tables = {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["kind"]))).parquet(f"{path}/{r['name']}") for r in rows}
    for r in rows:
        if tables[r["name"]].count() != r["rows"]:
            raise ValueError(f"{r['name']} is incomplete")
    return tables, json.loads(rows[0]["meta"]) if rows else {}
