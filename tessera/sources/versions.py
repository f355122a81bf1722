"""Versioned tables: a version is written beside the others, then one small file makes it the current one.

A version's manifest names, for each table, the folders that it consists of, so a version may add folders to those of the one before.
A write that is killed leaves folders that no manifest names; readers keep the version that they began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


class Conflict(RuntimeError):
    """Another writer has committed the version in the meantime."""


def digest(df: DataFrame) -> Column:
    """A number for all rows of a table, whatever their order, as text."""
    plain = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.coalesce(F.sum(F.xxhash64(*plain).cast("decimal(38,0)")), F.lit(0)).cast("string")


class Store:
    """Tables below a path of any store that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._at("_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """version, meta and tables of a version, the newest by default; version 0 has none."""
        known = self.versions()
        at = version if version is not None else (known[-1] if known else 0)
        if not at:
            return {"version": 0, "meta": {}, "tables": {}}
        if at not in known:
            raise ValueError(f"no version {at} in {self.path}")
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{at:012d}.json", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version. Partition columns of its folders are pruned as usual."""
        found = self.manifest(version)["tables"][name]
        schema = StructType.fromJson(found["schema"])
        if not found["parts"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType(schema.fields).add("part", "string")).option("basePath", f"{self.path}/{name}")
        return rows.parquet(*[f"{self.path}/{name}/part={p}" for p in found["parts"]]).select(*[f"`{c}`" for c in schema.names])

    def bytes(self, name: str) -> int:
        """Size of the current folders of a table."""
        parts = self.manifest()["tables"].get(name, {"parts": []})["parts"]
        return sum(self._fs.getContentSummary(self._at(f"{name}/part={p}")).getLength() for p in parts)

    def commit(
        self,
        replace: dict[str, DataFrame] | None = None,
        append: dict[str, DataFrame] | None = None,
        meta: dict | None = None,
        expect: int | None = None,
        by: dict[str, str] | None = None,
    ) -> int | None:
        """Writes a version in which some tables are replaced and others have rows added, and returns its number; None, and no new version,
        if nothing has changed: no rows added, equal rows in every replaced table, the same meta.

        by: partition columns. expect: the version that this one is made from; Conflict if it is not the current one, also when another
        writer commits while this one writes (on stores whose rename does not replace a file).
        """
        base = self.manifest()
        if expect is not None and expect != base["version"]:
            raise Conflict(f"{self.path} is at version {base['version']}, not {expect}")
        number, tables, changed = base["version"] + 1, dict(base["tables"]), False
        for name, df in [*(replace or {}).items(), *(append or {}).items()]:
            part, column = f"v{number}-{uuid.uuid4().hex[:12]}", (by or {}).get(name)
            target = f"{self.path}/{name}/part={part}"
            (df.write.partitionBy(column) if column else df.write).parquet(target)
            schema = df.schema if not column else StructType([f for f in df.schema if f.name != column]).add(df.schema[column])
            back = self.spark.read.schema(schema).parquet(target)
            rows, content = back.agg(F.count(F.lit(1)), digest(back)).first()
            old = tables.get(name)
            if name in (append or {}):
                keep = bool(rows) or old is None
                parts = [*(old["parts"] if old else []), part]
                held = (old["rows"] if old else 0) + rows, str(int(old["digest"] if old else 0) + int(content))
            else:
                keep = old is None or (old["rows"], old["digest"], old["schema"]) != (rows, content, schema.jsonValue()) or len(old["parts"]) > 1
                parts, held = [part], (rows, content)
            if not keep:
                self._fs.delete(self._at(f"{name}/part={part}"), True)
                continue
            changed = True
            tables[name] = {"parts": parts, "rows": held[0], "digest": held[1], "schema": schema.jsonValue()}
        new = meta if meta is not None else base["meta"]
        if not changed and new == base["meta"]:
            return None
        self._publish({"version": number, "meta": new, "tables": tables})
        return number

    def _publish(self, manifest: dict) -> None:
        number = manifest["version"]
        mark, draft = self._at(f"_versions/{number:012d}.json"), self._at(f"_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(mark) or not self._fs.rename(draft, mark):
            self._fs.delete(draft, False)
            raise Conflict(f"version {number} of {self.path} exists")

    def restore(self, version: int) -> int:
        """Makes an earlier version's tables current again, as a new version; no data is copied."""
        old = self.manifest(version)
        number = self.manifest()["version"] + 1
        self._publish(old | {"version": number})
        return number

    def compact(self, name: str, rows: DataFrame | None = None, parts: int = 16, size: int | None = None, by: str | None = None) -> bool:
        """Rewrites a table, or what `rows` makes of it, as one folder if it has more folders than `parts` or, with a size, more bytes."""
        found = self.manifest()["tables"].get(name)
        if found is None or (len(found["parts"]) <= parts and (size is None or self.bytes(name) <= size)):
            return False
        return self.commit(replace={name: self.read(name) if rows is None else rows}, by={name: by} if by else None) is not None

    def prune(self, keep: int = 2) -> int:
        """Forgets all but the newest versions and removes the folders that none of those names; how many folders went."""
        known = self.versions()
        for version in known[:-keep]:
            self._fs.delete(self._at(f"_versions/{version:012d}.json"), False)
        held: dict[str, set[str]] = {}
        for version in known[-keep:]:
            for name, found in self.manifest(version)["tables"].items():
                held.setdefault(name, set()).update(found["parts"])
        gone = 0
        for name, parts in held.items():
            for status in self._fs.listStatus(self._at(name)):
                at = status.getPath()
                if at.getName().removeprefix("part=") not in parts:
                    self._fs.delete(at, True)
                    gone += 1
        return gone
