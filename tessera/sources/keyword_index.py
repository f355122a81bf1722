"""A stored keyword index: postings by buckets of terms, versions of notes and tombstones; kept by adding, never by rewriting."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.keyword import FIELD_WEIGHTS, MOST, postings
from tessera.sources.versions import Store

BUCKETS = 64
#: Files of one bucket at least, so that a term that all notes have is written and read by several tasks.
SPLITS = 4
#: Notes whose postings are sorted by one task on average, notes and questions that are scored together.
SHARE, NOTE_BLOCK, QUERY_BLOCK = 4096, 8192, 256


def best_notes(rows: pa.Table, asked: pa.Table, k: int, cells: int = 1 << 22) -> pa.Table:
    """query_id, id, score, at: the k best notes of each query, by score, newest, then id.

    rows: notes (id, seq, at, t = -1) and postings of their terms (id, seq, t, weight), which count if the note has their seq. asked:
    query_id, the numbers of its terms (ts) and the score of each sum of weights (levels; the last for all above).
    """
    is_note = pc.equal(rows["t"], -1)
    notes = rows.filter(is_note).sort_by([("at", "descending"), ("id", "ascending")])
    kinds = pa.schema([("query_id", asked.schema.field("query_id").type), ("id", rows.schema.field("id").type), ("score", pa.float64()), ("at", pa.int64())])
    if not notes.num_rows or not asked.num_rows:
        return kinds.empty_table()
    postings = rows.filter(pc.invert(is_note))
    note = pc.fill_null(pc.index_in(postings["id"], notes["id"].combine_chunks()), -1).to_numpy()
    live = np.flatnonzero((note >= 0) & (notes["seq"].to_numpy()[note] == postings["seq"].to_numpy()))
    live = live[np.argsort(note[live], kind="stable")]
    note, term, weight = note[live], postings["t"].to_numpy()[live], postings["weight"].to_numpy()[live]
    terms = [np.asarray(t) for t in asked["ts"].to_pylist()]
    width = int(max(t.max() for t in terms)) + 1
    wanted = np.zeros((width, len(terms)), dtype=np.float32)
    for q, t in enumerate(terms):
        wanted[t, q] = 1
    hits, size = np.empty((notes.num_rows, len(terms)), dtype=np.float32), max(1, cells // width)
    for at in range(0, len(hits), size):
        some = slice(*np.searchsorted(note, [at, at + size]))
        count = min(size, len(hits) - at)
        cell = (note[some] - at).astype(np.int64) * width + term[some]
        held = np.bincount(cell, weights=weight[some], minlength=count * width).astype(np.float32)
        hits[at : at + count] = held.reshape(count, width) @ wanted
    which, place, score = [], [], []
    for q, level in enumerate(asked["levels"].to_pylist()):
        own = np.flatnonzero(hits[:, q])
        s = np.asarray(level)[np.minimum(hits[own, q].astype(np.int64), len(level) - 1)]
        if len(s) > k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            own, s = own[keep], s[keep]
        order = np.argsort(-s, kind="stable")[:k]  # newest first, then by id
        which.append(np.full(len(order), q))
        place.append(own[order])
        score.append(s[order])
    place = np.concatenate(place)
    return pa.table([asked["query_id"].take(np.concatenate(which)), notes["id"].take(place), np.concatenate(score), notes["at"].take(place)], schema=kinds)


class KeywordIndex:
    """Tables `postings` (term, id, weight, seq, bucket) and `notes` (id, seq, live, at) of a Store.

    A change is one version with a sequence number of its own: new notes bring postings and a row, removed ones a row that is not live. A
    posting counts if its note's latest row is live and of the same sequence; so a note is replaced by adding it again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.store = Store(spark, path)
        known = self.store.manifest()["meta"]
        self.buckets = known.get("buckets", buckets)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, notes: DataFrame) -> int | None:
        """Adds or replaces notes: id, any of title, tags and text, observed_at. One shuffle, of the new notes' terms by bucket."""
        seq = self.store.manifest()["version"] + 1
        weight = F.create_map(*[x for f, w in FIELD_WEIGHTS.items() for x in (F.lit(f), F.lit(w))])
        count = notes.count()
        splits = max(SPLITS, math.ceil(4 * count / (SHARE * self.buckets)))
        rows = postings(notes).select("term", "id", weight[F.col("field")].alias("weight"), F.lit(seq).alias("seq"), self._bucket(F.col("term")).alias("bucket"))
        dealt = self._dealt(rows, splits)
        state = notes.select("id", F.lit(seq).alias("seq"), F.lit(True).alias("live"), F.coalesce("observed_at", F.lit(0)).cast("long").alias("at"))
        return self.store.commit(append={"postings": dealt, "notes": state}, meta={"buckets": self.buckets}, by={"postings": "bucket"})

    def _dealt(self, rows: DataFrame, splits: int) -> DataFrame:
        """Postings by bucket and split of the notes, so many to a task that its sort doesn't grow with the notes."""
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.buckets * splits // 4)
        return rows.repartition(parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(splits))).sortWithinPartitions("bucket", "term")

    def remove(self, ids: DataFrame) -> int | None:
        """Tombstones for notes; their postings go when the index is compacted."""
        seq = self.store.manifest()["version"] + 1
        return self.store.commit(append={"notes": ids.select("id", F.lit(seq).alias("seq"), F.lit(False).alias("live"), F.lit(0).cast("long").alias("at"))})

    def notes(self) -> DataFrame:
        """id, seq, at of the notes that are there."""
        last = self.store.read("notes").groupBy("id").agg(F.max(F.struct("seq", "live", "at")).alias("s"))
        return last.filter("s.live").select("id", "s.seq", "s.at")

    def search(self, queries: DataFrame, top_k: int | None = 8) -> DataFrame:
        """query_id, id, score, place, as operators.keyword.search. Only the buckets that hold terms of the queries are read.

        The driver learns which buckets those are, a bounded number of small integers. Postings of asked terms go to blocks of notes,
        once for each block of queries that asks for them; there the hits of all notes and queries are one product of two matrices, so
        what moves are postings, not pairs of queries and notes. A block pair gives its best, of which a window keeps the best.
        """
        k = max(1, min(MOST, top_k if isinstance(top_k, int) and not isinstance(top_k, bool) else 8))
        asked = queries.select("query_id", tokens(F.col("text")).alias("terms")).withColumn("n", F.size("terms")).filter("n > 0")
        blocks = max(1, math.ceil(self.store.manifest()["tables"]["notes"]["rows"] / NOTE_BLOCK))
        query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rounded = F.transform(F.sequence(F.lit(0), 3 * F.col("n")), lambda hit: F.round(F.least(F.lit(1.0), hit / (3.0 * F.col("n"))), 4))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("levels", rounded)
        terms = asked.select("qb", F.explode("terms").alias("term")).distinct()
        terms = terms.withColumn("t", F.row_number().over(Window.partitionBy("qb").orderBy("term")) - 1).withColumn("bucket", self._bucket(F.col("term")))
        wanted = [r["bucket"] for r in terms.select("bucket").distinct().collect()]
        held = self.store.read("postings").filter(F.col("bucket").isin(wanted)) if wanted else self.store.read("postings").limit(0)
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")
        none = F.lit(None).cast("long").alias("at")
        hits = held.join(terms, ["bucket", "term"]).select("qb", block, "id", F.col("seq").cast("long").alias("seq"), "t", F.col("weight").cast("int").alias("weight"), none)
        live = self.notes().filter("id IS NOT NULL").select(each(query_blocks).alias("qb"), block, "id", F.col("seq").cast("long").alias("seq"), F.lit(-1).alias("t"), F.lit(0).alias("weight"), "at")
        own = asked.select("qb", "query_id", "levels", F.posexplode("terms").alias("p", "term")).join(terms, ["qb", "term"]).withColumn("levels", F.when(F.col("p") == 0, F.col("levels")))
        grouped = own.groupBy("qb", "query_id").agg(F.first("levels", ignorenulls=True).alias("levels"), F.collect_list("t").alias("ts"))
        numbered = grouped.select(F.col("qb").alias("qb"), F.col("query_id").alias("query_id"), "levels", "ts", each(blocks).alias("b"))
        kind = {f.name: f.dataType.simpleString() for f in [held.schema["id"], queries.schema["query_id"]]}

        def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
            return best_notes(rows, asked, k)

        parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * query_blocks)
        rows, numbered = hits.unionByName(live).repartition(parts, "b", "qb"), numbered.repartition(parts, "b", "qb")
        found = rows.groupBy("b", "qb").cogroup(numbered.groupBy("b", "qb")).applyInArrow(score, f"query_id {kind['query_id']}, id {kind['id']}, score double, at long")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("at"), "id"))
        return found.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "id", "score", "place")

    def statistics(self) -> DataFrame:
        """term, n: in how many fields of notes each term stands."""
        return self.store.read("postings").join(self.notes().select("id", "seq"), ["id", "seq"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))

    def compact(self, parts: int = 16) -> bool:
        """Rewrites postings and notes without what no longer counts, if there are more than `parts` changes."""
        found = self.store.manifest()["tables"].get("notes")
        if found is None or len(found["parts"]) <= parts:
            return False
        live = self.notes()
        held = self.store.read("postings").join(live.select("id", "seq"), ["id", "seq"], "left_semi")
        splits = max(SPLITS, math.ceil(4 * live.count() / (SHARE * self.buckets)))
        dealt = self._dealt(held.select("term", "id", "weight", "seq", "bucket"), splits)
        state = live.select("id", "seq", F.lit(True).alias("live"), "at")
        return self.store.commit(replace={"postings": dealt, "notes": state}, by={"postings": "bucket"}) is not None
