"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is the md5 of its normalised form. The index holds three tables below one folder, a new
generation of them for every change:

* ``postings``: ``key, doc`` of every document that holds the key,
* ``refs``: ``key, refs, last``, the exact count of documents and the largest id holding the key,
* ``filters``: one cuckoo filter per shard with the keys whose count has reached ``min_docs``.

``insert`` adds the counts of new documents, ``delete`` takes those of removed ones back. Only keys that
cross ``min_docs`` change a filter: they are inserted into or, as cuckoo filters allow, removed from it.
``dedup`` asks the filters first and the exact table only for lines that a filter may hold, so false
positives cost a lookup and never a line. A filter that is too full is built anew, twice as large.

Keys that hold a thousandth of all postings or more (a thousand at most) are told apart by a broadcast
table before lines are dealt to shards; all other keys are spread by hash. Texts move once, by id, when
lines are taken out.

Defined results: null or empty texts are one empty line; rows with equal ids count as one document; rows
without an id count together as one document that is never the largest; keys shorter than ``min_chars``
code points are never dropped; other columns are kept, those named ``n_lines`` or ``n_dropped`` replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm.common import BLANKS, UPPER, heavy_keys, stored

SHARDS = 1024
SLOTS = 4
KICKS = 200


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; supports removal."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table.reshape(buckets, SLOTS).copy()

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8)))))

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        table = np.frombuffer(blob, np.uint16)
        return cls(len(table) // SLOTS, table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and the two buckets of keys given as 64-bit integers."""
        mark = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        mask = np.uint64(self.buckets - 1)
        one = (keys & mask).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket, mark):
        step = (np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)
        return np.asarray(bucket, np.int64) ^ step.astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys; false if one found no place (the filter must then be built anew)."""
        for mark, one, two in zip(*self._places(keys), strict=True):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                bucket, turn = two, 0
                while True:
                    slot = turn % SLOTS
                    mark, self.table[bucket, slot] = self.table[bucket, slot], mark
                    bucket = int(self._other(bucket, mark))
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                    turn += 1
                    if turn > KICKS:
                        return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        for mark, one, two in zip(*self._places(keys), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    @classmethod
    def build(cls, keys: np.ndarray) -> Cuckoo:
        made = cls.sized(len(keys))
        while not made.insert(keys):
            made = cls(made.buckets * 2)
        return made


def _numbers(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(lines: Column, min_chars: int) -> Column:
    """Key of every line, null for lines too short to count."""

    def key(line: Column) -> Column:
        norm = F.translate(F.trim(line, F.lit(BLANKS)), UPPER, UPPER.lower())
        return F.when(F.length(norm) >= min_chars, F.unhex(F.md5(norm)))

    return F.transform(lines, key)


class LineIndex:
    """A line index below ``path``; see the module's text."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, min_chars: int = 20, shards: int = SHARDS):
        self.spark, self.min_docs, self.min_chars, self.shards = spark, min_docs, min_chars, shards
        self.postings = self._empty("key binary, doc long")
        self.refs = self._empty("key binary, refs long, last long")
        self.filters = self._empty("shard long, blob binary")

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards))

    def postings_of(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Distinct ``key, doc`` of the lines of ``docs``."""
        keys = F.array_distinct(F.array_compact(line_keys(lines_of(F.col(text_col)), self.min_chars)))
        flat = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.explode(keys).alias("key"))
        return flat.select("key", "doc").distinct()

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add documents and return their postings. Ids the index has are replaced."""
        added = stored(self.postings_of(docs, id_col, text_col), "line-postings")
        if not self.postings.isEmpty():
            self.delete(docs.select(F.col(id_col).cast("bigint").alias("doc")))
        counted = added.groupBy("key").agg(F.count("*").alias("refs"), F.max("doc").alias("last"))
        old = self.refs
        refs = stored(
            old.unionByName(counted).groupBy("key").agg(F.sum("refs").alias("refs"), F.max("last").alias("last")), "line-refs"
        )
        self._change(old, refs)
        self.postings, self.refs = self.postings.unionByName(added), refs
        return added

    def delete(self, ids: DataFrame) -> None:
        """Take the documents with the ids in column ``doc`` back out."""
        gone = ids.select("doc").distinct().withColumn("_gone", F.lit(True))
        split = self.postings.join(gone, self.postings["doc"].eqNullSafe(gone["doc"]), "left").select(
            "key", self.postings["doc"].alias("doc"), F.coalesce("_gone", F.lit(False)).alias("gone")
        )
        split = stored(split, "line-split")
        left = split.where("not gone").select("key", "doc")
        old = self.refs
        touched = split.where("gone").select("key").distinct()
        again = left.join(touched, "key", "left_semi").groupBy("key").agg(F.count("*").alias("refs"), F.max("doc").alias("last"))
        refs = stored(old.join(touched, "key", "left_anti").unionByName(again), "line-refs")
        self._change(old, refs)
        self.postings, self.refs = left, refs

    def _change(self, old: DataFrame, new: DataFrame) -> None:
        """Bring the filters from the repeated keys of ``old`` to those of ``new``."""
        keys = lambda refs, sign: refs.where(F.col("refs") >= self.min_docs).select("key", F.lit(sign).alias("sign"))
        moved = keys(new, 1).unionByName(keys(old, -1)).groupBy("key").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        moved = moved.withColumn("shard", self._shard())

        def update(shard: tuple, have: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            own = Cuckoo.load(have["blob"][0]) if len(have) else Cuckoo.sized(int((change["sign"] > 0).sum()) * 2)
            own.remove(_numbers(change.loc[change["sign"] < 0, "key"]))
            fits = own.insert(_numbers(change.loc[change["sign"] > 0, "key"]))
            return pd.DataFrame({"shard": [shard[0]], "blob": [own.dump() if fits else None]})

        have = self.filters.groupBy("shard")
        filters = stored(have.cogroup(moved.groupBy("shard")).applyInPandas(update, "shard long, blob binary"), "line-filters")
        full = filters.where("blob is null").select("shard")

        def build(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": part["shard"][:1], "blob": [Cuckoo.build(_numbers(part["key"])).dump()]})

        if not full.isEmpty():
            anew = new.where(F.col("refs") >= self.min_docs).select("key", self._shard().alias("shard"))
            anew = anew.join(F.broadcast(full), "shard", "left_semi").groupBy("shard").applyInPandas(build, "shard long, blob binary")
            filters = stored(filters.where("blob is not null").unionByName(anew), "line-filters")
        self.filters = filters

    def drops(self, postings: DataFrame) -> DataFrame:
        """``key, doc`` of ``postings`` whose lines are to go: repeated keys outside their largest document."""
        repeated = self.refs.where(F.col("refs") >= self.min_docs)
        hot = stored(heavy_keys(self.refs, "key", "refs").join(repeated, ["key", "refs"]).select("key", "last"), "hot-lines")
        marked = postings.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "key", "left")
        known = marked.where("_hot").select("key", "doc", "last")

        def probe(shard: tuple, lines: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            found = lines[["key", "doc"]]
            if not len(have) or not len(lines):
                return found[:0]
            return found[Cuckoo.load(have["blob"][0]).holds(_numbers(lines["key"]))]

        rest = marked.where("_hot is null").select("key", "doc", self._shard().alias("shard"))
        maybe = rest.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "key binary, doc long")
        exact = maybe.join(repeated.select("key", "last"), "key")
        return known.unionByName(exact).where(~F.col("doc").eqNullSafe(F.col("last"))).select("key", "doc")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: DataFrame | None = None) -> DataFrame:
        """``docs`` with ``text_col`` without its repeated lines, plus ``n_lines`` and ``n_dropped``."""
        drops = self.drops(self.postings_of(docs, id_col, text_col) if postings is None else postings)
        gone = drops.groupBy(F.col("doc").alias("_line_doc")).agg(F.collect_list("key").alias("_gone"))
        joined = docs.join(gone, F.col(id_col).cast("bigint").eqNullSafe(F.col("_line_doc")), "left").drop("_line_doc")
        lines = lines_of(F.col(text_col))
        keep = F.filter(
            F.arrays_zip(lines.alias("line"), line_keys(lines, self.min_chars).alias("key")),
            lambda x: ~F.coalesce(F.array_contains(F.col("_gone"), x["key"]), F.lit(False)),
        )
        kept = F.when(F.col("_gone").isNull(), lines).otherwise(F.transform(keep, lambda x: x["line"]))
        return (
            joined.withColumn("_kept", kept)
            .withColumn("n_lines", F.size(lines).cast("bigint"))
            .withColumn("n_dropped", (F.size(lines) - F.size("_kept")).cast("bigint"))
            .withColumn(text_col, F.array_join("_kept", "\n"))
            .drop("_gone", "_kept")
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Index ``docs`` and take their repeated lines out."""
    index = LineIndex(docs.sparkSession, min_docs, min_chars)
    postings = index.insert(docs, id_col, text_col)
    return index.dedup(docs, id_col, text_col, postings)
