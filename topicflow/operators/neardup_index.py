"""Near duplicates kept up to date batch by batch: a persistent band index with insert and delete.

Below ``path`` the index keeps, per batch, the MinHash signatures (``sigs``), their bands
(``bands``, in folders by a hash bucket of the band), spanning edges between near copies
(``edges``) and deleted ids (``deleted``). Signatures, bands and the agreement rule are those of
``dedupe.near_duplicate_groups``, so the groups are the same as a batch run over all live documents.

``add`` compares only the batch's documents, and only with documents that share one of their bands:
the bands are read from the buckets of the batch's bands alone (partition pruning). Comparisons run
in bounded blocks per band and return spanning edges, never all pairs of a group. ``delete``
tombstones ids; edges that touch them stop counting, and every other member of their groups is
compared again with the live documents of its bands, which restores all links that remain.
``groups`` labels the components of the live edges by their smallest id. Replaying a batch number
replaces what it wrote.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.operators import blocks, dedupe
from topicflow.operators.components import connected_components
from topicflow.session import stored_table

BUCKETS = 64


class NearDupIndex:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        id_type: str = "bigint",
        threshold: float = 0.8,
        shingle: int = 3,
        n_hashes: int = dedupe.N_HASHES,
        n_bands: int = dedupe.N_BANDS,
        block_rows: int = dedupe.BLOCK_ROWS,
        buckets: int = BUCKETS,
    ):
        if n_hashes - int(np.ceil(threshold * n_hashes)) >= n_bands:
            raise ValueError("n_bands must exceed the number of positions two near copies may differ in")
        self.spark, self.path, self.id_type = spark, path, id_type
        self.threshold, self.shingle, self.n_hashes, self.n_bands = threshold, shingle, n_hashes, n_bands
        self.block_rows, self.buckets = block_rows, buckets

    # storage
    def _read(self, name: str, schema: str) -> DataFrame:
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = hpath.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        full = f"{schema}, batch_id bigint"
        if not fs.exists(hpath):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, batch_id: int, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        writer = writer.partitionBy(by) if by else writer
        writer.parquet(f"{self.path}/{name}/batch_id={int(batch_id)}")

    def deleted(self) -> DataFrame:
        return self._read("deleted", f"id {self.id_type}").select("id").distinct()

    def signatures(self) -> DataFrame:
        return self._read("sigs", f"id {self.id_type}, sig array<int>").join(self.deleted(), "id", "left_anti").select("id", "sig")

    def _bands(self, sigs: DataFrame) -> DataFrame:
        width = self.n_hashes // self.n_bands
        bands = F.array(*[F.array(F.lit(i).cast("bigint"), F.xxhash64(F.slice("sig", i * width + 1, width))) for i in range(self.n_bands)])
        cells = sigs.select("id", "sig", F.explode(bands).alias("_cell"))
        return cells.withColumn("bucket", F.pmod(F.xxhash64("_cell"), F.lit(self.buckets)).cast("int"))

    def _live_bands(self, buckets: list[int]) -> DataFrame:
        stored = self._read("bands", f"id {self.id_type}, sig array<int>, _cell array<bigint>, bucket int")
        return stored.where(F.col("bucket").isin(buckets)).join(self.deleted(), "id", "left_anti").select("id", "sig", "_cell")

    def _link(self, probe: DataFrame) -> DataFrame:
        """Spanning edges between the ``probe`` signatures and the live documents sharing a band."""
        mine = self._bands(probe)
        buckets = sorted(r[0] for r in mine.select("bucket").distinct().collect())  # at most ``buckets`` values
        theirs = self._live_bands(buckets).join(mine.select("_cell").distinct(), "_cell", "left_semi")
        left_rows = mine.select("id", "sig", "_cell")
        right_rows = theirs.unionByName(left_rows).dropDuplicates(["id", "_cell"])
        left_cells, right_cells = blocks.cell_blocks(left_rows, self.block_rows), blocks.cell_blocks(right_rows, self.block_rows)
        left = blocks.with_blocks(left_rows, left_cells, "id")
        right = blocks.with_blocks(right_rows, right_cells, "id")
        pairs = blocks.block_pairs(left_cells, right_cells, [[0, 0]])
        schema = f"src {self.id_type}, dst {self.id_type}"
        edges = blocks.map_block_pairs(left, right, pairs, dedupe._agreeing(self.threshold), schema, self.block_rows)
        return edges.where(F.col("src") != F.col("dst"))

    # operations
    def add(self, docs: DataFrame, id_col: str, tokens: Column, batch_id: int) -> None:
        """Insert a batch of documents (ids new to the index)."""
        sigs = dedupe.signatures(docs, id_col, tokens, self.shingle, self.n_hashes).select(
            F.col("id").cast(self.id_type).alias("id"), "sig"
        )
        self._write(sigs, "sigs", batch_id)
        probe = self._read("sigs", f"id {self.id_type}, sig array<int>").where(F.col("batch_id") == int(batch_id)).select("id", "sig")
        # edges first: they read the stored bands, which a replay of this batch then replaces
        self._write(self._link(probe), "edges", batch_id)
        self._write(self._bands(probe), "bands", batch_id, by="bucket")

    def delete(self, ids: DataFrame, id_col: str, batch_id: int) -> None:
        """Remove documents; the other members of their groups are linked again."""
        gone = ids.select(F.col(id_col).cast(self.id_type).alias("id")).distinct()
        before = self.groups()
        touched = before.join(gone, "id").select("group").distinct()
        # written before the tombstones, which change what the index reads
        members = stored_table(before.join(touched, "group", "left_semi").select("id"), "neardup-touched")
        self._write(gone, "deleted", batch_id)
        probe = self.signatures().join(members, "id", "left_semi")
        self._write(self._link(probe), "edges", batch_id)

    def groups(self) -> DataFrame:
        """``id, group`` of every live document; ``group`` is the smallest id of its near copies."""
        nodes = self.signatures().select("id")
        gone = self.deleted()
        edges = self._read("edges", f"src {self.id_type}, dst {self.id_type}").select("src", "dst")
        edges = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        components = connected_components(edges.distinct())
        return nodes.join(components, nodes["id"] == components["node"], "left").select("id", F.coalesce("component", "id").alias("group"))
