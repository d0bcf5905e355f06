"""Near-duplicate documents by b-bit MinHash.

A document's set holds the distinct hashes of its word shingles. Every permutation keeps the smallest
value of the set; bands of minima give candidate buckets, and of each minimum only the low ``bits`` are
retained, packed into a signature. Two signatures are compared by counting equal values in the packed
bits; as unequal minima agree by chance in ``2**-bits`` of the cases, the estimate is corrected by
``(p - c) / (1 - c)``. Pairs well below the threshold end there, all others are confirmed on full sets.

Steps and their bounds:

* Equal sets collapse to one class by digest; only classes go on, hot digests are salted.
* A bucket links its members to its smallest member, never to each other. Components of these links
  are *neighbourhoods*: all classes that share a band with one another, directly or through others.
* A neighbourhood is cut into random blocks of about ``block`` classes, each with the neighbourhood's
  first class. A block is compared in memory; the trees of its confirmed links come back as stars around
  their smallest class, so that components over them take few rounds.
* Neighbourhoods of several blocks are cut anew ``TURNS`` times. After that, the classes outside the
  largest linked part are compared with all blocks, one pair of blocks at a time. Classes that are linked
  already are skipped, so a large tight group costs about one comparison per class.

No pair of texts is emitted other than the stars' edges and no bucket is capped. The only approximate step
are the bands: a pair exactly at the threshold shares none of them with probability at most ``MISS``.

Defined results: null or empty texts have an empty set and are linked with nothing; fewer words than a
shingle form one shingle; rows with equal ids are one node; a null id takes the smallest id of its
class if it has copies and a null component otherwise; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import WordHashes, mix, salted_join, stored
from topicflow.operators.components import connected_components

MISS = 1e-6
SIGMAS = 5.0
STEP = 2048
TURNS = 3


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words (of all words, if there are fewer)."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(acc)


def word_shingles(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    # lower() and split() of bytes know ASCII letters and the six ASCII blanks only
    return shingles(hashes.of(text.lower().split()) if text else np.empty(0, np.uint64), k)


def band_count(threshold: float, rows: int) -> int:
    """Bands of ``rows`` minima so that a pair at ``threshold`` is missed with probability ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, (n, 1), dtype=np.uint32), rng.integers(0, 2**32, (n, 1), dtype=np.uint32) | np.uint32(1)


def minima(items: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest permuted value of the set under every permutation."""
    low, (flip, mul) = (items >> np.uint64(32)).astype(np.uint32), perms
    best = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), STEP):
        np.minimum(best, ((low[at : at + STEP] ^ flip) * mul).min(axis=1), out=best)
    return best


def pack(minimum: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of every minimum, packed."""
    planes = (minimum[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel()).tobytes()


def estimate(a: np.ndarray, b: np.ndarray, bits: int, perms: int) -> np.ndarray:
    """Collision-corrected similarity of each packed signature in ``a`` with each in ``b``."""
    differ = np.zeros((len(a), len(b)), np.int32)
    fold = sum(1 << (i * bits) for i in range(64 // bits))
    wide_a, wide_b = (np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).view(np.uint64) for x in (a, b))
    for i in range(wide_a.shape[1]):
        x = wide_a[:, i, None] ^ wide_b[None, :, i]
        any_bit = x.copy()
        for shift in range(1, bits):
            any_bit |= x >> np.uint64(shift)
        differ += np.bitwise_count(any_bit & np.uint64(fold)).astype(np.int32)
    p, chance = 1 - differ / perms, 2.0**-bits
    return (p - chance) / (1 - chance)


def cutoff(threshold: float, bits: int, perms: int) -> float:
    """Estimates below this are no candidates: ``SIGMAS`` standard errors under the threshold."""
    chance = 2.0**-bits
    p = chance + (1 - chance) * threshold
    return threshold - SIGMAS * math.sqrt(p * (1 - p) / perms) / (1 - chance)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, rows: int, bands: int, bits: int) -> DataFrame:
    """``id, n, digest, sig, bands``; ``digest`` is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, perms = WordHashes(), permutations(rows * bands)
        seed = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, digest, sig, keys = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                items = word_shingles(text.as_py(), k, hashes)
                n.append(len(items))
                if not len(items):
                    digest.append(None), sig.append(None), keys.append(None)
                    continue
                sums = mix(items), mix(items + np.uint64(0x632BE59BD9B4E019))
                digest.append(b"".join(s.sum(dtype=np.uint64).tobytes() for s in sums) + len(items).to_bytes(4, "little"))
                least = minima(items, perms)
                sig.append(pack(least, bits))
                acc = seed
                for i in range(rows):
                    acc = mix(acc + least[i * bands : (i + 1) * bands].astype(np.uint64))
                keys.append(acc.view(np.int64).tolist())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "digest", "sig", "bands"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "id long, n long, digest binary, sig binary, bands array<long>")


def linked_forest(
    node: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, sig: list, items: list, need: tuple[int, int], bits: int, perms: int
) -> list[tuple[int, int]]:
    """Spanning forest of the confirmed links between a row with ``left`` and one with ``right``.

    Rows of one ``label`` count as linked already.
    """
    part, of = need
    # several labels of one class can meet here (it stands on both sides); they are one tree
    order = np.lexsort((~left, node))
    rows, cols = order[left[order]], order[right[order]]
    if not len(rows) or not len(cols):
        return []
    items = [np.frombuffer(x, np.uint64) for x in items]
    size = np.array([len(x) for x in items])
    sig = np.array([np.frombuffer(x, np.uint8) for x in sig])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    near = estimate(sig[rows], sig[cols], bits, perms)
    small = np.minimum(size[rows][:, None], size[cols])
    large = np.maximum(size[rows][:, None], size[cols])
    good = (near >= cutoff(part / of, bits, perms)) & (small * of >= large * part) & (label[rows][:, None] != label[cols])
    # where both rows stand on both sides, one of the two orders is enough
    both = left & right
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    good &= ~(both[rows][:, None] & both[cols] & (place[rows][:, None] >= place[cols]))
    edges = []
    for i in np.flatnonzero(good.any(axis=1)):
        at = np.flatnonzero(good[i])
        for j in at[np.argsort(-near[i, at], kind="stable")]:
            x, y = rows[i], cols[j]
            a, b = find(int(label[x])), find(int(label[y]))
            if a == b:
                continue
            common = len(np.intersect1d(items[x], items[y], assume_unique=True))
            if common * of >= part * (size[x] + size[y] - common):
                root[b] = a
                edges.append((int(node[x]), int(node[y])))
    return edges


def stars(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The trees of ``edges`` as stars: every node with the smallest of its tree."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(find(x), x) for x in list(up)]


def forest(units: DataFrame, keys: list[str], need: tuple[int, int], bits: int, perms: int, block: int) -> DataFrame:
    """``src, dst``: the trees of the links within every unit (rows with equal ``keys``), as stars; small units share a task's group."""
    bundles = max(1, units.count() // block)
    names = [*keys, "node", "label", "left", "right", "sig", "items"]

    def run(table: pa.Table) -> pa.Table:
        own = np.column_stack([table.column(c).to_numpy() for c in keys])
        unit = np.unique(own, axis=0, return_inverse=True)[1].ravel()
        node, label, left, right = (table.column(c).to_numpy() for c in ("node", "label", "left", "right"))
        sig, items, edges = table.column("sig").to_pylist(), table.column("items").to_pylist(), []
        order = np.argsort(unit, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            if len(at) > 1:
                edges += linked_forest(node[at], label[at], left[at], right[at], [sig[i] for i in at], [items[i] for i in at], need, bits, perms)
        src, dst = zip(*stars(edges)) if edges else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    bundled = units.select(*names).withColumn("_bundle", F.pmod(F.xxhash64(F.lit(3), *keys), F.lit(bundles)))
    return bundled.groupBy("_bundle").applyInArrow(run, "src long, dst long")


def cut(areas: DataFrame, turn: int) -> DataFrame:
    """Add ``blk``: a random block of the area, every block for the area's first class."""
    own = F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    return areas.withColumn("blk", F.explode(F.when(F.col("node") == F.col("area"), every).otherwise(F.array(own))))


def _sides(left: bool, right: bool) -> list:
    return [F.lit(left).alias("left"), F.lit(right).alias("right")]


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: tuple[int, int] = (4, 5),
    rows: int = 7,
    bits: int = 4,
    block: int = 384,
) -> DataFrame:
    """One row per document: ``<id_col>, n_shingles, component_id, kept``.

    ``threshold`` is the linking similarity as a fraction of integers; links are symmetric and components
    are taken over them. ``kept`` marks the documents that have the smallest id of their component.
    """
    bands = band_count(threshold[0] / threshold[1], rows)
    perms = rows * bands
    base = stored(signatures(docs, id_col, text_col, k, rows, bands, bits), "minhash")

    classes = base.where("digest is not null").groupBy("digest").agg(F.min("id").alias("node"))
    classes = stored(classes.where("node is not null"), "classes")
    members = salted_join(base.select("id", "n", "digest"), classes, "digest", ["id"], "left")

    # a class's bands come from the document whose id it has
    bands_of = base.where("digest is not null").select("digest", F.col("id").alias("node"), "bands")
    keys = bands_of.join(classes, ["digest", "node"], "left_semi").select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared = stored(shared.where("first <> last").select("band", "first"), "buckets")
    hits = stored(keys.join(shared, "band", "left_semi"), "band-hits")
    star = salted_join(hits, shared, "band", ["node"], "inner").where("node <> first")
    # a class hangs on the smallest of its buckets' first members, and so do the others: few distinct pairs
    hung = star.groupBy("node").agg(F.min("first").alias("src"), F.collect_set("first").alias("firsts"))
    ends = F.array_append("firsts", F.col("node"))
    around = connected_components(hung.select("src", F.explode(ends).alias("dst")).where("src <> dst").distinct())
    around = around.withColumnRenamed("component", "area")
    blocks = around.groupBy("area").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    around = stored(salted_join(around, blocks, "area", ["node"], "inner"), "areas")

    # full sets of the classes that have a neighbourhood, made again from their texts
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), permutations(perms)
        for batch in batches:
            found = [word_shingles(x.as_py(), k, hashes) for x in batch.column("text").cast(pa.binary())]
            some = pa.array([len(x) > 0 for x in found])
            found = [x for x in found if len(x)]
            cols = [batch.column(c).filter(some) for c in ("node", "area", "blocks")]
            cols += [pa.array([f(x) for x in found], pa.binary()) for f in (lambda x: pack(minima(x, own), bits), np.ndarray.tobytes)]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "area", "blocks", "sig", "items"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text")).join(around, "node")
    full = texts.mapInArrow(sets, "node long, area long, blocks long, sig binary, items binary")
    full = stored(full, "sets")

    units = cut(full.withColumn("label", F.col("node")), 0).select("*", *_sides(True, True))
    links = stored(forest(units, ["area", "blk"], threshold, bits, perms, block), "links")
    wide = full.where("blocks > 1")
    if not wide.isEmpty():
        for turn in range(1, TURNS):
            found, links = _labelled(wide, links)
            units = cut(found, turn).select("*", *_sides(True, True))
            links = stored(links.unionByName(forest(units, ["area", "blk"], threshold, bits, perms, block)), "links")
        found, links = _labelled(wide, links)
        links = stored(links.unionByName(_rest_links(found, threshold, bits, perms, block)), "links")

    labels = connected_components(links)
    own = F.coalesce("node", "id")
    found = members.withColumn("_node", own).join(labels.withColumnRenamed("node", "_node"), "_node", "left")
    component = F.coalesce("component", "_node")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _labelled(full: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``full`` with the ``label`` of its component, and the components as one star each instead of ``links``."""
    labels = connected_components(links).withColumnRenamed("component", "label")
    found = full.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return found, labels.select(F.col("label").alias("src"), F.col("node").alias("dst"))


def _rest_links(wide: DataFrame, need: tuple[int, int], bits: int, perms: int, block: int) -> DataFrame:
    """Links of the classes outside the largest linked part of their area with the whole area."""
    sizes = wide.groupBy("area", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("area").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
    rest = wide.select("area", "node", "label").join(largest, "area").where("label <> main")
    counts = rest.groupBy("area").agg(F.ceil(F.count("*") / F.lit(block)).alias("rest_blocks"))
    counts = stored(counts, "rest-blocks")
    both = salted_join(wide, counts.join(largest.select("area", "main"), "area"), "area", ["node"], "inner")
    own = F.pmod(F.xxhash64(F.lit(99), "node"), F.col("blocks"))
    rest_own = F.pmod(F.xxhash64(F.lit(98), "node"), F.col("rest_blocks"))
    each = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    cols = ["area", "node", "label", "sig", "items"]
    right = both.select(*cols, own.alias("blk"), F.explode(each("rest_blocks")).alias("rest_blk"), *_sides(False, True))
    left = both.where("label <> main").select(
        *cols, F.explode(each("blocks")).alias("blk"), rest_own.alias("rest_blk"), *_sides(True, False)
    )
    return forest(left.unionByName(right), ["area", "blk", "rest_blk"], need, bits, perms, block)
