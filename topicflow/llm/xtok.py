"""Alignment of two tokenizers' tokens over the bytes of each text, with an associative fragment monoid.

Tokenizer A (byte-level BPE) encodes ``" " + text``, tokenizer B (SentencePiece BPE, which adds the
space itself) encodes ``text``, both without special tokens. A token's bytes are A's vocabulary entry
through the byte-level alphabet, or B's piece in UTF-8 with U+2581 as a space and ``<0xHH>`` as byte HH.
A text has tokens only if both token streams join to exactly the bytes of ``" " + text``.

Byte offsets where an A token and a B token both end cut the streams into groups; a link is an A token
occurrence and a B token occurrence whose byte ranges overlap. A (A id, B id) pair's count is the number
of documents (rows) holding it linked.

Fragments. A text's byte range is described by a ``Fragment``: the tokens of an open prefix (before its
first common cut), its closed groups and the tokens of an open suffix (after its last common cut).
``combine`` is associative: the suffix of the left and the prefix of the right become one closed group
when the join is a common cut of both streams, else an open middle. Very long texts are cut into
segments at single spaces between two non-blank characters: both tokenizers start a token there (A's
pre-tokenizer starts a word with its space, B splits at spaces), so each segment is encoded on its own,
is a closed fragment, and segments spread over tasks; a document's fragments are then composed in
segment order. Only documents with more than one segment are shuffled by segment.

Results per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. ``n_best`` counts
links whose pair count is the highest of their A id over the corpus (ties included); ``count_sum`` sums
the pair counts over links. ``groups_sha256`` hashes ``a1,a2|b1;a3|b2,b3`` (decimal ids) and is ''
without tokens. Null or empty texts, and texts that fail the byte check, have zeros and ''. Null doc_ids
are kept; repeated rows are separate documents. Other input columns are ignored. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import salted_join, stored, texts_of

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
# a text longer than this many code points is cut into segments of about this size
SEGMENT_CHARS = 200_000
# a pair's B id takes the low 16 bits of its key
B_BITS = 16
# pair statistics up to this many rows travel with the tasks; beyond, a salted join
BROADCAST_PAIRS = 2_000_000
SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the other bytes in order
    for the characters from U+0100 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            table[chr(256 + extra)] = b
            extra += 1
    return table


@dataclass
class Fragment:
    """Tokens ``(a_ids, b_ids)`` of a byte range. With ``groups`` None the range holds no common cut and
    ``prefix`` is its open run; else ``prefix`` precedes the first cut, ``groups`` lie between cuts and
    ``suffix`` follows the last one (empty where the range itself begins or ends on a cut). ``ok`` is the
    byte check."""

    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    groups: list[tuple[list[int], list[int]]] | None = None
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    ok: bool = True


def _join(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return x[0] + y[0], x[1] + y[1]


def combine(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two adjacent byte ranges: associative, with ``Fragment()`` (an empty open run) as
    identity. Where both sides have cuts, the left's suffix and the right's prefix close one group."""
    ok = left.ok and right.ok
    if left.groups is None and right.groups is None:
        return Fragment(_join(left.prefix, right.prefix), None, ([], []), ok)
    if left.groups is None:
        return Fragment(_join(left.prefix, right.prefix), right.groups, right.suffix, ok)
    if right.groups is None:
        return Fragment(left.prefix, left.groups, _join(left.suffix, right.prefix), ok)
    middle = _join(left.suffix, right.prefix)
    groups = left.groups + ([middle] if middle[0] or middle[1] else []) + right.groups
    return Fragment(left.prefix, groups, right.suffix, ok)


def closed(groups: list[tuple[list[int], list[int]]], ok: bool = True) -> Fragment:
    """A fragment that begins and ends on common cuts, such as a segment."""
    return Fragment(([], []), list(groups), ([], []), ok)


def render(groups: list[tuple[list[int], list[int]]]) -> str:
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """``" " + text`` cut before single spaces between non-blanks into pieces of about ``size`` code
    points; every piece starts with its space."""
    whole = " " + text
    if len(whole) <= size:
        return [whole]
    pieces, start = [], 0
    while len(whole) - start > size:
        cut = SAFE_CUT.search(whole, start + size)
        if cut is None:
            break
        pieces.append(whole[start : cut.start()])
        start = cut.start()
    pieces.append(whole[start:])
    return pieces


def _same_ranks(public_tokenizers, a_file: str):
    """tiktoken over the same vocabulary as ``a_file`` (its ``.tiktoken`` rank file, special strings as
    plain text), which encodes to the same ids several times faster; None without that file."""
    import base64
    import pathlib

    import tiktoken

    if not a_file.endswith(".json"):
        return None
    ranks_file = pathlib.Path(str(public_tokenizers.path(a_file))).with_suffix(".tiktoken")
    if not ranks_file.exists():
        return None
    with open(ranks_file, "rb") as handle:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, handle) if token}
    return tiktoken.Encoding(f"ranks-{a_file}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both tokenizers, read inside the task, and their tokens' bytes."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE):
        # a task has one core: the tokenizer's own thread pool would only contend with the other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(str(public_tokenizers.path(a_file)))
        self.a.encode_special_tokens = True
        self.fast_a = _same_ranks(public_tokenizers, a_file)
        alphabet = byte_alphabet()
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(alphabet.get(c, 0) for c in (self.a.id_to_token(i) or "")) for i in range(size)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(b_file)))
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.bytes_b.append(b"")
            else:
                self.bytes_b.append(piece.replace("▁", " ").encode())
        self.len_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.len_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.bytes_a, self.bytes_b = np.array(self.bytes_a, dtype=object), np.array(self.bytes_b, dtype=object)
        self.str_a = np.array([str(i) for i in range(len(self.bytes_a))], dtype=object)
        self.str_b = np.array([str(i) for i in range(len(self.bytes_b))], dtype=object)

    def render(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3`` without a loop over groups: A's then B's tokens of each group in order,
        each followed by its separator. Every group holds tokens of both."""
        group = np.concatenate([group_a, group_b])
        stream = np.concatenate([np.zeros(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)])
        order = np.argsort(group * 2 + stream, kind="stable")
        words = np.concatenate([self.str_a[ids_a], self.str_b[ids_b]])[order]
        g, s = group[order], stream[order]
        nxt_g, nxt_s = np.append(g[1:], -1), np.append(s[1:], -1)
        sep = np.full(len(order), ",", dtype=object)
        sep[(nxt_g == g) & (nxt_s != s)] = "|"
        sep[nxt_g != g] = ";"
        sep[-1] = ""
        out = np.empty(2 * len(order), dtype=object)
        out[0::2], out[1::2] = words, sep
        return "".join(out.tolist())

    def align(self, pieces: list[str]) -> list[tuple]:
        """Per piece (which starts with a space): ``(ok, a_ids, b_ids, group_of_a, group_of_b, n_groups,
        pair_keys, pair_counts)``."""
        out = []
        # one thread each: Spark gives every task its own core
        if self.fast_a is not None:
            encoded_a = [self.fast_a.encode_ordinary(p) for p in pieces]
        else:
            encoded_a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        encoded_b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        for piece, ea, ids_b in zip(pieces, encoded_a, encoded_b):
            ids_a = np.array(ea, np.int64)
            ids_b = np.array(ids_b, np.int64)
            raw = piece.encode()
            ok = (
                len(ids_a) > 0
                and len(ids_b) > 0
                and b"".join(self.bytes_a[ids_a].tolist()) == raw
                and b"".join(self.bytes_b[ids_b].tolist()) == raw
            )
            if not ok:
                out.append((False, None, None, None, None, 0, None, None))
                continue
            end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
            start_a, start_b = end_a - self.len_a[ids_a], end_b - self.len_b[ids_b]
            # both ends ascend strictly: the common ones by one search
            at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
            cuts = end_a[end_b[at] == end_a]
            group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
            # B tokens over an A token: from the first ending after its start to the last starting before its end
            lo = np.searchsorted(end_b, start_a, side="right")
            hi = np.searchsorted(start_b, end_a, side="left")
            many = np.where(end_a > start_a, hi - lo, 0)
            many = np.maximum(many, 0)
            who = np.repeat(np.arange(len(ids_a)), many)
            first = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            partner = first + np.arange(len(who))
            keep = end_b[partner] > start_b[partner]  # empty B tokens link with nothing
            keys = (ids_a[who[keep]] << B_BITS) | ids_b[partner[keep]]
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            pair_keys, pair_counts = keys[first], np.diff(np.append(first, len(keys)))
            out.append((True, ids_a, ids_b, group_a, group_b, len(cuts), pair_keys, pair_counts))
        return out


FRAGMENTS = (
    "_row long, doc_id long, seg int, n_segs int, ok boolean, n_a long, n_b long, n_groups long, "
    "groups string, groups_sha256 string, pair_keys array<long>, pair_counts array<long>, piece string"
)


def _fragment_rows(aligner: Aligner, rows: list[tuple], pieces: list[str]) -> dict[str, list]:
    cols = {name: [] for name in ("_row", "doc_id", "seg", "n_segs", "ok", "n_a", "n_b", "n_groups", "groups", "groups_sha256", "pair_keys", "pair_counts", "piece")}
    for (row, doc, seg, n_segs), found in zip(rows, aligner.align(pieces)):
        ok, ids_a, ids_b, group_a, group_b, n, keys, counts = found
        text = aligner.render(ids_a, ids_b, group_a, group_b) if ok else ""
        single = n_segs == 1
        for name, value in (
            ("_row", row), ("doc_id", doc), ("seg", seg), ("n_segs", n_segs), ("ok", ok),
            ("n_a", len(ids_a) if ok else 0), ("n_b", len(ids_b) if ok else 0), ("n_groups", n),
            ("groups", None if single else text),
            ("groups_sha256", (hashlib.sha256(text.encode()).hexdigest() if ok else "") if single else None),
            ("pair_keys", keys if ok else NONE), ("pair_counts", counts if ok else NONE), ("piece", None),
        ):
            cols[name].append(value)
    return cols


NONE = np.zeros(0, np.int64)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column; lists of int64 come from numpy arrays (None: a null list) without Python ints."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    sizes = np.array([0 if v is None else len(v) for v in values], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    flat = np.concatenate([v for v in values if v is not None]) if any(v is not None for v in values) else NONE
    mask = pa.array([v is None for v in values])
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()), mask=mask)


def _empty_row(cols: dict[str, list], row, doc) -> None:
    for name, value in (
        ("_row", row), ("doc_id", doc), ("seg", 0), ("n_segs", 1), ("ok", False), ("n_a", 0), ("n_b", 0),
        ("n_groups", 0), ("groups", None), ("groups_sha256", ""), ("pair_keys", NONE), ("pair_counts", NONE), ("piece", None),
    ):
        cols[name].append(value)


def fragments(docs: DataFrame, id_col: str, text_col: str, a_file: str, b_file: str, segment_chars: int) -> DataFrame:
    """One row per segment of every text: its closed fragment's counts, and its pairs with multiplicity.
    Segments of long texts are written once and dealt over tasks by (row, segment)."""
    schema = pa.schema(
        [
            ("_row", pa.int64()), ("doc_id", pa.int64()), ("seg", pa.int32()), ("n_segs", pa.int32()), ("ok", pa.bool_()),
            ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()),
            ("groups_sha256", pa.string()), ("pair_keys", pa.list_(pa.int64())), ("pair_counts", pa.list_(pa.int64())),
            ("piece", pa.string()),
        ]
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for texts in _chunks(batch.column(2)):
                cols = {name: [] for name in schema.names}
                todo_rows, todo = [], []
                for text in texts:
                    row, doc = rows[at], ids[at]
                    at += 1
                    if not text:
                        _empty_row(cols, row, doc)
                        continue
                    pieces = segments(text, segment_chars)
                    if len(pieces) > 1:  # long: written as segments, aligned in the second pass
                        for seg, piece in enumerate(pieces):
                            for name, value in zip(schema.names, (row, doc, seg, len(pieces), None, None, None, None, None, None, None, None, piece)):
                                cols[name].append(value)
                    else:
                        todo_rows.append((row, doc, 0, 1))
                        todo.append(pieces[0])
                if todo:
                    aligner = aligner or Aligner(a_file, b_file)
                    for name, values in _fragment_rows(aligner, todo_rows, todo).items():
                        cols[name].extend(values)
                if cols["_row"]:
                    yield pa.record_batch([_column(cols[n], schema.field(n).type) for n in schema.names], schema=schema)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_file, b_file)
        for batch in batches:
            meta = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            pieces = batch.column(4).to_pylist()
            for at in range(0, len(pieces), 8):
                cols = _fragment_rows(aligner, meta[at : at + 8], pieces[at : at + 8])
                yield pa.record_batch([_column(cols[n], schema.field(n).type) for n in schema.names], schema=schema)

    source = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    passed = stored(source.mapInArrow(first, FRAGMENTS), "xtok-first")
    done = passed.where(F.col("piece").isNull())
    todo = passed.where(F.col("piece").isNotNull()).select("_row", "doc_id", "seg", "n_segs", "piece")
    spread = todo.repartition("_row", "seg").mapInArrow(second, FRAGMENTS)
    return stored(done.unionByName(spread).drop("piece"), "xtok-fragments")


def _chunks(texts: pa.Array) -> Iterator[list]:
    return (list(chunk) for chunk in _batched(texts_of(texts, 64), 64))


def _batched(items, size):
    chunk = []
    for item in items:
        chunk.append(item)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def pair_statistics(frags: DataFrame) -> DataFrame:
    """``pair, count, best``: documents holding the pair linked, and whether that is its A id's highest."""
    single = frags.where("n_segs = 1").select("_row", F.explode("pair_keys").alias("pair"))
    multi = frags.where("n_segs > 1").select("_row", F.explode("pair_keys").alias("pair")).distinct()
    counts = single.unionByName(multi).groupBy("pair").agg(F.count("*").alias("count"))
    by_a = counts.groupBy(F.shiftright("pair", B_BITS).alias("_a")).agg(F.max("count").alias("_top"))
    return (
        counts.join(by_a, F.shiftright(counts["pair"], B_BITS) == by_a["_a"])
        .select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))
    )


def link_sums(frags: DataFrame, stats: DataFrame) -> DataFrame:
    """``_row, seg, n_links, n_best, count_sum`` per fragment."""
    stats = stored(stats, "xtok-pairs")
    n_pairs = stats.count()
    if n_pairs <= BROADCAST_PAIRS:
        # at most BROADCAST_PAIRS rows of 17 bytes: sorted keys and their values, with the tasks
        table = stats.orderBy("pair").toPandas() if n_pairs else None
        keys = table["pair"].to_numpy(np.int64) if n_pairs else np.zeros(0, np.int64)
        counts = table["count"].to_numpy(np.int64) if n_pairs else np.zeros(0, np.int64)
        best = table["best"].to_numpy(bool) if n_pairs else np.zeros(0, bool)
        shared = frags.sparkSession.sparkContext.broadcast((keys, counts, best))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts, best = shared.value
            for batch in batches:
                n = batch.num_rows
                pk = pc.list_flatten(batch.column(2)).to_numpy().astype(np.int64)
                many = pc.list_flatten(batch.column(3)).to_numpy().astype(np.int64)
                owner = pc.list_parent_indices(batch.column(2)).to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(keys, pk), max(len(keys) - 1, 0))
                # keys of a document whose other segments failed are not counted (and it is zeroed)
                known = keys[at] == pk if len(keys) else np.zeros(len(pk), bool)
                owner, many, at = owner[known], many[known], at[known]
                top = best[at]

                def total(weights, where=None):
                    chosen = slice(None) if where is None else where
                    return pa.array(np.rint(np.bincount(owner[chosen], weights=weights[chosen], minlength=n)).astype(np.int64))

                yield pa.record_batch(
                    [batch.column(0), batch.column(1), total(many), total(many, top), total(many * counts[at])],
                    ["_row", "seg", "n_links", "n_best", "count_sum"],
                )

        return frags.select("_row", "seg", "pair_keys", "pair_counts").mapInArrow(add, "_row long, seg int, n_links long, n_best long, count_sum long")
    occurrences = frags.select("_row", "seg", F.explode(F.arrays_zip("pair_keys", "pair_counts")).alias("p")).select(
        "_row", "seg", F.col("p.pair_keys").alias("pair"), F.col("p.pair_counts").alias("n")
    )
    joined = salted_join(occurrences, stats, "pair", ["_row", "seg"], "inner")
    return joined.groupBy("_row", "seg").agg(
        F.sum("n").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    )


def align_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a_file: str = A_FILE,
    b_file: str = B_FILE,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    frags = fragments(docs, id_col, text_col, a_file, b_file, segment_chars)
    # a long text with one failed segment has no tokens at all
    failed = frags.where("n_segs > 1 AND NOT ok").select("_row").distinct()
    sums = link_sums(frags, pair_statistics(frags.where("ok").join(failed, "_row", "left_anti")))
    parts = frags.join(sums, ["_row", "seg"], "left").select(
        "_row", "doc_id", "seg", "n_segs", "ok", "n_a", "n_b", "n_groups", "groups", "groups_sha256",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")],
    )
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    single = parts.where("n_segs = 1").select("_row", "doc_id", *columns, "groups_sha256")
    ordered = F.array_sort(F.collect_list(F.struct("seg", "groups")))
    multi = (
        parts.where("n_segs > 1")
        .groupBy("_row", "doc_id")
        .agg(F.min(F.col("ok").cast("int")).alias("_ok"), *[F.sum(c).alias(c) for c in columns], ordered.alias("_g"))
        .select(
            "_row",
            "doc_id",
            *[F.when(F.col("_ok") == 1, F.col(c)).otherwise(0).cast("long").alias(c) for c in columns],
            F.when(F.col("_ok") == 1, F.sha2(F.array_join(F.transform("_g", lambda g: g["groups"]), ";"), 256))
            .otherwise(F.lit(""))
            .alias("groups_sha256"),
        )
    )
    return single.unionByName(multi).drop("_row")
