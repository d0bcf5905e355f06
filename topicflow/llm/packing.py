"""Best-fit packing of tokenized documents into sequences, by a hierarchy of rounds.

Round 0: every partition tokenizes its documents, cuts those longer than ``size`` into pieces and packs its
pieces best-fit, longest first. Bins filled to ``full`` of their size are done; the others go on as items
of their own. Every further round merges the underfull bins of several partitions, again by best fit, in
fewer partitions of about ``per_task`` bins, until bins no longer become fewer. The rounds are written
tables, so a lost executor costs a partition of one round.

A bin travels with its members as one binary of fixed-width records (at most ``size`` of them), hence no
join is needed to find where a piece went. No task ever takes more than ``per_task`` bins, which is
the memory bound; the last round has as many tasks as that needs.

Defined results: a null text is empty; every document ends with token 0, so an empty one has length 1;
null ids and repeated rows are packed like others; other columns are ignored.
"""

from __future__ import annotations

import codecs
import os
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import stored, texts_of

RECORD = np.dtype([("null", "u1"), ("doc", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BIN = "fill int, members binary"
ODD_BLANKS = "\x1c", "\x1d", "\x1e", "\x1f"
# words of Latin letters and signs, for which every Unicode version has the same classes; several, joined by spaces
LATIN = re.compile("[\x21-\x7e\xa1-\u024f]+")
LATIN_WORDS = re.compile("[\x20-\x7e\xa1-\u024f]+")
# the tokenizer's own split of a word
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHED_WORDS, TEXTS_AT_ONCE, PARTS_AT_ONCE, SPECIAL, WORD_END = 300_000, 256, 200, "<|", "</w>"
ENCODERS: dict[str, Encoder] = {}  # of this Python worker, which serves many tasks
END = b"\0\0\0\0"
# the character a byte-level vocabulary writes for each byte; the space stays one, since it parts the parts
SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
HIDDEN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
BYTE_CHARS = "".join(" " if b == 0x20 else HIDDEN.get(b, chr(b)) for b in range(256))


def parts_of(word: str) -> str | tuple[str, ...]:
    """The tokenizer's split of a lower-cased word: a string if it has one part, else all of them.

    Letters, or letters and signs behind them, need no regex.
    """
    if word.isalpha():
        return word
    stem = word.rstrip(string.punctuation)
    return (stem, word[len(stem) :]) if stem.isalpha() else tuple(PARTS.findall(word))


class Encoder(dict):
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and its rules never look across it, nor across the runs of letters or
    signs it splits words into, so the ids of words and of their parts are remembered (bounded). Texts
    with separators that Python and the tokenizer's rules see differently are encoded whole, and so are
    words with other than Latin letters or with special tokens. Parts are lower-cased and split already,
    so their bytes go straight to the tokenizer's merges, past its normalizing and splitting.
    """

    def __init__(self, path: str):
        # a task has one core: the tokenizer's own thread pool would only contend with the other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # two generations each: when the young one is full it becomes the old one, and what is used
        # from the old one moves back, so frequent words and parts are never encoded again
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words not seen yet, their new parts all in one call."""
        split: dict[str, str | tuple[str, ...]] = {}
        together = " ".join(words)
        all_latin = LATIN_WORDS.fullmatch(together) and SPECIAL not in together
        for word in words:
            if all_latin or (LATIN.fullmatch(word) and SPECIAL not in word):
                split[word] = parts_of(word.lower())
            else:
                self[word] = self.whole(word)
        wanted: dict[str, None] = {}
        for parts in split.values():
            if parts.__class__ is str:
                wanted[parts] = None
            else:
                wanted.update(dict.fromkeys(parts))
        if len(self.parts) + len(wanted) > CACHED_WORDS:
            self.old_parts, self.parts = self.parts, {}
        for p in wanted:
            if p not in self.parts and p in self.old_parts:
                self.parts[p] = self.old_parts[p]
        new = [p for p in wanted if p not in self.parts]
        if new:
            groups = [new[i : i + PARTS_AT_ONCE] for i in range(0, len(new), PARTS_AT_ONCE)]
            texts = [codecs.charmap_decode(" ".join(g).encode(), "strict", BYTE_CHARS)[0] for g in groups]
            batch = self.merges.encode_batch_fast(texts, add_special_tokens=False)
            for group, found in zip(groups, batch, strict=True):
                ids = np.array(found.ids, "<u4")
                at = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
                if len(at) == len(group) + 1:  # every part ends with one token that closes a word
                    raw = ids.tobytes()
                    self.parts.update((p, raw[at[i] : at[i + 1]]) for i, p in enumerate(group))
                else:
                    self.parts.update((p, self.whole(p)) for p in group)
        for word, parts in split.items():
            self[word] = self.parts[parts] if parts.__class__ is str else b"".join([self.parts[p] for p in parts])

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Token bytes of every text."""
        texts = iter(texts)
        while part := list(islice(texts, TEXTS_AT_ONCE)):
            split = [None if any(b in t for b in ODD_BLANKS) else t.split() for t in part]
            needed = set().union(*(w for w in split if w))
            missing = [w for w in needed if w not in self]
            if len(self) + len(missing) > CACHED_WORDS:
                self.old, missing = dict(self), list(needed)
                self.clear()
            new = []
            for word in missing:
                if word in self.old:
                    self[word] = self.old[word]
                else:
                    new.append(word)
            self.learn(new)
            for text, words in zip(part, split, strict=True):
                yield self.whole(text) if words is None else b"".join(map(self.__getitem__, words))


class OpenBins:
    """Bins by free space; gives the fullest one that still takes an item."""

    def __init__(self, size: int):
        self.size = size
        self.free: dict[int, list[int]] = defaultdict(list)
        self.mask = 0  # bit f is set if a bin has f free
        self.fill: list[int] = []
        self.members: list[list[int]] = []

    def put(self, item: int, length: int) -> None:
        fitting = self.mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = self.free[room].pop()
            if not self.free[room]:
                self.mask &= ~(1 << room)
        else:
            room, at = self.size, len(self.fill)
            self.fill.append(0)
            self.members.append([])
        self.fill[at] += length
        self.members[at].append(item)
        room -= length
        if room:
            self.free[room].append(at)
            self.mask |= 1 << room


def best_fit(lengths: np.ndarray, size: int) -> OpenBins:
    """Best-fit, longest first."""
    bins = OpenBins(size)
    for item in np.argsort(-lengths, kind="stable"):
        bins.put(int(item), int(lengths[item]))
    return bins


def _bins_batch(lengths: np.ndarray, blobs: list[bytes], size: int) -> pa.RecordBatch:
    bins = best_fit(lengths, size)
    members = [b"".join([blobs[i] for i in own]) for own in bins.members]
    return pa.RecordBatch.from_arrays([pa.array(bins.fill, pa.int32()), pa.array(members, pa.binary())], names=["fill", "members"])


def _repack(size: int, per_task: int):
    """Pack a partition's bins, ``per_task`` of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill: list[int] = []
        blobs: list[bytes] = []
        for batch in batches:
            fill += batch.column(0).to_pylist()
            blobs += batch.column(1).to_pylist()
            if len(fill) >= per_task:
                yield _bins_batch(np.array(fill), blobs, size)
                fill, blobs = [], []
        if fill:
            yield _bins_batch(np.array(fill), blobs, size)

    return run


def pieces_of(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """``piece, start, length, crc`` of a document's token bytes."""
    step, out = 4 * size, []
    for number, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        out.append((number, at // 4, len(part) // 4, zlib.crc32(part)))
    return out


def tokenized_bins(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int, per_task: int) -> DataFrame:
    """Round 0: ``fill, members`` bins of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in ENCODERS:
            ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder = ENCODERS[tokenizer]
        records: list[tuple] = []

        def packed() -> pa.RecordBatch:
            table = np.array(records, RECORD)
            raw, width = table.tobytes(), RECORD.itemsize
            return _bins_batch(table["length"], [raw[i : i + width] for i in range(0, len(raw), width)], size)

        for batch in batches:
            texts = (t or "" for t in texts_of(batch.column(1)))
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                records += [(doc is None, doc or 0, *piece) for piece in pieces_of(ids + END, size)]
            if len(records) >= per_task:
                yield packed()
                records.clear()
        if records:
            yield packed()

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, BIN)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    full: float = 0.999,
    per_task: int = 50_000,
    fan_in: int = 8,
    max_rounds: int = 12,
) -> DataFrame:
    """One row per piece: ``<id_col>, piece, start, length, ids_crc32, sequence_id, offset``."""
    bins = stored(tokenized_bins(docs, id_col, text_col, tokenizer, size, per_task), "bins")
    enough = int(full * size)
    done = [bins.where(F.col("fill") >= enough)]
    open_bins = bins.where(F.col("fill") < enough)
    count = open_bins.count()
    tasks = max(1, -(-count // per_task))
    for _ in range(max_rounds):
        if not count:
            break
        # bins of all fill levels must meet: deal them by a hash of their members
        dealt = open_bins.repartition(tasks, F.xxhash64("members")) if tasks > 1 else open_bins.coalesce(1)
        merged = stored(dealt.mapInArrow(_repack(size, per_task), BIN), "bins")
        done.append(merged.where(F.col("fill") >= enough))
        open_bins = merged.where(F.col("fill") < enough)
        before, count = count, open_bins.count()
        least = max(1, -(-count // per_task))
        if tasks <= least and merged.count() > 0.995 * before:
            break
        tasks = max(least, tasks // fan_in)
    if count:
        done.append(open_bins)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column(1).to_pylist()
            table = np.frombuffer(b"".join(blobs), RECORD)
            counts = np.array([len(b) // RECORD.itemsize for b in blobs])
            ends = np.cumsum(table["length"].astype(np.int64))
            first = np.repeat(np.cumsum(counts) - counts, counts)
            begin = ends - table["length"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table["doc"].copy(), pa.int64(), mask=table["null"].astype(bool)),
                    pa.array(table["piece"].copy()),
                    pa.array(table["start"].copy()),
                    pa.array(table["length"].astype(np.int64)),
                    pa.array(table["crc"].astype(np.int64)),
                    pa.array(np.repeat(batch.column(0).to_numpy(), counts)),
                    pa.array(begin - begin[first]),
                ],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    numbered = every.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.mapInArrow(rows, schema)
