"""Cross-tokenizer alignment against plain Python."""

import hashlib
from collections import Counter

import pytest

from topicflow.llm import xtok

TEXTS = [
    "Hello  world, this is a test.\nNew line here; and some digits 12345.",
    "Ünïcödé text 日本語 and emoji 😀 mixed in.",
    "x<|endoftext|>y special strings stay text",
    "Hello world again and again and again",
    " leading blank",
    "trailing blank ",
    "tab\tinside and\r\nwindows lines",
]


def brute(rows):
    a = xtok.Aligner()
    per, holders = {}, Counter()
    for key, (doc, text) in enumerate(rows):
        if not text:
            per[key] = (doc, None)
            continue
        raw = (" " + text).encode()
        ia = a.a.encode(" " + text, add_special_tokens=False).ids
        ib = a.b.encode(text)
        ba, bb = [a.bytes_a[i] for i in ia], [a.bytes_b[i] for i in ib]
        if b"".join(ba) != raw or b"".join(bb) != raw:
            per[key] = (doc, None)
            continue
        ra, rb, pos = [], [], 0
        for x in ba:
            ra.append((pos, pos + len(x)))
            pos += len(x)
        pos = 0
        for x in bb:
            rb.append((pos, pos + len(x)))
            pos += len(x)
        links = [(ia[i], ib[j]) for i, (s1, e1) in enumerate(ra) for j, (s2, e2) in enumerate(rb) if max(s1, s2) < min(e1, e2)]
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = []
        for lo, hi in zip([0] + cuts, cuts):
            groups.append(([ia[i] for i, (s, e) in enumerate(ra) if lo < e <= hi], [ib[j] for j, (s, e) in enumerate(rb) if lo < e <= hi]))
        text_g = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        per[key] = (doc, (len(ia), len(ib), len(cuts), links, hashlib.sha256(text_g.encode()).hexdigest()))
        holders.update(set(links))
    top = Counter()
    for (x, _), c in holders.items():
        top[x] = max(top[x], c)
    out = []
    for doc, found in per.values():
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, sha = found
        out.append((doc, n_a, n_b, n_groups, len(links), sum(holders[l] == top[l[0]] for l in links), sum(holders[l] for l in links), sha))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[7]))


def rows_of(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[7]))


ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(10, None), (11, ""), (12, TEXTS[0]), (None, TEXTS[3]), (13, " ".join(["word"] * 3000) + " end.")]


@pytest.mark.parametrize("segment", [200_000, 40])
def test_align_brute(spark, segment):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_a", xtok.F.lit("clash")).repartition(3)
    got = rows_of(xtok.align_documents(df, segment_chars=segment))
    assert got == brute(ROWS)
    assert any(r[1] > 0 for r in got) and any(r[1] == 0 for r in got)


def test_segments_cut_at_spaces():
    text = "aa bb  cc dd " * 20
    pieces = xtok.segments(text, 15)
    assert "".join(pieces) == " " + text and all(p.startswith(" ") for p in pieces) and len(pieces) > 3


def test_fragment_monoid():
    import itertools

    f = [
        xtok.Fragment(([1], [2]), [([3], [4])], ([5], [])),
        xtok.Fragment(([], [6]), [([7], [8])], ([], [])),
        xtok.Fragment(([9], []), None),
        xtok.closed([([10], [11])]),
        xtok.Fragment(([12], [13]), None, ok=False),
    ]
    for x, y, z in itertools.product(f, repeat=3):
        assert xtok.combine(xtok.combine(x, y), z) == xtok.combine(x, xtok.combine(y, z))
    for x in f:
        assert xtok.combine(xtok.Fragment(), x) == x == xtok.combine(x, xtok.Fragment())
    # an open run between two cut fragments closes into one group
    joined = xtok.combine(xtok.combine(f[0], f[2]), f[1])
    assert joined.groups == [([3], [4]), ([5, 9], [6]), ([7], [8])]
    # closed segments compose to their groups in order, which is how documents' segments are joined
    whole = xtok.combine(xtok.closed([([1], [2])]), xtok.closed([([3], [4]), ([5], [6])]))
    assert xtok.render(whole.groups) == ";".join([xtok.render([([1], [2])]), xtok.render([([3], [4]), ([5], [6])])])


def test_align_empty(spark):
    assert xtok.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rank_file_encodes_like_the_tokenizer():
    import duckdb

    a = xtok.Aligner()
    assert a.fast_a is not None
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    for text in texts + TEXTS:
        assert a.fast_a.encode_ordinary(" " + text) == a.a.encode(" " + text, add_special_tokens=False).ids
