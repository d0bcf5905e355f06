"""Merkle fingerprints against plain Python and against their SQL twin."""

import hashlib
import re

import duckdb
import pandas as pd
import pytest

from topicflow.llm import merkle


def brute_fp(text):
    text = text or ""
    leaves = [[hashlib.sha256(p.encode()).hexdigest()[:16] for p in s.split("\n")] for s in re.split(r"\n[ \t]*\n", text)]
    nodes = [hashlib.sha256("".join(ls).encode()).hexdigest()[:16] for ls in leaves]
    root = hashlib.sha256("".join(nodes).encode()).hexdigest()
    return f"{root}/{','.join(nodes)}/{';'.join(','.join(ls) for ls in leaves)}"


def brute_like(a, b):
    if a.split("/")[0] == b.split("/")[0]:
        return 1.0
    la, lb = set(re.split("[,;]", a.split("/")[2])), set(re.split("[,;]", b.split("/")[2]))
    return len(la & lb) / len(la | lb)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        fp, efp, nfp = brute_fp(text), brute_fp(edited), brute_fp(nxt)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, efp, brute_like(fp, efp), brute_like(fp, nfp)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[4]))


ROWS = [
    (5, "one\ntwo\nthree\n\nfour five\nsix"),
    (4, "one\ntwo\nthree\n\nfour five\nsix"),
    (9, None),
    (3, ""),
    (None, "orphan\n \nline"),
    (7, "日本語のテキスト😀\nsecond line\n\t\nsection two"),
    (7, "日本語のテキスト😀\nsecond line\n\t\nsection two"),
    (2, "a"),
    (8, "x" * 50_000 + "\n" + "y" * 10),
]


@pytest.mark.parametrize("per_range, chars", [(200_000, 64 << 20), (2, 64 << 20), (200_000, 40)])
def test_fingerprints_brute(spark, per_range, chars):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("fingerprint", merkle.F.lit(1)).repartition(5)
    got = merkle.fingerprints(df, rows_per_range=per_range, chars_per_range=chars).collect()
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted((tuple(r[c] for c in cols) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[4]))
    assert got == brute(ROWS)
    # equal texts, equal fingerprints; the edit sits in the second half
    fps = {r[0]: r[3] for r in got}
    assert fps[4] == fps[5]
    assert all(0.0 <= r[5] <= 1.0 and 0.0 <= r[6] <= 1.0 for r in got)


def test_fingerprint_sql_twin(spark):
    frame = pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(merkle.fingerprint_sql("documents")).fetchall()
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[4]))
    assert want == brute(ROWS)


def test_changed_sections_and_empty(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n\nc"), (0, "z\n\nq")], "doc_id long, text string")
    rows = {r.doc_id: r for r in merkle.fingerprints(df).collect()}
    # "a\n\nb\n\nc" (7 code points) keeps "a\n\nb" and takes "z\n\n": its second and third sections change
    assert rows[1].changed_sections == [2, 3]
    assert merkle.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
