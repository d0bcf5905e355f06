"""Near-duplicates, packing, line dedup, nearest neighbours and page extraction."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicflow.llm import crosspolytope, linededup, minhash, packing, sitetree
from topicflow.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"


def words(rng, n, size=4000):
    return [f"w{x}" for x in rng.integers(0, size, n)]


def brute_components(rows, k, need, of):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if w:
            sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(sets[i] & sets[j])
            if common * of >= need * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets.get(i, ())), find(i) if i in root else i) for i, _ in rows}


@pytest.mark.parametrize("block", [384, 8])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for size in (40, 12, 5, 2, 2, 1, 1, 1):
        base = words(rng, int(rng.integers(30, 200)))
        for _ in range(size):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = f"new{at}"
            rows.append((at, " ".join(copy)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \t\n"), (at + 3, "Two words"), (at + 4, "two\tWORDS"), (at + 5, rows[0][1].upper())]
    rows.append((at + 6, " ".join(words(rng, 30_000))))
    rng.shuffle(rows)
    rows = [(int(i), t if t != "None" else None) for i, t in rows]
    given = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).withColumn("n", F.lit(1)).withColumn("id", F.lit(1))
    want = brute_components(rows, 3, 17, 20)
    got = minhash.near_duplicates(given, k=3, threshold=(17, 20), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_trees_come_back_as_stars(spark, monkeypatch):
    assert sorted(minhash.stars([(5, 4), (3, 4), (9, 5), (7, 8)])) == [(3, 4), (3, 5), (3, 9), (7, 8)]
    assert minhash.stars([]) == []
    # texts that slide along one another: neighbours are linked, distant ones only through them
    run = words(np.random.default_rng(8), 180)
    rows = [(i, " ".join(run[2 * i : 2 * i + 100])) for i in range(40)]
    seen, real = [], minhash.connected_components
    monkeypatch.setattr(minhash, "connected_components", lambda edges: seen.append(edges) or real(edges))
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0}
    assert sorted(map(tuple, seen[-1].collect())) == [(0, i) for i in range(1, 40)]


def test_near_duplicates_of_odd_tables(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "only here at all"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        [(None, 4, False), (4, 4, True), (4, 4, True), (None, None, False), (None, None, False)]
    )
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_corrected_estimate(bits):
    rng = np.random.default_rng(6)
    perms = minhash.permutations(512)
    both, one, two = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (800, 100, 100))
    sig = [np.frombuffer(minhash.pack(minhash.minima(np.concatenate([both, x]), perms), bits), np.uint8) for x in (one, two)]
    got = minhash.estimate(sig[0][None], sig[1][None], bits, 512)[0, 0]
    assert abs(got - 0.8) < 0.1
    assert minhash.estimate(sig[0][None], sig[0][None], bits, 512)[0, 0] == 1


def check_packing(rows, want, size):
    """Every token of every document is in exactly one place; returns the number of sequences."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for doc, ids in want.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.piece):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part)) and (r.length == size or at + r.length == len(ids))
            at += r.length
        assert at == len(ids)
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= size
    return len(places)


def test_packing_equals_tokenizer_and_is_tight(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(7)
    texts = [None, "", " ", "It's <|endoftext|> HERE", "naïve CAFÉ x y", "a\x1cb\x85c", "ÀÉ é", "12345 !!??", "x" * 5000]
    texts += [" ".join(words(rng, int(rng.integers(1, 900)))) for _ in range(300)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    given = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5).withColumn("piece", F.lit(1))
    for per_task in (50_000, 20):
        got = packing.pack_documents(given, tokenizer_path(), size=256, per_task=per_task).collect()
        used, bound = check_packing(got, want, 256), -(-sum(map(len, want.values())) // 256)
        assert bound <= used <= 1.05 * bound
    odd = spark.createDataFrame([(None, "a"), (None, None), (3, "b"), (3, "b")], DOCS)
    got = packing.pack_documents(odd, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter([(None, 2), (None, 1), (3, 2), (3, 2)])
    assert packing.pack_documents(odd.limit(0), tokenizer_path()).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(bins.fill) == [10, 10]


def brute_lines(rows, min_docs=3, min_chars=20):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blanks).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    gone = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_rows():
    rng = np.random.default_rng(8)
    pool = [f"A repeated line number {i:03d}" for i in range(30)] + ["short", "", "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ äöü"]
    rows = [(i, "\n".join(f" {x}\t" if rng.random() < 0.2 else x for x in rng.choice(pool, int(rng.integers(0, 9))))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (7, rows[7][1]), (None, pool[0]), (None, pool[1]), (103, "x" * 100_000 + "\n" + pool[2].upper())]
    return rows


def as_counter(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    given = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("x")).withColumn("doc", F.lit(1)).withColumn("key", F.lit(1))
    found = linededup.dedup_lines(given)
    assert as_counter(found) == brute_lines(rows) and {"doc", "key"} <= set(found.columns)
    assert linededup.dedup_lines(given.limit(0)).count() == 0


def test_line_index_is_reversible(spark):
    rows = line_rows()
    index = linededup.LineIndex(spark, shards=7)
    first, second = rows[:40], rows[40:]
    index.insert(spark.createDataFrame(first, DOCS))
    before = {r["key"]: (r["refs"], r["last"]) for r in index.refs.collect()}
    everything = spark.createDataFrame(rows, DOCS)
    index.insert(spark.createDataFrame([r for r in second if r[0] != 7], DOCS))
    assert as_counter(index.dedup(everything)) == brute_lines(rows)
    ids = sorted({r[0] for r in second if r[0] not in (None, 7)})
    index.delete(spark.createDataFrame([(i,) for i in [*ids, None]], "doc long"))
    assert {r["key"]: (r["refs"], r["last"]) for r in index.refs.collect()} == before
    assert as_counter(index.dedup(spark.createDataFrame(first, DOCS))) == brute_lines(first)
    index.insert(spark.createDataFrame(first[:5], DOCS))  # again: replaced, not counted twice
    assert {r["key"]: (r["refs"], r["last"]) for r in index.refs.collect()} == before


def test_cuckoo_filter_holds_and_removes():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    made = linededup.Cuckoo.build(keys)
    assert made.holds(keys).all()
    made.remove(keys[:2500])
    assert made.holds(keys[2500:]).all() and made.holds(keys[:2500]).mean() < 0.05
    again = linededup.Cuckoo.load(made.dump())
    assert again.holds(keys[2500:]).all()
    assert not linededup.Cuckoo(2).insert(keys[:100])


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((1500, 48)).astype(np.float32)
    x[200:400] = x[0]  # many equal vectors
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(2000, None), (2050, [0.0] * 48), (2100, [None] * 48), (2150, [float("nan")] * 48), (2200, [1.0] * 3), (None, [1.0] * 48), (2250, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("score", F.lit("x"))
    got = crosspolytope.search(table, F.col("vec_id") % 50 == 0, chunk=64).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 50))
    hits = 0
    for q, near in found.items():
        score = unit @ unit[q]
        score[q] = -2
        top = np.lexsort((np.arange(1500), -np.round(score, 12)))[:5]
        near.sort()
        assert [n[0] for n in near] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in near)
        hits += len(set(top) & {v for _, v, _ in near})
    assert hits / (5 * len(found)) >= 0.9
    assert [v for _, v, _ in sorted(found[0])] == [200, 201, 202, 203, 204]  # ties to the smaller id
    few = crosspolytope.search(table.where("vec_id < 3"), F.col("vec_id") == 0, probes=96).collect()
    assert {(r["rank"], r.vec_id) for r in few} <= {(1, 1), (2, 2), (1, 2)} and few
    assert crosspolytope.search(table.limit(0), F.lit(True)).count() == 0


def test_short_queries_get_all_candidates(spark):
    x = np.random.default_rng(31).standard_normal((4, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (3, x[3].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for few in (1, 2, 4):
        got = crosspolytope.search(table.where(F.col("vec_id") < few), F.lit(True)).collect()
        assert len(got) == few * (few - 1) and {(r.query_id, r.vec_id) for r in got} == {(a, b) for a in range(few) for b in range(few) if a != b}
    # rows that share few of the probed axes: still five each, and the nearest of all for those that met fewer
    x = np.random.default_rng(32).standard_normal((40, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in crosspolytope.search(table, F.col("vec_id") < 20, probes=1).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    for q in range(20):
        near = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:5]
        assert sorted(found[q]) == [(j + 1, i) for j, i in enumerate(near)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(11).standard_normal((7, 48))
    turned = crosspolytope.rotated(x, 3)
    assert turned.shape == (7, 64) and np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1))


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li>Menu</ul></nav><div class="ad-box">Buy</div><div id="cookie-notice">Cookies</div>
<article><h1>Head &amp; line</h1><p><b>First</b> part<br>goes&nbsp; on<p>Second &lt;p&gt;
<div class="related-links">More</div><form><input value=1>Send</form><!-- <p>no</p> --><ul><li>one<li>two</ul>
<section class="comments"><article>Reader</article></section></article><aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_article_pages(spark):
    rows = [
        (1, "http://a.example/1", ARTICLE),
        (2, "http://a.example/2", None),
        (3, None, ""),
        (4, "not a url", "plain text\n here"),
        (5, "http://b.example/", "<p>Open <i>tag <b>text</p> tail < 3 &amp; &unknown; <a href='x"),
        (6, "http://b.example/x", "<div>" * 300 + "deep" + "<p>x</p>" * 20_000),
        (1, "http://a.example/1", ARTICLE),
    ]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit(1)).withColumn("path", F.lit(2))
    got = sitetree.extract_pages(given).collect()
    text = defaultdict(list)
    for r in got:
        text[r.page_id].append(r.main_text)
    want = "Head & line\n\nFirst part goes on\n\nSecond <p>\n\none\n\ntwo"
    assert text[1] == [want, want] and text[2] == [""] and text[3] == [""] and text[4] == ["plain text here"]
    assert text[5][0].startswith("Open tag text") and text[6][0].count("x") == 20_000
    assert sitetree.extract_pages(given.limit(0)).count() == 0


def test_site_style_tree_drops_what_a_host_repeats(spark):
    rows = []
    for i in range(12):
        own = f"<div class=story><p>Story {i} tells of item {i * 7}.</p><p>A passage all stories share.</p></div>"
        rows.append((i, f"http://c.example/{i}", f"<body><div class=strip><p>Call now</p></div>{own}<div class=bottom><span>About us</span></div></body>"))
    rows += [(100 + i, f"http://d.example/{i}", "<body><div class=story><p>The same</p></div></body>") for i in range(12)]
    got = {r.page_id: r.main_text for r in sitetree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Story {i} tells of item {i * 7}.\n\nA passage all stories share."
        assert got[100 + i] == "The same"  # copies of one page are no template


def test_site_style_tree_counts_every_sibling(spark):
    rows = []
    for i in range(9):
        own = f"Story {i} tells of item {i * 7}."
        rows.append((i, f"http://e.example/{i}", f"<body><div>menu</div><div>{own}</div><div>imprint</div></body>"))
        # without the menu the article is the first sibling, and what varies may be the last
        rows.append((100 + i, f"http://f.example/{i}", f"<body>{'<div>menu</div>' * (i % 3)}<div>imprint</div><div>{own}</div></body>"))
    got = {r.page_id: r.main_text for r in sitetree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert got[i] == got[100 + i] == f"Story {i} tells of item {i * 7}."


def test_class_words_do_not_drop_articles(spark):
    def page(i, kind):
        own = f"<p>Story {i} tells of item {i * 7} at some length.</p>"
        return {
            0: f"<body><div class='content-sidebar-wrap'><main><article>{own}</article></main></div><aside>Side</aside></body>",
            1: f"<body><div class='no-sidebar'><div class='text'>{own}</div></div><div class='sidebar'>Ads</div></body>",
            2: f"<body><main><article class='post comments-open'>{own}</article><div id='comments'><article>Reader {i}</article></div></main></body>",
            3: f"<body><form id='aspnetForm'><div class='search-share'>{own}</div></form><div class='ad'>Buy</div></body>",
            # the prior is overruled, but not the tree
            4: f"<body><div class='notice'>{'All pages have this long notice. ' * 9}</div><div class='text'>{own}</div></body>",
            5: f"<body><nav><a>Menu</a><article>{own}</article></nav></body>",
        }[kind]

    rows = [(10 * i + kind, f"http://k{kind}.example/{i}", page(i, kind)) for i in range(8) for kind in range(6)]
    got = {r.page_id: r.main_text for r in sitetree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert [got[10 * i + kind] for kind in range(6)] == [f"Story {i} tells of item {i * 7} at some length."] * 6


def test_sha_of_kept_text(spark):
    from topicflow.llm.queries import QUERIES

    got = QUERIES["op5_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want


def test_encoder_generations_keep_ids(monkeypatch):
    import duckdb
    from tokenizers import Tokenizer

    from topicflow.llm import packing
    from topicflow.llm.queries import tokenizer_path

    monkeypatch.setattr(packing, "CACHED_WORDS", 60)  # many turnovers of both generations
    monkeypatch.setattr(packing, "TEXTS_AT_ONCE", 8)
    texts = [r[0] or "" for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id LIMIT 120").fetchall()]
    encoder, tokenizer = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    got = list(encoder.encode_all(texts + texts))
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts + texts]
    assert got == want
    assert encoder.old and encoder.old_parts  # the generations turned over


def test_encoder_parts_skip_the_normalizer():
    from tokenizers import Tokenizer

    from topicflow.llm import packing
    from topicflow.llm.queries import tokenizer_path

    encoder, tokenizer = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = ["word, Word... it's don't!! 'sa' a'b x_y __ 1a2 é,% İstanbul İ, ǅ ª¹ ¡qué! ÅÄ ñ#'s ##", "a\x1cb , .' '. <|endoftext|> straße ŉ a^`b", "", "x" * 300]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoder.encode_all(texts)) == want
    encoder.tokenizer = None  # Latin words need the merges alone
    assert list(encoder.encode_all(["brandnewword, anothernewword's İx!"])) == [
        np.array(tokenizer.encode("brandnewword, anothernewword's İx!", add_special_tokens=False).ids, "<u4").tobytes()
    ]
