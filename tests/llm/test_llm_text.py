"""Licences, language-model scores, toxicity, decontamination and placement."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from topicflow.llm import decontam, licenses, lmscore, maglev, toxicity
from topicflow.llm.common import WordHashes

DOCS = "doc_id long, text string"


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


def test_license_rules(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\n"
        "The above copyright notice and this permission notice shall be included in all copies.\n"
        'The software is provided "as is", without warranty of any kind, express or implied.\n'
        "In no event shall the authors or copyright holders be liable for any claim.\n"
    )
    rows = [
        (1, "Words. Licensed under the Apache License, Version 2.0."),
        (2, mit + "x" * 200_000),
        (3, None),
        (4, ""),
        (5, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."),
        (6, "a licensed plumber"),
        (7, "The software is provided as is, without warranty of any kind"),
        (7, "SPDX-License-Identifier: BSD-3-Clause"),
        (8, "Released under CC BY-SA 4.0; distributed under the terms of the Expat license"),
    ]
    # clashing names of other columns are replaced
    found = licenses.scan_licenses(docs(spark, rows).withColumn("licenses", F.lit(1))).collect()
    got = sorted((r.doc_id, r.licenses, r.unmatched) for r in found)
    assert got == [
        (1, "Apache-2.0", ""),
        (2, "MIT", ""),
        (3, "", ""),
        (4, "", ""),
        (5, "GPL-3,MIT", ""),
        (6, "", ""),
        (7, "", "<MITAsIs>"),
        (7, "SPDX-bsd.3.clause", ""),
        (8, "CC-by.sa.4.0,MIT", ""),
    ]
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_license_notices_in_wrapped_lines(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
    apache = """Copyright 2020 Someone
Licensed under the Apache License,
Version 2.0 (the "License");
you may not use this file except in compliance
with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from it.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
    gpl = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    notices = [mit, apache, bsd, gpl.format(";", ";", 2), gpl.format(":", ",", 3), gpl.format(";", ";", 2).replace("\n", " ")]
    rows = [(10 * i + j, f"Some words\n\n{t}\n\nMore") for i, n in enumerate(notices) for j, t in enumerate([n, "/*\n" + "\n".join(f" * {x}" for x in n.split("\n")) + "\n */"])]
    rows += [(100, "SPDX-License-Identifier: MIT\nint main"), (101, "Released under the MIT License\nby Someone"), (102, "Released\nunder the MIT\r\nLicense\nby Someone")]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for i, want in enumerate(["MIT", "Apache-2.0", "BSD-3", "GPL-2", "GPL-3", "GPL-2"]):
        assert got[10 * i] == got[10 * i + 1] == (want, ""), i
    assert [got[i] for i in (100, 101, 102)] == [("SPDX-mit", ""), ("MIT", ""), ("MIT", "")]


def test_every_license_sentence_has_a_hint():
    import re

    words = re.compile(licenses.HINT)
    for _, pattern in licenses.SENTENCES:
        if "(?:licensed|released|distributed) under" not in pattern:
            assert words.search(re.sub(r"\(\?:([^|)]*)[^)]*\)", r"\1", pattern)), pattern


def test_lm_scores_equal_plain_counting(spark):
    rows = [(1, "a b a c"), (2, "A b, x"), (3, None), (4, ""), (5, "c c c a " * 3000), (2, "A b, x")]
    wanted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    words, pairs = 1 << 18, 1 << 20
    given = docs(spark, rows).withColumn("n_tokens", F.lit("old"))
    got = lmscore.cross_entropy_difference(given, wanted, words=words, pairs=pairs).collect()
    tokens = {i: (t or "").lower().replace(",", " ").split() for i, t in rows}
    count = [[Counter(), Counter(), Counter()] for _ in range(2)]
    for i, _ in rows:
        for m in ([0, 1] if i == 1 else [1]):
            seq = tokens[i]
            before = ["<s>", *seq][:-1] if seq else []
            count[m][0].update(seq), count[m][1].update(before), count[m][2].update(zip(before, seq, strict=True))

    def loss(m, seq):
        n, out = sum(count[m][0].values()), 0.0
        for u, w in zip(["<s>", *seq][:-1], seq, strict=True):
            single = (count[m][0][w] + lmscore.ALPHA) / (n + lmscore.ALPHA * words)
            out -= math.log((count[m][2][u, w] + lmscore.MU * single) / (count[m][1][u] + lmscore.MU))
        return out / len(seq)

    assert len(got) == 6
    for r in got:
        seq = tokens[r.doc_id]
        assert r.n_tokens == len(seq)
        if seq:
            assert math.isclose(r.target_loss, loss(0, seq), rel_tol=1e-4)
            assert math.isclose(r.background_loss, loss(1, seq), rel_tol=1e-4)
            assert math.isclose(r.loss_difference, r.target_loss - r.background_loss, abs_tol=1e-9)
        else:
            assert r.target_loss is None and r.loss_difference is None
    assert lmscore.cross_entropy_difference(docs(spark, []), wanted).count() == 0


def test_lm_counts_more_pairs_than_any_table_of_slots(spark):
    # 1.5 million different pairs of 400 000 words; with 2^20 slots their counts ran into each other
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400_000, 5000))) for i in range(300)]
    wanted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs(spark, rows), wanted).collect()}
    count = [[Counter(), Counter(), Counter()] for _ in range(2)]
    for i, t in rows:
        seq = t.split()
        for m in (0, 1) if i < 30 else (1,):
            before = ["", *seq[:-1]]
            count[m][0].update(seq), count[m][1].update(before), count[m][2].update(zip(before, seq, strict=True))
    assert len(count[1][2]) > lmscore.PAIRS and (classes := len(count[1][0])) > lmscore.WORDS
    for i in (0, 299):
        seq = rows[i][1].split()
        for m, loss in enumerate((got[i].target_loss, got[i].background_loss)):
            word, context, pair = count[m]
            single = lambda w: (word[w] + lmscore.ALPHA) / (word.total() + lmscore.ALPHA * classes)  # noqa: E731, B023
            p = [(pair[u, w] + lmscore.MU * single(w)) / (context[u] + lmscore.MU) for u, w in zip(["", *seq[:-1]], seq, strict=True)]
            assert max(p) < 1 and math.isclose(loss, -sum(map(math.log, p)) / len(seq), rel_tol=1e-9)


def test_word_hashes_forget_and_stay_right():
    small = WordHashes(limit=2)
    words = [b"a", b"b", b"c", b"a"]
    assert small.of(words).tolist() == WordHashes().of(words).tolist() and len(small) <= 2


def test_toxicity_learns_words_and_finds_the_sentence(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(int(rng.integers(1, 8)))]
        if i % 3 == 0:
            at = int(rng.integers(len(sentences)))
            sentences[at] += rng.choice([" idiot", " scumbag", " scumling"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(i % 3 == 0)))
    labels += [(None, 1), (5, None), (900, 1)]
    table = docs(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_model(table, known, F.col("doc_id") % 2 == 0)
    extra = [(1000, None), (1001, ""), (1002, "..."), (1003, "Waa wab. You SCUMBAG!! Wac"), (1003, "Waa wab. You SCUMBAG!! Wac"), (1004, "wab. " * 20_000)]
    scored = toxicity.score_documents(docs(spark, rows + extra).withColumn("toxic_score", F.lit("old")), model).collect()
    by = {r.doc_id: r for r in scored}
    held = [r for r in scored if r.doc_id < 600 and r.doc_id % 2]
    right = sum((r.toxic_score >= 0.7) == (r.doc_id % 3 == 0) for r in held)
    assert right / len(held) > 0.97
    assert by[1003].toxic_score > 0.7 and by[1003].worst_sentence == 1
    assert all(0 <= by[i].toxic_score < 0.1 for i in (1000, 1001, 1002)) and by[1000].toxic_score == by[1002].toxic_score
    assert 0 <= by[1004].toxic_score <= 1 and by[1004].n_sentences == 20_000
    # the scores are the noisy-or of the sentence probabilities
    text = "waa idiot. wab scumbag. wac"
    p = 1 / (1 + np.exp(-model.logits(text)))
    assert math.isclose(model.score(text)[0], 1 - np.prod(1 - p), rel_tol=1e-9)
    # one class only, no labels at all, no documents
    none = toxicity.train_model(table, known.where("toxic = 0"), F.lit(True))
    assert none.score("idiot")[0] < 1e-9
    assert toxicity.train_model(docs(spark, []), known, F.lit(True)).score("idiot")[0] < 1e-9
    assert toxicity.score_documents(docs(spark, []), model).count() == 0


def test_maximum_likelihood_slope():
    rows = [(True, 1, [[0], [1]]), (False, 2, [[1]]), (True, 0, [[0, 1]]), (False, 3, [])]
    whole = toxicity.Bags.of(rows)
    parts = toxicity.Bags.joined([toxicity.Bags.of(rows[:1]), toxicity.Bags.of(rows[1:])])
    assert all((getattr(whole, n) == getattr(parts, n)).all() for n in ("toxic", "plain", "bag", "sentence", "feature"))
    model = toxicity.fit(whole, ["=bad", "=ok"], steps=300, ridge=0.0)
    assert model.weights["=bad"] > 3 and model.weights["=bad"] > model.weights["=ok"]


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 5, int(rng.integers(0, 12))).tolist() for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(a, b) == table[-1][-1]


def test_randomised_svd_spans_the_passages(spark):
    rng = np.random.default_rng(2)
    weights = rng.random(40) + 0.5
    rows = [rng.integers(0, 40, 12).tolist() for _ in range(15)]
    basis = decontam.randomised_svd(spark.createDataFrame([(r,) for r in rows], "ids array<int>").repartition(3), weights, 20)
    dense = np.zeros((15, 40))
    for i, r in enumerate(rows):
        np.add.at(dense[i], r, 1)
    dense = dense * weights
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-6)


def test_leaks_and_paraphrases(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("bcdfgklmnprst"), 3)) + rng.choice(list("aeiou"))
    filler = [word() for _ in range(3000)]
    items = [" ".join(rng.choice(filler, 25)) for _ in range(20)]
    background = lambda n: " ".join(rng.choice(filler, n))
    rows = [(i, background(120)) for i in range(300)]
    rows += [(1000 + k, f"{background(int(rng.integers(0, 200)))} {t.upper()} {background(30)}") for k, t in enumerate(items)]
    for k, t in enumerate(items):  # every sixth word changed, another put in
        words = t.split()
        words[::6] = [word() for _ in words[::6]]
        words.insert(7, word())
        rows.append((2000 + k, background(50) + " " + " ".join(words) + " " + background(50)))
    rows += [(3000, None), (3001, ""), (3002, background(30_000)), (3003, items[0]), (3003, items[0])]
    bench = spark.createDataFrame([*enumerate(items), (None, items[3]), (77, None), (78, "")], "item_id long, text string")
    given = docs(spark, rows).withColumn("leaks", F.lit(1))
    found = decontam.find_leaks(given, bench).collect()
    hits = {r.doc_id: {x.item_id for x in r.leaks} for r in found}
    assert len(found) == len(rows) and sum(r.doc_id == 3003 and {x.item_id for x in r.leaks} == {0} for r in found) == 2
    for k in range(20):
        want = {k, None} if k == 3 else {k}
        assert hits[1000 + k] == want and hits[2000 + k] == want
    assert all(not hits[i] for i in [*range(300), 3000, 3001, 3002])
    # blocks of the benchmark give the same
    again = decontam.find_leaks(docs(spark, rows), bench, block=8).collect()
    assert {r.doc_id: {x.item_id for x in r.leaks} for r in again} == hits
    assert all(not r.leaks for r in decontam.find_leaks(docs(spark, rows[:3]), bench.limit(0)).collect())
    assert decontam.find_leaks(docs(spark, []), bench).count() == 0


def test_leak_search_looks_words_up_by_column():
    texts = ["b a, A\tzz b", None, "", " .,!", "a", "-a-", "\u0130 a\x0bb\x0cc", "a\u00a0b a"]
    names = {w: i for i, w in enumerate(decontam.words_of("a b c d"))}
    want = [[names.get(w, -1) for w in decontam.words_of(t)] for t in texts]
    for step in (1, 3, 256):
        assert [x.tolist() for x in decontam.Vocabulary(names).encode(pa.array(texts), step)] == want


def test_items_whose_answer_words_are_missing_are_not_searched():
    class Items(list):
        seen: list[int] = []

        def __getitem__(self, item):
            self.seen.append(item)
            return super().__getitem__(item)

    # two items of the same direction: the document has all words of the first, one answer word of the second
    items, unit = Items([np.array([0, 1, 2]), np.array([0, 3, 4])]), np.array([[1.0], [1.0]])
    names = {w: i for i, w in enumerate(decontam.words_of("a b c d e"))}
    block = decontam.Block(names, np.ones((5, 1), np.float32), np.ones(5, bool), np.array([0, 1]), unit, [7, 8], items, [3, 3], [{0, 1, 2}, {0, 3, 4}])
    found = decontam.matches_in(np.array([-1, 0, 1, 2, -1], np.int32), block, 64, 0.35, 0.6, 0.6)
    assert found == [(7, 1.0, 1.0, 1.0)] and set(Items.seen) == {0}


def test_maglev_is_even_and_stable(spark):
    names = [f"s{i}" for i in range(10)]
    full, less = (maglev.lookup_table(n, 10_007) for n in (names, names[:-1]))
    sizes = Counter(full)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 10
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 9)
    assert moved / len(full) < 0.1
    rows = spark.createDataFrame([(i, "x") for i in range(500)] + [(None, "x"), (3, "y")], "k long, slot string")
    got = maglev.place(rows, "k", names, 10_007).collect()
    assert len(got) == 502
    for r in got:
        key = "" if r.k is None else str(r.k)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 10_007
        assert (r.slot, r.shard) == (slot, names[full[slot]])
    assert maglev.place(rows.limit(0), "k", names).count() == 0


def test_maglev_turns():
    # every slot belongs to the shard that claims it first when shards take turns
    names, size = ["a", "b", "c"], 13
    at = [maglev._half(n, 0) % size for n in names]
    step = [maglev._half(n, 1) % (size - 1) + 1 for n in names]
    orders = [[(at[i] + j * step[i]) % size for j in range(size)] for i in range(3)]
    want = {}
    while len(want) < size:
        for i in range(3):
            free = [s for s in orders[i] if s not in want]
            if free:
                want[free[0]] = i
    assert maglev.lookup_table(names, size) == [want[s] for s in range(size)]


def test_model_packs_hold_hashes_and_counts():
    import zlib

    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 40_000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        counts = np.where(rng.random(len(hashes)) < 0.01, rng.integers(250, 2**40, len(hashes)), rng.integers(0, 3, len(hashes)))
        packed = lmscore.pack_hashes(hashes), lmscore.pack_counts(counts)
        assert (lmscore.unpack_hashes(packed[0]) == hashes).all() and (lmscore.unpack_counts(packed[1]) == counts).all()
        # what a block sends for a hash: a row of four numbers took 12 bytes
        assert n < 2 or len(zlib.compress(packed[0], 1)) + len(zlib.compress(packed[1], 1)) < 8 * n


def test_a_range_sums_over_blocks():
    import numpy as np
    import pyarrow as pa

    own = [np.array([2, 5, 2**63], np.uint64), np.array([5, 9], np.uint64), np.array([2**63], np.uint64)]
    t, b = [[0, 1, 0], [2, 0], [300]], [[1, 400, 7], [2, 3], [300]]
    sent = pa.table(
        {
            "_block": pa.array([4, 0, 2], pa.int32()),
            "_range": pa.array([1, 1, 1], pa.int32()),
            "hashes": [lmscore.pack_hashes(h) for h in own],
            "t": [lmscore.pack_counts(np.array(x)) for x in t],
            "b": [lmscore.pack_counts(np.array(x)) for x in b],
        }
    )
    got = lmscore.sums_of_range(sent).to_pylist()
    assert [r["_block"] for r in got] == [4, 0, 2]
    assert [lmscore.unpack_counts(r["t"]).tolist() for r in got] == [[0, 3, 300], [3, 0], [300]]
    assert [lmscore.unpack_counts(r["b"]).tolist() for r in got] == [[1, 402, 307], [402, 3], [307]]
