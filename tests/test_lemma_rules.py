from collections import Counter

from pyspark.sql import functions as F

from topicflow.operators import lemma_rules

DICT = [
    ("cities", "city"), ("ponies", "pony"), ("babies", "baby"), ("parties", "party"),
    ("cats", "cat"), ("dogs", "dog"), ("houses", "house"), ("trees", "tree"), ("books", "book"),
    ("running", "run"), ("sitting", "sit"), ("walking", "walk"), ("talking", "talk"), ("jumped", "jump"),
    ("walked", "walk"), ("talked", "talk"), ("glass", "glass"), ("class", "class"), ("boss", "boss"),
]


def brute_rules(pairs, context=2):
    examples = set(pairs) | {(l, l) for _, l in pairs}
    counts = Counter()
    for t, l in examples:
        p = 0
        while p < min(len(t), len(l)) and t[p] == l[p]:
            p += 1
        strip, tail = len(t) - p, l[p:]
        for k in range(max(strip, 1), min(strip + context, len(t)) + 1):
            counts[(t[-k:], strip, tail)] += 1
    best = {}
    for (ending, strip, tail), n in counts.items():
        key = (-n, strip, tail)
        if ending not in best or key < best[ending]:
            best[ending] = key
    return {e: (s, t, -n) for e, (n, s, t) in best.items()}


def brute_guess(token, rules, min_support=2):
    for k in range(len(token), 0, -1):
        r = rules.get(token[-k:])
        if r and r[2] >= min_support:
            return token[: len(token) - r[0]] + r[1]
    return token


def test_rules_against_brute_force(spark):
    dictionary = spark.createDataFrame(DICT, "token string, lemma string")
    got = {r["ending"]: (r["strip"], r["tail"], r["support"]) for r in lemma_rules.learn_rules(dictionary).collect()}
    want = brute_rules(DICT)
    assert got == want
    words = ["puppies", "ladies", "birds", "jumping", "kissed", "moss", "x", "", None]
    frame = spark.createDataFrame([(w,) for w in words], "token string")
    guessed = {r["token"]: r["lemma"] for r in lemma_rules.guess_lemmas(frame, lemma_rules.learn_rules(dictionary)).collect()}
    assert guessed == {w: brute_guess(w, want) for w in words if w is not None}
    assert guessed["puppies"] == "puppy" and guessed["birds"] == "bird" and guessed["moss"] == "moss"


def test_lemmatize_with_rules(spark):
    dictionary = spark.createDataFrame(DICT, "token string, lemma string")
    docs = spark.createDataFrame([(1, "cats chase puppies"), (2, None), (3, "")], "id int, text string")
    rows = {r["id"]: r["lemmatized"] for r in lemma_rules.lemmatize_with_rules(docs, dictionary, "id", "text").collect()}
    assert rows[1] == "cat chase puppy" and rows[3] == ""


def test_held_out_accuracy(spark):
    rows = [(w + "s", w) for w in (f"w{i}ord" for i in range(200))] + [(f"st{i}ory"[:-1] + "ies", f"st{i}ory"[:-1] + "y") for i in range(200)]
    dictionary = spark.createDataFrame(rows, "token string, lemma string")
    assert lemma_rules.held_out_accuracy(dictionary) >= 0.95
