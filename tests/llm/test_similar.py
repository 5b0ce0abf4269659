"""Near-duplicates and overlaps against brute force."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import near_duplicates, similar
from tallyforge.llm.components import components


def runs(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(w, w[1:], w[2:], strict=False)), tuple(w)


def linked(a, b):
    (ra, wa), (rb, wb) = runs(a), runs(b)
    if not wa or not wb:
        return False
    if not ra or not rb:
        return wa == wb
    return 5 * len(ra & rb) >= 3 * len(ra | rb)


def groups_of(texts):
    up = {k: k for k in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(texts, 2):
        if linked(texts[a], texts[b]):
            up[top(a)] = top(b)
    return {(a, b) if a < b else (b, a) for a, b in combinations(texts, 2) if top(a) == top(b)}


def corpus(n, seed):
    """Texts that share a boilerplate opening (a third of all), with edited, reordered and equal variants."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    made = []
    for k in range(n):
        if made and rng.random() < 0.6:
            words = list(rng.choice(made))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 60))]
            if k % 3 == 0:
                words = "solve the following problem step by step and give the result".split() + words
        made.append(words)
    return {f"r{k:04d}": " ".join(w) for k, w in enumerate(made)}


EDGES = {"n1": None, "n2": "", "n3": "  \n", "n4": "...", "s1": "Two words", "s2": "two, WORDS!", "s3": "two", "long": "lorem ipsum dolor " * 3000}


@pytest.mark.parametrize("block", [1024, 3])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = corpus(160, 1) | EDGES
    rows = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(texts.items())], "id string, t string, loaded_at int")
    again = rows.limit(10).withColumn("loaded_at", F.lit(-1)).withColumn("t", F.lit("an older delivery of this row"))
    given = near_duplicates.worded(rows.unionByName(again), F.col("t"), F.lit(0))
    got = near_duplicates.pairs_in_groups(near_duplicates.groups(given))
    assert {tuple(r) for r in got.collect()} == groups_of(texts)


def test_sides_stay_apart(spark):
    given = spark.createDataFrame([("a", "one two three four", 0), ("b", "one two three four", 1), ("c", "one two three four", 1)], "id string, words string, side int")
    got = near_duplicates.pairs_in_groups(near_duplicates.groups(given))
    assert [tuple(r) for r in got.collect()] == [("b", "c")]


@pytest.mark.parametrize("block", [1024, 2])
def test_overlaps_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = corpus(140, 2) | EDGES
    rows = [(k, t, i % 3 == 0) for i, (k, t) in enumerate(texts.items())]
    given = spark.createDataFrame([(k, t, int(h)) for k, t, h in rows], "id string, t string, side int")
    given = given.select("id", similar.plain_words(F.col("t")).alias("words"), "side", F.lit("validation").alias("split"), F.lit("d").alias("dataset")).where("words <> ''")
    got = near_duplicates.overlaps(given).collect()
    want = {(a, b) for a, ta, ha in rows if not ha for b, tb, hb in rows if hb and linked(ta, tb)}
    assert {(r.train_id, r.held_id) for r in got} == want and len(got) == len(want)
    for r in got:
        a, b = runs(texts[r.train_id])[0], runs(texts[r.held_id])[0]
        if b:
            assert r.containment == pytest.approx(len(a & b) / len(b)) and r.similarity == pytest.approx(len(a & b) / len(a | b))


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {x: x for e in edges if None not in e for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in up}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_third_of_all_rows_as_near_copies(spark, monkeypatch):
    """Blocks far beyond BLOCK rows: settled by their star, the rest compared with all."""
    monkeypatch.setattr(similar, "BLOCK", 20)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(40)]
    texts = {}
    for i in range(210):
        words = list(base) if i % 3 == 0 else [f"t{rng.randrange(300)}" for _ in range(30)]
        # some near-copies drift so far that only other near-copies tie them
        for _ in range(rng.choice([1, 1, 3, 5])):
            words[rng.randrange(len(words))] = f"u{i}"
        texts[f"r{i:03d}"] = " ".join(words)
    rows = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "id string, words string, side int")
    got = near_duplicates.pairs_in_groups(near_duplicates.groups(rows))
    assert {tuple(r) for r in got.collect()} == groups_of(texts)


@pytest.mark.parametrize("part", [1 << 16, 3])
def test_contained_texts_equal_brute_force(spark, monkeypatch, part):
    """Held-out texts inside longer training texts, a third of which are alike; runs met in parts."""
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    held = {f"h{i:03d}": " ".join(word() for _ in range(rng.randrange(5, 40))) for i in range(60)} | {"short": "two words", "null": None}
    train = {}
    for i in range(120):
        inner = rng.choice(list(held.values())[:60]).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            inner[rng.randrange(len(inner))] = "changed"
        around = [word() for _ in range(rng.choice([0, 10, 80]))]
        train[f"t{i:03d}"] = " ".join(around + inner + around) if i % 3 else " ".join(held["h000"].split() * 1 + ["and", "more", "of", "the", "same"])
    train["short too"] = "Two, words!"
    rows = [(k, t, 1) for k, t in held.items()] + [(k, t, 0) for k, t in train.items()]
    given = spark.createDataFrame(rows, "id string, t string, side int")
    given = given.select("id", similar.plain_words(F.col("t")).alias("words"), "side", F.lit("s").alias("split"), F.lit("d").alias("dataset")).where("words <> ''")
    got = near_duplicates.overlaps(given).collect()
    want = {}
    for a, ta in train.items():
        for b, tb in held.items():
            ra, rb = runs(ta)[0], runs(tb)[0]
            like = linked(ta, tb)
            if like or (rb and 5 * len(ra & rb) >= 4 * len(rb)):
                want[a, b] = like
    assert {(r.train_id, r.held_id): r.linked for r in got} == want and len(got) == len(want)
    assert sum(not x for x in want.values()) > 20


def test_hub_of_a_third_of_all_nodes(spark, monkeypatch):
    """One node that a third of all others are tied to, by its greatest and by its least name."""
    from tallyforge.operators import skew

    monkeypatch.setattr(skew, "FEW", 20)
    edges = [(i, 10_000) for i in range(200)] + [(i, -1) for i in range(1000, 1200)] + [(i, i + 1) for i in range(3000, 3010)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)).collect()}
    assert got == {i: 0 for i in [*range(200), 10_000]} | {i: -1 for i in [-1, *range(1000, 1200)]} | {i: 3000 for i in range(3000, 3011)}
