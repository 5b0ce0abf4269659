"""Copies behind formatting and splits of related records."""

import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyforge.llm import formatting, splits

SAME = ["A train, 3.5 km = 7!", "a  TRAIN 3.5 km=7", "“A” train​ — 3.5 km\t=\n7", "(a) train， $3.5$ km = 7？"]
OTHER = ["A train, 35 km = 7!", "A train, 3.5 km + 7!", "A train, 3.5 km 7", "train a 3.5 km = 7", "A train, -3.5 km = 7"]


def canonical(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in rows.select(formatting.canonical_text(F.col("t"))).collect()]


def test_canonical_text(spark):
    same, other = canonical(spark, SAME), canonical(spark, OTHER)
    assert len(set(same)) == 1 and len({*same, *other}) == 1 + len(OTHER)
    assert canonical(spark, ["Straße", "STRASSE", "", None, "?!", "12 3", "123"]) == ["strasse", "strasse", "", None, "", "12 3", "123"]


def test_canonical_record(spark):
    record = {"prompt": "How many?", "answer": "x = 3", "dataset": "core", "level": 2, "steps": "1 + 2 = 3"}
    mixed = {"level": 2, "steps": "1+2=3", "dataset": "CORE", "answer": "X=3.", "prompt": "how  many"}
    moved = record | {"prompt": "x = 3", "answer": "How many?"}
    payloads = [json.dumps(record), json.dumps(mixed, indent=3), json.dumps(moved), json.dumps(record)[:-5], None, "", "[1]", "3", json.dumps(record | {"level": 3})]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = [r[0] for r in rows.orderBy("i").select(formatting.canonical_record(F.col("p"))).collect()]
    assert got[0] == got[1] and got[3:8] == [None] * 5 and len({got[0], got[2], got[8]}) == 3


def test_groups_with_split_buckets(spark):
    """A third of all rows are one value, many share a long opening; buckets of 5 rows split again and again."""
    rng = random.Random(3)
    values = ["hot value"] * 100 + ["the same long opening of many texts " + rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(150)] + [None, "", ""]
    rng.shuffle(values)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "key bigint, c string").repartition(7)
    records, groups = formatting.copy_groups(rows, "key", "c", bucket_rows=5, bucket_bytes=1 << 20)
    want = defaultdict(list)
    for i, v in enumerate(values):
        if v is not None:
            want[v].append(i)
    assert sorted((r.kept_key, r.copies) for r in groups.collect()) == sorted((min(v), len(v)) for v in want.values())
    pairs = {tuple(r) for r in formatting.copies_of(records, groups).collect()}
    assert pairs == {(min(v), x) for v in want.values() for x in v if x != min(v)}


def test_trie_counts():
    trie = formatting.CountingTrie()
    for v, k in [(b"abc", 5), (b"abc", 2), (b"", 9), (b"a" * 40, 1), (b"a" * 39, 3), (b"a" * 40, 7), (b"abcd", 4)]:
        trie.add(v, k, 1)
    assert {e[0]: (e[1], e[2]) for e in trie.ends()} == {b"abc": (2, 2), b"": (9, 1), b"a" * 40: (1, 2), b"a" * 39: (3, 1), b"abcd": (4, 1)}


def related_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.35 else f"s{rng.randrange(n)}"
        rows.append((f"id{i:05d}", rng.choice([source, source, None]), rng.choice([None, f"s{rng.randrange(n)}", source, source]), rng.choice([None, -1, -1, rng.randrange(n)]), rng.choice(["train", "train", "validation"])))
    return rows


def test_related_rows_equal_union_find(spark):
    rows = related_rows(300, 4)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for id_, s, h, i, _ in rows:
        for k in [("h", s)] * (s is not None) + [("h", h)] * (h is not None) + [("i", i)] * (i is not None and i >= 0):
            up[top(("r", id_))] = top(k)
    made = splits.related(spark.createDataFrame(rows, "id string, source string, sha string, row_index bigint, split string"))
    got = {r.id: r.group for r in made.collect()}
    assert len(got) == len(rows)
    pairs = defaultdict(set)
    for r in rows:
        pairs[top(("r", r[0]))].add(got[r[0]])
    assert all(len(v) == 1 for v in pairs.values()) and len(pairs) == len(set(got.values()))
    spread = splits.spread_groups(made).collect()
    members = defaultdict(list)
    for r in rows:
        members[top(("r", r[0]))].append(r)
    want = {(r[0], min((x[1] for x in m if x[1]), default=None)) for m in members.values() if len({x[4] for x in m}) > 1 for r in m}
    assert {tuple(r) for r in spread} == want


def test_new_splits_keep_groups_and_proportions(spark):
    rows = [(f"r{i}", f"s{i // 3}", None, None, "train") for i in range(3000)] + [(f"h{i}", "hot", None, None, "train") for i in range(1000)]
    made = splits.related(spark.createDataFrame(rows, "id string, source string, sha string, row_index bigint, split string"))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("evaluation", 0.1), ("never", 0.0), (None, 0.5)], "split string, proportion double")
    got = splits.assign_splits(made, targets, bins=50).collect()
    assert len(got) == len(rows)
    by_group = defaultdict(set)
    for r in got:
        by_group[r.group_id].add((r.split, r.bin))
    assert all(len(v) == 1 for v in by_group.values())
    share = Counter(r.split for r in got)
    assert set(share) == {"train", "validation", "evaluation"} and abs(share["validation"] - 400) <= 60 and abs(share["evaluation"] - 400) <= 60


def test_largest_differencing():
    extra, load = splits.balanced_bins([(7, 3), (5, 2), (3, 4), (1, 9)], 4)
    assert sum(load) == 7 * 3 + 5 * 2 + 3 * 4 + 9 and max(load) - min(load) <= 3
    assert {w: len(b) for w, b in extra.items()} == {7: 3, 5: 2, 1: 1}
    assert splits.balanced_bins([], 3) == ({}, [0, 0, 0])


def test_plain_forms(spark):
    hashes = ["SHA256: AbC ", "abc", " a b c", "", None, "md5:sha:ABC"]
    rows = spark.createDataFrame([(h,) for h in hashes], "h string")
    assert [r[0] for r in rows.select(splits.plain_hash(F.col("h"))).collect()] == ["abc", "abc", "abc", None, None, "abc"]
    named = [(" Train", "x"), ("VAL ", "x"), ("valid", "x"), ("eval", "x"), (None, "a_validation_7_dpo"), ("??", "a_train_1_sft"), (None, None)]
    rows = spark.createDataFrame(named, "s string, i string")
    assert [r[0] for r in rows.select(splits.plain_split(F.col("s"), F.col("i"))).collect()] == ["train", "validation", "validation", "evaluation", "validation", "train", None]


def test_buckets_of_a_giant_partition_leave_one_by_one():
    """What is held after the shuffle is a bucket and a few thousand finished rows, however large the partition."""
    import pyarrow as pa

    read = []

    def partition():
        for b in range(400):
            read.append(b)
            values = [f"{b:04d} value {i % 90}".encode() for i in range(100)]
            yield pa.RecordBatch.from_pydict({"bucket": [f"{b:04d}".encode()] * 100, "canon": values, "key": list(range(b * 100, b * 100 + 100)), "n": [1] * 100})

    held, rows = 0, 0
    for out in formatting._combine_buckets(partition()):
        held = max(held, len(read) * 90 - rows)
        rows += out.num_rows
        assert sum(out.column("n").to_pylist()) == out.num_rows + out.num_rows // 9
    assert rows == 400 * 90 and held <= 4096 + 3 * 90


def test_combined_before_the_shuffle_within_bounds(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"bucket": [b""] * 1000, "canon": [b"x" * 40_000 + str(i).encode() for i in range(1000)], "key": list(range(1000)), "n": [1] * 1000})
    outs = list(formatting._combine(iter([batch, batch])))
    assert len(outs) > 1 and sum(sum(o.column("n").to_pylist()) for o in outs) == 2000 and max(o.num_rows for o in outs) < 900


def test_weights_without_a_cap():
    """Tens of thousands of single states, more than any list of them would be cut at."""
    classes = [(w, 60) for w in range(1, 400)]
    extra, load = splits.balanced_bins(classes, 100)
    assert sum(load) == sum(w * n for w, n in classes) and max(load) - min(load) <= 1
    assert all(len(extra[w]) == 60 for w, _ in classes)
