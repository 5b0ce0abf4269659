"""Problem 2: records that differ only in formatting, collapsed and counted.

Recursive radix partitioning on canonical bytes: equal rows of a task are combined in a trie with counters at
its ends; what is left goes to buckets by the first bytes of its canonical form; a bucket beyond `bucket_rows`
or `bucket_bytes` is split by further bytes until each fits or holds one value only. Inside each bucket another
such trie merges the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..plans.durable import release, written

# Fixed values of the task: tokens of a canonical text. Numbers keep a point between two digits;
# the signs + - * / = < > ^ % count; everything else separates.
TOKEN = r"\p{Nd}+(?:\.\p{Nd}+)*|[\p{L}\p{M}]+|[\p{Nl}\p{No}]+|[-+*/=<>^%]"
FIELDS = ("prompt", "answer", "dataset", "level", "steps")


def canonical_text(text: Column) -> Column:
    """Words, numbers and signs of `text` in order, lower case, one space between; null stays null.

    Letters that differ from their kind in lower case only (sharp s, long s, final sigma) meet it.
    """
    lower = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ſς", "sσ")
    seen = F.regexp_replace(lower, r"\p{Cf}+", "")
    return F.array_join(F.regexp_extract_all(seen, F.lit(TOKEN), F.lit(0)), " ")


def canonical_record(payload: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Canonical form of a JSON object's `fields`, each in its place; null if it isn't a JSON object.

    A missing field counts like a null or blank one.
    """
    parsed = F.try_parse_json(payload)
    parts = [F.coalesce(canonical_text(F.get_json_object(payload, f"$.{f}")), F.lit("")) for f in fields]
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(is_object, F.concat_ws("\u001f", *parts))


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\p{Z}\p{Cf}\p{Cc}]+", "") == ""


def copy_groups(
    rows: DataFrame, key: str, canonical: str, bucket_rows: int = 50_000, bucket_bytes: int = 16 << 20
) -> tuple[DataFrame, DataFrame]:
    """(records, groups): records are (digest, key), groups (digest, kept_key, copies) of each value.

    `kept_key` is the smallest key, `copies` the number of records. Null canonical forms are left out.
    Both are written tables. A value that a third of all rows share is combined before it is shuffled, and
    after the shuffle a task holds one bucket at a time.
    """
    # two columns only, so names of the input can't clash
    table = written(
        rows.where(F.col(canonical).isNotNull() & F.col(key).isNotNull()).select(
            F.col(key).alias("key"), F.col(canonical).cast("binary").alias("canon"), F.unhex(F.md5(F.col(canonical).cast("binary"))).alias("digest")
        ),
        "canonical",
    )
    counted = written(table.select(F.lit(b"").alias("bucket"), "canon", "key", F.lit(1).cast("bigint").alias("n")).mapInArrow(_combine, COUNTED).select("canon", "key", "n"), "combined")
    bucketed = assign_buckets(counted, bucket_rows, bucket_bytes)
    ordered = bucketed.select("bucket", "canon", "key", "n").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    merged = ordered.mapInArrow(_combine_buckets, COUNTED)
    groups = written(merged.select(F.unhex(F.md5("canon")).alias("digest"), F.col("key").alias("kept_key"), F.col("n").alias("copies")), "groups")
    release(counted)
    return table.select("digest", "key"), groups


COUNTED = "bucket binary, canon binary, key bigint, n bigint"
#: Parts of a plan's rows, so that a bucket with a third of all rows is planned by as many tasks.
SALTS = 32


def assign_buckets(rows: DataFrame, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """`rows` (canon, ...), a written table, with the radix bucket of each: a prefix whose bucket fits or holds
    one value only.

    Each round measures the open buckets, and those beyond the bounds are split by further bytes: past the
    bytes that all their values share, one for every factor of eight by which they are too large, so a few
    rounds do. What is to be split stands in a written table (bucket, depth), which Spark broadcasts while it
    is small; beyond that its rows are repeated SALTS times and joined by shuffle. The driver sees no bucket.
    """
    rows = rows.withColumn("bucket", F.substring("canon", 1, 1)).withColumn("_salt", F.pmod(F.xxhash64("canon"), F.lit(SALTS)).cast("int"))
    open_level = rows.select("canon", "bucket", "_salt")
    while True:
        stats = (
            open_level.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("canon").cast("bigint")).alias("size"), F.min("canon").alias("low"), F.max("canon").alias("high"))
            .where((F.col("n") > bucket_rows) | (F.col("size") > bucket_bytes))
            .where(F.col("low") != F.col("high"))
        )
        factor = F.greatest(F.col("n") / bucket_rows, F.col("size") / bucket_bytes)
        more = F.greatest(F.lit(1), F.ceil(F.log2(factor) / 3).cast("int"))
        plan = written(stats.select("bucket", (_shared("low", "high") + more).alias("depth")), "plan")
        if plan.isEmpty():
            return rows.drop("_salt")
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        deeper = F.substring(F.col("canon"), F.lit(1), F.col("depth"))
        rows = rows.join(salted, ["bucket", "_salt"], "left").withColumn("bucket", F.coalesce(deeper, F.col("bucket"))).drop("depth")
        open_level = open_level.join(salted, ["bucket", "_salt"]).select("canon", deeper.alias("bucket"), "_salt")


def _shared(low: str, high: str) -> Column:
    """How many bytes two different binary columns have in common at their start."""
    a, b = F.hex(F.col(low)), F.hex(F.col(high))
    # by halving: the greatest length at which the prefixes are equal
    step = lambda n, _: F.when(F.substring(a, F.lit(1), 2 * ((n["lo"] + n["hi"] + 1) / 2).cast("int")) == F.substring(b, F.lit(1), 2 * ((n["lo"] + n["hi"] + 1) / 2).cast("int")), F.struct(((n["lo"] + n["hi"] + 1) / 2).cast("int").alias("lo"), n["hi"].alias("hi"))).otherwise(F.struct(n["lo"].alias("lo"), (((n["lo"] + n["hi"] + 1) / 2).cast("int") - 1).alias("hi")))
    start = F.struct(F.lit(0).alias("lo"), F.least(F.length(F.col(low)), F.length(F.col(high))).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step)["lo"]


class CountingTrie:
    """A trie over byte strings whose ends count: nodes branch on 12 bytes and open when two values meet."""

    STRIDE = 12

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, value: bytes, key: int, n: int) -> None:
        node, depth, stride = self.root, 0, self.STRIDE
        while True:
            part = value[depth : depth + stride]
            at = node.get(part)
            if at is None:
                node[part] = [value, key, n]
                self.size += 1
                return
            if isinstance(at, list):
                if at[0] == value:
                    at[1] = min(at[1], key)
                    at[2] += n
                    return
                opened: dict = {at[0][depth + stride : depth + 2 * stride]: at}
                node[part] = at = opened
            node, depth = at, depth + stride

    def ends(self) -> Iterator[list]:
        todo = [self.root]
        while todo:
            for at in todo.pop().values():
                if isinstance(at, dict):
                    todo.append(at)
                else:
                    yield at


def _emit(tries: dict[bytes, CountingTrie]) -> pa.RecordBatch:
    out: tuple[list, list, list, list] = ([], [], [], [])
    for bucket, trie in tries.items():
        for value, key, n in trie.ends():
            for column, x in zip(out, (bucket, value, key, n), strict=True):
                column.append(x)
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "canon", "key", "n"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: counts of equal values are combined; what is held stays below 32 MB of values."""
    trie = CountingTrie()
    held = 0
    for batch in batches:
        for value, key, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            before = trie.size
            trie.add(value, key, n)
            held += (trie.size - before) * (len(value) + 200)
            if held > 32 << 20:
                yield _emit({b"": trie})
                trie, held = CountingTrie(), 0
    if trie.size:
        yield _emit({b"": trie})


def _combine_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After it: rows come in the order of buckets, and each bucket, which fits, is emitted when it ends."""
    bucket: bytes | None = None
    trie = CountingTrie()
    done: dict[bytes, CountingTrie] = {}
    rows = 0
    for batch in batches:
        for b, value, key, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if b != bucket:
                if trie.size:
                    done[bucket] = trie
                    rows += trie.size
                    if rows >= 4096:  # small buckets go out together
                        yield _emit(done)
                        done, rows = {}, 0
                bucket, trie = b, CountingTrie()
            trie.add(value, key, n)
    if trie.size:
        done[bucket] = trie
    if done:
        yield _emit(done)


def copies_of(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(kept_key, copy_key): one row per record beyond the kept one of its group; keys are those of records.

    A record whose key comes twice is one record. No task gets a whole group that is hot (`lookup_join`).
    """
    pairs = lookup_join(records, groups.where("copies > 1").select("digest", "kept_key"), "digest")
    return pairs.where("key <> kept_key").select("kept_key", F.col("key").alias("copy_key")).distinct()
