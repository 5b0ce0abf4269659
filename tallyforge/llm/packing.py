"""Problem 7: filling containers of a fixed capacity, best two fit.

A container is filled greedily with the largest items that fit; then its smallest item is replaced by two
unpacked ones whenever these fill the widened gap better. Items of one size are alike, so packing works on
the histogram of sizes (one entry per size, whatever the number of items) and repeats each found pattern
as often as its sizes last. Items then find their container by their rank within their size.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import bucketed_rank
from ..plans.durable import written

CAPACITY = 2048


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of the container, how often) until every item of `histogram` (size to number) is packed."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        left[size] = n
    out: list[tuple[tuple[int, ...], int]] = []
    while left.any():
        here = left.copy()
        gap, content = capacity, []
        while gap > 0 and (fit := np.flatnonzero(here[1 : gap + 1])).size:
            size = int(fit[-1]) + 1
            content.append(size)
            here[size] -= 1
            gap -= size
        while gap > 0 and len(content) > 1:
            small = content[-1]
            pair = _two(here, gap + small)
            if pair is None or sum(pair) <= small:
                break
            content[-1:] = pair
            here[small] += 1
            for x in pair:
                here[x] -= 1
            gap += small - sum(pair)
            content.sort(reverse=True)
        used = Counter(content)
        times = min(int(left[s]) // k for s, k in used.items())
        for s, k in used.items():
            left[s] -= k * times
        out.append((tuple(content), times))
    return out


def _two(here: np.ndarray, room: int) -> list[int] | None:
    """The two unpacked sizes of the greatest sum within `room`, the more uneven pair of equals."""
    sizes = np.flatnonzero(here[:room]) if room > 0 else np.empty(0, int)
    if not sizes.size:
        return None
    other = np.searchsorted(sizes, np.minimum(room - sizes, sizes), "right") - 1
    single = (other >= 0) & (sizes[other] == sizes) & (here[sizes] < 2)
    other = np.where(single, other - 1, other)
    total = np.where(other >= 0, sizes + sizes[np.maximum(other, 0)], -1)
    best = int(np.flatnonzero(total == total.max())[-1])
    return [int(sizes[best]), int(sizes[other[best]])] if total[best] > 0 else None


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, container_id, start, n_tokens) of (doc_id, tokens): where each document lies.

    A document longer than `capacity` is cut into full containers and a remainder, which is packed like
    any other item (pieces 0, 1, ...); no other is split. A document without tokens lies in container 0.
    Null lengths count as 0. The driver sees one count per size, at most `capacity` of them.
    """
    spark = lengths.sparkSession
    sized = lengths.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    full = F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(0).cast("int")
    items = written(sized.withColumn("full", full).withColumn("size", (F.col("tokens") - F.col("full") * capacity).cast("int")), "items")
    histogram = {r[0]: r[1] for r in items.where("size > 0").groupBy("size").count().collect()}
    plan, first = [], 0
    reached: Counter = Counter()
    for content, times in patterns(histogram, capacity):
        for size, k in Counter(content).items():
            plan.append((size, reached[size], reached[size] + k * times, first, k))
            reached[size] += k * times
        first += times
    slots = F.broadcast(spark.createDataFrame(plan, "size int, low bigint, high bigint, first bigint, k int").withColumnRenamed("size", "_size"))
    ranked = bucketed_rank(items.where("size > 0"), F.pmod(F.xxhash64("doc_id"), F.lit(256)), [F.col("doc_id")], ("size",))
    placed = ranked.join(slots, (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    last = placed.select(
        "doc_id",
        F.col("full").alias("piece"),
        (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("k"))).cast("bigint").alias("container_id"),
        (F.col("full").cast("bigint") * capacity).alias("start"),
        F.col("size").cast("bigint").alias("n_tokens"),
    )
    pieces = items.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = bucketed_rank(pieces, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4096)), [F.col("doc_id"), F.col("piece")]).select(
        "doc_id", "piece", (F.col("rank") + first).alias("container_id"), (F.col("piece").cast("bigint") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("n_tokens")
    )
    zero = F.lit(0).cast("bigint")
    none = items.where("tokens <= 0").select("doc_id", F.lit(0).alias("piece"), zero.alias("container_id"), zero.alias("start"), zero.alias("n_tokens"))
    return last.unionByName(whole).unionByName(none)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, documents, tokens, unused, least_possible): how full the containers are."""
    used = packed.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    totals = used.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    unused = F.col("containers") * capacity - F.col("tokens")
    return totals.select("containers", "tokens", unused.alias("unused"), F.ceil(F.col("tokens") / capacity).alias("least_possible"))
