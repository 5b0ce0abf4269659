"""Problem 3: splits that keep related records together.

Components of records that share a hash or a row index are weighed, balanced into many equal bins by
largest differencing, and the bins go whole to the splits by target proportion.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import bucketed_rank
from ..operators.skew import lookup_join
from ..plans.durable import written
from ..sources.tables import latest_delivery, plain_split
from .components import components


def plain_hash(value: Column) -> Column:
    """A hash value in plain form: lower case, no blanks, no prefix before a colon; blank gives null."""
    bare = F.regexp_replace(F.lower(value), r"(?U)[\s\p{Z}\p{Cf}]+", "")
    return F.nullif(F.regexp_replace(bare, "^.*:", ""), F.lit(""))


def related(rows: DataFrame) -> DataFrame:
    """`rows` (id, source, sha, row_index, split) with `group`, the component of each row.

    Rows are related when they share a plain hash (source or sha, either against either) or a known row
    index, directly or through others. A row without any of them is a group of its own. Nulls link nothing;
    an index below 0 is unknown.
    """
    known = F.when(F.col("row_index") >= 0, F.concat(F.lit("i"), F.col("row_index").cast("string")))
    # nodes are 16 bytes each, whatever they name
    short = lambda text: F.unhex(F.md5(text))
    keyed = rows.withColumns(
        {
            "_s": short(F.concat(F.lit("h"), F.col("source"))),
            "_h": short(F.concat(F.lit("h"), F.col("sha"))),
            "_i": short(known),
        }
    ).withColumn("anchor", F.coalesce("_s", "_h", "_i", short(F.concat(F.lit("r"), F.col("id")))))
    keyed = written(keyed, "keyed")
    edges = keyed.select(F.col("anchor").alias("a"), F.explode(F.array_distinct(F.array_compact(F.array("anchor", "_h", "_i")))).alias("b"))
    edges = edges.distinct()  # combined map-side: a source with a third of the rows gives few edges
    found = components(edges).select(F.col("node").alias("anchor"), F.col("component").alias("group"))
    return written(lookup_join(keyed, found, "anchor").drop("anchor", "_s", "_h", "_i"), "related")


def dpo_relations(dpo: DataFrame) -> DataFrame:
    """The preference rows, each id once in its latest delivery, with their group."""
    columns = {
        "source": plain_hash(F.col("source_id")),
        "sha": plain_hash(F.col("metadata.normalized_prompt_sha256")),
        "row_index": F.col("metadata.raw_row_index"),
        "split": plain_split(F.col("split"), F.col("id")),
    }
    return related(latest_delivery(dpo, "id", "loaded_at", columns))


def spread_groups(rows: DataFrame) -> DataFrame:
    """(id, group_id) of all rows in groups whose delivered splits differ; group_id: least plain source."""
    groups = rows.groupBy("group").agg(F.min("source").alias("group_id"), F.min("split").alias("low"), F.max("split").alias("high"))
    spread = groups.where("low <> high").select("group", "group_id")
    return lookup_join(rows.select("id", "group"), spread, "group").select("id", "group_id")


def balanced_bins(weights: Iterable[tuple[int, int]], bins: int) -> tuple[dict[int, list[int]], list[int]]:
    """Largest differencing over (weight, how many components have it): (extra, load).

    Of a weight's components, every `bins` fill all bins alike and differ by nothing. Each of the rest is a
    state of `bins` slots. The two states of the greatest difference are combined again and again, the fullest
    slots of one with the emptiest of the other. extra[weight] lists the bins that get one of the rest each;
    load is each bin's sum. Single states of one weight are alike and stand in the heap as one entry with
    their number; there are at most the root of 2 x bins x rows of them, whatever the weights.
    """
    base = 0
    heap: list[tuple] = []
    for k, (weight, n) in enumerate(sorted(weights, reverse=True)):
        base += weight * (n // bins)
        if n % bins:
            heap.append((-weight, k, n % bins, None, None))
    heapq.heapify(heap)
    serial = len(heap)

    def greatest() -> tuple[np.ndarray, list]:
        diff, k, n, load, held = heapq.heappop(heap)
        if load is not None:
            return load, held
        if n > 1:
            heapq.heappush(heap, (diff, k, n - 1, None, None))
        load = np.zeros(bins, dtype=np.int64)
        load[0] = -diff
        return load, [(-diff,), *[()] * (bins - 1)]

    while len(heap) > 1 or heap and heap[0][2] > 1:
        (a, held_a), (b, held_b) = greatest(), greatest()
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        load = a[down] + b[up]
        # slots hold nested pairs, so nothing is copied
        held = [(held_a[i], held_b[j]) if held_a[i] and held_b[j] else held_a[i] or held_b[j] for i, j in zip(down.tolist(), up.tolist(), strict=True)]
        serial += 1
        heapq.heappush(heap, (-int(load.max() - load.min()), serial, 1, load, held))
    extra: dict[int, list[int]] = {}
    if not heap:
        return extra, [base] * bins
    load, held = greatest()
    for bin_, slot in enumerate(held):
        todo = [slot]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                extra.setdefault(x, []).append(bin_)
    return extra, [base + int(x) for x in load]


def allot(load: list[int], targets: dict[str, float]) -> list[str]:
    """The split of each bin: the fullest bin first, to the split that lacks most of its share."""
    total, share = sum(load) or 1, sum(targets.values()) or 1.0
    lack = {s: total * p / share for s, p in targets.items()}
    out = [""] * len(load)
    for i in sorted(range(len(load)), key=lambda i: (-load[i], i)):
        if lack:
            best = max(sorted(lack), key=lambda s: lack[s])
            out[i] = best
            lack[best] -= load[i]
    return out


def assign_splits(rows: DataFrame, targets: DataFrame, bins: int = 100) -> DataFrame:
    """(id, group_id, bin, split): the new split of each row of `related`.

    All rows of a group share a bin, all rows of a bin a split. A component heavier than a bin makes a bin of
    its own. Empty input gives an empty result; targets with a null or non-positive proportion get nothing,
    and without any target the split is empty text.
    """
    spark = rows.sparkSession
    weights = written(rows.groupBy("group").agg(F.count(F.lit(1)).alias("weight"), F.min("source").alias("group_id")), "weights")
    classes = [(r[0], r[1]) for r in weights.groupBy("weight").count().collect()]
    wanted = {r[0]: float(r[1]) for r in targets.where("split is not null and proportion > 0").select("split", "proportion").collect()}
    extra, load = balanced_bins(classes, bins)
    split_of = allot(load, wanted)
    table = [(w, n // bins * bins, extra.get(w, [])) for w, n in classes]
    plan = spark.createDataFrame(table, "weight bigint, even bigint, extra array<int>")
    names = F.array(*[F.lit(s) for s in split_of])
    ranked = bucketed_rank(weights, F.pmod(F.xxhash64("group"), F.lit(256)), [F.col("group")], ("weight",))
    place = F.when(F.col("rank") < F.col("even"), F.pmod("rank", F.lit(bins))).otherwise(F.get(F.col("extra"), (F.col("rank") - F.col("even")).cast("int")))
    binned = ranked.join(F.broadcast(plan), "weight").withColumn("bin", place.cast("int")).select("group", "group_id", "bin", F.get(names, F.col("bin")).alias("split"))
    return lookup_join(rows.select("id", "group"), binned, "group").select("id", "group_id", "bin", "split")
