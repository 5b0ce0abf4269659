"""Joins whose row side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows below which a key is never treated as hot.
FEW = 10_000


def hot_keys(rows: DataFrame, key: str, most_hot: int = 500) -> tuple[list[tuple], int]:
    """Keys with more than 1/most_hot of `rows`, `most_hot` of them at most, with their counts; and that bound."""
    n = rows.count()
    least = max(FEW, n // most_hot)
    if n <= least:
        return [], least
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least)
    return [(bytes(k) if isinstance(k, bytearray) else k, m) for k, m in counts.collect()], least


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, most_hot: int = 500) -> DataFrame:
    """Inner join of `rows` with `lookup` (one row per `key`) that no hot key can pile onto one task.

    Keys with more than 1/most_hot of the rows (so `most_hot` of them at most, a size bound that holds for
    any input) are matched by broadcast, all others by shuffle. Null keys match nothing. `rows` is read
    three times and should be a written table.
    """
    names = [k for k, _ in hot_keys(rows, key, most_hot)[0]]
    if not names:
        return rows.join(lookup, key)
    is_hot = F.col(key).isin(names)
    few = F.broadcast(lookup.where(is_hot))
    return rows.where(is_hot).join(few, key).unionByName(rows.where(~is_hot).join(lookup, key))


def expanding_join(rows: DataFrame, others: DataFrame, key: str, most_hot: int = 500) -> DataFrame:
    """Inner join on `key` where both sides may hold many rows of one key, as a pair list does.

    The rows of a hot key (as in `lookup_join`) are cut into parts of a tenth of the bound, and the other
    side's rows of that key are repeated for each part, so no task gets all pairs of a key. `rows` is the side
    with the larger groups and should be a written table.
    """
    hot, least = hot_keys(rows, key, most_hot)
    if not hot:
        return rows.join(others, key)
    parts = {k: -(-10 * n // least) for k, n in hot}
    table = rows.sparkSession.createDataFrame([(k, p) for k, p in parts.items()], rows.select(F.col(key).alias("_k"), F.lit(1).alias("_parts")).schema)
    names = list(parts)
    is_hot = F.col(key).isin(names)
    plan = F.broadcast(table)  # most_hot rows at most
    cut = rows.where(is_hot).join(plan, F.col(key) == F.col("_k")).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"))
    again = others.where(is_hot).join(plan, F.col(key) == F.col("_k")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    joined = cut.drop("_k", "_parts").join(again.drop("_k", "_parts"), [key, "_part"]).drop("_part")
    return joined.unionByName(rows.where(~is_hot).join(others.where(~is_hot), key))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over all cores where the source comes in fewer pieces, for work that costs more than a shuffle.

    A source with as many pieces as cores is left as it is. Otherwise the columns pass a generator, since a
    filter would move back before the shuffle, into the few pieces, with all the work it needs.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores).select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))
