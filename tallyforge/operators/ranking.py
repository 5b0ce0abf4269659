"""Dense ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import written


def bucketed_rank(rows: DataFrame, bucket: Column, order: list[Column], within: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """`rows` with a 0-based dense rank per `within`, ordered by `bucket`, then `order`.

    Rows are numbered inside their bucket only; the buckets' starts come from the much smaller table of
    bucket sizes. Choose `bucket` so that it is fine enough for one task to sort one and never contradicts
    the wanted order: a prefix of the key, or a hash where any stable order will do. The input is read
    twice, so it should be a table or cheap to recompute. Null buckets sort first.
    """
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*within).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = rows.withColumn("_local", F.row_number().over(W.partitionBy(*within, "_bucket").orderBy(*order)) - 1)
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    drop = ["_bucket", "_local", "_b", "_start", *[f"_w_{c}" for c in within]]
    return local.join(starts, same).withColumn(name, (F.col("_start") + F.col("_local")).cast("bigint")).drop(*drop)


def ranged_rank(rows: DataFrame, order: list[str], within: tuple[str, ...], name: str = "rank") -> DataFrame:
    """`rows` with a 0-based dense rank by `order` per `within`, where one group may hold a third of all rows.

    Rows are cut into ranges of (within, order) by sampled bounds and written with the number of their range,
    which then serves as the bucket, so a task never sorts more than a range. Nulls come first.
    """
    cut = rows.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id())
    return bucketed_rank(written(cut, "ranges"), F.col("_range"), [F.col(c) for c in order], within, name).drop("_range")
