"""Readers of the input tables and the rule for rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder` (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def latest_delivery(rows: DataFrame, key: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """One row per `key`, that of the greatest `order`; of equal ones, the greatest values.

    A null `order` counts as earliest; rows whose `key` is null are dropped. Only `columns`
    (name to expression) are carried, so the shuffle holds nothing else. The combine is map-side.
    """
    picked = F.struct(F.col(order).alias("_order"), *[c.alias(n) for n, c in columns.items()])
    best = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(picked).alias("_best"))
    return best.select(F.col("_key").alias(key), *[F.col(f"_best.{n}").alias(n) for n in columns])


def plain_split(split: Column, id: Column | None = None) -> Column:
    """train, validation or evaluation for any spelling; where it names none, what the id says; else null."""

    def named(text: Column) -> Column:
        bare = F.regexp_replace(F.lower(text), r"[^a-z]", "")
        return (
            F.when(bare.startswith("tr"), "train").when(bare.startswith("val") | (bare == "dev"), "validation").when(bare.startswith("ev") | (bare == "test"), "evaluation")
        )

    said = named(split)
    if id is not None:
        said = F.coalesce(said, named(F.regexp_extract(F.lower(id), "_(train|validation|evaluation|val|eval)_", 1)))
    return said
