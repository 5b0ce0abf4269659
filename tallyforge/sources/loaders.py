"""Prepared sets as training and evaluation read them: in order, limited, and checked before use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import pair_violations
from .files import file_exists, guard_output, read_split

COLUMNS = {
    "sft": {"id", "source_id", "prompt", "completion", "messages", "token_count"},
    "dpo": {"id", "source_id", "step_index", "prompt", "chosen", "rejected", "token_count"},
    "evaluation": {"id", "source_id", "problem", "reference_answer", "prompt_messages", "metadata"},
}


def load_split(spark: SparkSession, path: str, kind: str, split: str, limit: int | None = None, lengths: tuple[int, int] | None = None) -> DataFrame:
    """The rows of a split in the order of their ids, the first `limit` of them.

    Raises where the tree, a column or all rows are missing; preference rows are checked too, and with
    `lengths` (prompt, total) held to them: the first faulty one is named.
    """
    if not file_exists(spark, path):
        raise FileNotFoundError(path)
    rows = read_split(spark, path, split, COLUMNS[kind]).orderBy(F.length("id"), "id")
    rows = rows if limit is None else rows.limit(limit)
    if kind == "dpo":
        most = lengths or (2**31 - 1, 2**31 - 1)
        bad = pair_violations(rows, *most).select("id", "violation").head(1)
        if bad:
            raise ValueError(f"{path} {split}: {bad[0].violation}: {bad[0].id}")
    return rows


def load_pair(spark: SparkSession, path: str, kind: str, train: int | None = None, validation: int | None = None, lengths: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both splits that a training run reads."""
    return load_split(spark, path, kind, "train", train, lengths), load_split(spark, path, kind, "validation", validation, lengths)


def cached(source: DataFrame, path: str, refresh: bool = False, overwrite: bool = False) -> DataFrame:
    """`source` as it was first read: the table at `path` where there is one, else it is written there.

    With `refresh` it is read anew, which replaces a table only with `overwrite`.
    """
    spark = source.sparkSession
    if refresh or not file_exists(spark, path):
        guard_output(spark, path, overwrite)
        source.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
