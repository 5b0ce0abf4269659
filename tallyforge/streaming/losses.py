"""An extension: training logs watched as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import finite


def loss_alarms(log: DataFrame) -> DataFrame:
    """Rows of a streamed log (run_id, step, loss) whose loss is no finite number; stateless."""
    return log.where(F.col("loss").isNotNull() & ~finite(F.col("loss")))


def windowed_losses(log: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Per run and window the number of rows, least and mean finite loss; rows later than `late` are dropped
    by the watermark, which also bounds the state."""
    rows = log.where(finite(F.col("loss"))).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), "run_id").agg(F.count(F.lit(1)).alias("rows"), F.min("loss").alias("least"), F.avg("loss").alias("mean"))
