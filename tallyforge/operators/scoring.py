"""Scoring of generated answers: predictions, summaries per stage, sample cases, training metrics, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers as A
from .prepare import first_reason


def score(generations: DataFrame) -> DataFrame:
    """Generations (.., generated_text, finish_reason, prompt_messages, reference_answer, answer) with what
    they answer, the reference's answer, both normal forms and how they match."""
    drawn = generations.withColumns(
        {
            "_p": A.extract_answer(F.coalesce("generated_text", F.lit("")), F.col("finish_reason")),
            "_g": A.gold_answer(F.col("answer"), F.coalesce("reference_answer", F.lit(""))),
        }
    )
    drawn = A.with_normal(drawn, normalized_predicted_answer=F.col("_p.answer"), normalized_reference_answer=F.col("_g.answer"))
    strict = F.coalesce(F.col("normalized_predicted_answer") == F.col("normalized_reference_answer"), F.lit(False))
    matched = A.compare_answers(drawn.withColumn("strict_exact_match", strict), "_m", F.col("_p.answer"), F.col("_g.answer"), A.match_text(F.col("prompt_messages")), F.col("strict_exact_match"))
    return matched.withColumns(
        {
            "predicted_answer": F.col("_p.answer"),
            "extraction_method": F.col("_p.method"),
            "reference_final_answer": F.col("_g.answer"),
            "reference_answer_source": F.col("_g.source"),
            "reference_extraction_method": F.col("_g.method"),
            "answer_extracted": F.col("normalized_predicted_answer").isNotNull(),
            "reference_answer_extracted": F.col("_g.answer").isNotNull(),
            "math_equivalent": F.col("_m.equal"),
            "match_method": F.col("_m.method"),
            "exact_match": F.col("strict_exact_match"),
        }
    ).drop("_p", "_g", "_m")


# The names of the rates and what each is the mean of.
RATES = {
    "answer_extraction_rate": "answer_extracted",
    "reference_answer_extraction_rate": "coalesce(reference_answer_extracted, true)",
    "strict_exact_match": "strict_exact_match",
    "math_equivalent": "math_equivalent",
    "exact_match": "strict_exact_match",
    "eos_finish_rate": "finish_reason = 'eos'",
    "length_truncation_rate": "finish_reason = 'length'",
    "hit_max_new_tokens_rate": "hit_max_new_tokens",
}


def summarize(predictions: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """Per model stage its number of examples, eight rates and the averages.

    With `stages`, a stage without predictions raises when the result is made.
    """
    rates = [F.avg(F.coalesce(F.expr(c), F.lit(False)).cast("double")).alias(k) for k, c in RATES.items()]
    averages = [F.avg(F.col(c).cast("double")).alias(k) for k, c in (("average_real_output_tokens", "output_tokens"), ("average_output_tokens", "output_tokens"), ("average_generation_seconds", "generation_seconds"))]
    made = predictions.groupBy("model_stage").agg(F.count(F.lit(1)).alias("num_examples"), *rates, *averages)
    if stages is None:
        return made
    asked = predictions.sparkSession.createDataFrame([(s,) for s in stages], "model_stage string").join(made, "model_stage", "left")
    some = F.when(F.col("num_examples").isNull(), F.raise_error(F.concat(F.lit("No predictions for "), "model_stage"))).otherwise(F.col("num_examples"))
    return asked.withColumn("num_examples", some.cast("bigint"))


def cases(predictions: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first `n` right and the first `n` wrong predictions by `order`, as `case`."""
    right = F.coalesce("math_equivalent", F.lit(False))
    parts = [predictions.where(c).orderBy(*order).limit(n).withColumn("case", F.lit(k)) for k, c in (("correct", right), ("error", ~right))]
    return parts[0].unionByName(parts[1])


# --- training metrics: rows (run_id, step, metric) or with loss and eval_loss -----------------------


def finite(value):
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def best_checkpoint(events: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """(run_id, step, metric): the least finite metric of each run, the earliest step of equal ones.

    Runs without one take their `final` (run_id, metric), with no step.
    """
    best = events.where(finite(F.col("metric"))).groupBy("run_id").agg(F.min(F.struct("metric", "step")).alias("b")).select("run_id", "b.step", "b.metric")
    if final is None:
        return best
    rest = final.where(finite(F.col("metric"))).join(best, "run_id", "left_anti").select("run_id", F.lit(None).cast(best.schema["step"].dataType).alias("step"), "metric")
    return best.unionByName(rest)


def running_best(events: DataFrame) -> DataFrame:
    """Finite events with the best metric so far and whether the event improves on all before it."""
    so_far = W.partitionBy("run_id").orderBy("step")
    before = F.min("metric").over(so_far.rowsBetween(W.unboundedPreceding, -1))
    rows = events.where(finite(F.col("metric")))
    return rows.select(
        "run_id", "step", "metric", F.min("metric").over(so_far.rowsBetween(W.unboundedPreceding, 0)).alias("best_metric"), F.coalesce(F.col("metric") < before, F.lit(True)).alias("improved")
    )


def loss_history(log: DataFrame) -> DataFrame:
    """The rows that carry a loss of either kind."""
    return log.where("loss is not null or eval_loss is not null")


def not_finite(log: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a loss (columns that are or end with 'loss') that is no finite number."""
    names = columns or [c for c in log.columns if c == "loss" or c.endswith("loss")]
    bad = F.lit(False)
    for c in names:
        bad = bad | (F.col(c).isNotNull() & ~finite(F.col(c)))
    return log.where(bad)


# --- checks -----------------------------------------------------------------------------------------


def require_columns(rows: DataFrame, names: set[str]) -> DataFrame:
    """`rows`, if it has all `names` and at least one row; else a ValueError."""
    missing = sorted(names - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if rows.isEmpty():
        raise ValueError("no rows")
    return rows


def pair_violations(rows: DataFrame, max_prompt: int, max_total: int) -> DataFrame:
    """Preference rows with the first of their faults, as `violation`."""
    t = F.col("token_count")
    blank = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    negative = F.lit(False)
    for f in ("prompt", "chosen_total", "rejected_total", "chosen_completion", "rejected_completion"):
        negative = negative | t[f].isNull() | (t[f] < 0)
    checks = [
        (F.coalesce(F.col("id"), F.lit("")) == "", "id_empty"),
        (F.col("chosen").eqNullSafe(F.col("rejected")), "chosen_equals_rejected"),
        (blank("prompt"), "prompt_empty"),
        (blank("chosen"), "chosen_empty"),
        (blank("rejected"), "rejected_empty"),
        (t.isNull() | negative, "token_count_invalid"),
        (t["prompt"] > max_prompt, "prompt_too_long"),
        (t["chosen_total"] > max_total, "chosen_too_long"),
        (t["rejected_total"] > max_total, "rejected_too_long"),
    ]
    return rows.withColumn("violation", first_reason(checks)).where("violation is not null")
