"""Preference pairs from sampled candidates: filters, quality, selection, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.answers import WEAK_METHODS
from ..plans.settings import Settings
from ..plans.durable import written
from .prepare import count_tokens, first_reason, pair_length_reason
from .ranking import ranged_rank
from .skew import lookup_join

# What the way an answer was found is worth.
METHOD_BONUS = {"boxed": 0.03, "labeled_answer": 0.02, "hash_answer": 0.02, "final_line_choice": 0.01, "final_line_numeric": 0.005}


def quality(logprob: Column, tokens: Column, method: Column) -> Column:
    """Score of a candidate: mean log-probability (-100 if unknown), a little for length, a bonus by method."""
    bonus = F.when(F.lit(False), 0.0)
    for name, worth in METHOD_BONUS.items():
        bonus = bonus.when(method == name, worth)
    confidence = F.coalesce(logprob, F.lit(-100.0))
    length = F.least(F.coalesce(tokens, F.lit(0)), F.lit(256)) / F.lit(10000.0)
    return confidence + length + bonus.otherwise(0.0)


def average(values: Column) -> Column:
    """Mean of an array of numbers; null for an empty or null one."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(values), F.lit(0))


def with_ids(candidates: DataFrame) -> DataFrame:
    """Candidates with `candidate_index` (0-based by `arrival` within source and split) and their id.

    One source may hold a third of all candidates, so they are ranked by ranges."""
    made = ranged_rank(candidates, ["arrival"], ("source_id", "split"), "candidate_index").withColumn("candidate_index", F.col("candidate_index").cast("int"))
    return made.withColumn("id", F.concat("source_id", F.lit("_"), "split", F.lit("_cand_"), F.format_string("%02d", F.col("candidate_index"))))


def candidate_reasons(candidates: DataFrame) -> DataFrame:
    """Candidates with `reason`, why each can't be a rejected answer; null for those that can.

    A text counts as seen before its other checks, so a later equal one is a duplicate whatever the first
    was left out for; blank texts are never seen.
    """
    said = candidates.withColumn("_text", T.strip(F.coalesce("generated_text", F.lit(""))))
    said = said.withColumn("_key", F.when(F.col("_text") != "", T.compare_key(F.col("_text"))))
    # the first index of each text is a map-side minimum; with the index in the join key no text is hot
    said = said.withColumn("_digest", F.when(F.col("_key").isNotNull(), F.md5(F.concat_ws("\u001f", "source_id", "split", "_key"))))
    seen = said.where("_digest is not null").groupBy("_digest").agg(F.min("candidate_index").alias("candidate_index"))
    first = said.join(seen.withColumn("_first", F.lit(True)), ["_digest", "candidate_index"], "left")
    checks = [
        (F.col("_text") == "", "empty_text"),
        (F.col("_first").isNull(), "duplicate_text"),
        (~F.col("finish_reason").eqNullSafe("eos"), "not_eos"),
        (F.coalesce("hit_max_new_tokens", F.lit(False)), "hit_max_new_tokens"),
        (~F.coalesce("answer_extracted", F.lit(False)), "no_answer"),
        (F.col("extraction_method").isin(*WEAK_METHODS), "no_explicit_final_answer"),
        (F.coalesce("math_equivalent", F.lit(False)), "correct_answer"),
        (T.abnormal(F.col("_text")), "abnormal_output"),
    ]
    return first.withColumn("reason", first_reason(checks)).drop("_text", "_key", "_first", "_digest")


def joined_reasons(sources: DataFrame, candidates: DataFrame, settings: Settings) -> DataFrame:
    """Candidates of the sources (source_id, split, sft_row_id, prompt, completion), each source once, with
    their reason, score and token counts. Sources that come again are left out (`first_sources`)."""
    place = F.concat_ws("\u001f", "source_id", "split")
    judged = written(candidate_reasons(candidates.drop("prompt", "completion", "sft_row_id")).withColumn("_place", place), "judged")
    both = lookup_join(judged, sources.select(place.alias("_place"), "sft_row_id", "prompt", "completion"), "_place").drop("_place")
    said = F.array(T.message("assistant", T.strip(F.col("generated_text"))))
    counted = both.withColumns(
        {
            "prompt_tokens": count_tokens(F.col("prompt"), opening=3).cast("bigint"),
            "chosen_tokens": count_tokens(F.concat("prompt", "completion")).cast("bigint"),
            "rejected_tokens": count_tokens(F.concat("prompt", said)).cast("bigint"),
        }
    )
    same = F.when(T.compare_key(F.get("completion", 0)["content"]) == T.compare_key(F.col("generated_text")), "same_as_chosen")
    long = pair_length_reason(F.col("prompt_tokens"), F.col("chosen_tokens"), F.col("rejected_tokens"), settings)
    score = quality(F.col("average_logprob"), F.col("output_tokens"), F.col("extraction_method"))
    return counted.withColumns({"reason": F.coalesce("reason", same, long), "score": score})


def first_sources(rows: DataFrame, order: str) -> DataFrame:
    """Each source and split once, by the least `order`."""
    return rows.groupBy("source_id", "split").agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def duplicate_sources(rows: DataFrame, order: str) -> DataFrame:
    """The rows that `first_sources` leaves out, with their reason. `order` must be unique."""
    first = first_sources(rows, order).select("source_id", "split", F.col(order).alias("_first"))
    same = (F.col("source_id") == F.col("_s")) & F.col("split").eqNullSafe(F.col("_split")) & (F.col(order) == F.col("_first"))
    kept = first.withColumnsRenamed({"source_id": "_s", "split": "_split"})
    return rows.join(kept, same, "left_anti").withColumn("reason", F.lit("duplicate_source_row"))


def select_pairs(judged: DataFrame, settings: Settings) -> DataFrame:
    """The best rejected answer of each source: greatest score, the earlier candidate of equal ones."""
    order = F.struct(F.col("score"), -F.col("candidate_index"))
    kept = ["sft_row_id", "id", "candidate_index", "prompt", "completion", "generated_text", "score", "prompt_tokens", "chosen_tokens", "rejected_tokens"]
    best = judged.where("reason is null").groupBy("source_id", "split").agg(F.max_by(F.struct(*kept), order).alias("c"))
    p, c, r = F.col("c.prompt_tokens"), F.col("c.chosen_tokens"), F.col("c.rejected_tokens")
    return best.select(
        F.lit(settings.schema_version).alias("schema_version"),
        F.concat("source_id", F.lit("_dpo_v2")).alias("id"),
        "source_id",
        F.lit(0).cast("bigint").alias("step_index"),
        F.col("c.prompt").alias("prompt"),
        F.col("c.completion").alias("chosen"),
        F.array(T.message("assistant", T.strip(F.col("c.generated_text")))).alias("rejected"),
        F.struct(p.alias("prompt"), c.alias("chosen_total"), r.alias("rejected_total"), (c - p).alias("chosen_completion"), (r - p).alias("rejected_completion")).alias("token_count"),
        "split",
        F.struct(F.col("c.id").alias("candidate_id"), F.col("c.candidate_index").alias("candidate_index"), F.col("c.sft_row_id").alias("original_sft_row_id")).alias("metadata"),
        F.col("c.score").alias("score"),
    )


def mini_pairs(pairs: DataFrame, small: DataFrame) -> DataFrame:
    """Pairs whose source stands in the mini set of the same split."""
    return pairs.join(small.select("source_id", "split").distinct(), ["source_id", "split"], "left_semi")


def without_pair(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    return sources.join(pairs.select("source_id", "split"), ["source_id", "split"], "left_anti")


def candidate_stats(reached: DataFrame, total: DataFrame) -> DataFrame:
    """(outcome, count, ratio) over the candidates that a source reached; the ratio is to all candidates."""
    answered, right = F.coalesce("answer_extracted", F.lit(False)), F.coalesce("math_equivalent", F.lit(False))
    outcomes = {"eos": F.col("finish_reason").eqNullSafe("eos"), "length": ~F.col("finish_reason").eqNullSafe("eos"), "correct": answered & right, "wrong": answered & ~right, "no_answer": ~answered}
    counted = reached.agg(*[F.count_if(c).alias(k) for k, c in outcomes.items()])
    n = total.agg(F.count(F.lit(1)).alias("all"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(k).alias("count")) for k in outcomes])).alias("o")
    ratio = F.coalesce(F.try_divide(F.col("o.count").cast("double"), F.col("all")), F.lit(0.0))
    return counted.crossJoin(F.broadcast(n)).select(rows, "all").select("o.outcome", "o.count", ratio.alias("ratio"))  # one row each


def split_report(sources: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per split: questions, sources, candidates, pairs, sources without one, mean lengths of the pairs."""
    s = sources.groupBy("split").agg(F.count(F.lit(1)).alias("source_questions"), F.count_distinct("source_id").alias("unique_source_id"))
    c = candidates.groupBy("split").agg(F.count(F.lit(1)).alias("candidate_count"))
    p = pairs.groupBy("split").agg(
        F.count(F.lit(1)).alias("final_preference_pairs"),
        F.avg("token_count.chosen_completion").alias("chosen_average_tokens"),
        F.avg("token_count.rejected_completion").alias("rejected_average_tokens"),
    )
    made = s.join(c, "split", "left").join(p, "split", "left").na.fill(0)
    return made.withColumn("no_valid_rejected", F.col("unique_source_id") - F.col("final_preference_pairs"))


def total_report(report: DataFrame) -> DataFrame:
    names = {"source_questions": "formal_source_questions", "candidate_count": "formal_candidate_count", "final_preference_pairs": "formal_preference_pairs", "no_valid_rejected": "formal_no_valid_rejected"}
    return report.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(v) for k, v in names.items()])


def audit_sample(pairs: DataFrame, n: int, settings: Settings) -> DataFrame:
    """`n` pairs for review in an order drawn from the seed; the same for the same pairs on any layout."""
    return pairs.orderBy(F.sha2(F.concat_ws("|", F.lit(str(settings.seed)), F.col("id"), F.col("split")), 256)).limit(n)
