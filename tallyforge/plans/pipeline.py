"""Whole runs: from a raw table to written sets, from candidates to pairs, from generations to a summary."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import prepare as R
from ..operators import scoring as S
from ..sources import files
from .durable import written
from .settings import Settings

RAW_COLUMNS = {"prompt", "initial_reason_steps", "full_chosen", "full_rejected", "answer"}


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _rows(frame: DataFrame) -> list[dict]:
    """A small report as Python values; only ever called on counts per split or reason."""
    return [r.asDict(recursive=True) for r in frame.collect()]


def prepare(spark: SparkSession, raw: DataFrame, out: str, settings: Settings, overwrite: bool = False, mini: Settings | None = None) -> dict:
    """Writes formal and mini sets, the manifest and `metadata.json` under `out`; returns the metadata.

    `out` must be empty, or goes with `overwrite`; `run.json` records how the run ended. The prepared rows are
    written once; all sets and counters are read from them. A source without `raw_row_index` is numbered in
    reading order, one without `dataset` gets nulls. Raises if a row of the mini sets is longer than the
    lengths of `mini` allow (those of `settings`, if not given).
    """
    S.require_columns(raw, RAW_COLUMNS)
    files.guard_output(spark, out, overwrite)
    with files.run_record(spark, f"{out}/run.json", {"stage": "prepare", "started_at": _now()}) as record:
        metadata = _prepared(spark, raw, out, settings, mini or settings)
        record["dataset_counts"] = metadata["dataset_counts"]
    return metadata


def _prepared(spark: SparkSession, raw: DataFrame, out: str, settings: Settings, mini: Settings) -> dict:
    if "raw_row_index" not in raw.columns:
        raw = files.numbered(raw)
    if "dataset" not in raw.columns:
        raw = raw.withColumn("dataset", F.lit(None).cast("string"))
    raw = raw.select("raw_row_index", *R.FIELDS, "dataset")
    judged = written(R.field_reason(raw, settings), "judged")
    kept = written(R.with_solutions(R.representatives(judged.where("reason is null").drop("reason"), settings), settings).withColumn("reason", R.length_reason(settings)), "prepared")
    rows = written(R.split_rows(kept.where("reason is null"), settings), "split")
    small = R.mini(rows, settings)
    mismatches = R.prefix_mismatches(small, rows, settings).count()
    if mismatches:
        raise ValueError(f"{mismatches} rows of the mini sets are no prefix of the formal ones")
    long = R.length_violations(small, mini).orderBy("split", "split_rank").head(1)
    if long:
        raise ValueError(f"row {long[0].source_id} of the mini sets ({long[0].split}): {long[0].reason}")
    builders = {"sft": R.sft_rows, "dpo": R.dpo_rows, "evaluation": R.evaluation_rows, "reserve": R.reserve_rows}
    for kind, build in builders.items():
        files.write_tree(build(rows, settings), f"{out}/formal/{kind}")
        if kind != "reserve":
            files.write_tree(build(small, settings), f"{out}/mini/{kind}")
    files.write_tree(R.manifest(rows), f"{out}/manifest")
    counts = R.dataset_counts(rows, settings)
    passed = judged.where("reason is null").count()
    metadata = {
        "schema_version": settings.schema_version,
        "created_at": _now(),
        "raw_source_rows": judged.count(),
        "duplicate_prompt_rows": passed - kept.count(),
        "filter_counts": _rows(R.reason_counts(judged, "field_filter").unionByName(R.reason_counts(kept, "length")).orderBy("stage", "reason")),
        "dataset_counts": _rows(counts.orderBy("mode", "kind", "split")),
        "shortfall": _rows(R.shortfall(counts, settings).where("missing > 0").orderBy("mode", "kind", "split")),
    }
    files.write_json(spark, f"{out}/metadata.json", metadata)
    return metadata


def build_pairs(sources: DataFrame, candidates: DataFrame, out: str, settings: Settings, mini_sources: DataFrame | None = None, overwrite: bool = False, audit: int = 50) -> dict:
    """Writes candidates, pairs, their mini subset and an audit sample; returns the report.

    `sources` are supervised rows (id, source_id, split, prompt, completion), of which the first by id of
    each source and split counts; they are reported as duplicate_source_row otherwise. `candidates` carry `arrival` or already an id and an index.
    """
    given = sources.select("source_id", "split", F.col("id").alias("sft_row_id"), "prompt", "completion", F.col("id").alias("arrival"))
    spark = sources.sparkSession
    files.guard_output(spark, out, overwrite)
    with files.run_record(spark, f"{out}/run.json", {"stage": "pairs", "started_at": _now()}) as record:
        report = _pairs(given, candidates, out, settings, mini_sources, audit)
        record["total"] = report["total"]
    return report


def _pairs(given: DataFrame, candidates: DataFrame, out: str, settings: Settings, mini_sources: DataFrame | None, audit: int) -> dict:
    first = P.first_sources(given, "arrival")
    named = candidates if "candidate_index" in candidates.columns else P.with_ids(candidates)
    judged = written(P.joined_reasons(first, named, settings), "judged")
    pairs = written(P.select_pairs(judged, settings), "pairs")
    files.write_jsonl(named, f"{out}/candidates")
    files.write_tree(pairs, f"{out}/formal")
    if mini_sources is not None:
        files.write_tree(P.mini_pairs(pairs, mini_sources), f"{out}/mini")
    files.write_jsonl(P.audit_sample(pairs, audit, settings), f"{out}/audit")
    report = P.split_report(given, named, pairs)
    return {
        "splits": _rows(report.orderBy("split")),
        "total": _rows(P.total_report(report))[0],
        "candidates": _rows(P.candidate_stats(judged, named)),
        "filter_counts": _rows(R.reason_counts(judged, "candidates").unionByName(R.reason_counts(P.duplicate_sources(given, "arrival"), "sources")).orderBy("stage", "reason")),
        "duplicate_source_rows": given.count() - first.count(),
    }


def evaluate(generations: DataFrame, out: str, stages: list[str], overwrite: bool = False) -> dict:
    """Writes predictions and sample cases as JSON Lines and `run.json`; returns the summary per stage."""
    spark = generations.sparkSession
    files.guard_output(spark, out, overwrite)
    with files.run_record(spark, f"{out}/run.json", {"stage": "evaluation", "started_at": _now()}) as record:
        record["summary"] = summary = _scored(generations, out, stages)
    return summary


def _scored(generations: DataFrame, out: str, stages: list[str]) -> dict:
    scored = written(S.score(generations), "scored")
    files.write_jsonl(scored, f"{out}/predictions")
    # stages in the given order, as their place in the list
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("model_stage"))
    cases = S.cases(scored.withColumn("stage_order", place), ["stage_order", "id"])
    files.write_jsonl(cases, f"{out}/cases")
    return {r["model_stage"]: r for r in _rows(S.summarize(scored, stages))}
