"""Whole runs over the smallest tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import catalog, pipeline
from tallyforge.plans.settings import Settings
from tallyforge.sources import files

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
FEW = Settings(train=40, validation=5, evaluation=5, mini_train=4, mini_validation=2, mini_evaluation=2)


def test_prepare_then_pair_then_evaluate(spark, tmp_path):
    raw = spark.read.parquet(f"{SMALL}/raw_rows.parquet").drop("raw_row_index")
    out = str(tmp_path / "sets")
    made = pipeline.prepare(spark, raw, out, FEW)
    counts = {(r["mode"], r["kind"], r["split"]): r["rows"] for r in made["dataset_counts"]}
    assert counts["formal", "evaluation", "evaluation"] == 5 and counts["mini", "sft", "train"] == 4
    kept = sum(counts["formal", "sft", s] for s in ("train", "validation")) + 5 + counts["formal", "reserve", "reserve"]
    left_out = sum(r["rows"] for r in made["filter_counts"])
    assert made["raw_source_rows"] == kept + left_out + made["duplicate_prompt_rows"]
    assert json.loads((tmp_path / "sets" / "metadata.json").read_text())["raw_source_rows"] == made["raw_source_rows"]
    train = files.read_split(spark, f"{out}/formal/sft", "train", {"id", "messages"})
    assert train.count() == counts["formal", "sft", "train"]
    with pytest.raises(Exception, match="(?i)already exists"):
        pipeline.prepare(spark, raw, out, FEW)

    sources = spark.read.parquet(f"{out}/formal/sft")
    wrong = [("the answer is 12345 I think", "eos", False, True, "boxed", False, -0.1, 30), ("", "eos", False, True, "boxed", False, -0.1, 30), ("cut of", "length", True, False, "not_found", False, None, 512)]
    kinds = "generated_text string, finish_reason string, hit_max_new_tokens boolean, answer_extracted boolean, extraction_method string, math_equivalent boolean, average_logprob double, output_tokens int"
    said = sources.select("source_id", "split").crossJoin(F.broadcast(spark.createDataFrame(wrong, kinds))).withColumn("arrival", F.xxhash64("generated_text"))
    report = pipeline.build_pairs(sources, said, str(tmp_path / "pairs"), FEW, files.read_split(spark, f"{out}/mini/sft", "train"))
    n = sources.count()
    assert report["total"] == {"formal_source_questions": n, "formal_candidate_count": 3 * n, "formal_preference_pairs": n, "formal_no_valid_rejected": 0}
    assert {r["reason"]: r["rows"] for r in report["filter_counts"]} == {"empty_text": n, "not_eos": n}
    assert spark.read.parquet(str(tmp_path / "pairs" / "mini")).count() == 4

    summary = pipeline.evaluate(catalog._generations(spark, SMALL), str(tmp_path / "eval"), ["base", "sft", "dpo"])
    assert list(summary) and sum(r["num_examples"] for r in summary.values()) == catalog._generations(spark, SMALL).count()
    assert spark.read.json(str(tmp_path / "eval" / "cases")).count() <= 10


def test_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns: answer"):
        pipeline.prepare(spark, spark.createDataFrame([("a", "b", "c", "d")], "prompt string, initial_reason_steps string, full_chosen string, full_rejected string"), str(tmp_path), FEW)
