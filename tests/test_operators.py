"""Preparation, pairs, scoring, ranks, joins, files and the stream."""

import json
import math
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import pairs as P
from tallyforge.operators import prepare as R
from tallyforge.operators import scoring as S
from tallyforge.operators.ranking import bucketed_rank
from tallyforge.operators.skew import lookup_join, spread
from tallyforge.plans.durable import release, shared_folder, written
from tallyforge.plans.settings import Settings, load
from tallyforge.sources import files
from tallyforge.sources.tables import latest_delivery
from tallyforge.streaming import losses

SMALL = Settings(train=8, validation=3, evaluation=3, mini_train=2, mini_validation=1, mini_evaluation=1)
RAW = "raw_row_index bigint, prompt string, initial_reason_steps string, full_chosen string, full_rejected string, answer string, dataset string"


def raw(spark, n=30, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"Problem  {rng.randrange(n // 2)}", "Step 1", f"then {i}", f"but {i}", str(i), None) for i in range(n)]
    return spark.createDataFrame(rows, RAW)


def test_field_reasons(spark):
    good = ("Q", "Step 1", "so 4", "so 5", "4")
    cases = [(good, None)]
    for k, f in enumerate(R.FIELDS):
        cases += [((*good[:k], None, *good[k + 1 :]), f"{f}_not_string"), ((*good[:k], " \n ", *good[k + 1 :]), f"{f}_empty")]
    cases += [(("Q", "Step 1", "step   1 then", "so 5", "4"), "full_chosen_duplicated_initial_reason_steps"), (("Q", "Step 1", "so 4", "STEP 1", "4"), "full_rejected_duplicated_initial_reason_steps")]
    cases += [(("Q", "Step 1", "so  4", "SO 4", "4"), "full_positive_equals_full_negative"), ((None, None, None, None, None), "prompt_not_string")]
    rows = spark.createDataFrame([(i, *c, None) for i, (c, _) in enumerate(cases)], RAW)
    got = {r.raw_row_index: r.reason for r in R.field_reason(rows, SMALL).collect()}
    assert got == {i: r for i, (_, r) in enumerate(cases)}


def test_allocation(spark):
    def sizes(n, settings):
        return list(spark.range(1).select(*R.allocation(F.lit(n), settings).values()).first())

    assert sizes(8887, Settings()) == [6887, 1000, 1000]
    assert sizes(1500, Settings()) == [0, 500, 1000]
    assert sizes(0, Settings()) == [0, 0, 0]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_splits_do_not_depend_on_the_layout(spark, parts):
    wanted = {r.source_id: (r.split, r.split_rank, r.rank) for r in R.split_rows(R.prepared(raw(spark), SMALL), SMALL).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    shuffled = raw(spark).orderBy(F.rand(parts)).repartition(parts)
    got = {r.source_id: (r.split, r.split_rank, r.rank) for r in R.split_rows(R.prepared(shuffled, SMALL), SMALL).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == wanted and sorted(r for _, _, r in got.values()) == list(range(len(got)))


def test_mini_is_a_prefix_and_splits_do_not_leak(spark):
    rows = R.split_rows(R.prepared(raw(spark), SMALL), SMALL)
    assert R.prefix_mismatches(R.mini(rows, SMALL), rows, SMALL).count() == 0
    assert R.leakage(rows).count() == 0
    moved = R.mini(rows, SMALL).withColumn("source_id", F.lit("other"))
    assert R.prefix_mismatches(moved, rows, SMALL).count() == 4
    assert [r.source_id for r in R.prefix_mismatches(R.mini(rows, SMALL).where("split <> 'evaluation'"), rows, SMALL).collect()] == [None]


def test_empty_raw_table(spark):
    nothing = R.split_rows(R.prepared(raw(spark).limit(0), SMALL), SMALL)
    assert nothing.count() == 0 and R.sft_rows(nothing, SMALL).count() == 0
    counts = R.dataset_counts(nothing, SMALL)
    assert counts.count() == 11 and counts.where("rows <> 0").count() == 0
    assert {r.missing for r in R.shortfall(counts, SMALL).collect()} == {8, 3, 2, 1}


def test_no_plan_has_row_wise_python_or_one_partition_windows(spark):
    plan = R.split_rows(R.prepared(raw(spark), SMALL), SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_six_digit_ranks_keep_all_digits(spark):
    rows = spark.createDataFrame([("train", 7), ("train", 123456)], "split string, split_rank bigint")
    assert [r[0] for r in rows.select(R.row_id("sft", SMALL)).collect()] == ["stepmath_train_00007_sft", "stepmath_train_123456_sft"]


CANDIDATE = "source_id string, split string, arrival int, generated_text string, finish_reason string, hit_max_new_tokens boolean, answer_extracted boolean, extraction_method string, math_equivalent boolean, average_logprob double, output_tokens int"


def test_candidate_reasons(spark):
    ok = ("It is five, I say", "eos", False, True, "boxed", False, -0.5, 100)
    cases = [
        ((" ", *ok[1:]), "empty_text"), (("same text", "length", *ok[2:]), "not_eos"), (("Same  TEXT", *ok[1:]), "duplicate_text"), ((None, *ok[1:]), "empty_text"),
        (("max", "eos", True, *ok[3:]), "hit_max_new_tokens"), (("none given", "eos", False, False, *ok[4:]), "no_answer"), (("weak one", "eos", False, True, "tail_number", *ok[5:]), "no_explicit_final_answer"),
        (("right one", "eos", False, True, "boxed", True, *ok[6:]), "correct_answer"), (("abc", *ok[1:]), "abnormal_output"), (ok, None), (("unknown", None, None, None, None, None, None, None), "not_eos"),
    ]
    rows = spark.createDataFrame([("s", "train", i, *c) for i, (c, _) in enumerate(cases)], CANDIDATE)
    got = {r.arrival: r.reason for r in P.candidate_reasons(P.with_ids(rows)).collect()}
    assert got == {i: r for i, (_, r) in enumerate(cases)}


def test_equal_scores_take_the_earlier_candidate(spark):
    text = lambda k: f"a wrong but readable answer {k}"
    rows = spark.createDataFrame([("s", "train", k, text(k), "eos", False, True, "boxed", False, -0.5, 100) for k in range(3)], CANDIDATE)
    sources = spark.createDataFrame([("s", "train", "row", [("user", "q")], [("assistant", "right")], 1), ("none", "train", "r2", [("user", "q")], [("assistant", "x")], 1)], "source_id string, split string, sft_row_id string, prompt array<struct<role:string,content:string>>, completion array<struct<role:string,content:string>>, arrival int")
    judged = P.joined_reasons(sources, P.with_ids(rows), Settings())
    pairs = P.select_pairs(judged, Settings())
    assert [r.metadata.candidate_index for r in pairs.collect()] == [0]
    assert [r.source_id for r in P.without_pair(sources, pairs).collect()] == ["none"]
    report = P.split_report(sources, P.with_ids(rows), pairs).first()
    assert (report.source_questions, report.candidate_count, report.final_preference_pairs, report.no_valid_rejected) == (2, 3, 1, 1)


def test_quality(spark):
    rows = spark.createDataFrame([(None, 100, "boxed"), (-0.5, 300, "labeled_answer_line"), (0.0, None, None)], "p double, n int, m string")
    got = [r[0] for r in rows.select(P.quality(F.col("p"), F.col("n"), F.col("m"))).collect()]
    assert got == pytest.approx([-99.96, -0.4744, 0.0])


def test_stats_of_nothing_are_zero(spark):
    rows = P.with_ids(spark.createDataFrame([], CANDIDATE))
    assert [(r["count"], r.ratio) for r in P.candidate_stats(rows, rows).collect()] == [(0, 0.0)] * 5


def test_best_checkpoint(spark):
    losses_ = [0.2502, 0.2393, 0.2316, 0.2267, 0.2250, 0.2247]
    rows = [("sft", 50 * (i + 1), v) for i, v in enumerate(losses_)] + [("dpo", 50 * (i + 1), v) for i, v in enumerate([0.5756, 0.5346, 0.5267, 0.5274])]
    rows += [("tie", 10, 0.5), ("tie", 20, 0.5), ("tie", 30, math.nan), ("none", 1, math.inf), ("none", 2, None)]
    final = spark.createDataFrame([("none", 0.9), ("sft", 0.1)], "run_id string, metric double")
    got = {r.run_id: r.step for r in S.best_checkpoint(spark.createDataFrame(rows, "run_id string, step int, metric double"), final).collect()}
    assert got == {"sft": 300, "dpo": 150, "tie": 10, "none": None}
    improved = S.running_best(spark.createDataFrame(rows, "run_id string, step int, metric double")).where("run_id = 'tie'").orderBy("step").collect()
    assert [r.improved for r in improved] == [True, False]


def test_summary_of_a_missing_stage_raises(spark):
    rows = spark.createDataFrame([("base", True, True, True, True, "eos", False, 5, 0.5)], "model_stage string, answer_extracted boolean, reference_answer_extracted boolean, strict_exact_match boolean, math_equivalent boolean, finish_reason string, hit_max_new_tokens boolean, output_tokens int, generation_seconds double")
    assert S.summarize(rows, ["base"]).first().num_examples == 1
    with pytest.raises(Exception, match="No predictions for sft"):
        S.summarize(rows, ["base", "sft"]).collect()


def test_pair_violations(spark):
    one, two = [("assistant", "a")], [("assistant", "b")]
    counts = (1, 2, 2, 1, 1)
    rows = [
        ("", one, one, two, counts, "id_empty"), ("a", one, one, one, counts, "chosen_equals_rejected"), ("b", None, one, two, counts, "prompt_empty"), ("c", one, [], two, counts, "chosen_empty"),
        ("d", one, one, None, counts, "rejected_empty"), ("e", one, one, two, None, "token_count_invalid"), ("f", one, one, two, (1, 2, 2, -1, 1), "token_count_invalid"), ("g", one, one, two, (99, 2, 2, 1, 1), "prompt_too_long"),
        ("h", one, one, two, (1, 99, 2, 1, 1), "chosen_too_long"), ("i", one, one, two, (1, 2, 99, 1, 1), "rejected_too_long"), ("j", one, one, two, counts, None), (None, one, one, two, counts, "id_empty"),
    ]
    m = "array<struct<role:string,content:string>>"
    made = spark.createDataFrame(rows, f"id string, prompt {m}, chosen {m}, rejected {m}, token_count struct<prompt:int,chosen_total:int,rejected_total:int,chosen_completion:int,rejected_completion:int>, want string")
    got = S.pair_violations(made, 50, 50).collect()
    assert all(r.violation == r.want for r in got) and len(got) == len(rows) - 1


def test_ranks(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(10_000), i) for i in range(500)]
    made = bucketed_rank(spark.createDataFrame(rows, "g string, v int, i int"), F.floor(F.col("v") / 1000), [F.col("v"), F.col("i")], ("g",))
    got = {r.i: r["rank"] for r in made.collect()}
    for g in ("a", "b", None):
        mine = sorted((v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in mine] == list(range(len(mine)))


def test_hot_keys_join_once(spark):
    rows = written(spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")), "rows")
    lookup = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = lookup_join(rows, lookup, "k")
    assert got.count() == 60_000 and got.where("w <> 2 * k").count() == 0
    release(rows)


def test_latest_delivery(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", None, "x"), ("a", 2, "new"), (None, 3, "y")], "id string, t int, v string")
    assert sorted(tuple(r) for r in latest_delivery(rows, "id", "t", {"v": F.col("v")}).collect()) == [("a", "new"), ("b", "x")]


def test_written_tables_use_the_session_s_folder(spark):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: {"spark.checkpoint.dir": "hdfs://shared/x/"}.get(name, default)))
    assert shared_folder(session) == "hdfs://shared/x"
    own = shared_folder(spark)  # unset in tests
    table = written(spark.range(3), "x")
    assert own == shared_folder(spark) and table._tallyforge_path.startswith(own) and table.count() == 3
    release(table)
    assert not os.path.exists(table._tallyforge_path)


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8


def test_json(spark, tmp_path):
    rows = spark.createDataFrame([(math.nan, [1.0, math.inf], (2.0, "é"), None), (1.5, None, None, "x")], "b double, a array<double>, c struct<x:double,y:string>, d string")
    files.write_jsonl(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert sorted(lines, key=str) == sorted([{"a": [1.0, None], "b": None, "c": {"x": 2.0, "y": "é"}, "d": None}, {"a": None, "b": 1.5, "c": None, "d": "x"}], key=str)
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_jsonl(rows, str(tmp_path / "out"))
    files.write_json(spark, str(tmp_path / "one.json"), {"b": math.nan, "a": {1: [math.inf, "é"]}})
    assert (tmp_path / "one.json").read_text(encoding="utf-8") == '{\n  "a": {\n    "1": [\n      null,\n      "é"\n    ]\n  },\n  "b": null\n}\n'


def test_trees_and_records(spark, tmp_path):
    files.write_tree(spark.createDataFrame([(1, "train"), (2, "validation")], "id int, split string"), str(tmp_path / "t"))
    assert files.read_split(spark, str(tmp_path / "t"), "train", {"id"}).count() == 1
    with pytest.raises(ValueError, match="missing columns: prompt"):
        files.read_split(spark, str(tmp_path / "t"), "train", {"prompt"})
    with pytest.raises(ValueError, match="no rows"):
        files.read_split(spark, str(tmp_path / "t"), "test")
    with pytest.raises(RuntimeError), files.run_record(spark, str(tmp_path / "r.json"), {"stage": "x"}):
        raise RuntimeError("broken")
    assert json.loads((tmp_path / "r.json").read_text())["status"] == "failed"
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("")
    with pytest.raises(FileExistsError):
        files.guard_output(spark, str(tmp_path / "full"), overwrite=False)
    files.guard_output(spark, str(tmp_path / "full"), overwrite=True)
    assert not list((tmp_path / "full").iterdir())
    assert [r.raw_row_index for r in files.numbered(spark.createDataFrame([("a",), ("b",)], "x string")).collect()] == [0, 1]


def test_settings(tmp_path):
    with pytest.raises(ValueError):
        Settings(max_prompt_length=5, max_pair_length=5)
    with pytest.raises(ValueError):
        Settings(train=1)
    assert Settings().smoke(4, 2, 2).mini == {"train": 4, "validation": 2, "evaluation": 2}
    (tmp_path / "s.json").write_text('{"seed": 7}')
    assert load(str(tmp_path / "s.json")).seed == 7


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5, "2030-01-01 00:00:00"), ("a", 2, math.nan, "2030-01-01 00:10:00"), ("b", 1, 0.25, "2030-01-01 03:00:00")], "run_id string, step int, loss double, ts string")
    rows.write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log")).withColumn("ts", F.to_timestamp("ts"))
    for name, made, mode in (("alarms", losses.loss_alarms(log), "append"), ("windows", losses.windowed_losses(log), "complete")):
        run = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(60)
    assert [r.step for r in spark.table("alarms").collect()] == [2]
    assert sorted((r.run_id, r.rows, r.least) for r in spark.table("windows").collect()) == [("a", 1, 0.5), ("b", 1, 0.25)]
