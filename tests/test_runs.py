"""Run records and their gate, configs, loaders, and what ranks and pairs do with hot sources."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import pairs as P
from tallyforge.operators.ranking import ranged_rank
from tallyforge.plans import runs
from tallyforge.plans.durable import written
from tallyforge.sources import files, loaders

CONFIG = {
    "project": {"run_mode": "formal", "seed": 42},
    "model": {"name_or_path": "/m", "revision": "r1", "modelscope_name_or_path": "some/model", "max_length": 2048},
    "data": {"processed_dir": "/d", "formal_dir": "/d/formal", "mini_dir": "/d/mini", "train_samples": 8000, "validation_samples": 1000, "dataset_name": "n", "dataset_revision": "x", "source_split": "train", "raw_dir": "/r"},
    "sft": {"enabled": True, "max_steps": 300},
    "dpo": {"enabled": True, "train_samples": 8000, "validation_samples": 1000, "max_steps": 200, "max_length": 2048, "max_prompt_length": 1024, "beta": 0.1},
    "evaluation": {"output_dir": "/o", "samples": 1000, "batch_size": 8, "max_new_tokens": 512, "num_beams": 1, "temperature": 1.0, "top_p": 1.0},
}


def changed(path, value):
    made = copy.deepcopy(CONFIG)
    at = made
    *parts, last = path.split(".")
    for p in parts:
        at = at[p]
    at[last] = value
    return made


def mini():
    made = changed("project.run_mode", "mini")
    made["data"]["train_samples"] = made["dpo"]["train_samples"] = 256
    return made


@pytest.mark.parametrize(
    ("path", "value", "problem"),
    [
        ("project.run_mode", "full", "project.run_mode must be mini or formal"), ("model.revision", "", "model.revision is required"), ("model.max_length", 0, "model.max_length must be positive"), ("data.formal_dir", None, "data needs the folder of its run mode"),
        ("sft.enabled", False, "sft.enabled must be true"), ("dpo.beta", "x", "dpo.beta must be positive"), ("dpo.max_prompt_length", 2048, "dpo.max_prompt_length must be below dpo.max_length"), ("dpo.train_samples", 7, "dpo.train_samples must equal data.train_samples"),
        ("evaluation.num_beams", None, "evaluation.num_beams must be positive"), ("sft", None, "sft must be a section"),
    ],
)
def test_config_rules(path, value, problem):
    assert runs.config_problems(CONFIG) == []
    assert problem in runs.config_problems(changed(path, value))
    with pytest.raises(ValueError, match="config"):
        runs.require(runs.config_problems(changed(path, value)), "config")


def test_sampled_generation_and_pairs_of_configs():
    sampled = changed("evaluation.do_sample", True)
    sampled["evaluation"]["top_p"] = 1.5
    assert runs.config_problems(sampled) == ["evaluation.top_p must lie in (0, 1]"]
    assert runs.generation_problems({"temperature": 0, "top_p": 0.9, "limit": 0}) == ["temperature must be positive", "limit must be positive"]
    assert runs.pair_problems(mini(), CONFIG) == []
    other = mini()
    other["project"]["seed"], other["data"]["raw_dir"], other["evaluation"]["samples"] = 1, "/elsewhere", 5000
    assert runs.pair_problems(other, mini()) == ["project.run_mode must be formal", "project.seed must be shared", "data.raw_dir must be shared", "evaluation.samples of the mini config is above the formal one"]


def test_paths_and_settings_of_reports():
    assert runs.dataset_path(CONFIG, "sft") == "/d/formal/sft" and runs.dataset_path(changed("dpo.dataset_dir", "/own"), "dpo") == "/own"
    assert runs.settings_of(CONFIG, "evaluation", runs.EVALUATION)["samples"] == 1000 and runs.settings_of(CONFIG, "evaluation", runs.EVALUATION)["metrics"] is None
    assert runs.settings_of(CONFIG, "model", runs.IDENTITY)["revision"] == "r1"


def test_run_records(spark, tmp_path):
    good = {"status": "completed", "training_stage": "sft", "run_mode": "formal", "model": {"revision": "r1", "modelscope_name_or_path": "some/model"}, "smoke_test": False, "more": [1]}
    cases = {
        "good": (good, None), "failed": (good | {"status": "failed"}, "not_completed"), "stage": (good | {"training_stage": "dpo"}, "wrong_stage"), "mode": (good | {"run_mode": "mini"}, "other_mode"),
        "path": ({k: v for k, v in good.items() if k != "run_mode"} | {"dataset_paths": {"sft": "/d/formal/sft"}}, None), "nopath": ({k: v for k, v in good.items() if k != "run_mode"}, "other_mode"),
        "revision": (good | {"model": {"revision": "r2"}}, "other_revision"), "loader": (good | {"model": {}, "model_loader": {"remote_name_or_path": "x/y"}}, "other_model"), "silent": (good | {"model": {}}, None),
        "smoke": (good | {"smoke_test": True}, "smoke_run"), "bare": (good, "adapter_missing"), "untokenized": (good, "tokenizer_missing"), "none": (None, "no_record"),
    }
    for name, (record, _) in cases.items():
        root = tmp_path / "runs" / name
        (root / "best_adapter").mkdir(parents=True)
        if record is not None:
            (root / "run_config.json").write_text(json.dumps(record, indent=1))
        for f in runs.ADAPTER[: 1 if name == "bare" else 2]:
            (root / "best_adapter" / f).write_text("x")
        if name != "untokenized":
            (root / "tokenizer").mkdir()
            (root / "tokenizer" / "tokenizer.json").write_text("{}")
    found = written(runs.read_runs(spark, str(tmp_path / "runs")), "runs")
    assert {r.root: r.reason for r in runs.gated(found, CONFIG, "sft", "sft").collect()} == {k: v for k, (_, v) in cases.items()}
    assert runs.usable_run(found, "smoke", CONFIG, "sft", "sft", smoke=True)["training_stage"] == "sft"
    for name in ("failed", "missing"):
        with pytest.raises(ValueError, match=f"run {name}: (not_completed|no_record)"):
            runs.usable_run(found, name, CONFIG, "sft", "sft")


MESSAGES = "array<struct<role:string,content:string>>"
DPO = f"id string, source_id string, step_index int, prompt {MESSAGES}, chosen {MESSAGES}, rejected {MESSAGES}, token_count struct<prompt:int,chosen_total:int,rejected_total:int,chosen_completion:int,rejected_completion:int>, split string"


def test_loaders(spark, tmp_path):
    one, two = [("assistant", "a")], [("assistant", "b")]
    rows = [(f"x_{i}", "s", 0, one, one, two, (1, 2, 9 if i == 11 else 2, 1, 1), "train" if i else "validation") for i in range(12)]
    path = str(tmp_path / "dpo")
    with pytest.raises(FileNotFoundError):
        loaders.load_pair(spark, path, "dpo")
    files.write_tree(spark.createDataFrame(rows, DPO).repartition(3), path)
    train, validation = loaders.load_pair(spark, path, "dpo", train=10, lengths=(5, 5))
    assert [r.id for r in train.collect()] == [f"x_{i}" for i in range(1, 11)] and validation.count() == 1
    with pytest.raises(ValueError, match="rejected_too_long: x_11"):
        loaders.load_pair(spark, path, "dpo", lengths=(5, 5))
    with pytest.raises(ValueError, match="missing columns"):
        loaders.load_split(spark, path, "sft", "train")
    with pytest.raises(ValueError, match="no rows"):
        loaders.load_split(spark, path, "dpo", "evaluation")


def test_cached_source(spark, tmp_path):
    path = str(tmp_path / "raw")
    assert loaders.cached(spark.range(3), path).count() == 3
    assert loaders.cached(spark.range(9), path).count() == 3
    with pytest.raises(FileExistsError):
        loaders.cached(spark.range(9), path, refresh=True)
    assert loaders.cached(spark.range(9), path, refresh=True, overwrite=True).count() == 9


def test_hot_source_is_ranked_in_ranges(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source_id"), F.lit("train").alias("split"), (F.col("id") * 7919 % 4000).alias("arrival"))
    got = ranged_rank(rows.repartition(5), ["arrival"], ("source_id", "split")).collect()
    hot = sorted((r.arrival, r["rank"]) for r in got if r.source_id == "hot")
    assert [k for _, k in hot] == list(range(len(hot))) and len(got) == 4000
    ids = P.with_ids(rows).where("source_id = 'hot' and candidate_index = 7").collect()
    assert [r.id for r in ids] == ["hot_train_cand_07"] and ids[0].arrival == hot[7][0]


def test_documents_on_any_storage(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/one.json"
    files.write_json(spark, path, {"b": float("inf"), "a": [float("nan"), "é"]})
    assert files.read_json(spark, path) == {"a": [None, "é"], "b": None} and files.read_json(spark, path + "x") is None
