"""Records of earlier runs: reading them, the gate in front of a stage that builds on one, config checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import first_reason

#: Fields of a record file (`run_config.json` of a run's folder) that the gate looks at.
RECORD = (
    "status string, training_stage string, run_mode string, smoke_test boolean, dataset_paths map<string,string>, "
    "model struct<revision:string,modelscope_name_or_path:string>, model_loader struct<revision:string,modelscope_name_or_path:string,remote_name_or_path:string>"
)
#: Files that a usable adapter has.
ADAPTER = ("adapter_model.safetensors", "adapter_config.json")


def read_runs(spark: SparkSession, folder: str, adapter: str = "best_adapter") -> DataFrame:
    """(root, status, ..., dataset_paths, revision, model_name, has_adapter, has_tokenizer) of all runs below
    `folder`, one folder each; a folder without a record has null fields. Files are listed, not read."""
    runs = folder.rstrip("/")
    where = F.col("_metadata.file_path")
    root = lambda path: F.regexp_extract(path, r"^.*/([^/]+)/[^/]+$", 1)
    records = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "run_config.json").option("recursiveFileLookup", True).json(runs).select(root(where).alias("root"), "*")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(runs).select("path")
    place = F.regexp_extract_all(F.substring_index("path", f"{runs.rsplit('/', 1)[-1]}/", -1), F.lit("[^/]+"), F.lit(0))
    named = files.select(F.get(place, 0).alias("root"), F.get(place, 1).alias("part"), F.element_at(place, -1).alias("file"))
    has = named.groupBy("root").agg(
        F.count_distinct(F.when((F.col("part") == adapter) & F.col("file").isin(*ADAPTER), F.col("file"))).alias("n"), F.max(F.col("part") == "tokenizer").alias("has_tokenizer")
    )
    known = records.withColumns(
        {
            "revision": F.coalesce("model.revision", "model_loader.revision"),
            "model_name": F.coalesce("model.modelscope_name_or_path", "model_loader.modelscope_name_or_path", "model_loader.remote_name_or_path"),
        }
    ).drop("model", "model_loader")
    return has.join(known, "root", "left").withColumn("has_adapter", F.col("n") == len(ADAPTER)).drop("n")


def gate_reason(dataset: str, stage: Column, mode: Column, revision: Column, model_name: Column, smoke: Column) -> Column:
    """Why a run's record can't be built on, null if it can: the first of an ordered series of checks against
    what the next stage expects. A record that names no revision or model is taken as fitting; one without a
    mode must have its data under a folder of that mode."""
    recorded = F.coalesce(F.get(F.map_values(F.map_filter("dataset_paths", lambda k, _: k == dataset)), 0), F.lit(""))
    other = lambda have, want: F.coalesce((F.nullif(have, F.lit("")) != want) & (want != ""), F.lit(False))
    said = F.col("run_mode").isNotNull()
    return first_reason(
        [
            (F.col("status").isNull(), "no_record"),
            (F.col("status") != "completed", "not_completed"),
            (~F.col("training_stage").eqNullSafe(stage), "wrong_stage"),
            (said & (F.col("run_mode") != mode), "other_mode"),
            (~said & ~F.contains(recorded, F.concat(F.lit("/"), mode, F.lit("/"))), "other_mode"),
            (other(F.col("revision"), revision), "other_revision"),
            (other(F.col("model_name"), model_name), "other_model"),
            (F.coalesce(F.col("smoke_test"), F.lit(False)) & ~smoke, "smoke_run"),
            (~F.coalesce(F.col("has_adapter"), F.lit(False)), "adapter_missing"),
            (~F.coalesce(F.col("has_tokenizer"), F.lit(False)), "tokenizer_missing"),
        ]
    )


def gated(runs: DataFrame, config: Mapping, stage: str, dataset: str, smoke: bool = False) -> DataFrame:
    """`runs` of `read_runs` with `reason` against a config."""
    model = config["model"]
    name = model.get("modelscope_name_or_path") or model.get("remote_name_or_path") or ""
    expected = [F.lit(str(v)) for v in (stage, config["project"]["run_mode"], model["revision"], name)]
    return runs.withColumn("reason", gate_reason(dataset, *expected, F.lit(smoke)))


def usable_run(runs: DataFrame, root: str, config: Mapping, stage: str, dataset: str, smoke: bool = False) -> dict:
    """The record of run `root`, if the gate lets it pass; else a ValueError that names the reason."""
    found = gated(runs.where(F.col("root") == root), config, stage, dataset, smoke).head(1)
    reason = found[0].reason if found else "no_record"
    if reason:
        raise ValueError(f"run {root}: {reason}")
    return found[0].asDict(recursive=True)


# --- configs ----------------------------------------------------------------------------------------


def _at(config: Mapping, path: str):
    for part in path.split("."):
        config = config.get(part) if isinstance(config, Mapping) else None
    return config


def _number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return float("nan")


Rule = tuple[str, Callable[[object, Mapping], bool], str]
SECTIONS = ("project", "model", "data", "sft", "dpo", "evaluation")
POSITIVE = (
    "model.max_length", "sft.max_steps", "dpo.train_samples", "dpo.validation_samples", "dpo.max_steps", "dpo.max_length", "dpo.max_prompt_length", "dpo.beta",
    "evaluation.samples", "evaluation.batch_size", "evaluation.max_new_tokens", "evaluation.num_beams",
)
GIVEN = ("data.processed_dir", "model.name_or_path", "model.revision", "evaluation.output_dir")
RULES: list[Rule] = [(s, lambda v, _: isinstance(v, Mapping), "must be a section") for s in SECTIONS]
RULES += [("project.run_mode", lambda v, _: v in ("mini", "formal"), "must be mini or formal")]
RULES += [(p, lambda v, _: bool(v), "is required") for p in GIVEN]
RULES += [("data", lambda v, c: bool(_at(c, f"data.{_at(c, 'project.run_mode')}_dir")), "needs the folder of its run mode")]
RULES += [(p, lambda v, _: _number(v) > 0, "must be positive") for p in POSITIVE]
RULES += [(p, lambda v, _: v is True, "must be true") for p in ("sft.enabled", "dpo.enabled")]
RULES += [("dpo.max_prompt_length", lambda v, c: _number(v) < _number(_at(c, "dpo.max_length")), "must be below dpo.max_length")]
RULES += [(f"dpo.{n}", lambda v, c, n=n: v == _at(c, f"data.{n}"), f"must equal data.{n}") for n in ("train_samples", "validation_samples")]
SAMPLED: list[Rule] = [("temperature", lambda v, _: _number(v) > 0, "must be positive"), ("top_p", lambda v, _: 0 < _number(v) <= 1, "must lie in (0, 1]")]
SHARED = ("project.seed", *[f"data.{k}" for k in ("dataset_name", "dataset_revision", "source_split", "processed_dir", "raw_dir", "mini_dir", "formal_dir")])
NOT_ABOVE = ("data.train_samples", "dpo.train_samples", "evaluation.samples")


def config_problems(config: Mapping) -> list[str]:
    """What a config lacks, every rule it breaks in order; a sampled evaluation needs a temperature and a top_p."""
    found = [f"{path} {why}" for path, holds, why in RULES if not holds(_at(config, path), config)]
    if _at(config, "evaluation.do_sample"):
        found += [f"evaluation.{p}" for p in generation_problems(config["evaluation"])]
    return found


def pair_problems(mini: Mapping, formal: Mapping) -> list[str]:
    """What keeps two configs from being the mini and the formal one of a project."""
    found = [f"project.run_mode must be {mode}" for c, mode in ((mini, "mini"), (formal, "formal")) if _at(c, "project.run_mode") != mode]
    found += [f"{path} must be shared" for path in SHARED if _at(mini, path) != _at(formal, path)]
    return found + [f"{path} of the mini config is above the formal one" for path in NOT_ABOVE if _number(_at(mini, path)) > _number(_at(formal, path))]


def generation_problems(arguments: Mapping) -> list[str]:
    """What is wrong with the arguments of a sampled generation: temperature, top_p, and counts where given."""
    found = [f"{path} {why}" for path, holds, why in SAMPLED if not holds(arguments.get(path), arguments)]
    counts = ("candidates_per_prompt", "batch_size", "max_new_tokens", "limit")
    return found + [f"{c} must be positive" for c in counts if arguments.get(c) is not None and not _number(arguments[c]) > 0]


def require(problems: list[str], what: str) -> None:
    if problems:
        raise ValueError(f"{what}: {'; '.join(problems)}")


#: Settings of an evaluation that its report carries, with their kinds.
EVALUATION = {"output_dir": str, "samples": int, "batch_size": int, "max_new_tokens": int, "do_sample": bool, "temperature": float, "top_p": float, "num_beams": int, "model_stages": list, "metrics": list}
PREFERENCE = {"beta": float, "loss_type": str, "max_length": int, "max_prompt_length": int, "max_steps": int, "learning_rate": float}
IDENTITY = {"name_or_path": str, "revision": str, "modelscope_name_or_path": str, "remote_name_or_path": str}


def settings_of(config: Mapping, section: str, kinds: Mapping[str, type]) -> dict:
    """The settings of a section that a report carries, each in its kind; missing ones are None."""
    given = config.get(section) or {}
    return {k: None if given.get(k) is None else kind(given[k]) for k, kind in kinds.items()}


def dataset_path(config: Mapping, kind: str) -> str:
    """Where the sets of `kind` (sft, dpo, evaluation) lie: the section's own folder, else that of the run mode."""
    own = _at(config, f"{kind}.dataset_dir")
    return str(own) if own else f"{str(_at(config, f'data.{_at(config, 'project.run_mode')}_dir')).rstrip('/')}/{kind}"
