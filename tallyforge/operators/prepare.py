"""From raw rows to split, numbered rows for supervised, preference and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.settings import Settings
from .ranking import bucketed_rank

FIELDS = ("prompt", "initial_reason_steps", "full_chosen", "full_rejected", "answer")


# --- filters: one column with the first reason that applies, null for rows that stay ----------------


def field_reason(rows: DataFrame, settings: Settings) -> DataFrame:
    """`rows` with normalized FIELDS, `normalized_prompt` and `reason`.

    Reasons in order: each field null, then empty; a solution that repeats the given steps; both solutions
    alike; an empty prompt. `raw` columns are replaced by their normal form.
    """
    clean = rows.withColumns({f: T.normalize_text(F.col(f), blank_lines=settings.blank_lines) for f in FIELDS})
    keyed = clean.withColumns({f"_{f}": T.compare_key(F.col(f)) for f in FIELDS[1:4]} | {"normalized_prompt": T.collapse(F.col("prompt"))})
    checks: list[tuple[Column, str]] = []
    for f in FIELDS:
        checks += [(F.col(f).isNull(), f"{f}_not_string"), (F.col(f) == "", f"{f}_empty")]
    for f in ("full_chosen", "full_rejected"):
        checks.append((F.startswith(F.col(f"_{f}"), F.col("_initial_reason_steps")), f"{f}_duplicated_initial_reason_steps"))
    # the steps are a common prefix, so the joined solutions are alike where their tails are
    checks += [(F.col("_full_chosen") == F.col("_full_rejected"), "full_positive_equals_full_negative"), (F.col("normalized_prompt") == "", "empty_normalized_prompt")]
    return keyed.withColumn("reason", first_reason(checks)).drop(*[f"_{f}" for f in FIELDS[1:4]])


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that holds, else null."""
    reason = F.when(checks[0][0], checks[0][1])
    for check, name in checks[1:]:
        reason = reason.when(check, name)
    return reason


def pair_length_reason(prompt: Column, chosen: Column, rejected: Column, settings: Settings) -> Column:
    """Why a preference pair with these token totals is left out."""
    return first_reason(
        [
            (prompt > settings.max_prompt_length, "prompt_too_long"),
            (chosen > settings.max_pair_length, "chosen_too_long"),
            (rejected > settings.max_pair_length, "rejected_too_long"),
            (chosen - prompt <= 0, "chosen_completion_empty"),
            (rejected - prompt <= 0, "rejected_completion_empty"),
        ]
    )


def length_reason(settings: Settings) -> Column:
    """The same for a prepared row with its token columns."""
    pair = pair_length_reason(F.col("prompt_tokens"), F.col("chosen_tokens"), F.col("rejected_tokens"), settings)
    sft, evaluation = F.when(F.col("sft_tokens") > settings.max_length, "sft_too_long"), F.when(F.col("prompt_tokens") > settings.max_length, "evaluation_prompt_too_long")
    return F.coalesce(sft, pair, evaluation)


def reason_counts(reasons: DataFrame, stage: str) -> DataFrame:
    """(stage, reason, rows) of the rows that have a reason."""
    return reasons.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(stage).alias("stage"), "reason", "rows")


# --- keys and duplicates -----------------------------------------------------------------------------


def row_key(prompt: Column, index: Column, settings: Settings) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(settings.row_tag), F.lit(str(settings.seed)), F.lit(settings.revision), prompt, index.cast("string")), 256)


def split_key(prompt: Column, settings: Settings) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(settings.split_tag), F.lit(str(settings.seed)), F.lit(settings.revision), prompt), 256)


def representatives(rows: DataFrame, settings: Settings) -> DataFrame:
    """One row per normalized prompt, that of the least row key, with `source_id` and `split_key`.

    A running minimum with map-side combine: a prompt that a third of all rows share is no hot task, and
    rows that aren't kept are never sorted.
    """
    keyed = rows.withColumn("row_key", row_key(F.col("normalized_prompt"), F.col("raw_row_index"), settings))
    kept = keyed.groupBy("normalized_prompt").agg(F.min(F.struct("row_key", *[F.col(c) for c in keyed.columns if c not in ("row_key", "normalized_prompt")])).alias("r"))
    return kept.select("r.*", "normalized_prompt").withColumns({"source_id": F.sha2("normalized_prompt", 256), "split_key": split_key(F.col("normalized_prompt"), settings)})


# --- tokens and projections --------------------------------------------------------------------------


def count_tokens(messages: Column, per_message: int = 4, opening: int = 0) -> Column:
    """Default counter of a chat: word tokens of all contents, a few more per message and for an opened answer.

    A null content counts as empty. Any Column function of a message array can take its place.
    """
    return F.aggregate(messages, F.lit(opening), lambda n, m: n + F.coalesce(F.size(T.tokens(m["content"])), F.lit(0)) + per_message)


def with_solutions(rows: DataFrame, settings: Settings, counter=count_tokens) -> DataFrame:
    """`rows` with both full solutions, the model's input and its token counts."""
    made = rows.withColumns(
        {
            "model_input": T.model_input(F.col("prompt")),
            "full_positive": T.join_reasoning(F.col("initial_reason_steps"), F.col("full_chosen")),
            "full_negative": T.join_reasoning(F.col("initial_reason_steps"), F.col("full_rejected")),
        }
    )
    opened = T.chat(F.col("model_input"), settings.system_prompt)
    whole = lambda c: F.concat(opened, T.assistant(F.col(c)))
    return made.withColumns(
        {
            "prompt_tokens": counter(opened, opening=3).cast("bigint"),
            "chosen_tokens": counter(whole("full_positive")).cast("bigint"),
            "rejected_tokens": counter(whole("full_negative")).cast("bigint"),
        }
    ).withColumn("sft_tokens", F.col("chosen_tokens"))


def prepared(raw: DataFrame, settings: Settings) -> DataFrame:
    """Everything up to the split: filtered, one row per prompt, short enough."""
    kept = representatives(field_reason(raw, settings).where("reason is null").drop("reason"), settings)
    return with_solutions(kept, settings).where(length_reason(settings).isNull())


# --- splits ------------------------------------------------------------------------------------------


def allocation(available: Column, settings: Settings) -> dict[str, Column]:
    """Rows per split: evaluation first, validation next, train gets what is left; reserve the rest."""
    n = available.cast("bigint")
    evaluation = F.least(F.lit(settings.evaluation).cast("bigint"), n)
    validation = F.least(F.lit(settings.validation).cast("bigint"), n - evaluation)
    train = F.least(F.lit(settings.train).cast("bigint"), n - evaluation - validation)
    return {"train": train, "validation": validation, "evaluation": evaluation}


def split_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    """`rows` with `rank` in split-key order, `split` and the rank within it.

    Keys are hashes in hexadecimal, so three leading digits make 4,096 even buckets that keep their order:
    no task sorts more than one, and only bucket sizes are summed up.
    """
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("available")))  # a single row
    ranked = bucketed_rank(rows, F.substring("split_key", 1, 3), [F.col("split_key")]).crossJoin(n)
    sizes = allocation(F.col("available"), settings)
    first = {"train": F.lit(0).cast("bigint"), "validation": sizes["train"], "evaluation": sizes["train"] + sizes["validation"]}
    end = first["evaluation"] + sizes["evaluation"]
    r = F.col("rank")
    split = F.when(r < first["validation"], "train").when(r < first["evaluation"], "validation").when(r < end, "evaluation").otherwise("reserve")
    start = F.when(r < first["validation"], first["train"]).when(r < first["evaluation"], first["validation"]).when(r < end, first["evaluation"]).otherwise(end)
    return ranked.withColumns({"split": split, "split_rank": r - start}).drop("available")


def mini(rows: DataFrame, settings: Settings) -> DataFrame:
    """The first rows of each split, as many as the mini set takes."""
    most = F.when(F.lit(False), 0)
    for name, n in settings.mini.items():
        most = most.when(F.col("split") == name, n)
    return rows.where(F.col("split_rank") < most)


def row_id(kind: str, settings: Settings) -> Column:
    """Ids hold the split and the rank, padded to five digits and longer where it needs more."""
    tail = F.lit("" if kind in ("evaluation", "reserve") else f"_{kind}")
    return F.concat(F.lit(settings.id_prefix + "_"), F.col("split"), F.lit("_"), F.format_string("%05d", F.col("split_rank")), tail)


def metadata(*more: Column) -> Column:
    return F.struct(
        "raw_row_index",
        F.col("source_id").alias("normalized_prompt_sha256"),
        F.col("dataset").alias("source_dataset"),
        F.lit("full_positive").alias("reference_answer_policy"),
        *more,
    )


def sft_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    opened, said = T.chat(F.col("model_input"), settings.system_prompt), T.assistant(F.col("full_positive"))
    return rows.where("split in ('train', 'validation')").select(
        F.lit(settings.schema_version).alias("schema_version"),
        row_id("sft", settings).alias("id"),
        "source_id",
        opened.alias("prompt"),
        said.alias("completion"),
        F.concat(opened, said).alias("messages"),
        F.col("sft_tokens").alias("token_count"),
        "split",
        metadata().alias("metadata"),
    )


def dpo_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    p, c, r = F.col("prompt_tokens"), F.col("chosen_tokens"), F.col("rejected_tokens")
    counts = F.struct(p.alias("prompt"), c.alias("chosen_total"), r.alias("rejected_total"), (c - p).alias("chosen_completion"), (r - p).alias("rejected_completion"))
    return rows.where("split in ('train', 'validation')").select(
        F.lit(settings.schema_version).alias("schema_version"),
        row_id("dpo", settings).alias("id"),
        "source_id",
        F.lit(0).cast("bigint").alias("step_index"),
        T.chat(F.col("model_input"), settings.system_prompt).alias("prompt"),
        T.assistant(F.col("full_positive")).alias("chosen"),
        T.assistant(F.col("full_negative")).alias("rejected"),
        counts.alias("token_count"),
        "split",
        metadata(F.lit("full_response").alias("dpo_type")).alias("metadata"),
    )


def evaluation_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    return rows.where("split = 'evaluation'").select(
        F.lit(settings.schema_version).alias("schema_version"),
        row_id("evaluation", settings).alias("id"),
        "source_id",
        F.col("model_input").alias("problem"),
        F.col("full_positive").alias("reference_answer"),
        T.chat(F.col("model_input"), settings.system_prompt).alias("prompt_messages"),
        F.col("prompt_tokens").alias("prompt_token_count"),
        "split",
        metadata(F.col("answer").alias("answer")).alias("metadata"),
    )


def reserve_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    return rows.where("split = 'reserve'").select(
        F.lit(settings.schema_version).alias("schema_version"),
        row_id("reserve", settings).alias("id"),
        "source_id",
        F.col("model_input").alias("problem"),
        "full_positive",
        "full_negative",
        "answer",
        "split",
        metadata().alias("metadata"),
    )


# --- reports and checks ------------------------------------------------------------------------------


def manifest(rows: DataFrame) -> DataFrame:
    return rows.select("split", F.col("split_rank").alias("rank"), "source_id", F.col("source_id").alias("normalized_prompt_sha256"), "raw_row_index", "split_key")


def dataset_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """(mode, kind, split, rows) of every set, those without rows too."""
    spark = rows.sparkSession
    grid = [(m, k, s) for m in ("formal", "mini") for k in ("sft", "dpo") for s in ("train", "validation")]
    grid += [("formal", "evaluation", "evaluation"), ("mini", "evaluation", "evaluation"), ("formal", "reserve", "reserve")]
    full = rows.select(F.lit("formal").alias("mode"), "split")
    small = mini(rows, settings).select(F.lit("mini").alias("mode"), "split")
    counted = full.unionByName(small).groupBy("mode", "split").agg(F.count(F.lit(1)).alias("n"))
    return (
        spark.createDataFrame(grid, "mode string, kind string, split string")
        .join(F.broadcast(counted), ["mode", "split"], "left")
        .select("mode", "kind", "split", F.coalesce("n", F.lit(0)).cast("bigint").alias("rows"))
    )


def shortfall(counts: DataFrame, settings: Settings) -> DataFrame:
    """(mode, kind, split, target, rows, missing): how many rows each set lacks."""
    target = F.when(F.lit(False), 0)
    for mode, sizes in (("formal", {"train": settings.train, "validation": settings.validation, "evaluation": settings.evaluation}), ("mini", settings.mini)):
        for split, n in sizes.items():
            target = target.when((F.col("mode") == mode) & (F.col("split") == split), n)
    wanted = counts.where("split <> 'reserve'").withColumn("target", target.cast("bigint"))
    return wanted.select("mode", "kind", "split", "target", "rows", F.greatest(F.lit(0).cast("bigint"), F.col("target") - F.col("rows")).alias("missing"))


def leakage(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """Keys that stand in more than one split, with how many; none in a sound split."""
    return rows.groupBy(key).agg(F.min("split").alias("first_split"), F.max("split").alias("last_split")).where("first_split <> last_split")


def prefix_mismatches(small: DataFrame, full: DataFrame, settings: Settings) -> DataFrame:
    """Where the mini sets aren't the first rows of the formal ones: rows of another source than the formal row
    of their split and rank, and formal rows that should stand in a mini set and don't (`source_id` null)."""
    wanted = mini(full, settings).select("split", "split_rank", F.col("source_id").alias("full_source_id"))
    met = small.select("split", "split_rank", "source_id").join(wanted, ["split", "split_rank"], "full")
    return met.where(~F.col("source_id").eqNullSafe(F.col("full_source_id")))


def length_violations(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows that `settings` find too long, with the reason."""
    return rows.withColumn("reason", length_reason(settings)).where("reason is not null")


def first_rows(rows: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first `n` rows by `order`, all where n is None."""
    return rows if n is None else rows.orderBy(order).limit(n)


def window_first(rows: DataFrame, keys: list[str], order: Column, name: str = "is_first") -> DataFrame:
    """`rows` with whether each is the first of its keys."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)) == 1)
