"""The queries over the given tables, one per operator, as functions of (session, folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import pairs as P
from ..operators import prepare as R
from ..operators import scoring as S
from ..operators.skew import spread
from ..operators.ranking import ranged_rank
from ..sources.files import json_safe
from ..sources.tables import latest_delivery, plain_split, read_table
from .durable import written
from .runs import gate_reason
from .settings import Settings

#: The formal run; the tests hold the queries against their SQL under tight values too.
SETTINGS = Settings()
#: Raw rows for which the formal targets hold; other tables get targets in proportion, so that each set has
#: rows at every size and some are left in reserve. None leaves the targets as they are.
PER_ROWS: int | None = 12_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "raw_rows").select("raw_row_index", "prompt", "initial_reason_steps", "full_chosen", "full_rejected", "answer", "dataset"))


def _settings(spark: SparkSession, folder: str) -> Settings:
    return SETTINGS.scaled(read_table(spark, folder, "raw_rows").count(), PER_ROWS) if PER_ROWS else SETTINGS


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return R.split_rows(written(R.prepared(_raw(spark, folder), SETTINGS), "prepared"), _settings(spark, folder))


# --- text --------------------------------------------------------------------------------------------


@query
def normalize_text(spark, folder):
    raw = _raw(spark, folder)
    wild = F.concat(F.lit("  \r\n"), "full_chosen", F.lit("\r\n\r\n\r\r\n\n"), "prompt", F.lit("\t "))
    return raw.select("raw_row_index", T.normalize_text(wild, blank_lines=2).alias("normalized"), T.normalize_text(wild, blank_lines=0).alias("tight"))


@query
def model_input(spark, folder):
    return _raw(spark, folder).select("raw_row_index", T.model_input(F.col("prompt")).alias("model_input"))


@query
def join_reasoning(spark, folder):
    return _raw(spark, folder).select("raw_row_index", T.join_reasoning(F.col("initial_reason_steps"), F.col("full_chosen")).alias("joined"))


@query
def text_compare_key(spark, folder):
    alike = T.starts_alike(F.col("full_chosen"), F.col("initial_reason_steps"))
    return _raw(spark, folder).select("raw_row_index", T.compare_key(F.col("prompt")).alias("compare_key"), alike.alias("starts_alike"))


@query
def word_tokens(spark, folder):
    t = T.tokens(F.col("text"))
    rows = spread(read_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("distinct_tokens"), F.get("t", 0).alias("first_token")).where("t is not null")


@query
def tail_lines(spark, folder):
    rows = _raw(spark, folder).select("raw_row_index", T.tail_lines(F.col("full_chosen"), 3).alias("x"))
    return rows.select("raw_row_index", F.size("x").cast("bigint").alias("n"), F.get("x", 0).alias("last_line"), F.get("x", 2).alias("third_last_line"))


@query
def strip_answer(spark, folder):
    shown = F.concat(F.lit(" ("), F.substring("dataset", 1, 1), F.lit(").: "))
    return _raw(spark, folder).select("raw_row_index", T.strip_answer(F.col("answer")).alias("stripped"), T.strip_answer(shown).alias("letter"))


@query
def abnormal_output(spark, folder):
    rows = spread(read_table(spark, folder, "documents").select("doc_id", "text").where("text is not null"))
    return rows.select("doc_id", T.abnormal(F.col("text")).alias("abnormal"))


@query
def message_text(spark, folder):
    rows = read_table(spark, folder, "dpo_rows")
    return rows.select("id", "loaded_at", F.sha2(T.message_text(F.col("prompt")), 256).alias("prompt_sha"), T.message_text(F.col("chosen")).alias("chosen_text"))


@query
def chat_messages(spark, folder):
    chat = T.chat(F.col("prompt"), SETTINGS.system_prompt)
    rows = _raw(spark, folder).where("prompt is not null").select("raw_row_index", F.posexplode(F.concat(chat, T.assistant(F.col("full_chosen")))).alias("position", "m"))
    return rows.select("raw_row_index", F.col("position").cast("bigint").alias("position"), "m.role", "m.content")


# --- preparation -------------------------------------------------------------------------------------


@query
def field_filter(spark, folder):
    return R.field_reason(_raw(spark, folder), SETTINGS).select("raw_row_index", "reason")


@query
def filter_counts(spark, folder):
    judged = R.field_reason(_raw(spark, folder), SETTINGS)
    kept = R.with_solutions(R.representatives(judged.where("reason is null").drop("reason"), SETTINGS), SETTINGS).withColumn("reason", R.length_reason(SETTINGS))
    return R.reason_counts(judged, "field_filter").unionByName(R.reason_counts(kept, "length"))


@query
def prompt_dedupe(spark, folder):
    kept = R.representatives(R.field_reason(_raw(spark, folder), SETTINGS).where("reason is null").drop("reason"), SETTINGS)
    return kept.select("normalized_prompt", "raw_row_index", "row_key")


@query
def dedupe_stats(spark, folder):
    rows = R.field_reason(_raw(spark, folder), SETTINGS).where("reason is null").groupBy("normalized_prompt").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("prompts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_prompt_rows"))


@query
def source_ids(spark, folder):
    rows = _raw(spark, folder).where("prompt is not null").withColumn("p", T.collapse(F.col("prompt")))
    return rows.select("raw_row_index", F.sha2("p", 256).alias("source_id"), R.split_key(F.col("p"), SETTINGS).alias("split_key"), R.row_key(F.col("p"), F.col("raw_row_index"), SETTINGS).alias("row_key"))


@query
def token_counts(spark, folder):
    kept = R.field_reason(_raw(spark, folder), SETTINGS).where("reason is null")
    p, c, r = F.col("prompt_tokens"), F.col("chosen_tokens"), F.col("rejected_tokens")
    return R.with_solutions(kept, SETTINGS).select("raw_row_index", "prompt_tokens", "chosen_tokens", "rejected_tokens", (c - p).alias("chosen_completion"), (r - p).alias("rejected_completion"))


@query
def length_filter(spark, folder):
    kept = R.field_reason(_raw(spark, folder), SETTINGS).where("reason is null").drop("reason")
    return R.with_solutions(kept, SETTINGS).select("raw_row_index", R.length_reason(SETTINGS).alias("reason"))


@query
def dpo_length_filter(spark, folder):
    t = F.col("token_count")
    rows = read_table(spark, folder, "dpo_rows")
    return rows.select("id", "loaded_at", R.pair_length_reason(t["prompt"], t["chosen_total"], t["rejected_total"], SETTINGS).alias("reason"))


@query
def stable_split(spark, folder):
    return _split(spark, folder).select("source_id", "rank", "split", "split_rank")


@query
def allocate_splits(spark, folder):
    n = R.prepared(_raw(spark, folder), SETTINGS).agg(F.count(F.lit(1)).alias("available"))
    sizes = R.allocation(F.col("available"), _settings(spark, folder))
    return n.select("available", *[c.alias(k) for k, c in sizes.items()])


@query
def row_ids(spark, folder):
    rows = _split(spark, folder)
    return rows.select("source_id", R.row_id("sft", SETTINGS).alias("sft_id"), R.row_id("evaluation", SETTINGS).alias("plain_id"))


@query
def split_manifest(spark, folder):
    return R.manifest(_split(spark, folder))


@query
def dataset_counts(spark, folder):
    return R.dataset_counts(_split(spark, folder), _settings(spark, folder))


@query
def shortfall_counts(spark, folder):
    """Against twice the targets, so that sets fall short."""
    settings = _settings(spark, folder)
    return R.shortfall(R.dataset_counts(_split(spark, folder), settings), settings.scaled(2, 1))


@query
def mini_prefix(spark, folder):
    return R.mini(_split(spark, folder), _settings(spark, folder)).select("split", "split_rank", "source_id")


@query
def mini_length_violations(spark, folder):
    small = R.mini(_split(spark, folder), _settings(spark, folder))
    tighter = Settings(max_length=180, max_prompt_length=120, max_pair_length=190)
    return R.length_violations(small, tighter).select("split", "split_rank", "reason")


@query
def mini_prefix_check(spark, folder):
    """A mini set that lost every seventh row and got another source in every fifth."""
    settings = _settings(spark, folder)
    rows = written(_split(spark, folder), "split")
    small = R.mini(rows, settings).where("split_rank % 7 <> 3")
    damaged = small.withColumn("source_id", F.when(F.col("split_rank") % 5 == 1, F.concat(F.lit("x"), "source_id")).otherwise(F.col("source_id")))
    return R.prefix_mismatches(damaged, rows, settings)


def _delivered(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """Each id of a delivered table once, its split in plain spelling."""
    kept = {c: F.col(c) for c in columns} | {"split": plain_split(F.col("split"), F.col("id"))}
    return latest_delivery(read_table(spark, folder, table), "id", "loaded_at", kept)


@query
def split_leakage(spark, folder):
    """Sources of the delivered tables that stand in more than one split, however those are spelled."""
    rows = _delivered(spark, folder, "sft_rows", "source_id").unionByName(_delivered(spark, folder, "evaluation_rows", "source_id"))
    return R.leakage(rows.unionByName(_delivered(spark, folder, "dpo_rows", "source_id")))


@query
def field_filter_reasons(spark, folder):
    """Every reason of the field filter, on rows whose fields are damaged in turn."""
    k = F.col("raw_row_index") % 20
    raw = _raw(spark, folder)
    for i, f in enumerate(R.FIELDS):
        raw = raw.withColumn(f, F.when(k == 2 * i, F.lit(None)).when(k == 2 * i + 1, F.lit(" \t ")).otherwise(F.col(f)))
    steps, chosen = F.col("initial_reason_steps"), F.col("full_chosen")
    raw = raw.withColumns(
        {
            "full_chosen": F.when(k == 10, F.concat(F.lit(" "), steps, F.lit(" then more"))).otherwise(chosen),
            "full_rejected": F.when(k == 11, F.concat(F.upper(steps), F.lit(" or less"))).when(k == 12, F.concat(F.lit("  "), chosen)).otherwise(F.col("full_rejected")),
        }
    )
    return R.field_reason(raw, SETTINGS).select("raw_row_index", "reason")


@query
def sft_rows(spark, folder):
    rows = R.sft_rows(_split(spark, folder), SETTINGS)
    return rows.select("schema_version", "id", "source_id", F.get("prompt", 0)["content"].alias("system"), F.get("prompt", 1)["content"].alias("user"), F.get("completion", 0)["content"].alias("completion"), F.size("messages").cast("bigint").alias("messages"), "token_count", "split", "metadata.raw_row_index", "metadata.source_dataset", "metadata.reference_answer_policy")


@query
def dpo_rows(spark, folder):
    rows = R.dpo_rows(_split(spark, folder), SETTINGS)
    return rows.select("id", "source_id", "step_index", F.get("prompt", 1)["content"].alias("user"), F.get("chosen", 0)["content"].alias("chosen"), F.get("rejected", 0)["content"].alias("rejected"), "token_count.prompt", "token_count.chosen_total", "token_count.rejected_total", "token_count.chosen_completion", "token_count.rejected_completion", "split", "metadata.dpo_type")


@query
def evaluation_rows(spark, folder):
    rows = R.evaluation_rows(_split(spark, folder), SETTINGS)
    return rows.select("id", "source_id", "problem", "reference_answer", "prompt_token_count", "split", "metadata.answer", "metadata.normalized_prompt_sha256")


@query
def reserve_rows(spark, folder):
    rows = R.reserve_rows(_split(spark, folder), SETTINGS)
    return rows.select("id", "source_id", "problem", "full_positive", "full_negative", "answer", "split", "metadata.raw_row_index")


@query
def limit_rows(spark, folder):
    return R.first_rows(read_table(spark, folder, "orders"), 25, "o_orderkey").select("o_orderkey", "o_custkey")


# --- pairs -------------------------------------------------------------------------------------------


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = _delivered(spark, folder, "sft_rows", "source_id", "prompt", "completion").where("prompt is not null and completion is not null")
    return rows.select("source_id", "split", F.col("id").alias("sft_row_id"), "prompt", "completion", F.col("id").alias("arrival"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Both answers of the preference rows, and the supervised ones in capitals, stand in for sampled ones; what
    a generation run would report (finish, extraction, scores) is derived from the text's length."""
    rows = _delivered(spark, folder, "dpo_rows", "source_id", "chosen", "rejected")
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get(c, 0)["content"].alias("t")) for k, c in ((0, "chosen"), (1, "rejected"))])).alias("v")
    said = rows.select("source_id", "split", F.col("id").alias("a"), both)
    own = _delivered(spark, folder, "sft_rows", "source_id", "completion")
    again = F.struct(F.lit(2).alias("k"), F.upper(F.get("completion", 0)["content"]).alias("t")).alias("v")
    said = said.unionByName(own.select("source_id", "split", F.col("id").alias("a"), again))
    n = F.coalesce(F.length("v.t"), F.lit(0))
    methods = F.array(*[F.lit(m) for m in ("boxed", "hash_answer", "labeled_answer_line", "labeled_answer", "final_line_choice", "final_line_numeric", "tail_number", "not_found")])
    made = said.select(
        "source_id", "split", F.concat("a", F.lit("|"), F.col("v.k").cast("string")).alias("arrival"), F.col("v.t").alias("generated_text"),
        F.when(n % 7 == 0, "length").otherwise("eos").alias("finish_reason"), (n % 9 == 4).alias("hit_max_new_tokens"), (n % 11 != 0).alias("answer_extracted"),
        F.get(methods, n % 8).alias("extraction_method"), (n % 5 == 0).alias("math_equivalent"), F.when(n % 13 != 0, -(n % 100) / F.lit(100.0)).alias("average_logprob"), (n % 400).alias("output_tokens"),
    )
    return P.with_ids(made)


#: Pairs are held to the lengths of the formal run.
PAIRS = SETTINGS


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return P.joined_reasons(P.first_sources(_sources(spark, folder), "arrival"), _candidates(spark, folder), PAIRS)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return P.select_pairs(_judged(spark, folder), PAIRS)


@query
def candidate_ids(spark, folder):
    return _candidates(spark, folder).select("arrival", F.col("candidate_index").cast("bigint").alias("candidate_index"), "id")


@query
def candidate_filter(spark, folder):
    return _judged(spark, folder).select("id", "reason")


@query
def candidate_quality(spark, folder):
    rows = _candidates(spark, folder)
    return rows.select("id", F.round(P.quality(F.col("average_logprob"), F.col("output_tokens"), F.col("extraction_method")), 9).alias("score"))


@query
def candidate_stats(spark, folder):
    return P.candidate_stats(_judged(spark, folder), _candidates(spark, folder))


@query
def avg_logprob(spark, folder):
    rows = read_table(spark, folder, "embeddings")
    return rows.select("vec_id", F.round(P.average(F.transform("embedding", lambda v: v.cast("double"))), 9).alias("average"))


@query
def select_pairs(spark, folder):
    return _pairs(spark, folder).select("id", "source_id", "split", "metadata.candidate_id", "metadata.original_sft_row_id", "token_count.chosen_completion", "token_count.rejected_completion")


@query
def no_valid_rejected(spark, folder):
    return P.without_pair(P.first_sources(_sources(spark, folder), "arrival"), _pairs(spark, folder)).select("source_id", "split", "sft_row_id")


@query
def split_report(spark, folder):
    made = P.split_report(_sources(spark, folder), _candidates(spark, folder), _pairs(spark, folder))
    return made.select("split", "source_questions", "unique_source_id", "candidate_count", "final_preference_pairs", "no_valid_rejected", F.round("chosen_average_tokens", 6).alias("chosen_average_tokens"))


@query
def total_report(spark, folder):
    return P.total_report(P.split_report(_sources(spark, folder), _candidates(spark, folder), _pairs(spark, folder)))


@query
def mini_pairs(spark, folder):
    """Pairs of the sources in the mini set: the first of each split by id, as many as it takes."""
    ranked = ranged_rank(P.first_sources(_sources(spark, folder), "arrival"), ["sft_row_id"], ("split",))
    most = F.when(F.col("split") == "train", PAIRS.mini_train).when(F.col("split") == "validation", PAIRS.mini_validation)
    return P.mini_pairs(_pairs(spark, folder), ranked.where(F.col("rank") < most)).select("id", "split")


@query
def duplicate_sources(spark, folder):
    """Supervised rows as delivered, again or not, that aren't the first of their source and split."""
    arrival = F.concat("id", F.lit("|"), F.col("loaded_at").cast("string"))
    rows = read_table(spark, folder, "sft_rows").select("source_id", plain_split(F.col("split"), F.col("id")).alias("split"), arrival.alias("arrival"))
    return P.duplicate_sources(rows, "arrival").select("arrival", "reason")


@query
def audit_sample(spark, folder):
    return P.audit_sample(_pairs(spark, folder), 20, SETTINGS).select("id", "split")


# --- answers and scoring -----------------------------------------------------------------------------


@query
def extract_answer(spark, folder):
    rows = spread(read_table(spark, folder, "raw_rows").select("raw_row_index", "full_chosen"))
    cut = F.when(F.col("raw_row_index") % 5 == 0, "length").otherwise("eos")
    made = rows.where("full_chosen is not null").select("raw_row_index", A.extract_answer(F.col("full_chosen"), cut).alias("x"))
    return made.select("raw_row_index", "x.answer", "x.method")


@query
def gold_reference(spark, folder):
    rows = read_table(spark, folder, "evaluation_rows").where("reference_answer is not null")
    made = rows.select("id", "loaded_at", A.gold_answer(F.when(~F.endswith("id", F.lit("3")), F.col("metadata.answer")), F.col("reference_answer")).alias("x"))
    return made.select("id", "loaded_at", "x.answer", "x.source", "x.method")


@query
def normalize_answer(spark, folder):
    return A.with_normal(_raw(spark, folder).select("raw_row_index", "answer"), normalized=F.col("answer")).select("raw_row_index", "normalized")


def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of lineitem written in six ways: integer, decimal, percent, slash, LaTeX, with a unit."""
    rows = spread(read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    written = (
        F.when(F.col("l_linenumber") % 6 == 0, F.concat(q, F.lit(".50")))
        .when(F.col("l_linenumber") % 6 == 1, F.concat(q, F.lit("%")))
        .when(F.col("l_linenumber") % 6 == 2, F.concat(q, F.lit("/"), n))
        .when(F.col("l_linenumber") % 6 == 3, F.concat(F.lit("\\frac{"), q, F.lit("}{"), n, F.lit("}")))
        .when(F.col("l_linenumber") % 6 == 4, F.concat(q, F.lit(" cm")))
        .otherwise(F.concat(F.lit("x = -"), q))
    )
    return rows.select("l_orderkey", "l_linenumber", q.alias("q"), written.alias("written"))


@query
def answer_rational(spark, folder):
    return A.with_rational(_numbers(spark, folder), value=F.col("written")).select("l_orderkey", "l_linenumber", "value")


@query
def compare_answers(spark, folder):
    rows = _numbers(spark, folder)
    asked = F.when(F.col("l_linenumber") == 1, "What percent is left?")
    return A.compare_answers(rows, "x", F.col("written"), F.col("q"), asked, F.col("written") == F.col("q")).select("l_orderkey", "l_linenumber", F.col("x.equal").alias("equal"), F.col("x.method").alias("method"))


@query
def choice_match(spark, folder):
    rows = read_table(spark, folder, "part")
    prompt = F.concat(F.lit("Which size?\nA. "), F.col("p_size").cast("string"), F.lit("\n(B) "), (F.col("p_size") + 1).cast("string"), F.lit("\nC: "), (F.col("p_size") + 2).cast("string"), F.lit("."))
    given = F.when(F.col("p_partkey") % 3 == 0, "B").when(F.col("p_partkey") % 3 == 1, (F.col("p_size") + 2).cast("string")).otherwise("(a)")
    wanted = F.when(F.col("p_partkey") % 3 == 0, (F.col("p_size") + 1).cast("string")).when(F.col("p_partkey") % 3 == 1, "C").otherwise((F.col("p_size") + 1).cast("string"))
    made = A.compare_answers(rows, "x", given, wanted, prompt, F.lit(False))
    return made.select("p_partkey", F.col("x.equal").alias("equal"), F.col("x.method").alias("method"))


@query
def match_methods(spark, folder):
    """Every way in which two answers can match, in turn over the parts."""
    rows = read_table(spark, folder, "part").select("p_partkey", "p_size")
    k, n = F.col("p_partkey") % 11, F.col("p_size").cast("string")
    more = (F.col("p_size") + 1).cast("string")
    long = F.concat(n, F.lit("0" * 30))
    pairs = [
        (F.lit(None).cast("string"), n, None), (n, n, None), (F.concat(n, F.lit(".50")), F.concat((F.col("p_size") * 2 + 1).cast("string"), F.lit("/2")), None),
        (F.concat(n, F.lit("%")), n, "What percent is left?"), (F.concat(F.lit("It is "), n, F.lit(" boxes")), n, None),
        (F.concat(n, F.lit("\\sqrt{2}\\text{ cm}")), F.concat(n, F.lit("\\sqrt{2}")), None), ("B", more, "options"), (more, "(b)", "options"), (more, n, None),
        (F.concat(long, F.lit("/"), long), F.lit("1"), None), (F.concat(long, F.lit("1/"), long), F.lit("1"), None),
    ]
    options = F.concat(F.lit("Which size?\nA. "), n, F.lit("\n(B) "), more, F.lit("."))
    given = wanted = asked = None
    for i, (p, r, prompt) in enumerate(pairs):
        text = options if prompt == "options" else F.lit(prompt)
        p, r = (F.lit(x) if isinstance(x, str) else x for x in (p, r))
        given = F.when(k == i, p) if given is None else given.when(k == i, p)
        wanted = F.when(k == i, r) if wanted is None else wanted.when(k == i, r)
        asked = F.when(k == i, text) if asked is None else asked.when(k == i, text)
    made = A.compare_answers(rows.withColumns({"given": given, "wanted": wanted, "asked": asked}), "x", F.col("given"), F.col("wanted"), F.col("asked"), k == 1)
    return made.select("p_partkey", F.col("x.equal").alias("equal"), F.col("x.method").alias("method"))


@query
def extraction_methods(spark, folder):
    """Every way in which an answer is found, in turn over the parts, and what a reference would take from it."""
    rows = read_table(spark, folder, "part").select("p_partkey", "p_size")
    k, n = F.col("p_partkey") % 10, F.col("p_size").cast("string")
    filler = "\nthen\nthen\nthen\nthen\nthen"
    texts = [
        F.concat(F.lit("so \\boxed{\\frac{"), n, F.lit("}{7}}.")), F.concat(F.lit("work\n#### "), n), F.concat(F.lit("The answer is: "), n, F.lit(".")), F.concat(F.lit("answer: "), n, F.lit(filler)),
        F.lit("we take\n(C)"), F.concat(F.lit("we get\n"), n, F.lit("/9")), F.concat(F.lit("about "), n, F.lit(" apples in all")), F.lit("no digits here"),
        F.concat(F.lit("we get\n"), n), F.concat(F.lit("\\boxed{"), F.lit("{" * 30), n, F.lit("}" * 30), F.lit("}")),
    ]
    text = None
    for i, t in enumerate(texts):
        text = F.when(k == i, t) if text is None else text.when(k == i, t)
    cut = F.when(k == 8, "length").otherwise("eos")
    made = rows.withColumn("text", text).select("p_partkey", A.extract_answer(F.col("text"), cut).alias("x"), A.gold_answer(F.lit(None).cast("string"), F.col("text")).alias("g"))
    return made.select("p_partkey", "x.answer", "x.method", F.col("g.answer").alias("gold"), F.col("g.method").alias("gold_method"))


@query
def run_gate(spark, folder):
    """Records of runs made of orders, held against what the next stage expects."""
    k = F.col("o_orderkey")
    rows = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(k % 31 != 0, F.when(k % 7 == 0, "failed").otherwise("completed")).alias("status"), F.when(k % 11 == 0, "dpo").when(k % 11 != 1, "sft").alias("training_stage"), F.when(k % 3 == 0, "formal").when(k % 13 == 0, "mini").alias("run_mode"),
        F.when(k % 17 == 0, "r2").when(k % 17 < 9, "r1").alias("revision"), F.when(k % 19 == 0, "other/model").when(k % 19 < 4, "").otherwise("some/model").alias("model_name"), (k % 23 == 0).alias("smoke_test"),
        F.create_map(F.lit("sft"), F.when(k % 5 == 0, "/sets/mini/sft").otherwise("/sets/formal/sft")).alias("dataset_paths"), (k % 29 != 0).alias("has_adapter"), (k % 37 != 0).alias("has_tokenizer"),
    )
    reason = gate_reason("sft", F.lit("sft"), F.lit("formal"), F.lit("r1"), F.lit("some/model"), F.lit(False))
    return rows.select("o_orderkey", reason.alias("reason"))


@query
def finish_reason(spark, folder):
    rows = read_table(spark, folder, "lineitem")
    n = F.col("l_linenumber")
    ids = F.transform(F.sequence(F.lit(1), n + 2), lambda i: F.when(i > n, 0).otherwise(F.pmod(F.col("l_orderkey") + i, F.lit(9)) + 1).cast("int"))
    made = rows.select("l_orderkey", "l_linenumber", A.finish_reason(ids, [9], 0, 6).alias("x"))
    return made.select("l_orderkey", "l_linenumber", F.size("x.ids").cast("bigint").alias("kept"), "x.reason", "x.hit_max")


def _generations(spark: SparkSession, folder: str) -> DataFrame:
    """Reference solutions of the evaluation rows stand in for generated texts, one of three stages each."""
    rows = spread(read_table(spark, folder, "evaluation_rows").where("reference_answer is not null"))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    stages = F.array(F.lit("base"), F.lit("sft"), F.lit("dpo"))
    return rows.select(
        "id", "loaded_at", "source_id", F.get(stages, (number % 3).cast("int")).alias("model_stage"), "prompt_messages", F.col("reference_answer").alias("generated_text"), "reference_answer",
        F.when(number % 4 == 0, F.lit("7")).otherwise(F.col("metadata.answer")).alias("answer"), F.when(number % 5 == 0, "length").otherwise("eos").alias("finish_reason"),
        (number % 10 == 0).alias("hit_max_new_tokens"), (number % 300).alias("output_tokens"), ((number % 40) / F.lit(8.0)).alias("generation_seconds"),
    )


@query
def score_predictions(spark, folder):
    made = S.score(_generations(spark, folder))
    return made.select("id", "loaded_at", "model_stage", "predicted_answer", "extraction_method", "reference_final_answer", "reference_answer_source", "normalized_predicted_answer", "normalized_reference_answer", "strict_exact_match", "math_equivalent", "match_method")


@query
def prediction_summary(spark, folder):
    made = S.summarize(S.score(_generations(spark, folder)))
    return made.select("model_stage", "num_examples", *[F.round(c, 9).alias(c) for c in (*S.RATES, "average_real_output_tokens", "average_output_tokens", "average_generation_seconds")])


@query
def case_samples(spark, folder):
    made = S.cases(S.score(_generations(spark, folder)), ["model_stage", "id", "loaded_at"], 5)
    return made.select("case", "model_stage", "id", "match_method")


# --- training metrics and checks ---------------------------------------------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    nan = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).when(F.col("event_id") % 19 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return read_table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), "event_type", nan.alias("metric"))


@query
def best_checkpoint(spark, folder):
    rows = _events(spark, folder)
    return S.best_checkpoint(rows.where("event_type <> 'click'"), rows.groupBy("run_id").agg(F.max("metric").alias("metric")))


@query
def running_best(spark, folder):
    return S.running_best(_events(spark, folder))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder)
    return rows.select("run_id", "step", F.when(F.col("step") % 3 == 0, F.col("metric")).alias("loss"), F.when(F.col("step") % 3 == 1, F.col("metric")).alias("eval_loss"))


@query
def loss_history(spark, folder):
    return S.loss_history(_log(spark, folder)).select("run_id", "step", F.col("loss").isNotNull().alias("trains"))


@query
def finite_metrics(spark, folder):
    return S.not_finite(_log(spark, folder)).select("run_id", "step")


@query
def json_safe_rows(spark, folder):
    return json_safe(_log(spark, folder)).select("run_id", "step", "loss", "eval_loss")


@query
def dpo_violations(spark, folder):
    return S.pair_violations(read_table(spark, folder, "dpo_rows"), 150, 260).select("id", "loaded_at", "violation")


def queries() -> dict[str, Query]:
    return {name: partial(f) for name, f in QUERIES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows to counted sets: scan, clean, dedupe, filter, order, allocate, count."""
    return R.dataset_counts(_split(spark, folder), _settings(spark, folder))
