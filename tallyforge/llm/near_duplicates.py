"""Problems 1 and 5: near-duplicates within a table, and overlaps between training and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import expanding_join, lookup_join
from ..plans.durable import written
from ..sources.tables import latest_delivery
from .components import components
from .similar import SIMILARITY, contained_pairs, plain_words, similar_pairs
from .splits import plain_split


def user_content(messages: Column) -> Column:
    """The content of the user message, wherever it stands; null if there is none."""
    return F.get(F.filter(messages, lambda m: F.lower(F.trim(m["role"])) == "user"), 0)["content"]


def worded(rows: DataFrame, text: Column, side: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, words, side and `extra`) of the latest delivery of each id, without texts that have no word."""
    columns = {"words": plain_words(text), "side": side.cast("int"), **(extra or {})}
    return latest_delivery(rows, "id", "loaded_at", columns).where(F.col("words") != "")


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members are `rows` with the digest of their words, sets (rid, digest, words, side)
    have one row per side and word sequence. Copies, a third of all rows or more, are combined map-side."""
    keyed = rows.withColumn("digest", F.unhex(F.md5(F.concat_ws(" ", F.col("side").cast("string"), "words"))))
    members = written(keyed, "members")
    texts = members.groupBy("digest").agg(F.min("words").alias("words"), F.min("side").alias("side"))
    # ids are drawn as the table is written, once
    return members.drop("words"), written(texts.withColumn("rid", F.monotonically_increasing_id()), "texts")


def groups(rows: DataFrame) -> DataFrame:
    """(id, side, group) of `rows` (id, words, side): the component of each row among its side.

    Equal word sequences are always one group; texts of fewer than three words have no runs, so they join
    equal ones only.
    """
    members, sets = distinct_texts(rows)
    links = similar_pairs(sets, apart=True)
    found = components(links.select("a", "b"))
    placed = sets.select("rid", "digest").join(found.withColumnRenamed("node", "rid"), "rid", "left").select("digest", F.coalesce("component", "rid").alias("group"))
    return written(lookup_join(members, placed, "digest").select("id", "side", "group"), "groups")


def pairs_in_groups(grouped: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all rows that share a group, as the result is defined; `grouped` is written.

    `groups` has the same in one row per row; a group with a third of all rows is met in parts."""
    a, b = (grouped.select("group", F.col("id").alias(name)) for name in ("id_a", "id_b"))
    return expanding_join(a, b, "group").where("id_a < id_b").select("id_a", "id_b")


def table_rows(sft: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both tables' rows for problem 1: side 0 is sft_rows, side 1 evaluation_rows."""
    first = worded(sft, user_content(F.col("prompt")), F.lit(0))
    return first.unionByName(worded(evaluation, F.col("problem"), F.lit(1)))


def split_rows(sft: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both tables' rows for problem 5: side 0 trains, side 1 is held out; `split` and `dataset` ride along."""
    split = plain_split(F.col("split"), F.col("id"))
    dataset = {"split": split, "dataset": F.col("metadata.source_dataset")}
    side = F.when(split == "train", 0).when(split == "validation", 1)
    first = worded(sft, user_content(F.col("prompt")), side, dataset).where("side is not null")
    held = {"split": F.lit("evaluation"), "dataset": F.col("metadata.source_dataset")}
    return first.unionByName(worded(evaluation, F.col("problem"), F.lit(1), held))


#: Share of a held-out text's runs that makes it contained in a training text, however long that is.
CONTAINED = (4, 5)


def overlaps(rows: DataFrame, contained: tuple[int, int] = CONTAINED) -> DataFrame:
    """(train_id, held_id, held_split, held_dataset, similarity, containment, linked) of each pair of a training
    and a held-out row that is linked by similarity (Jaccard, 0.6) or of which the training text contains the
    share `contained` of the held-out text's runs or more; `linked` tells the former.

    Equal texts of fewer than three words have similarity and containment 1. Texts without a word match nothing.
    """
    members, sets = distinct_texts(rows)
    found = contained_pairs(sets, SIMILARITY, contained)
    short = F.size(F.split("words", " ")) < 3
    one = F.lit(1).cast("bigint")
    train = sets.where((F.col("side") == 0) & short).select(F.col("rid").alias("a"), "words")
    held = sets.where((F.col("side") == 1) & short).select(F.col("rid").alias("b"), "words")
    equal = train.join(held, "words").select("a", "b", one.alias("shared"), one.alias("runs_a"), one.alias("runs_b"))
    pairs = found.unionByName(equal)
    names = written(lookup_join(members, sets.select("digest", "rid"), "digest").select("rid", "id", "side", "split", "dataset"), "names")
    a = names.where("side = 0").select(F.col("rid").alias("a"), F.col("id").alias("train_id"))
    b = names.where("side = 1").select(F.col("rid").alias("b"), F.col("id").alias("held_id"), F.col("split").alias("held_split"), F.col("dataset").alias("held_dataset"))
    shared, union = F.col("shared"), F.col("runs_a") + F.col("runs_b") - F.col("shared")
    p, q = SIMILARITY
    return expanding_join(b, expanding_join(a, pairs, "a"), "b").select(
        "train_id",
        "held_id",
        "held_split",
        "held_dataset",
        (shared / union).alias("similarity"),
        (shared / F.col("runs_b")).alias("containment"),
        (q * shared >= p * union).alias("linked"),
    )
