"""Queries of the eight problems, by the names the driver knows, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..plans.durable import written
from ..sources.tables import latest_delivery, read_table
from . import defects, formatting, near_duplicates, packing, splits, tokenizing, truncation
from .oracle import oracle_sql as oracle_sql


def _table_rows(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.table_rows(read_table(spark, folder, "sft_rows"), read_table(spark, folder, "evaluation_rows"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.pairs_in_groups(near_duplicates.groups(_table_rows(spark, folder)))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per row with a text: its group, named by the least id, and the group's rows."""
    grouped = near_duplicates.groups(_table_rows(spark, folder))
    named = grouped.groupBy("group").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_rows"))
    name = F.when(F.col("side") == 0, "sft_rows").otherwise("evaluation_rows")
    return lookup_join(grouped, named, "group").select(name.alias("table_name"), "id", "group_id", "group_rows")


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_duplicates.split_rows(read_table(spark, folder, "sft_rows"), read_table(spark, folder, "evaluation_rows"))
    return near_duplicates.overlaps(rows)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).where("linked").select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b"))


def p5_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Linked pairs, and held-out rows whose runs stand in a training row to four fifths, however long that is."""
    return _overlaps(spark, folder).drop("linked")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per held-out split and source dataset: linked pairs, held-out rows and training rows in them."""
    counts = [F.count(F.lit(1)).alias("pairs"), F.countDistinct("held_id").alias("held_rows"), F.countDistinct("train_id").alias("train_rows")]
    return _overlaps(spark, folder).where("linked").groupBy("held_split", "held_dataset").agg(*counts)


def _row_copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    text = F.when(~formatting._blank(F.col("prompt")), formatting.canonical_text(F.col("prompt")))
    return formatting.copy_groups(read_table(spark, folder, "raw_rows").withColumn("_canonical", text), "raw_row_index", "_canonical")


def _copies(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, DataFrame]]:
    records = read_table(spark, folder, "raw_records").withColumn("_canonical", formatting.canonical_record(F.col("payload")))
    return [("raw_rows", *_row_copies(spark, folder)), ("raw_records", *formatting.copy_groups(records, "record_id", "_canonical"))]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [formatting.copies_of(r, g).select(F.lit(name).alias("table_name"), "kept_key", "copy_key") for name, r, g in _copies(spark, folder)]
    return parts[0].unionByName(parts[1])


def p2_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One record per group of copies, with the number of records it stands for."""
    parts = [g.select(F.lit(name).alias("table_name"), "kept_key", "copies") for name, _, g in _copies(spark, folder)]
    return parts[0].unionByName(parts[1])


def p2_batch_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch of raw_rows: copies found beside what the preparation run reported (latest issue of the batch)."""
    raw = read_table(spark, folder, "raw_rows")
    records, groups = _row_copies(spark, folder)
    found = formatting.copies_of(records, groups).select(F.col("copy_key").alias("raw_row_index"), F.lit(1).alias("copy"))
    per_batch = (
        raw.select("raw_row_index", "batch_id").join(found, "raw_row_index", "left").groupBy("batch_id").agg(F.count(F.lit(1)).alias("raw_rows"), F.count("copy").alias("found_copies"))
    )
    issued = read_table(spark, folder, "prep_metadata").groupBy("batch_id").agg(F.max_by("filter_counts_by_reason", "created_at").alias("latest"))
    reported = F.col("latest.dedupe.duplicate_prompt_rows")
    return per_batch.join(issued, "batch_id", "left").select(
        "batch_id", "raw_rows", "found_copies", reported.alias("reported_duplicates"), (F.col("found_copies") - reported).alias("missed_copies")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.spread_groups(splits.dpo_relations(read_table(spark, folder, "dpo_rows")))


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.dpo_relations(read_table(spark, folder, "dpo_rows"))
    return splits.assign_splits(rows, read_table(spark, folder, "split_targets"))


def p3_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What any new assignment must keep: all rows and groups, no group in two splits, and shares within a
    hundredth of the rows, or within the weight of the heaviest group, of what split_targets asks for."""
    made = written(p3_splits(spark, folder), "splits")
    groups = made.groupBy("group_id").agg(F.count_distinct("split").alias("splits"))
    n = made.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))
    heaviest = made.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("heaviest"))
    asked = read_table(spark, folder, "split_targets").where("split is not null and proportion > 0")
    share = asked.select("split", (F.col("proportion") / F.sum("proportion").over(W.partitionBy())).alias("share"))  # one row per split
    got = share.join(F.broadcast(made.groupBy("split").agg(F.count(F.lit(1)).alias("n"))), "split", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(heaviest))
    off = F.coalesce(F.max(F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("rows")) - F.col("heaviest")) <= 0, F.lit(True))
    torn = groups.where("group_id is not null").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("splits") > 1).alias("torn_groups"))
    return n.crossJoin(F.broadcast(torn)).crossJoin(F.broadcast(got.agg(off.alias("in_proportion"))))  # one row each


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).select("id", "field_name", "defect")


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    return defects.defects(defects.values(read_table(spark, folder, "dpo_rows"), read_table(spark, folder, "sft_rows")))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Values per field, defect and what it was found by (templates, words or the other checks)."""
    return _defects(spark, folder).groupBy("field_name", "defect", "evidence").agg(F.count(F.lit(1)).alias("values"))


def p4_empty(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).where("defect = 'empty'").select("id", "field_name")


def p4_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).where("defect = 'copy'").select("id", "field_name")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.texts_of(read_table(spark, folder, "documents"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.encode(_texts(spark, folder))


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: number of ids, and whether decoding them gives the text back."""
    texts = _texts(spark, folder)
    encoded = written(tokenizing.encode(texts), "ids")
    back = tokenizing.decode(encoded).withColumnRenamed("text", "restored")
    joined = texts.join(encoded, "doc_id").join(back, "doc_id")
    return joined.select("doc_id", F.size("ids").cast("bigint").alias("tokens"), (F.col("text") == F.col("restored")).alias("same"))


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(documents, without_ids, restored): documents, those without ids, those that decoding gives back."""
    made = p6_restored(spark, folder)
    return made.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("tokens") == 0).alias("without_ids"), F.count_if("same").alias("restored"))


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(documents, overfull, torn): documents that are placed, containers beyond the capacity, and documents cut
    although they fit into one."""
    made = written(p7_containers(spark, folder), "placed")
    loads = made.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("load")).agg(F.count_if(F.col("load") > packing.CAPACITY).alias("overfull"))
    each = made.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    torn = (F.col("pieces") > 1) & (F.col("tokens") <= packing.CAPACITY)
    return each.agg(F.count(F.lit(1)).alias("documents"), F.count_if(torn).alias("torn")).crossJoin(F.broadcast(loads)).select("documents", "overfull", "torn")  # one row each


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokenizing.token_counts(_texts(spark, folder)))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(read_table(spark, folder, "documents")).select("doc_id")


def p8_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Per source of the documents: its channel, documents with a text, truncated ones, those of them that only
    the form of the ending tells, and the share of truncated ones. A document delivered again counts once."""
    documents = read_table(spark, folder, "documents")
    cut = truncation.truncated(documents)
    latest = latest_delivery(documents, "doc_id", "collected_at", {"source": F.col("source"), "has_text": F.col("text").isNotNull()}).where("has_text")
    counts = [F.count(F.lit(1)).alias("documents"), F.count("why").alias("truncated"), F.count_if(F.col("why") == "unfinished").alias("by_form")]
    counted = latest.join(cut, "doc_id", "left").groupBy("source").agg(*counts)
    catalog = read_table(spark, folder, "source_catalog").select("source", "channel")
    return counted.join(catalog, "source", "left").select("source", "channel", "documents", "truncated", "by_form", (F.col("truncated") / F.col("documents")).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_groups, p2_found, p2_collapsed, p2_batch_report, p3_found, p3_splits, p3_invariants, p4_found, p4_counts, p4_empty, p4_copies, p5_found, p5_containment, p5_report]
    found += [p6_ids, p6_restored, p6_totals, p7_containers, p7_fill, p7_totals, p8_found, p8_by_source]
    return {f.__name__: f for f in found}
