"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary through a distinct-word table.

Spark splits each text into words (the vocabulary's own pre-tokens), every distinct word is encoded once,
and the ids are joined back by position. Merges never cross a word, so this equals encoding whole texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import release, written
from ..sources.tables import latest_delivery

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The white space of the vocabulary's pattern, and the pattern itself.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; they concatenate to it. Null gives null, the empty text no words."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def vocabulary(path: str = VOCABULARY) -> list[tuple[bytes, int]]:
    """(piece, id) of a vocabulary file of lines 'base64 id'."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


def _encoder(pieces):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        codec = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=dict(pieces.value), special_tokens={})
        for batch in batches:
            ids = [codec._encode_single_piece(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1)], ["word", "ids", "n"])

    return encode


def split_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, words) of `texts` (doc_id, text), written once for all that follows."""
    return written(texts.select("doc_id", words_of(F.col("text")).alias("words")), "split")


def word_table(split: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(word, ids, n) of every distinct word of `split` (doc_id, words); n is how often it occurs. Written."""
    spark = split.sparkSession
    pieces = spark.sparkContext.broadcast(vocabulary(path))  # bounded by the vocabulary file
    counted = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.mapInArrow(_encoder(pieces), "word string, ids array<int>, n bigint"), "words")


def _common(table: DataFrame, most: int = 5000) -> DataFrame:
    """The part of a word table that is broadcast: words of one id, of which the vocabulary has as many
    as ids, and words with over 1/most of all occurrences, so `most` at the utmost."""
    total = table.agg(F.sum("n")).first()[0] or 0
    return table.where((F.size("ids") == 1) | (F.col("n") > max(1, total // most)))


def texts_of(documents: DataFrame) -> DataFrame:
    """(doc_id, text), each document once (the latest), laid out by doc_id; a null text counts as empty."""
    return latest_delivery(documents, "doc_id", "collected_at", {"text": F.coalesce("text", F.lit(""))})


def _gathered(common, lengths_only: bool):
    """Words of texts met with the broadcast part of the table: the ids between two words that are not in it
    (`known`, or their number), and these words in order (`rare`)."""
    kind = pa.int32()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in batches:
            lists = batch.column("words")
            per_text = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = lists.flatten().dictionary_encode()
            at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = [table.get(w) for w in flat.dictionary.to_pylist()]
            missing = np.array([x is None for x in found], bool)
            ids = pa.array([x or () for x in found], pa.list_(kind))
            sizes = np.asarray(pc.list_value_length(ids)).astype(np.int64)
            is_rare = missing[at] if len(at) else np.empty(0, bool)
            row = np.repeat(np.arange(len(per_text)), per_text)
            rares = np.bincount(row[is_rare], minlength=len(per_text))
            # a text has one segment more than rare words
            segments = np.cumsum(rares + 1) - (rares + 1)
            segment = segments[row] + np.cumsum(is_rare) - (np.cumsum(rares) - rares)[row]
            size = np.bincount(segment, weights=sizes[at], minlength=int((rares + 1).sum())).astype(np.int64)
            outer = pa.array(np.r_[0, np.cumsum(rares + 1)].astype(np.int32))
            if lengths_only:
                known = pa.array(np.add.reduceat(size, segments) if len(segments) else np.empty(0, np.int64), pa.int64())
            else:
                inner = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                known = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, ids.take(pa.array(at)).flatten().cast(kind)))
            words = flat.filter(pa.array(is_rare)).dictionary_decode()
            rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rares)].astype(np.int32)), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), known, rare], ["doc_id", "known", "rare"])

    return gather


def _met(split: DataFrame, table: DataFrame, lengths_only: bool) -> DataFrame:
    """(doc_id, known, rare) of `split`, written. What the driver holds is bounded as `_common` says."""
    common = {r[0]: tuple(r[1]) for r in _common(table).select("word", "ids").collect()}
    known = "bigint" if lengths_only else "array<array<int>>"
    kind = split.schema["doc_id"].dataType.simpleString()
    sent = split.sparkSession.sparkContext.broadcast(common)
    return written(split.mapInArrow(_gathered(sent, lengths_only), f"doc_id {kind}, known {known}, rare array<string>"), "met")


def encode(texts: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of `texts` (doc_id, text): ids without special tokens; empty for an empty or null text.

    Words are split once and counted. Those that the vocabulary has whole, and very frequent ones, meet their
    ids where they stand; all others travel to the table and back, with their place among the text's others.
    """
    split = split_texts(texts)
    table = word_table(split, path)
    met = _met(split, table, False)
    release(split)
    rare = met.where(F.size("rare") > 0).select("doc_id", F.posexplode("rare").alias("pos", "word"))
    back = rare.join(table.select("word", "ids"), "word").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("back"))
    pairs = F.transform(F.col("known"), lambda part, i: F.concat(part, F.coalesce(F.get(F.col("back"), i)["ids"], F.expr("cast(array() as array<int>)"))))
    return met.select("doc_id", "known").join(back, "doc_id", "left").select("doc_id", F.flatten(pairs).alias("ids"))


def token_counts(texts: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens): how many ids `encode` gives, without gathering them."""
    split = split_texts(texts)
    table = word_table(split, path)
    met = _met(split, table, True)
    release(split)
    rare = met.where(F.size("rare") > 0).select("doc_id", F.explode("rare").alias("word"))
    back = rare.join(table.select("word", F.size("ids").alias("size")), "word").groupBy("doc_id").agg(F.sum("size").alias("back"))
    return met.select("doc_id", "known").join(back, "doc_id", "left").select("doc_id", (F.col("known") + F.coalesce("back", F.lit(0))).alias("tokens"))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), by a join with the table of pieces; no ids give the empty text."""
    spark = encoded.sparkSession
    pieces = F.broadcast(spark.createDataFrame([(b, bytearray(a)) for a, b in vocabulary(path)], "id int, piece binary"))
    at = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(pieces, "id", "left")
    got = at.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece")))).alias("got"))
    text = F.array_join(F.transform("got", lambda x: F.hex(x["piece"])), "")
    return got.select("doc_id", F.decode(F.unhex(text), "UTF-8").alias("text"))
