"""Problem 8: texts that were cut off.

A self-join by prefix, at two grains. Whole texts are sorted, so that a text which is a strict prefix of a
longer one stands right before it. And what stands from each word of the corpus on is a value, too: hashes
of the two or three words before bring a text's last word together with all words that follow the same words
elsewhere, and the text is cut if what stands there mostly goes on where the text stops. Only ends that
neither decides are left to the form of the ending, a fallback that is reported apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..plans.durable import release, written
from . import endings
from .similar import _small
from .tokenizing import texts_of

#: An end is cut if texts elsewhere go on there this many times as often as one ends so. A ratio only, so that
#: a verdict holds when all counts grow alike.
RARE = 50
#: Words of a hashed prefix.
LENGTHS = (3, 2)
#: Reasons in the order in which one of several is reported.
REASONS = ("prefix", "continued", "unfinished")
BREAK = "⏎"
NAME = re.compile(r"^(\W*)([A-ZÀ-ÞА-Я][^\W\d_]*(?:['’-][^\W\d_]+)*)(.*)$", re.S)
RUNS_ON = re.compile(r"\W*[a-zß-ÿа-я0-9]")


def masked(word: str) -> tuple[str, str]:
    """A word as it counts at the start of a sentence or line (lower case), and inside one (capitals as N,
    for names); digits are # in both."""
    bare = re.sub(r"\d+", "#", word) if any(map(str.isdigit, word)) else word
    name = NAME.match(bare)
    lower = bare.lower()
    return lower, f"{name[1]}N{name[3].lower()}" if name else lower


def bare_end(text: str) -> str:
    """Without white space and marks that were put after a cut."""
    text = endings.stripped(text)
    mark = endings.CUT_MARK.search(text, max(0, len(text) - 40)) if text and text[-1] in ".…⋯])" else None
    return text[: mark.start()].rstrip() if mark else text


def _mix(value: np.ndarray) -> np.ndarray:
    value = value * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def _words(texts: list[str], known: dict, forms: dict) -> tuple[np.ndarray, ...]:
    """Words of all texts in order: (row, masked word as its place in `known`, keys by length, whether the
    sentence or line goes on after it, whether it is the text's last).

    `known` numbers the masked words and is filled on the way, `forms` keeps them for texts to come; a key hashes the words before within the
    sentence or line and the word's first letter.
    """
    import xxhash

    spaced = pc.replace_substring_regex(pa.array(texts, pa.string()), r"\s*[\n\r]+\s*", f" {BREAK} ")
    spaced = pc.replace_substring_regex(spaced, r"([\x{3000}-\x{303f}\x{3400}-\x{9fff}\x{ff00}-\x{ffef}])", r" \1 ")
    lists = pc.utf8_split_whitespace(spaced)
    flat = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)).astype(np.int64))
    at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.dictionary.to_pylist()
    numbered = []
    for w in words:
        both = forms.get(w)
        if both is None:
            both = forms[w] = masked(w)
        numbered.append((known.setdefault(both[0], len(known)), known.setdefault(both[1], len(known))))
    named = np.array(numbered, np.int64).reshape(-1, 2)
    stops = np.array([w.rstrip(endings.CLOSERS)[-1:] in endings.STOPS and w.rstrip(endings.CLOSERS) != "" for w in words], bool)
    runs_on = np.array([bool(RUNS_ON.match(w)) for w in words], bool)
    line_end = np.array([w == BREAK for w in words], bool)
    keep = np.array([w != "" for w in words], bool)[at]
    at, row = at[keep], row[keep]
    if not len(at):
        return row, at, np.empty((len(LENGTHS), 0), np.uint64), keep[:0], keep[:0]
    last = np.r_[row[1:] != row[:-1], True]
    after = np.r_[at[1:], 0]
    goes_on = ~last & ~line_end[at] & ~line_end[after] & ~(stops[at] & ~runs_on[after])
    first = np.r_[True, ~goes_on[:-1]]
    word = np.where(first, named[at, 0], named[at, 1])
    names = list(known)
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64)
    initials = np.array([xxhash.xxh3_64_intdigest(x[:1]) for x in names], np.uint64)
    place = np.arange(len(word))
    depth = place - np.maximum.accumulate(np.where(first, place, 0))
    keys = []
    for length in LENGTHS:
        key = initials[word] + np.uint64(length)
        for k in range(1, length + 1):
            before = np.where(depth >= k, np.r_[np.zeros(min(k, len(word)), np.uint64), hashes[word[:-k]]], np.uint64(7))
            key = _mix(key ^ before + np.uint64(k))
        keys.append(key)
    return row, word, np.array(keys), goes_on, last


JUDGED = "digest binary, unfinished boolean, last string, keys array<bigint>, key bigint, next string, goes bigint, ends bigint"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text whether its ending is unfinished by form, its last word and the keys of that; per batch how
    often each word follows each key elsewhere than at a text's end, going on or ending there."""
    lengths = len(LENGTHS)
    kinds = [pa.binary(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in JUDGED.split(", ")]

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    forms: dict[str, tuple[str, str]] = {}
    for batch in _small(batches, "text"):
        texts = batch.column("text").to_pylist()
        known: dict[str, int] = {}
        if len(forms) > 200_000:
            forms = {}
        row, word, keys, goes_on, last = _words([bare_end(t) for t in texts], known, forms)
        said = list(known)
        tail: list = [None] * len(texts)
        met: list = [None] * len(texts)
        for r, w, k in zip(row[last].tolist(), word[last].tolist(), keys[:, last].T.view(np.int64).tolist(), strict=True):
            tail[r], met[r] = said[w], k
        yield rows({"digest": batch.column("digest"), "unfinished": [endings.unfinished(t) for t in texts], "last": tail, "keys": met}, len(texts))
        inner = ~last
        key = keys[:, inner].reshape(-1)
        if not len(key):
            continue
        next_, goes = np.tile(word[inner], lengths), np.tile(goes_on[inner], lengths)
        order = np.argsort(key * np.uint64(0x9E3779B97F4A7C15) + next_.astype(np.uint64), kind="stable")
        key, next_, goes = key[order], next_[order], goes[order]
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (next_[1:] != next_[:-1])])
        n = np.diff(np.r_[edge, len(key)])
        g = np.add.reduceat(goes.astype(np.int64), edge)
        yield rows({"key": key[edge].view(np.int64), "next": [said[w] for w in next_[edge].tolist()], "goes": g, "ends": n - g}, len(edge))


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted texts: those that the next one continues; and each partition's first and last."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    before: tuple | None = None
    first: tuple | None = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "part", "digest", "text"])

    for batch in batches:
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if before is None:
                first = (digest, text)
            elif text != before[1] and text.startswith(before[1]):
                out.append(("prefix", part, before[0], before[1][-40:] + text[len(before[1])]))
            before = (digest, text)
        if out:
            yield batch_of(out)
            out = []
    if first and before:
        yield batch_of([("first", part, *first), ("last", part, *before)])


def strict_prefixes(texts: DataFrame) -> DataFrame:
    """(digest, seam) of `texts` (digest, text) that are strict prefixes of another; seam is the text's end
    and the one character that follows it there."""
    ordered = texts.select("digest", "text").repartitionByRange("text").sortWithinPartitions("text")
    found = written(ordered.mapInArrow(_adjacent, "kind string, part int, digest binary, text string"), "adjacent")
    # two rows per partition; a pair that two partitions share is found here
    ends = found.where("kind <> 'prefix'")
    order = W.orderBy("part", "kind")
    after = ends.withColumn("next", F.lead("text").over(order)).where("kind = 'last' and next is not null and next <> text and startswith(next, text)")
    seam = F.concat(F.right("text", F.lit(40)), F.substring(F.col("next"), F.length("text") + 1, F.lit(1)))
    return found.where("kind = 'prefix'").select("digest", F.col("text").alias("seam")).unionByName(after.select("digest", seam.alias("seam")))


def continued(judged: DataFrame) -> DataFrame:
    """(digest) of the texts among `judged` whose last words are a strict prefix of what stands elsewhere.

    Of a last word and the words before it, `goes` counts where the corpus goes on after it or has a longer
    word in its place, `ends` where a line or sentence ends with it, and the texts that end so themselves.
    At either of LENGTHS the text is cut if the first is RARE times the others or more.
    """
    tails = judged.where("keys is not null").select("digest", "last", F.explode("keys").alias("key"))
    tails = written(tails.withColumn("tail", F.xxhash64("key", "last")), "tails")
    asked = tails.groupBy("tail", "key", "last").agg(F.count(F.lit(1)).alias("asks"))
    table = judged.where("key is not null").groupBy("key", "next").agg(F.sum("goes").alias("goes"), F.sum("ends").alias("ends"))
    met = asked.join(table, "key").where(F.startswith("next", "last"))
    equal = F.col("next") == F.col("last")
    counted = met.groupBy("tail", "asks").agg(F.sum(F.when(equal, F.col("goes")).otherwise(F.col("goes") + F.col("ends"))).alias("goes"), F.sum(F.when(equal, F.col("ends")).otherwise(0)).alias("ends"))
    cut = written(counted.where((F.col("goes") > 0) & (F.col("goes") >= RARE * (F.col("ends") + F.col("asks")))).select("tail").distinct(), "cut")
    return lookup_join(tails.select("digest", "tail"), cut, "tail").select("digest").distinct()


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, why) of each document whose text is cut: 'prefix' (the whole text begins a longer one),
    'continued' (its last words are a strict prefix of what stands elsewhere), else 'unfinished' (by form only).

    Null, empty and blank texts are no case. Copies are judged once and all come out. A strict prefix of a
    longer text counts unless it ends with its sentence.
    """
    keyed = texts_of(documents).where(F.col("text").rlike(r"(?U)[^\s\p{Z}\p{C}]")).withColumn("digest", F.unhex(F.md5(F.col("text"))))
    members = written(keyed, "documents")
    texts = written(members.groupBy("digest").agg(F.min("text").alias("text")), "texts")
    judged = written(texts.mapInArrow(_ends, JUDGED), "judged")
    seam = F.col("seam")
    # the seam's last character follows the text elsewhere; at a line's end the ending itself decides
    inside = seam.rlike(r"(?U)[\w,;:=+*/({\[$\\%-] ?[^\n\r]\z") | seam.rlike(r"(?U)\d\.\d\z")
    found = {"prefix": strict_prefixes(texts).where(inside), "continued": continued(judged), "unfinished": judged.where("unfinished")}
    reasons = None
    for place, why in enumerate(REASONS):
        mine = found[why].select("digest", F.lit(place).alias("place"))
        reasons = mine if reasons is None else reasons.unionByName(mine)
    first = written(reasons.groupBy("digest").agg(F.min("place").alias("place")), "reasons")
    release(texts)
    names = F.array(*[F.lit(w) for w in REASONS])
    return lookup_join(members.select("doc_id", "digest"), first, "digest").select("doc_id", F.get(names, F.col("place")).alias("why"))
