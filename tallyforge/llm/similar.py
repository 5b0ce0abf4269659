"""Pairs of texts whose word-run sets reach a Jaccard similarity, found without loss.

Three lossless steps. (1) Two sets of similarity t share one of the first n - ceil(t n) + 1 members of each
under any one order; members are ordered rare first, by a table of hashed counts over all texts, so the
blocks of texts that share such a member are small. (2) In each block, a binary trie over 128 parity bits
per set is joined with itself: node pairs go down together, differing bits add up, and a pair of nodes is
dropped once they exceed the error budget, (1-t)/(1+t) of both sizes, which no linked pair can exceed.
(3) What is left is compared exactly. A trie over all texts at once could not prune: at 0.6 the budget is a
quarter of both sizes, far more bits than the levels on which a trie branches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..plans.durable import release, written
from .components import components

RUN = 3
SIMILARITY = (3, 5)
BITS = 128
BLOCK = 1024
RANGES = 16


def plain_words(text: Column) -> Column:
    """The words of a text (maximal runs of letters and digits, lower case), one blank between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def _runs(words: pa.Array, salt: np.ndarray | None = None, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of `run` words of each text, ordered by row, then hash."""
    import xxhash

    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    lists = pc.split_pattern(pc.fill_null(words, ""), " ")
    flat = lists.flatten().dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    hashed = known[flat.indices.to_numpy(zero_copy_only=False)]
    lengths = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - run + 1, 0)
    row = np.repeat(np.arange(len(lengths)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    value = np.zeros(len(at), np.uint64)
    for k in range(run):
        value = value * np.uint64(0x9E3779B97F4A7C15) + hashed[at + k]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
    if salt is not None:
        value ^= (salt[row].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def _small(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some 4 MB of text, so that long texts don't fill a worker's memory."""
    for batch in batches:
        texts = names or [f.name for f in batch.schema if pa.types.is_string(f.type)]
        size = sum((np.asarray(pc.fill_null(pc.binary_length(batch.column(n)), 0)).astype(np.int64) for n in texts), np.zeros(batch.num_rows, np.int64))
        part = np.cumsum(size) // (4 << 20)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if batch.num_rows else []
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


def _salt(batch: pa.RecordBatch, apart: bool) -> np.ndarray | None:
    return batch.column("side").to_numpy(zero_copy_only=False) if apart else None


def _counter(bits: int, apart: bool, only=None):
    """Per task: how often each hashed bucket occurs, as gaps and counts by range of buckets; with `only`, a
    table of `count_table` that was broadcast, of runs whose bucket it knows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if only is None else unpacked(only)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            at = np.concatenate([a for a, _ in held])
            n = np.concatenate([b for _, b in held])
            at, where = np.unique(at, return_inverse=True)
            n = np.bincount(where, weights=n).astype(np.uint32)
            out: tuple[list, list, list] = ([], [], [])
            part = at >> np.uint64(bits - 4)
            for k in range(RANGES):
                mine = at[part == k] - np.uint64(k << (bits - 4))
                if len(mine):
                    gaps = np.diff(mine, prepend=np.uint64(0)).astype(np.uint32)
                    out[0].append(k)
                    out[1].append(zlib.compress(gaps.tobytes(), 1))
                    out[2].append(zlib.compress(n[part == k].tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["k", "gaps", "n"])

        size = 0
        for batch in _small(batches):
            if "words" in batch.schema.names:
                _, value = _runs(batch.column("words"), _salt(batch, apart))
            else:
                value = np.asarray(batch.column("block")).view(np.uint64)
            if known is not None:
                value = value[known[bucket(value, bits)] > 0]
            if len(value):
                held.append(np.unique(value >> np.uint64(64 - bits), return_counts=True))
                size += len(held[-1][0])
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return count


def _merger(bits: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, gaps, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                table = total.setdefault(k, np.zeros(1 << (bits - 4), np.uint32))
                at = np.cumsum(np.frombuffer(zlib.decompress(gaps), np.uint32).astype(np.int64))
                table[at] += np.frombuffer(zlib.decompress(n), np.uint32)
        for k, table in total.items():
            code = np.zeros(len(table), np.uint8)
            some = table > 0
            code[some] = np.minimum(255, np.ceil(7.9 * np.log2(table[some].astype(float))) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(code.tobytes(), 1)], pa.binary())], ["k", "codes"])

    return merge


def bucket(value: np.ndarray, bits: int) -> np.ndarray:
    return (value >> np.uint64(64 - bits)).astype(np.int64)


def unpacked(table) -> np.ndarray:
    """A broadcast table of `count_table` in a worker."""
    return np.frombuffer(zlib.decompress(table.value), np.uint8)


def table_bits(runs: int, room: int = 2) -> int:
    """Bits of a table with `room` buckets a run; 2^26 buckets at most."""
    return min(26, max(16, int(room * runs).bit_length()))


def total_runs(sets: DataFrame) -> int:
    return sets.agg(F.sum(F.greatest(F.size(F.split("words", " ")) - RUN + 1, F.lit(0)))).first()[0] or 0


def count_table(sets: DataFrame, apart: bool, bits: int, only=None) -> np.ndarray:
    """One byte per hashed bucket: 0 none, 1 exactly one run of all texts, else the count's logarithm.

    `sets` has texts (words, side) or runs (block). 2^bits bytes, 64 MB at most whatever the number of texts,
    so the driver and a broadcast can hold it.
    """
    columns = ["words", "side"] if "words" in sets.columns else ["block"]
    parts = sets.select(*columns).mapInArrow(_counter(bits, apart, only), "k int, gaps binary, n binary")
    merged = parts.repartition(RANGES, "k").mapInArrow(_merger(bits), "k int, codes binary")
    table = np.zeros(1 << bits, np.uint8)
    width = 1 << (bits - 4)
    for k, codes in merged.collect():
        table[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(bytes(codes)), np.uint8)
    return table


def _entries(table, bits: int, apart: bool, similarity: tuple[int, int]):
    p, q = similarity

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = unpacked(table)
        for batch in _small(batches, "words"):
            m = batch.num_rows
            row, value = _runs(batch.column("words"), _salt(batch, apart))
            if not len(row):
                continue
            parity = np.bincount(row * BITS + (value & np.uint64(BITS - 1)).astype(np.int64), minlength=m * BITS) & 1
            words = np.packbits(parity.astype(np.uint8).reshape(m, BITS), axis=1).view(">u8").astype(np.uint64).view(np.int64)
            code = codes[bucket(value, bits)]
            order = np.lexsort((value, code, row))
            row, value, code = row[order], value[order], code[order]
            n = np.bincount(row, minlength=m)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keep = (place < (n - -(-p * n // q) + 1)[row]) & (code != 1)
            row, value, code = row[keep], value[keep], code[keep]
            arrays = [value.view(np.int64), np.zeros(len(row), np.int32), np.asarray(batch.column("rid"))[row], n[row].astype(np.int32)]
            arrays += [words[row, 0], words[row, 1], code.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["block", "grp", "rid", "n", "w0", "w1", "code"])

    return emit


def trie_pairs(block, grp, n, w, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs within the error budget: tries of all blocks joined with themselves, level by level.

    Rows of a block with both groups pair across the groups only. Rows must be ordered by block, group and
    bits: a trie node is then a range of rows.
    """
    p, q = similarity
    edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (grp[1:] != grp[:-1]), True])
    low, high = edge[:-1], edge[1:]
    first = np.r_[True, block[low[1:]] != block[low[:-1]]]
    last = np.r_[first[1:], True]
    alone = np.flatnonzero(first & last)
    paired = np.flatnonzero(first & ~last)  # the other group's range comes next
    a0 = np.r_[low[alone], low[paired]]
    a1 = np.r_[high[alone], high[paired]]
    b0 = np.r_[low[alone], low[paired + 1]]
    b1 = np.r_[high[alone], high[paired + 1]]
    same = np.r_[np.ones(len(alone), bool), np.zeros(len(paired), bool)]
    # the most that any pair of the block may differ in
    most = np.maximum.reduceat(n, low) if len(low) else n
    top = most[np.r_[alone, paired]]
    top[len(alone) :] = np.maximum(top[len(alone) :], most[paired + 1])
    budget = 2 * top * (q - p) // (q + p)
    diff = np.zeros(len(a0), np.int64)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for level in range(BITS + 1):
        # pairs of small nodes are opened into their rows
        small = ((a1 - a0) * (b1 - b0) <= 24) | (level == BITS)
        if small.any():
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            wide = t1 - t0
            count = (s1 - s0) * wide
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide = np.repeat(wide, count)
            x, y = np.repeat(s0, count) + at // wide, np.repeat(t0, count) + at % wide
            keep = ~np.repeat(same[small], count) | (x < y)
            x, y = x[keep], y[keep]
            far = np.bitwise_count(w[x, 0] ^ w[y, 0]).astype(np.int64) + np.bitwise_count(w[x, 1] ^ w[y, 1])
            near = (far * (q + p) <= (q - p) * (n[x] + n[y])) & (p * np.maximum(n[x], n[y]) <= q * np.minimum(n[x], n[y]))
            left.append(x[near])
            right.append(y[near])
            go = ~small
            a0, a1, b0, b1, same, diff, budget = (z[go] for z in (a0, a1, b0, b1, same, diff, budget))
        if level == BITS or not len(a0):
            break
        bit = (w[:, level // 64] >> np.uint64(63 - level % 64)) & np.uint64(1)
        ones = np.r_[0, np.cumsum(bit.astype(np.int64))]
        am = a1 - (ones[a1] - ones[a0])
        bm = b1 - (ones[b1] - ones[b0])
        cross = ~same
        quads = [
            (a0, am, b0, bm, same, diff, np.ones(len(a0), bool)),
            (am, a1, bm, b1, same, diff, np.ones(len(a0), bool)),
            (a0, am, bm, b1, np.zeros(len(a0), bool), diff + 1, np.ones(len(a0), bool)),
            (am, a1, b0, bm, np.zeros(len(a0), bool), diff + 1, cross),
        ]
        keeps = [(c & (s1 > s0) & (t1 > t0) & (d <= budget)) for s0, s1, t0, t1, _, d, c in quads]
        picked = [tuple(z[k] for z in quad[:6]) + (budget[k],) for quad, k in zip(quads, keeps, strict=True)]
        a0, a1, b0, b1, same, diff, budget = (np.concatenate(z) for z in zip(*picked, strict=True))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _joiner(similarity: tuple[int, int]):
    """Blocks in, candidate pairs out. Batches come ordered by block; whole blocks are worked on together."""

    def search(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        block, grp, rid, n, w0, w1 = cols
        w = np.stack([w0.view(np.uint64), w1.view(np.uint64)], axis=1)
        order = np.lexsort((w[:, 1], w[:, 0], grp, block))
        block, grp, rid, n, w = block[order], grp[order], rid[order], n[order].astype(np.int64), w[order]
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        size = np.diff(edge)
        # runs of blocks with a bounded number of row pairs
        part = (np.cumsum(size.astype(np.int64) ** 2) - 1) // 4_000_000
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            lo, hi = edge[mine[0]], edge[mine[-1] + 1]
            x, y = trie_pairs(block[lo:hi], grp[lo:hi], n[lo:hi], w[lo:hi], similarity)
            a, b = rid[lo:hi][x], rid[lo:hi][y]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(6)]
            held.append(cols)
            size += batch.num_rows
            if size >= 60_000:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                if cut:
                    yield from search([c[:cut] for c in cols])
                held, size = [[c[cut:] for c in cols]], size - cut
        if size:
            yield from search([np.concatenate(c) for c in zip(*held, strict=True)])

    return join


def _split_hot(entries: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame | None]:
    """(blocks, links) of `entries`, a written table: blocks beyond BLOCK rows as pairs of chunks, so that no
    task gets a large one.

    Such a block is first compared with its least row. Rows that are tied through these links need no
    comparison with each other, so only the rows outside the block's largest tied group are compared, with
    all. A third of all rows as near-copies of one text then costs in proportion to them.
    """
    # 2^(code / 7.9) bounds the count of a member from above, so only these blocks can be too large
    maybe = entries.where(F.pow(F.lit(2.0), F.col("code") / 7.9) > BLOCK)
    large = written(maybe.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK), "large")
    n_large = large.count()
    entries = entries.select("block", "grp", "rid", "n", "w0", "w1")
    if not n_large:
        return entries, None
    sent = F.broadcast if n_large <= 100_000 else (lambda x: x)
    usual = entries.join(sent(large.select("block")), "block", "left_anti")
    hot = entries.join(sent(large), "block")
    columns = ["n", "w0", "w1"]
    hot = written(hot, "hot")
    leaders = hot.groupBy("block").agg(F.min("rid").alias("a"))
    stars = written(hot.select("block", F.col("rid").alias("b")).join(sent(leaders), "block").where("a <> b").select("a", "b").distinct(), "stars")
    links = _verified(stars, sets, similarity)
    tied = components(links.select("a", "b")).select(F.col("node").alias("rid"), F.col("component").alias("label"))
    marked = written(hot.join(tied, "rid", "left"), "marked")
    groups = marked.where("label is not null").groupBy("block", "label").agg(F.count(F.lit(1)).alias("m"))
    main = groups.groupBy("block").agg(F.max(F.struct("m", "label")).alias("main"))
    plan = large.join(main, "block", "left").select(
        "block",
        F.col("main.label").alias("_main"),
        F.ceil((F.col("_n") - F.coalesce("main.m", F.lit(0))) / BLOCK).cast("int").alias("_open"),
        F.ceil(F.coalesce("main.m", F.lit(0)) / BLOCK).cast("int").alias("_tied"),
    )
    # a block without open rows is settled by its star
    placed = marked.join(sent(plan), "block").where("_open > 0").withColumn("_is", F.coalesce(F.col("label") == F.col("_main"), F.lit(False)))
    chunk = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    zero, one = F.lit(0), F.lit(1)
    opened = placed.where("not _is").withColumn("_c", chunk("_open"))
    among = opened.withColumn("_k", each("_open"))
    among = among.select(F.xxhash64("block", zero, F.least("_c", "_k"), F.greatest("_c", "_k")).alias("block"), (F.col("_c") > F.col("_k")).cast("int").alias("grp"), "rid", *columns)
    out = opened.where("_tied > 0").withColumn("_k", each("_tied")).select(F.xxhash64("block", one, "_c", "_k").alias("block"), zero.alias("grp"), "rid", *columns)
    into = placed.where("_is").withColumn("_c", chunk("_tied")).withColumn("_k", each("_open"))
    into = into.select(F.xxhash64("block", one, "_k", "_c").alias("block"), one.alias("grp"), "rid", *columns)
    return usual.unionByName(among).unionByName(out).unionByName(into), links


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int], contained: tuple[int, int] | None = None) -> DataFrame:
    """Those of `pairs` (a, b), a written table, that reach the similarity, or of which `contained` of b's runs
    stand in a, with their counts; written."""
    # only texts that some pair names travel; both joins on an id share its partitioning
    named = lambda k: sets.join(pairs.select(F.col(k).alias("rid")).distinct(), "rid", "left_semi").select(F.col("rid").alias(k), F.col("words").alias(f"words_{k}"))
    left, right = named("a"), named("b")
    shown = lookup_join(pairs, left, "a").join(right, "b").select("a", "b", "words_a", "words_b")
    return written(shown.mapInArrow(_checker(similarity, contained), "a bigint, b bigint, shared bigint, runs_a bigint, runs_b bigint"), "linked")


def _checker(similarity: tuple[int, int], contained: tuple[int, int] | None):
    p, q = similarity

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, "words_a", "words_b"):
            ra, va = _runs(batch.column("words_a"))
            rb, vb = _runs(batch.column("words_b"))
            m = batch.num_rows
            na, nb = np.bincount(ra, minlength=m), np.bincount(rb, minlength=m)
            row, value = np.r_[ra, rb], np.r_[va, vb]
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
            both = np.bincount(row[1:][twice], minlength=m)
            keep = q * both >= p * (na + nb - both)
            if contained:
                keep |= contained[1] * both >= contained[0] * nb
            keep &= both > 0
            cols = [np.asarray(batch.column("a"))[keep], np.asarray(batch.column("b"))[keep], both[keep], na[keep], nb[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["a", "b", "shared", "runs_a", "runs_b"])

    return check


def similar_pairs(sets: DataFrame, apart: bool = False, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(a, b, shared, runs_a, runs_b) of linked pairs of `sets` (rid, words, side); written tables.

    Linked pairs with a < b, of the same side where `apart`: all of them but for those in blocks beyond BLOCK
    rows whose both texts are already tied through other pairs, so the components are those of all linked
    pairs. `sets` must be a table that gives the same rows each time it is read. Texts of fewer than RUN words
    are linked to nothing here.
    """
    spark = sets.sparkSession
    bits = table_bits(total_runs(sets))
    codes = count_table(sets, apart, bits)
    table = spark.sparkContext.broadcast(zlib.compress(codes.tobytes(), 1))
    columns = "block bigint, grp int, rid bigint, n int, w0 bigint, w1 bigint, code int"
    entries = sets.select("rid", "words", "side").mapInArrow(_entries(table, bits, apart, similarity), columns)
    blocks, first = entries, None
    if 2.0 ** (int(codes.max()) / 7.9) > BLOCK:  # a code bounds the rows of a block from above
        entries = written(entries, "entries")
        blocks, first = _split_hot(entries, sets, similarity)
    ordered = blocks.select("block", "grp", "rid", "n", "w0", "w1").repartition("block").sortWithinPartitions("block")
    candidates = written(ordered.mapInArrow(_joiner(similarity), "a bigint, b bigint").distinct(), "candidates")
    release(entries)
    linked = _verified(candidates, sets, similarity)
    release(candidates)
    return linked if first is None else linked.unionByName(first)


# --- held-out runs, scanned for in training texts ----------------------------------------------------

#: Rows of a run in training texts beyond which they are searched in parts.
PART = 1 << 16


def _held_entries(table, bits: int, least: tuple[int, int]):
    """Per held-out text the first n - ceil(least n) + 1 of its runs in the order of their number in training
    texts, without those that stand in none."""
    p, q = least

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = unpacked(table)
        for batch in _small(batches, "words"):
            row, value = _runs(batch.column("words"))
            code = codes[bucket(value, bits)]
            order = np.lexsort((value, code, row))
            row, value, code = row[order], value[order], code[order]
            n = np.bincount(row, minlength=batch.num_rows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keep = (place < (n - -(-p * n // q) + 1)[row]) & (code > 0)
            yield _emitted(batch, row[keep], value[keep], n, code[keep], "b")

    return emit


def _train_entries(marks, mark_bits: int, table, bits: int):
    """Per training text those of its runs that a held-out text asks for."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, codes = unpacked(marks), unpacked(table)
        for batch in _small(batches, "words"):
            row, value = _runs(batch.column("words"))
            n = np.bincount(row, minlength=batch.num_rows)
            keep = wanted[bucket(value, mark_bits)] > 0
            yield _emitted(batch, row[keep], value[keep], n, codes[bucket(value[keep], bits)], "a")

    return emit


def _emitted(batch: pa.RecordBatch, row: np.ndarray, value: np.ndarray, n: np.ndarray, code: np.ndarray, name: str) -> pa.RecordBatch:
    arrays = [value.view(np.int64), np.asarray(batch.column("rid"))[row], n[row].astype(np.int32), code.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["block", name, f"n_{name}", "code"])


def contained_pairs(sets: DataFrame, similarity: tuple[int, int], contained: tuple[int, int]) -> DataFrame:
    """(a, b, shared, runs_a, runs_b) of all pairs of a training text a (side 0 of `sets`) and a held-out text b
    (side 1) that reach the similarity or of which `contained` of b's runs stand in a; a written table.

    Either way a holds the lesser of both shares of b's runs, so it holds one of b's n - ceil(share n) + 1
    rarest. Only these few hashes of a held-out text are partitioned. Training texts are scanned for them: a
    bit table of all asked hashes (64 MB at most) drops nearly all other runs before anything is shuffled, and
    what remains meets the held-out texts by hash. Runs with more than PART rows in training are met in parts.
    Rareness, by a table of hashed counts, only orders; no pair depends on it.
    """
    spark = sets.sparkSession
    held, train = sets.where("side = 1"), sets.where("side = 0")
    sent = lambda codes: spark.sparkContext.broadcast(zlib.compress(codes.tobytes(), 1))
    least = min(similarity, contained, key=lambda x: x[0] / x[1])
    bits = table_bits(total_runs(held), 8)
    known = sent(count_table(held, False, bits))
    table = sent(count_table(train, False, bits, known))
    known.unpersist()
    columns = "block bigint, {0} bigint, n_{0} int, code int"
    asked = written(held.select("rid", "words").mapInArrow(_held_entries(table, bits, least), columns.format("b")), "asked")
    mark_bits = table_bits(asked.count(), 8)
    marks = sent(count_table(asked, False, mark_bits))
    met = train.select("rid", "words").mapInArrow(_train_entries(marks, mark_bits, table, bits), columns.format("a"))
    parts = F.ceil(F.pow(F.lit(2.0), F.col("code") / 7.9) / PART).cast("int")
    asked = asked.select("block", "b", "n_b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = met.select("block", "a", "n_a", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    pairs = met.join(asked, ["block", "part"]).where(least[1] * F.col("n_a") >= least[0] * F.col("n_b")).select("a", "b").distinct()
    return _verified(written(pairs, "candidates"), sets, similarity, contained)
