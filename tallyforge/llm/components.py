"""Connected components of a graph too large for one machine, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..plans.durable import release, written


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's edges replaced by stars that connect the same nodes."""
    for frame in frames:
        up: dict = {}

        def top(x, up=up):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pd.DataFrame({"a": nodes, "b": [top(x) for x in nodes]}).astype(frame.dtypes.to_dict())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b), component being its smallest node.

    Self-loops name a node without linking it. Each round is two combinable aggregations; the edges are
    written to the shared folder after each, and the rounds end when a round changes nothing, so the
    result doesn't depend on a limit. Rounds grow with the logarithm of the longest path.
    """
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    named = edges.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    nodes = written(edges, "edges")
    links = nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(links.mapInPandas(_forest, named).where("a <> b").distinct(), "stars")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: each greater neighbour of a node is tied to the node's least neighbour; once stars have
        # formed, a component's edges share one node
        large = lookup_join(now.select(F.col("b").alias("u"), F.col("a").alias("v")), least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: what a node leads to is tied to the least of it
        down = written(large.where("a <> b").distinct(), "down")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup_join(down, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        release(now)
        release(down)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = nodes.select(F.col("a").alias("node")).unionByName(nodes.select(F.col("b").alias("node"))).distinct()
    found = written(roots.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component")), "components")
    release(nodes)
    release(now)
    return found


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
