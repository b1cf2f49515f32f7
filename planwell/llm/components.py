"""Connected components: spanning forests of blocks of edges, then alternating large-star and small-star rounds over
written edge tables where there is more than one block."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import to_batch
from planwell.session import checkpoint, discard

#: edges that a task ties together before the rounds, and at most remembers at a time
EDGES = 200_000

#: node types that Python orders as Spark does
PLAIN = (T.BinaryType(), T.StringType(), T.LongType(), T.IntegerType())


def _forest(limit: int, schema: pa.Schema):
    """(u, v) edges to an equivalent forest: each node of a block of at most ``limit`` edges with the smallest node that
    the block's edges reach."""
    def stars(root: dict) -> pa.RecordBatch:
        nodes = [x for x in root if root[x] != x]
        return to_batch({"u": nodes, "v": [_top(root, x) for x in nodes]}, schema)

    def run(it):
        root, seen = {}, 0
        for batch in it:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seen == limit:
                    yield stars(root)
                    root, seen = {}, 0
                seen += 1
                x, y = _top(root, u), _top(root, v)
                root[max(x, y)] = root[min(x, y)] = min(x, y)
        yield stars(root)

    return run


def _top(root: dict, x):
    path = []
    while (up := root.setdefault(x, x)) != x:
        path.append(x)
        x = up
    for y in path:
        root[y] = x
    return x


def connected_components(edges: DataFrame, max_rounds: int = 60, block: int = EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node of its component.

    Node values may have any type that can be ordered; loops and repeats do no harm.  Each task first ties its edges
    together, ``block`` of them at a time; edges that make one block are done then.  In the rounds that follow
    otherwise, a hub is reduced by partial aggregation to one row of a written table and met again in a join: with
    nothing but the two shuffles in the join's stage, Spark can split the hub's side, so that no task holds all
    neighbours of a node.  Each round is written and replaces the one before.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if e.schema["u"].dataType in PLAIN:
        blocks = -(-e.count() // block)
        tied = checkpoint(e.coalesce(max(1, blocks)).mapInArrow(_forest(block, to_arrow_schema(e.schema)), e.schema))
        discard(e)
        e = tied
        if blocks <= 1:
            return _stars(e)
    whole = checkpoint(e.distinct())
    discard(e)
    e, state = whole, None
    for _ in range(max_rounds):
        # large star: a node's larger neighbours move to the smallest of it and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpoint(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours move to the smallest of these
        discard(least)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        new = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        new = checkpoint(new)
        discard(e, large, least)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _stars(e)


def _stars(e: DataFrame) -> DataFrame:
    """(node, root) of edges (u, v) from every other node to the smallest of its component."""
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
