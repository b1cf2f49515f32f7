"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` Gaussian directions.  Two vectors collide in a projection if
one lies in the window around the other, in the sorted order of that projection.  A pair is verified by
its cosine in double precision if it collides at least as often as a pair right at the threshold does
with a probability of ``RECALL``.

Vectors are put in the order of (label, cell, first projection) and cut into blocks of equal size, so
that no label is a hot key.  Two blocks that share a label meet in one task, unless their ranges are too far apart
in so many projections that no pair could reach the count.  A task sends out, for each of its vectors, how
many others it links with, and a spanning forest of the links, never the pairs.  Equal vectors are one
class from the start.  Without clusters in the data few blocks are too far apart, and the work of a
label grows with the square of its distinct vectors over the block size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import columns, running_totals, smallest_roots, to_batch
from planwell.llm.components import connected_components
from planwell.session import checkpoint, discard

PROJECTIONS = 48
#: half width of a window, in distances of a pair right at the threshold
WINDOW = 2.5
RECALL = 1 - 1e-9
BLOCK = 512
#: sign bits of the last projections that make up the cell a vector is sorted by
CELL_BITS = 6


def directions(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([20, dim])).standard_normal((dim, PROJECTIONS))


def needed_count(recall: float = RECALL, count: int = PROJECTIONS, window: float = WINDOW) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``: its difference in
    a projection is normal with its distance as deviation, so the collisions are binomial."""
    p = math.erf(window / math.sqrt(2))
    missed, total = 0.0, 0
    for total in range(count + 1):
        missed += math.comb(count, total) * p**total * (1 - p) ** (count - total)
        if missed > 1 - recall:
            break
    return total


def _prepare(schema: pa.Schema):
    """Unit vector, projections and digest of each valid row; a null key marks the others."""
    def run(it):
        for batch in it:
            ids, values, labels = batch.column(0), batch.column(1), batch.column(2)
            lists = values.to_pylist()
            keys, vecs, projs, cells, firsts = [], [], [], [], []
            for row, label, vec_id in zip(lists, labels.to_pylist(), ids.to_pylist()):
                x = np.array(row, np.float64) if row and label is not None and vec_id is not None and None not in row else None
                top = np.abs(x).max() if x is not None else 0
                if x is None or not np.isfinite(x).all() or top == 0:
                    keys.append(None), vecs.append(None), projs.append(None), cells.append(None), firsts.append(None)
                    continue
                unit = x / top
                unit = unit / math.sqrt(unit @ unit)
                proj = unit @ directions_of(len(x))
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
                vecs.append(x.tobytes()), projs.append(proj.tobytes()), firsts.append(float(proj[0]))
                cells.append(int(((proj[-CELL_BITS:] > 0) << np.arange(CELL_BITS)).sum()))
            yield to_batch({"vec_id": ids, "label": labels, "key": keys, "dim": [len(r) if r else 0 for r in lists],
                            "vec": vecs, "proj": projs, "cell": cells, "first": firsts}, schema)

    return run


_known: dict[int, np.ndarray] = {}


def directions_of(dim: int) -> np.ndarray:
    if dim not in _known:
        _known[dim] = directions(dim)
    return _known[dim]


def _meet(threshold: float, schema: pa.Schema):
    """One pair of blocks: counts collisions by windows in sorted projections, verifies, sums up."""
    need = needed_count()
    half = WINDOW * math.sqrt(2 * (1 - threshold))

    def run(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        at = table["block"].to_numpy()
        labels = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        group = np.stack([labels.astype(np.int64), table["dim"].to_numpy().astype(np.int64)])
        nodes, n = table["node"].combine_chunks(), table["n"].to_numpy()
        proj = np.frombuffer(b"".join(table["proj"].to_pylist()), np.float64).reshape(len(at), PROJECTIONS)
        vecs = table["vec"].to_pylist()
        left, right = [], []
        for label, dim in np.unique(group, axis=1).T:
            mine = (group[0] == label) & (group[1] == dim)
            a, b = np.flatnonzero(mine & (at == low)), np.flatnonzero(mine & (at == high))
            if not len(a) or not len(b):
                continue
            count = np.zeros((len(a), len(b)), np.uint8)
            for j in range(PROJECTIONS):
                order = np.argsort(proj[b, j], kind="stable")
                place = np.empty(len(b), np.int64)
                place[order] = np.arange(len(b))
                line = proj[b[order], j]
                begin = np.searchsorted(line, proj[a, j] - half, "left")[:, None]
                end = np.searchsorted(line, proj[a, j] + half, "right")[:, None]
                count += (place >= begin) & (place < end)
            x, y = np.nonzero(count >= need)
            x, y = a[x], b[y]
            if low == high:
                x, y = x[x < y], y[x < y]
            if len(x):
                used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                v = np.stack([np.frombuffer(vecs[i], np.float64) for i in used])
                v = v / np.abs(v).max(1, keepdims=True)
                norm = np.sqrt((v * v).sum(1))
                x_, y_ = back[: len(x)], back[len(x) :]
                for i in range(0, len(x), 100_000):
                    s = slice(i, i + 100_000)
                    linked = (v[x_[s]] * v[y_[s]]).sum(1) / (norm[x_[s]] * norm[y_[s]]) >= threshold
                    left.append(x[s][linked])
                    right.append(y[s][linked])
        x = np.concatenate(left) if left else np.empty(0, np.int64)
        y = np.concatenate(right) if right else np.empty(0, np.int64)
        links = np.bincount(x, weights=n[y], minlength=len(at)) + np.bincount(y, weights=n[x], minlength=len(at))
        used = np.flatnonzero(links)
        root = smallest_roots(len(at), x, y)
        return pa.table({"node": nodes.take(pa.array(used)), "root": nodes.take(pa.array(root[used])),
                         "links": pa.array(links[used].astype(np.int64))}, schema=schema)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows with equal labels link at a cosine of at least ``threshold``, in double precision.  Rows without
    id or label, and vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths do not link.  n_links counts rows, so repeated rows count one by
    one; component_id is the smallest vec_id that links reach, itself included.  Labels may
    be of any type that Spark writes as text; they are equal where their values are (0.0 and -0.0, too).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = columns(vectors, "vec_id", "embedding", "label")
    label = F.col("label")
    if isinstance(rows.schema["label"].dataType, (T.FloatType, T.DoubleType)):
        label = label + F.lit(0.0)  # one zero
    rows = rows.withColumn("label", label.cast("string"))
    id_type = rows.schema["vec_id"].dataType
    schema = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("label", T.StringType()), T.StructField("key", T.BinaryType()),
        T.StructField("dim", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("proj", T.BinaryType()),
        T.StructField("cell", T.LongType()), T.StructField("first", T.DoubleType())])
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    prepared = checkpoint(rows.mapInArrow(_prepare(to_arrow_schema(schema)), schema))
    node = F.concat(F.col("label").cast("binary"), F.lit(":").cast("binary"), F.col("key"))
    prepared = prepared.withColumn("node", node)
    classes = prepared.filter("key is not null").groupBy("node").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("label", "dim", "vec", "proj", "cell", "first")])
    placed = running_totals(classes.withColumn("one", F.lit(1).cast("long")), ["label", "dim", "cell", "first", "node"], ["one"])
    placed = checkpoint(placed.withColumn("block", F.floor(F.col("one_before") / BLOCK)).drop("one", "one_before", "cell", "first"))
    # which blocks meet: a common label, and ranges near enough in enough projections
    bounds_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("label", T.StringType()),
                                  T.StructField("dim", T.LongType())] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("lo", "hi")])

    def bounds(table: pa.Table) -> pa.Table:
        p = np.frombuffer(b"".join(table["proj"].to_pylist()), np.float64).reshape(-1, PROJECTIONS)
        return pa.table({"block": [table["block"][0].as_py()], "label": [table["label"][0].as_py()], "dim": [table["dim"][0].as_py()],
                         "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()]}, schema=to_arrow_schema(bounds_schema))

    ranges = checkpoint(placed.select("block", "label", "dim", "proj").groupBy("block", "label", "dim").applyInArrow(bounds, bounds_schema))
    half, need = WINDOW * math.sqrt(2 * (1 - threshold)), needed_count()
    other = ranges.select(F.col("block").alias("other"), "label", "dim", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = ranges.join(other, ["label", "dim"]).filter("block <= other")
    near = F.expr(f"size(filter(sequence(0, {PROJECTIONS - 1}), i -> lo[i] - hi2[i] <= {half!r} and lo2[i] - hi[i] <= {half!r}))")
    meet = meet.filter(near >= need).select(F.col("block").alias("low"), F.col("other").alias("high")).distinct()
    deal = meet.select(F.col("low").alias("block"), "low", "high").unionByName(
        meet.filter("low <> high").select(F.col("high").alias("block"), "low", "high"))
    found_schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("root", T.BinaryType()),
                                 T.StructField("links", T.LongType())])
    sides = placed.join(deal, "block").select("low", "high", "block", "node", "label", "dim", "n", "proj", "vec")
    found = checkpoint(sides.groupBy("low", "high").applyInArrow(_meet(threshold, to_arrow_schema(found_schema)), found_schema))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = placed.select("node", "rep", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = checkpoint(named.join(smallest, "root").join(counts, "node", "left").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    discard(found, ranges)
    out = prepared.select("vec_id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
