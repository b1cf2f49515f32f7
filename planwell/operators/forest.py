"""Random forest of two classes grown from counts, a level of all trees in one pass over the rows (L4).

It grows the trees that ``RandomForestClassifier`` defines (Poisson bags of all rows, a random subset of the features at each
node, weighted Gini, categories ordered by their weight of class 1, thresholds between values, leaves of equal prediction merged)
and hands them over as its models.  What differs is the work:

* rows are stored once as blocks of bin numbers, column after column (``pack``);
* bags are drawn again from a seed of (tree, block, chunk) in each pass, so nothing is kept of a row and tree;
* a task counts (node, feature, bin, class) of its blocks for all trees with a few array operations a chunk.  Its output is one
  array of counts a tree, whatever the number of rows; these are added up by tree, where the splits are chosen;
* the first six levels are looked up at once: per bin a word has a bit for each node that its rows can still reach.
"""

from __future__ import annotations

import json
import pickle
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.util import DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwell.session import checkpoint, discard, ensure_checkpoint_dir, shuffles_removed

#: rows of a stored block, and rows that are counted at once (their arrays stay in a core's cache)
BLOCK, CHUNK = 1 << 17, 1 << 16
#: rows that one task counts, where the cluster's slots are fewer
TASK_ROWS = 16_000_000
#: counts that a task holds at once (8 bytes each); trees of one level are counted in groups of at most so many
CELLS = 12_000_000
#: levels that are looked up in one word, and entries of one lookup table
WORD_LEVELS, TABLE = 6, 4096
#: counts of a row in a bag: Poisson(1) in steps of 1/65536
POISSON = np.repeat(np.arange(10, dtype=np.uint8), np.diff(np.concatenate([[0], np.rint(65536 * np.cumsum(
    np.exp(-1) / np.cumprod(np.maximum(np.arange(9), 1)))).astype(int), [65536]])))


#: rows whose draw is smaller are not in the bag
NOT_IN_BAG = int((POISSON == 0).sum())


def thresholds(counts: list[tuple[float, float]], most: int) -> list[float]:
    """Split points of a continuous feature from its (value, weight): between all values, or ``most`` of about equal weight."""
    counts = sorted(counts)
    middle = [(a[0] + b[0]) / 2 for a, b in zip(counts, counts[1:])]
    if len(middle) <= most:
        return middle
    out, seen, stride = [], counts[0][1], sum(w for _, w in counts) / (most + 1)
    target = stride
    for (_, w), m in zip(counts[1:], middle):
        if abs(seen - target) < abs(seen + w - target):
            out.append(m)
            target += stride
        seen += w
    return out


def code_type(bins: list[int]):
    return np.uint8 if max(bins) <= 1 << 8 else np.uint16 if max(bins) <= 1 << 16 else np.uint32


def pack(numbers: DataFrame, columns: list[str], label: str, bins: list[int], cuts: dict[int, list[float]], tasks: int) -> DataFrame:
    """``numbers`` as a stored table of blocks (id, rows, codes): bin numbers of all columns and the label, column-major.

    ``cuts`` has the split points of continuous columns; other columns are numbers of categories already.
    """
    kind, size, names = code_type(bins), BLOCK, [*columns, label]

    def blocks(batches):
        held, rows, made = [], 0, 0
        part = TaskContext.get().partitionId()

        def block(parts):
            codes = np.concatenate(parts, axis=1)
            return pa.RecordBatch.from_pydict({"id": pa.array([part * 1_000_000 + made], pa.int64()), "rows": pa.array([codes.shape[1]], pa.int64()),
                                               "codes": pa.array([codes.tobytes()], pa.binary())})

        for b in batches:
            if any(b.column(n).null_count for n in names):
                raise ValueError("a null among the features or labels")
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
            codes = np.stack([(np.searchsorted(cuts[i], c, side="left") if i in cuts else c).astype(kind) for i, c in enumerate(cols)])
            while codes.shape[1]:
                take = min(size - rows, codes.shape[1])
                held.append(codes[:, :take])
                rows, codes = rows + take, codes[:, take:]
                if rows == size:
                    yield block(held)
                    held, rows, made = [], 0, made + 1
        if rows:
            yield block(held)

    table = numbers.select(*names).mapInArrow(blocks, "id long, rows long, codes binary").repartition(tasks)
    with shuffles_removed(numbers.sparkSession):
        return checkpoint(table)


@dataclass
class Tree:
    """One tree: by level the arrays over its 2^level places.  A place that is no node, or a leaf, has the feature -1;
    rows of a leaf go to the left."""

    seed: tuple
    stats: list = field(default_factory=list)  # per level (places, 2): rows of the bag by class
    feature: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    left: list = field(default_factory=list)  # per level a list of arrays over bins, None where no split is
    open: np.ndarray = None  # places of the level that is grown now


def subsets(tree: Tree, level: int, features: int, take: int) -> np.ndarray:
    """(open nodes, take) candidate features, drawn anew at each node."""
    rng = np.random.default_rng([*tree.seed, 1, level])
    return np.sort(rng.random((len(tree.open), features)).argsort(axis=1)[:, :take], axis=1)


def words(tree: Tree, bins: list[int], levels: int) -> list[np.ndarray]:
    """Per feature and bin a word of the places at ``levels`` that the bin's rows can reach."""
    full = np.uint64((1 << (1 << levels)) - 1)
    out = [np.full(b, full, dtype=np.uint64) for b in bins]
    for j in range(levels):
        half = 1 << (levels - j - 1)
        for p in range(1 << j):
            f = tree.feature[j][p]
            low = ((1 << half) - 1) << (2 * p * half)
            if f < 0:  # rows of a leaf, and no others, come here: they are at its leftmost place
                out[0] &= np.uint64(int(full) & ~(low << half))
            else:
                go = np.where(tree.left[j][p], np.uint64(int(full) & ~(low << half)), np.uint64(int(full) & ~low))
                out[f] &= go
    return out


def table_groups(bins: list[int]) -> list[list[int]]:
    """Features whose bins together number one lookup table."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
        fits = [g for g in range(len(groups)) if sizes[g] * bins[f] <= TABLE]
        if fits:
            g = max(fits, key=lambda g: sizes[g])
            groups[g].append(f)
            sizes[g] *= bins[f]
        else:
            groups.append([f])
            sizes.append(bins[f])
    return groups


def pair(feature: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where the rows of a feature lie in a chunk, and the first of its cells elsewhere, in one number: one lookup finds both."""
    return (feature * CHUNK) | (start << 32)


@dataclass
class Plan:
    """What a task needs to count one level of one tree."""

    seed: tuple
    words: list  # as of ``words``, for the first levels
    steps: list  # per further level (``pair`` of the feature's rows and its bins by place, 1 for a bin that goes right)
    candidates: np.ndarray  # (take, places): ``pair`` of rows and counts; places without an open node share the cells after the last
    cells: list  # cells per candidate
    bag: bool  # whether rows are drawn; else each counts once


def plan(tree: Tree, level: int, bins: list[int], take: int, bag: bool = True) -> tuple[Plan, np.ndarray]:
    sizes, places = np.array(bins, dtype=np.int64), 1 << level
    chosen = subsets(tree, level, len(bins), take)
    feature = np.zeros((take, places), dtype=np.int64)
    start = np.zeros((take, places), dtype=np.int64)
    cells = []
    for j in range(take):
        ends = np.cumsum(2 * sizes[chosen[:, j]])
        start[j] = ends[-1]
        start[j, tree.open] = ends - 2 * sizes[chosen[:, j]]
        feature[j, tree.open] = chosen[:, j]
        cells.append(int(ends[-1]))
    steps = []
    for j in range(WORD_LEVELS, level):
        at = np.maximum(tree.feature[j], 0).astype(np.int64)
        begin = 2 * (np.cumsum(sizes[at]) - sizes[at])
        right = np.concatenate([np.zeros(bins[at[p]], np.uint8) if tree.left[j][p] is None else (~tree.left[j][p]).astype(np.uint8)
                                for p in range(1 << j)])
        steps.append((pair(at, begin), right.repeat(2)))
    top = words(tree, bins, min(level, WORD_LEVELS)) if level else []
    return Plan(tree.seed, top, steps, pair(feature, start), cells, bag), chosen


def places_of(p: Plan, tables: list[np.ndarray], code: list[np.ndarray], idx: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The place of each row of ``idx`` at the level of the plan."""
    if not tables:
        return np.zeros(len(idx), dtype=np.int64)
    word = tables[0].take(code[0])
    for t, c in zip(tables[1:], code[1:]):
        word &= t.take(c)
    # the only bit of a word is the exponent of its number
    place = word.take(idx).astype(np.float64).view(np.int64)
    place >>= 52
    place -= 1023
    for where, right in p.steps:
        at = cells_of(where.take(place), idx, flat)
        place <<= 1
        place += right.take(at)
    return place


def cells_of(where: np.ndarray, idx: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The cell of each row of ``idx``, with ``where`` its ``pair``."""
    x = where & 0xFFFFFFFF
    x += idx
    where >>= 32
    where += flat.take(x)
    return where


def count_blocks(batches, plans: list[Plan], bins: list[int], take: int):
    """Counts (tree, cells) of all blocks of one task."""
    groups, kind = table_groups(bins), code_type(bins)
    double = np.uint16 if max(bins) <= 1 << 15 else np.uint32
    tables = []
    for p in plans:
        one = []
        for g in groups if p.words else []:
            t = p.words[g[0]]
            for f in g[1:]:
                t = (t[:, None] & p.words[f][None, :]).ravel()
            one.append(t)
        tables.append(one)
    sums = [np.zeros(sum(p.cells)) for p in plans]
    spare = 2 * max(bins)  # rows of places without an open node are counted there and forgotten
    cell = np.zeros((len(bins), CHUNK), dtype=double)  # bin and class of each feature
    flat = cell.reshape(-1)
    for b in batches:
        for number, rows, blob in zip(b.column("id").to_pylist(), b.column("rows").to_pylist(), b.column("codes")):
            codes = np.frombuffer(blob.as_buffer(), dtype=kind).reshape(len(bins) + 1, rows)
            draws = [np.random.SFC64([*p.seed, 0, number]) for p in plans]
            for lo in range(0, rows, CHUNK):
                part = codes[:, lo:lo + CHUNK]
                n = part.shape[1]
                cell[:, :n] = part[:-1]
                cell[:, :n] *= 2
                cell[:, :n] += part[-1]
                code = []
                for g in groups:
                    c = part[g[0]].astype(np.intp)
                    for f in g[1:]:
                        c *= bins[f]
                        c += part[f]
                    code.append(c)
                for k, p in enumerate(plans):
                    if p.bag:
                        drawn = draws[k].random_raw(-(-n // 4)).view(np.uint16)[:n]
                        idx = np.flatnonzero(drawn >= NOT_IN_BAG)
                        w = POISSON.take(drawn.take(idx)).astype(np.float64)
                    else:
                        idx, w = np.arange(n), None
                    place = places_of(p, tables[k], code, idx, flat)
                    done = 0
                    for j in range(take):
                        key = cells_of(p.candidates[j].take(place), idx, flat)
                        sums[k][done:done + p.cells[j]] += np.bincount(key, weights=w, minlength=p.cells[j] + spare)[:p.cells[j]]
                        done += p.cells[j]
    for k, s in enumerate(sums):
        yield k, s


def gini(w: np.ndarray) -> np.ndarray:
    total = w.sum(axis=-1)
    safe = np.where(total > 0, total, 1.0)
    return np.where(total > 0, 1.0 - np.square(w / safe[..., None]).sum(axis=-1), 0.0)


def best_splits(cells: np.ndarray, chosen: np.ndarray, bins: list[int], ordered: set[int], weights: np.ndarray, min_leaf: int) -> dict:
    """Of each open node the best split over its candidates, from the counts of one tree."""
    nodes, take = chosen.shape
    sizes = 2 * np.array(bins, dtype=np.int64)
    ends = np.cumsum(sizes[chosen].T.reshape(-1)).reshape(take, nodes)
    begin = ends - sizes[chosen].T
    gain, feature = np.full(nodes, -np.inf), np.full(nodes, -1, dtype=np.int64)
    stats, left_stats, left = np.zeros((nodes, 2)), np.zeros((nodes, 2)), [None] * nodes
    # by rising feature, so that of equal gains the first feature stays
    for f, b in enumerate(bins):
        at, j = np.nonzero(chosen == f)
        if not len(at):
            continue
        c = cells[begin[j, at][:, None] + np.arange(2 * b)].reshape(len(at), b, 2)
        stats[at] = c.sum(axis=1)
        if b < 2:
            continue
        if f in ordered:
            order = np.broadcast_to(np.arange(b), (len(at), b))
        else:
            order = np.argsort(np.where(c.sum(axis=2) > 0, c[:, :, 1] * weights[1], np.inf), axis=1, kind="stable")
        lows = np.cumsum(np.take_along_axis(c, order[:, :, None], axis=1), axis=1)
        low, high = lows[:, :-1], lows[:, -1:] - lows[:, :-1]
        wl, wh, wt = low * weights, high * weights, lows[:, -1:] * weights
        total = np.maximum(wt.sum(axis=2), np.finfo(float).tiny)
        g = gini(wt) - wl.sum(axis=2) / total * gini(wl) - wh.sum(axis=2) / total * gini(wh)
        g = np.where((low.sum(axis=2) >= min_leaf) & (high.sum(axis=2) >= min_leaf), g, -np.inf)
        s = g.argmax(axis=1)
        rows = np.arange(len(at))
        better = g[rows, s] > gain[at]
        for r in np.flatnonzero(better):
            node = at[r]
            side = np.zeros(b, dtype=bool)
            side[order[r, :s[r] + 1]] = True
            gain[node], feature[node], left[node], left_stats[node] = g[r, s[r]], f, side, low[r, s[r]]
    feature[gain <= 0] = -1
    return {"stats": stats, "left_stats": left_stats, "feature": feature, "gain": gain,
            "left": [left[i] if feature[i] >= 0 else None for i in range(nodes)]}


def grow(spark: SparkSession, blocks: DataFrame, bins: list[int], ordered: set[int], weights: np.ndarray, seeds: list[tuple],
         depth: int, min_leaf: int, take: int, bag: bool = True) -> list[Tree]:
    """The trees of ``seeds``, from blocks of two classes.  ``ordered`` are the features whose bins keep their order."""
    trees = [Tree(s, open=np.array([0])) for s in seeds]
    slots = spark.sparkContext.defaultParallelism
    for level in range(depth):
        todo = [t for t in trees if len(t.open)]
        plans = [plan(t, level, bins, take, bag) for t in todo]
        lo = 0
        while lo < len(todo):
            hi, held = lo, 0
            while hi < len(todo) and (hi == lo or held + sum(plans[hi][0].cells) <= CELLS):
                held += sum(plans[hi][0].cells)
                hi += 1
            found = splits_of(spark, blocks, plans[lo:hi], bins, ordered, weights, min_leaf, take, min(hi - lo, 2 * slots))
            for t, (k, s) in zip(todo[lo:hi], sorted(found.items()), strict=True):
                settle(t, level, s, depth, weights)
            lo = hi
    return trees


def splits_of(spark, blocks, plans, bins, ordered, weights, min_leaf, take, parts) -> dict[int, dict]:
    """One pass over the blocks: the best splits of one level of some trees."""
    shared = spark.sparkContext.broadcast(plans)

    def counted(batches):
        for k, s in count_blocks(batches, [p for p, _ in shared.value], bins, take):
            yield pa.RecordBatch.from_pydict({"tree": pa.array([k], pa.int32()), "cells": pa.array([s.astype(np.uint32).tobytes()], pa.binary())})

    def chosen_splits(batches):
        def done(k, total):
            s = best_splits(total.astype(np.float64), shared.value[k][1], bins, ordered, weights, min_leaf)
            return pa.RecordBatch.from_pydict({"tree": pa.array([k], pa.int32()), "splits": pa.array([pickle.dumps(s)], pa.binary())})

        now, total = None, None
        for b in batches:  # in the order of trees
            for k, blob in zip(b.column("tree").to_pylist(), b.column("cells")):
                one = np.frombuffer(blob.as_buffer(), dtype=np.uint32)
                if k != now:
                    if now is not None:
                        yield done(now, total)
                    now, total = k, one.astype(np.int64)
                else:
                    total += one
        if now is not None:
            yield done(now, total)

    sums = blocks.select("id", "rows", "codes").mapInArrow(counted, "tree int, cells binary")
    sums = sums.repartition(parts, "tree").sortWithinPartitions("tree").mapInArrow(chosen_splits, "tree int, splits binary")
    try:
        with shuffles_removed(spark):
            return {r.tree: pickle.loads(r.splits) for r in sums.collect()}
    finally:
        shared.destroy()


def settle(t: Tree, level: int, s: dict, depth: int, weights: np.ndarray) -> None:
    """Take the splits of one level into the tree and open their children."""
    places = 1 << level
    feature, gain, left = np.full(places, -1, dtype=np.int64), np.zeros(places), [None] * places
    if level == 0:
        t.stats.append(s["stats"])
    below = np.zeros((2 * places, 2))
    opened = []
    for i, p in enumerate(t.open):
        if s["feature"][i] < 0:
            continue
        feature[p], gain[p], left[p] = s["feature"][i], s["gain"][i], s["left"][i]
        below[2 * p], below[2 * p + 1] = s["left_stats"][i], s["stats"][i] - s["left_stats"][i]
        # a child of one class is a leaf
        opened += [c for c in (2 * p, 2 * p + 1) if level + 1 < depth and (below[c] > 0).all()]
    t.feature.append(feature)
    t.gain.append(gain)
    t.left.append(left)
    t.stats.append(below)
    t.open = np.array(opened, dtype=np.int64)


def nodes(t: Tree, bins: list[int], cuts: dict[int, list[float]], weights: np.ndarray) -> list[tuple]:
    """The tree's nodes as Spark saves them, in preorder; two leaves of equal prediction are merged, as Spark does."""

    def leaf(stats):
        w = stats * weights
        return [float(np.argmax(w)), float(gini(w)), [float(x) for x in w], int(stats.sum())]

    def shape(level, p):
        if level >= len(t.feature) or t.feature[level][p] < 0:
            return (level, p, None, None)
        a, b = shape(level + 1, 2 * p), shape(level + 1, 2 * p + 1)
        if a[2] is None and b[2] is None and leaf(t.stats[level + 1][2 * p])[0] == leaf(t.stats[level + 1][2 * p + 1])[0]:
            return (level, p, None, None)
        return (level, p, a, b)

    out: list = []

    def write(node) -> int:
        level, p, a, b = node
        own = len(out)
        out.append(None)
        head = leaf(t.stats[level][p])
        if a is None:
            out[own] = (own, *head, -1.0, -1, -1, (-1, [], -1))
            return own
        f, side = int(t.feature[level][p]), t.left[level][p]
        split = (f, [float(cuts[f][int(side.sum()) - 1])], -1) if f in cuts else (f, [float(c) for c in np.flatnonzero(side)], bins[f])
        left, right = write(a), write(b)
        out[own] = (own, *head, float(t.gain[level][p]), left, right, split)
        return own

    write(shape(0, 0))
    return out


NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                  ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                  ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])
SPARK_CLASS = "org.apache.spark.ml.classification."
#: parameters of a forest that its trees do not have
FOREST_ONLY = {"bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate"}


def as_model(spark: SparkSession, estimator: RandomForestClassifier, trees: list[list[tuple]], features: int) -> RandomForestClassificationModel:
    """Trees (as of ``nodes``) as the model that ``estimator`` would have fitted: written in Spark's format and loaded."""
    def meta(name: str, uid: str, drop=frozenset(), **more) -> str:
        m = json.loads(DefaultParamsWriter._get_metadata_to_save(estimator, spark, extraMetadata=more))
        for k in ("paramMap", "defaultParamMap"):
            m[k] = {n: v for n, v in m[k].items() if n not in drop}
        return json.dumps(m | {"class": SPARK_CLASS + name, "uid": uid, "timestamp": int(time.time() * 1000)})

    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"

    def table(columns: dict) -> DataFrame:
        return spark.createDataFrame(pa.table(columns)).coalesce(1)

    head = meta("RandomForestClassificationModel", estimator.uid, numFeatures=features, numClasses=2, numTrees=len(trees))
    table({"value": pa.array([head])}).write.text(f"{path}/metadata")
    each = [meta("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", FOREST_ONLY) for _ in trees]
    table({"_1": pa.array(range(len(trees)), pa.int32()), "_2": pa.array(each), "_3": pa.array([1.0] * len(trees))}).write.parquet(f"{path}/treesMetadata")
    names = [f.name for f in NODE]
    rows = [dict(zip(names, (*n[:-1], dict(zip(("featureIndex", "leftCategoriesOrThreshold", "numCategories"), n[-1]))))) for t in trees for n in t]
    table({"treeID": pa.array([i for i, t in enumerate(trees) for _ in t], pa.int32()), "nodeData": pa.array(rows, NODE)}).write.parquet(f"{path}/data")
    model = RandomForestClassificationModel.load(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return model


#: models that are written and loaded at once
MODELS = 4
#: values of a continuous feature that are few enough for the driver
FEW_VALUES = 100_000


def fit(spark: SparkSession, numbers: DataFrame, columns: list[str], sizes: list[int], age: str, label: str,
        estimators: list[RandomForestClassifier]) -> list[RandomForestClassificationModel] | None:
    """The fitted ``estimators`` over ``numbers`` (category numbers, the continuous ``age``, the label 0 or 1), each row of
    class c with the weight n / (2 n_c).  None where this growth does not apply: not two classes, or too many ages."""
    counts = numbers.groupBy(label, age).agg(F.count(F.lit(1)).alias("n")).limit(FEW_VALUES + 1).collect()
    by_class = [sum(r.n for r in counts if r[label] == c) for c in (0, 1)]
    if len(counts) > FEW_VALUES or not all(by_class) or {r[label] for r in counts} != {0.0, 1.0}:
        return None
    if any(r[age] is None for r in counts):
        raise ValueError(f"a null in {age}: every row of the training part needs a value")
    weights = np.array([sum(by_class) / (2 * n) for n in by_class])
    first = estimators[0]
    ages: dict = {}
    for r in counts:
        ages[float(r[age])] = ages.get(float(r[age]), 0.0) + r.n * weights[int(r[label])]
    cuts = {len(columns): thresholds(list(ages.items()), first.getMaxBins() - 1)}
    bins = [*sizes, len(cuts[len(columns)]) + 1]
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(by_class) // TASK_ROWS))
    blocks = pack(numbers, [*columns, age], label, bins, cuts, tasks)
    try:
        take = {"sqrt": int(np.ceil(np.sqrt(len(bins)))), "all": len(bins)}[first.getFeatureSubsetStrategy()]
        seeds = [(e.getSeed(), i) for e in estimators for i in range(e.getNumTrees())]
        trees = grow(spark, blocks, bins, set(cuts), weights, seeds, first.getMaxDepth(), first.getMinInstancesPerNode(), take,
                     first.getBootstrap())
    finally:
        discard(blocks)
    ends = np.cumsum([e.getNumTrees() for e in estimators])
    with ThreadPoolExecutor(MODELS) as pool:  # small jobs of one task each
        return list(pool.map(lambda e, hi: as_model(spark, e, [nodes(t, bins, cuts, weights) for t in trees[hi - e.getNumTrees():hi]], len(bins)),
                             estimators, ends))


def saved_trees(spark: SparkSession, path: str, uids: list[str]) -> list[list[dict]]:
    """The nodes of all trees of a saved pipeline's forest parts, in the order of parts, trees and nodes."""
    out = []
    for uid in uids:
        rows = spark.read.parquet(f"{path}/stages/*_{uid}/data").toArrow()
        of_tree: dict = {}
        for t, n in zip(rows.column("treeID").to_pylist(), rows.column("nodeData").to_pylist()):
            of_tree.setdefault(t, []).append(n)
        out += [sorted(of_tree[t], key=lambda n: n["id"]) for t in sorted(of_tree)]
    return out


@dataclass
class Scorer:
    """Trees as arrays: per tree the next node by (node, bin) and the classes' shares by node."""

    bins: list
    cuts: dict  # split points of continuous features
    trees: list  # (``pair`` of the feature's rows and its bins by node, next node, shares (nodes, classes), depth)


def scorer(trees: list[list[dict]], sizes: list[int], continuous: set[int]) -> Scorer:
    cuts = {f: sorted({n["split"]["leftCategoriesOrThreshold"][0] for t in trees for n in t if n["split"]["featureIndex"] == f}) for f in continuous}
    bins = [len(cuts[f]) + 1 if f in cuts else b for f, b in enumerate(sizes)]
    rank = {f: {c: i for i, c in enumerate(cs)} for f, cs in cuts.items()}
    least = min(range(len(bins)), key=lambda f: bins[f])
    out = []
    for t in trees:
        feature, following, depth = [], [], [0] * len(t)
        for n in t:  # preorder: a parent stands before its children
            f, to = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"]
            if f < 0:  # a row stays at its leaf
                feature.append(least)
                following.append(np.full(bins[least], n["id"], dtype=np.int64))
                continue
            left = np.arange(bins[f]) <= rank[f][to[0]] if f in cuts else np.isin(np.arange(bins[f]), np.array(to, dtype=np.int64))
            feature.append(f)
            following.append(np.where(left, n["leftChild"], n["rightChild"]))
            for c in (n["leftChild"], n["rightChild"]):
                depth[c] = depth[n["id"]] + 1
        at = np.array(feature, dtype=np.int64)
        size = np.array(bins, dtype=np.int64)[at]
        stats = np.array([n["impurityStats"] for n in t])
        total = stats.sum(axis=1, keepdims=True)
        shares = np.divide(stats, total, out=np.zeros_like(stats), where=total > 0)
        out.append((pair(at, np.cumsum(size) - size), np.concatenate(following), shares, max(depth)))
    return Scorer(bins, cuts, out)


def probabilities(s: Scorer, columns: list[np.ndarray]) -> np.ndarray:
    """(rows, classes): the mean over all trees of the classes' shares at each row's leaf."""
    rows, classes = len(columns[0]), s.trees[0][2].shape[1]
    out = np.zeros((rows, classes))
    kind = code_type(s.bins)
    codes = np.zeros((len(s.bins), CHUNK), dtype=kind)
    flat = codes.reshape(-1)
    for lo in range(0, rows, CHUNK):
        n = min(CHUNK, rows - lo)
        idx = np.arange(n)
        for f, c in enumerate(columns):
            codes[f, :n] = np.searchsorted(s.cuts[f], c[lo:lo + n], side="left") if f in s.cuts else c[lo:lo + n]
        for where, following, shares, depth in s.trees:
            node = np.zeros(n, dtype=np.int64)
            for _ in range(depth):
                node = following.take(cells_of(where.take(node), idx, flat))
            out[lo:lo + n] += shares.take(node, axis=0)
    return out / len(s.trees)


def scored(numbers: DataFrame, columns: list[str], label: str, score: Scorer, of_class: int) -> DataFrame:
    """(label, prediction, score) of each row: the likeliest class and the probability of ``of_class``."""
    shared = numbers.sparkSession.sparkContext.broadcast(score)
    names = [*columns, label]

    def rows(batches):
        for b in batches:
            if any(b.column(n).null_count for n in names):
                raise ValueError("a null among the features or labels")
            p = probabilities(shared.value, [b.column(n).to_numpy(zero_copy_only=False) for n in columns])
            yield pa.RecordBatch.from_pydict({"label": b.column(label), "prediction": pa.array(p.argmax(axis=1).astype(np.float64)), "score": pa.array(p[:, of_class])})

    return numbers.select(*names).mapInArrow(rows, "label double, prediction double, score double")
