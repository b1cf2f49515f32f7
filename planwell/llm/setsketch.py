"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles, as 64-bit hashes.  Register i of its sketch is
``floor(1 - log_b h_i)``, cut to 0..q+1, where h_i is the smallest over the set of exponentially
distributed values of rate a: the registers of a union are the maxima, and with b near 1 two registers are
equal with nearly the probability of the Jaccard similarity.  Bands of registers name buckets.  Within
a bucket each document is first compared with one centre.  Where a bucket still holds different components
that are likely to link, these make up a cluster, whose documents are compared with each other, block
by block, as far as links found before have not joined them.  A pair is judged by the joint likelihood
of its registers, given the two set sizes, and what passes is confirmed on the full sets.
Documents with equal sets are one class from the start, so groups of copies cost one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import WordHashes, arrow_rows, binary_rows, columns, kept_rows, mix64, numbered, release, to_batch, utf8
from planwell.llm.components import connected_components
from planwell.session import checkpoint, discard

#: sketch: base, rate and range of the registers
BASE, RATE, RANGE = 1.001, 20.0, (1 << 16) - 2
#: at a similarity of 0.8 one of the bands fails to match with a probability of 4e-8
BANDS, ROWS = 32, 4
#: bucket members whose registers are compared with each other in one go, and cluster members on their full sets; a
#: larger group meets as pairs of blocks, which copies a member once per block of its group
BLOCK, VERIFY_BLOCK = 2048, 256

#: components that a task of the second round remembers as tied together
TIED = 500_000

_words = WordHashes()


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words: the whole sequence as one."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out + h[i : len(h) - n + 1 + i])
    return np.unique(mix64(out + np.uint64(n)))


_MULTIPLIERS = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row of ``count`` registers per non-empty set, as uint16."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = np.concatenate(sets)
    largest = np.empty((count, len(sets)), np.uint64)
    for i in range(count):
        # the largest uniform value gives the smallest exponential one
        y = x * _MULTIPLIERS[i]
        y ^= y >> np.uint64(29)
        y *= _MULTIPLIERS[count + i]
        largest[i] = np.maximum.reduceat(y, starts)
    u = (largest.T >> np.uint64(11)).astype(np.float64)
    smallest = -np.log((u + 0.5) * 2.0 ** -53) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, RANGE + 1).astype(np.uint16)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each row pair, from the numbers of registers that are larger,
    smaller and equal and from the known set sizes.

    With b near 1 the three have the probabilities u - vJ, v - uJ and J, for shares u and v of both sizes;
    the likelihood is concave in J and its slope is halved down to the root.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        j = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = same / j - more * v / (u - v * j) - less * u / (v - u * j)
        up = ~(slope < 0)
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def _sketch(shingle: int, count: int, schema: pa.Schema):
    def run(it):
        for batch in arrow_rows(it, 8 << 20):
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(t, shingle) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            nodes = [None] * len(sets)
            regs = np.zeros((len(sets), count), np.uint16)
            for i in full:
                nodes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            if full:
                regs[full] = registers([sets[i] for i in full], count)
            more = {batch.schema.names[i]: batch.column(i) for i in range(2, batch.num_columns)}
            yield to_batch({"doc_id": batch.column(0), "n": [len(s) for s in sets], "node": nodes,
                            "regs": binary_rows(regs), **more}, schema)
        release(_words)

    return run


def _bands(schema: pa.Schema):
    def run(it):
        for batch in it:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            packed = np.ascontiguousarray(regs).view(np.uint64).reshape(-1, BANDS)
            keys = mix64(packed + _MULTIPLIERS[:BANDS]).view(np.int64)
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
            yield to_batch({"key": keys.reshape(-1), "node": node}, schema)

    return run


def _likely(threshold: float, schema: pa.Schema):
    """Pairs whose registers do not rule out a similarity of ``threshold``: five deviations below it."""
    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            keep = _passes(a, b, batch["na"].to_numpy(), batch["nb"].to_numpy(), threshold)
            yield to_batch({c: batch[c].filter(pa.array(keep)) for c in ("a", "b")}, schema)

    return run


def _passes(a, b, n_a, n_b, threshold):
    margin = 5 * (threshold * (1 - threshold) / a.shape[1]) ** 0.5
    close = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) * (1 - 1e-12)
    return close & (joint_similarity(a, b, n_a.astype(float), n_b.astype(float)) >= threshold - margin)


def _bucket_pairs(threshold: float, schema: pa.Schema):
    """Where members of a (key, low, high) that are in different components are likely to link: edges between
    these components, by their roots.  The stream is ordered by the three.

    A task emits a forest over all that it sees: components that earlier buckets or blocks have tied together
    already are neither compared nor named again, so its rows are fewer than its components.
    """
    tied: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        path = []
        while (up := tied.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            tied[y] = x
        return x

    def pairs(table: pa.Table):
        if len(tied) > TIED:
            tied.clear()
        group = np.stack([table[c].to_numpy() for c in ("key", "low", "high")])
        new = np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)])
        number = np.cumsum(new)
        names = [top(x) for x in table["root"].to_pylist()]
        root = pa.array(names, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block, n = table["block"].to_numpy(), table["n"].to_numpy()
        cross = group[1] != group[2]
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(len(n), -1)
        left, right = [], []
        for d in range(1, len(n)):
            same = number[:-d] == number[d:]
            if not same.any():
                break
            at = np.flatnonzero(same & (root[:-d] != root[d:]) & (~cross[:-d] | (block[:-d] != block[d:])))
            for i in range(0, len(at), 20_000):
                x = at[i : i + 20_000]
                x = x[_passes(regs[x], regs[x + d], n[x], n[x + d], threshold)]
                left.append(x)
                right.append(x + d)
        a, b = [], []
        for i, j in zip(np.concatenate(left).tolist(), np.concatenate(right).tolist()) if left else ():
            if (x := top(names[i])) != (y := top(names[j])):
                tied[x] = y
                a.append(x)
                b.append(y)
        if a:
            yield to_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())}, schema)

    def run(it):
        held = None
        for batch in it:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = [table[c][table.num_rows - 1].as_py() for c in ("key", "low", "high")] if table.num_rows else None
            if not last:
                continue
            tail = table.num_rows
            keys = np.stack([table[c].to_numpy() for c in ("key", "low", "high")])
            differs = np.flatnonzero((keys != np.array(last)[:, None]).any(0))
            tail = differs[-1] + 1 if len(differs) else 0
            if tail:
                yield from pairs(table.slice(0, tail))
            held = table.slice(tail).combine_chunks()
        if held is not None and held.num_rows:
            yield from pairs(held)

    return run


def _verify_block(threshold: float, percent: int, schema: pa.Schema):
    """The links of one pair of blocks of a cluster, on the full sets: pairs whose members earlier links
    have not joined yet are confirmed one by one, and those that link come out."""
    def run(table: pa.Table) -> pa.Table:
        n, block = table["n"].to_numpy(), table["block"].to_numpy()
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(len(n), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        root = table["root"].combine_chunks().dictionary_encode().indices.to_pylist()
        parent = list(range(max(root) + 1))

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        cross, number = table["low"][0].as_py() != table["high"][0].as_py(), np.array(root)
        left, right = [], []
        for i in range(len(n) - 1):
            at = np.flatnonzero(number[i + 1 :] != number[i]) + i + 1
            if cross:
                at = at[block[at] != block[i]]
            if not len(at):
                continue
            at = at[_passes(regs[i][None].repeat(len(at), 0), regs[at], n[i].repeat(len(at)), n[at], threshold)]
            for j in at.tolist():
                if (x := find(root[i])) != (y := find(root[j])) and _linked(sets[i], sets[j], percent):
                    parent[x] = y
                    left.append(i)
                    right.append(j)
        nodes = table["node"].combine_chunks()
        return pa.table({"a": nodes.take(pa.array(left, pa.int64())), "b": nodes.take(pa.array(right, pa.int64()))}, schema=schema)

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _full_sets(shingle: int, schema: pa.Schema):
    def run(it):
        for batch in arrow_rows(it, 8 << 20):
            sets = [shingle_set(t, shingle) for t in batch["text"].to_pylist()]
            yield to_batch({"node": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                            "hashes": [s.tobytes() for s in sets]}, schema)
        release(_words)

    return run


def _confirm(percent: int, schema: pa.Schema):
    def run(it):
        for batch in it:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist())]
            yield to_batch({c: batch[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")}, schema)

    return run


_PAIR = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept, and the digests of its set, ``_set``,
    and of the smallest set of its component, ``_root``.

    Documents link where 100 * intersection >= ``percent`` * union of their sets of distinct
    ``shingle``-word shingles (lower-cased A-Z; with fewer words, the whole sequence is one shingle);
    component_id is the smallest doc_id that links reach.  Null, empty and wordless texts have no
    shingles, link with nothing and stay.  A null doc_id takes part in its component but never names it;
    a component without any doc_id has none and is not kept, except wordless rows.  Rows that repeat a
    doc_id share its verdict.  An empty table gives none; further columns are ignored.
    """
    sketches, named = _components(columns(docs, id_col, text_col).toDF("doc_id", "text"), [], shingle, percent)
    out = sketches.select("doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("_set")).join(named, "_set", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.col("n_shingles") == 0).alias("kept"), "_set", "_root")


def _components(rows: DataFrame, extra: list[str], shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sketches, named) of the rows (doc_id, text and ``extra`` columns that come along): a row per row with n and node, the
    digest of its set; and (_set, _root, component_id) of every set."""
    from pyspark.sql.pandas.types import to_arrow_schema

    threshold = percent / 100
    carried = [rows.schema[c] for c in extra]
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType()),
                           T.StructField("node", T.BinaryType()), T.StructField("regs", T.BinaryType()), *carried])
    rows = rows.select("doc_id", utf8("text").alias("text"), *extra)
    sketches = checkpoint(rows.mapInArrow(_sketch(shingle, BANDS * ROWS, to_arrow_schema(schema)), schema))
    classes = checkpoint(sketches.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    band_schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.BinaryType())])
    bands = classes.select("node", "regs").mapInArrow(_bands(to_arrow_schema(band_schema)), band_schema)
    pair_arrow = to_arrow_schema(_PAIR)
    # buckets of two or more, with their centre
    bands = checkpoint(bands)
    # centres are a table of their own before they meet the members: Spark can split a large bucket's side of the join
    centres = checkpoint(bands.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    buckets = checkpoint(bands.join(centres, "key"))
    discard(bands, centres)

    def full_sets(wanted: DataFrame) -> DataFrame:
        """(node, hashes) of the wanted nodes; only their documents are read once more."""
        # one document stands for each set; where its id repeats, the digest tells the right row
        stand = checkpoint(classes.join(wanted, "node", "left_semi").select("node", "rep"))
        set_schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("hashes", T.BinaryType())])
        texts = rows.join(stand.select("rep").distinct(), rows["doc_id"].eqNullSafe(F.col("rep")), "left_semi")
        sets = texts.select("text").mapInArrow(_full_sets(shingle, to_arrow_schema(set_schema)), set_schema)
        return checkpoint(sets.join(stand, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their full sets."""
        pairs = checkpoint(pairs)
        sets = full_sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        first = checkpoint(pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("sa")), "a"))
        both = first.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("sb")), "b").select("a", "b", "sa", "sb")
        links = checkpoint(both.mapInArrow(_confirm(percent, pair_arrow), _PAIR))
        discard(pairs, sets, first)
        return links

    def blocked(df: DataFrame, members: str, block: int) -> DataFrame:
        """Each row once per pair of blocks of its group that it takes part in: columns low, high, block."""
        df = df.withColumn("_blocks", F.ceil(F.col(members) / block)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
        df = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other"))
        return df.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}).drop("_blocks", "_other", members)

    # round 1: each member of a bucket with its centre
    star = buckets.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    side = classes.select("node", "n", "regs")
    judged = star.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")
    links = confirmed(judged.mapInArrow(_likely(threshold, pair_arrow), _PAIR))
    roots = checkpoint(connected_components(links))
    # round 2: what a bucket of three or more still holds in different components
    held = buckets.filter("members > 2").join(roots, "node", "left").select(
        "key", "node", "members", F.coalesce("root", "node").alias("root"))
    held = checkpoint(held)
    mixed = checkpoint(held.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key"))
    done = held
    held = held.join(mixed, "key").join(side, "node").select("key", "node", "members", "root", "n", "regs")
    held = blocked(held, "members", BLOCK).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    likely = checkpoint(held.select("key", "low", "high", "block", "node", "root", "n", "regs").mapInArrow(
        _bucket_pairs(threshold, pair_arrow), _PAIR).distinct())
    discard(done, mixed)
    if not likely.isEmpty():
        # clusters: components and the likely links between them; inside, all is confirmed on full sets
        clusters = checkpoint(connected_components(likely.unionByName(links)).select("node", F.col("root").alias("cluster")))
        open_ = clusters.join(roots, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root"))
        sizes = open_.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        open_ = checkpoint(open_.join(sizes.filter("r0 <> r1").select("cluster", "members"), "cluster"))
        sets = full_sets(open_.select("node"))
        met = blocked(open_.join(side, "node").join(sets, "node"), "members", VERIFY_BLOCK)
        more = checkpoint(met.groupBy("cluster", "low", "high").applyInArrow(_verify_block(threshold, percent, pair_arrow), _PAIR))
        roots = checkpoint(connected_components(links.unionByName(more)))
        discard(sets, clusters, open_)
    discard(buckets, links)
    named = classes.select("node", "rep").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep")
    # a table of its own, so that Spark can split a large component's side of the join
    smallest = checkpoint(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = checkpoint(named.join(smallest, "root").select(F.col("node").alias("_set"), F.col("root").alias("_root"), "component_id"))
    return sketches, named


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were: of each near-copy group one of the
    rows with the smallest doc_id, and every row without words.

    Where several rows of a group carry that doc_id, or the group has no doc_id at all, the one with the smallest
    set digest among them stays, and of equal ones the first by its place in the input.  Rows are marked by their
    place; texts are read but never shuffled for it.
    """
    docs = numbered(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), "_file", "_row")
    sketches, named = _components(rows, ["_file", "_row"], shingle, percent)
    place = F.struct("_file", "_row")
    # of each set one row first: a partial aggregate, whatever the number of copies
    first = sketches.filter("n > 0").groupBy("node").agg(F.min_by(
        F.struct("doc_id", "_file", "_row"), F.struct(F.col("doc_id").isNull(), "doc_id", "_file", "_row")).alias("p")).select("node", "p.*")
    first = checkpoint(first)
    best = first.join(named.select("_set", "_root"), F.col("node") == F.col("_set")).groupBy("_root").agg(
        F.min_by(place, F.struct(F.col("doc_id").isNull(), "doc_id", "node", "_file", "_row")).alias("p"))
    stay = best.select("p.*").unionByName(sketches.filter("n = 0").select("_file", "_row"))
    out = kept_rows(docs, checkpoint(stay))
    discard(sketches, named, first)
    return out
