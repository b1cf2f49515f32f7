"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks: a hash of the row names one of ``2**k`` cells, and neighbouring cells of a
source make up a block of about ``block_words``, so that a block is a random share of its source and the
blocks of a source, in the order of their cells, a random permutation of it.  A source's target is drawn as whole passes over its blocks and a last
part pass that ends inside one block, where documents are chosen to fill what is left.  Room that no document
of that block fits goes to documents of the later blocks, until it is below the smallest.  The draws of all
sources are the urn of a splitting tree: the root holds every source's number of draws, each split hands
one half of the output shards its share by a multivariate hypergeometric draw, and a leaf is one shard
with an exact number of draws per source.  Shards take the next draws of each source, disjoint by
construction, and each is shuffled on its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwell.llm.common import WORD, columns, running_totals
from planwell.session import checkpoint

#: weights of the sources in order, repeating; the most that a target may be of its source
WEIGHTS, MOST = (5, 2, 1), 3
MAX_CELL_BITS = 20


def water_fill(sizes, weights, total: float, most: float = MOST) -> np.ndarray:
    """Shares of ``total`` by weight; a share stops at ``most`` times its size and the excess is shared
    again by weight among the others until none is above."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        rest = max(0.0, total - out[~open_].sum())
        share = rest * weights[open_] / weights[open_].sum()
        over = share > most * sizes[open_]
        if not over.any():
            out[open_] = share
            break
        at = np.flatnonzero(open_)[over]
        out[at], open_[at] = most * sizes[at], False
    return out


def _targets(weights, most: float):
    """All sources (one row each) in their order: target, whole passes and the words of the part pass."""

    def run(pdf):
        import pandas as pd

        named = pdf[pdf.source.notna()]
        named = named.iloc[sorted(range(len(named)), key=lambda i: named.source.iloc[i].encode())]
        pdf = pd.concat([named, pdf[pdf.source.isna()]], ignore_index=True)
        sizes = pdf["source_size"].to_numpy(np.int64)
        pdf["target"] = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], float(sizes.sum()), most)
        words = np.floor(pdf["target"].to_numpy() + 0.5).astype(np.int64)
        pdf["passes"] = words // np.maximum(sizes, 1)
        pdf["rest"] = words - pdf["passes"] * sizes
        pdf["source_no"] = np.arange(len(pdf))
        return pdf[["source", "source_no", "source_size", "target", "blocks", "passes", "rest"]]

    return run


def _split(seed: int, stop: int):
    """Splits a node's draws among its shards, by halves, down to nodes of at most ``stop`` shards."""

    def halves(quota, first, shard, count):
        if count <= stop:
            yield shard, count, first, quota
            return
        rng = np.random.Generator(np.random.PCG64([seed, shard, count]))
        left, pool = count // 2, int(quota.sum())
        want, take = pool * left // count, np.zeros_like(quota)
        for i, q in enumerate(quota.tolist()):  # the sources one after the other: multivariate hypergeometric
            take[i] = rng.hypergeometric(q, pool - q, want) if q and want else 0
            pool, want = pool - q, want - int(take[i])
        yield from halves(take, first, shard, left)
        yield from halves(quota - take, first + take, shard + left, count - left)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("source_no")
        out = []
        for shard, count, first, quota in halves(pdf["draws"].to_numpy(np.int64), pdf["first"].to_numpy(np.int64),
                                                 int(pdf["shard"].iloc[0]), int(pdf["shards"].iloc[0])):
            out.append(pd.DataFrame({"source_no": pdf["source_no"].to_numpy(), "shard": shard, "shards": count,
                                     "first": first, "draws": quota}))
        return pd.concat(out)

    return run


def _fill(table: pa.Table) -> pa.Table:
    """The documents of one block that a part pass takes: from the longest each one that still fits."""
    table = table.sort_by([("_size", "descending"), ("_hash", "ascending")])
    size, room = table["_size"].to_numpy(), table["_room"][0].as_py()
    taken, left = np.zeros(len(size), bool), room
    for i, s in enumerate(size.tolist()):
        if 0 < s <= left:
            taken[i], left = True, left - s
    return table.set_column(table.schema.get_field_index("_chosen"), "_chosen", pa.array(taken))


def _carried(tail: DataFrame, part: DataFrame, left: DataFrame) -> DataFrame:
    """(source_no, _hash, n, all): of how many of the rows of a hash the room goes to that the part blocks leave.

    ``tail`` are the rows of later blocks, ``part`` those that the part blocks do not take, as (source_no, _hash,
    _size); ``left`` is a row per source with its room.  In the order of the hashes documents are taken while they
    fit; then again among those that are small enough for what is left, until there is none.  At the end the
    smallest document is taken if that comes nearer.
    """
    taken = None
    rest = checkpoint(tail.join(left, "source_no").filter("_size <= left").drop("left").withColumn(
        "no", F.monotonically_increasing_id()))
    while not rest.isEmpty():
        each = running_totals(rest, ["source_no", "_hash", "no"], ["_size"])
        first = each.groupBy("source_no").agg(F.min("_size_before").alias("start"))
        each = checkpoint(each.join(first, "source_no").join(left, "source_no").withColumn(
            "fits", F.col("_size_before") - F.col("start") + F.col("_size") <= F.col("left")))
        now = each.filter("fits").select("source_no", "_hash", "_size")
        taken = now if taken is None else taken.unionByName(now)
        used = now.groupBy("source_no").agg(F.sum("_size").alias("used"))
        left = checkpoint(left.join(used, "source_no", "left").select("source_no", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")))
        rest = checkpoint(each.filter("not fits").select("source_no", "_hash", "_size", "no").join(left, "source_no").filter(
            "_size <= left").drop("left"))
    taken = (taken if taken is not None else tail.limit(0)).groupBy("source_no", "_hash").agg(F.count(F.lit(1)).alias("n"))
    over = tail.unionByName(part).join(left, "source_no").filter("_size > left and _size < 2 * left").groupBy("source_no", "_hash").agg(
        F.min("_size").alias("_size"), F.count(F.lit(1)).alias("all")).join(taken, ["source_no", "_hash"], "left")
    over = over.filter("all > coalesce(n, 0)").groupBy("source_no").agg(F.min(F.struct("_size", "_hash")).alias("x"))
    over = over.select("source_no", F.col("x._hash").alias("_hash"), F.lit(1).cast("long").alias("n"))
    taken = checkpoint(taken.unionByName(over).groupBy("source_no", "_hash").agg(F.sum("n").alias("n")))
    count = tail.unionByName(part).join(taken.select("source_no", "_hash"), ["source_no", "_hash"]).groupBy("source_no", "_hash").agg(
        F.count(F.lit(1)).alias("all"))
    return checkpoint(taken.join(count, ["source_no", "_hash"]))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, payload: bool) -> DataFrame:
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if payload else []
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        *row, F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.xxhash64(text)).alias("_hash"))


def mix_draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights=WEIGHTS, most: float = MOST, seed: int = 11, shard_words: int = 1 << 22, block_words: int = 1 << 15,
              payload: bool = False) -> DataFrame:
    """A row per row of ``docs``: _id, _source, _size, _source_size, _target and the draws that take it.

    ``_picks`` is an array of (pass, shard), empty for a row that is not taken; with ``payload`` the whole
    row comes along as ``_row``.  Sizes count words; null text counts as empty and is never taken.  A null
    source is a source of its own, last in the order.  Repeated rows are drawn one by one.  Draws depend
    on the rows and ``seed`` only, so reruns agree.  The total is that of all sizes; a document is taken at
    most ``most`` times.  One row per source, and per source and shard, is what single tasks handle.
    """
    sized = checkpoint(_measured(docs, id_col, text_col, source_col, seed, False))
    total = sized.agg(F.sum("_size")).first()[0] or 0
    bits = min(MAX_CELL_BITS, max(0, math.ceil(math.log2(max(1, 4 * total / block_words)))))
    cell = F.shiftrightunsigned(F.col("_hash"), 64 - bits) if bits else F.lit(0).cast("long")
    cells = sized.filter("_size > 0").groupBy(F.col("_source").alias("source"), cell.alias("cell")).agg(F.sum("_size").alias("words"))
    w = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("before", F.sum("words").over(w) - F.col("words"))
    cells = checkpoint(cells.withColumn("block", (F.dense_rank().over(
        Window.partitionBy("source").orderBy(F.floor(F.col("before") / block_words))) - 1).cast("long")))
    blocks = cells.groupBy("source", "block").agg(F.sum("words").alias("words"), F.min("before").alias("before"))
    empty = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    counted = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"))
    named = empty.alias("e").join(counted.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left").select(
        "e.source", "source_size", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    sources = checkpoint(named.groupBy().applyInPandas(
        _targets(tuple(weights), most), "source string, source_no long, source_size long, target double, blocks long, passes long, rest long"))
    placed = checkpoint(blocks.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        "b.source", "block", "source_no", "passes", "s.blocks",
        F.when(F.col("before") < F.col("rest"), F.col("rest") - F.col("before")).alias("room"), "words"))
    urn = placed.groupBy("source_no").agg((F.first("passes") * F.first("blocks") + F.count("room")).alias("draws"))
    shards = max(1, math.ceil(total / shard_words))
    schema = "source_no long, shard long, shards long, first long, draws long"
    root = urn.select("source_no", F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("shards"),
                      F.lit(0).cast("long").alias("first"), "draws")
    inner = root.groupBy("shard").applyInPandas(_split(seed, max(1, math.isqrt(shards))), schema)
    leaves = checkpoint(inner.groupBy("shard").applyInPandas(_split(seed, 1), schema).filter("draws > 0"))
    each = leaves.select("source_no", "shard", F.explode(F.sequence("first", F.col("first") + F.col("draws") - 1)).alias("draw"))
    each = each.join(sources.select("source_no", "blocks"), "source_no").select(
        "source_no", (F.col("draw") % F.col("blocks")).alias("block"), F.floor(F.col("draw") / F.col("blocks")).alias("pass"), "shard")
    whole = (F.col("pass") < F.col("passes")) | (F.col("room") >= F.col("words"))
    pick = F.struct(F.col("pass").cast("int").alias("pass"), "shard")
    plan = placed.join(each, ["source_no", "block"]).groupBy("source_no", "block").agg(
        F.first("source").alias("source"), F.sort_array(F.collect_list(F.when(whole, pick))).alias("picks"),
        F.first(F.when(~whole, pick), True).alias("part"), F.first(F.when(~whole, F.col("room")), True).alias("room")).alias("d")
    plan = checkpoint(cells.alias("c").join(plan, F.col("c.source").eqNullSafe(F.col("d.source")) & (F.col("c.block") == F.col("d.block")))
                      .select("c.source", "c.cell", "c.block", "picks", "part", "room"))
    ends = checkpoint(plan.filter("room is not null").groupBy("source").agg(
        F.max("cell").alias("upto"), F.first("part").alias("end"), F.first("room").alias("left")).alias("e").join(
        sources.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source"))).select("e.*", "s.source_no"))

    def filled(rows):
        """All rows with what their blocks say; ``_chosen`` are those that a part block takes."""
        rows = rows.withColumn("_cell", cell).alias("r").join(
            plan.alias("p"), F.col("r._source").eqNullSafe(F.col("p.source")) & (F.col("r._cell") == F.col("p.cell")), "left")
        rows = rows.select("r.*", F.col("block").alias("_block"), "picks", "part", F.col("room").alias("_room"), F.lit(False).alias("_chosen"))
        partial = rows.filter("_room is not null and _size > 0")
        return rows, partial.groupBy("_source", "_block").applyInArrow(_fill, partial.schema)

    known = checkpoint(filled(sized)[1].alias("r").join(ends.alias("e"), F.col("r._source").eqNullSafe(F.col("e.source"))).select(
        "source_no", "_hash", "_size", "_chosen"))
    used = known.filter("_chosen").groupBy("source_no").agg(F.sum("_size").alias("used"))
    left = checkpoint(ends.join(used, "source_no", "left").select("source_no", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")))
    tail = sized.filter("_size > 0").alias("r").join(ends.alias("e"), F.col("r._source").eqNullSafe(F.col("e.source")) & (cell > F.col("upto"))).select(
        "source_no", "_hash", "_size")
    more = _carried(tail, known.filter("not _chosen").drop("_chosen"), left)
    more = more.join(ends.select("source_no", "source", "end"), "source_no").select(
        F.col("source").alias("_from"), F.col("_hash").alias("_more"), "end", "n", "all")
    rows, chosen = filled(_measured(docs, id_col, text_col, source_col, seed, True) if payload else sized)
    rows = rows.filter("_room is null or _size = 0").unionByName(chosen)
    cols = rows.columns
    rows = rows.join(more, F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_hash") == F.col("_more")) & ~F.col("_chosen"), "left")
    some = rows.filter("n < all").withColumn("_nth", F.row_number().over(Window.partitionBy("_source", "_hash").orderBy("_size")))
    rows = rows.filter("n is null or n >= all").withColumn("_nth", F.lit(0)).unionByName(some)
    extra = F.col("n").isNotNull() & (F.col("_nth") <= F.col("n"))
    rows = rows.withColumn("part", F.when(extra, F.col("end")).otherwise(F.col("part"))).withColumn(
        "_chosen", F.col("_chosen") | extra).select(*cols)
    none = F.array().cast("array<struct<pass:int,shard:bigint>>")
    picks = F.when(F.col("_size") == 0, none).otherwise(F.concat(
        F.coalesce("picks", none), F.when(F.col("_chosen"), F.array("part")).otherwise(none)))
    out = rows.withColumn("_picks", picks).alias("r").join(
        sources.select("source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target")).alias("s"),
        F.col("r._source").eqNullSafe(F.col("s.source")))
    return out.drop("picks", "part", "_room", "_chosen", "_cell", "_block", "source")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    d = mix_draws(columns(docs, *dict.fromkeys([options.get("id_col", "doc_id"), options.get("text_col", "text"),
                                                options.get("source_col", "source")])), **options)
    return d.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                    F.col("_target").alias("target"), (F.col("_size") * F.size("_picks")).alias("taken"))


def mixed(docs: DataFrame, with_shard: bool = False, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is drawn, dealt to its shards, shuffled within each.

    Rows keep their columns; ``with_shard`` adds ``_shard`` and ``_pass``.
    """
    seed = options.get("seed", 11)
    d = mix_draws(docs, payload=True, **options).select("_row", "_hash", F.explode("_picks").alias("_pick"))
    d = d.withColumn("_order", F.xxhash64(F.lit(seed), "_pick", "_hash")).repartition("_pick.shard")
    d = d.sortWithinPartitions("_pick.shard", "_order")
    more = [F.col("_pick.shard").alias("_shard"), F.col("_pick.pass").alias("_pass")] if with_shard else []
    return d.select("_row.*", *more)
