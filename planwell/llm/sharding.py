"""Sharding by extendible hashing.

A directory maps prefixes of a row's hash to shards.  A shard is the shortest prefix whose rows fit the
byte limit: only buckets over the limit split, on one more bit.  The bytes of all prefixes up to some
depth come from one histogram of the hashes; buckets that are over the limit even there are the only ones
whose rows are looked at again, some bits deeper.  Rows that share a whole hash cannot be split by bits; they fill
overflow pages of the limit's size in the order of a distributed prefix sum.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwell.llm.common import columns, numbered, running_totals
from planwell.session import checkpoint

LIMIT_BYTES = 16 << 20
#: bits by which the histogram is finer than the average shard, and by which each further look is finer
FINER_BITS, MORE_BITS, ALL_BITS = 4, 8, 60


def _prefix(bits):
    """The leading ``bits`` of the hash's upper ``ALL_BITS``."""
    return F.shiftrightunsigned(F.col("hash"), 64 - bits) if bits else F.lit(0).cast("long")


def _directory(cells: DataFrame, bits: int, known: int, limit: int) -> DataFrame:
    """(cell, depth): of each cell of ``bits`` bits the shortest prefix longer than ``known`` bits that fits;
    null where even the cell is over the limit and holds more than one hash."""
    depths = F.explode(F.sequence(F.lit(known), F.lit(bits)))
    each = cells.select("cell", "bytes", "low", "high", depths.alias("depth"))
    each = each.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = sums.filter((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "prefix")
    leaf = each.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(leaf, "cell", "left")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """A row per row of ``docs``: doc_id, bytes, depth, shard and page.

    bytes is the UTF-8 length of the text (null: 0); the hash is of id and text, so rows that repeat an
    id still spread.  ``shard`` is "<depth>/<prefix>"; the prefix's bits are its place in the directory.
    No shard holds more than the limit unless one row alone does; equal rows beyond the limit go to
    the pages 0, 1, ... of their shard, as many to a page as fit the limit (one that is over it has a page of its own).
    Every row has a shard; an empty table has none.
    """
    rows = columns(docs, id_col, text_col).toDF("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return _assign(rows.select("doc_id", F.octet_length(text).cast("long").alias("bytes"),
                               F.xxhash64(F.col("doc_id").cast("string"), text).alias("hash")), limit_bytes)


def _assign(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """``rows`` (bytes, hash and any others) with depth, shard and page in place of the hash."""
    kept = [c for c in rows.columns if c != "hash"]
    rows = checkpoint(rows)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(ALL_BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + FINER_BITS)
    known, left, done = 0, rows, []
    while True:
        cells = left.groupBy(_prefix(bits).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        directory = checkpoint(_directory(checkpoint(cells), bits, known, limit_bytes))
        placed = left.withColumn("cell", _prefix(bits)).join(directory, "cell")
        done.append(placed.filter("depth is not null").drop("cell"))
        if bits == ALL_BITS or directory.filter("depth is null").isEmpty():
            break
        left = checkpoint(placed.filter("depth is null").drop("cell", "depth"))
        known, bits = bits + 1, min(ALL_BITS, bits + MORE_BITS)
    # what 60 bits do not part: at the last depth, whatever its bytes
    done.append(placed.filter("depth is null").drop("cell").withColumn("depth", F.lit(ALL_BITS)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("prefix", F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftrightunsigned(hash, 64 - depth) END"))
    # rows of one hash that are together over the limit: they have one size, so a page takes a fixed number of them
    heavy = rows.groupBy("hash").agg(F.sum("bytes").alias("all"), F.max("bytes").alias("most"), F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") > 1) & (F.col("all") > limit_bytes)).select("hash", F.greatest(F.lit(1), F.floor(limit_bytes / F.col("most"))).alias("fit"))
    heavy = checkpoint(heavy)
    out = out.withColumn("page", F.lit(0).cast("long"))
    if not heavy.isEmpty():
        full = out.join(heavy, "hash").withColumn("no", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long"))
        full = running_totals(checkpoint(full), ["hash", "no"], ["one"])
        start = full.groupBy("hash").agg(F.min("one_before").alias("start"))
        full = full.join(start, "hash").withColumn("page", F.floor((F.col("one_before") - F.col("start")) / F.col("fit")))
        out = out.join(heavy, "hash", "left_anti").unionByName(full.select(*out.columns))
    return out.select(*kept, F.col("depth").cast("int").alias("depth"),
                      F.concat_ws("/", F.col("depth").cast("string"), F.col("prefix").cast("string")).alias("shard"), "page")


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Write every row of ``docs`` under ``path``, a folder (``shard_page``) per shard and page, and return the
    assignment: bytes, shard_page and the row's place in the input, _file and _row.

    A row's bytes are those of all its columns as JSON.  Rows are told apart by their place, so nulls and
    repeats in any column do no harm; equal rows share pages as in ``shard_rows``.  Columns are written as they are.
    """
    clash = {"shard_page", "_file", "_row"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are needed for the shards")
    docs = numbered(docs)
    data = [c for c in docs.columns if c not in ("_file", "_row")]
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in data]))
    sized = docs.select("_file", "_row", F.octet_length(record).cast("long").alias("bytes"), F.xxhash64(record).alias("hash"))
    where = checkpoint(_assign(sized, limit_bytes)).select(
        "_file", "_row", "bytes", F.concat(F.translate("shard", "/", "-"), F.lit("-"), F.col("page").cast("string")).alias("shard_page"))
    docs.join(where.drop("bytes"), ["_file", "_row"]).select(*[F.col(f"`{c}`") for c in data], "shard_page").repartition(
        "shard_page").write.partitionBy("shard_page").parquet(path)
    return where
