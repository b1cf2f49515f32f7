"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition turns its rows into a run: digests in order, each once, with its smallest or
largest identifier, its number of rows and its byte length.  Runs then meet in binomial rounds: round r
merges ``fan_in`` neighbouring runs, slice by slice of the digest space, in one streaming pass over the
merged order.  A digest that a third of all rows share is one row of each run, and a slice is a bounded
share of the digests, so neither a hot text nor the root of the tree meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import columns, kept_rows, numbered
from planwell.session import checkpoint, discard

#: leading hex digits of a digest that name its slice
SLICE_DIGITS = 3


def _collapse(it):
    """Merges neighbouring rows of one (node, digest) in a stream ordered by node, digest and wanted
    identifier first: that identifier, the number of rows, the byte length.

    Holds back only the last digest, so memory does not grow with a run.  Raises where equal digests
    differ in length: their texts would not be equal.
    """
    held = None
    for batch in it:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table.cast(held.schema)])
        table = table.combine_chunks()
        rows = table.num_rows
        if not rows:
            continue
        same = pc.and_(pc.equal(table["node"][1:], table["node"][:-1]), pc.equal(table["digest"][1:], table["digest"][:-1]))
        first = np.flatnonzero(np.concatenate([[True], ~same.to_numpy(zero_copy_only=False).astype(bool)]))
        size = table["bytes"].to_numpy()
        if (np.minimum.reduceat(size, first) != np.maximum.reduceat(size, first)).any():
            raise ValueError("texts of different length share a digest")
        count = pa.array(np.add.reduceat(table["n"].to_numpy(), first), pa.int64())
        table = table.take(pa.array(first))
        table = table.set_column(table.schema.get_field_index("n"), "n", count)
        yield from table.slice(0, len(first) - 1).combine_chunks().to_batches()
        held = table.slice(len(first) - 1).combine_chunks()
    if held is not None:
        yield from held.to_batches()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, bytes) of every row; the text as it is, null as empty; SHA-256 of its UTF-8 bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return columns(docs, id_col, text_col).toDF("id", "text").select(
        "id", F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def merge_runs(rows: DataFrame, largest: bool = True, fan_in: int = 8) -> DataFrame:
    """Tree-merge of a written table of (id, digest, bytes): (digest, id, n, bytes), a row per digest."""
    schema = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("slice", T.StringType()),
                           T.StructField("digest", T.StringType()), T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("n", T.LongType()), T.StructField("bytes", T.LongType())])
    wanted = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    order = ["node", "slice", "digest", wanted]
    leaves = rows.select(F.spark_partition_id().alias("node"), F.substring("digest", 1, SLICE_DIGITS).alias("slice"),
                         "digest", "id", F.lit(1).cast("long").alias("n"), "bytes")
    runs = checkpoint(leaves.sortWithinPartitions(*order).mapInArrow(_collapse, schema))
    nodes, made = (runs.agg(F.max("node")).first()[0] or 0) + 1, []
    while True:
        made.append(runs)
        met = runs.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).repartition("slice", "node")
        runs = checkpoint(met.sortWithinPartitions(*order).mapInArrow(_collapse, schema))
        nodes = -(-nodes // fan_in)
        if nodes == 1:
            discard(*made)
            return runs.select("digest", "id", "n", "bytes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text.  Of equal texts the row with the
    largest (or ``keep="smallest"``) identifier stays.  A null identifier stays only where its whole group has
    none.  Repeated rows count one by one in ``group_size`` and share the verdict of their identifier.
    An empty table gives none.  Other columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    rows = checkpoint(digests(docs, id_col, text_col))
    root = merge_runs(rows, keep == "largest").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    return rows.join(root, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were.

    One row of each group of equal texts stays: the one with the largest (smallest) identifier, and the first by
    its place in the input where the group's rows repeat that identifier.  Otherwise as ``exact_groups``.  Rows
    are marked by their place; texts are read but never shuffled.
    """
    docs = numbered(docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = checkpoint(docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"),
                                  F.octet_length(text).cast("long").alias("bytes"), "_file", "_row"))
    root = merge_runs(rows.select("id", "digest", "bytes"), keep == "largest").select(F.col("digest").alias("_digest"), F.col("id").alias("keep_id"))
    # the first place of each (digest, identifier), before the digests meet: a hot text is spread by its identifiers
    places = rows.groupBy("digest", "id").agg(F.min(F.struct("_file", "_row")).alias("p"))
    stay = places.join(root, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("keep_id"))).select("p.*")
    out = kept_rows(docs, checkpoint(stay))
    discard(rows)
    return out
