"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.session import checkpoint

#: white space of the word rule: a word is ``[^\x20\x09-\x0D]+``
WORD = r"[^\x20\x09-\x0D]+"


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def utf8(col: str):
    """Text as UTF-8 bytes; null counts as empty.  ``bytes.lower`` and ``bytes.split`` then follow the
    contract's rules for letters A-Z and for white space exactly."""
    return F.coalesce(F.col(f"`{col}`"), F.lit("")).cast("binary")


def arrow_rows(it, buffer_bytes: int = 32 << 20):
    """Record batches cut so that none holds much more than ``buffer_bytes``."""
    for batch in it:
        parts = max(1, -(-batch.nbytes // buffer_bytes))
        step = max(1, -(-batch.num_rows // parts))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def to_batch(data: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=schema.field(k).type) for k, v in data.items()],
        schema=schema)


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a C-contiguous matrix."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (two multiply-xorshift steps) over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def release(*caches: dict) -> None:
    """Empty the caches at the end of a task and hand free memory back to the system.

    Python workers live on between tasks, and those of different operators share them: what each keeps for itself
    would add up.
    """
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


class WordHashes(dict):
    """word bytes -> 64-bit hash, kept between batches up to ``limit`` words."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def smallest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, by repeated minima over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def running_totals(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """``<v>_before``: the sum of ``v`` over all rows earlier in the global order, by a distributed prefix sum.

    Rows are range-partitioned by ``order`` and each partition adds up its own; the partition totals
    (one row per partition) give the offsets.  No key or partition needs to fit a single task's memory.
    Ties in ``order`` stay within one partition; give a unique order for a definite result.
    """
    fields = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()),
                           *[T.StructField(f"{v}_before", T.LongType()) for v in values]])

    def add(it):
        from pyspark import TaskContext

        part, base = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for b in it:
            arrays = [*b.columns, pa.array(np.full(b.num_rows, part, np.int32))]
            for v in values:
                x = b.column(b.schema.get_field_index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(x)
                arrays.append(pa.array(total - x + base[v]))
                if len(total):
                    base[v] += int(total[-1])
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    keys = [F.col(o) for o in order]
    ranged = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(add, fields))
    last = ranged.groupBy("_part").agg(*[F.max(F.col(f"{v}_before") + F.col(v)).alias(f"_{v}_total") for v in values])
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select("_part", *[F.coalesce(F.sum(f"_{v}_total").over(w), F.lit(0)).alias(f"_{v}_offset")
                                     for v in values])
    joined = ranged.join(F.broadcast(offsets), "_part")  # one row per partition
    return joined.select(*[F.col(f"`{c}`") for c in df.columns],
                         *[(F.col(f"{v}_before") + F.col(f"_{v}_offset")).alias(f"{v}_before") for v in values])


#: bytes of row marks that are sent to all tasks together; more of them go in several parts
SENT_MARKS = 64 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of every row: ``_file``, a number for its file, and ``_row``, its position there.

    The places are those of Spark's file sources and stay the same however often the rows are read; rows that
    do not come from files are written first.
    """
    for attempt in (docs, None):
        source = checkpoint(docs) if attempt is None else attempt
        try:
            out = source.select(*[F.col(f"`{c}`") for c in docs.columns], F.xxhash64("_metadata.file_path").alias("_file"),
                                F.col("_metadata.row_index").alias("_row"))
            out.schema  # noqa: B018 - resolves the columns
        except AnalysisException:
            if attempt is None:
                raise
            continue
        if attempt is not None and not _rows_of_files(docs):
            continue
        return out
    raise AssertionError("unreachable")


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether ``docs`` reads files whose names have different numbers."""
    files = docs.inputFiles()
    spark = docs.sparkSession
    if not files:
        return False
    numbers = spark.createDataFrame([(f,) for f in files], "f string").select(F.xxhash64("f")).distinct().count()
    if numbers != len(set(files)):
        raise ValueError("two input files share a number")
    return True


def kept_rows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``docs`` (as ``numbered`` gives it) whose place is in the written table ``places`` (_file, _row), without the places.

    Each file's places become a bit a row, and the bits go to the tasks that read the file, so the rows
    themselves are not shuffled.  Bits beyond ``SENT_MARKS`` are sent in several parts, each to the files it is for.
    """
    def bits(table: pa.Table) -> pa.Table:
        rows = table["_row"].to_numpy()
        words = np.zeros(int(rows.max()) // 64 + 1, np.uint64)
        np.bitwise_or.at(words, rows // 64, np.uint64(1) << (rows % 64).astype(np.uint64))
        return pa.table({"_marked": table["_file"][:1], "_words": pa.array([words.view(np.int64).tolist()], pa.list_(pa.int64()))})

    marks = checkpoint(places.select("_file", "_row").groupBy("_file").applyInArrow(bits, "_marked long, _words array<long>"))
    sizes = marks.select("_marked", (F.size("_words") * 8).alias("bytes")).orderBy("_marked").collect()  # a row a file
    parts, filled = [[]], 0
    for r in sizes:
        if parts[-1] and filled + r["bytes"] > SENT_MARKS:
            parts, filled = [*parts, []], 0
        parts[-1].append(r["_marked"])
        filled += r["bytes"]
    names = [c for c in docs.columns if c not in ("_file", "_row")]
    word = F.get("_words", F.shiftright("_row", 6).cast("int"))
    out = None
    for part in parts:
        # the part's files are a range of the ordered numbers
        one = marks.filter(F.col("_marked").between(part[0], part[-1])) if part else marks
        some = docs if len(parts) == 1 else docs.filter(F.col("_file").between(part[0], part[-1]))
        # at most SENT_MARKS bytes, or one file's
        met = some.join(F.broadcast(one), F.col("_file") == F.col("_marked"))
        met = met.filter(F.getbit(word, F.pmod("_row", F.lit(64)).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in names])
        out = met if out is None else out.unionByName(met)
    return out
