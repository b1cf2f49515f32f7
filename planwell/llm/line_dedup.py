"""Substring dedup by line or paragraph hashing.

Texts are cut into units with their places in the text; a unit is normalised and hashed.  Digests are
grouped globally, by partial aggregation, to the earliest ranked occurrence; every other occurrence is
removed.  A line that is in a third of all documents is one row of each task before the shuffle, and the
join that finds its other occurrences can be split by Spark because nothing above it needs a key together.

Unit ``all`` takes paragraphs, lines and sentences at once.  What is a unit of several kinds counts once, as the
largest kind but for a paragraph of one line, which is a line; so equal texts meet whatever they are units of.
Paragraphs are normalised line by line, so that equal ones have equal lines: of every line and sentence the
earliest occurrence stays, also where a larger unit around another one goes.  A unit within the occurrence that
stays, as a sentence is in a line of only marks more, is part of it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import arrow_rows, columns, to_batch
from planwell.session import checkpoint

#: what separates units
SEPARATORS = {"line": r"\n", "paragraph": r"\n[^\S\n]*\n\s*", "sentence": r"\n|(?<=[.!?])\s+"}
#: units of fewer words are part of ordinary text and stay; of ``all`` only sentences that are not a whole line
MIN_WORDS = 6

_space = re.compile(r"\s+")
_patterns = {kind: re.compile(separator) for kind, separator in SEPARATORS.items()}


def normalise(unit: str) -> str:
    """Lower case, white space as single spaces, no marks at the ends."""
    return _space.sub(" ", unit.lower()).strip(" \t.,;:!?")


def cut(text: str, pattern: re.Pattern):
    """(start, end) of the units of a text, by code points, without the white space around them."""
    at = 0
    for m in [*pattern.finditer(text), None]:
        end = m.start() if m else len(text)
        unit = text[at:end]
        if stripped := unit.strip():
            start = at + len(unit) - len(unit.lstrip())
            yield start, start + len(stripped)
        at = m.end() if m else end


def _digest_text(unit: str) -> str:
    """The normalised text, or all of it if it is nothing but marks."""
    return normalise(unit) or _space.sub(" ", unit.lower()).strip()


def all_units(text: str, min_words: int):
    """(kind, number, start, end, words, what is hashed) of a text's paragraphs, lines and sentences."""
    at = {kind: 0 for kind in SEPARATORS}

    def number(kind):
        at[kind] += 1
        return at[kind] - 1

    for a, b in cut(text, _patterns["paragraph"]):
        lines = [(a + x, a + y) for x, y in cut(text[a:b], _patterns["line"])]
        units = [_digest_text(text[x:y]) for x, y in lines]
        no = number("paragraph")
        if len(lines) > 1:
            yield "paragraph", no, a, b, sum(u.count(" ") + 1 for u in units), "\n".join(units)
        for (x, y), unit in zip(lines, units):
            yield "line", number("line"), x, y, unit.count(" ") + 1, unit
            sentences = list(cut(text[x:y], _patterns["sentence"]))
            for c, d in sentences:
                no, unit = number("sentence"), normalise(text[x + c : x + d])
                words = unit.count(" ") + 1
                if len(sentences) > 1 and words >= min_words:
                    yield "sentence", no, x + c, x + d, words, unit


def _one_kind(kind: str, min_words: int):
    def units(text):
        for k, (start, end) in enumerate(cut(text, _patterns[kind])):
            unit = normalise(text[start:end])
            words = unit.count(" ") + 1
            if words >= min_words:
                yield kind, k, start, end, words, unit

    return units


def _units(kind: str, min_words: int, numbered: bool, schema: pa.Schema):
    units = _one_kind(kind, min_words) if kind != "all" else lambda text: all_units(text, min_words)

    def run(it):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in arrow_rows(it, 8 << 20):
            out = {f.name: [] for f in schema}
            given = batch.column(2).to_pylist() if numbered else None
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for kind_, k, start, end, words, unit in units(text):
                    digest = hashlib.blake2b(unit.encode(), digest_size=16).digest()
                    for name, value in zip(out, (doc_id, given[i] if numbered else row, k, start, end, words, kind_, digest)):
                        out[name].append(value)
                row += 1
            yield to_batch(out, schema)

    return run


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line",
                   min_words: int = MIN_WORDS, row_col: str | None = None) -> DataFrame:
    """A row per unit to remove: doc_id, kind, unit, start, end, n_words, keep_id, keep_kind, keep_unit, copies, and ``_row``.

    ``unit`` is one kind of units or ``all``.  Units are ranked by doc_id (null last), then their place in the text,
    then the row; of equal ones the first stays.  start and end are code points of the whole text.  Null texts have no units; units of
    fewer than ``min_words`` words stay, of ``all`` only sentences inside lines.  Rows that repeat a doc_id are ranked one by one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("_row", "unit", "start", "end", "n_words")],
                           T.StructField("kind", T.StringType()), T.StructField("digest", T.BinaryType())])
    names = [id_col, text_col] + ([row_col] if row_col else [])
    rows = columns(docs, *names).toDF("doc_id", "text", *names[2:]).withColumn("text", F.coalesce("text", F.lit("")))
    found = checkpoint(rows.mapInArrow(_units(unit, min_words, bool(row_col), to_arrow_schema(schema)), schema))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "_row", "end", "kind", "unit")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    hit = found.join(first, "digest").filter((F.col("_row") != F.col("first._row")) | (F.col("start") >= F.col("first.end")))
    return hit.select("doc_id", "kind", "unit", "start", "end", "n_words", F.col("first.doc_id").alias("keep_id"),
                      F.col("first.kind").alias("keep_kind"), F.col("first.unit").alias("keep_unit"), "copies", "_row")


def _rebuild(it):
    for batch in arrow_rows(it, 8 << 20):
        texts, spans = [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if text is None:
                texts.append(None), spans.append([])
                continue
            kept, at = [], 0
            for start, end in sorted((g["start"], g["end"]) for g in gone or []):
                if start > at:
                    kept.append((at, start))
                at = max(at, end)
            if at < len(text) or not text:
                kept.append((at, len(text)))
            texts.append("".join(text[a:b] for a, b in kept))
            spans.append([{"start": a, "end": b} for a, b in kept])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, span)],
                                         names=["_doc", "_text", "_kept"])


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str | None = None, **options) -> DataFrame:
    """``docs`` with the repeated units cut out of their texts; ``kept_col`` names a further column with the
    (start, end) in the original text of what is left."""
    numbered = checkpoint(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                                      F.monotonically_increasing_id().alias("_no")))
    flat = numbered.select(F.col(f"_doc.`{id_col}`").alias("doc_id"), F.col(f"_doc.`{text_col}`").alias("text"), "_no")
    gone = repeated_units(flat, row_col="_no", **options).groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    rows = numbered.join(gone, F.col("_no") == F.col("_row"), "left").select("_doc", F.col(f"_doc.`{text_col}`").alias("_text"), "gone")
    schema = T.StructType([rows.schema["_doc"], T.StructField("_text", T.StringType()),
                           T.StructField("_kept", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    built = rows.mapInArrow(_rebuild, schema)
    cols = [F.col("_text").alias(c) if c == text_col else F.col(f"_doc.`{c}`") for c in docs.columns]
    return built.select(*cols, *([F.col("_kept").alias(kept_col)] if kept_col else []))
