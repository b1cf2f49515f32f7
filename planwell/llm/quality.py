"""Quality classifier by importance resampling over hashed n-grams.

Two generative bag-of-n-gram models share a table of ``BUCKETS`` hashed features: one of the target text
(documents labelled good), one of the raw text (all documents).  A document's importance is the ratio of
its probabilities under the two, kept as a log; the resample is the top k of log importance plus Gumbel
noise, so that it is a draw without replacement in proportion to the importance.  The noise is a hash of
the document, so that reruns agree.  k is the number of documents above the importance that best
separates the labelled rows.  For that a row labelled good is scored by a model without its own words:
counted with them it is far above a clean document whose rare words the target has not seen, and a cut
below such rows alone would reject most clean documents without a label.  A document labelled not good
is not drawn, whatever its score: the cut is for those whose label is not known.

Features are words, punctuation runs and neighbouring pairs of them.  A pair of equal neighbours is one
feature whatever the word, and so are a word all in capitals and a repetition at a distance of two,
because the hashed words alone say nothing about words that no other document has.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import WordHashes, arrow_rows, columns, kept_rows, mix64, numbered, release, running_totals, utf8
from planwell.session import checkpoint

BUCKETS = 1 << 16
#: bins of the labelled rows' log importance, on an asinh scale, from which the cut is chosen
BINS, SPAN = 4000, 20.0
#: labelled rows are sent to all tasks up to this number, 16 bytes each, and joined by a shuffle beyond it
SENT_ROWS = 2_000_000

_parts = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
_hash = WordHashes()


class _Features(dict):
    """white-space word -> hashes of its parts in lower case, after one for capitals if it is all capitals."""

    limit = 100_000

    def __missing__(self, word: bytes) -> bytes:
        letters = word.strip(_MARKS)
        shape = [b"\0capitals"] if len(letters) > 1 and letters.isupper() else []
        value = self[word] = np.array([_hash[p] for p in [*shape, *_parts.findall(word.lower())]], np.uint64).tobytes()
        return value


_features = _Features()
_CAPITALS = np.uint64(_hash[b"\0capitals"])
_SAME, _PAIR, _NEAR = np.uint64(11), np.uint64(13), np.uint64(17)


def features(text: bytes) -> np.ndarray:
    """Bucket numbers of all features of a text, with repeats."""
    if len(_features) > _features.limit:
        _features.clear()
    h = np.frombuffer(b"".join(map(_features.__getitem__, text.split())), np.uint64)
    capitals = h == _CAPITALS
    tokens = h[~capitals] if capitals.any() else h
    pairs = mix64(tokens[:-1] * np.uint64(3) + tokens[1:] + _PAIR)
    pairs[tokens[:-1] == tokens[1:]] = _SAME
    near = np.full(int((tokens[:-2] == tokens[2:]).sum()), _NEAR)
    out = np.concatenate([tokens, pairs, h[capitals], near])
    return (out % np.uint64(BUCKETS)).astype(np.int64)


def _count(it):
    """Feature counts of a task's rows: of all, and of those labelled good."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in arrow_rows(it, 4 << 20):
        found = [features(t) for t in batch.column(0).to_pylist()]
        is_good = batch.column(1).to_pylist()
        if found:
            raw += np.bincount(np.concatenate(found), minlength=BUCKETS)
            good += np.bincount(np.concatenate([np.empty(0, np.int64), *[f for f, g in zip(found, is_good) if g]]), minlength=BUCKETS)
    release(_features, _hash)
    at = np.flatnonzero(raw)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])


def labelled_rows(labels: DataFrame) -> DataFrame:
    """(label_id, good) of the labelled documents; one labelled both ways counts as not good."""
    return checkpoint(labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        (F.min("quality") == 1).alias("good")))


class Ratio:
    """The log ratio of target and raw probability of each of the ``BUCKETS`` features, add-one smoothed.

    Without target counts the ratio is 0 throughout.
    """

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.target, self.total = target, target.sum()
        self.raw = np.log((raw + 1) / (raw.sum() + BUCKETS))
        self.ratio = np.log((target + 1) / (self.total + BUCKETS)) - self.raw if self.total else np.zeros(BUCKETS)

    def score(self, found: np.ndarray) -> float:
        return float(self.ratio[found].sum())

    def score_without(self, found: np.ndarray, copies: int) -> float:
        """The score by the model without ``copies`` texts of the same features."""
        bucket, n = np.unique(found, return_counts=True)
        total = self.total - copies * len(found)
        if total <= 0:
            return 0.0
        return float((n * (np.log((self.target[bucket] - copies * n + 1) / (total + BUCKETS)) - self.raw[bucket])).sum())


def sent(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few enough rows."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    """Raw counts over all documents, target counts over all labelled good."""
    good = sent(labelled.filter("good").select("label_id"))
    rows = columns(docs, id_col, text_col).toDF("doc_id", "text").join(good, F.col("doc_id") == F.col("label_id"), "left")
    rows = rows.select(utf8("text").alias("text"), F.col("label_id").isNotNull().alias("good"))
    counts = rows.mapInArrow(_count, "bucket long, raw long, good long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    table = checkpoint(counts).toPandas()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table["bucket"]], target[table["bucket"]] = table["raw"], table["good"]
    return Ratio(raw, target)


def _score(ratio: Ratio):
    """Adds the log importance, the one without the row's own words and the number of features, computed from
    the last two columns, the copies of the text among the target's and the text, which it drops."""
    def run(it):
        for batch in arrow_rows(it, 4 << 20):
            found = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            copies = batch.column(batch.num_columns - 2).to_pylist()
            value = [ratio.score(f) for f in found]
            without = [ratio.score_without(f, c) if c else v for f, c, v in zip(found, copies, value)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(value, pa.float64()), pa.array(without, pa.float64()), pa.array([len(f) for f in found], pa.int64())],
                names=[*batch.schema.names[:-2], "log_importance", "without_own", "n_features"])
        release(_features, _hash)

    return run


def best_cut(counts: list[tuple[int, bool, int]]) -> float:
    """The log importance that puts the most labelled rows on the right side: the middle of the best bins.
    Without rows of both classes nothing is cut off."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for bin_, is_good, n in counts:
        (good if is_good else bad)[bin_] += n
    if not good.sum() or not bad.sum():
        return -np.inf
    right = good.sum() - np.cumsum(good) + np.cumsum(bad)
    best = np.flatnonzero(right == right.max())
    middle = best[len(best) // 2]
    return float(np.sinh(((middle + 1) / BINS * 2 - 1) * SPAN))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7,
             extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(scored, k): a row per row of ``docs`` with log_importance, n_features, its Gumbel key and ``kept``.

    Null and empty texts have no features, a log importance of 0 and are judged like any other.  Rows
    equal in id and text share one key and are kept or dropped together, so ties can add to the k.  The
    order of equal keys is that of a hash.  Columns named in ``extra`` come along.  The cut
    is chosen on ``without_own``, the log importance by a model without the words of the row and of all rows
    of equal text, if it is labelled good; on other rows the two are the same.
    """
    labelled = labelled_rows(labels)
    ratio = fit(docs, labelled, id_col, text_col)
    row = [F.col(c) for c in extra]
    tie = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), utf8(text_col))
    text = F.xxhash64(utf8(text_col))
    rows = docs.select(*row, F.col(f"`{id_col}`").alias("doc_id"), tie.alias("tie"), text.alias("_same"), utf8(text_col).alias("_text"))
    known = sent(labelled)
    copies = checkpoint(rows.select("doc_id", "_same").join(known, F.col("doc_id") == F.col("label_id")).filter("good").groupBy(
        F.col("_same").alias("_copied")).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1"))
    rows = rows.join(known, F.col("doc_id") == F.col("label_id"), "left").join(sent(copies), F.col("_same") == F.col("_copied"), "left")
    own = F.when(F.col("good"), F.coalesce("_copies", F.lit(1))).otherwise(0).cast("long")
    rows = rows.select(*extra, "doc_id", "tie", "good", own.alias("_own"), "_text")
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("log_importance", T.DoubleType()),
                           T.StructField("without_own", T.DoubleType()), T.StructField("n_features", T.LongType())])
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "tie"), 11).cast("double") + 0.5) * (2.0 ** -53)
    scored = checkpoint(rows.mapInArrow(_score(ratio), schema).withColumn(
        "key", F.col("log_importance") - F.log(-F.log(uniform))))
    at = F.least(F.greatest(F.floor((F.asinh("without_own") / SPAN + 1) / 2 * BINS), F.lit(0)), F.lit(BINS))
    seen = scored.filter("good is not null").groupBy(at.alias("bin"), "good").count()
    cut = best_cut([tuple(r) for r in seen.collect()])  # at most two rows a bin
    drawn = F.coalesce("good", F.lit(True)) if np.isfinite(cut) else F.lit(True)
    k = scored.filter(drawn & (F.col("log_importance") > cut)).count()
    keys = scored.filter(drawn).select((-F.col("key")).alias("minus_key"), "tie", F.lit(1).cast("long").alias("one"))
    ranked = running_totals(keys, ["minus_key", "tie"], ["one"])
    last = ranked.filter(F.col("one_before") == k - 1).select("minus_key", "tie").first()
    kept = F.lit(False) if last is None else (F.col("key") > -last[0]) | (F.col("key") == -last[0]) & (F.col("tie") <= last[1])
    return scored.withColumn("kept", drawn & kept).drop("good"), k


def keep_resampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the resample keeps, with all their columns as they were."""
    docs = numbered(docs)
    scored, _ = resample(docs, labels, extra=("_file", "_row"), **options)
    return kept_rows(docs, checkpoint(scored.filter("kept").select("_file", "_row")))
