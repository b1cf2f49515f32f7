"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings: of the word and of its first four and five characters, so that
forms of a known stem are known too.  One dimension starts from how far a bucket parts toxic from other training rows
(signed root of the likelihood ratio), as the maximum would otherwise learn from whichever word the random start
puts first.  Filters of several widths run over the words, the maximum of each over the whole text feeds a logistic
output, and a two-parameter calibration on labelled rows that were not trained on makes the score a
probability.  Thresholds by language, from those rows as well, are a further result: the score never sees the language.

The model is fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled rows, drawn by a hash of their id.
One task streams over them, batch by batch, in each epoch.  Scoring reads every whole text in pieces,
so that a task holds one piece of a text and one batch at a time.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import arrow_rows, columns, utf8
from planwell.session import checkpoint, discard

#: labelled rows that the model is trained on, at most
SAMPLE_ROWS = 12_000
BUCKETS, DIM = 1 << 16, 12
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.15, 1e-4
#: size of the informed dimension at the start
START = 0.5
#: one labelled row in so many is kept from training, for the calibration and the thresholds
CALIBRATE = 8
BINS = 200
#: a language has a threshold of its own from so many calibration rows of each class
LEAST = 20
PIECE_BYTES, PIECE_WORDS = 1 << 20, 20_000
PAD = max(WIDTHS) - 1

_space = re.compile(rb"[\x09-\x0D\x20]")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def word_features(word: bytes) -> tuple[int, int, int]:
    """Buckets of a word in lower case without marks at its ends: the word, its first four and five characters."""
    bare = word.strip(_MARKS) or word
    text = bare.decode("utf-8", "replace").lower()
    return tuple(1 + zlib.crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) for x in (text, "4" + text[:4], "5" + text[:5]))


class _Words(dict):
    """word -> its number in this task's list of feature rows, kept between batches up to ``limit`` words."""

    limit = 120_000

    def __init__(self):
        super().__init__()
        self.rows = [(0, 0, 0)]  # number 0 is padding

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.rows)
        self.rows.append(word_features(word))
        return at


def pieces(text: bytes):
    """The words of a text, piece by piece; no word is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            found = _space.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].split()
        at = end


class Network:
    """Embeddings, filters and output weights; row 0 of the embeddings is padding and stays zero."""

    def __init__(self, seed: int = 12):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [r.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def inform(self, toxic_rows: np.ndarray, other_rows: np.ndarray, toxic: int, other: int) -> None:
        """Start the first dimension from the rows of either class that hold each bucket."""
        if not toxic or not other:
            return
        share = np.maximum(toxic_rows + other_rows, 1) / (toxic + other)
        a, b = np.maximum(toxic_rows, 1e-9), np.maximum(other_rows, 1e-9)
        ratio = 2 * (toxic_rows * np.log(a / (toxic * share)) + other_rows * np.log(b / (other * share)))
        signed = np.sign(toxic_rows / toxic - other_rows / other) * np.sqrt(np.maximum(ratio, 0))
        signed[0] = 0
        self.embed[:, 0] += (START * signed / max(signed.max(), 1e-9)).astype(np.float32)
        for f in self.filters:
            f[:, 0] = np.abs(f[:, 0])
        self.out = np.abs(self.out)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.base]

    def projections(self, rows: np.ndarray) -> np.ndarray:
        """What each word (a row of three buckets) adds to each filter at each of its places."""
        x = self.embed[rows].sum(axis=1)
        return np.concatenate([x @ f[j] for f in self.filters for j in range(len(f))], axis=1)

    def maxima(self, projected: np.ndarray) -> np.ndarray:
        """The maximum of every filter over the windows of consecutive words, given their projections."""
        out, at = [], 0
        for w in WIDTHS:
            n = len(projected) - w + 1
            z = projected[:n, at:at + FILTERS]
            for j in range(1, w):
                z = z + projected[j:j + n, at + j * FILTERS:at + (j + 1) * FILTERS]
            out.append(z.max(axis=0))
            at += w * FILTERS
        return np.concatenate(out)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.base[0]


class _Projected:
    """What the words numbered by a ``_Words`` add to the filters, computed once a word."""

    def __init__(self, network: Network):
        self.network, self.words = network, _Words()
        self.table = np.zeros((4096, sum(WIDTHS) * FILTERS), np.float32)
        self.known = 0

    def of(self, piece: list[bytes]) -> np.ndarray:
        ids = list(map(self.words.__getitem__, piece))
        rows = self.words.rows
        if len(rows) > len(self.table):
            grown = np.zeros((2 * len(rows), self.table.shape[1]), np.float32)
            grown[:self.known] = self.table[:self.known]
            self.table = grown
        if self.known < len(rows):
            self.table[self.known:len(rows)] = self.network.projections(np.array(rows[self.known:]))
            self.known = len(rows)
        return self.table[ids]

    def forget(self) -> None:
        """Start over if there are too many words."""
        if len(self.words) > self.words.limit:
            self.words.clear()
            self.words.rows[:] = [(0, 0, 0)]
            self.known = 0


def logits(network: Network, texts, seen: _Projected) -> np.ndarray:
    """The logit of each whole text, with two words of padding at its start and its end."""
    pooled = np.full((len(texts), len(network.bias)), -np.inf, np.float32)
    padding = np.zeros((PAD, seen.table.shape[1]), np.float32)
    for best, text in zip(pooled, texts):
        tail = padding
        for piece in pieces(text):
            for at in range(0, len(piece), PIECE_WORDS):
                seen.forget()
                rows = np.concatenate([tail, seen.of(piece[at:at + PIECE_WORDS])])
                np.maximum(best, network.maxima(rows), out=best)
                tail = rows[-PAD:]
        np.maximum(best, network.maxima(np.concatenate([tail, padding])), out=best)
    return network.logit(pooled)


# ------------------------------------------------------------------ training

def _token_rows(it):
    """The features of each labelled text: three 32-bit buckets a word, padding at both ends."""
    words = _Words()
    for batch in arrow_rows(it, 4 << 20):
        out = []
        for text in batch.column(2).to_pylist():
            if len(words) > words.limit:
                words.clear()
                words.rows[:] = [(0, 0, 0)]
            ids = [0] * PAD
            for piece in pieces(text):
                ids.extend(map(words.__getitem__, piece))
            ids.extend([0] * PAD)
            out.append(np.array([words.rows[i] for i in ids], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["order", "toxic", "words"])


class _Adagrad:
    def __init__(self, network: Network):
        self.seen = [np.full_like(p, 0.1) for p in network.parameters()]

    def step(self, parameters, gradients):
        for p, s, g in zip(parameters[1:], self.seen[1:], gradients[1:]):
            s += g * g
            p -= RATE * g / np.sqrt(s)
        rows, g = gradients[0]
        self.seen[0][rows] += g * g
        parameters[0][rows] -= RATE * (g / np.sqrt(self.seen[0][rows]) + DECAY * parameters[0][rows])


def train_batch(network: Network, optimizer: _Adagrad, docs: list[np.ndarray], toxic: np.ndarray) -> None:
    """One step on a batch of feature rows; the gradient of a maximum goes to its (first) window alone."""
    n_filters = len(network.bias)
    pooled, where = np.empty((len(docs), n_filters), np.float32), np.empty((len(docs), n_filters), np.int64)
    for i, rows in enumerate(docs):
        at = 0
        best, place = np.full(n_filters, -np.inf, np.float32), np.zeros(n_filters, np.int64)
        for start in range(0, len(rows) - PAD, PIECE_WORDS):  # windows overlap, so that none is lost between pieces
            x = network.embed[rows[start:start + PIECE_WORDS + PAD]].sum(axis=1)
            for k, (w, f) in enumerate(zip(WIDTHS, network.filters)):
                n = len(x) - w + 1
                z = x[:n] @ f[0]
                for j in range(1, w):
                    z += x[j:j + n] @ f[j]
                at = z.argmax(axis=0)
                top, mine = z[at, np.arange(FILTERS)], slice(k * FILTERS, (k + 1) * FILTERS)
                better = top > best[mine]
                best[mine][better], place[mine][better] = top[better], (start + at)[better]
        pooled[i], where[i] = best, place
    hidden = np.maximum(pooled + network.bias, 0)
    error = 1 / (1 + np.exp(-np.clip(hidden @ network.out + network.base[0], -30, 30))) - toxic
    to_hidden = (error[:, None] * network.out) * (hidden > 0)
    filter_grads, rows_at, rows_grad = [], [], []
    for k, (w, f) in enumerate(zip(WIDTHS, network.filters)):
        g = to_hidden[:, k * FILTERS:(k + 1) * FILTERS]
        grad = np.zeros_like(f)
        for j in range(w):
            hit = np.array([[rows[p + j] for p in where[i, k * FILTERS:(k + 1) * FILTERS]] for i, rows in enumerate(docs)])
            x = network.embed[hit].sum(axis=2)  # documents x filters x DIM
            grad[j] = np.einsum("ifd,if->df", x, g)
            back = g[:, :, None] * f[j].T[None]  # documents x filters x DIM
            rows_at.append(hit.reshape(-1))
            rows_grad.append(np.repeat(back.reshape(-1, DIM), 3, axis=0))
        filter_grads.append(grad / len(docs))
    at, values = np.concatenate(rows_at), np.concatenate(rows_grad)
    used, inverse = np.unique(at, return_inverse=True)
    total = np.zeros((len(used), DIM), np.float32)
    np.add.at(total, inverse, values)
    total[used == 0] = 0
    optimizer.step(network.parameters(), [(used, total), *filter_grads, to_hidden.mean(axis=0),
                                          (error[:, None] * hidden).mean(axis=0), np.array([error.mean()], np.float32)])


def _bucket_counts(it):
    """Rows of either class that hold each bucket, of a task; bucket 0 counts all rows."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in it:
        for label, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            counts[int(label > 0), np.union1d(np.frombuffer(words, np.int32), [0])] += 1
    at = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c[at]) for c in counts]], names=["bucket", "other", "toxic"])


def fit(sample: DataFrame) -> Network:
    """A network trained on (order, toxic, words): one task streams over the sorted sample in each epoch."""
    network = Network()
    seen = sample.mapInArrow(_bucket_counts, "bucket long, other long, toxic long").groupBy("bucket").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()  # at most BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    counts[:, seen["bucket"].to_numpy()] = seen[["other", "toxic"]].to_numpy().T
    network.inform(counts[1], counts[0], int(counts[1, 0]), int(counts[0, 0]))
    optimizer = _Adagrad(network)
    ordered = sample.repartition(1).sortWithinPartitions("order", "words")

    def epoch(it):
        docs, toxic = [], []

        def step():
            train_batch(network, optimizer, docs, np.array(toxic, np.float32))
            docs.clear()
            toxic.clear()

        for batch in arrow_rows(it, 4 << 20):
            for label, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                docs.append(np.frombuffer(words, np.int32).reshape(-1, 3))
                toxic.append(label)
                if len(docs) == BATCH:
                    step()
        if docs:
            step()
        values = [*network.parameters(), *optimizer.seen]
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in values], pa.binary()), pa.array(range(len(values)), pa.int32())], names=["v", "i"])

    if sample.isEmpty():
        return network
    for _ in range(EPOCHS):
        made = {r["i"]: r["v"] for r in ordered.mapInArrow(epoch, "v binary, i int").collect()}  # the model's own size
        for i, p in enumerate([*network.parameters(), *optimizer.seen]):
            p[...] = np.frombuffer(made[i], np.float32).reshape(p.shape)
    return network


# ------------------------------------------------------------------ scores

def _held_out(col: str):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5)) == 0


def _calibrate(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of the probability by Newton steps; unchanged without both classes."""
    if not weight[toxic == 1].sum() or not weight[toxic == 0].sum():
        return 1.0, 0.0
    positives, negatives = weight[toxic == 1].sum(), weight[toxic == 0].sum()
    target = np.where(toxic == 1, (positives + 1) / (positives + 2), 1 / (negatives + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        g = np.array([((p - target) * logit * weight).sum() + 1e-3 * (a - 1), ((p - target) * weight).sum()])
        h = p * (1 - p) * weight + 1e-9
        hess = np.array([[(h * logit * logit).sum() + 1e-3, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(float(a), 0.05), float(b)


def _thresholds(counts: DataFrame) -> DataFrame:
    """(_lang, lang_threshold): the bin with the best F1 among the calibration rows of each language with
    ``LEAST`` rows of both classes; the middle of the lowest and highest of equal ones."""
    from pyspark.sql import Window

    above = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    f1 = 2 * F.sum("good").over(above) / (F.sum("good").over(above) + F.sum("bad").over(above) + F.sum("good").over(whole))
    rows = counts.select("lang", "bin", f1.alias("f1"), F.sum("good").over(whole).alias("p"), F.sum("bad").over(whole).alias("q"))
    best = rows.filter((F.col("p") >= LEAST) & (F.col("q") >= LEAST)).withColumn("best", F.max("f1").over(whole)).filter("f1 = best")
    return best.groupBy(F.col("lang").alias("_lang")).agg(((F.min("bin") + F.max("bin")) / (2 * BINS)).alias("lang_threshold"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, score, predicted, lang_threshold, flagged.

    Labels are learned from rows of ``labels`` whose id is not held out (crc32 of the id as text, modulo 5,
    is not 0); an id labelled both ways counts as toxic, a null label or id as none.  A null id is not
    held out.  Null and empty texts, and texts of white space, are scored as one window of padding.  Rows
    with equal texts have equal scores.  Without labels of both classes the score follows the start weights and means nothing.
    ``flagged`` is score >= lang_threshold, which is 0.5 for a language with fewer than ``LEAST``
    calibration rows of either class; a null language counts as a language.
    """
    has_lang = lang_col in docs.columns
    rows = columns(docs, id_col, text_col, *([lang_col] if has_lang else []))
    rows = rows.toDF("doc_id", "text", "lang") if has_lang else rows.toDF("doc_id", "text").withColumn("lang", F.lit(None).cast("string"))
    rows = rows.withColumn("lang", F.col("lang").cast("string"))
    known = columns(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy(
        F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(12), F.col("label_id").cast("string"))
    known = checkpoint(known.filter(~_held_out("label_id")).select("label_id", "toxic", order.alias("order"), (F.pmod(order, F.lit(CALIBRATE)) == 0).alias("calibrate")))
    chosen = known.filter(~F.col("calibrate")).orderBy("order", "label_id").limit(sample_rows)
    # the sample's ids and labels (at most sample_rows rows) go to all tasks, so that texts stay where they are;
    # ids that repeat in ``docs`` bring their texts once each: still at most sample_rows texts are read as rows of the sample
    texts = rows.select("doc_id", utf8("text").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("label_id", "order", "toxic").agg(
        F.min("text").alias("text")).select("order", "toxic", "text")
    sample = checkpoint(texts.mapInArrow(_token_rows, "order long, toxic int, words binary"))
    network = fit(sample)
    discard(sample)

    def run(it):
        seen = _Projected(network)
        for batch in arrow_rows(it, 8 << 20):
            value = logits(network, batch.column(2).to_pylist(), seen).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["doc_id", "lang", "logit"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("logit", T.DoubleType())])
    scored = checkpoint(rows.select("doc_id", "lang", utf8("text").alias("text")).mapInArrow(run, schema))
    kept = known.filter("calibrate").select("label_id", "toxic")
    judged = checkpoint(scored.join(kept, F.col("doc_id") == F.col("label_id")).select("lang", "logit", "toxic"))
    cells = judged.groupBy(F.round(F.least(F.greatest("logit", F.lit(-40.0)), F.lit(40.0)), 1).alias("v"), "toxic").count().collect()  # at most 1,602 rows
    scale, shift = _calibrate(*(np.array([r[c] for r in cells], float) for c in ("v", "toxic", "count")))
    slope = F.least(F.greatest(F.col("logit") * scale + shift, F.lit(-40.0)), F.lit(40.0))
    score = 1 / (1 + F.exp(-slope))
    counts = judged.withColumn("bin", F.floor(score * BINS).cast("int")).groupBy("lang", "bin").agg(
        F.sum("toxic").alias("good"), F.sum(1 - F.col("toxic")).alias("bad"))
    limits = checkpoint(_thresholds(counts))
    out = scored.withColumn("score", score).join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn(
        "lang_threshold", F.coalesce("lang_threshold", F.lit(0.5)))
    return out.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_threshold",
                      (F.col("score") >= F.col("lang_threshold")).alias("flagged"))
