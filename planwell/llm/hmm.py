"""Language-model scores by a hidden Markov model over word classes.

The ``FREQUENT`` most frequent training tokens are classes of their own; all others share ``SUFFIXES`` classes by
their last bytes, inside which a token has the probability (c + 1) / (class count + class types + 1), the
last share being for all unseen ones.  The states emit classes.  Baum-Welch runs over all training
documents: tasks sum expected counts, which meet by class, and every round's model is their normalisation
with a prior of the class shares.  Scores are exact likelihoods by the scaled forward recursion over
whole texts.  Only the bounded class tables are sent to tasks; counts of rare tokens are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import arrow_rows, columns, to_batch, utf8
from planwell.session import checkpoint

STATES, ROUNDS = 8, 5
FREQUENT, SUFFIXES = 60_000, 2048
#: weight of the class shares in each state's emissions, in tokens; of the even spread in its transitions
PRIOR, MOVE_PRIOR = 2000.0, 10.0
#: tokens worked through together, which bounds a task's memory
TOGETHER = 1_000_000
END = b""


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIXES


def _count(it):
    counts: Counter = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         names=["token", "c"])
        counts.clear()

    for batch in arrow_rows(it, 4 << 20):
        for text in batch.column(0).to_pylist():
            counts.update(text.lower().split())
            counts[END] += 1
            if len(counts) > 400_000:
                yield from out()
    if counts:
        yield from out()


def _suffixes(it):
    for batch in it:
        cls = pa.array([suffix_class(w) for w in batch.column(0).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([cls, batch.column(1)], names=["class", "c"])


class Vocabulary:
    """The bounded part of the training counts: frequent tokens and the totals of the suffix classes."""

    def __init__(self, words: list[bytes], counts, class_count, class_types, tokens: int, types: int):
        self.words, self.counts = words, np.asarray(counts, np.int64)
        self.class_count, self.class_types = class_count, class_types
        self.tokens, self.types = tokens, types

    @property
    def classes(self) -> int:
        return len(self.words) + SUFFIXES

    def shares(self) -> np.ndarray:
        n = np.concatenate([self.counts, self.class_count]) + 1.0
        return n / n.sum()


def vocabulary(train: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(token, c) of all training tokens as a table, and its bounded summary.  ``train`` is a column of texts."""
    table = checkpoint(train.mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))
    tokens, types = table.agg(F.sum("c"), F.count(F.lit(1))).first()
    # the lowest count that at most FREQUENT tokens reach: as many levels of it can matter
    least, n = None, 0
    for r in table.groupBy("c").count().orderBy(F.desc("c")).limit(FREQUENT + 1).collect():
        n += r["count"]
        if n > FREQUENT:
            break
        least = r["c"]
    often = F.col("token") == F.lit(END)
    if least is not None:
        often = often | (F.col("c") >= least)
    top = sorted(table.filter(often).collect(), key=lambda r: (-r["c"], r["token"]))
    words = [bytes(r["token"]) for r in top]
    if END not in words:
        words.append(END)
    counts = [r["c"] for r in top] + [0] * (len(words) - len(top))
    totals = table.filter(~often).mapInArrow(_suffixes, "class long, c long").groupBy("class").agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("types")).collect()
    count, kinds = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in totals:
        count[r["class"]], kinds[r["class"]] = r["c"], r["types"]
    return table, Vocabulary(words, counts, count, kinds, int(tokens or 0), int(types))


def _sequences(v: Vocabulary, schema: pa.Schema):
    """Class sequence of each text, its rare tokens with their numbers, and sums over what is known here."""
    index = {w: i for i, w in enumerate(v.words)}
    log_count = np.log10(v.counts + 1.0)
    known = v.counts > 0
    within = np.log10(v.class_count + v.class_types + 1.0)
    first = len(v.words)

    def run(it):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in arrow_rows(it, 4 << 20):
            out = {f.name: [] for f in schema}
            for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                words = text.lower().split()
                words.append(END)
                ids = [index.get(w, -1) for w in words]
                seq = np.array(ids, np.int64)
                at = np.flatnonzero(seq < 0)
                rare = [words[i] for i in at.tolist()]
                common = seq[seq >= 0]
                if rare:
                    classes = np.array([suffix_class(w) for w in rare], np.int64)
                    seq[at] = first + classes
                times = Counter(rare)
                values = (doc_id, held, row, len(seq), int(known[common].sum()), float(log_count[common].sum()),
                          float(within[classes].sum()) if rare else 0.0, seq.astype(np.uint16).tobytes(), list(times), list(times.values()))
                for name, value in zip(out, values):
                    out[name].append(value)
                row += 1
            yield to_batch(out, schema)

    return run


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = (x.astype(np.float32) for x in (start, move, emit))


def first_model(shares: np.ndarray, states: int, seed: int = 5) -> Model:
    """States that tend to stay, with the class shares as emissions, each with noise of its own."""
    rng = np.random.Generator(np.random.PCG64(seed))
    emit = shares[:, None] * np.exp(0.5 * rng.standard_normal((len(shares), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _step_major(seqs: list[np.ndarray]):
    """The sequences, longest first, as one array step by step: classes, rows of each step, place and owner."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    lengths = np.array([len(seqs[i]) for i in order])
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1), "left")
    begin = np.concatenate([[0], np.cumsum(active)])
    step = np.concatenate([np.arange(n) for n in lengths])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = begin[step] + owner
    classes, owners = np.empty(begin[-1], np.int64), np.empty(begin[-1], np.int64)
    classes[place] = np.concatenate([seqs[i] for i in order])
    owners[place] = owner
    return order, classes, owners, active, begin


def forward(seqs: list[np.ndarray], m: Model, backward: bool = False):
    """Natural-log likelihood of each sequence; with ``backward`` also the expected counts of
    (emissions by class and state, transitions, starts), all by the scaled recursions."""
    order, classes, owners, active, begin = _step_major(seqs)
    seen = m.emit[classes]
    alpha, scale = np.empty_like(seen), np.empty(len(seen), np.float32)
    state = None
    for t, n in enumerate(active.tolist()):
        a, b = begin[t], begin[t + 1]
        state = seen[a:b] * (m.start if state is None else state[:n] @ m.move)
        scale[a:b] = s = state.sum(1)
        state = state / s[:, None]
        alpha[a:b] = state
    total = np.empty(len(seqs))
    total[order] = np.bincount(owners, weights=np.log(scale.astype(np.float64)), minlength=len(seqs))
    if not backward:
        return total
    k = m.move.shape[0]
    moved, next_ = np.zeros((k, k), np.float64), None
    for t in range(len(active) - 1, -1, -1):
        a, b, n = begin[t], begin[t + 1], int(active[t])
        beta = np.ones((n, k), np.float32)
        if next_ is not None:
            moved += alpha[a : a + len(next_)].T @ next_
            beta[: len(next_)] = next_ @ m.move.T
        next_ = seen[a:b] * beta / scale[a:b, None]
        alpha[a:b] *= beta
    emitted = np.stack([np.bincount(classes, weights=alpha[:, i], minlength=len(m.emit)) for i in range(k)], 1)
    return total, emitted, moved * m.move, alpha[: active[0]].sum(0, dtype=np.float64)


def _groups(seqs: list[np.ndarray]):
    """Numbers of sequences of like length that together have about TOGETHER tokens."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    group, n = [], 0
    for i in order:
        group.append(i)
        n += len(seqs[i])
        if n >= TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


def _expect(m: Model):
    """Expected counts of a task's sequences: a row per class and its counts by state; then, numbered on,
    a row per state of transitions and one of starts."""
    k, c = m.move.shape[0], len(m.emit)

    def run(it):
        sums = np.zeros((c + k + 1, k))
        for batch in it:
            seqs = [np.frombuffer(b, np.uint16) for b in batch.column(0).to_pylist()]
            for group in _groups(seqs):
                _, emitted, moved, started = forward([seqs[i] for i in group], m, True)
                sums[:c] += emitted
                sums[c : c + k] += moved
                sums[c + k] += started
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(sums[at, i]) for i in range(k)]],
                                         names=["class", *[f"s{i}" for i in range(k)]])

    return run


def baum_welch(sequences: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Train on all rows of ``sequences`` (one binary column of 16-bit classes)."""
    m, c = first_model(shares, states), len(shares)
    cols = [f"s{i}" for i in range(states)]
    schema = "class long, " + ", ".join(f"{x} double" for x in cols)
    for _ in range(rounds):
        rows = sequences.mapInArrow(_expect(m), schema).groupBy("class").agg(*[F.sum(x).alias(x) for x in cols]).toPandas()
        sums = np.zeros((c + states + 1, states))
        sums[rows["class"].to_numpy()] = rows[cols].to_numpy()  # a row per class and state: bounded
        emitted, moved, started = sums[:c], sums[c : c + states], sums[c + states]
        emit = (emitted + PRIOR * shares[:, None]) / (emitted.sum(0) + PRIOR)
        move = (moved + MOVE_PRIOR / states) / (moved.sum(1, keepdims=True) + MOVE_PRIOR)
        m = Model((started + 1) / (started.sum() + states), move, emit)
    return m


def _likelihood(m: Model):
    def run(it):
        for batch in it:
            seqs = [np.frombuffer(b, np.uint16) for b in batch.column(1).to_pylist()]
            out = np.zeros(len(seqs))
            for group in _groups(seqs):
                out[group] = forward([seqs[i] for i in group], m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out / np.log(10))], names=["row", "model"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with crc32(doc_id as text) mod 7 = 2 are held out, all others train; a null doc_id trains.  Null
    texts are empty and have the end token alone.  Repeated rows train and score one by one.  Without
    training rows every token is unseen and the model stays at its start.  An empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = columns(docs, id_col, text_col).toDF("doc_id", "text").select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), utf8("text").alias("text"))
    table, v = vocabulary(rows.filter("not held_out").select("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("row", "n_tokens", "n_known")],
                           *[T.StructField(c, T.DoubleType()) for c in ("log_counts", "log_within")],
                           T.StructField("seq", T.BinaryType()), T.StructField("rare", T.ArrayType(T.BinaryType())),
                           T.StructField("times", T.ArrayType(T.LongType()))])
    seqs = checkpoint(rows.mapInArrow(_sequences(v, to_arrow_schema(schema)), schema))
    model = baum_welch(seqs.filter("not held_out").select("seq"), v.shares(), states, rounds)
    scored = checkpoint(seqs.select("row", "seq").mapInArrow(_likelihood(model), "row long, model double"))
    each = seqs.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    rare = each.join(table, "token").groupBy("row").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_counts"))
    out = seqs.drop("seq", "rare", "times").join(scored, "row").join(rare, "row", "left")
    counts = F.coalesce("rare_counts", F.lit(0.0))
    base = F.col("log_counts") + counts - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + v.types + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                      F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
                      (F.col("model") + counts - F.col("log_within")).alias("score"))
