"""Spelling variant grouping by a trie of letter-group frequencies.

Every word is the vector of how often it uses each of ``GROUPS`` letter groups.  The trie arranges words by
successive counts.  A word at an edit distance of one has a vector with at most one letter more (a
surplus) and at most one less (a deficit), so the search walks down the trie with a budget of one each, and
verifies the words of the leaves that it reaches.

The trie is spread over tasks.  Its upper part is a directory of prefixes: a node with more than ``PAGE`` words is
inner, and its children are looked at one level down; a node with fewer is a page.  Words walk down the
directory level by level, in joins by the node, and come to each page with what is left of their budget;
inside a page, a task builds the rest of the trie and searches it depth first for all its words together.
Words that share a whole vector and are too many for a page are dealt over several pages, each searched by all
that come.  Near words never leave a task as pairs: a task gives each word's count and its best form.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwell.llm.common import arrow_rows, columns
from planwell.session import checkpoint, discard

MIN_LETTERS, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: one run in so many, by the hash of document and run, loses a letter
DAMAGE = 199
#: letter groups, in the order of the trie's levels: the letters a-z by falling frequency, then eight groups of others
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
OTHERS = 8
GROUPS = len(LETTERS) + OTHERS
#: words of a page, and of a node that is compared without going further down
PAGE, FEW = 20_000, 24
#: distinct words a task counts before it passes them on
TOGETHER = 400_000

_group = np.array([LETTERS.index(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % OTHERS for c in range(256)])
_kept = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def damaged_runs(doc_id: str, text: str) -> Counter:
    """Counts of the runs of one text, lower-cased, after the fixed damage; as latin-1 bytes, one a code point."""
    runs = Counter(text.encode("latin-1", "replace").translate(_kept).split())
    start = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= MIN_LETTERS:
            out[run] += n
    return out


def _count(it):
    counts: Counter = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()

    for batch in arrow_rows(it, 4 << 20):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update(damaged_runs(doc_id, text))
            if len(counts) > TOGETHER:
                yield from out()
    if counts:
        yield from out()


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter-group counts of words of one byte a code point; counts beyond 255 share the last value."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = _group[np.frombuffer(b"".join(words), np.uint8)]
    cells = np.repeat(np.arange(len(words)), lengths) * GROUPS + letters
    return np.minimum(np.bincount(cells, minlength=len(words) * GROUPS), 255).reshape(-1, GROUPS).astype(np.uint8)


def near(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced character parts the two."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def search(words: np.ndarray, asked: np.ndarray, level: int, budgets: np.ndarray, found) -> None:
    """Calls ``found(query numbers, word numbers)`` for all leaves of the trie over the vectors ``words`` that the
    vectors ``asked`` reach, both from ``level`` on, within ``budgets`` (surplus and deficit left, a row a query).

    Words must be sorted by their vectors, so that each node is a range of them.
    """
    def walk(low: int, high: int, at: int, alive: np.ndarray, left: np.ndarray):
        while at < GROUPS and high - low > FEW and len(alive):
            counts = words[low:high, at]
            if counts[0] != counts[-1]:
                break
            # a node with one child: no call of its own
            step = asked[alive, at].astype(np.int16) - np.int16(counts[0])
            left = left - np.stack([np.maximum(step, 0), np.maximum(-step, 0)], axis=1)
            ok = (left >= 0).all(axis=1)
            alive, left, at = alive[ok], left[ok], at + 1
        if not len(alive):
            return
        if at == GROUPS:
            found(np.repeat(alive, high - low), np.tile(np.arange(low, high), len(alive)))
            return
        if high - low <= FEW:
            for i in range(0, len(alive), 4096):
                some, rest = alive[i:i + 4096], left[i:i + 4096]
                step = asked[some, None, at:].astype(np.int16) - words[None, low:high, at:]
                more = np.maximum(step, 0).sum(axis=2)
                ok = (more <= rest[:, :1]) & (more - step.sum(axis=2) <= rest[:, 1:])
                q, w = np.nonzero(ok)
                if len(q):
                    found(some[q], low + w)
            return
        counts = words[low:high, at]
        starts = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]])
        mine = asked[alive, at].astype(np.int16)
        for start, end in zip(starts, [*starts[1:], high - low]):
            step = mine - np.int16(counts[start])
            new = left - np.stack([np.maximum(step, 0), np.maximum(-step, 0)], axis=1)
            ok = (new >= 0).all(axis=1)
            if ok.any():
                walk(low + int(start), low + int(end), at + 1, alive[ok], new[ok])

    if len(words) and len(asked):
        walk(0, len(words), level, np.arange(len(asked)), budgets.astype(np.int16))


def search_page(words: list[str], counts: list[int], asked: list[str], budgets: np.ndarray, level: int):
    """(query number, near words, count and text of its best near word) of all queries that have one here."""
    coded = [w.encode("latin-1") for w in words]
    v = vectors(coded)
    order = np.lexsort(v.T[::-1])
    v, coded, n = v[order], [coded[i] for i in order], [counts[i] for i in order]
    queries = [q.encode("latin-1") for q in asked]
    many, best = Counter(), {}

    def found(q, w):
        for i, j in zip(q.tolist(), w.tolist()):
            if near(queries[i], coded[j]):
                many[i] += 1
                key = (-n[j], coded[j])
                if i not in best or key < best[i]:
                    best[i] = key

    for i in range(0, len(queries), PAGE):
        part = queries[i:i + PAGE]
        search(v, vectors(part), level, budgets[i:i + PAGE], lambda q, w, i=i: found(q + i, w))
    return [(i, many[i], -best[i][0], best[i][1].decode("latin-1")) for i in sorted(many)]


def _search_group(key, pages, queries):
    page, level = key
    words, counts = pages["word"].to_pylist(), pages["n"].to_pylist()
    asked = queries["asked"].to_pylist()
    left = np.stack([queries["surplus"].to_numpy(), queries["deficit"].to_numpy()], axis=1).reshape(-1, 2)
    rows = search_page(words, counts, asked, left, level.as_py()) if words and asked else []
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({"word": pa.array([asked[i] for i in cols[0]], pa.string()), "near": pa.array(cols[1], pa.int64()),
                     "form_n": pa.array(cols[2], pa.int64()), "form": pa.array(cols[3], pa.string())})


def _with_vector(it):
    for batch in it:
        words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        v = vectors(words) if words else np.zeros((0, GROUPS), np.uint8)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in v], pa.binary())], names=["word", "n", "v"])


def near_words(vocabulary: DataFrame, page: int = PAGE) -> DataFrame:
    """word, n_near, form_n and form (its near word of largest n, of equal ones the smallest) of the words of
    ``vocabulary`` (word, n; each word once, of code points up to U+00FF) that have a near word in it."""
    words = checkpoint(vocabulary.select("word", "n").mapInArrow(_with_vector, "word string, n long, v binary"))
    # the directory, level by level: only words below nodes that are too full for a page are looked at again
    walkers = words.select("word", "v", F.lit(b"").alias("node"), F.lit(1).alias("surplus"), F.lit(1).alias("deficit"))
    below, pages, come, spent = words.withColumn("node", F.lit(b"")), [], [], []
    for level in range(GROUPS + 1):
        sizes = checkpoint(below.groupBy("node").agg(F.count(F.lit(1)).alias("size")))
        full = level < GROUPS
        small = sizes.filter(F.col("size") <= page) if full else sizes
        # beyond the last level only words of one vector are left: as many pages as they need
        parts = small.select("node", F.ceil(F.col("size") / page).cast("int").alias("parts"))
        here = below.join(parts, "node").select("word", "n", "node", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"))
        pages.append(here.select("word", "n", "node", "part", F.lit(level).alias("level")))
        met = walkers.join(parts, "node").select("word", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                                 F.lit(level).alias("level"), "surplus", "deficit")
        come.append(met)
        inner = sizes.filter(F.col("size") > page).select("node") if full else sizes.limit(0).select("node")
        if not full or inner.isEmpty():
            break
        at = F.expr(f"substring(v, {level + 1}, 1)")
        below = checkpoint(below.join(inner, "node", "left_semi").withColumn("node", F.concat("node", at)))
        mine = F.conv(F.hex(at), 16, 10).cast("int")
        # a count one lower spends the surplus, one higher the deficit
        steps = F.array(*[F.struct(F.lit(d).alias("d")) for d in (-1, 0, 1)])
        moved = walkers.join(inner, "node", "left_semi").select("*", F.explode(steps).alias("step")).select(
            "word", "v", "node", (mine + F.col("step.d")).alias("c"),
            F.when(F.col("step.d") == -1, F.col("surplus") - 1).otherwise(F.col("surplus")).alias("surplus"),
            F.when(F.col("step.d") == 1, F.col("deficit") - 1).otherwise(F.col("deficit")).alias("deficit"))
        moved = moved.filter("surplus >= 0 and deficit >= 0 and c between 0 and 255")
        moved = moved.withColumn("node", F.concat("node", F.unhex(F.lpad(F.hex("c"), 2, "0")))).drop("c")
        nodes = below.select("node").distinct()
        walkers = checkpoint(moved.join(nodes, "node", "left_semi"))
        spent += [sizes, below, walkers]
    homes, guests = pages[0], come[0]
    for p, c in zip(pages[1:], come[1:]):
        homes, guests = homes.unionByName(p), guests.unionByName(c)
    page_key = F.concat(F.hex("node"), F.lit("/"), F.col("part").cast("string"))
    homes = homes.select("word", "n", page_key.alias("page"), "level")
    guests = guests.select(F.col("word").alias("asked"), "surplus", "deficit", page_key.alias("at_page"), F.col("level").alias("at_level"))
    found = homes.groupBy("page", "level").cogroup(guests.groupBy("at_page", "at_level")).applyInArrow(
        _search_group, "word string, near long, form_n long, form string")
    best = F.min_by(F.struct("form_n", "form"), F.struct(-F.col("form_n"), F.col("form")))
    out = checkpoint(found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.*"))
    discard(words, *spent)
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``MIN_LETTERS`` code points that occur at least ``min_count`` times."""
    rows = columns(docs, id_col, text_col).toDF("doc_id", "text").filter("text is not null")
    rows = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the end of each chain of ``forms`` (word, form), by doubling.

    A chain's counts grow by ``FORM_RATIO`` at every step, so that it has no loop and few steps.
    """
    links = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = checkpoint(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(links)
        links = moved
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE) -> DataFrame:
    """word, form, root (text), n, n_near, form_n (long): a row per word of the corpus.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of the whole texts, A-Z lower-cased, after the fixed
    damage; those of at least ``MIN_LETTERS`` code points that occur ``MIN_COUNT`` times stay.  A form is the near word of
    largest n (ties: the smallest), if its n is at least ``FORM_RATIO`` times the word's; a root is the last
    of the forms, the word itself where there is none.  Null and empty texts have no words; a null id counts as an
    empty one in the hash; repeated rows count as often as they come.  An empty table gives no row.
    """
    vocabulary = checkpoint(word_counts(docs, id_col, text_col))
    rows = vocabulary.join(near_words(vocabulary, page), "word", "left")
    is_form = F.col("form_n") >= FORM_RATIO * F.col("n")
    rows = checkpoint(rows.select("word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  F.when(is_form, F.col("form_n")).alias("form_n")))
    roots = last_forms(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
