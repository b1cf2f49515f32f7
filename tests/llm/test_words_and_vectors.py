"""Spelling variants, toxicity and whitening against brute force, with nulls, empties, ties, repeats and odd columns."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from planwell.llm import toxicity, variants, whitening
from planwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word string, n int"


# ------------------------------------------------------------------ 11 spelling variants

def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_az(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: [x for x in n if distance_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variant_rows(df, **options):
    return sorted(tuple(r) for r in variants.variant_groups(df, **options).collect())


def by_word(rows):
    return sorted(rows, key=lambda r: r[0])


VARIANT_TEXTS = [
    (1, "Colour " * 200 + "Color-colors, colours color color color color " * 3, "en", "x", 1),
    (2, "colour colou colou colou colou colou coulor " * 6, "en", None, None),
    (2, "colour colou colou colou colou colou coulor " * 6, "en", None, None),
    (3, None, "en", "x", 1), (4, "", None, "x", 1), (None, "Éclairs éclairs eclairs eclairs×÷eclairs " * 9, "fr", "x", 1),
    (8, "lettersx " * 6 + "letters " * 40 + "letter " * 250, "en", "x", 1),
    (5, "banana bananb bananc " * 7 + "aaaaaa " * 30 + "a" * 700 + " ", "es", "x", 1),
    (6, ("a" * 700 + " ") * 6 + ("a" * 699 + "b ") * 40 + ("a" * 699 + " ") * 210, "es", "x", 1),
    (7, "Ωμέγα straße_strasse naïveté ÀÀÀÀÀÀ àààààà " * 12, None, "x", 1),
]


def test_variants_by_brute_force(spark):
    df = spark.createDataFrame(VARIANT_TEXTS, SCHEMA)
    want = brute_variants([r[:2] for r in VARIANT_TEXTS])
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms
    assert by_word(variant_rows(df)) == by_word(want)


def test_variants_of_random_words_over_many_pages(spark):
    r = random.Random(3)
    words = {"".join(r.choice("ae") for _ in range(r.choice([6, 7]))) for _ in range(150)}  # many share a vector
    rows = [(i, " ".join(w for w in words for _ in range(r.choice([0, 1, 6])))) for i in range(12)]
    want = by_word(brute_variants(rows))
    assert sum(w[4] for w in want) > 500
    for page in (20_000, 7):
        assert by_word(variant_rows(spark.createDataFrame(rows, "doc_id long, text string"), page=page)) == want


def test_variants_of_no_rows(spark):
    assert variant_rows(spark.createDataFrame([], SCHEMA)) == []
    assert variant_rows(spark.createDataFrame([(1, "short words", "x", "y", 1)], SCHEMA)) == []


def test_variants_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert by_word(tuple(r) for r in QUERIES["op11_spelling_variants"](spark, SF).collect()) == by_word(brute_variants(docs))


def test_page_search_reaches_every_near_word():
    r = random.Random(5)
    words = sorted({"".join(r.choice("etxé") for _ in range(r.choice([3, 4, 5]))) for _ in range(400)})
    counts = [r.randrange(1, 9) for _ in words]
    got = {words[i]: (many, n, form) for i, many, n, form in variants.search_page(words, counts, words, np.ones((len(words), 2), int), 0)}
    for w in words:
        near = [(-c, x) for x, c in zip(words, counts) if distance_one(w, x)]
        assert got.get(w) == ((len(near), -min(near)[0], min(near)[1]) if near else None)


# ------------------------------------------------------------------ 12 toxicity

def toxic_corpus(n=400):
    r = random.Random(12)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("aeinorst") for _ in range(r.choice([2, 4, 6]))) for _ in range(r.choice([20, 60, 200]))]
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 40):
                words[r.randrange(len(words))] = r.choice(["Nastyword", "vileword!", "hatewordish"])
        rows.append((i, " ".join(words), "de" if i % 3 else None, "x", i))
        labels.append((i, int(bad)))
    return rows, labels


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_is_learned_and_held_out_rows_are_not_read(spark):
    rows, labels = toxic_corpus()
    extra = [(1000, None, "de", "x", 1), (1001, "", None, "x", 1), (1002, " \n ", "fr", None, 1), (None, "Nastyword here", "de", "x", 1),
             (5, rows[5][1], "de", "x", 5), (1003, "calm words " * 150_000 + "nastyword", "de", "x", 1), (1004, "calm words " * 20_000, "de", "x", 1)]
    docs = spark.createDataFrame(rows + extra, SCHEMA).repartition(3)
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.5) and r["flagged"] == (r["score"] >= r["lang_threshold"]) for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    toxic = dict(labels)
    unseen = [i for i in toxic if held(i)]
    right = sum((score[i] >= 0.5) == bool(toxic[i]) for i in unseen)
    assert right >= 0.95 * len(unseen)
    assert score[1000] == score[1001] == score[1002] < 0.5
    assert score[1003] > 0.5 > score[1004]  # the last of 300,001 words counts
    # wrong labels of held-out rows change nothing
    other = [(i, 1 - t if held(i) else t) for i, t in labels] + [(None, 1), (3, None)]
    again = toxicity.score_documents(docs, spark.createDataFrame(other, "doc_id long, toxic int")).collect()
    assert {r["doc_id"]: r["score"] for r in again} == pytest.approx(score, abs=1e-12)


def test_toxicity_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(spark.createDataFrame([], SCHEMA), none).collect() == []
    rows = spark.createDataFrame([(1, "some text", None, "x", 1)], SCHEMA)
    assert toxicity.score_documents(rows, none).count() == 1
    assert toxicity.score_documents(rows.select("doc_id", "text"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 1


def test_logits_by_brute_force():
    network = toxicity.Network(5)
    network.embed[1:] *= 30
    r = random.Random(1)
    texts = [" ".join(r.choice(["ab", "cdefgh", "cdefij", "é!", "KL"]) for _ in range(n)).encode().lower() for n in (0, 1, 2, 3, 9, 70)]
    pad = [(0, 0, 0)] * 2
    want = []
    for t in texts:
        x = [sum(network.embed[b] for b in rows) for rows in [*pad, *map(toxicity.word_features, t.split()), *pad]]
        pooled = [max(sum(float(x[i + j] @ f[j][:, c]) for j in range(w)) for i in range(len(x) - w + 1))
                  for w, f in zip(toxicity.WIDTHS, network.filters) for c in range(toxicity.FILTERS)]
        want.append(np.maximum(np.array(pooled) + network.bias, 0) @ network.out + network.base[0])
    old = toxicity.PIECE_BYTES, toxicity.PIECE_WORDS, toxicity._Words.limit
    try:
        for piece_bytes, piece_words, limit in (old, (10, 3, 2), (1, 1, 1)):
            toxicity.PIECE_BYTES, toxicity.PIECE_WORDS, toxicity._Words.limit = piece_bytes, piece_words, limit
            assert toxicity.logits(network, texts, toxicity._Projected(network)) == pytest.approx(np.array(want), rel=1e-4, abs=1e-4)
    finally:
        toxicity.PIECE_BYTES, toxicity.PIECE_WORDS, toxicity._Words.limit = old


def test_gradient_of_a_batch_lowers_its_loss():
    r = np.random.default_rng(2)
    docs = [r.integers(1, 50, (n, 3)).astype(np.int32) for n in (5, 9, 30, 44)]
    toxic = np.array([1, 0, 1, 0], np.float32)
    network = toxicity.Network(1)
    optimizer = toxicity._Adagrad(network)

    def loss():
        z = np.array([network.logit(network.maxima(network.projections(d))) for d in docs])
        return float(np.mean(np.log1p(np.exp(-z * (2 * toxic - 1)))))

    first = loss()
    for _ in range(60):
        toxicity.train_batch(network, optimizer, docs, toxic)
    assert loss() < 0.3 * first


# ------------------------------------------------------------------ 13 whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"


def usable(e):
    return e is not None and None not in e and np.isfinite(e).all()


def check_whitening(got, rows, k=16):
    """Everything against exact sums and numpy's eigenvectors of the covariance."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e] for i, e in rows if usable(e)}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    total = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[float(Fraction(v[j]) - Fraction(total[j], n)) for j in range(d)] for v in fit])
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    assert collections.Counter(r["vec_id"] for r in got) == {i: k for i in x}
    by_id = collections.defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r["whitened"]
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], total))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
    ids = sorted(x)
    w = np.array([[by_id[i][c] for c in range(1, k + 1)] for i in ids])
    z = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(x[i], total)] for i in ids]) @ basis[:, :k] / np.sqrt(values[:k])
    at = {tuple(x[i]): j for j, i in enumerate(ids)}
    sample = w[[at[v] for v in fit]]
    assert np.abs(np.cov(sample.T, bias=True) - np.eye(k)).max() < 1e-9
    return w, z, values


def test_whitening_by_brute_force(spark):
    r = np.random.default_rng(13)
    base = r.normal(0, 1, (60, 12)) * np.linspace(0.3, 3, 12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, [None, *rows[0][1][1:]]), (104, [float("nan"), *rows[0][1][1:]]),
             (105, [float("inf"), *rows[0][1][1:]]), (106, [300.0] + [0.0] * 11)]
    df = spark.createDataFrame([(i, e, None, 5, "x") for i, e in rows], VECTORS).repartition(4)
    w, z, _ = check_whitening(whitening.whiten(df, components=9).collect(), rows, 9)
    assert np.abs(np.abs(w) - np.abs(z)).max() < 1e-7


def test_whitening_query_and_a_repeated_eigenvalue(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    w, z, _ = check_whitening(QUERIES["op13_whitening"](spark, SF).collect(), rows)
    assert np.abs(np.abs(w) - np.abs(z)).max() < 1e-6
    cross = [(2 * i + (s > 0), [s * float(i == j) for j in range(5)] + [0.0]) for i in range(5) for s in (-1, 1)]
    df = spark.createDataFrame([(i, e, 1, 1, "x") for i, e in cross], VECTORS)
    _, _, values = check_whitening(whitening.whiten(df).collect(), cross)
    assert np.allclose(values[:5], values[0])


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    same = [(i, [0.5, 0.25], 1, 1, "x") for i in range(4)]
    assert whitening.whiten(spark.createDataFrame(same, VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, 1, "x")], VECTORS)).collect() == []
    two = same + [(9, [1.0, 0.25], 1, 1, "x"), (None, [1.0, 0.25], 1, 1, "x"), (7, [1.0], 1, 1, "x")]
    got = whitening.whiten(spark.createDataFrame(two, VECTORS)).collect()
    assert len(got) == 6 and {r["component"] for r in got} == {1} and {abs(r["whitened"]) for r in got} == {1.0}


def test_characteristic_polynomial_and_roots():
    r = np.random.default_rng(4)
    a = r.integers(-50, 50, (7, 5)).astype(object)
    m = a @ a.T  # rank 5
    p = 2147483629
    got = whitening.characteristic_mod(m, p)
    want = np.round(np.poly(m.astype(float)))[::-1]
    exact = [Fraction(1)]  # Faddeev-LeVerrier
    b = np.array([[Fraction(int(i == j)) for j in range(7)] for i in range(7)], object)
    for k in range(1, 8):
        c = -sum((m @ b)[i, i] for i in range(7)) / k
        exact.append(c)
        b = m @ b + c * np.array([[Fraction(int(i == j)) for j in range(7)] for i in range(7)], object)
    exact = [int(c) for c in exact[::-1]]
    assert got.tolist() == [c % p for c in exact] and exact[-1] == want[-1]
    values = np.linalg.eigvalsh(m.astype(float))[::-1]
    for k in range(1, 6):
        assert whitening.largest_root(exact, k) / 2.0 ** whitening.ROOT_BITS == pytest.approx(values[k - 1], rel=1e-12)
    assert whitening.largest_root(exact, 6) == 0
    assert whitening.largest_root([4, -4, 1], 2) == 2 << whitening.ROOT_BITS  # (x - 2)^2


def test_exact_products_of_large_entries():
    r = np.random.default_rng(9)
    x = r.integers(-(1 << 61), 1 << 61, (50, 3))
    total, square = whitening.exact_products(x)
    o = x.astype(object)
    assert total.tolist() == o.sum(axis=0).tolist() and square.tolist() == (o.T @ o).tolist()
