"""The training-data queries, one per operator, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planwell.llm import (collision, exact_dedup, hmm, line_dedup, mixing, packing, quality, secret_scan, setsketch, sharding, toxicity,
                          variants, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op3_source_mixing")
def op3(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@register("op9_exact_dedup", """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op9(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register("op8_setsketch_near_dedup", """WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
  s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) = 1 THEN words
      ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
  reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON p.a = r.other)
  SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
  FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""")
def op8(spark, sf_dir):
    return setsketch.near_groups(table(spark, sf_dir, "documents"), shingle=2).drop("_set", "_root")


@register("op10_importance_resampling")
def op10(spark, sf_dir):
    scored, _ = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "log_importance", "n_features", "key", "kept")


@register("op1_collision_counting", """WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
  n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
  SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
  FROM reach r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id""")
def op1(spark, sf_dir):
    return collision.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op4_line_dedup")
def op4(spark, sf_dir):
    return line_dedup.repeated_units(table(spark, sf_dir, "documents"), unit="all").drop("_row")


@register("op7_extendible_sharding")
def op7(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


@register("op5_hidden_markov_scores")
def op5(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


def _secret_sql() -> str:
    """Each rule's matches with their places, from the lengths of matches and of the text between them."""
    rules, parts = (*secret_scan.BASE_RULES, *secret_scan.MORE_RULES), []
    for number, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {number} AS number, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
          'start': coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
          'size': length(m[i]), 'value': length(v[i])}})) AS s, {r.least} AS least
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS v,
          string_split_regex(t, '{pattern}') AS b FROM d)""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  spans AS (SELECT doc_id, number, kind, CAST(s.start AS BIGINT) AS start, CAST(s.start + s.size AS BIGINT) AS stop
            FROM ({" UNION ALL ".join(parts)}) WHERE s.value >= least),
  done AS (SELECT doc_id, count(*) FILTER (WHERE number = 0) AS n_assign, count(*) FILTER (WHERE number = 1) AS n_access,
    count(*) FILTER (WHERE number = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (WHERE number < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans FROM spans GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN done USING (doc_id)"""


@register("op6_trigram_secret_scan", _secret_sql())
def op6(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


@register("op11_spelling_variants")
def op11(spark, sf_dir):
    return variants.variant_groups(table(spark, sf_dir, "documents"))


@register("op12_toxicity")
def op12(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
