"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression follows a Boolean trigram query that every match satisfies.  The index
lists, for each trigram of these queries, the documents that hold it; intersecting the lists gives the
documents worth matching, and only these are matched against the rule.  A rule without a mandatory
trigram is matched against every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwell.llm.common import columns
from planwell.session import checkpoint


@dataclass(frozen=True)
class Rule:
    """A match counts if ``group`` of it (0: all) has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the three base rules, and formats that issuers of keys have published
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)

#: a character class or an optional part with more alternatives than this ends a literal stretch
ALTERNATIVES = 8


def _literals(node) -> set[str] | None:
    """All strings that a part of a parsed expression can match, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= ALTERNATIVES:
        return {chr(a).lower() for _, a in arg}
    if op == "SUBPATTERN":
        return _joined(arg[-1])
    if op == "BRANCH":
        parts = [_joined(b) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
        inner = _joined(arg[2])
        return None if inner is None else inner | {""}
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _literals(node)
        if more is None:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What any match holds, in lower case: every clause of the list; of a clause one alternative; of an
    alternative all trigrams.  An empty list means that nothing is mandatory."""
    from re import _parser

    clauses, stretch = [], {""}

    def end():
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in stretch}
        if frozenset() not in grams:  # alternatives that hold all of another one add nothing
            clauses.append(sorted((g for g in grams if not any(o < g for o in grams)), key=sorted))

    for node in _parser.parse(pattern):
        more = _literals(node)
        if more is not None and len(stretch) * len(more) <= ALTERNATIVES * 8:
            stretch = {a + b for a in stretch for b in more}
        else:
            end()
            stretch = {""} if more is None else more
    end()
    return clauses


def build_index(docs: DataFrame, rules) -> DataFrame:
    """(gram, doc_id): the documents that hold a trigram of the rules' queries, in lower case."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for alt in clause for g in alt})
    if not grams:
        return docs.select(F.lit("").alias("gram"), "doc_id").limit(0)
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("low"), g))
    return docs.select("doc_id", F.lower("text").alias("low")).select(F.explode(held).alias("gram"), "doc_id").distinct()


def candidates(index: DataFrame, rules) -> DataFrame:
    """(candidate, kinds): documents whose lists satisfy the query of at least one rule, with these rules."""
    lists = index.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))

    def holds(rule: Rule) -> Column:
        clauses = [reduce(Column.__or__, [reduce(Column.__and__, [F.array_contains("grams", g) for g in sorted(alt)]) for alt in clause])
                   for clause in trigram_query(rule.pattern)]
        return reduce(Column.__and__, clauses)

    kinds = F.array_compact(F.array(*[F.when(holds(r), F.lit(r.kind)) for r in rules if trigram_query(r.pattern)]))
    return lists.select(F.col("doc_id").alias("candidate"), kinds.alias("kinds")).filter(F.size("kinds") > 0)


_SPAN = "struct<start:bigint,number:int,end:bigint,size:int>"

#: lengths that are added up one by one; sums of longer lists go by sums of stretches of this many
STRETCH, LEVELS = 32, 3


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(values: Column, levels: int = LEVELS) -> Column:
    """For each element of an array the sum of those before it.

    A stretch adds up its own elements; where it starts is the same question for the sums of the stretches,
    so the work of a list of n is about n * STRETCH / 2 up to millions of elements.
    """
    if not levels:
        return F.transform(values, lambda _, i: _total(F.slice(values, F.lit(1), i)))
    last = F.floor((F.size(values) - 1) / STRETCH).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * STRETCH + 1, F.lit(STRETCH)))

    def placed(parts):
        starts = _let(F.transform(parts, _total), lambda sums: _before(sums, levels - 1))
        inner = F.zip_with(parts, starts, lambda part, start: F.transform(
            part, lambda _, i: start + _total(F.slice(part, F.lit(1), i))))
        return F.flatten(inner)

    return F.when(F.size(values) > 0, _let(stretches, placed)).otherwise(F.array().cast("array<bigint>"))


def _spans(rule: Rule, number: int) -> Column:
    """A rule's matches as structs (start, number, end, size of the group): places follow from the lengths of
    the matches and of what lies between them."""
    sizes, gaps, values = F.col(f"sizes{number}"), F.col(f"gaps{number}"), F.col(f"values{number}")
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda gap, size: (gap + size).cast("long"))

    def placed(before):
        def span(start, i):
            start = start + F.element_at(gaps, i + 1)
            return F.struct(start.alias("start"), F.lit(number).alias("number"), (start + F.element_at(sizes, i + 1)).alias("end"),
                            F.element_at(values, i + 1).alias("size"))

        return F.transform(before, span)

    spans = _let(_let(steps, lambda steps: _before(steps)), placed)
    return F.when(F.size(sizes) > 0, F.filter(spans, lambda s: s["size"] >= rule.least)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_rules=MORE_RULES) -> DataFrame:
    """A row per row of ``docs``: doc_id and ``found``, the spans (start, number, end, size) of all rules in
    order of start and rule; start and end are code points of the whole text, end exclusive.

    Matches of a rule are leftmost and do not overlap; those of different rules may.  Null texts are empty
    and have none.  A null or repeated doc_id does no harm: lists name documents by id, and every row of
    a listed id is matched by its own text.
    """
    rules = (*BASE_RULES, *more_rules)
    rows = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    worth = checkpoint(candidates(checkpoint(build_index(rows, rules)), rules))
    joined = rows.join(worth, F.col("doc_id").eqNullSafe(F.col("candidate")), "left")
    text, none = F.col("text"), F.array().cast("array<string>")
    found, between, value = {}, {}, {}
    for n, r in enumerate(rules):
        matches = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        found[f"found{n}"] = F.when(F.array_contains("kinds", r.kind), matches).otherwise(none) if trigram_query(r.pattern) else matches
        some = F.size(f"found{n}") > 0
        between[f"gaps{n}"] = F.transform(F.when(some, F.split(text, r.pattern, -1)).otherwise(none), F.length)
        between[f"sizes{n}"] = F.transform(F.col(f"found{n}"), F.length)
        value[f"values{n}"] = F.transform(F.when(some, F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))).otherwise(none),
                                          F.length) if r.group else F.col(f"sizes{n}")
    measured = joined.withColumns(found).withColumns(between).withColumns(value)
    each = [_spans(r, n) for n, r in enumerate(rules)]
    return measured.select("doc_id", F.sort_array(F.concat(*each)).alias("found"))


def report(docs: DataFrame, more_rules=MORE_RULES, **names) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    rules = (*BASE_RULES, *more_rules)
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["number"] < len(BASE_RULES))

    def count(number):
        return F.size(F.filter("found", lambda s: s["number"] == number)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return scan(docs, more_rules=more_rules, **names).select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
