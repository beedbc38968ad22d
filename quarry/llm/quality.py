"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import time
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, hash_sample, materialize, n_words, text_of


class Rule(NamedTuple):
    """``sql`` is true of a text to reject; {t} is the text, {w} its number of words. ``duck``
    is the same for the checking engine where its functions have other names."""

    name: str
    sql: str
    duck: str


def _count(pattern: str) -> tuple[str, str]:
    return "regexp_count({t}, r'" + pattern + "')", "len(regexp_extract_all({t}, '" + pattern + "'))"


def _rule(name: str, pattern: str, test: str) -> Rule:
    spark, duck = _count(pattern)
    return Rule(name, f"{spark} {test}", f"{duck} {test}")


RULES = (
    Rule("no_words", "{w} < 1", "{w} < 1"),
    _rule("few_letters", r"\p{L}+", "< 0.5 * {w}"),
    Rule("long_words", "length({t}) > 40 * {w}", "length({t}) > 40 * {w}"),
    _rule("symbols", r"[#$%&*~^=<>]{3}", "> 0.1 * {w}"),
    Rule("bars", "length({t}) - length(replace({t}, '|', '')) > 0.1 * {w}", "length({t}) - length(replace({t}, '|', '')) > 0.1 * {w}"),
    _rule("shouting", r"[A-ZÀ-ÖØ-Þ]{2,}", "> 0.3 * {w}"),
    _rule("exclaiming", r"!!", "> 0.2 * {w}"),
    Rule(
        "stuttering",
        r"regexp_count({t}, r'(?<!\S)(\S++)(?=\s++\1(?!\S))') > 0.2 * {w}",
        r"len(list_filter(list_zip(regexp_extract_all({t}, '\S+'), regexp_extract_all({t}, '\S+')[2:]), lambda z: z[1] = z[2])) > 0.2 * {w}",
    ),
    Rule("repeated_lines", "size(split({t}, '\n')) >= 5 and size(array_distinct(split({t}, '\n'))) < 0.4 * size(split({t}, '\n'))", "len(string_split({t}, '\n')) >= 5 and len(list_distinct(string_split({t}, '\n'))) < 0.4 * len(string_split({t}, '\n'))"),
)


def test_of(rule: Rule, text: str, words: str) -> Column:
    return F.expr(rule.sql.replace("{t}", f"`{text}`").replace("{w}", f"`{words}`"))


def by_rejection_per_cost(costs: list[float], patterns: dict[int, int]) -> list[int]:
    """The order of rules, by index: next is always the one that rejects most for its cost of what
    the ones before it leave. patterns: how many rows the rules of each bit mask reject. Rules
    that reject nothing more come last, cheapest first."""
    left, out = dict(patterns), []
    rest = set(range(len(costs)))
    while rest:
        rejects = {i: sum(n for mask, n in left.items() if mask >> i & 1) for i in rest}
        best = min(rest, key=lambda i: (-rejects[i] / costs[i], costs[i], i))
        out.append(best)
        rest.remove(best)
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return out


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = 2000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", least_seconds: float = 0.05) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share it rejects) in the order of a run: most rejections per cost
    first, of what the rules before leave (:func:`by_rejection_per_cost`), as measured on a
    sample of about ``sample_rows`` rows. A rule's cost is the median of three runs over the
    sample, repeated until one takes ``least_seconds`` more than a run without a rule. The order
    changes what a run costs, never what it decides."""
    picked = hash_sample(docs, id_col, sample_rows, seed).select(text_of(text_col).alias("t"))
    picked = materialize(picked.withColumn("w", n_words(F.col("t"))).repartition(1), "sample")  # after the filter: only the sample goes to one task
    mask = reduce(lambda a, b: a + b, [F.when(test_of(r, "t", "w"), F.lit(1 << i)).otherwise(0) for i, r in enumerate(rules)])
    patterns = {r[0]: r[1] for r in picked.groupBy(mask.alias("mask")).count().collect()}  # at most 2 ** rules and sample_rows rows
    n = max(1, sum(patterns.values()))

    def took(test: Column | None, times: int) -> float:
        rows = picked.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))
        value = F.length("t") + F.col("again") if test is None else F.length("t") + F.col("again") + test.cast("int")
        each = []
        for _ in range(3):
            began = time.perf_counter()
            rows.agg(F.sum(value)).collect()
            each.append(time.perf_counter() - began)
        return sorted(each)[1]

    costs, base = [], {}
    for r in rules:
        times = 1
        while True:
            base.setdefault(times, took(None, times))
            more = took(test_of(r, "t", "w"), times) - base[times]
            if more >= least_seconds or times >= 16:
                break
            times *= 4
        costs.append(max(more, 1e-6) / times / n)
    shares = [sum(k for mask, k in patterns.items() if mask >> i & 1) / n for i in range(len(rules))]
    return [(rules[i], costs[i], shares[i]) for i in by_rejection_per_cost(costs, patterns)]


def cascade(order) -> str:
    """SQL of a struct ``x`` of a text and its words; CASE tries a rule only where those before it pass."""
    return "case " + " ".join(f"when {r.sql.replace('{t}', 'x.t').replace('{w}', 'x.w')} then false" for r in order) + " else true end"


def judged(docs: DataFrame, name: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text", order=None, only_kept: bool = False) -> DataFrame:
    """``docs`` with a struct ``name`` of ``w``, a text's number of words, and ``keep``.

    The struct comes from a generator over an array of one element: whatever reads it later,
    the text is taken, its words are counted and the rules are tried once a row; a plain
    column would be put into filter and projection alike and counted anew by each rule.
    """
    order = [r for r, _, _ in plan_cascade(docs, rules, id_col=id_col, text_col=text_col)] if order is None else order
    quoted = "`" + text_col.replace("`", "``") + "`"
    one = f"transform(array(coalesce(cast({quoted} as string), '')), t -> named_struct('t', t, 'w', regexp_count(t, r'\\S+')))"
    judge = f"transform({one}, x -> named_struct('w', x.w, 'keep', {cascade(order)}))"
    return docs.select(*[col(c) for c in docs.columns], F.expr(f"explode({f'filter({judge}, v -> v.keep)' if only_kept else judge})").alias(name))


def quality(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", only_kept: bool = False) -> DataFrame:
    """``doc_id, n_words, keep`` for each row of ``docs``, or for those kept.

    A row is kept if no rule rejects its text. Null and empty texts, and texts of white
    space alone, have no words and are rejected. Null ids and repeated rows are judged like
    any row; an empty table gives no rows; rules of equal merit are tried in their own order.
    """
    (v,) = fresh(docs, "judged")
    return judged(docs, v, rules, id_col, text_col, only_kept=only_kept).select(col(id_col).alias("doc_id"), F.col(v)["w"].cast("long").alias("n_words"), F.col(v)["keep"].alias("keep"))


def keep_good(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with their own columns."""
    (v,) = fresh(docs, "judged")
    return judged(docs, v, rules, id_col, text_col, only_kept=True).select(*[col(c) for c in docs.columns])


def oracle(view: str = "documents", rules=RULES) -> str:
    tests = " or ".join("(" + r.duck.replace("{t}", "t").replace("{w}", "w") + ")" for r in rules)
    return f"select doc_id, w as n_words, not ({tests}) as keep from (select doc_id, t, cast(len(regexp_extract_all(t, '\\S+')) as bigint) as w from (select doc_id, coalesce(text, '') as t from {view}))"
