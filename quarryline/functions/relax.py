"""What to try when a query finds nothing: relaxed forms, suggestions, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import CJK, STOP_WORDS, let, query_terms, strip


def _content_terms(terms: Column) -> Column:
    """Terms with an ASCII letter, digit or underscore that are no stop words."""
    return F.filter(terms, lambda t: t.rlike("[A-Za-z0-9_]") & ~t.isin(*STOP_WORDS))


def _plural(word: Column) -> Column:
    """The other number of an English word."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), F.substring(word, F.lit(1), n - 1))
        .otherwise(F.concat(word, F.lit("s")))
    )


def _word(x: Column) -> Column:
    return x.rlike("^[A-Za-z][A-Za-z0-9_-]{2,}$")


def term_variants(term: Column, last: Column) -> Column:
    """Forms of a term: itself, split at hyphens, and for the last term the other number."""
    none = F.array().cast("array<string>")

    def forms(v):
        t, parts = v["t"], v["parts"]
        tail = F.element_at(parts, -1)
        head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")
        tails = F.concat(F.array(tail), F.when(v["last"] & _word(tail), F.array(_plural(tail))).otherwise(none))
        split = F.concat(F.array(F.array_join(parts, " ")), F.transform(tails, lambda x: F.concat_ws(" ", head, x)))
        split = F.when(F.size(parts) > 1, split).otherwise(none)
        plural = F.when(v["last"], F.array(_plural(t))).otherwise(none)
        return F.when(_word(t), F.array_distinct(F.concat(F.array(t), split, plural))).otherwise(F.array(t))

    parts = F.filter(F.split(term, "[-_]"), lambda p: p != "")
    return let(F.struct(term.alias("t"), last.alias("last"), parts.alias("parts")), forms)


def relaxed_queries(query: Column) -> Column:
    """Up to twelve forms of a query to try in order; empty unless some, not all, terms carry meaning."""

    def build(v):
        cjk = F.exists(v["terms"], lambda t: t.rlike(f"[{CJK}]"))
        base = F.when(cjk, v["ascii"]).otherwise(F.slice(v["ascii"], 1, 5))
        usable = (F.size(v["terms"]) >= 2) & (F.size(v["ascii"]) > 0) & (F.size(v["ascii"]) < F.size(v["terms"])) & (F.size(base) <= 5)

        def combine(b):
            start = F.array(F.lit("")).cast("array<string>")

            def step(acc, i):
                variants = term_variants(F.get(b, i), i == F.size(b) - 1)
                grown = F.flatten(F.transform(acc, lambda p: F.transform(variants, lambda x: F.when(p == "", x).otherwise(F.concat_ws(" ", p, x)))))
                return F.slice(grown, 1, 12)

            return F.array_distinct(F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step))

        return F.when(usable, let(base, combine)).otherwise(F.array().cast("array<string>"))

    return let(query_terms(query), lambda t: let(F.struct(t.alias("terms"), _content_terms(t).alias("ascii")), build))


def _longest_first(values: Column) -> Column:
    return F.transform(F.sort_array(F.transform(values, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def refinement(query: Column) -> Column:
    """Struct (over_constrained, suggested_queries, n_terms, mixed_script) for a query without results."""

    def build(v):
        ascii_, runs = v["ascii"], v["runs"]
        mixed = (F.size(ascii_) > 0) & (F.size(runs) > 0)
        offered = F.concat(F.slice(ascii_, 1, 2), F.slice(runs, 1, 2))
        kept = F.slice(F.array_distinct(F.filter(offered, lambda x: F.lower(x) != v["q"])), 1, 3)
        return F.struct(((F.size(v["terms"]) >= 4) | mixed).alias("over_constrained"), kept.alias("suggested_queries"), F.size(v["terms"]).alias("n_terms"), mixed.alias("mixed_script"))

    runs = _longest_first(F.array_distinct(F.regexp_extract_all(query, F.lit(f"([{CJK}]{{2,}})"), F.lit(1))))
    terms = query_terms(query)
    return let(terms, lambda t: let(F.struct(t.alias("terms"), _longest_first(F.array_distinct(_content_terms(t))).alias("ascii"), runs.alias("runs"), F.lower(strip(query)).alias("q")), build))


def diagnosis(freshness: Column) -> Column:
    """Why an empty result may or may not be trusted."""
    return F.when(freshness == "fresh", "fresh_miss").when(freshness.isin("stale", "missing"), "stale_or_missing_coverage").otherwise("coverage_not_confirmed")


def next_action(has_selector: Column, n_results: Column, freshness: Column) -> Column:
    """Struct (kind, reason) of what to do next; null if there is nothing to do."""
    act = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    return (
        F.when(freshness.isin("stale", "missing"), act("check-coverage-then-retry", "stale_or_missing_coverage"))
        .when((n_results == 0) & has_selector, act("check-coverage-then-retry", "zero_results_with_unconfirmed_selector_coverage"))
        .when(n_results == 0, act("choose-selector-then-check-coverage", "zero_results_without_selector"))
    )
