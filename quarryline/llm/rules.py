"""Quality rules: text statistics and a decision list learned from labels.

All statistics are native expressions over whole texts.  The decision list is
learned by sequential covering.  A rule is a conjunction of thresholds that
marks bad documents: it is grown condition by condition by information gain on
two thirds of the labelled rows, pruned on the other third, and kept if it holds
there; the rows that it covers go, and the next rule is learned.  Every step is
one aggregation over all labelled rows that brings a count per statistic and
threshold to the driver, however many rows there are.  The list comes out as one
ordered ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import SPACED_WORD, let, stash

_SHARE = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95)
#: Statistics that rules may test, as expressions on the columns of ``text_stats``, with their thresholds.
FEATURES: dict[str, tuple[str, tuple[float, ...]]] = {
    "words": ("n_words", (10, 20, 30, 50, 80, 120, 200, 400, 800, 1600, 3200)),
    "mean_word": ("word_chars / n_words", (2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 10)),
    "symbol_share": ("n_symbols / word_chars", _SHARE),
    "dup_line_share": ("n_dup_lines / n_lines", _SHARE),
    "repeat_share": ("n_repeat_words / n_words", _SHARE),
    "upper_share": ("n_upper / word_chars", _SHARE),
    "bang_share": ("n_bang / n_words", _SHARE),
    "digit_share": ("n_digits / word_chars", _SHARE),
    "distinct_share": ("n_distinct / n_words", (*_SHARE, 0.99)),
}


def _removed(text: Column, pattern: str) -> Column:
    """Code points that the pattern's matches cover."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array."""
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def marked(h):
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s):
            at = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
            return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

        def covered(acc, i):
            return F.struct((acc["n"] + i + 3 - F.greatest(acc["to"], i)).alias("n"), (i + 3).alias("to"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        total = let(order, lambda s: F.aggregate(twins(s), zero, covered, lambda acc: acc["n"]))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), total).otherwise(0)

    return let(hashes, marked).cast("long")


def text_stats(text: Column) -> Column:
    """Struct of counts over a whole text; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(F.regexp_extract_all(t, F.lit(SPACED_WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        _removed(t, r"[#*$%&|<>]+").alias("n_symbols"),
        _removed(t, r"[A-Z]+").alias("n_upper"),
        _removed(t, r"[!]+").alias("n_bang"),
        _removed(t, r"[0-9]+").alias("n_digits"),
    )


def with_stats(docs: DataFrame, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds the statistics as columns, named with ``prefix``; columns of the same names are replaced."""
    s = f"{prefix}__stats"
    names = {"n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_distinct": "w.n_distinct", "n_lines": "l.n_lines", "n_upper": "n_upper", "n_bang": "n_bang", "n_digits": "n_digits"}
    held = docs.withColumn(s, text_stats(F.col(text_col)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {prefix + n for n in names}]
    return held.select(*kept, *(F.col(f"`{s}`.{path}").alias(prefix + n) for n, path in names.items()))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = feature(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that none of them matches is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        verdict = None
        for rule in self.rules:
            hit = _all(rule)
            verdict = F.when(hit, False) if verdict is None else verdict.when(hit, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)

    def __str__(self) -> str:
        return "\n".join([f"if {' and '.join(map(str, r))}: reject" for r in self.rules] + ["else: keep"])


def feature(name: str) -> Column:
    """A statistic as a double; 0 where its divisor is 0."""
    top, _, bottom = FEATURES[name][0].partition(" / ")
    x = F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, x / F.col(bottom)).otherwise(0.0) if bottom else x


def _all(rule) -> Column:
    hit = F.lit(True)
    for c in rule:
        hit = hit & c.column()
    return hit


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good))) if bad else 0.0


def _best(rows: DataFrame) -> Condition | None:
    """The condition of most information gain over the rows (columns bad and one bin per statistic)."""
    names = list(FEATURES)
    cells = rows.select("bad", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"bin_{n}").alias("bin")) for i, n in enumerate(names)))).alias("c"))
    counts = {(r["f"], r["bin"]): (r["bad"], r["n"] - r["bad"]) for r in cells.groupBy("c.f", "c.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()}
    best, chosen = 1e-9, None
    for i, n in enumerate(names):
        edges = FEATURES[n][1]
        table = [counts.get((i, b), (0, 0)) for b in range(len(edges) + 1)]
        bad, good = sum(x[0] for x in table), sum(x[1] for x in table)
        low = [0, 0]
        for b, edge in enumerate(edges):
            low = [low[0] + table[b][0], low[1] + table[b][1]]
            for above, (p, q) in ((True, (bad - low[0], good - low[1])), (False, tuple(low))):
                if p + q < bad + good and (g := _gain(p, q, bad, good)) > best:
                    best, chosen = g, Condition(n, above, float(edge))
    return chosen


def learn_rules(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.6, least_covered: int = 3) -> DecisionList:
    """Learns a decision list against label 0.

    ``stats`` has ``id_col`` and the columns of ``with_stats``.  Ids labelled
    twice count twice; null ids, labels other than 0 and 1, and labels without a
    document teach nothing.  Without bad rows the list is empty.
    """
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    used = sorted({c for top, *_ in FEATURES.values() for c in top.split(" / ")})
    known = stats.select(F.col(id_col).alias("id"), *used).join(y, "id")
    bins = {f"bin_{n}": sum(((feature(n) > e).cast("int") for e in edges), F.lit(0)) for n, (_, edges) in FEATURES.items()}
    known = known.withColumns(bins).withColumns({"bad": (F.col("y") == 0).cast("int"), "prune": F.pmod(F.xxhash64("id"), F.lit(3)) == 0})
    left = stash(known.select("bad", "prune", *used, *bins))
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            c = _best(left.where(~F.col("prune") & _all(rule)))
            if c is None or c in rule:
                break
            rule.append(c)
        if not rule:
            break
        forms = [rule[: k + 1] for k in range(len(rule))]
        held = left.where("prune").agg(*(F.sum((_all(r) & (F.col("bad") == v)).cast("int")).alias(f"s{k}_{v}") for k, r in enumerate(forms) for v in (0, 1))).first()
        worth = []
        for k, r in enumerate(forms):
            good, bad = held[f"s{k}_0"] or 0, held[f"s{k}_1"] or 0
            worth.append(((bad - good) / (bad + good) if bad + good else -1.0, bad, -k))
        value, bad, k = max(worth)
        if bad < least_covered or (value + 1) / 2 < least_precision:
            break
        rules.append(tuple(forms[-k]))
        left = left.where(~_all(rules[-1]))
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
