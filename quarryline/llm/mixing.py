"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight, at most ``max_epochs``
times its own size; what a small source cannot take is shared again among the
others.  A source takes as many complete epochs as fit in its target.  What is
left is filled by sampling without replacement: every document draws the key
``-ln(u) / w`` from a hash of its id and its quality weight, documents are taken
by rising key, and the prefix sum of their sizes meets the budget.  The document
on the line is taken in part, so each source ends at its target.

The prefix sum never sorts a whole source.  Keys fall into ``bins`` by a monotone
rule, and those of the bin in which the budget ends into ``bins`` finer ones; the
sizes are summed with partial aggregation, and only the one fine bin on the line is
sorted, some four-millionth of a source at the default.  What comes out is the line
itself, one row a source, to which every document is compared where it lies: no
document's row is moved, and texts are counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import SPACED_WORD, stash

_T = "__mix_"


def word_count(text: Column) -> Column:
    """Words between blanks; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))), F.lit(0)).cast("long")


def letter_weight(text: Column) -> Column:
    """Default quality weight, 0.5 to 1.5: rises with the share of letters in the text."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.when(n > 0, F.lit(0.5) + letters / n).otherwise(F.lit(0.5))


def sampling_key(doc_id: Column, weight: Column, seed: str = "") -> Column:
    """Exponential key of a document, the same on every run; smaller is taken earlier."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return -F.log((h + 0.5) / float(2**52)) / weight


def source_targets(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target, epochs, rest).

    One row a source, so the unpartitioned windows sort the sources only.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    level = level.withColumn("level", F.first(fits, ignorenulls=True).over(all_rows))
    target = F.round(F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")), 6)
    out = level.select("source", "source_size", target.alias("target"))
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return out.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))


def _starts(hist: DataFrame, plan: DataFrame, bin_col: str) -> DataFrame:
    """``plan`` with the bin in which a source's rest ends (``cut``), and the words before it (``start``).

    ``hist``: source, ``bin_col``, words.  ``plan``: source, rest and others; the rest counts from the first bin on.
    """
    line = Window.partitionBy("source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = hist.withColumn("begin", F.coalesce(F.sum("words").over(line), F.lit(0)))
    joined = starts.alias("h").join(plan.alias("p"), F.expr("h.source <=> p.source"), "right")
    reached = F.when(F.col("h.begin") <= F.col("p.rest"), F.struct(F.col(f"h.{bin_col}").alias("cut"), F.col("h.begin").alias("start")))
    found = joined.groupBy(*(F.col(f"p.{c}").alias(c) for c in plan.columns)).agg(F.max(reached).alias("at"))
    return found.select(*plan.columns, "at.cut", "at.start")


def line_of_sources(keyed: DataFrame, max_epochs: float) -> DataFrame:
    """One row a source: source_size, target, epochs, and the document on the line with the words taken of it.

    ``keyed``: source, id, size, key, bin, fine, row.
    """
    hist = stash(keyed.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    plan = source_targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    coarse = stash(_starts(hist, plan, "bin").withColumnRenamed("cut", "cut_bin").withColumn("rest", F.col("rest") - F.coalesce("start", F.lit(0))).drop("start"))
    on = lambda a, b, *more: F.expr(" AND ".join([f"{a}.source <=> {b}.source", *more]))
    inside = keyed.alias("k").join(coarse.alias("c"), on("k", "c", "k.bin = c.cut_bin")).select("k.*")
    fine_hist = stash(inside.groupBy("source", "fine").agg(F.sum("size").alias("words")))
    fine = stash(_starts(fine_hist, coarse, "fine").withColumnRenamed("cut", "cut_fine"))
    last = keyed.alias("k").join(fine.alias("c"), on("k", "c", "k.bin = c.cut_bin", "k.fine = c.cut_fine")).select("k.*", "c.rest", "c.start")
    order = Window.partitionBy("source").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("part", F.col("rest") - F.col("start") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    place = F.struct("key", "id", "size", "row")
    line = last.where("part >= 0").groupBy("source").agg(F.max(F.struct(place.alias("place"), "part")).alias("line"))
    out = plan.alias("p").join(line.alias("l"), on("p", "l"), "left")
    return out.select("p.source", "p.source_size", "p.target", "p.epochs", "l.line")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
    weight: Column | None = None,
    max_epochs: float = 3.0,
    bins: int = 2048,
    seed: str = "",
    prefix: str = "",
) -> DataFrame:
    """Adds size, source_size, target and taken (words) to every document.

    ``size`` and ``weight`` are columns of the documents; by default the words of the
    text, and ``letter_weight``.  Null texts have size 0, null sources are a source of
    their own, rows with equal ids draw equal keys, and identical rows may swap places.
    The added columns get ``prefix`` and replace columns of the same names.

    The documents are written once with their size and key.  What is decided for a
    source is a row, written too, so Spark knows its size and sends it to the tasks only
    under its own threshold; with very many sources it joins them instead.
    """
    w = letter_weight(F.col(text_col)) if weight is None else weight
    n = word_count(F.col(text_col)) if size is None else size.cast("long")
    key = sampling_key(F.col(id_col), F.greatest(F.coalesce(w, F.lit(1e-6)), F.lit(1e-6)), seed)
    held = docs.withColumns({f"{_T}size": n, f"{_T}key": key, f"{_T}row": F.monotonically_increasing_id()})
    # exp(-key) falls as the key rises, so low bins are taken first.
    u = (1.0 - F.exp(-F.col(f"{_T}key"))) * bins
    coarse = F.least(F.floor(u), F.lit(bins - 1)).cast("int")
    held = stash(held.withColumns({f"{_T}bin": coarse, f"{_T}fine": F.floor((u - coarse) * bins).cast("int")}))
    c = lambda name: F.col(_T + name)
    names = ("size", "key", "bin", "fine", "row")
    keyed = held.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), *(c(x).alias(x) for x in names))
    line = stash(line_of_sources(keyed, max_epochs)).select(*(F.col(x).alias(_T + x) for x in ("source", "source_size", "target", "epochs", "line")))
    joined = held.join(line, F.col(source_col).eqNullSafe(c("source")), "left")
    place = F.struct(c("key").alias("key"), F.col(id_col).alias("id"), c("size").alias("size"), c("row").alias("row"))
    at = c("line")["place"]
    part = F.when(place < at, c("size")).when(place == at, F.least(c("size"), c("line")["part"])).otherwise(0)
    taken = (c("epochs") * c("size") + part).cast("long")
    added = {f"{prefix}size": c("size"), f"{prefix}source_size": c("source_size"), f"{prefix}target": c("target"), f"{prefix}taken": taken}
    kept = [F.col(f"`{x}`") for x in docs.columns if x not in added]
    return joined.select(*kept, *(v.alias(k) for k, v in added.items()))


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN length(text) > 0 THEN 0.5::DOUBLE + length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))::DOUBLE / length(text)::DOUBLE ELSE 0.5::DOUBLE END AS w,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
m AS (SELECT arg_min(lev, cap / w) AS level FROM l WHERE lev <= cap / w),
t AS (SELECT source, source_size, round(least(cap, level * w), 6) AS target FROM l, m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
f AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e),
o AS (SELECT k.doc_id, k.size, f.source_size, f.target, f.epochs, f.rest,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - earlier)))::BIGINT AS taken FROM o
"""
