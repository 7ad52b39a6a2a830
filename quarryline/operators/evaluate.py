"""Search quality: golden checks, scoreboards, comparisons, sizes and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_goldens(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of a JSONL file; blank and # lines are passed over, bad lines come with their number."""
    from quarryline.sources.jsonl import lines

    files = spark.read.format("binaryFile").load(path).select(F.lit("golden").alias("source_id"), F.col("path").alias("file_path"), "content")
    return goldens_of(lines(files, keep_tail=True), schema)


def goldens_of(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """The same from lines (file_path, line_no, value)."""
    rows = rows.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    v = rows.withColumn("entry", F.from_json("value", schema)).withColumn("ok", F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT") & F.col("entry.id").isNotNull() & F.col("entry.query").isNotNull())
    bad = v.where(~F.coalesce("ok", F.lit(False)))
    line = (F.col("line_no") + 1).alias("line")
    return v.where("ok").select("file_path", line, "entry.*"), bad.select("file_path", line, "value")


def keyword_check(goldens: DataFrame, results: DataFrame, top_k: int = 10) -> DataFrame:
    """pass, fail or skip per golden (query_id, title_or_summary, cwd, snippet needles; null: not asked)."""
    r = results.where(F.col("rank") <= top_k)
    j = goldens.join(r.select("query_id", "title", "summary_text", F.col("cwd").alias("r_cwd"), F.col("snippet").alias("r_snippet")), "query_id", "left")
    has = lambda c, needle: F.coalesce(F.lower(c).contains(F.lower(needle)), F.lit(False))
    checks = {"title_or_summary": has("title", F.col("title_or_summary")) | has("summary_text", F.col("title_or_summary")), "cwd": has("r_cwd", F.col("cwd")), "snippet": has("r_snippet", F.col("snippet"))}
    g = j.groupBy("query_id").agg(*(F.bool_or(hit).alias(f"hit_{n}") for n, hit in checks.items()), *(F.max(F.col(n).isNotNull()).alias(f"ask_{n}") for n in checks))
    asked = [F.col(f"ask_{n}") for n in checks]
    ok = [~F.col(f"ask_{n}") | F.col(f"hit_{n}") for n in checks]
    mark = F.when(~(asked[0] | asked[1] | asked[2]), "skip").when(ok[0] & ok[1] & ok[2], "pass").otherwise("fail")
    return g.select("query_id", mark.alias("mark"))


def structured_check(goldens: DataFrame, results: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Marks of structured goldens and the classes of what failed.

    Golden columns (null: not asked): query_id, status, top_k, source_id, session_uuids, session_ref,
    cwd_contains, match_source, match_seq, must_contain, facets (array of struct label, must_contain).
    The hit is the first acceptable session within top_k, else the first result.
    """
    r = results.select("query_id", "rank", F.struct("source_id", "session_uuid", "session_ref", "cwd", "match_source", "match_seq", "rank").alias("r"))
    j = goldens.join(r, "query_id", "left")
    fits = (F.col("rank") <= F.coalesce("top_k", F.lit(5))) & F.array_contains("session_uuids", F.col("r.session_uuid"))
    pick = j.groupBy("query_id").agg(F.min_by("r", F.when(F.coalesce(fits, F.lit(False)), F.col("rank"))).alias("good"), F.min_by("r", "rank").alias("top"))
    g = goldens.join(pick, "query_id").withColumn("hit", F.coalesce("good", "top"))
    if contexts is not None:
        g = g.join(contexts.select("query_id", F.lower("context").alias("context")), "query_id", "left")
    else:
        g = g.withColumn("context", F.lit(None).cast("string"))
    hit, text = F.col("hit"), F.coalesce("context", F.lit(""))
    miss = F.when(hit.isNull(), "coverage_index").otherwise("cli_recall_ranking_context")
    test = lambda asked, ok: F.when(asked, F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), miss.alias("class")))
    equal = lambda c, f: test(F.col(c).isNotNull(), hit[f] == F.col(c))
    holds = lambda needles: F.forall(needles, lambda n: text.contains(F.lower(n)))
    asserts = F.array(
        equal("source_id", "source_id"), test(F.size("session_uuids") > 0, F.col("good").isNotNull()), equal("session_ref", "session_ref"),
        test(F.col("cwd_contains").isNotNull(), F.lower(hit["cwd"]).contains(F.lower("cwd_contains"))), equal("match_source", "match_source"), equal("match_seq", "match_seq"),
        test(F.size("must_contain") > 0, holds(F.col("must_contain"))),
    )
    facets = F.transform(F.coalesce("facets", F.array().cast("array<struct<label:string,must_contain:array<string>>>")), lambda f: F.struct(holds(f["must_contain"]).alias("ok"), miss.alias("class")))
    g = g.withColumns({"asserts": F.filter(asserts, lambda x: x.isNotNull()), "facet_checks": facets})
    mark = lambda c: F.when(F.size(c) == 0, "skip").when(F.forall(c, lambda x: x["ok"]), "pass").otherwise("fail")
    every = F.concat("asserts", "facet_checks")
    return g.select("query_id", "status", mark(every).alias("mark"), mark(F.col("asserts")).alias("assertion_mark"), mark(F.col("facet_checks")).alias("facet_mark"), F.array_distinct(F.transform(F.filter(every, lambda x: ~x["ok"]), lambda x: x["class"])).alias("failure_classes"), hit["rank"].alias("hit_rank"))


def scoreboard(marks: DataFrame) -> DataFrame:
    """Counts of a check's marks (one row)."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    fail = F.col("mark") == "fail"
    return marks.agg(
        F.count("*").alias("total"), n("mark", "pass").alias("pass"), n("mark", "fail").alias("fail"), n("mark", "skip").alias("skip"), F.count_if(fail & (F.col("status") == "hard")).alias("hard_fail"),
        F.count_if(fail & (F.col("status") == "candidate")).alias("candidate_fail"), n("assertion_mark", "pass").alias("assertion_pass"), n("assertion_mark", "fail").alias("assertion_fail"), n("facet_mark", "pass").alias("facet_pass"), n("facet_mark", "fail").alias("facet_fail"),
    )


def passed_at(goldens: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Share of goldens (query_id, session_ref) whose session is among the first k."""
    hit = goldens.join(results.where(F.col("rank") <= k).select("query_id", "session_ref").withColumn("hit", F.lit(1)), ["query_id", "session_ref"], "left")
    return hit.agg(F.count("*").alias("queries"), F.count("hit").alias("passed"))


def top_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries whose first result is another one."""
    b, a = (df.where("rank = 1").select("query_id", F.col("session_ref").alias(n)) for df, n in ((before, "before"), (after, "after")))
    return b.join(a, "query_id").where("before <> after")


def diversity(results: DataFrame, k: int) -> DataFrame:
    """Distinct sessions, titles and directories among the first k of each query."""
    return results.where(F.col("rank") <= k).groupBy("query_id").agg(*(F.countDistinct(c).alias(n) for c, n in (("session_ref", "sessions"), ("title", "titles"), ("cwd", "cwds"))))


def nearest_rank(values: Column, share: float) -> Column:
    """Nearest-rank percentile of a gathered, bounded list."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.greatest(F.ceil(F.size(ordered) * share).cast("int") - 1, F.lit(0)))


def context_sizes(contexts: DataFrame) -> DataFrame:
    """Nearest-rank p50 and p95 of the contexts' characters, and the largest in characters and bytes."""
    w = Window.orderBy("chars")
    n = contexts.select(F.length("context").alias("chars"), F.octet_length("context").alias("bytes"))
    # Counts per size, so the ordered pass is over distinct sizes and not over contexts.
    sizes = n.groupBy("chars").agg(F.count("*").alias("c"), F.max("bytes").alias("bytes"))
    run = sizes.withColumns({"upto": F.sum("c").over(w), "all": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("chars")))
    return run.agg(at(0.5).alias("p50_chars"), at(0.95).alias("p95_chars"), F.max("chars").alias("max_chars"), F.max("bytes").alias("max_bytes"))


def latency_rollup(samples: DataFrame, warm_up: int = 0) -> DataFrame:
    """Per (shape, level): samples, errors, linear p50/p95/p99, worst and throughput.

    ``samples``: shape, level, n (order), ok, ms, at_s; the first ``warm_up`` of each group do not count.
    """
    good = F.when(F.col("ok"), F.col("ms"))
    s = samples.where(F.col("n") >= warm_up)
    span = F.max("at_s") - F.min("at_s")
    return s.groupBy("shape", "level").agg(F.count("*").alias("samples"), F.count_if(~F.col("ok")).alias("errors"), *(F.percentile(good, p).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)), F.max(good).alias("max_ms"), F.when(span > 0, F.count(good) / span).alias("per_second"))
