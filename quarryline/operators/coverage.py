"""Coverage: what the index has proved to hold, and whether that is still so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import selectors
from quarryline.operators.project import INDEX_VERSION


_PLACE = ["__source", "__root"]


def covering(records: DataFrame, requests: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """Pairs of requests (request_id, requested) and current records (selector, ...) that imply them.

    Records of a whole root meet all requests of it.  Others meet those of their directory and
    of the days that are asked for in their range, by equality, so that no two are paired
    that have nothing in common; the implication has the last word.
    """
    own, asked = F.col("selector"), F.col("requested")
    r = records.where(F.col("record_version") == version).withColumns(dict(zip(_PLACE, (own["source"], own["root"]))))
    q = requests.withColumns(dict(zip(_PLACE, (asked["source"], asked["root"]))))
    whole = q.join(r.where(own["kind"] == "all"), _PLACE)

    none = F.lit("")
    key = lambda kind, cwd=none, day=none: F.struct(F.lit(kind).alias("kind"), cwd.alias("cwd"), day.alias("day"))
    dated, placed = asked["kind"].isin("date_range", "cwd_date_range"), asked["kind"].isin("cwd", "cwd_date_range")
    keys = F.array(F.when(placed, key("cwd", asked["cwd"])), F.when(dated, key("date_range", day=asked["fromDate"])), F.when(dated & placed, key("cwd_date_range", asked["cwd"], asked["fromDate"])))
    q = q.withColumn("__key", F.explode(F.filter(keys, lambda k: k.isNotNull())))

    days = requests.where(dated).select(asked["source"].alias("__source"), asked["root"].alias("__root"), asked["fromDate"].alias("day")).groupBy(*_PLACE).agg(F.collect_set("day").alias("days"))  # of the calendar
    in_range = F.filter("days", lambda d: (d >= own["fromDate"]) & (d <= own["toDate"]))
    by_day = r.where(own["kind"].isin("date_range", "cwd_date_range"))
    one_day = own["fromDate"] == own["toDate"]
    wide = by_day.where(~one_day).join(days, _PLACE).withColumn("__day", F.explode(in_range)).drop("days")
    by_day = by_day.where(one_day).withColumn("__day", own["fromDate"]).unionByName(wide)
    narrow = r.where(own["kind"] == "cwd").withColumn("__day", none).unionByName(by_day)
    cwd = F.when(own["kind"] == "date_range", none).otherwise(own["cwd"])
    narrow = narrow.withColumn("__key", F.struct(own["kind"].alias("kind"), cwd.alias("cwd"), F.col("__day").alias("day"))).drop("__day")
    met = q.join(narrow, [*_PLACE, "__key"]).where(selectors.implies(own, asked)).drop("__key")
    return whole.unionByName(met).drop(*_PLACE)


def stored_coverage(records: DataFrame, requests: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """Per request whether a compatible proof exists; freshness is never claimed without a look at the source."""
    hits = covering(records, requests, version).groupBy("request_id").agg(F.sort_array(F.collect_list("selector_key")).alias("covering_selectors"))
    return requests.join(hits, "request_id", "left").select("request_id", F.col("covering_selectors").isNotNull().alias("complete"), F.lit("not_checked").alias("freshness"), F.coalesce("covering_selectors", F.array().cast("array<string>")).alias("covering_selectors"))


def evaluate_records(records: DataFrame, snapshots: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """Adds freshness, stale_reason and advisory to records joined with the sources' present state.

    ``snapshots``: (selector_key, now_fingerprint, now_file_set, now_count).
    """
    e = records.join(snapshots, "selector_key", "left")
    set_same = (F.col("file_set_fingerprint") == "") | (F.col("now_file_set") == F.col("file_set_fingerprint"))
    fresh = F.coalesce((F.col("now_fingerprint") == F.col("fingerprint")) & set_same & (F.col("now_count") == F.col("file_count")) & (F.col("record_version") == version), F.lit(False))
    content = F.coalesce((F.col("file_set_fingerprint") != "") & (F.col("now_file_set") == F.col("file_set_fingerprint")), F.lit(False))
    reason = F.when(fresh, "none").when(content, "source_content_changed").otherwise("source_set_changed")
    return e.withColumns({"freshness": F.when(fresh, "fresh").otherwise("stale"), "stale_reason": reason, "advisory": (F.col("selector.source") == "codex") & (reason == "source_content_changed")})


def evaluate_requests(evaluated: DataFrame, requests: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """Per request: freshness of the best covering record, why it is stale, and what to do."""
    hit = covering(evaluated, requests, version).groupBy("request_id").agg(F.bool_or(F.col("freshness") == "fresh").alias("any_fresh"), F.bool_or(F.col("stale_reason") == "source_content_changed").alias("any_content"), F.count("*").alias("n"))
    j = requests.join(hit, "request_id", "left")
    freshness = F.when(F.col("any_fresh"), "fresh").when(F.col("n").isNull(), "missing").otherwise("stale")
    reason = F.when(freshness == "fresh", "none").when(freshness == "missing", "missing").when(F.col("any_content"), "source_content_changed").otherwise("source_set_changed")
    action = F.when((freshness == "fresh") | ((F.col("requested.source") == "codex") & (reason == "source_content_changed")), "query").otherwise("sync")
    return j.select("request_id", (freshness == "fresh").alias("complete"), freshness.alias("freshness"), reason.alias("stale_reason"), action.alias("recommended_action"))


def session_selectors(sessions: DataFrame, *, narrowest: bool = False) -> DataFrame:
    """The two to four selectors that hold a session: all, its directory, its date, both; or the last of them only."""
    make = lambda kind, cwd=None, date=None: F.struct(F.lit(kind).alias("kind"), F.col("source_id").alias("source"), F.col("source_root").alias("root"), (cwd if cwd is not None else F.lit(None).cast("string")).alias("cwd"), (date if date is not None else F.lit(None).cast("string")).alias("fromDate"), (date if date is not None else F.lit(None).cast("string")).alias("toDate"))
    cwd, date = F.col("cwd"), F.col("path_date")
    some = F.array(make("all"), F.when(cwd != "", make("cwd", cwd)), F.when(date.isNotNull(), make("date_range", None, date)), F.when((cwd != "") & date.isNotNull(), make("cwd_date_range", cwd, date)))
    there = F.filter(some, lambda x: x.isNotNull())
    return sessions.select("session_key", (F.element_at(there, -1) if narrowest else F.explode(there)).alias("requested"))


def storage_key_of_all(source: Column, root: Column) -> Column:
    """Storage key of the selector for all of a source's root."""
    none = F.lit(None).cast("string")
    return selectors.storage_key(F.struct(F.lit("all").alias("kind"), source.alias("source"), root.alias("root"), none.alias("cwd"), none.alias("fromDate"), none.alias("toDate")))


def session_coverage(sessions: DataFrame, records: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """Per session (session_key) whether some current proof holds it, and the selectors of those that do."""
    # What implies any selector of a session implies its narrowest.
    wanted = session_selectors(sessions, narrowest=True).withColumn("request_id", F.col("session_key"))
    hits = covering(records, wanted, version).groupBy("session_key").agg(F.array_sort(F.collect_set("selector_key")).alias("covering_selectors"))
    none = F.array().cast("array<string>")
    out = sessions.select("session_key").join(hits, "session_key", "left")
    return out.select("session_key", F.col("covering_selectors").isNotNull().alias("complete"), F.lit("not_checked").alias("freshness"), F.coalesce("covering_selectors", none).alias("covering_selectors"))


def reason_counts(evaluated: DataFrame) -> DataFrame:
    """Records by freshness and reason; a reason counts for stale ones only."""
    reason = F.when(F.col("freshness") == "stale", F.col("stale_reason")).otherwise("none")
    return evaluated.groupBy("freshness", reason.alias("stale_reason")).agg(F.count("*").alias("records"))


def merged_freshness(values: Column) -> Column:
    """All fresh: fresh; else missing before stale before not_checked."""
    return F.when(F.forall(values, lambda x: x == "fresh"), "fresh").when(F.array_contains(values, "missing"), "missing").when(F.array_contains(values, "stale"), "stale").otherwise("not_checked")


def record_coverage(records: DataFrame, proofs: DataFrame) -> DataFrame:
    """The table after a sync: complete proofs replace their selector's record, an incomplete one clears its source and root."""
    broken = proofs.where("not complete").select("source_id", "root").distinct()
    new = proofs.where("complete").drop("complete")
    kept = records.join(broken, ["source_id", "root"], "left_anti").join(new.select("selector_key"), "selector_key", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
