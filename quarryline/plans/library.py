"""Queries over metadata, reads, adapters, coverage, sync, audit and evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import audit, catalog, coverage, evaluate, project, read, selectors, sync
from quarryline.operators import find as find_op
from quarryline.operators import rank as rk
from quarryline.plans import corpora
from quarryline.plans.registry import ORACLES, QUERIES
from quarryline.plans.search import CONV_SQL, NOW, _head, candidates_sql, conv, conversation_queries, merged_sql, ranked_sql
from quarryline.sources import adapters
from quarryline.storage import keep

DOC_SQL = "WITH " + ",".join([corpora.DOC_MESSAGES_SQL, project.sessions_sql("doc_m", "doc_s"), project.documents_sql("doc_m", "doc_s", "doc_d")])


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = corpora.doc_messages(spark, sf_dir)
    return m, project.build_sessions(m)


# Metadata


@register("list_sessions", DOC_SQL + " SELECT session_key, title, ended_at, message_count FROM doc_s WHERE source_id IN ('codex', 'pi') AND path_date BETWEEN '2024-01-01' AND '2024-06-30' AND cwd LIKE '%/src%' AND ended_at >= '2024-01-01T01' ORDER BY ended_at DESC, session_key LIMIT 20")
def list_recent(spark, sf_dir):
    s = docs(spark, sf_dir)[1].where(F.col("path_date").between("2024-01-01", "2024-06-30"))
    return catalog.list_sessions(s, source_ids=["codex", "pi"], cwd="/SRC", since="2024-01-01T01").select("session_key", "title", "ended_at", "message_count")


@register("list_by_messages", DOC_SQL + " SELECT session_key, message_count FROM doc_s ORDER BY message_count DESC, session_key LIMIT 20")
def list_longest(spark, sf_dir):
    return catalog.list_sessions(docs(spark, sf_dir)[1], sort="messages").select("session_key", "message_count")


@register("source_stats", DOC_SQL + " SELECT source_id, count(*) AS session_count, sum(message_count)::BIGINT AS message_count, min(started_at) AS first_started_at, max(ended_at) AS last_ended_at FROM doc_s GROUP BY 1")
def stats(spark, sf_dir):
    return catalog.source_stats(docs(spark, sf_dir)[1])


@register("top_cwds", DOC_SQL + " SELECT source_id, cwd, sessions, place FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sessions DESC, cwd) AS place FROM (SELECT source_id, cwd, count(*) AS sessions FROM doc_s WHERE cwd <> '' GROUP BY 1, 2)) WHERE place <= 10")
def cwds(spark, sf_dir):
    return catalog.top_cwds(docs(spark, sf_dir)[1]).withColumn("place", F.col("place").cast("long"))


@register("inventory_by_cwd", DOC_SQL + " SELECT source_id, cwd, count(*) AS files, min(path_date) AS from_date, max(path_date) AS to_date FROM doc_s GROUP BY 1, 2")
def by_cwd(spark, sf_dir):
    return catalog.inventory(docs(spark, sf_dir)[1]).drop("place")


def wanted_selectors(s: DataFrame) -> DataFrame:
    """A selector of each kind for every session's source, directory and date."""
    one = coverage.session_selectors(s.select("session_key", "source_id", "source_root", "cwd", "path_date")).select("requested").distinct()
    return one.select(selectors.storage_key(F.col("requested")).alias("selector_id"), F.col("requested").alias("s"))


_WANTED_SQL = """
sel AS (SELECT DISTINCT kind, source, root, cwd, d FROM (
  SELECT 'all' AS kind, source_id AS source, source_root AS root, NULL AS cwd, NULL AS d FROM {s} UNION ALL SELECT 'cwd', source_id, source_root, cwd, NULL FROM {s} WHERE cwd <> ''
  UNION ALL SELECT 'date_range', source_id, source_root, NULL, path_date FROM {s} UNION ALL SELECT 'cwd_date_range', source_id, source_root, cwd, path_date FROM {s} WHERE cwd <> '')),
sk AS (SELECT *, '{{"kind":"' || kind || '","source":"' || source || '","root":"' || root || '"' || coalesce(',"cwd":"' || cwd || '"', '') || coalesce(',"fromDate":"' || d || '","toDate":"' || d || '"', '') || '}}' AS selector_id FROM sel)
"""


@register("selector_counts", DOC_SQL + "," + _WANTED_SQL.format(s="doc_s") + " SELECT selector_id, count(*) AS session_count, sum(message_count)::BIGINT AS message_count, sum(document_count)::BIGINT AS document_count FROM sk JOIN doc_s s ON s.source_id = sk.source AND s.file_path LIKE sk.root || '/%' AND (sk.cwd IS NULL OR s.cwd = sk.cwd) AND (sk.d IS NULL OR s.path_date = sk.d) GROUP BY 1")
def counts_by_selector(spark, sf_dir):
    s = keep(docs(spark, sf_dir)[1])
    return catalog.selector_counts(s, wanted_selectors(s))


@register("scanned_messages", DOC_SQL + " SELECT sum(message_count)::BIGINT AS scanned_message_count FROM doc_s WHERE source_id = 'codex' AND path_date BETWEEN '2024-01-01' AND '2024-12-31'")
def scanned(spark, sf_dir):
    s = selectors.as_column(selectors.selector("date_range", "/docs/codex", from_date="2024-01-01", to_date="2024-12-31"))
    return catalog.scope_messages(docs(spark, sf_dir)[1], selectors.matches(s, F.col("source_id"), F.col("file_path"), F.col("cwd"), F.col("path_date")))


# Reads


@register("read_page", DOC_SQL + " SELECT session_key, seq, role, length(body_text) AS chars, total, (3 + least(4, greatest(total - 3, 0)) < total) AS has_more FROM doc_m JOIN (SELECT session_key, count(*) AS total FROM doc_m GROUP BY 1) USING (session_key) WHERE seq >= 3 AND seq < 7")
def pages_(spark, sf_dir):
    m = corpora.doc_messages(spark, sf_dir)
    requests = m.select("session_key").distinct().withColumns({"offset": F.lit(3), "limit": F.lit(4)})
    return read.page(m, requests).select("session_key", "seq", "role", F.length("body_text").cast("long").alias("chars"), "total", "has_more")


_ELIDE_SQL = "CASE WHEN length(body_text) <= 800 THEN body_text ELSE left(body_text, 400) || chr(10) || '[... elided middle ...]' || chr(10) || right(body_text, 400) END AS body, CASE WHEN length(body_text) > 800 THEN length(body_text) - 800 ELSE 0 END AS omitted"


@register("read_range", DOC_SQL + f" SELECT a.session_key || '@' || a.seq AS anchor_id, m.seq, {_ELIDE_SQL.replace('body_text', 'm.body_text')} FROM doc_m a JOIN doc_m m ON m.session_key = a.session_key AND m.seq BETWEEN greatest(a.seq - 2, 0) AND a.seq + 2 WHERE a.seq % 3 = 1")
def ranges(spark, sf_dir):
    """The neighbourhood of every third message, elided."""
    m = corpora.doc_messages(spark, sf_dir)
    anchors = m.where("seq % 3 = 1").select(F.concat_ws("@", "session_key", F.col("seq").cast("string")).alias("anchor_id"), "session_key", "seq", F.lit(read.BEFORE).alias("before"), F.lit(read.AFTER).alias("after"))
    e = read.elide(F.col("body_text"))
    return read.neighbourhood(m, anchors).withColumn("e", e).select("anchor_id", "seq", F.col("e.text").alias("body"), F.col("e.omitted").cast("long").alias("omitted"))


@register("read_range_all", DOC_SQL + f" SELECT a.session_key || '@' || a.seq AS anchor_id, m.seq, {_ELIDE_SQL.replace('body_text', 'm.body_text')} FROM doc_m a JOIN doc_m m ON m.session_key = a.session_key AND m.seq BETWEEN greatest(a.seq - 2, 0) AND a.seq + 2")
def all_ranges(spark, sf_dir):
    """The neighbourhood of every message, elided."""
    m = corpora.doc_messages(spark, sf_dir)
    anchors = m.select(F.concat_ws("@", "session_key", F.col("seq").cast("string")).alias("anchor_id"), "session_key", "seq", F.lit(read.BEFORE).alias("before"), F.lit(read.AFTER).alias("after"))
    return read.neighbourhood(m, anchors).withColumn("e", read.elide(F.col("body_text"))).select("anchor_id", "seq", F.col("e.text").alias("body"), F.col("e.omitted").cast("long").alias("omitted"))


@register("first_latest_messages", CONV_SQL + " SELECT session_key, role, seq, seq = min(seq) OVER w AS \"first\", seq = max(seq) OVER w AS latest FROM conv_m WINDOW w AS (PARTITION BY session_key, role) QUALIFY \"first\" OR latest")
def ends(spark, sf_dir):
    return read.rank_messages(corpora.conv_messages(spark, sf_dir)).select("session_key", "role", "seq", "first", "latest")


@register("find_evidence", ",".join([_head, candidates_sql(5), ranked_sql(5), merged_sql(5).rpartition("SELECT query_id, mrank")[0]]) + " SELECT query_id, mrank AS rank, CASE WHEN shown_seq >= 0 THEN 'message_match' ELSE 'session_level_match' END AS reason, nullif(shown_seq, -1) AS seq, session_ref, 2::INT AS before, 2::INT AS after FROM merged WHERE mrank <= 5")
def evidence(spark, sf_dir):
    c = conv(spark, sf_dir).searchable()
    q = conversation_queries(c)
    r = find_op.find(q, c.documents, c.sessions, c.index, now=NOW, limit=5).join(q, "query_id")
    r = r.withColumn("e", read.evidence_action(F.col("match_seq"), F.col("query"), F.col("source_id"), F.col("session_ref")))
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "e.reason", "e.seq", "e.session_ref", "e.before", "e.after")


@register("find_snippets")
def snippets(spark, sf_dir):
    """Snippets of the merged results; tested against fixed cases and a plain version."""
    c = conv(spark, sf_dir).searchable()
    q = conversation_queries(c)
    r = find_op.find(q, c.documents, c.sessions, c.index, now=NOW, limit=5).join(q.withColumn("a", T.analyze_query(F.col("query"))), "query_id")
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "session_ref", read.snippet(F.col("content"), F.col("a.normalized"), F.col("a.terms")).alias("snippet"), F.array_join("matched_fields", ",").alias("matched_fields"))


# Adapters: every message of the conversation corpus, rendered in its source's format and read back


def rendered_lines(spark, sf_dir) -> DataFrame:
    m = corpora.conv_messages(spark, sf_dir)
    ms = (F.unix_seconds(F.to_timestamp_ltz(F.regexp_replace("timestamp", "Z$", "+00:00"))) * 1000).cast("long")
    js = lambda **k: F.to_json(F.struct(*(v.alias(n) for n, v in k.items())))
    lit, c = F.lit, F.col
    part = F.array(F.struct(lit("text").alias("type"), c("body_text").alias("text")), F.struct(lit("tool").alias("type"), lit("private").alias("text")))
    user = c("role") == "user"
    codex = js(timestamp=c("timestamp"), type=lit("event_msg"), payload=F.struct(F.when(user, "user_message").otherwise("agent_message").alias("type"), c("body_text").alias("message")))
    claude = js(type=c("role"), sessionId=c("native_session_id"), cwd=c("cwd"), timestamp=c("timestamp"), message=F.struct(part.alias("content")))
    pi = js(type=lit("message"), timestamp=c("timestamp"), message=F.struct(c("role").alias("role"), c("body_text").alias("content")))
    dsh = F.when(user, js(type=lit("user/message"), time=ms, data=F.struct(F.struct(lit("user").alias("kind")).alias("source"), part.alias("content")))).otherwise(js(type=lit("assistant/message"), time=ms, data=F.struct(F.struct(lit("assistant").alias("role"), part.alias("content")).alias("message"))))
    line = F.when(c("source_id") == "codex", codex).when(c("source_id") == "claude-code", claude).when(c("source_id") == "pi", pi).otherwise(dsh)
    body = m.select("source_id", "file_path", (c("seq") + 1).alias("line_no"), line.alias("value"))
    head = F.when(c("source_id") == "codex", js(timestamp=c("timestamp"), type=lit("session_meta"), payload=F.struct(c("native_session_id").alias("id"), c("cwd").alias("cwd"))))
    head = head.when(c("source_id") == "pi", js(type=lit("session"), id=c("native_session_id"), cwd=c("cwd"), timestamp=c("timestamp"))).when(c("source_id") == "dsh", js(type=lit("session"), id=c("native_session_id"), cwd=c("cwd"), createdAt=ms)).otherwise(lit("not json"))
    first = m.where("seq = 0").select("source_id", "file_path", lit(0).cast("long").alias("line_no"), head.alias("value"))
    return first.unionByName(body).withColumns({"raw_start": lit(0).cast("long"), "raw_end": lit(0).cast("long")})


def adapter_events(spark, sf_dir) -> DataFrame:
    rows = rendered_lines(spark, sf_dir)
    out = None
    for source, adapt in adapters.ADAPTERS.items():
        part = adapt(rows.where(F.col("source_id") == source))
        out = part if out is None else out.unionByName(part)
    return out


@register("adapters_round_trip", CONV_SQL + " SELECT source_id, session_key, session_uuid, seq, role, \"timestamp\", trim(body_text) AS body_text, cwd, path_date FROM conv_m")
def round_trip(spark, sf_dir):
    messages, _ = adapters.project_files(adapter_events(spark, sf_dir))
    return messages.select("source_id", "session_key", "session_uuid", "seq", "role", "timestamp", F.trim("body_text").alias("body_text"), "cwd", F.col("path_date"))


@register("file_outcomes", CONV_SQL + " SELECT source_id, file_path, session_key, 'projected' AS outcome, 0::BIGINT AS filtered_count FROM conv_s")
def outcomes(spark, sf_dir):
    _, o = adapters.project_files(adapter_events(spark, sf_dir))
    return o.select("source_id", "file_path", "session_key", "outcome", F.col("filtered_count").cast("long").alias("filtered_count"))


# Coverage, sync, retention


def proofs(s: DataFrame) -> DataFrame:
    """A coverage record for every selector whose digest is even in length-independent terms: the first half by key."""
    w = wanted_selectors(s)
    h = F.substring(F.md5("selector_id"), 1, 1)
    return w.where(h < "8").select(F.col("selector_id").alias("selector_key"), F.col("s").alias("selector"), F.when(h < "2", "other").otherwise(project.INDEX_VERSION).alias("record_version"), F.col("selector_id").alias("fingerprint"), F.when(h < "4", "").otherwise("set").alias("file_set_fingerprint"), F.lit(1).alias("file_count"))


_IMPLIES = "c.source = r.source AND c.root = r.root AND (c.kind = 'all' OR (c.kind = 'date_range' AND r.kind IN ('date_range', 'cwd_date_range') AND c.d = r.d) OR (c.kind = 'cwd' AND r.kind IN ('cwd', 'cwd_date_range') AND c.cwd = r.cwd) OR (c.kind = 'cwd_date_range' AND r.kind = 'cwd_date_range' AND c.cwd = r.cwd AND c.d = r.d))"
_PROOF_SQL = DOC_SQL + "," + _WANTED_SQL.format(s="doc_s") + ", pr AS (SELECT *, substr(md5(selector_id), 1, 1) AS h FROM sk WHERE substr(md5(selector_id), 1, 1) < '8')"


@register("coverage_stored", _PROOF_SQL + f" SELECT r.selector_id AS request_id, count(c.selector_id) > 0 AS complete, 'not_checked' AS freshness, count(c.selector_id) AS n_covering FROM sk r LEFT JOIN pr c ON c.h >= '2' AND {_IMPLIES} GROUP BY 1")
def stored(spark, sf_dir):
    s = keep(docs(spark, sf_dir)[1])
    requests = wanted_selectors(s).select(F.col("selector_id").alias("request_id"), F.col("s").alias("requested"))
    return coverage.stored_coverage(proofs(s), requests).select("request_id", "complete", "freshness", F.size("covering_selectors").cast("long").alias("n_covering"))


_REASON = "CASE WHEN bool_or(fresh) THEN 'none' WHEN count(k) = 0 THEN 'missing' WHEN bool_or(content) THEN 'source_content_changed' ELSE 'source_set_changed' END"


@register("coverage_requested", _PROOF_SQL + f""", ev AS (SELECT *, selector_id AS k, h < '5' AS fresh, h >= '5' AND h < '7' AS content FROM pr WHERE h >= '2'),
g AS (SELECT r.selector_id AS request_id, any_value(r.source) AS source, CASE WHEN bool_or(fresh) THEN 'fresh' WHEN count(k) = 0 THEN 'missing' ELSE 'stale' END AS freshness, {_REASON} AS stale_reason FROM sk r LEFT JOIN ev c ON {_IMPLIES} GROUP BY 1)
SELECT request_id, freshness = 'fresh' AS complete, freshness, stale_reason, CASE WHEN freshness = 'fresh' OR (source = 'codex' AND stale_reason = 'source_content_changed') THEN 'query' ELSE 'sync' END AS recommended_action FROM g""")
def requested(spark, sf_dir):
    """Proofs against a state in which some contents and some file sets have changed."""
    s = keep(docs(spark, sf_dir)[1])
    p = proofs(s)
    h = F.substring(F.md5("selector_key"), 1, 1)
    now = p.select("selector_key", F.when(h < "5", F.col("fingerprint")).otherwise("changed").alias("now_fingerprint"), F.when(h < "7", "set").otherwise("other").alias("now_file_set"), F.lit(1).alias("now_count"))
    requests = wanted_selectors(s).select(F.col("selector_id").alias("request_id"), F.col("s").alias("requested"))
    return coverage.evaluate_requests(coverage.evaluate_records(p, now), requests)


def scan_and_state(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as files, now and as they were: some new, some grown, some rewritten, some only touched."""
    d = corpora.table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", "text", "lang", "source")
    case = F.pmod("doc_id", F.lit(7))
    old = F.when(case == 1, F.substring("text", F.lit(1), F.length("text") - 1)).when(case == 2, F.concat(F.lit("x"), F.expr("substring(text, 2)"))).when(case == 3, F.concat("text", F.lit("more"))).otherwise(F.col("text"))
    path = F.concat(F.lit("/f/"), F.col("doc_id").cast("string"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    scan = d.select(F.lit("codex").alias("source_id"), path.alias("file_path"), F.octet_length("text").cast("long").alias("size"), F.lit(2.0).alias("mtime_ms"), F.col("source").alias("cwd"), F.lit("2024-01-01").alias("path_date"), sha(F.col("text")).alias("content_sha"), F.sha2(F.substring(F.col("text").cast("binary"), F.lit(1), F.octet_length(old)), 256).alias("prefix_sha"))
    state = d.where(case != 0).select(F.lit("codex").alias("source_id"), path.alias("file_path"), F.octet_length(old).cast("long").alias("s_size"), F.when(case == 4, 1.0).otherwise(2.0).alias("s_mtime_ms"), F.col("source").alias("s_cwd"), F.lit("2024-01-01").alias("s_path_date"), sha(old).alias("s_content_sha"), F.when(case == 5, 0).otherwise(sync.EPOCH).alias("s_epoch"))
    return scan, state


@register("sync_actions", "SELECT '/f/' || doc_id::VARCHAR AS file_path, CASE doc_id % 7 WHEN 1 THEN 'append' WHEN 4 THEN 'refresh' WHEN 6 THEN 'unchanged' WHEN 2 THEN CASE WHEN left(text, 1) = 'x' THEN 'unchanged' ELSE 'full' END ELSE 'full' END AS action, CASE doc_id % 7 WHEN 0 THEN 'new_file' WHEN 2 THEN CASE WHEN left(text, 1) = 'x' THEN NULL WHEN strlen(left(text, 1)) > 1 THEN 'prefix_changed' ELSE 'rewritten' END WHEN 3 THEN 'truncated' WHEN 5 THEN 'epoch_changed' END AS reason FROM documents WHERE text IS NOT NULL AND text <> ''")
def actions(spark, sf_dir):
    return sync.classify_files(*scan_and_state(spark, sf_dir)).select("file_path", "action", "reason")


@register("sync_report", "SELECT 'codex' AS source_id, count(*) AS scanned, count(*) FILTER (doc_id % 7 = 0) AS added, count(*) FILTER (doc_id % 7 IN (1, 3, 5) OR (doc_id % 7 = 2 AND left(text, 1) <> 'x')) AS updated, count(*) FILTER (doc_id % 7 IN (4, 6) OR (doc_id % 7 = 2 AND left(text, 1) = 'x')) AS skipped FROM documents WHERE text IS NOT NULL AND text <> ''")
def report(spark, sf_dir):
    return sync.report(sync.classify_files(*scan_and_state(spark, sf_dir)))


@register("snapshot_transition", DOC_SQL + " SELECT source_id, CASE source_id WHEN 'codex' THEN 'append_only' WHEN 'pi' THEN 'rejected' ELSE 'stable' END AS kind, CASE source_id WHEN 'codex' THEN 'source_content_changed' WHEN 'pi' THEN 'non_codex_source_changed' END AS reason FROM doc_s GROUP BY 1")
def transitions(spark, sf_dir):
    s = docs(spark, sf_dir)[1].select("source_id", "file_path", F.col("message_count").alias("size"), F.lit(1.0).alias("mtime_ms"))
    grown = F.col("source_id").isin("codex", "pi")
    after = s.withColumns({"size": F.col("size") + F.when(grown, 5).otherwise(0), "mtime_ms": F.when(grown, 2.0).otherwise(1.0)})
    known = s.select("file_path", F.lit(True).alias("prefix_matches"), F.lit(True).alias("was_indexed"), F.lit(False).alias("projected"))
    return sync.transition(s, after, known).select("source_id", "kind", "reason")


@register("prune_with_cold", DOC_SQL + " SELECT session_key, CASE WHEN session_key NOT LIKE '%3' THEN 'kept' WHEN source_id = 'codex' AND native_session_id LIKE 'src1%' THEN 'retained_cold' ELSE 'removed' END AS fate FROM doc_s")
def pruned(spark, sf_dir):
    s = docs(spark, sf_dir)[1]
    return sync.prune(s, s.where("session_key not like '%3'"), s.where("native_session_id like 'src1%'")).select("session_key", "fate")


@register("replace_sessions", CONV_SQL + " SELECT session_key, count(*) AS documents, sum(length(body_text))::BIGINT AS chars FROM (SELECT session_key, body_text FROM conv_d WHERE source_id <> 'pi' UNION ALL SELECT session_key, 'new' FROM conv_d WHERE source_id = 'pi') GROUP BY 1")
def replaced(spark, sf_dir):
    c = conv(spark, sf_dir)
    new = c.documents.where("source_id = 'pi'").withColumn("body_text", F.lit("new"))
    out = sync.replace_sessions(c.documents, new, new.select("session_key"))
    return out.groupBy("session_key").agg(F.count("*").alias("documents"), F.sum(F.length("body_text")).alias("chars"))


# Audit and legacy copy


@register("audit_violations", CONV_SQL + """ SELECT rule, session_key AS key FROM (
  SELECT session_key, unnest(CASE WHEN n % 5 = 0 THEN ['message_count'] WHEN n % 5 = 1 THEN ['document_count', 'profile_count'] WHEN n % 5 = 2 AND message_count > 1 THEN ['message_count', 'document_count', 'sequence'] WHEN n % 5 = 2 THEN ['message_count', 'document_count'] ELSE [] END) AS rule
  FROM (SELECT *, native_session_id::BIGINT AS n FROM conv_s))""")
def broken(spark, sf_dir):
    """The rules against tables in which every fifth session is wrong in one of three ways."""
    c = conv(spark, sf_dir)
    n = F.pmod(F.element_at(F.split("session_key", ":"), 2).cast("long"), F.lit(5))
    s = c.sessions.withColumn("message_count", F.when(n == 0, F.col("message_count") + 1).otherwise(F.col("message_count")))
    d = c.documents.where(~((n == 1) & (F.col("kind") == "session_profile")) & ~((n == 2) & (F.coalesce("seq", F.lit(-1)) == 0)))
    return audit.violations(s, d).select("rule", "key")


@register("audit_clean", CONV_SQL + " SELECT '' AS rule, '' AS key FROM conv_s WHERE false")
def clean(spark, sf_dir):
    c = conv(spark, sf_dir)
    return audit.violations(c.sessions, c.documents).select("rule", "key")


@register("legacy_copy", CONV_SQL + " SELECT doc_id, session_key, kind, seq, role, body_text, title_text FROM conv_d")
def legacy(spark, sf_dir):
    """The corpus in the older two-table layout, copied to sessions and documents."""
    c = conv(spark, sf_dir)
    old = c.messages.select("session_uuid", "source_id", "seq", "role", F.col("body_text").alias("content_text"), "timestamp")
    _, d = audit.copy_legacy(c.sessions.drop("session_key", "native_session_id"), old.drop("source_id"))
    return d.select("doc_id", "session_key", "kind", "seq", "role", "body_text", "title_text")


# Evaluation


@register("latency_rollup", "SELECT event_type AS shape, user_id % 4 AS level, count(*) AS samples, count(*) FILTER (NOT ok) AS errors, round(quantile_cont(value, 0.5) FILTER (ok), 6) AS p50_ms, round(quantile_cont(value, 0.95) FILTER (ok), 6) AS p95_ms, round(quantile_cont(value, 0.99) FILTER (ok), 6) AS p99_ms, max(value) FILTER (ok) AS max_ms FROM (SELECT *, event_id % 11 <> 0 AS ok, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS n FROM events) WHERE n >= 5 GROUP BY 1, 2")
def latency(spark, sf_dir):
    e = corpora.table(spark, sf_dir, "events")
    level = F.pmod("user_id", F.lit(4))
    w = Window.partitionBy("event_type", level).orderBy("event_id")
    s = e.select(F.col("event_type").alias("shape"), level.alias("level"), (F.row_number().over(w) - 1).alias("n"), (F.pmod("event_id", F.lit(11)) != 0).alias("ok"), F.col("value").alias("ms"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"))
    r = evaluate.latency_rollup(s, warm_up=5).drop("per_second")
    return r.withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms", "p99_ms")})


@register("context_sizes", "SELECT quantile_disc(length(text), 0.5) AS p50_chars, quantile_disc(length(text), 0.95) AS p95_chars, max(length(text)) AS max_chars, max(strlen(text)) AS max_bytes FROM documents WHERE text IS NOT NULL")
def sizes(spark, sf_dir):
    r = evaluate.context_sizes(corpora.table(spark, sf_dir, "documents").where("text is not null").select(F.col("text").alias("context")))
    return r.select(*(F.col(c).cast("long").alias(c) for c in r.columns))


_RES = ",".join([_head, candidates_sql(5), ranked_sql(5), merged_sql(5).rpartition("SELECT query_id, mrank")[0]])


@register("result_diversity", _RES + " SELECT query_id, count(DISTINCT session_ref) AS sessions, count(DISTINCT title) AS titles, count(DISTINCT cwd) AS cwds FROM merged WHERE mrank <= 5 GROUP BY 1")
def spread(spark, sf_dir):
    c = conv(spark, sf_dir).searchable()
    return evaluate.diversity(find_op.find(conversation_queries(c), c.documents, c.sessions, c.index, now=NOW, limit=5), 5)


@register("golden_self_retrieval", _RES + " SELECT (SELECT count(*) FROM qq) AS queries, count(*) AS passed FROM merged WHERE mrank <= 5 AND session_key = query_id")
def self_retrieval(spark, sf_dir):
    """Does a query made of a session's own words find that session among the first five?"""
    c = conv(spark, sf_dir).searchable()
    q = conversation_queries(c)
    r = find_op.find(q, c.documents, c.sessions, c.index, now=NOW, limit=5)
    own = q.join(c.sessions, F.col("query_id") == F.col("session_key")).select("query_id", rk.session_ref(F.col("source_id"), F.col("session_uuid"), F.col("session_key")).alias("session_ref"))
    return evaluate.passed_at(own, r, 5)


@register("result_json", CONV_SQL + " SELECT session_key, '{\"source_id\":\"' || source_id || '\",\"session_key\":\"' || session_key || '\",\"message_count\":' || message_count || '}' AS json FROM conv_s")
def as_json(spark, sf_dir):
    return conv(spark, sf_dir).sessions.select("session_key", F.to_json(F.struct("source_id", "session_key", "message_count")).alias("json"))
