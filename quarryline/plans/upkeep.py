"""Queries over syncs, status and coverage of files rendered from the conversations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import audit, catalog, coverage, project, refresh, sync
from quarryline.plans import corpora
from quarryline.plans.library import _WANTED_SQL, DOC_SQL, docs, proofs, register, rendered_lines
from quarryline.plans.search import CONV_SQL, conv
from quarryline.sources import adapters
from quarryline.storage import keep

#: What becomes of a file between two syncs, by conversation: it is new, has grown, was rewritten, was only touched, or is the same.
NEW, GROWN, REWRITTEN, TOUCHED, SAME = range(5)
_CASE_SQL = "(native_session_id::BIGINT // 4) % 5"
C_SQL = CONV_SQL + f", c AS (SELECT *, {_CASE_SQL} AS k FROM conv_s)"


def case_of(path: Column) -> Column:
    number = F.regexp_extract(path, r"([0-9]+)\.jsonl$", 1).cast("long")
    return F.pmod(F.floor(number / 4), F.lit(5))


def files_of(lines: DataFrame, mtime: Column) -> DataFrame:
    """Files with their content from lines (source_id, file_path, line_no, value); a file is gathered as it would be read."""
    body = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    text = F.concat(F.array_join(F.transform(body, lambda x: x["value"]), "\n"), F.lit("\n"))
    whole = lines.groupBy(*refresh.FILE).agg(text.alias("text"))
    content = F.encode("text", "UTF-8")
    return whole.select(
        "source_id", F.concat(F.lit("/logs/"), "source_id").alias("source_root"), "file_path", F.octet_length(content).cast("long").alias("size"),
        mtime.cast("double").alias("mtime_ms"), content.alias("content"), F.lit(None).cast("string").alias("error"),
    )


def files_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rendered_lines(spark, sf_dir)
    return files_of(lines, F.when(case_of(F.col("file_path")) == TOUCHED, 2).otherwise(1))


def files_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as they were: some not there yet, some with two lines only, some with another first line."""
    lines = rendered_lines(spark, sf_dir).select(*refresh.FILE, "line_no", "value")
    case = case_of(F.col("file_path"))
    lines = lines.where((case != NEW) & ((case != GROWN) | (F.col("line_no") < 2)))
    other = lines.where((case == REWRITTEN) & (F.col("line_no") == 0)).withColumns({"line_no": F.lit(-1).cast("long"), "value": F.lit("{}")})
    return files_of(lines.unionByName(other), F.lit(1))


def first_sync(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return refresh.refresh(files_before(spark, sf_dir), refresh.empty_tables(spark)).tables


@register("sync_delta_documents", CONV_SQL + " SELECT doc_id, session_key, kind, seq, role, trim(body_text) AS body_text, trim(title_text) AS title_text FROM conv_d")
def delta_documents(spark, sf_dir):
    """Two syncs, the second of which reads on in grown files, give what one full read gives."""
    tables = first_sync(spark, sf_dir)
    d = refresh.refresh(files_now(spark, sf_dir), tables).tables["documents"]
    return d.select("doc_id", "session_key", "kind", "seq", "role", F.trim("body_text").alias("body_text"), F.trim("title_text").alias("title_text"))


@register(
    "sync_delta_report",
    C_SQL + """ SELECT source_id, count(*) AS scanned, count(*) FILTER (k = 0) AS added, count(*) FILTER ((k = 1 AND message_count > 1) OR k = 2) AS updated,
    count(*) FILTER ((k = 1 AND message_count = 1) OR k > 2) AS skipped, 0::BIGINT AS filtered, 0::BIGINT AS removed, 0::BIGINT AS retained_cold, 0::BIGINT AS errors FROM c GROUP BY 1""",
)
def delta_report(spark, sf_dir):
    return refresh.refresh(files_now(spark, sf_dir), first_sync(spark, sf_dir)).report


@register(
    "sync_file_states",
    C_SQL + " SELECT source_id, file_path, session_key, message_count AS next_seq, 'projected' AS outcome, cwd, path_date, CASE WHEN k = 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS mtime_ms FROM c",
)
def delta_states(spark, sf_dir):
    s = refresh.refresh(files_now(spark, sf_dir), first_sync(spark, sf_dir)).tables["source_files"]
    return s.select("source_id", "file_path", "session_key", "next_seq", "outcome", "cwd", "path_date", "mtime_ms")


@register(
    "sync_with_failures",
    C_SQL + """, o AS (SELECT *, source_id = 'pi' AND k = 1 AS bad FROM c),
    t AS (SELECT count(*) FILTER (bad) AS errors, count(*) FILTER (k <> 0) AS old_sessions, sum(CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE message_count END)::BIGINT AS old_messages,
          count(*) AS new_sessions, sum(CASE WHEN bad THEN 1 ELSE message_count END)::BIGINT AS new_messages, count(DISTINCT source_id) AS roots FROM o)
    SELECT 'best_effort' AS mode, 'published' AS status, errors, new_sessions AS sessions, new_messages AS messages, CASE WHEN errors = 0 THEN roots ELSE 0 END AS coverage_records FROM t
    UNION ALL SELECT 'strict', CASE WHEN errors = 0 THEN 'published' ELSE 'failed' END, errors, CASE WHEN errors = 0 THEN new_sessions ELSE old_sessions END, CASE WHEN errors = 0 THEN new_messages ELSE old_messages END, CASE WHEN errors = 0 THEN roots ELSE 0 END FROM t""",
)
def failures(spark, sf_dir):
    """A sync in which grown files of one source cannot be read, strict and with best effort."""
    tables = first_sync(spark, sf_dir)
    bad = (F.col("source_id") == "pi") & (case_of(F.col("file_path")) == GROWN)
    files = keep(files_now(spark, sf_dir).withColumns({"error": F.when(bad, "unreadable"), "content": F.when(~bad, F.col("content"))}))
    out = None
    for mode in ("strict", "best_effort"):
        r = refresh.refresh(files, tables, best_effort=mode == "best_effort")
        s, c = r.tables["sessions"], r.tables["coverage"]
        row = s.agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages")).crossJoin(F.broadcast(c.agg(F.count("*").alias("coverage_records"))))  # one row each
        row = row.crossJoin(F.broadcast(r.report.agg(F.sum("errors").alias("errors")))).withColumns({"mode": F.lit(mode), "status": F.lit(r.status)})
        out = row if out is None else out.unionByName(row)
    return out.select("mode", "status", "errors", "sessions", "messages", "coverage_records")


@register("sync_prune", C_SQL + " SELECT session_key, message_count FROM c WHERE k <> 3 OR (source_id = 'codex' AND native_session_id::BIGINT % 8 = 0)")
def pruned_sync(spark, sf_dir):
    """A sync after files went away, some of which are archived."""
    tables = first_sync(spark, sf_dir)
    files = files_now(spark, sf_dir).where(case_of(F.col("file_path")) != TOUCHED)
    cold = tables["sessions"].where(F.col("native_session_id").cast("long") % 8 == 0).select("native_session_id")
    s = refresh.refresh(files, tables, prune=True, cold=cold).tables["sessions"]
    return s.select("session_key", "message_count")


_STATUS_SQL = """
, g AS (SELECT source_id, source_root, count(*) AS files, count(*) FILTER (k = 0) AS new_files, count(*) FILTER (k = 2 OR (k = 1 AND message_count > 1)) AS changed_files, count(*) FILTER (k = 2) AS unproven,
        0::BIGINT AS lost_files, 0::BIGINT AS errors, count(*) FILTER (k <> 0) AS sessions, coalesce(sum(CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE message_count END), 0)::BIGINT AS messages FROM c WHERE {where} GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN sessions = 0 THEN 'missing' WHEN new_files > 0 THEN 'source_set_changed' WHEN changed_files > 0 THEN 'source_content_changed' ELSE 'none' END AS stale_reason FROM g)
SELECT source_id, files, new_files, changed_files, unproven, lost_files, errors, sessions, messages, CASE stale_reason WHEN 'none' THEN 'fresh' WHEN 'missing' THEN 'missing' ELSE 'stale' END AS freshness, stale_reason,
       CASE WHEN stale_reason = 'none' OR (source_id = 'codex' AND stale_reason = 'source_content_changed' AND unproven = 0) THEN 'query' ELSE 'sync' END AS recommended_action FROM h
"""
STATUS = ["source_id", "files", "new_files", "changed_files", "unproven", "lost_files", "errors", "sessions", "messages", "freshness", "stale_reason", "recommended_action"]


@register("status_report", C_SQL + _STATUS_SQL.format(where="true"))
def status_all(spark, sf_dir):
    """Status after files came, grew, and were rewritten."""
    return refresh.status(files_now(spark, sf_dir), first_sync(spark, sf_dir)).select(*STATUS)


@register("status_of_grown_files", C_SQL + _STATUS_SQL.format(where="k IN (1, 3, 4)"))
def status_grown(spark, sf_dir):
    """Status where files only grew: each proves that its indexed bytes are still there."""
    only = case_of(F.col("file_path")).isin(GROWN, TOUCHED, SAME)
    tables = refresh.refresh(files_before(spark, sf_dir).where(only), refresh.empty_tables(spark)).tables
    return refresh.status(files_now(spark, sf_dir).where(only), tables).select(*STATUS)


@register("status_after_sync", C_SQL + " SELECT source_id, count(*) AS files, 'fresh' AS freshness, 'query' AS recommended_action, sum(message_count)::BIGINT AS messages FROM c GROUP BY 1")
def status_fresh(spark, sf_dir):
    """A sync's own proof holds for the files it has seen."""
    files = files_now(spark, sf_dir)
    tables = refresh.refresh(files, refresh.empty_tables(spark)).tables
    return refresh.status(files, tables).select("source_id", "files", "freshness", "recommended_action", "messages")


# Adapters: records beside messages


def odd_codex_lines(spark, sf_dir) -> DataFrame:
    """Codex files with summaries, reasoning, models and internal messages; some have nothing else, some nothing at all."""
    m = corpora.conv_messages(spark, sf_dir).where("source_id = 'codex'")
    js = lambda **k: F.to_json(F.struct(*(v.alias(n) for n, v in k.items())))
    lit, c = F.lit, F.col
    case = F.pmod(F.floor(c("native_session_id").cast("long") / 4), lit(3))
    kind = F.when(case == 1, "tool").when(c("role") == "user", "user_message").otherwise("agent_message")
    text = F.when(case == 0, F.concat(lit(adapters.INTERNAL_MARKERS[2] + "\n"), "body_text")).otherwise(c("body_text"))
    event = lambda kind, **payload: js(timestamp=c("timestamp"), type=lit(kind), payload=F.struct(*(v.alias(n) for n, v in payload.items())))
    said = event("event_msg", type=kind, message=text)
    every = {
        0: event("session_meta", id=lit("other"), cwd=c("cwd")),
        1: event("turn_context", model=F.concat(lit("m"), c("seq").cast("string")), cwd=lit("/turn")),
        2: F.when(case != 1, event("compacted", message=F.concat(lit("sum  "), (c("seq") / 2).cast("int").cast("string")))).otherwise(lit("[1]")),
        3: F.when(case != 1, event("response_item", type=lit("reasoning"), summary=F.array(F.struct(lit(" why ").alias("text")), F.struct(c("role").alias("text"))))).otherwise(lit("{")),
        4: said,
    }
    rows = None
    for k, value in every.items():
        part = m.select("source_id", "file_path", (c("seq") * 5 + k).alias("line_no"), value.alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumns({"raw_start": c("line_no"), "raw_end": c("line_no")})


@register(
    "codex_side_records",
    CONV_SQL + """, x AS (SELECT *, (native_session_id::BIGINT // 4) % 3 AS k FROM conv_s WHERE source_id = 'codex'),
    p AS (SELECT session_key, string_agg(DISTINCT 'sum ' || (seq // 2)::VARCHAR, ' | ' ORDER BY 'sum ' || (seq // 2)::VARCHAR) AS compact,
          'why' || CASE WHEN arg_min(role, seq) = 'user' THEN ' | user' || CASE WHEN bool_or(role = 'assistant') THEN ' | assistant' ELSE '' END ELSE ' | assistant' || CASE WHEN bool_or(role = 'user') THEN ' | user' ELSE '' END END AS why,
          max(seq) AS last FROM conv_m WHERE source_id = 'codex' GROUP BY 1)
    SELECT file_path, CASE k WHEN 0 THEN 'filtered' WHEN 1 THEN 'skipped' ELSE 'projected' END AS outcome, CASE WHEN k = 0 THEN message_count ELSE 0 END AS filtered_count, 'other' AS native_session_id, cwd,
           'm' || last AS model, path_date, CASE WHEN k = 1 THEN '' ELSE compact END AS compact_text, CASE WHEN k = 1 THEN '' ELSE why END AS reasoning_summary_text FROM x JOIN p USING (session_key)""",
)
def side_records(spark, sf_dir):
    """Outcome, counts, model, place and summaries of files with all kinds of records."""
    _, o = adapters.project_files(adapters.codex_events(odd_codex_lines(spark, sf_dir)))
    return o.select("file_path", "outcome", F.col("filtered_count").cast("long").alias("filtered_count"), "native_session_id", "cwd", "model", "path_date", "compact_text", "reasoning_summary_text")


def pi_lines(spark, sf_dir) -> DataFrame:
    """Pi files with two summaries a message; every third has no messages at all."""
    m = corpora.conv_messages(spark, sf_dir).where("source_id = 'pi'")
    js = lambda **k: F.to_json(F.struct(*(v.alias(n) for n, v in k.items())))
    c, lit = F.col, F.lit
    none = F.pmod(F.floor(c("native_session_id").cast("long") / 4), lit(3)) == 0
    role = F.when(none, "tool").otherwise(c("role"))
    head = js(type=lit("session"), id=c("native_session_id"), cwd=c("cwd"), timestamp=lit("2023-12-31T00:00:00.000Z"))
    values = {0: F.when(c("seq") == 0, head).otherwise(lit("null")), 1: js(type=lit("model_change"), modelId=F.concat(lit("p"), "role"))}
    values |= {2: js(type=lit("compaction"), summary=F.concat(lit("part  of "), "role"), timestamp=c("timestamp"))}
    values |= {3: js(type=lit("message"), message=F.struct(role.alias("role"), c("body_text").alias("content"), c("timestamp").alias("timestamp")))}
    rows = None
    for k, value in values.items():
        part = m.select("source_id", "file_path", (c("seq") * 4 + k).alias("line_no"), value.alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumns({"raw_start": c("line_no"), "raw_end": c("line_no")})


@register(
    "pi_side_records",
    CONV_SQL + """, x AS (SELECT *, (native_session_id::BIGINT // 4) % 3 = 0 AS bare FROM conv_s WHERE source_id = 'pi'),
    p AS (SELECT session_key, string_agg('part of ' || role, chr(10) || chr(10) ORDER BY seq) AS parts, arg_min(role, seq) AS first_role, arg_max(role, seq) AS last_role, max("timestamp") AS high FROM conv_m WHERE source_id = 'pi' GROUP BY 1)
    SELECT file_path, 'projected' AS outcome, session_key, 'p' || last_role AS model, CASE WHEN bare THEN '2023-12-31' ELSE path_date END AS path_date, left(parts, 20000) AS compact_text,
           CASE WHEN bare THEN 'part  of ' || first_role END AS title, '2023-12-31T00:00:00.000Z' AS meta_low, high AS meta_high FROM x JOIN p USING (session_key)""",
)
def pi_records(spark, sf_dir):
    """Summaries that are joined and not thinned out, and files that have nothing else."""
    _, o = adapters.project_files(adapters.pi_events(pi_lines(spark, sf_dir)))
    return o.select("file_path", "outcome", "session_key", "model", "path_date", "compact_text", "title", "meta_low", "meta_high")


# Coverage, retention, verification


@register(
    "coverage_of_sessions",
    DOC_SQL + "," + _WANTED_SQL.format(s="doc_s") + """, pr AS (SELECT * FROM sk WHERE substr(md5(selector_id), 1, 1) BETWEEN '2' AND '7')
    SELECT s.session_key, count(p.selector_id) > 0 AS complete, 'not_checked' AS freshness, count(p.selector_id) AS n_covering
    FROM doc_s s LEFT JOIN pr p ON p.source = s.source_id AND p.root = s.source_root AND (p.cwd IS NULL OR p.cwd = s.cwd) AND (p.d IS NULL OR p.d = s.path_date) GROUP BY 1""",
)
def covered_sessions(spark, sf_dir):
    """Which proofs hold each session."""
    s = keep(docs(spark, sf_dir)[1])
    c = coverage.session_coverage(s, proofs(s))
    return c.select("session_key", "complete", "freshness", F.size("covering_selectors").cast("long").alias("n_covering"))


def _evaluated(s: DataFrame) -> DataFrame:
    p = proofs(s)
    h = F.substring(F.md5("selector_key"), 1, 1)
    now = p.select("selector_key", F.when(h < "5", F.col("fingerprint")).otherwise("changed").alias("now_fingerprint"), F.when(h < "7", "set").otherwise("other").alias("now_file_set"), F.lit(1).alias("now_count"))
    return coverage.evaluate_records(p, now)


@register(
    "coverage_reasons",
    DOC_SQL + "," + _WANTED_SQL.format(s="doc_s") + """, e AS (SELECT substr(md5(selector_id), 1, 1) AS h FROM sk WHERE substr(md5(selector_id), 1, 1) < '8'),
    f AS (SELECT CASE WHEN h >= '2' AND h < '5' THEN 'fresh' ELSE 'stale' END AS freshness, CASE WHEN h >= '2' AND h < '5' THEN 'none' WHEN h >= '4' AND h < '7' THEN 'source_content_changed' ELSE 'source_set_changed' END AS stale_reason FROM e)
    SELECT freshness, stale_reason, count(*) AS records FROM f GROUP BY 1, 2""",
)
def reasons(spark, sf_dir):
    """Proofs by how fresh they are and why not."""
    return coverage.reason_counts(_evaluated(keep(docs(spark, sf_dir)[1])))


@register(
    "coverage_merged",
    DOC_SQL + """, f AS (SELECT session_key, list_transform(range(0, 3), lambda i: ['fresh', 'fresh', 'fresh', 'stale', 'missing', 'not_checked'][1 + (ord(substr(md5(session_key), (i + 1)::INT, 1)) % 6)::INT]) AS v FROM doc_s)
    SELECT session_key, CASE WHEN len(list_filter(v, lambda x: x <> 'fresh')) = 0 THEN 'fresh' WHEN list_contains(v, 'missing') THEN 'missing' WHEN list_contains(v, 'stale') THEN 'stale' ELSE 'not_checked' END AS freshness FROM f""",
)
def merged(spark, sf_dir):
    """Freshness over several sources."""
    states = F.array(*map(F.lit, ("fresh", "fresh", "fresh", "stale", "missing", "not_checked")))
    v = F.array(*(F.get(states, F.pmod(F.ascii(F.substring(F.md5("session_key"), i + 1, 1)), F.lit(6))) for i in range(3)))
    return docs(spark, sf_dir)[1].select("session_key", coverage.merged_freshness(v).alias("freshness"))


@register(
    "coverage_recorded",
    DOC_SQL + "," + _WANTED_SQL.format(s="doc_s") + """, h AS (SELECT *, substr(md5(selector_id), 1, 1) AS h FROM sk), broken AS (SELECT DISTINCT source, root FROM h WHERE h >= 'e'),
    old AS (SELECT * FROM h WHERE h < '8'), new AS (SELECT * FROM h WHERE h >= '4' AND h < 'e')
    SELECT selector_id AS selector_key, 'new' AS fingerprint FROM new UNION ALL
    SELECT selector_id, 'old' FROM old WHERE h < '4' AND NOT EXISTS (SELECT 1 FROM broken b WHERE b.source = old.source AND b.root = old.root)""",
)
def recorded(spark, sf_dir):
    """Proofs after a sync: complete ones replace their like, an incomplete one clears its source and root."""
    w = wanted(keep(docs(spark, sf_dir)[1]))
    old = w.where("h < '8'").select("selector_key", "source_id", "root", F.lit("old").alias("fingerprint"))
    new = w.where("h >= '4'").select("selector_key", "source_id", "root", F.lit("new").alias("fingerprint"), (F.col("h") < "e").alias("complete"))
    return coverage.record_coverage(old, new).select("selector_key", "fingerprint")


def wanted(s: DataFrame) -> DataFrame:
    from quarryline.plans.library import wanted_selectors

    w = wanted_selectors(s).select(F.col("selector_id").alias("selector_key"), F.col("s.source").alias("source_id"), F.col("s.root").alias("root"))
    return w.withColumn("h", F.substring(F.md5("selector_key"), 1, 1))


@register(
    "cold_root_registry",
    DOC_SQL + """, r AS (SELECT source_id, cwd AS root, min(started_at) AS added_at FROM doc_s GROUP BY 1, 2), gone AS (SELECT DISTINCT source_id, cwd AS root FROM doc_s WHERE source_id = 'pi')
    SELECT source_id, root, added_at FROM r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.source_id = r.source_id AND g.root = r.root)""",
)
def cold_roots(spark, sf_dir):
    """Roots registered again and again keep their first date; some are removed."""
    s = docs(spark, sf_dir)[1].select("source_id", F.col("cwd").alias("root"), F.col("started_at").alias("added_at"))
    registry = sync.add_cold_roots(s.where("added_at < '2024-06'"), s.where("added_at >= '2024-01-02'"))
    return sync.remove_cold_roots(registry, registry.where("source_id = 'pi'"))


@register(
    "files_with_sessions",
    C_SQL + " SELECT file_path, CASE WHEN k <> 0 THEN session_key END AS session_key, CASE WHEN k <> 0 THEN message_count END AS message_count FROM c",
)
def files_sessions(spark, sf_dir):
    """Known files with the sessions they gave, if any."""
    s = keep(conv(spark, sf_dir).sessions)
    files = s.select("source_id", "file_path", "session_key")
    held = s.where(case_of(F.col("file_path")) != NEW)
    return catalog.files_with_sessions(files, held).select("file_path", "session_key", "message_count")


@register(
    "file_set_fingerprints",
    DOC_SQL + """, f AS (SELECT source_id, source_root, regexp_replace(file_path, '/[^/]*$', '') AS folder, count(*) AS n, sha256(string_agg(file_path, chr(30) ORDER BY file_path)) AS d FROM doc_s GROUP BY 1, 2, 3)
    SELECT source_id, source_root, sum(n)::BIGINT AS file_count, sha256(string_agg(folder || chr(31) || d, chr(30) ORDER BY folder || chr(31) || d)) AS fingerprint FROM f GROUP BY 1, 2""",
)
def fingerprints(spark, sf_dir):
    return catalog.fingerprint_files(docs(spark, sf_dir)[1], with_content=False)


@register(
    "copy_verification",
    CONV_SQL + """ SELECT "table", rows_before, rows_after, changed FROM (
      SELECT 'documents' AS "table", (SELECT count(*) FROM conv_d) AS rows_before, (SELECT count(*) FROM conv_d) AS rows_after, (SELECT count(*) FROM conv_d WHERE source_id = 'pi' AND kind = 'message') > 0 AS changed
      UNION ALL SELECT 'messages', (SELECT count(*) FROM conv_m), (SELECT count(*) FROM conv_m) + (SELECT count(*) FROM conv_m WHERE source_id = 'codex'), (SELECT count(*) FROM conv_m WHERE source_id = 'codex') > 0
      UNION ALL SELECT 'sessions', (SELECT count(*) FROM conv_s), (SELECT count(*) FROM conv_s), false)""",
)
def verified(spark, sf_dir):
    """Tables against copies, of which one has other texts and one has rows twice."""
    c = conv(spark, sf_dir)
    d = c.documents
    changed = d.withColumn("body_text", F.when((F.col("source_id") == "pi") & (F.col("kind") == "message"), F.concat("body_text", F.lit("x"))).otherwise(F.col("body_text")))
    twice = c.messages.unionByName(c.messages.where("source_id = 'codex'"))
    return audit.compare_copies({"sessions": (c.sessions, c.sessions.repartition(3)), "documents": (d, changed), "messages": (c.messages, twice)})


@register(
    "write_checks",
    CONV_SQL + """ SELECT session_key, seq, rule FROM (SELECT session_key, seq, CASE seq % 7 WHEN 0 THEN 'session_key' WHEN 1 THEN 'role' WHEN 2 THEN 'seq' WHEN 3 THEN 'body_text' WHEN 4 THEN 'offsets' END AS rule FROM conv_m) WHERE rule IS NOT NULL""",
)
def write_checks(spark, sf_dir):
    """Messages that may not be written, each wrong in one way."""
    m = corpora.conv_messages(spark, sf_dir)
    n = F.pmod("seq", F.lit(7))
    rows = m.select(
        F.col("session_key").alias("key"), F.col("seq").alias("place"), F.when(n == 0, "").otherwise(F.col("session_key")).alias("session_key"), F.when(n == 1, "system").otherwise(F.col("role")).alias("role"),
        F.when(n == 2, -1).otherwise(F.col("seq")).alias("seq"), F.when(n == 3, "").otherwise(F.col("body_text")).alias("body_text"), F.lit(5).alias("raw_start"), F.when(n == 4, 4).otherwise(9).alias("raw_end"),
    )
    return audit.bad_messages(rows).select(F.col("key").alias("session_key"), F.col("place").alias("seq"), "rule")


@register(
    "audit_all_rules",
    CONV_SQL + """, n AS (SELECT *, native_session_id::BIGINT AS n FROM conv_s),
    x AS (SELECT *, n % 11 AS k FROM n)
    SELECT rule, key FROM (
      SELECT unnest(CASE k WHEN 0 THEN ['unknown_source', 'noncanonical_key'] WHEN 1 THEN ['noncanonical_key'] WHEN 2 THEN ['profile_mirror'] WHEN 3 THEN ['kind_or_role'] WHEN 4 THEN ['duplicate_session'] ELSE [] END) AS rule, session_key AS key FROM x
      UNION ALL SELECT 'orphan_document', d.doc_id FROM conv_d d JOIN x USING (session_key) WHERE k = 5
      UNION ALL SELECT 'not_indexed', d.doc_id FROM conv_d d JOIN x USING (session_key) WHERE k = 6
      UNION ALL SELECT 'index_without_document', d.doc_id || '!' FROM conv_d d JOIN x USING (session_key) WHERE k = 7
      UNION ALL SELECT 'bad_cursor', file_path FROM x WHERE k = 8 UNION ALL SELECT 'stale_next_seq', file_path FROM x WHERE k = 9
      UNION ALL SELECT CASE WHEN n % 2 = 0 THEN 'coverage_selector' ELSE 'coverage_key' END, session_key FROM x WHERE k = 10)""",
)
def all_rules(spark, sf_dir):
    """The rules on index, files and coverage too, each broken for one session in eleven."""
    c = conv(spark, sf_dir)
    k = F.pmod(F.element_at(F.split("session_key", ":"), 2).cast("long"), F.lit(11))
    s = c.sessions.withColumns({
        "source_id": F.when(k == 0, "none").otherwise(F.col("source_id")), "native_session_id": F.when(k == 1, F.concat("native_session_id", F.lit("?"))).otherwise(F.col("native_session_id")),
        "title": F.when(k == 2, "another").otherwise(F.col("title")),
    })
    s = s.unionByName(s.where(k == 4)).where(k != 5)
    d = c.documents.withColumn("role", F.when((k == 3) & (F.col("seq") == 0), "system").otherwise(F.col("role")))
    stats = c.documents.where(k != 6).select("doc_id").unionByName(c.documents.where(k == 7).select(F.concat("doc_id", F.lit("!")).alias("doc_id")))
    files = c.sessions.select(
        "file_path", "session_key", F.lit(10).alias("size"), F.when(k == 8, 11).otherwise(10).alias("indexed_bytes"), F.lit("sha").alias("prefix_sha"),
        F.when(k == 9, F.col("message_count") + 1).otherwise(F.col("message_count")).alias("next_seq"),
    )
    even = F.pmod(F.element_at(F.split("session_key", ":"), 2).cast("long"), F.lit(2)) == 0
    good = '{"kind":"all","source":"codex","root":"/logs"}'
    records = c.sessions.where(k == 10).select(F.when(even, '{"kind":"none"}').otherwise(good).alias("selector_json"), F.col("session_key").alias("selector_key"))
    records = records.unionByName(c.sessions.where(k != 10).select(F.lit(good).alias("selector_json"), F.lit(good).alias("selector_key")))
    return audit.violations(s, d, doc_stats=stats, files=files, coverage=records).select("rule", "key")


@register(
    "epoch_gate",
    C_SQL + " SELECT session_key, k < 3 AS readable, k < 2 AS coverage_shown FROM c",
)
def epochs(spark, sf_dir):
    """Tables of another content version cannot be read; of another coverage version, their proofs do not count."""
    s = conv(spark, sf_dir).sessions
    k = case_of(F.col("file_path"))
    meta = s.select("session_key", F.when(k < 3, project.INDEX_VERSION).otherwise("older").alias("index_version"), F.when(k < 2, sync.EPOCH).otherwise(0).alias("coverage_epoch"))
    return audit.epoch_gate(meta).select("session_key", "readable", "coverage_shown")
