"""Queries over the finer parts of search and reading: literal and relaxed recall, commands, snippets, anchors, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import relax
from quarryline.functions import text as T
from quarryline.operators import catalog, coverage, evaluate, project, read, recall, selectors, sync
from quarryline.operators import find as find_op
from quarryline.operators import index as ix
from quarryline.operators import rank as rk
from quarryline.plans import corpora
from quarryline.plans.library import _ELIDE_SQL, _WANTED_SQL, DOC_SQL, docs, proofs, register
from quarryline.plans.registry import ORACLES
from quarryline.plans.search import CONV_SQL, NOW, Corpus, _head, candidates_sql, conv, conversation_queries, merged_sql, ranked_sql, result_rows, scored_sql
from quarryline.sources import jsonl
from quarryline.storage import keep

#: Letters that become Han characters in the corpus for literal searches.
LETTERS, HAN = "zqxjk", "字区小机开"
_HAN_SQL = f"translate({{}}, '{LETTERS}', '{HAN}')"
HAN_MESSAGES_SQL = corpora.CONV_MESSAGES_SQL.replace("conv_m AS", "conv_m0 AS") + f", conv_m AS (SELECT * REPLACE ({_HAN_SQL.format('body_text')} AS body_text) FROM conv_m0)"
HAN_CORPUS_SQL = "WITH " + ",".join([HAN_MESSAGES_SQL, project.sessions_sql("conv_m", "conv_s"), project.documents_sql("conv_m", "conv_s", "conv_d")])
_HAN_LIST = ", ".join(f"('{c}')" for c in HAN)
_CONTENT = "concat_ws(chr(10), body_text, title_text, summary_text, compact_text, reasoning_text)"


def han_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = corpora.conv_messages(spark, sf_dir)
    return m.withColumn("body_text", F.translate("body_text", LETTERS, HAN))


def han_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, c) for c in HAN], "query_id string, query string")


# Recall beside terms


@register("recall_literal", HAN_CORPUS_SQL + f" SELECT n.c AS query_id, doc_id, 0.0::DOUBLE AS fts_score FROM conv_d, (VALUES {_HAN_LIST}) n(c) WHERE contains({_CONTENT}, n.c)")
def literal(spark, sf_dir):
    """Single Han characters, which have no terms, are looked for in all texts."""
    m = han_messages(spark, sf_dir)
    d = project.build_documents(m, project.build_sessions(m))
    return recall.literal_matches(recall.analyzed_queries(han_queries(spark)), d)


_PAIRS = ("字 区", "小 机", "开")
_PAIR_LIST = ", ".join(f"('{c}')" for c in _PAIRS)


@register("recall_literal_indexed", HAN_CORPUS_SQL + f" SELECT n.c AS query_id, doc_id, 0.0::DOUBLE AS fts_score FROM conv_d, (VALUES {_PAIR_LIST}, {_HAN_LIST}) n(c) WHERE " + " OR ".join(f"contains({c}, n.c)" for c in ("body_text", "title_text", "summary_text")) + " GROUP BY ALL")
def literal_indexed(spark, sf_dir):
    """The same, and needles of several lone characters, by the index of characters."""
    c = Corpus(han_messages(spark, sf_dir)).searchable()
    queries = spark.createDataFrame([(x, x) for x in dict.fromkeys([*_PAIRS, *HAN])], "query_id string, query string")
    return recall.literal_matches(recall.analyzed_queries(queries), c.documents, c.index.chars)


_LITERAL_SQL = HAN_CORPUS_SQL + f"""
, qq AS (SELECT c AS query_id, c AS query, c AS nq, []::VARCHAR[] AS terms FROM (VALUES {_HAN_LIST}) n(c)),
hits AS (SELECT n.query_id, doc_id, 0.0::DOUBLE AS fts_score FROM conv_d, qq n WHERE contains({_CONTENT}, n.nq))
"""


@register("find_literal", ",".join([_LITERAL_SQL, candidates_sql(5), ranked_sql(5), merged_sql(5)]))
def find_literal(spark, sf_dir):
    c = Corpus(han_messages(spark, sf_dir)).searchable()
    return result_rows(find_op.find(han_queries(spark), c.documents, c.sessions, c.index, now=NOW, limit=5))


@register(
    "literal_snippets",
    "WITH " + HAN_MESSAGES_SQL + f""", p AS (SELECT session_key, seq, body_text AS t, c, strpos(body_text, c) - 1 AS p_, length(body_text) AS n FROM conv_m, (VALUES {_HAN_LIST}) x(c))
    SELECT session_key, seq, c AS needle, CASE WHEN p_ < 0 THEN left(t, 160) ELSE CASE WHEN p_ > 40 THEN '…' ELSE '' END || replace(substr(t, greatest(p_ - 40, 0) + 1, least(p_ + 81, n) - greatest(p_ - 40, 0)), c, '<mark>' || c || '</mark>')
           || CASE WHEN p_ + 81 < n THEN '…' ELSE '' END END AS snippet FROM p""",
)
def literal_snippets(spark, sf_dir):
    """A window round a literal needle in every message."""
    m = han_messages(spark, sf_dir).select("session_key", "seq", "body_text", F.explode(F.array(*map(F.lit, HAN))).alias("needle"))
    return m.select("session_key", "seq", "needle", read.literal_snippet(F.col("body_text"), F.col("needle")).alias("snippet"))


@register(
    "cjk_predicates",
    "WITH " + HAN_MESSAGES_SQL + r""" SELECT session_key, seq, regexp_matches(body_text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]') AS has_cjk, regexp_matches(substr(body_text, 3, 2), '^[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+$') AS pair_is_cjk,
    length(body_text) + length(regexp_replace(translate(body_text, 'w', '😀'), '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS utf16 FROM conv_m""",
)
def cjk(spark, sf_dir):
    """Script tests, and lengths in UTF-16 units of texts with characters outside the basic plane."""
    t = F.col("body_text")
    wide = T.utf16_length(F.translate(t, "w", "😀")).cast("long")
    return han_messages(spark, sf_dir).select("session_key", "seq", T.has_cjk(t).alias("has_cjk"), T.is_cjk_token(F.substring(t, 3, 2)).alias("pair_is_cjk"), wide.alias("utf16"))


_RELAXED_SQL = CONV_SQL + "," + ix.index_sql("conv_d", "conv") + f"""
, w0 AS (SELECT session_key, list_sort(list_transform(list_filter(list_distinct({ix.tokens_sql("t")}), lambda x: regexp_matches(x, '^[a-z]{{5,}}$') AND NOT regexp_matches(x, '(s|ie)$')), lambda x: {{'n': -length(x), 'x': x}}))[1].x AS w
       FROM (SELECT session_key, arg_min(body_text, seq) AS t FROM conv_m WHERE role = 'user' GROUP BY 1)),
w1 AS (SELECT * FROM w0 WHERE w IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conv_post p WHERE p.term = w || 's')),
qq AS (SELECT session_key AS query_id, 'the ' || w || 's' AS query, 'the ' || w || 's' AS nq, ['the', w || 's'] AS terms FROM w1),
qt AS (SELECT session_key AS query_id, w AS token, 1 AS n_terms, w AS term FROM w1)
"""


@register("find_relaxed", ",".join([_RELAXED_SQL, scored_sql(), candidates_sql(5), ranked_sql(5), merged_sql(5)]))
def relaxed(spark, sf_dir):
    """Queries that only a relaxed form answers: a stop word and the plural of a word that has no plural in the corpus."""
    c = conv(spark, sf_dir).searchable()
    first = c.messages.where("role = 'user'").groupBy("session_key").agg(F.min_by("body_text", "seq").alias("t"))
    words = F.filter(T.query_terms(F.col("t")), lambda x: x.rlike("^[a-z]{5,}$") & ~x.rlike("(s|ie)$"))
    longest = F.get(F.sort_array(F.transform(words, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), F.lit(0))["x"]
    one = first.select("session_key", longest.alias("w")).where("w is not null").withColumn("term", F.concat("w", F.lit("s")))
    one = one.join(c.index.postings.select("term").distinct(), "term", "left_anti")
    q = keep(one.select(F.col("session_key").alias("query_id"), F.concat(F.lit("the "), "term").alias("query")))
    return result_rows(find_op.find(q, c.documents, c.sessions, c.index, now=NOW, limit=5))


@register(
    "relaxed_forms",
    CONV_SQL + f""", t AS (SELECT session_key, seq, list_filter(list_distinct({ix.tokens_sql("body_text")}), lambda x: regexp_matches(x, '^[a-z]{{5,}}$') AND NOT regexp_matches(x, '(s|ie)$')) AS ws FROM conv_m),
    u AS (SELECT session_key, seq, list_sort(ws)[1] AS a, list_sort(ws)[2] AS b FROM t WHERE len(ws) > 1)
    SELECT session_key, seq, array_to_string([a || '_' || b, a || ' ' || b, a || ' ' || b || 's', a || '_' || b || 's'], '|') AS forms FROM u""",
)
def forms(spark, sf_dir):
    """Forms of a stop word and a compound of two words of each message."""
    ws = F.sort_array(F.filter(T.query_terms(F.col("body_text")), lambda x: x.rlike("^[a-z]{5,}$") & ~x.rlike("(s|ie)$")))
    m = corpora.conv_messages(spark, sf_dir).select("session_key", "seq", ws.alias("ws")).where("size(ws) > 1")
    query = F.concat(F.lit("where is "), F.get("ws", F.lit(0)), F.lit("_"), F.get("ws", F.lit(1)))
    return m.select("session_key", "seq", F.array_join(relax.relaxed_queries(query), "|").alias("forms"))


# Commands


#: Texts in which every e is a slash have paths; a command is a plain word and a path of two parts that follow one another.
_COMMAND = "[a-z]+ [a-z]+/[a-z]+"
_INNER = r"\p{L}\p{N}_./-"


@register(
    "command_features",
    CONV_SQL + f""", m AS (SELECT session_key, seq, role, replace(lower(body_text), 'e', '/') AS t FROM conv_m),
    q0 AS (SELECT session_key, regexp_extract(arg_min(t, seq), '{_COMMAND}') AS q, left(arg_min(t, seq), 120) AS title FROM m GROUP BY 1),
    q AS (SELECT *, {ix.tokens_sql("q")} AS ts FROM q0 WHERE q <> ''),
    p AS (SELECT session_key, seq, q, title, ts, t, {ix.tokens_sql("t")} AS toks FROM m JOIN q USING (session_key) WHERE len(list_distinct(ts)) = 3),
    r AS (SELECT *, list_filter(range(len(toks)), lambda i: toks[i + 1] = ts[1]) AS p0, list_filter(range(len(toks)), lambda i: toks[i + 1] = ts[2]) AS p1, list_filter(range(len(toks)), lambda i: toks[i + 1] = ts[3]) AS p2,
                 regexp_matches(t, '(^|[^{_INNER}])' || q || '($|[^{_INNER}])') AS bounded,
                 regexp_matches(t, '(^|[^{_INNER}])' || q || '[^\\n{_INNER}][^\\n]{{0,78}}[./]') OR regexp_matches(t, '(^|[^{_INNER}])' || q || '([^\\n{_INNER}][^\\n]{{0,75}})?[^\\S\\n]--?[a-z0-9]') AS args FROM p),
    s AS (SELECT *, list_min(list_transform(p0, lambda a: list_min(list_filter(p2, lambda c: c > list_min(list_filter(p1, lambda b: b > a)))) - a + 1)) AS span FROM r)
    SELECT session_key, seq, q AS query, bounded, args, span, CASE WHEN bounded THEN CASE WHEN args THEN 60.0 ELSE 36.0 END WHEN span IS NULL THEN 0.0 WHEN span = 3 THEN 8.0 WHEN span <= 6 THEN 24.0 - 2.0 * (span - 3) ELSE 0.0 END::DOUBLE AS bonus,
           regexp_matches(title, '(^|[^{_INNER}])' || q || '($|[^{_INNER}])') AND len({ix.tokens_sql("replace(title, q, ' ')")}) >= 2 AS restates FROM s""",
)
def command_features(spark, sf_dir):
    """What the score of a command-like query sees in each message of its session."""
    m = corpora.conv_messages(spark, sf_dir).select("session_key", "seq", F.replace(F.lower("body_text"), F.lit("e"), F.lit("/")).alias("t"))
    first = m.groupBy("session_key").agg(F.min_by("t", "seq").alias("first"))
    q = first.select("session_key", F.substring("first", 1, 120).alias("title"), F.regexp_extract("first", _COMMAND, 0).alias("query")).where("query <> ''")
    q = q.withColumn("a", T.analyze_query(F.col("query"))).where("size(a.terms) = 3")
    a, t = F.col("a"), F.col("t")
    return m.join(q, "session_key").select(
        "session_key", "seq", "query", T.has_bounded_phrase(t, a["normalized"]).alias("bounded"), T.has_trailing_arguments(t, a["normalized"]).alias("args"),
        T.shortest_ordered_span(T.tokenize(t), a["terms"]).cast("long").alias("span"), rk.path_bonus(t, a).alias("bonus"), rk.title_restates(F.col("title"), a).alias("restates"),
    )


# Texts as shown


@register(
    "snippets_of_phrases",
    CONV_SQL + """, t AS (SELECT session_key, seq, lower(body_text) AS t FROM conv_m), p AS (SELECT *, substr(t, 60, 12) AS q, length(t) AS n FROM t),
    w AS (SELECT *, strpos(t, q) - 1 AS p_ FROM p)
    SELECT session_key, seq, CASE WHEN q = '' THEN left(t, 160) ELSE CASE WHEN p_ > 40 THEN '…' ELSE '' END || replace(substr(t, greatest(p_ - 40, 0) + 1, least(p_ + length(q) + 80, n) - greatest(p_ - 40, 0)), q, '<mark>' || q || '</mark>')
           || CASE WHEN p_ + length(q) + 80 < n THEN '…' ELSE '' END END AS snippet FROM w""",
)
def phrase_snippets(spark, sf_dir):
    """Snippets round a stretch of each message itself."""
    t = F.lower("body_text")
    none = F.array().cast("array<string>")
    return corpora.conv_messages(spark, sf_dir).select("session_key", "seq", read.snippet(t, F.substring(t, 60, 12), none).alias("snippet"))


@register(
    "matched_profile_fields",
    ",".join([_head]) + """ SELECT query_id, s.session_key, array_to_string(list_filter([CASE WHEN len(list_filter(terms, lambda x: contains(lower(s.title), x))) > 0 OR contains(lower(s.title), nq) THEN 'title' END,
    CASE WHEN len(list_filter(terms, lambda x: contains(lower(s.summary_text), x))) > 0 OR contains(lower(s.summary_text), nq) THEN 'summary' END], lambda x: x IS NOT NULL), ',') AS fields FROM qq JOIN conv_s s ON s.source_id = split_part(qq.query_id, ':', 1)""",
)
def profile_fields(spark, sf_dir):
    """Which fields of the profiles of its source a query matches."""
    c = conv(spark, sf_dir)
    q = conversation_queries(c).select("query_id", F.substring_index("query_id", ":", 1).alias("source_id"), T.analyze_query(F.col("query")).alias("a"))
    return rk.matched_profiles(q, c.sessions)


@register(
    "display_lines",
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g'), ' the ', ' <mark>the</mark> '), '\s+', ' ', 'g')) AS m FROM documents), u AS (SELECT doc_id, replace(replace(m, '<mark>', ''), '</mark>', '') AS d, m FROM t)
    SELECT doc_id, CASE WHEN length(d) > 100 THEN left(d, 99) || '…' ELSE d END AS line, replace(replace(replace(left(d, 30), '\', '\\'), '%', '\%'), '_', '\_') AS liked, '"' || replace(left(d, 30), '"', '""') || '"' AS quoted, sha256(left(m, 64)) AS prefix FROM u""",
)
def display_lines(spark, sf_dir):
    """Texts as single lines without marks, escaped for patterns and expressions, and the digest of a prefix."""
    t = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?"), F.lit(" the "), F.lit(" <mark>the</mark> "))
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", T.squeeze(t).alias("m")).withColumn("d", F.regexp_replace("m", "</?mark>", ""))
    short = F.substring("d", 1, 30)
    digest = jsonl.prefix_digest(F.encode("m", "UTF-8"), F.lit(64))
    return d.select("doc_id", T.display_text(F.col("m"), 100).alias("line"), T.escape_like(short).alias("liked"), T.quote_term(short).alias("quoted"), digest.alias("prefix"))


@register(
    "zero_result_advice",
    DOC_SQL + """, v AS (SELECT session_key, ['fresh', 'stale', 'missing', 'not_checked'][1 + (message_count % 4)::INT] AS f, message_count % 3 = 0 AS s, message_count % 2 AS n FROM doc_s)
    SELECT session_key, CASE f WHEN 'fresh' THEN 'fresh_miss' WHEN 'not_checked' THEN 'coverage_not_confirmed' ELSE 'stale_or_missing_coverage' END AS diagnosis,
           CASE WHEN f IN ('stale', 'missing') OR (n = 0 AND s) THEN 'check-coverage-then-retry' WHEN n = 0 THEN 'choose-selector-then-check-coverage' END AS kind,
           CASE WHEN f IN ('stale', 'missing') THEN 'stale_or_missing_coverage' WHEN n = 0 AND s THEN 'zero_results_with_unconfirmed_selector_coverage' WHEN n = 0 THEN 'zero_results_without_selector' END AS reason FROM v""",
)
def advice(spark, sf_dir):
    """What an empty result means and what to do next, by coverage, selector and number of results."""
    n = F.col("message_count")
    f = F.get(F.array(*map(F.lit, ("fresh", "stale", "missing", "not_checked"))), F.pmod(n, F.lit(4)).cast("int"))
    s = docs(spark, sf_dir)[1].select("session_key", f.alias("f"), relax.next_action(F.pmod(n, F.lit(3)) == 0, F.pmod(n, F.lit(2)), f).alias("act"))
    return s.select("session_key", relax.diagnosis(F.col("f")).alias("diagnosis"), "act.kind", "act.reason")


# Reading


_IN_SESSION_SQL = ",".join([_head, candidates_sql(4, scope="h.query_id = session_key"), ranked_sql(4)])


@register(
    "read_range_by_query",
    _IN_SESSION_SQL + """, a AS (SELECT query_id, nullif(shown_seq, -1) AS anchor_seq FROM res WHERE rank = 1)
    SELECT q.query_id AS request_id, CASE WHEN a.anchor_seq IS NULL THEN 'anchor_not_found' ELSE 'anchored' END AS status, a.anchor_seq, m.seq
    FROM qq q LEFT JOIN a USING (query_id) LEFT JOIN conv_m m ON m.session_key = q.query_id AND m.seq BETWEEN greatest(a.anchor_seq - 2, 0) AND a.anchor_seq + 2""",
)
def range_by_query(spark, sf_dir):
    """The neighbourhood of the message that answers a query within its session; a session may have none."""
    c = conv(spark, sf_dir).searchable()
    q = conversation_queries(c).withColumn("session_key", F.col("query_id"))
    r = find_op.read_range(q.withColumnsRenamed({"query_id": "request_id"}), c.messages, c.documents, c.sessions, c.index, now=NOW)
    return r.select("request_id", "status", "anchor_seq", "seq")


@register("read_page_elided", DOC_SQL + f" SELECT session_key, seq, {_ELIDE_SQL}, total > 3 AS has_more FROM doc_m JOIN (SELECT session_key, count(*) AS total FROM doc_m GROUP BY 1) USING (session_key) WHERE seq < 3")
def page_elided(spark, sf_dir):
    """The first page of each session, long messages shortened."""
    m = corpora.doc_messages(spark, sf_dir)
    requests = m.select("session_key").distinct().withColumns({"offset": F.lit(0), "limit": F.lit(3)})
    p = read.page(m, requests).withColumn("e", read.elide(F.col("body_text")))
    return p.select("session_key", "seq", F.col("e.text").alias("body"), F.col("e.omitted").cast("long").alias("omitted"), "has_more")


_MERGED5 = ",".join([_head, candidates_sql(5), ranked_sql(5), merged_sql(5).rpartition("SELECT query_id, mrank")[0]])


@register(
    "result_evidence_json",
    _MERGED5 + """ SELECT query_id, mrank AS rank, '{"kind":"read-range","reason":"' || CASE WHEN shown_seq >= 0 THEN 'message_match' ELSE 'session_level_match' END || '","source_id":"' || source_id || '","session_ref":"' || session_ref || '"'
    || CASE WHEN shown_seq >= 0 THEN ',"seq":' || shown_seq ELSE '' END || ',"query":"' || query || '","before":2,"after":2}' AS evidence FROM merged JOIN (SELECT query_id, query FROM qq) USING (query_id) WHERE mrank <= 5""",
)
def evidence_json(spark, sf_dir):
    """Each result with the action that reads its evidence, as JSON."""
    c = conv(spark, sf_dir).searchable()
    q = conversation_queries(c)
    r = read.with_evidence(find_op.find(q, c.documents, c.sessions, c.index, now=NOW, limit=5), q)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), F.to_json("evidence").alias("evidence"))


@register(
    "find_summaries",
    ",".join([_head, candidates_sql(3), ranked_sql(3), merged_sql(3).rpartition("SELECT query_id, mrank")[0]]) + """
    , n AS (SELECT query_id, count(*) AS n FROM merged WHERE mrank <= 3 GROUP BY 1), every AS (SELECT query_id, length(query) % 2 = 1 AS miss FROM qq),
    t AS (SELECT sum(message_count)::BIGINT AS scanned, count(DISTINCT source_id) AS sources FROM conv_s),
    k AS (SELECT query_id, CASE WHEN miss THEN 0 ELSE coalesce(n, 0) END AS n_results FROM every LEFT JOIN n USING (query_id))
    SELECT query_id, n_results, scanned AS scanned_message_count, false AS complete, 'not_checked' AS freshness, CASE WHEN n_results = 0 THEN 'coverage_not_confirmed' END AS diagnosis,
           CASE WHEN n_results = 0 THEN 'choose-selector-then-check-coverage' END AS next_action FROM k, t""",
)
def summaries(spark, sf_dir):
    """Per query: results, what was searched, how far that is proven, and what to do; every other query has no results."""
    c = conv(spark, sf_dir).searchable()
    q = conversation_queries(c)
    q = keep(q.withColumn("query", F.when(F.length("query") % 2 == 1, F.concat("query", F.lit(" zzqxzz"))).otherwise(F.col("query"))))
    r = find_op.find(q, c.documents, c.sessions, c.index, now=NOW, limit=3)
    scopes = coverage.session_selectors(c.sessions).where("requested.kind = 'all'").select("requested").distinct()
    scopes = scopes.select(selectors.storage_key(F.col("requested")).alias("request_id"), "requested")
    records = scopes.where("requested.source <> 'pi'").select(F.col("request_id").alias("selector_key"), F.col("requested").alias("selector"), F.lit(project.INDEX_VERSION).alias("record_version"))
    s = find_op.find_summary(q, r, c.sessions, scopes, records)
    return s.select("query_id", "n_results", "scanned_message_count", "complete", "freshness", "diagnosis", F.col("next_action.kind").alias("next_action"))


# Files and selectors


@register(
    "file_lines",
    r"""WITH f AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\n', chr(13) || chr(10)), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS line_no, len(ls) AS n FROM f),
    o AS (SELECT *, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_start, regexp_replace(raw, '\r$', '') AS value FROM l)
    SELECT doc_id, line_no, raw_start, raw_start + strlen(value) AS raw_end, sha256(value) AS value_sha256, line_no = n - 1 AS is_tail FROM o WHERE trim(value) <> ''""",
)
def file_lines(spark, sf_dir):
    """Texts as files: records with byte offsets, and the last, unfinished one as a metadata read has it."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^([^\n]*)\n", "$1\r\n")
    d = corpora.table(spark, sf_dir, "documents").select(F.lit("pi").alias("source_id"), F.col("doc_id").cast("string").alias("file_path"), F.encode(text, "UTF-8").alias("content"))
    done = jsonl.lines(d).withColumn("is_tail", F.lit(False))
    every = jsonl.lines(d, keep_tail=True)
    tail = every.join(done.select("file_path", "line_no"), ["file_path", "line_no"], "left_anti").withColumn("is_tail", F.lit(True))
    rows = done.unionByName(tail)
    return rows.select(F.col("file_path").cast("long").alias("doc_id"), "line_no", "raw_start", "raw_end", F.sha2("value", 256).alias("value_sha256"), "is_tail")


_UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@register("archived_ids", f"SELECT DISTINCT {_UUID_SQL} AS native_session_id FROM (SELECT md5(source || lang) AS h FROM documents)")
def archived(spark, sf_dir):
    """Ids that the names of archived files end with; files without one, or of other kinds, have none."""
    h = F.md5(F.concat("source", "lang"))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    d = corpora.table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("rollout-00000000-0000-4000-8000-000000000000-"), F.upper(uuid), F.lit(".jsonl.zst"))).otherwise(F.concat(uuid, F.lit(".jsonl")))
    names = d.select(name.alias("name")).unionByName(d.select(F.concat(F.lit("x"), F.md5("lang"), F.lit(".jsonl")).alias("name"))).unionByName(d.select(F.lit("00000000-0000-4000-8000-000000000001.txt").alias("name")))
    return jsonl.ids_of_names(names)


@register(
    "golden_files",
    """WITH g AS (SELECT 'g' || doc_id % 10 AS file_path, doc_id // 10 AS line_no, doc_id % 5 AS k, doc_id FROM documents)
    SELECT file_path, line_no + 1 AS line, CASE WHEN k = 4 THEN doc_id::VARCHAR END AS id, k < 4 AS bad FROM g WHERE k > 1""",
)
def golden_files(spark, sf_dir):
    """Golden queries of JSON lines: comments and blanks are passed over, bad lines come with their number."""
    i = F.col("doc_id")
    k = F.pmod(i, F.lit(5))
    value = F.when(k == 0, "# note").when(k == 1, " ").when(k == 2, "{broken").when(k == 3, '{"id":"x"}').otherwise(F.to_json(F.struct(i.cast("string").alias("id"), F.lit("words").alias("query"))))
    rows = corpora.table(spark, sf_dir, "documents").select(F.concat(F.lit("g"), F.pmod(i, F.lit(10)).cast("string")).alias("file_path"), F.floor(i / 10).cast("long").alias("line_no"), value.alias("value"))
    good, bad = evaluate.goldens_of(rows, "id string, query string")
    return good.select("file_path", "line", "id", F.lit(False).alias("bad")).unionByName(bad.select("file_path", "line", F.lit(None).cast("string").alias("id"), F.lit(True).alias("bad")))


@register(
    "selectors_checked",
    DOC_SQL + """, s AS (SELECT session_key, message_count % 6 AS k, cwd, path_date AS d FROM doc_s)
    SELECT session_key, CASE k WHEN 0 THEN 'kind' WHEN 1 THEN 'cwd' WHEN 2 THEN 'fromDate' WHEN 3 THEN 'reversed' END AS error,
           CASE k WHEN 4 THEN '{"kind":"cwd","source":"codex","root":"/logs","cwd":"' || cwd || '"}' WHEN 5 THEN '{"kind":"date_range","source":"pi","root":"/r","fromDate":"' || d || '","toDate":"' || d || '"}' END AS storage_key FROM s""",
)
def checked(spark, sf_dir):
    """Selectors with defaults filled in, or what is wrong with them."""
    k, cwd, d = F.pmod("message_count", F.lit(6)), F.col("cwd"), F.col("path_date")
    pad = F.concat(F.lit(" "), cwd, F.lit(" "))
    js = lambda **v: F.to_json(F.struct(*(c.alias(n) for n, c in v.items())))
    dated = lambda a, b: js(kind=F.lit("date_range"), source=F.lit("pi"), root=F.lit(" /r "), fromDate=a, toDate=b)
    text = (
        F.when(k == 0, js(kind=F.lit("some"))).when(k == 1, js(kind=F.lit("cwd"), cwd=F.lit(" "))).when(k == 2, dated(F.lit("2024-1-1"), d)).when(k == 3, dated(F.lit("2999-01-01"), d))
        .when(k == 4, js(kind=F.lit("cwd"), cwd=pad)).otherwise(dated(d, F.concat(d, F.lit(" "))))
    )
    c = docs(spark, sf_dir)[1].select("session_key", selectors.canonical(text, default_root="/logs").alias("c"))
    return c.select("session_key", "c.error", selectors.storage_key(F.col("c.selector")).alias("storage_key"))


@register(
    "exclusion_forms",
    DOC_SQL + """ SELECT session_key FROM doc_s WHERE NOT (session_key LIKE '%1' OR (native_session_id LIKE '%2' AND source_id = 'codex') OR (session_uuid LIKE '%3'))""",
)
def exclusions(spark, sf_dir):
    """Sessions left after exclusions by bare id, by id within a source, and by reference."""
    s = keep(docs(spark, sf_dir)[1])
    by_source = s.where("session_key like '%1'").select(F.concat(F.lit(" "), "session_key").alias("value"))
    within = s.where("native_session_id like '%2'").select(F.concat(F.lit("codex:"), "native_session_id").alias("value"))
    bare = s.where("session_uuid like '%3' and source_id = 'codex'").select(F.col("session_uuid").alias("value"))
    named = s.where("session_uuid like '%3' and source_id <> 'codex'").select(F.col("session_key").alias("value"))
    gone = recall.exclusions(by_source.unionByName(within).unionByName(bare).unionByName(named))
    own = s.withColumn("wanted", F.lit(1))
    return recall.excluded(own, gone).select("session_key")


@register(
    "file_sets_compared",
    DOC_SQL + " SELECT source_id, count(*) FILTER (session_key LIKE '%3') = 0 AS same FROM doc_s GROUP BY 1",
)
def file_sets(spark, sf_dir):
    """Sources whose set of files is the same at two looks."""
    s = keep(docs(spark, sf_dir)[1])
    return sync.same_file_sets(s, s.where("session_key not like '%3'"))


@register("inventory_order", DOC_SQL + " SELECT source_id, cwd, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, cwd) AS place FROM doc_s GROUP BY 1, 2")
def inventory_order(spark, sf_dir):
    return catalog.inventory(docs(spark, sf_dir)[1]).select("source_id", "cwd", F.col("place").cast("long").alias("place"))


@register(
    "source_stats_with_coverage",
    DOC_SQL + "," + _WANTED_SQL.format(s="doc_s") + """, p AS (SELECT source, count(*) AS n FROM sk WHERE substr(md5(selector_id), 1, 1) BETWEEN '2' AND '7' GROUP BY 1)
    SELECT source_id, count(*) AS session_count, sum(message_count)::BIGINT AS message_count, coalesce(any_value(n), 0) AS coverage_records FROM doc_s LEFT JOIN p ON p.source = source_id GROUP BY 1""",
)
def stats_coverage(spark, sf_dir):
    s = keep(docs(spark, sf_dir)[1])
    return catalog.stats_with_coverage(s, proofs(s)).select("source_id", "session_count", "message_count", "coverage_records")


# Evaluation


def _goldens(spark, sf_dir) -> tuple[Corpus, DataFrame, DataFrame]:
    c = conv(spark, sf_dir).searchable()
    q = conversation_queries(c)
    r = keep(find_op.find(q, c.documents, c.sessions, c.index, now=NOW, limit=5))
    own = q.join(c.sessions.select(F.col("session_key").alias("query_id"), "source_id", "session_uuid", "cwd", "title"), "query_id")
    return c, r, own


@register(
    "golden_keyword_marks",
    _MERGED5 + """, g AS (SELECT session_key AS query_id, lower(left(title, 9)) AS t, CASE WHEN message_count % 2 = 0 THEN upper(cwd) END AS c FROM conv_s WHERE session_key IN (SELECT query_id FROM qq)),
    h AS (SELECT g.query_id, bool_or(coalesce(contains(lower(s.title), g.t) OR contains(lower(s.summary_text), g.t), false)) AS ht, bool_or(coalesce(contains(lower(s.cwd), lower(g.c)), false)) AS hc, any_value(g.c) AS c
          FROM g LEFT JOIN (SELECT query_id, session_key FROM merged WHERE mrank <= 3) m USING (query_id) LEFT JOIN conv_s s ON s.session_key = m.session_key GROUP BY 1)
    SELECT query_id, CASE WHEN ht AND (c IS NULL OR hc) THEN 'pass' ELSE 'fail' END AS mark FROM h""",
)
def keyword_marks(spark, sf_dir):
    """Keyword goldens: the start of the session's own title, and for every other one its directory."""
    c, r, own = _goldens(spark, sf_dir)
    n = c.sessions.select(F.col("session_key").alias("query_id"), "message_count")
    g = own.join(n, "query_id").select("query_id", F.substring("title", 1, 9).alias("title_or_summary"), F.when(F.col("message_count") % 2 == 0, F.upper("cwd")).alias("cwd"), F.lit(None).cast("string").alias("snippet"))
    return evaluate.keyword_check(g, r.withColumn("snippet", F.col("content")), top_k=3)


@register(
    "golden_scoreboard",
    _MERGED5 + """, g AS (SELECT session_key AS query_id, source_id, session_uuid, message_count % 2 = 0 AS hard FROM conv_s WHERE session_key IN (SELECT query_id FROM qq)),
    p AS (SELECT g.query_id, any_value(hard) AS hard, bool_or(coalesce(m.session_key = g.query_id, false)) AS ok FROM g LEFT JOIN (SELECT query_id, session_key FROM merged WHERE mrank <= 2) m USING (query_id) GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (ok) AS pass, count(*) FILTER (NOT ok) AS fail, 0::BIGINT AS skip, count(*) FILTER (NOT ok AND hard) AS hard_fail, count(*) FILTER (NOT ok AND NOT hard) AS candidate_fail,
           count(*) FILTER (ok) AS assertion_pass, count(*) FILTER (NOT ok) AS assertion_fail, 0::BIGINT AS facet_pass, 0::BIGINT AS facet_fail FROM p""",
)
def golden_board(spark, sf_dir):
    """Structured goldens (source, session among the first two, directory) and their counts."""
    c, r, own = _goldens(spark, sf_dir)
    n = c.sessions.select(F.col("session_key").alias("query_id"), "message_count")
    none = lambda kind: F.lit(None).cast(kind)
    g = own.join(n, "query_id").select(
        "query_id", F.when(F.col("message_count") % 2 == 0, "hard").otherwise("candidate").alias("status"), F.lit(2).alias("top_k"), "source_id", F.array("session_uuid").alias("session_uuids"), none("string").alias("session_ref"),
        F.upper("cwd").alias("cwd_upper"), none("string").alias("match_source"), none("long").alias("match_seq"), F.array().cast("array<string>").alias("must_contain"),
        none("array<struct<label:string,must_contain:array<string>>>").alias("facets"),
    ).withColumnRenamed("cwd_upper", "cwd_contains").withColumn("cwd_contains", F.lower("cwd_contains"))
    return evaluate.scoreboard(evaluate.structured_check(g, r))


def _top_sql(name: str) -> str:
    return f"(SELECT query_id, session_ref FROM ({ORACLES[name]}) WHERE rank = 1)"


@register("top_result_changes", f'SELECT b.query_id, b.session_ref AS "before", a.session_ref AS "after" FROM {_top_sql("find_relevance")} b JOIN {_top_sql("find_ended")} a USING (query_id) WHERE b.session_ref <> a.session_ref')
def top_changes(spark, sf_dir):
    """Queries whose first result is another one when sorted by time."""
    c = conv(spark, sf_dir).searchable()
    q = keep(conversation_queries(c))
    by = find_op.first_results(q, c.documents, c.sessions, c.index, now=NOW, limit=10)
    return evaluate.top_differences(by.where("sort = 'relevance'"), by.where("sort = 'ended'"))


@register(
    "latency_throughput",
    """SELECT event_type AS shape, user_id % 4 AS level, CASE WHEN max(at_s) > min(at_s) THEN round(count(*) FILTER (ok) / (max(at_s) - min(at_s))::DOUBLE, 9) END AS per_second FROM (SELECT *, event_id % 11 <> 0 AS ok, epoch(ts)::BIGINT AS at_s FROM events) GROUP BY 1, 2""",
)
def throughput(spark, sf_dir):
    """Good operations a second of each shape and level."""
    e = corpora.table(spark, sf_dir, "events")
    at = F.unix_seconds(F.to_timestamp_ltz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    s = e.select(F.col("event_type").alias("shape"), F.pmod("user_id", F.lit(4)).alias("level"), F.lit(0).alias("n"), (F.pmod("event_id", F.lit(11)) != 0).alias("ok"), F.col("value").alias("ms"), at.alias("at_s"))
    return evaluate.latency_rollup(s).select("shape", "level", F.round("per_second", 9).alias("per_second"))
