"""Search queries over the conversation and document corpora, with their SQL twins."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions.relax import refinement
from quarryline.operators import find as find_op
from quarryline.operators import index as ix
from quarryline.operators import project, recall
from quarryline.operators import rank as rk
from quarryline.plans import corpora
from quarryline.plans.registry import ORACLES, QUERIES
from quarryline.storage import keep, passing

NOW = "2024-03-01T00:00:00.000Z"


class Corpus:
    """Messages, sessions, documents and index of a corpus; the search tables are written once."""

    def __init__(self, messages: DataFrame):
        self.messages = messages
        self.sessions = project.build_sessions(messages)
        self.documents = project.build_documents(messages, self.sessions)

    @cached_property
    def index(self) -> ix.Index:
        with passing(self.documents.sparkSession):
            return ix.build_index(self.documents).saved()

    def searchable(self) -> Corpus:
        self.sessions, self.documents = keep(self.sessions), keep(self.documents)
        return self


def conv(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(corpora.conv_messages(spark, sf_dir))


CONV_SQL = "WITH " + ",".join([corpora.CONV_MESSAGES_SQL, project.sessions_sql("conv_m", "conv_s"), project.documents_sql("conv_m", "conv_s", "conv_d")])
CONV_INDEX_SQL = CONV_SQL + "," + ix.index_sql("conv_d", "conv")


def conversation_queries(c: Corpus) -> DataFrame:
    """A query a session: the two shortest, or for odd ones the two longest, words of its first user message."""
    first = c.messages.where("role = 'user'").groupBy("session_key", "native_session_id").agg(F.min_by("body_text", "seq").alias("t"))
    words = F.filter(T.query_terms(F.col("t")), lambda x: x.rlike(r"^\p{L}{3,}$"))
    side = F.when(F.col("native_session_id").cast("long") % 2 == 0, 1).otherwise(-1)
    ordered = F.sort_array(F.transform(words, lambda x: F.struct((F.length(x) * side).alias("n"), x.alias("x"))))
    return first.select(F.col("session_key").alias("query_id"), F.array_join(F.transform(F.slice(ordered, 1, 2), lambda s: s["x"]), " ").alias("query")).where("query <> ''")


CONV_QUERIES_SQL = f"""
q AS (
  SELECT session_key AS query_id, array_to_string(list_transform(list_sort(list_transform(list_filter(list_distinct({ix.tokens_sql("t")}), lambda x: regexp_matches(x, '^\\p{{L}}{{3,}}$')),
           lambda x: {{'n': length(x) * (CASE WHEN native_session_id::BIGINT % 2 = 0 THEN 1 ELSE -1 END), 'x': x}}))[1:2], lambda s: s.x), ' ') AS query
  FROM (SELECT session_key, native_session_id, arg_min(body_text, seq) AS t FROM conv_m WHERE role = 'user' GROUP BY 1, 2)),
qq AS (SELECT query_id, query, lower(query) AS nq, string_split(query, ' ') AS terms FROM q WHERE query <> ''),
qt AS (SELECT query_id, token, len(terms) AS n_terms, {ix._translate_sql("token")} AS term FROM (SELECT query_id, terms, unnest(terms) AS token FROM qq))
"""


def scored_sql(prefix: str = "conv") -> str:
    weights = ", ".join(str(w) for w in ix.WEIGHTS.values())
    return f"""
tf AS (SELECT term, doc_id, sum([{weights}][field + 1]) AS f FROM {prefix}_post WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
tdf AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
hits AS (
  SELECT query_id, doc_id, -sum(CASE WHEN raw > 0 THEN raw ELSE 1e-6::DOUBLE END * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS fts_score
  FROM (SELECT qt.query_id, tf.doc_id, qt.n_terms, tf.f::DOUBLE AS f, dl, avgdl, ln((n - df + 0.5)::DOUBLE / (df + 0.5)::DOUBLE) AS raw
        FROM qt JOIN tf USING (term) JOIN tdf USING (term) JOIN {prefix}_dl USING (doc_id), {prefix}_corpus)
  GROUP BY query_id, doc_id, n_terms HAVING count(*) = n_terms)
"""


def candidates_sql(limit: int, sort: str = "relevance", scope: str = "true", extra: str = "") -> str:
    order = {"relevance": "fts_score, ended_at DESC, coalesce(seq, -1)", "ended": "ended_at DESC, fts_score", "started": "started_at DESC, fts_score"}[sort]
    return f"""
cand AS (
  SELECT * FROM (
    SELECT h.query_id, h.fts_score, d.*, s.title, s.summary_text AS s_summary, s.cwd, s.started_at, s.ended_at, s.session_uuid, s.native_session_id, s.path_date, s.file_path, s.message_count,
           row_number() OVER (PARTITION BY h.query_id, d.source_id ORDER BY {order}, d.doc_id) AS cand_pos
    FROM hits h JOIN conv_d d USING (doc_id) JOIN conv_s s USING (session_key) {extra} WHERE {scope}) WHERE cand_pos <= {recall.budget(limit, sort)})
"""


def ranked_sql(limit: int, sort: str = "relevance", now: str = NOW) -> str:
    time = {"ended": "ended_at", "started": "started_at"}.get(sort)
    final = f"{time} DESC, score DESC, source_id, session_ref" if time else "score DESC, ended_at DESC, first_pos"
    newest = f"JOIN (SELECT query_id, source_id, session_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY at_ DESC, pos, session_key) AS n FROM (SELECT query_id, source_id, session_key, arg_min({time}, cand_pos) AS at_, min(cand_pos) AS pos FROM cand GROUP BY ALL)) WHERE n <= {2 * limit}) USING (query_id, source_id, session_key)" if time else ""
    return f"""
rows_ AS (
  SELECT *, -fts_score + CASE WHEN contains(txt, nq) THEN 8.0 ELSE 0.0 END + 2.0 * len(list_filter(terms, lambda t: contains(txt, t))) + CASE WHEN kind = 'message' THEN 4.0 ELSE 0.0 END + CASE WHEN role = 'user' THEN 2.0 ELSE 0.0 END AS rs
  FROM (SELECT cand.*, qq.nq, qq.terms, lower(CASE WHEN kind = 'message' THEN body_text ELSE concat_ws(chr(10), title_text, summary_text, compact_text, reasoning_text) END) AS txt FROM cand JOIN qq USING (query_id) {newest})),
grp AS (
  SELECT query_id, source_id, session_key, any_value(session_uuid) AS session_uuid, any_value(title) AS title, any_value(cwd) AS cwd, any_value(started_at) AS started_at, any_value(ended_at) AS ended_at, any_value(nq) AS nq, any_value(terms) AS terms,
         max(rs) AS best, count(*) AS match_count, count(*) FILTER (kind <> 'message') AS ph, count(*) FILTER (role = 'user') AS uh, min(cand_pos) AS first_pos,
         arg_max(coalesce(seq, -1), {{'m': (kind = 'message')::INT, 's': rs, 'p': -cand_pos}}) AS shown_seq
  FROM rows_ GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY {final}) AS rank FROM (
    SELECT *, CASE WHEN source_id = 'codex' THEN session_uuid ELSE session_key END AS session_ref,
           best + CASE WHEN contains(lower(title), nq) THEN 30.0 ELSE 0.0 END + 10.0 * len(list_filter(terms, lambda t: contains(lower(title), t))) + 18.0 * len(list_filter(terms, lambda t: contains(lower(cwd), t)))
           + 4.0 * least(uh, 3) + 2.0 * least(ph, 2) + 1.5 * least(match_count, 6)
           + greatest(18.0::DOUBLE - 0.15::DOUBLE * greatest(epoch_ms(substr('{now}', 1, 19)::TIMESTAMP) - epoch_ms(substr(ended_at, 1, 19)::TIMESTAMP), 0)::DOUBLE / 86400000.0::DOUBLE, 0.0::DOUBLE) AS score
    FROM grp)),
res AS (SELECT * FROM ranked WHERE rank <= {limit})
"""


def merged_sql(limit: int, sort: str = "relevance") -> str:
    time = {"ended": "ended_at", "started": "started_at"}.get(sort)
    score = "score" if time else "CASE WHEN n_sources > 1 THEN 1.0::DOUBLE / (60 + rank) ELSE score END"
    order = f"{time} DESC, ms DESC, source_id, session_ref" if time else "ms DESC, ended_at DESC, source_id, session_ref"
    return f"""
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS mrank FROM
  (SELECT *, {score} AS ms FROM (SELECT *, count(DISTINCT source_id) OVER (PARTITION BY query_id) AS n_sources FROM res)))
SELECT query_id, mrank AS rank, source_id, session_ref, round(ms, 6) AS score, match_count, nullif(shown_seq, -1) AS match_seq, started_at, ended_at FROM merged WHERE mrank <= {limit}
"""




def result_rows(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "source_id", "session_ref", F.round("score", 6).alias("score"), "match_count", "match_seq", "started_at", "ended_at")


def _find(sort: str, limit: int = 10):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = conv(spark, sf_dir).searchable()
        return result_rows(find_op.find(conversation_queries(c), c.documents, c.sessions, c.index, now=NOW, limit=limit, sort=sort))

    return query


_head = CONV_INDEX_SQL + "," + CONV_QUERIES_SQL + "," + scored_sql()
for _sort in ("relevance", "ended", "started"):
    QUERIES[f"find_{_sort}"] = _find(_sort)
    ORACLES[f"find_{_sort}"] = ",".join([_head, candidates_sql(10, _sort), ranked_sql(10, _sort), merged_sql(10, _sort)])


def q_sessions(spark, sf_dir):
    return conv(spark, sf_dir).sessions


QUERIES["project_sessions"] = q_sessions
ORACLES["project_sessions"] = CONV_SQL + " SELECT * FROM conv_s"


def q_documents(spark, sf_dir):
    return conv(spark, sf_dir).documents


QUERIES["project_documents"] = q_documents
ORACLES["project_documents"] = CONV_SQL + " SELECT * FROM conv_d"


def q_doc_sessions(spark, sf_dir):
    return project.build_sessions(corpora.doc_messages(spark, sf_dir))


QUERIES["project_doc_sessions"] = q_doc_sessions
ORACLES["project_doc_sessions"] = "WITH " + corpora.DOC_MESSAGES_SQL + "," + project.sessions_sql("doc_m", "doc_s") + " SELECT * FROM doc_s"


def q_tokens(spark, sf_dir):
    d = corpora.table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.tokenized_text(F.col("text")).alias("tokens"), F.size(T.query_terms(F.col("text"))).cast("long").alias("n_terms"))


QUERIES["tokenize_documents"] = q_tokens
ORACLES["tokenize_documents"] = f"SELECT doc_id, array_to_string({ix.tokens_sql('text')}, ' ') AS tokens, len(list_distinct({ix.tokens_sql('text')}))::BIGINT AS n_terms FROM documents WHERE text IS NOT NULL"


def q_postings(spark, sf_dir):
    p = conv(spark, sf_dir).index.postings
    return p.select("term", "doc_id", "field", F.size("positions").cast("long").alias("count"), F.array_min("positions").alias("first"))


QUERIES["index_postings"] = q_postings
ORACLES["index_postings"] = CONV_INDEX_SQL + " SELECT term, doc_id, field, count(*) AS \"count\", min(pos) AS \"first\" FROM conv_post GROUP BY 1, 2, 3"


def q_index_stats(spark, sf_dir):
    i = conv(spark, sf_dir).index
    return ix.term_stats(i).crossJoin(F.broadcast(i.corpus)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))  # one row


QUERIES["index_term_stats"] = q_index_stats
ORACLES["index_term_stats"] = CONV_INDEX_SQL + " SELECT term, count(DISTINCT doc_id) AS df, any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl FROM conv_post, conv_corpus GROUP BY 1"


def q_recall(spark, sf_dir):
    c = conv(spark, sf_dir).searchable()
    rows = recall.candidate_keys(conversation_queries(c), c.documents, c.sessions, c.index)
    return rows.select("query_id", "source_id", "doc_id", F.round("fts_score", 6).alias("fts_score"), F.col("cand_pos").cast("long").alias("cand_pos"))


QUERIES["recall_candidates"] = q_recall
ORACLES["recall_candidates"] = _head + "," + candidates_sql(10) + " SELECT query_id, source_id, doc_id, round(fts_score, 6) AS fts_score, cand_pos FROM cand"


def q_scoped(spark, sf_dir):
    c = conv(spark, sf_dir).searchable()
    scope = F.col("source_id").isin("codex", "pi") & F.lower("cwd").contains("/p3") & (F.col("ended_at") >= "2024-01-02") & F.col("path_date").between("2024-01-01", "2024-12-31") & F.col("file_path").startswith("/logs/")
    gone = recall.exclusions(c.sessions.where("native_session_id like '%1'").select(F.col("native_session_id").alias("value")))
    rows = recall.candidate_keys(conversation_queries(c), c.documents, c.sessions, c.index, scope=scope, exclude=gone)
    return rows.select("query_id", "source_id", "doc_id", F.round("fts_score", 6).alias("fts_score"), F.col("cand_pos").cast("long").alias("cand_pos"))


QUERIES["recall_scoped_excluding"] = q_scoped
ORACLES["recall_scoped_excluding"] = (
    _head + "," + candidates_sql(10, scope="d.source_id IN ('codex', 'pi') AND lower(cwd) LIKE '%/p3%' AND ended_at >= '2024-01-02' AND path_date BETWEEN '2024-01-01' AND '2024-12-31' AND file_path LIKE '/logs/%' AND native_session_id NOT LIKE '%1'")
    + " SELECT query_id, source_id, doc_id, round(fts_score, 6) AS fts_score, cand_pos FROM cand"
)


def q_in_session(spark, sf_dir):
    c = conv(spark, sf_dir).searchable()
    q = conversation_queries(c).withColumn("session_key", F.col("query_id"))
    rows = recall.candidate_keys(q, c.documents, c.sessions, c.index, limit=4)
    return rows.select("query_id", "doc_id", F.round("fts_score", 6).alias("fts_score"), F.col("cand_pos").cast("long").alias("cand_pos"))


QUERIES["recall_in_session"] = q_in_session
ORACLES["recall_in_session"] = _head + "," + candidates_sql(4, scope="h.query_id = session_key") + " SELECT query_id, doc_id, round(fts_score, 6) AS fts_score, cand_pos FROM cand"


def q_by_source(spark, sf_dir):
    c = conv(spark, sf_dir).searchable()
    r = find_op.find(conversation_queries(c), c.documents, c.sessions, c.index, now=NOW, limit=5, per_source=True)
    return r.select("query_id", "source_id", F.col("rank").cast("long").alias("rank"), "session_ref", F.round("score", 6).alias("score"), F.round(1.0 / (60.0 + F.col("rank")), 9).alias("rrf"))


QUERIES["rank_by_source"] = q_by_source
ORACLES["rank_by_source"] = ",".join([_head, candidates_sql(5), ranked_sql(5)]) + " SELECT query_id, source_id, rank, session_ref, round(score, 6) AS score, round(1.0::DOUBLE / (60 + rank), 9) AS rrf FROM res"


def q_analysis(spark, sf_dir):
    """Query analysis of every first user message."""
    m = conv(spark, sf_dir).messages.where("seq = 0")
    a = m.select("session_key", T.analyze_query(F.col("body_text")).alias("a"))
    return a.select("session_key", "a.normalized", F.array_join("a.terms", " ").alias("terms"), "a.is_multi_term", "a.is_path_like", "a.mode", F.length(T.match_expression(F.col("a.terms"))).cast("long").alias("expression_chars"))


QUERIES["analyze_queries"] = q_analysis
ORACLES["analyze_queries"] = CONV_SQL + f"""
, t AS (SELECT session_key, trim(body_text) AS t, {ix.tokens_sql("body_text")} AS toks FROM conv_m WHERE seq = 0),
u AS (SELECT session_key, any_value(t) AS t, string_agg(x, ' ' ORDER BY i) AS terms, sum(length(x) + 2) + 5 * (count(*) - 1) AS ec
      FROM (SELECT session_key, any_value(t) AS t, x, min(i) AS i FROM (SELECT session_key, t, unnest(toks) AS x, unnest(range(len(toks))) AS i FROM t) GROUP BY session_key, x) GROUP BY 1)
SELECT session_key, lower(t) AS normalized, terms, regexp_matches(t, '\\s') AS is_multi_term, regexp_matches(t, '\\s') AND regexp_matches(t, '[\\\\/._:-]') AS is_path_like, 'terms' AS mode, ec::BIGINT AS expression_chars FROM u
"""


def q_refine(spark, sf_dir):
    """What would be suggested for first user messages, were they queries without results."""
    m = conv(spark, sf_dir).messages.where("seq = 0")
    r = m.select("session_key", refinement(F.col("body_text")).alias("r"))
    return r.select("session_key", "r.over_constrained", F.array_join("r.suggested_queries", "|").alias("suggested"), F.col("r.n_terms").cast("long").alias("n_terms"))


QUERIES["zero_result_refinement"] = q_refine
_stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
ORACLES["zero_result_refinement"] = CONV_SQL + f"""
, t AS (SELECT session_key, lower(trim(body_text)) AS nq, list_distinct({ix.tokens_sql("body_text")}) AS terms FROM conv_m WHERE seq = 0),
u AS (SELECT session_key, nq, len(terms) AS n, list_transform(list_sort(list_transform(list_filter(terms, lambda x: regexp_matches(x, '[A-Za-z0-9_]') AND NOT list_contains([{_stop}], x)), lambda x: {{'n': -length(x), 'x': x}}))[1:2], lambda s: s.x) AS asc_ FROM t)
SELECT session_key, n >= 4 AS over_constrained, coalesce(array_to_string(list_filter(asc_, lambda x: x <> nq), '|'), '') AS suggested, n::BIGINT AS n_terms FROM u
"""


def q_analysis_all(spark, sf_dir):
    """Query analysis of every message."""
    a = conv(spark, sf_dir).messages.select("session_key", "seq", T.analyze_query(F.col("body_text")).alias("a"))
    return a.select("session_key", "seq", "a.normalized", F.array_join("a.terms", " ").alias("terms"), "a.is_multi_term", "a.is_path_like", "a.mode")


QUERIES["analyze_queries_all"] = q_analysis_all
ORACLES["analyze_queries_all"] = CONV_SQL + f"""
, t AS (SELECT session_key, seq, trim(body_text) AS t, {ix.tokens_sql("body_text")} AS toks FROM conv_m),
x AS (SELECT session_key, seq, x, min(i) AS i FROM (SELECT session_key, seq, unnest(toks) AS x, unnest(range(len(toks))) AS i FROM t) GROUP BY 1, 2, 3),
u AS (SELECT session_key, seq, string_agg(x, ' ' ORDER BY i) AS terms FROM x GROUP BY 1, 2)
SELECT session_key, seq, lower(t) AS normalized, coalesce(terms, '') AS terms, regexp_matches(t, '\\s') AS is_multi_term,
       regexp_matches(t, '\\s') AND regexp_matches(t, '[\\\\/._:-]') AS is_path_like, CASE WHEN terms IS NULL THEN 'empty' ELSE 'terms' END AS mode
FROM t LEFT JOIN u USING (session_key, seq)
"""


def q_refine_all(spark, sf_dir):
    """What would be suggested for every message, were it a query without results."""
    r = conv(spark, sf_dir).messages.select("session_key", "seq", refinement(F.col("body_text")).alias("r"))
    return r.select("session_key", "seq", "r.over_constrained", F.array_join("r.suggested_queries", "|").alias("suggested"), F.col("r.n_terms").cast("long").alias("n_terms"))


QUERIES["zero_result_refinement_all"] = q_refine_all
ORACLES["zero_result_refinement_all"] = ORACLES["zero_result_refinement"].replace(" FROM conv_m WHERE seq = 0", " FROM conv_m").replace("SELECT session_key,", "SELECT session_key, seq,")
