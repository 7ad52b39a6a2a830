"""Accepted messages to sessions and searchable documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import squeeze

EPOCH = "1970-01-01T00:00:00.000Z"
INDEX_VERSION = "quarryline-1"


def number_messages(messages: DataFrame, file_col: str = "file_path", order_col: str = "line_no") -> DataFrame:
    """Adds seq: 0-based order of the accepted messages of a file."""
    return messages.withColumn("seq", (F.row_number().over(Window.partitionBy(file_col).orderBy(order_col)) - 1).cast("long"))


def cut(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def _part(label: str, text: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), squeeze(cut(text, 5000)))


def distinct_summary(parts: Column) -> Column:
    """Order-keeping distinct of the non-empty parts, each cut and squeezed, joined and cut."""
    clean = F.filter(F.transform(parts, lambda x: squeeze(cut(x, 5000))), lambda x: x != "")
    return cut(F.array_join(F.array_distinct(clean), " | "), 4000)


def joined_summary(parts: Column) -> Column:
    """All non-empty parts, squeezed, joined by blank lines and cut; repeats stay."""
    return cut(F.array_join(F.filter(F.transform(parts, squeeze), lambda x: x != ""), "\n\n"), 20000)


def session_digest() -> dict[str, Column]:
    """Aggregates over a session's messages (role, seq, body_text, timestamp)."""
    by = {role: F.col("role") == role for role in ("user", "assistant")}
    out: dict[str, Column] = {}
    for role, is_role in by.items():
        text, seq = F.when(is_role, F.col("body_text")), F.when(is_role, F.col("seq"))
        out |= {f"first_{role}": F.min_by(text, seq), f"last_{role}": F.max_by(text, seq), f"first_{role}_seq": F.min(seq), f"last_{role}_seq": F.max(seq)}
    stamp = F.when(F.col("timestamp") != "", F.col("timestamp"))
    return out | {"low": F.min(stamp), "high": F.max(stamp), "message_count": F.count("*")}


def digest_title(explicit: Column | None = None) -> Column:
    title = cut(F.col("first_user"), 120)
    return F.coalesce(*([F.when(explicit != "", explicit)] if explicit is not None else []), title, F.lit("(no title)"))


def digest_summary() -> Column:
    """First message of either role, and the latest where that is another one."""
    later = lambda role, label: F.when(F.col(f"last_{role}_seq") != F.col(f"first_{role}_seq"), _part(label, F.col(f"last_{role}")))
    return cut(F.concat_ws(" | ", _part("user", F.col("first_user")), _part("assistant", F.col("first_assistant")), later("user", "follow-up"), later("assistant", "latest")), 480)


def fallback_timestamp(path_date: Column) -> Column:
    """Start of the path's date, else the epoch; never the file's own time."""
    return F.coalesce(F.concat(path_date, F.lit("T00:00:00.000Z")), F.lit(EPOCH))


def build_sessions(messages: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """One row a session from its numbered messages.

    ``extras`` (session_key, title, compact_text, reasoning_summary_text, model)
    adds what adapters found beside the messages.
    """
    keys = ["source_id", "native_session_id", "session_key", "session_uuid", "source_root", "file_path"]
    s = messages.groupBy(*keys).agg(F.min("cwd").alias("cwd"), F.min("path_date").alias("path_date"), *(c.alias(n) for n, c in session_digest().items()))
    blank = {"x_title": F.lit(None).cast("string"), "compact_text": F.lit(""), "reasoning_summary_text": F.lit(""), "model": F.lit("")}
    if extras is None:
        s = s.withColumns(blank)
    else:
        e = extras.select("session_key", F.col("title").alias("x_title"), "compact_text", "reasoning_summary_text", "model")
        s = s.join(e, "session_key", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("compact_text", "reasoning_summary_text", "model")})
    start = F.coalesce("low", fallback_timestamp(F.col("path_date")))
    return s.select(
        *keys, digest_title(F.col("x_title")).alias("title"), digest_summary().alias("summary_text"), "compact_text", "reasoning_summary_text", "cwd", "model",
        start.alias("started_at"), F.coalesce(F.col("high"), start).alias("ended_at"), "path_date", "message_count", (F.col("message_count") + 1).alias("document_count"), F.lit(INDEX_VERSION).alias("index_version"),
    )


def document_id(key: Column, seq: Column) -> Column:
    """Natural key of a document; a session's profile comes before its messages."""
    return F.concat(key, F.lit("#"), F.coalesce(F.lpad(seq.cast("string"), 9, "0"), F.lit("")))


def build_documents(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Message rows and one profile row a session, which holds title, summaries and no body."""
    blank = [F.lit("").alias(c) for c in ("title_text", "summary_text", "compact_text", "reasoning_text")]
    m = messages.select(document_id(F.col("session_key"), F.col("seq")).alias("doc_id"), "session_key", "source_id", F.lit("message").alias("kind"), "seq", "role", "timestamp", "body_text", *blank)
    none = F.lit(None)
    p = sessions.select(
        document_id(F.col("session_key"), none.cast("long")).alias("doc_id"), "session_key", "source_id", F.lit("session_profile").alias("kind"), none.cast("long").alias("seq"), none.cast("string").alias("role"), none.cast("string").alias("timestamp"),
        F.lit("").alias("body_text"), F.col("title").alias("title_text"), "summary_text", "compact_text", F.col("reasoning_summary_text").alias("reasoning_text"),
    )
    return m.unionByName(p)


def sessions_sql(messages: str, name: str) -> str:
    """The session rows of a corpus as a SQL common table; ``messages`` is its messages' table."""
    part = lambda label, c: f"'{label}: ' || trim(regexp_replace(left({c}, 5000), '\\s+', ' ', 'g'))"
    return f"""
{name} AS (
  SELECT source_id, native_session_id, session_key, session_uuid, source_root, file_path, coalesce(left(fu, 120), '(no title)') AS title,
         left(concat_ws(' | ', {part("user", "fu")}, {part("assistant", "fa")}, CASE WHEN lus <> fus THEN {part("follow-up", "lu")} END, CASE WHEN las <> fas THEN {part("latest", "la")} END), 480) AS summary_text,
         '' AS compact_text, '' AS reasoning_summary_text, cwd, '' AS model, started_at, ended_at, path_date, message_count, message_count + 1 AS document_count, '{INDEX_VERSION}' AS index_version
  FROM (SELECT source_id, native_session_id, session_key, session_uuid, source_root, file_path, min(cwd) AS cwd, min(path_date) AS path_date,
               arg_min(body_text, seq) FILTER (role = 'user') AS fu, arg_max(body_text, seq) FILTER (role = 'user') AS lu, min(seq) FILTER (role = 'user') AS fus, max(seq) FILTER (role = 'user') AS lus,
               arg_min(body_text, seq) FILTER (role = 'assistant') AS fa, arg_max(body_text, seq) FILTER (role = 'assistant') AS la, min(seq) FILTER (role = 'assistant') AS fas, max(seq) FILTER (role = 'assistant') AS las,
               min("timestamp") AS started_at, max("timestamp") AS ended_at, count(*) AS message_count
        FROM {messages} GROUP BY ALL))
"""


def documents_sql(messages: str, sessions: str, name: str) -> str:
    """The document rows of a corpus as a SQL common table."""
    return f"""
{name} AS (
  SELECT session_key || '#' || lpad(seq::VARCHAR, 9, '0') AS doc_id, session_key, source_id, 'message' AS kind, seq, role, "timestamp", body_text, '' AS title_text, '' AS summary_text, '' AS compact_text, '' AS reasoning_text FROM {messages}
  UNION ALL
  SELECT session_key || '#', session_key, source_id, 'session_profile', NULL, NULL, NULL, '', title, summary_text, compact_text, reasoning_summary_text FROM {sessions})
"""
