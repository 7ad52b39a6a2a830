"""Two deterministic transcript corpora over the given tables, and the same as SQL.

``conversations`` gives messages of four sources; ``documents`` gives long
messages in sessions of eight.  Both have the columns that the source adapters
produce, so every operator can run on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The four transcript sources.
SOURCES = ("codex", "claude-code", "pi", "dsh")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(seconds) -> F.Column:
    """ISO text, UTC, of 2024-01-01 plus so many seconds, whatever the session's time zone is."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")
    s = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(s, F.lit(60))), F.lit(".000Z"))


def conv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of users and assistants, numbered from 0 in each session."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    c = c.withColumns({"source_id": source, "native_session_id": F.col("conv_id").cast("string"), "timestamp": stamp(F.col("conv_id") * 3600 + F.col("turn") * 60)})
    c = c.withColumns({
        "session_key": F.concat_ws(":", "source_id", "native_session_id"),
        "session_uuid": F.when(F.col("source_id") == "codex", F.col("native_session_id")).otherwise(F.concat_ws(":", "source_id", "native_session_id")),
        "cwd": F.concat(F.lit("/work/p"), F.pmod("conv_id", F.lit(7)).cast("string")),
        "path_date": F.substring(stamp(F.col("conv_id") * 3600), 1, 10),
    })
    c = c.withColumns({"source_root": F.concat(F.lit("/logs/"), "source_id"), "file_path": F.concat(F.lit("/logs/"), "source_id", F.lit("/"), F.replace("path_date", F.lit("-"), F.lit("/")), F.lit("/"), "native_session_id", F.lit(".jsonl"))})
    order = Window.partitionBy("session_key").orderBy("turn")
    return c.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).select("source_id", "native_session_id", "session_key", "session_uuid", "source_root", "file_path", "cwd", "path_date", "seq", "role", "timestamp", F.col("text").alias("body_text"))


CONV_MESSAGES_SQL = """
conv_m AS (
  SELECT source_id, native_session_id, source_id || ':' || native_session_id AS session_key,
         CASE WHEN source_id = 'codex' THEN native_session_id ELSE source_id || ':' || native_session_id END AS session_uuid,
         '/logs/' || source_id AS source_root, '/logs/' || source_id || '/' || strftime(t0, '%Y/%m/%d') || '/' || native_session_id || '.jsonl' AS file_path,
         '/work/p' || (conv_id % 7)::VARCHAR AS cwd, strftime(t0, '%Y-%m-%d') AS path_date,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role,
         strftime(t0 + to_minutes(turn), '%Y-%m-%dT%H:%M:%S.000Z') AS "timestamp", text AS body_text
  FROM (SELECT *, ['codex', 'claude-code', 'pi', 'dsh'][conv_id % 4 + 1] AS source_id, conv_id::VARCHAR AS native_session_id,
               TIMESTAMP '2024-01-01' + to_hours(conv_id) AS t0 FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''))
"""


def doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: eight consecutive ids of a source are a session."""
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''")
    native = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 160).cast("string"))
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.pmod(F.length("source"), F.lit(4)) + 1).cast("int"))
    d = d.withColumns({"source_id": source, "native_session_id": native, "timestamp": stamp(F.col("doc_id") * 60)})
    d = d.withColumns({"session_key": F.concat_ws(":", "source_id", "native_session_id"), "cwd": F.concat(F.lit("/"), "lang", F.lit("/"), "source")})
    order = Window.partitionBy("session_key").orderBy("doc_id")
    d = d.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    first_day = F.min(F.substring("timestamp", 1, 10)).over(Window.partitionBy("session_key"))
    return d.select(
        "source_id", "native_session_id", "session_key",
        F.when(F.col("source_id") == "codex", F.col("native_session_id")).otherwise(F.col("session_key")).alias("session_uuid"),
        F.concat(F.lit("/docs/"), "source_id").alias("source_root"), F.concat(F.lit("/docs/"), "source_id", F.lit("/"), "native_session_id", F.lit(".jsonl")).alias("file_path"),
        F.first("cwd").over(order).alias("cwd"), first_day.alias("path_date"), "seq", F.when(F.col("seq") % 2 == 0, "user").otherwise("assistant").alias("role"), "timestamp", F.col("text").alias("body_text"),
    )


DOC_MESSAGES_SQL = """
doc_m AS (
  SELECT source_id, native_session_id, session_key, CASE WHEN source_id = 'codex' THEN native_session_id ELSE session_key END AS session_uuid,
         '/docs/' || source_id AS source_root, '/docs/' || source_id || '/' || native_session_id || '.jsonl' AS file_path,
         first_value(cwd) OVER w AS cwd, min(substr(ts, 1, 10)) OVER (PARTITION BY session_key) AS path_date,
         row_number() OVER w - 1 AS seq, CASE WHEN (row_number() OVER w - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, ts AS "timestamp", text AS body_text
  FROM (SELECT *, source_id || ':' || native_session_id AS session_key FROM
        (SELECT *, ['codex', 'claude-code', 'pi', 'dsh'][length(source) % 4 + 1] AS source_id, source || '-' || (doc_id // 160)::VARCHAR AS native_session_id,
                '/' || lang || '/' || source AS cwd, strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S.000Z') AS ts
         FROM documents WHERE text IS NOT NULL AND text <> ''))
  WINDOW w AS (PARTITION BY session_key ORDER BY doc_id))
"""
