"""Synthetic transcripts of any size, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans.corpora import stamp

_LATIN = "deploy retry cache index worker token schema merge branch commit review latency timeout socket queue stream".split()
_CJK = "健康检查 索引更新 缓存失效 重试策略 会话搜索 日志分析 部署流程 性能测试".split()
_PATHS = "src/main.rs docs/plan.md tests/test_api.py lib/core/index.ts scripts/build.sh".split()


def generate(spark: SparkSession, sessions: int, seed: int = 1, words: int = 40) -> DataFrame:
    """Numbered messages: 3 + (i mod 8) a session, roles in turn, 120 s apart, 20 directories.

    Of the words 60 % are CJK, 25 % Latin and 15 % paths.
    """
    pick = lambda values, h: F.element_at(F.array(*map(F.lit, values)), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))
    base = spark.range(sessions).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("id", F.lit(8)) + 2)))

    def word(k):
        h = F.xxhash64(F.lit(seed), F.col("id"), F.col("seq"), k)
        kind, which = F.pmod(h, F.lit(100)), F.xxhash64(h)
        return F.when(kind < 60, pick(_CJK, which)).when(kind < 85, pick(_LATIN, which)).otherwise(pick(_PATHS, which))

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ")
    native = F.concat(F.lit("gen-"), F.lpad(F.col("id").cast("string"), 9, "0"))
    key = F.concat(F.lit("codex:"), native)
    at = F.col("id") * 3600 + F.col("seq") * 120
    return base.select(
        F.lit("codex").alias("source_id"), native.alias("native_session_id"), key.alias("session_key"), native.alias("session_uuid"), F.lit("/gen").alias("source_root"), F.concat(F.lit("/gen/"), native, F.lit(".jsonl")).alias("file_path"),
        F.concat(F.lit("/work/p"), F.pmod("id", F.lit(20)).cast("string")).alias("cwd"), F.substring(stamp(F.col("id") * 3600), 1, 10).alias("path_date"), "seq", F.when(F.col("seq") % 2 == 0, "user").otherwise("assistant").alias("role"), stamp(at).alias("timestamp"), text.alias("body_text"),
    )
