"""Which proofs imply which requests."""

import random

from pyspark.sql import functions as F

from quarryline.operators import coverage, selectors
from quarryline.operators.project import INDEX_VERSION

KIND = selectors.SELECTOR


def tables(spark, n, seed):
    r = random.Random(seed)
    day = lambda: f"2024-01-{r.randint(1, 9):02}"

    def one():
        kind, dates = r.choice([*selectors.KINDS, "odd", None]), sorted([day(), day()])
        dates = dates if r.random() < 0.5 else dates[:1] * 2
        dated = kind is not None and "date" in kind
        return (kind, r.choice(["codex", "pi", None]), r.choice(["/a", "/b"]), r.choice(["/x", "/y", ""]) if kind and "cwd" in kind else None, *(dates if dated else (None, None)))

    records = spark.createDataFrame([(str(i), r.choice([INDEX_VERSION] * 5 + ["old"]), one()) for i in range(n)], f"selector_key string, record_version string, selector {KIND}")
    return records, spark.createDataFrame([(i, one()) for i in range(n)], f"request_id long, requested {KIND}")


def test_covering_is_every_pair_that_the_implication_holds_of(spark):
    for seed in range(2):
        records, requests = tables(spark, 250, seed)
        want = requests.crossJoin(records.where(F.col("record_version") == INDEX_VERSION)).where(selectors.implies(F.col("selector"), F.col("requested")))
        got = coverage.covering(records, requests)
        assert got.columns == [*requests.columns, *records.columns]
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(got) == rows(want.select(*got.columns)) and got.count() > 1000


def test_proofs_of_days_meet_sessions_of_these_days_only(spark):
    """Joined on source and root alone, every session would meet every proof."""
    s = spark.range(2000).select(F.col("id").cast("string").alias("session_key"), F.lit("pi").alias("source_id"), F.lit("/r").alias("source_root"), F.lit("/c").alias("cwd"), F.format_string("2024-%02d-%02d", F.col("id") % 12 + 1, F.col("id") % 28 + 1).alias("path_date"))
    w = coverage.session_selectors(s).select("requested").distinct()
    records = w.select(selectors.storage_key(F.col("requested")).alias("selector_key"), F.lit(INDEX_VERSION).alias("record_version"), F.col("requested").alias("selector"))
    pairs = coverage.covering(records.where("selector.kind <> 'all'"), coverage.session_selectors(s, narrowest=True))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert any("__key" in line for line in plan.splitlines() if "Join Inner" in line)
    assert pairs.count() == 3 * 2000
    c = coverage.session_coverage(s, records)
    assert c.where("complete and size(covering_selectors) = 4").count() == 2000
