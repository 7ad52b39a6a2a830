"""All pairs of queries and profiles against a plain scan."""

import random

from pyspark.sql import functions as F

from quarryline.operators import rank
from quarryline.operators.recall import analyzed_queries

PARTS = ["ab", "abc", "cab", "Zebra", "zeb", "e-mail", "mail", "über", "straße", "字区", "🙂", "x.y", "a b", "", "bra", "17"]


def random_text(rng, n):
    return "".join(rng.choice(PARTS) + rng.choice(["", " ", "  ", ". "]) for _ in range(rng.randrange(n)))


def test_pairs_are_those_of_a_plain_scan_and_lie_in_many_tasks(spark, monkeypatch):
    rng = random.Random(4)
    asked = [(f"{s}:{i}", s, random_text(rng, 5)) for s in ("one", "two") for i in range(60)] + [("none:0", "none", "ab")]
    profiles = [(s, f"{s}:s{i}", random_text(rng, 8), random_text(rng, 20)) for s in ("one", "two", "rest") for i in range(70)]
    q = analyzed_queries(spark.createDataFrame(asked, "query_id string, source_id string, query string"))
    s = spark.createDataFrame(profiles, "source_id string, session_key string, title string, summary_text string")
    monkeypatch.setattr(rank, "SENT_NEEDLES", 20)
    found = rank.matched_profiles(q, s, cell=(16, 8)).withColumn("task", F.spark_partition_id()).collect()

    wanted = {r.query_id: [*r.a.terms, r.a.normalized] for r in q.collect()}
    hit = lambda text, key: text != "" and any(x != "" and x in text.lower() for x in wanted[key])
    expected = {(k, p[1]): ",".join(n for n, text in (("title", p[2]), ("summary", p[3])) if hit(text, k)) for k, source, _ in asked for p in profiles if p[0] == source}
    assert len(found) == len(expected) and {(r.query_id, r.session_key): r.fields for r in found} == expected
    assert {"", "title", "summary", "title,summary"} == set(expected.values())
    tasks = [r.task for r in found]
    assert max(map(tasks.count, set(tasks))) < len(tasks) / 4  # a source's pairs are not one task's
