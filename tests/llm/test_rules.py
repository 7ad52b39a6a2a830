import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarryline.llm import queries, rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t ", "one", "a b c a b c a b", "x x x x x", "A line\nA line\n \nB\n", "é😀 ## <b> é😀 ## <b> |", "a b c d\n" * 300, "w " * 5000]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_stats_match_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = rules.with_stats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in BASE) == brute(TEXTS[r["doc_id"]]), r["doc_id"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_quality_rules(spark, sf).collect():
        b = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in BASE) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r["base_failed"] and r["kept"])


def test_learned_list_finds_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op2_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    judged = [(r["quality"], got[r["doc_id"]]["kept"]) for r in labels if not got[r["doc_id"]]["base_failed"]]
    bad = [k for q, k in judged if q == 0]
    good = [k for q, k in judged if q == 1]
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.35 * len(bad)


def test_no_labels_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    stats = rules.with_stats(empty)
    assert rules.learn_rules(stats.drop("text"), labels).rules == ()
    assert stats.count() == 0


def brute_rules(rows, max_rules=8, max_conditions=3, least_precision=0.6, least_covered=3):
    """The decision list over (bad, prune, feature values), by looks at the rows themselves."""
    holds = lambda c, v: (v[c[0]] > c[2]) == c[1]
    covers = lambda rule, v: all(holds(c, v) for c in rule)

    def best(some):
        top, chosen = 1e-9, None
        bad = sum(b for b, _, _ in some)
        for name, (_, edges) in rules.FEATURES.items():
            for edge in edges:
                for above in (True, False):
                    hit = [b for b, _, v in some if (v[name] > edge) == above]
                    p = sum(hit)
                    if p and len(hit) < len(some):
                        gain = p * (math.log2(p / len(hit)) - math.log2(bad / len(some)))
                        if gain > top:
                            top, chosen = gain, (name, above, float(edge))
        return chosen

    found = []
    while len(found) < max_rules:
        rule = []
        while len(rule) < max_conditions:
            c = best([r for r in rows if not r[1] and covers(rule, r[2])])
            if c is None or c in rule:
                break
            rule.append(c)
        if not rule:
            break
        worth = []
        for k in range(len(rule)):
            hit = [b for b, prune, v in rows if prune and covers(rule[: k + 1], v)]
            worth.append(((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, sum(hit), -k))
        value, bad, k = max(worth)
        if bad < least_covered or (value + 1) / 2 < least_precision:
            break
        found.append(rule[: 1 - k])
        rows = [r for r in rows if not covers(found[-1], r[2])]
    return found


def test_learner_matches_brute_force(spark):
    """With repeated labels, unknown ids, other labels, and columns of clashing names."""
    rng = random.Random(8)
    texts = []
    for i in range(400):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "PIECE", "x1", "no!", "#"]) for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            words = words[:7] * rng.randint(1, 12)
        texts.append((i if i != 5 else None, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    stats = rules.with_stats(docs).drop("text").withColumns({c: F.lit("clash") for c in ("id", "y", "bad", "prune", "bin_words")})
    marks = [(i, 0 if i % 3 == 0 or rng.random() < 0.1 else 1) for i in range(0, 400, 2)]
    marks += [marks[3], marks[4], (None, 0), (7000, 0), (9, 5), (11, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = rules.learn_rules(stats, labels)
    plain = rules.with_stats(docs).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, *(rules.feature(n).alias(n) for n in rules.FEATURES))
    known = {r[0]: (r[1], r.asDict()) for r in plain.collect() if r[0] is not None}
    rows = [(1 - y, *known[i]) for i, y in marks if i in known and y in (0, 1)]
    want = brute_rules(rows)
    assert want and [[(c.feature, c.above, c.threshold) for c in r] for r in got.rules] == want
    covers = lambda v: any(all((v[n] > t) == above for n, above, t in r) for r in want)
    kept = {r["doc_id"]: r["kept"] for r in stats.select("doc_id", got.kept().alias("kept")).collect()}
    assert all(kept[i] == (not covers(v)) for i, (_, v) in known.items())
