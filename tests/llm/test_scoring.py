"""Quality classifier, mixing and decontamination: odd rows, and ways that must agree."""

import math
import random
import re
import tracemalloc
from collections import defaultdict

import duckdb
import zstandard
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, mixing, queries
from quarryline.llm.common import trained_dictionary
from quarryline.llm.quality import fit_compression_model

SF = "/root/testdata/sf0.001"


def duck(sql):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c.sql(sql)


def test_queries_equal_their_sql(spark):
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        want = duck("select " + ", ".join(columns) + f" from ({sql})").fetchall()
        assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr), name


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    labels = [(r["quality"], got[r["doc_id"]]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(y, r) for y, r in labels if r["held_out"]]
    assert sum(r["predicted"] == y for y, r in held) >= 0.94 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_scores_match_brute_force(spark):
    """Sizes under the two dictionaries, piece by piece, and the curve, for every text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_compression_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.good) > 0 and len(model.bad) > 0 and abs(len(model.good) - len(model.bad)) < 0.2 * len(model.good)
    packers = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in docs.select("text", model.score(F.col("text")).alias("score")).collect():
        data = (r["text"] or "").encode()
        good, bad = (sum(len(p.compress(data[i : i + model.piece_bytes])) for i in range(0, len(data), model.piece_bytes)) for p in packers)
        x = (bad - good) / (bad + good) if bad + good else 0.0
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.slope * x + model.intercept)))) < 1e-6


def test_few_samples_give_trained_dictionaries():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)).encode()
    magic = b"\x37\xa4\x30\xec"  # of trained dictionaries
    for n, k in ((3, 300), (20, 60), (200, 60), (3000, 20)):
        d = trained_dictionary([line(k) for _ in range(n)], 65536)
        assert d[:4] == magic and len(d) <= max(256, n * k)
    assert trained_dictionary([b"one"], 65536) == b"one"
    assert trained_dictionary([b"same " * 5] * 3, 65536)


def test_size_of_the_window_set_is_bounded_by_what_is_reckoned():
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 30, 90]))).encode()) for i in range(2000)]
    tracemalloc.start()
    held = decontaminate.WindowSet(items, 10)
    took = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    sizes = [len(t.split()) for _, t in items]
    need = sum(max(n - 9, 1) for n in sizes) * decontaminate.WINDOW_BYTES + sum(sizes) * decontaminate.WORD_BYTES + sum(len(t) for _, t in items) + len(items) * decontaminate.ITEM_BYTES
    assert sum(map(len, held.windows.values())) > 50_000 and need / 3 < took <= need


def test_benchmark_ids_may_be_strings(spark):
    text = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string").withColumn("hits", F.lit("clash"))
    b = spark.createDataFrame([("gsm-2", text), ("gsm-10", text), (None, text)], "item_id string, text string")
    for limit in (16 << 20, 0):
        got = {r["doc_id"]: r["hits"]["items"] for r in decontaminate.find_contamination(d, b, broadcast_bytes=limit).collect()}
        assert got == {1: ["gsm-10", "gsm-2"], 2: []}


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50000), (3, "word " * 50000), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    one_class = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (9, 0), (1, 7)], "doc_id long, quality int")
    both = spark.createDataFrame([(3, 1), (3, 0), (2, 0)], "doc_id long, quality int")
    for labels in (none, one_class, both):
        model = fit_compression_model(docs, labels)
        scores = [r[0] for r in docs.select(model.score(F.col("text"))).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
        assert docs.where("false").select(model.score(F.col("text"))).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_decontamination_ways_agree_with_brute_force(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve"
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (4, "É x " + passage.upper() + " y " + passage), (5, "Short item! and short-item again"), (6, "one two three four five six seven eight nine"), (None, passage), (7, "w " * 30000 + passage)]
    items = [(10, passage), (11, "Short item"), (12, passage + " more words"), (13, None), (14, "..."), (None, "one"), (11, "Short item")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit("clash"), "n": F.lit(1)})
    b = spark.createDataFrame(items, "item_id long, text string")
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            grams[tuple(w[k : k + n])].add(i)
    sizes = {len(g) for g in grams}

    def brute(t):
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit |= set(range(k, k + n))
        return len(w), len(hit), sorted(found)

    want = sorted(str((i, *brute(t))) for i, t in docs)
    for limit in (16 << 20, 0):
        got = decontaminate.find_contamination(d, b, broadcast_bytes=limit).select("doc_id", "hits.n_words", decontaminate.hit_words(F.col("hits")), "hits.items").collect()
        assert sorted(str(tuple(r)) for r in got) == want, limit
        empty = decontaminate.find_contamination(d, b.where("false"), broadcast_bytes=limit)
        assert empty.where(F.size("hits.items") > 0).count() == 0 and empty.count() == len(docs)


def test_mixing_odd_rows_and_targets(spark):
    rows = [(1, "a b c", "s1"), (1, "a b c", "s1"), (2, None, "s1"), (3, "", None), (None, "x " * 40, None), (4, "y " * 5000, "big"), (5, "z " * 700, "big"), (6, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "bin": F.lit(1), "target": F.lit("clash")})
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-3
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
    again = mixing.mix(df.repartition(5), bins=7)
    key = lambda rs: sorted(str((r["doc_id"], r["source"], r["taken"])) for r in rs)
    assert key(again.collect()) == key(got)
    assert mixing.mix(df.where("false")).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(df.where("doc_id in (2, 3)")).collect())
