import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from quarryline.llm import queries

from .test_jaccard import brute
from .test_secrets import masked

SF = "/root/testdata/sf0.001"


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, SF))
        kept.append({r["doc_id"]: r.asDict() for r in docs.collect()})
        assert len(kept[-1]) == docs.count()
    good = {r["doc_id"] for r in queries.op1_quality_classifier(spark, SF).where("predicted = 1").collect()}
    assert set(kept[0]) == good
    ids = sorted(kept[0])
    # The stage's rule is a Jaccard similarity of 0.8 over five words, not op4's digest rule.
    assert set(kept[1]) == {ids[i] for i in brute([kept[0][i]["text"] for i in ids])}
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain(r["text"])
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(g) for g in grams}
    leaked = lambda t: any(tuple(w[i : i + n]) in grams for w in [plain(t)] for n in sizes for i in range(len(w) - n + 1))
    assert set(kept[2]) == {i for i, r in kept[1].items() if not leaked(r["text"])}
    assert {i: r["text"] for i, r in kept[3].items()} == {i: masked(r["text"]) for i, r in kept[2].items()}
    assert all(r["n_chars"] == len(r["text"]) for i, r in kept[3].items() if r["text"] != kept[2][i]["text"])
    assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in kept[3].items()}
    by_source, taken, target = defaultdict(int), defaultdict(int), {}
    for i, r in kept[3].items():
        by_source[r["source"]] += size[i]
    for i, r in kept[4].items():
        assert r["size"] == size[i] and 0 < r["taken"] <= 3 * size[i] and r["source_size"] == by_source[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - sum(by_source.values())) < 1
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (None, "x y z w v", "en", "a"), (2, "", "en", None), (3, "same text of five words here", "en", "b"), (3, "same text of five words here", "en", "b"), (4, "same text of five words here", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("size", "score", "id", "fp", "hits", "bin")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "source mixing":
            assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == ["1", "3", "None"]
