import random
import re

import xxhash
from pyspark.sql import functions as F

from quarryline.llm import queries, simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        best[find(i)] = min(best.get(find(i), d), d)
    return [best[find(i)] for i in range(len(ids))]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in docs}
    ids = sorted(fps)
    want = dict(zip(ids, brute_components(ids, [fps[i] for i in ids])))
    got = queries.op4_simhash_neardup(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_over_random_clusters_and_crowded_anchors(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, 1, (1 << 64) - 1, 0b1111, 0b11111}
    fps = sorted(fps)
    want = brute_components([signed(x) for x in fps], fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for cell in (8192, 16):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, cell_rows=cell)).collect()}
        assert [got.get(signed(x), signed(x)) for x in fps] == want


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (1, "One two THREE"), (2, "one two three"), (2, "one two three"), (None, "one two three"), (7, "w " * 30000), (8, "w " * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "component_id": F.lit(0)})
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (2, 1), (None, 1), (7, 7), (8, 7)], key=str)
    assert simhash.near_duplicates(df.where("false")).count() == 0
