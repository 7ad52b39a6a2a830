import hashlib
import random
import re
from collections import Counter

import numpy as np

from quarryline.llm import blocks, queries

SF = "/root/testdata/sf0.001"


def brute(rows, window=35):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in docs for p in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    rows = blocks.remove_passages(df, **options).collect()
    for r in rows:
        assert sum(r["span_ends"]) - sum(r["span_starts"]) == r["n_removed"]
        assert all(a >= 35 or "window" in options for a in (e - s for s, e in zip(r["span_starts"], r["span_ends"])))
        assert all(e < s for e, s in zip(r["span_ends"], r["span_starts"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=repr)


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [prose(rng.randint(30, 160)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(shared).split()
            a = rng.randint(0, len(words) // 2)
            parts += [rng.choice(["\n", " ", "\t\r\n "]).join(words[a : a + rng.randint(20, len(words))]), prose(rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, bits string, chunk int").repartition(3)


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(table(spark, rows), chunk_bytes=2000, bucket_bytes=3000) == brute(rows)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_passage_dedup"](spark, SF).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got), key=repr) == brute(docs)
    assert sum(r["n_removed"] for r in got) > 0


def test_odd_rows(spark):
    line = " ".join(f"v{i}" for i in range(35))
    long = "one two three " * 40_000 + line
    rows = [(1, None), (2, ""), (3, " \n"), (4, line), (4, line), (None, line), (None, None), (5, line.replace("v3 ", "v3\x85")), (6, long), (7, line[:-1]), (8, "a " * 36), (9, "b " * 35), (10, line.upper())]
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, rows), window=2, chunk_bytes=1, bucket_bytes=1 << 20) == brute(rows, 2)
    assert found(table(spark, rows), window=6, chunk_bytes=100) == brute(rows, 6)
    assert found(table(spark, rows[:1])) == brute(rows[:1])
    assert found(table(spark, rows).limit(0)) == []


def test_crowd_of_copies_sends_each_key_once():
    text = " ".join(f"u{i}" for i in range(400)).encode()
    keys, at, block = blocks._Plan(35, 8).block_keys(blocks.Chunk([text] * 50))
    assert len(keys.bucket) == 400 - 17 and keys.many.all() and len(at) == 50 * 383 and block.sum() == 50 * 22


def test_bits_come_back_in_order():
    rng = np.random.default_rng(5)
    value = rng.integers(0, 1 << 63, 5000, np.uint64)
    keys = blocks.Keys(rng.integers(0, 9, 5000), np.concatenate((value[:2500], value[:2500])))
    sent = keys.sent(3, np.ones(len(keys.bucket), bool)).to_pylist()
    assert [r["bucket"] for r in sent] == list(range(9))
    back = keys.returned([{"bucket": r["bucket"], "bits": r["many"]} for r in sent])
    assert (back == keys.many).all()


def test_word_hashes_are_those_of_the_words():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab\0é \t\n\x0b\x1f\x85") for _ in range(rng.randint(0, 120))).encode() for _ in range(200)]
    texts += [b"", b" ", b"x" * 5000, b"x" * 4999 + b"y"]
    h, sizes = blocks.word_hashes(texts)
    words = [t.split() for t in texts]
    assert list(sizes) == list(map(len, words))
    of = {}
    for w, x in zip((w for ws in words for w in ws), h.tolist()):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of) > 700
    assert blocks.word_hashes([])[0].size == 0
