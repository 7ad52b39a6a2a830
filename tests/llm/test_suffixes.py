import hashlib
import random

from quarryline.llm import queries, suffixes


def brute(rows, length=100):
    """(n_bytes, n_removed, n_spans, digest) by row; rows are (id, text).

    Null ids are last, different texts of one id go by their SHA-256, and rows equal in
    id and text are one document.
    """
    encoded = [(i, (t or "").encode()) for i, t in rows]
    ranked = sorted(set(encoded), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1]).digest()))
    place = {r: k for k, r in enumerate(ranked)}
    first = {}
    for k, (_, data) in enumerate(ranked):
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], (k, p))
    out = []
    for i, data in encoded:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] != (place[i, data], p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, k, "clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long, digest string").repartition(4)
    got = suffixes.remove_repeats(df, **options).collect()
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == sorted(str((i, *b)) for (i, _), b in zip(rows, brute(rows)))
    for r in got:
        assert sum(r["span_ends"]) - sum(r["span_starts"]) == r["n_removed"]


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "and"] + ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(rng.randint(12, 80)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(50, len(s))], prose(rng.randint(0, 20))]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, rows[4][1]), (501, rows[4][1] + " tail"), (502, "x" + rows[4][1])]
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        check(spark, corpus(seed))


def test_edge_cases(spark):
    base = corpus(3, 8)
    text = base[0][1] + base[1][1]
    rows = base + [(900, None), (901, ""), (902, "a" * 99), (903, "a" * 100), (904, "a" * 350), (905, "ab" * 200), (None, text), (None, text + "!"), (7, text), (7, text), (7, text[5:] + "other"), (-3, text)]
    check(spark, rows)
    check(spark, rows, batches=1)
    check(spark, rows, batches=9)  # levels of four, two and one
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quarryline_")]


def test_ids_of_other_types(spark):
    """Ids need an order only; "10" comes before "9"."""
    text = corpus(3, 8)[0][1] * 3 + "".join(random.Random(1).choices("abcdef", k=200))
    df = spark.createDataFrame([("9", text), ("10", text), (None, text)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(df).collect()}
    assert got["10"] < got["9"] == got[None] == len(text.encode())


def test_thousands_of_null_ids_and_a_crowded_passage(spark):
    """At the real limits: 5000 different texts without an id, all round one passage."""
    rng = random.Random(9)
    letters = lambda k: "".join(rng.choice("abcdefghijkl ") for _ in range(k))
    passage = letters(120)
    rows = [(None, letters(rng.randint(30, 60)) + passage + letters(rng.randint(30, 60))) for _ in range(5000)]
    rows += rows[:3] + [(5, passage), (4, letters(300))]
    check(spark, rows)


def test_long_texts_and_crowded_keys(spark, monkeypatch):
    """Segments, and keys that skip the scan, give the same result."""
    monkeypatch.setattr(suffixes, "_SEGMENT", 700)
    monkeypatch.setattr(suffixes, "_CROWD", 2)
    monkeypatch.setattr(suffixes, "_TASK_BYTES", 3000)
    check(spark, corpus(4, 40))
    monkeypatch.setattr(suffixes, "_CROWD", 64)
    monkeypatch.setattr(suffixes, "_GROUP", 3)
    check(spark, corpus(5, 40))


def test_query_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: b for (i, _), b in zip(rows, brute(rows))}
    got = queries.op9_suffix_dedup(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert sum(r["n_removed"] for r in got) > 0


def test_levels_are_not_shuffled(spark):
    """What is scanned of the levels is neither dealt out again nor sorted twice."""
    rows = spark.range(3000).selectExpr("encode(cast(id % 300 as string), 'UTF-8') key", "id run", "id run2", "id row", "id place", "cast(0 as int) kind")
    index = suffixes.SuffixIndex(spark, 8)
    try:
        level = index._level(index._write(suffixes._scan(rows.repartition(8, "key"), 100), "matched"))
        keys = rows.select("key").repartition(8, "key").hint("shuffle_hash")
        both = rows.repartition(8, "key").unionByName(level.join(keys, "key", "left_semi"))
        plan = suffixes._scan(both, 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        index.close()
    above, _, below = plan.partition("Union")
    assert "Exchange" not in above and above.count("Sort ") == 1
    assert below.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in below


def test_levels_are_read_no_more_often_than_needed(spark, monkeypatch):
    seen = []
    merge, add = suffixes.SuffixIndex._merge, suffixes.SuffixIndex.add
    monkeypatch.setattr(suffixes.SuffixIndex, "_merge", lambda self, a, b: (seen.append("merge"), merge(self, a, b))[1])
    monkeypatch.setattr(suffixes.SuffixIndex, "add", lambda self, docs, **k: (seen.append(len(self.levels)), add(self, docs, **k))[1])
    rows = [(i, f"{i} " * 40 + "the same words stand in every one of these texts, and they are more than a hundred bytes long, all of them. ") for i in range(8)]
    check(spark, rows)
    assert seen == [0, 1, "merge", 1, 2]
