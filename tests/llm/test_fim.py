import hashlib
import random
import re

from pyspark.sql import functions as F

from quarryline.llm import fim, queries

SF = "/root/testdata/sf0.001"


def brute(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    elif h[3] % 100 < 20:
        form, out, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    return (key, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=repr)


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_fill_in_middle"](spark, SF).select(COLUMNS).collect()
    assert ordered(map(tuple, got)) == ordered(brute(*r) for r in docs)
    assert len({r["form"] for r in got}) == 3


def test_odd_rows_at_any_piece_size(spark):
    rng = random.Random(12)
    texts = [None, "", " ", "é", "<P>", "a<M>b", "abc", "ABC def", "퟿😀x\n\r\n\t" * 9, "Kſa", "[`{@Zz"]
    texts += ["".join(rng.choice("abZ é😀\n<") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[6]), (7, texts[6]), (None, "no id here"), (None, "no id here"), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, row int").repartition(3)
    for piece in (1, 7, 1 << 16):
        got = fim.assemble(fim.pieces(df, piece=piece), partitions=4, with_text=True).withColumnRenamed("id", "doc_id")
        assert ordered(map(tuple, got.select(COLUMNS).collect())) == ordered(brute(*r) for r in rows)
        for r in got.collect():
            assert hashlib.sha256(r["output"].encode()).hexdigest() == r["output_sha256"]
    assert fim.assemble(fim.pieces(df.limit(0))).count() == 0


def test_long_text_in_pieces(spark):
    text = "word é 12," * 300_000
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id string, text string")
    made = fim.pieces(df, piece=10_000)
    assert made.count() > 3 * 300 and made.agg(F.max(F.length("body"))).first()[0] == 10_000
    got = fim.assemble(made).withColumnRenamed("id", "doc_id").select(COLUMNS).collect()
    assert ordered(map(tuple, got)) == ordered(brute(str(i), text) for i in range(3))


def test_units_across_slices():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab-é") for _ in range(rng.randint(0, 40)))
        starts = [int(s) for part in fim.unit_starts(text, 5) for s in part]
        assert starts == [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]


def test_one_shuffle(spark):
    plan = fim.assemble(fim.pieces(spark.read.parquet(f"{SF}/documents.parquet")))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1
