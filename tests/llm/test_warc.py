import hashlib
import random

import zstandard
from pyspark.sql import functions as F

from quarryline.llm import warc


def test_exact_round_trip(spark, tmp_path):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    html = lambda n: "<p>" + " ".join(rng.choice(words) for _ in range(n)) + "</p>\r\n\r\nWARC/1.1 é😀"
    long = html(200_000)
    rows = [(i, f"http://x/{i}", html(rng.randint(20, 300))) for i in range(3000)]
    rows += [(5000, "http://x/a", rows[7][2]), (4000, None, rows[7][2]), (7, "again", rows[7][2]), (5001, "n", None), (5002, "e", ""), (5003, "s", "short"), (5004, "s", "short"), (5005, "l\nx", long), (5006, "l", long), (None, "z", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(df, folder, archive_bytes=300_000, sample_bytes=150_000, dictionary_bytes=8192)
    got = warc.read_archives(manifest, folder).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    assert manifest.agg(F.max("dictionary_bytes")).first()[0] > 0
    text = {}
    for p, u, h in rows:
        text.setdefault((p, u), (h or "").encode())
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h] = min(first.get(h, p), p)
    for r in got:
        data = text[r["page_id"], r["url"]]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == hashlib.sha256(data).hexdigest()
        owner = first.get(data.decode(), r["page_id"]) if len(data) >= 100 else r["page_id"]
        assert r["record_type"] == ("response" if owner == r["page_id"] else "revisit")
        assert r["refers_to"] == (None if owner == r["page_id"] else owner)
        assert r["payload"] == (data if owner == r["page_id"] else None)


def test_frames_stand_alone(spark, tmp_path):
    """Any frame after the dictionary is one record, whatever came before it."""
    rows = [(i, "u", f"<p>page {i} " + "common words in every page " * 20 + "</p>") for i in range(2000)]
    folder = f"{tmp_path}/a"
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder, sample_bytes=400_000, dictionary_bytes=4096)
    [m] = manifest.collect()
    data = open(f"{folder}/{m['archive']}", "rb").read()
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + m["dictionary_bytes"]]))
    rest = data[8 + m["dictionary_bytes"] :]
    seen = 0
    while rest:
        o = d.decompressobj()
        assert o.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest = o.unused_data
        seen += 1
    assert seen == len(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_archives_have_their_dictionary_too(spark, tmp_path):
    """However few and small the records are, each archive opens with a skippable frame."""
    for n, size in ((1, 0), (1, 3000), (5, 40), (40, 300)):
        rows = [(i, "u", f"<p>page {i} " + "words of every page " * (size // 20) + "</p>") for i in range(n)]
        folder = f"{tmp_path}/{n}-{size}"
        manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
        [m] = manifest.collect()
        data = open(f"{folder}/{m['archive']}", "rb").read()
        assert m["dictionary_bytes"] > 0 and data[:8] == warc.struct.pack("<II", warc.DICTIONARY_MAGIC, m["dictionary_bytes"])
        got = warc.read_archives(manifest, folder).collect()
        assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got) == [(i, h) for i, _, h in rows]
