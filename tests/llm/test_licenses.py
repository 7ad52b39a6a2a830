import re

from pyspark.sql import functions as F

from quarryline.llm import licenses, queries


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def places(words):
    found = []
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(found)


def templates(words, index, share):
    found = {}
    for i, w in enumerate(words):
        for t, pos, idf in index.postings.get(w, ()):
            found[t, i - pos] = found.get((t, i - pos), 0) + idf / index.weights[t]
    line = f" {' '.join(words)} "
    return sorted({index.templates[t].label for (t, _), s in found.items() if s >= share - 1e-12 and all(f" {p} " in line for p in index.templates[t].phrases)})


TEXTS = [
    None, "", "no licence here", "Released under the MIT License.", "MIT, License! mit  license\nApache-License", "the general public license, the GENERAL PUBLIC LICENSE",
    "license", "public license general", "é mit license É mit license", "İ MIT LICENSE K apache license",
    "x y " * 200 + licenses.TEMPLATES[6].text + " z" * 100 + " " + licenses.TEMPLATES[8].text, licenses.TEMPLATES[10].text.replace("forms", "shapes"),
    "mit license " * 500,
]


def test_matches_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    index = licenses.build_index(df)
    got = licenses.scan_licenses(df, index).collect()
    assert len(got) == len(rows)
    for r in got:
        words = plain(TEXTS[r["doc_id"]])
        assert r["licenses"]["n_words"] == len(words)
        assert sorted((p["at"], p["label"]) for p in r["licenses"]["places"]) == places(words)
        assert sorted(t["label"] for t in r["licenses"]["templates"]) == templates(words, index, 0.7), TEXTS[r["doc_id"]]
    by_id = {r["doc_id"]: r for r in got}
    assert {t["label"] for t in by_id[10]["licenses"]["templates"]} >= {"mit", "gpl-3.0-or-later"}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = licenses.build_index(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op3_license_scan(spark, sf).collect():
        words = plain(texts[r["doc_id"]])
        base = places(words)
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["labels"] == ",".join(sorted({x for _, x in base} | set(templates(words, index, 0.7))))
        assert 0 <= r["score"] <= 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(df, licenses.build_index(df)).count() == 0


def test_a_notice_many_times_over_is_found_in_time(spark):
    """Time in proportion to the text: 16000 repeats of a notice."""
    import time


    df = spark.createDataFrame([(1, "permission is hereby granted free of charge to any person obtaining a copy of this software " * 10)], "doc_id long, text string")
    index = licenses.build_index(df)
    notice = next(t for t in licenses.TEMPLATES if t.label == "mit").text
    took = []
    for n in (2000, 16000):
        long = spark.createDataFrame([(1, f"{notice} \n" * n)], "doc_id long, text string")
        began = time.time()
        [r] = licenses.scan_licenses(long, index).collect()
        took.append(time.time() - began)
        assert "mit" in [x["label"] for x in r["licenses"]["templates"]]
    assert took[1] < 8 * took[0] + 10
