"""First results by several sorts at once, and the scores of queries of one to five terms."""

import math

from pyspark.sql import functions as F

from quarryline.functions.text import query_terms
from quarryline.operators import find, recall
from quarryline.operators.index import K1, WEIGHTS, B
from quarryline.plans.search import NOW, conv, conversation_queries
from quarryline.storage import keep

SF = "/root/testdata/sf0.001"


def test_first_results_are_those_of_a_whole_search_and_found_once(spark, monkeypatch):
    c = conv(spark, SF).searchable()
    q = keep(conversation_queries(c))
    calls, scored = [], recall.scored
    monkeypatch.setattr(recall, "scored", lambda *a, **k: calls.append(1) or scored(*a, **k))
    got = {(r.sort, r.query_id): r.session_ref for r in find.first_results(q, c.documents, c.sessions, c.index, now=NOW, sorts=("relevance", "ended", "started")).collect()}
    strict = len(calls)
    expected = {}
    for sort in ("relevance", "ended", "started"):
        rows = find.find(q, c.documents, c.sessions, c.index, now=NOW, sort=sort).where("rank = 1").collect()
        expected |= {(sort, r.query_id): r.session_ref for r in rows}
    assert got == expected and len({k for _, k in got}) == q.count()
    assert strict < len(calls) - strict


def test_scores_of_one_to_five_terms(spark):
    c = conv(spark, SF).searchable()
    words = query_terms(F.col("body_text"))
    m = c.messages.where("seq < 2").select("session_key", "seq", words.alias("w")).where("size(w) > 5")
    q = keep(m.select(F.concat_ws("#", "session_key", "seq").alias("query_id"), F.array_join(F.slice("w", 1, F.pmod(F.xxhash64("session_key", "seq"), F.lit(5)).cast("int") + 1), " ").alias("query")))
    asked = keep(recall.analyzed_queries(q))
    look = recall.looked_up(asked, c.index)
    got = {(r.query_id, r.doc_id): r.fts_score for r in recall.scored(look.asked, look, c.index).collect()}

    tf, dl = {}, {r.doc_id: r.dl for r in c.index.doc_stats.collect()}
    for r in c.index.postings.collect():
        docs = tf.setdefault(r.term, {})
        docs[r.doc_id] = docs.get(r.doc_id, 0) + list(WEIGHTS.values())[r.field] * len(r.positions)
    n, avg, expected, sizes = len(dl), sum(dl.values()) / len(dl), {}, set()
    for r in asked.collect():
        if any(not t.isalnum() or not t.isascii() for t in r.a.terms):  # a phrase, or folded
            got = {k: v for k, v in got.items() if k[0] != r.query_id}
            continue
        sizes.add(len(r.a.terms))
        for doc in set.intersection(*(set(tf.get(t, {})) for t in r.a.terms)):
            total = 0.0
            for t in r.a.terms:
                f, raw = tf[t][doc], math.log((n - len(tf[t]) + 0.5) / (len(tf[t]) + 0.5))
                total += (raw if raw > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * dl[doc] / avg))
            expected[r.query_id, doc] = -total
    assert sizes == {1, 2, 3, 4, 5} and set(got) == set(expected)
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in expected)
