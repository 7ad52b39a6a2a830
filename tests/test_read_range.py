from quarryline.plans import corpora
from quarryline.plans.registry import QUERIES, load

SF = "/root/testdata/sf0.001"


def test_every_message_is_an_anchor(spark):
    load()
    m = corpora.doc_messages(spark, SF)
    want = {f"{r['session_key']}@{r['seq']}" for r in m.select("session_key", "seq").collect()}
    assert {r["anchor_id"] for r in QUERIES["read_range_all"](spark, SF).collect()} == want
