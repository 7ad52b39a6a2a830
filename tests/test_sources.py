"""Files, lines, adapters, streaming and publication."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.operators import audit, project, selectors, sync
from quarryline.operators.evaluate import keyword_check, read_goldens, scoreboard, structured_check, top_differences
from quarryline.sources import adapters, jsonl
from quarryline.streaming import sessions as stream

UUID = "5b1d0c2e-91a4-4f61-8b1c-3d1e5a7f9021"


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan_takes_only_transcripts(spark, tmp_path):
    write(tmp_path / "a/x.jsonl", "{}\n")
    write(tmp_path / "a/b/y.jsonl", "{}\n")
    write(tmp_path / "a/z.txt", "no")
    write(tmp_path / "a/w.zstd", "no")
    assert {r["file_path"].rsplit("/", 1)[1] for r in jsonl.scan(spark, str(tmp_path), "pi").collect()} == {"x.jsonl", "y.jsonl"}
    assert [r["file_path"][-6:] for r in jsonl.scan(spark, str(tmp_path), "dsh").collect()] == ["w.zstd"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        jsonl.scan(spark, str(tmp_path / "none"), "pi").collect()


def test_lines_offsets_limit_and_tail(spark, tmp_path):
    data = 'é one\r\n\n{"b":2}\ntail'.encode()
    write(tmp_path / "f.jsonl", data)
    files = jsonl.read_files(spark, str(tmp_path), "pi")
    rows = jsonl.lines(files).orderBy("line_no").collect()
    assert [(r["value"], data[r["raw_start"] : r["raw_end"]].decode()) for r in rows] == [("é one", "é one"), ('{"b":2}', '{"b":2}')]
    assert [r["value"] for r in jsonl.lines(files, keep_tail=True).orderBy("line_no").collect()][-1] == "tail"
    assert [r["value"] for r in jsonl.lines(files, limit=12).collect()] == ["é one"]
    assert [r["value"] for r in jsonl.lines(files, limit=12, keep_tail=True).collect()] == ["é one"]
    assert [r["value"] for r in jsonl.lines(files, parse_from=rows[1]["raw_start"]).collect()] == ['{"b":2}']
    assert jsonl.objects(spark.createDataFrame([("[1]",), ("{",), ('{"a":1}',), ("3",)], "value string")).count() == 1


def zstd(data):
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        out.write(data)
    return sink.getvalue().to_pybytes()


def test_compressed_lines_keep_the_prefix_of_a_torn_file(spark, tmp_path):
    import random

    rng = random.Random(1)
    body = "".join(json.dumps({"n": i, "x": rng.random()}) + "\n" for i in range(60000)).encode()
    write(tmp_path / "ok.zstd", zstd(b'{"a":1}\n\n{"a":2}\ntail'))
    write(tmp_path / "torn.zstd", zstd(body)[:-2000])
    write(tmp_path / "bad.zst", b"not compressed at all")
    rows = jsonl.lines_zstd(jsonl.read_files(spark, str(tmp_path), "dsh")).collect()
    by = lambda name: [r for r in rows if r["file_path"].endswith(name)]
    assert [r["value"] for r in by("ok.zstd")] == ['{"a":1}', '{"a":2}']
    assert len(by("torn.zstd")) > 1000 and all(r["error"] is None for r in by("torn.zstd"))
    assert [r["value"] for r in by("bad.zst")] == [None] and by("bad.zst")[0]["error"]


def test_path_dates_uuids_and_cold_ids(spark, tmp_path):
    paths = [f"/l/2020/01/15/rollout-2020-01-15T01-00-00-{UUID}.jsonl", "/l/rollout-2021-02-03T00-00-00-x.jsonl", "/l/s.jsonl"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(jsonl.path_date(F.col("p")), jsonl.file_uuid(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("2020-01-15", UUID), ("2021-02-03", ""), (None, "")]
    write(tmp_path / f"d/{UUID}-{UUID.replace('1', 'A')}.jsonl.zst", "x")
    write(tmp_path / "d/none.jsonl", "")
    assert [r[0] for r in jsonl.cold_ids(spark, [str(tmp_path)]).collect()] == [UUID.replace("1", "a")]


def events(spark, source, objects):
    rows = [(source, f"/l/{source}/f.jsonl", i, i * 10, i * 10 + 5, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    return adapters.ADAPTERS[source](spark.createDataFrame(rows, "source_id string, file_path string, line_no long, raw_start long, raw_end long, value string"))


def test_codex_adapter(spark):
    t = "2024-01-01T00:00:00Z"
    e = events(spark, "codex", [
        {"timestamp": t, "type": "session_meta", "payload": {"id": "s1", "cwd": "/a"}},
        {"timestamp": t, "type": "turn_context", "payload": {"model": "m1", "cwd": "/b"}},
        {"timestamp": t, "type": "event_msg", "payload": {"type": "user_message", "message": " hi "}},
        {"timestamp": t, "type": "event_msg", "payload": {"type": "tool", "message": "private"}},
        {"timestamp": t, "type": "event_msg", "payload": {"type": "user_message", "message": 3}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "no time"}},
        {"timestamp": t, "type": "event_msg", "payload": {"type": "agent_message", "message": ">>> TRANSCRIPT START\nx"}},
        {"timestamp": t, "type": "event_msg", "payload": {"type": "agent_message", "message": ">>> TRANSCRIPT STARTED"}},
        {"timestamp": t, "type": "compacted", "payload": {"message": "c  1"}}, {"timestamp": t, "type": "compacted", "payload": {"message": "c 1"}}, {"timestamp": t, "type": "compacted", "payload": {"message": "c 2"}},
        {"timestamp": t, "type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "r1"}, {"text": " "}, 5, {"text": "r2"}]}},
        "{broken", "[1]", '"text"',
    ])
    messages, out = adapters.project_files(e)
    assert [(r["seq"], r["role"], r["body_text"]) for r in messages.orderBy("seq").collect()] == [(0, "user", "hi"), (1, "assistant", ">>> TRANSCRIPT STARTED")]
    [o] = out.collect()
    assert (o["session_key"], o["cwd"], o["model"], o["compact_text"], o["reasoning_summary_text"], o["filtered_count"], o["outcome"]) == ("codex:s1", "/a", "m1", "c 1 | c 2", "r1 | r2", 1, "projected")


def test_claude_pi_and_dsh_adapters(spark):
    parts = [{"type": "text", "text": " a "}, {"type": "tool_use", "text": "private"}, {"type": "text", "text": "b"}]
    m, _ = adapters.project_files(events(spark, "claude-code", [
        {"type": "user", "sessionId": "c1", "cwd": "/c", "timestamp": "t1", "message": {"content": parts}}, {"type": "user", "isMeta": True, "content": "x"}, {"type": "assistant", "isSidechain": True, "content": "x"},
        {"type": "assistant", "sessionId": "c1", "content": "plain"}, {"type": "summary", "content": "x"},
    ]))
    assert [r["body_text"] for r in m.orderBy("seq").collect()] == ["a\n\nb", "plain"]
    m, o = adapters.project_files(events(spark, "pi", [
        {"type": "session", "id": "p1", "cwd": "/p", "timestamp": "t0"}, {"type": "model_change", "modelId": "m2"}, {"type": "message", "message": {"role": "user", "content": ["x", {"type": "text", "text": "y"}], "timestamp": "t1"}},
        {"type": "message", "message": {"role": "tool", "content": "no"}}, {"type": "compaction", "summary": "s", "timestamp": "t2"},
    ]))
    assert [(r["body_text"], r["timestamp"]) for r in m.collect()] == [("x\n\ny", "t1")]
    assert [(r["session_key"], r["cwd"], r["model"], r["compact_text"]) for r in o.collect()] == [("pi:p1", "/p", "m2", "s")]
    m, o = adapters.project_files(events(spark, "dsh", [
        {"type": "session", "id": "d1", "cwd": "/d", "createdAt": 1704067200000}, {"type": "session/title", "data": {"title": "first"}}, {"type": "session/title", "data": {"title": "second"}},
        {"type": "user/message", "time": 1704067200500, "data": {"source": {"kind": "user"}, "content": [{"type": "text", "text": "hey"}]}}, {"type": "user/message", "time": 1, "data": {"source": {"kind": "hook"}, "content": "no"}},
        {"type": "assistant/message", "time": 1704067201000, "data": {"message": {"role": "assistant", "content": "yo"}}}, {"type": "assistant/message", "data": {"message": {"role": "assistant", "content": "no time"}}},
    ]))
    assert [(r["role"], r["body_text"], r["timestamp"]) for r in m.orderBy("seq").collect()] == [("user", "hey", "2024-01-01T00:00:00.500Z"), ("assistant", "yo", "2024-01-01T00:00:01.000Z")]
    assert [(r["session_key"], r["title"]) for r in o.collect()] == [("dsh:d1", "second")]


def test_private_records_leave_the_fingerprint(spark):
    keep = {"type": "user", "sessionId": "c", "content": "kept"}
    prints = [adapters.project_files(events(spark, "claude-code", [keep, *more]))[1].first()["accepted_fingerprint"] for more in ([], [{"type": "tool", "content": "x"}], [{"type": "user", "sessionId": "c", "content": "new"}])]
    assert prints[0] == prints[1] != prints[2]


def test_selectors(spark):
    s = selectors.selector
    for bad in (lambda: s("all", " "), lambda: s("cwd", "/r"), lambda: s("date_range", "/r", from_date="2024-1-1", to_date="2024-01-02"), lambda: s("date_range", "/r", from_date="2024-01-03", to_date="2024-01-02"), lambda: s("x", "/r")):
        with pytest.raises(ValueError):
            bad()
    text = [('{"kind":"all"}', None), ('{"kind":"cwd","cwd":" /w "}', None), ('{"kind":"cwd"}', "cwd"), ("{", "kind"), ('{"kind":"date_range","fromDate":"2024-02-01","toDate":"2024-01-01"}', "reversed")]
    got = spark.createDataFrame([(t,) for t, _ in text], "t string").select(selectors.canonical(F.col("t"), default_root="/r").alias("c")).select("c.error", selectors.storage_key(F.col("c.selector"))).collect()
    assert [r[0] for r in got] == [e for _, e in text]
    assert got[1][1] == '{"kind":"cwd","source":"codex","root":"/r","cwd":"/w"}'
    under = spark.createDataFrame([("/r",), ("/r/x",), ("/rx",), ("/r_/x",)], "p string").select(selectors.under(F.col("p"), F.lit("/r"))).collect()
    assert [r[0] for r in under] == [True, True, False, False]


def test_publish_is_all_or_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("codex", 1)], "source_id string, n int")
    base = str(tmp_path / "t")
    first = sync.publish({"sessions": rows}, base)
    assert sync.current(spark, base) == first
    with pytest.raises(ValueError):
        sync.publish({"sessions": rows}, base, violations=rows)
    assert sync.current(spark, base) == first
    second = sync.publish({"sessions": rows.union(rows)}, base)
    assert sync.current(spark, base) == second and spark.read.parquet(f"{second}/sessions").count() == 2


def test_cold_roots(spark):
    kind = "source_id string, root string, added_at string"
    a = sync.add_cold_roots(spark.createDataFrame([("codex", "/c", "1")], kind), spark.createDataFrame([("codex", "/c", "2"), ("codex", "/d", "3")], kind))
    assert sorted(map(tuple, a.collect())) == [("codex", "/c", "1"), ("codex", "/d", "3")]
    assert [r["root"] for r in sync.remove_cold_roots(a, a.where("root = '/c'")).collect()] == ["/d"]


def test_bad_messages(spark):
    rows = spark.createDataFrame([("k", "user", 0, "t", 0, 5), ("k", "system", 1, "t", 0, 5), ("k", "user", -1, "t", 0, 5), ("k", "user", 2, "", 0, 5), ("k", "user", 3, "t", 9, 5)], "session_key string, role string, seq long, body_text string, raw_start long, raw_end long")
    assert [r["rule"] for r in audit.bad_messages(rows).orderBy("seq").collect()] == ["seq", "role", "body_text", "offsets"]


def test_goldens_and_checks(spark, tmp_path):
    write(tmp_path / "g.jsonl", '# note\n{"id":"a","query":"q"}\n\nbroken\n{"id":"b"}\n{"id":"c","query":"r"}')
    good, bad = read_goldens(spark, str(tmp_path / "g.jsonl"), "id string, query string")
    assert sorted(r["id"] for r in good.collect()) == ["a", "c"] and sorted(r["line"] for r in bad.collect()) == [4, 5]
    results = spark.createDataFrame([(1, 1, "codex", "u1", "u1", "T one", "", "/w", "snip", "message", 4), (1, 2, "codex", "u2", "u2", "T two", "", "/x", "s", "message", 1)], "query_id long, rank int, source_id string, session_uuid string, session_ref string, title string, summary_text string, cwd string, snippet string, match_source string, match_seq long")
    g = spark.createDataFrame([(1, "two", "/X", None), (2, "x", None, None), (3, None, None, None)], "query_id long, title_or_summary string, cwd string, snippet string")
    assert {r[0]: r[1] for r in keyword_check(g, results).collect()} == {1: "pass", 2: "fail", 3: "skip"}
    s = spark.createDataFrame([(1, "hard", 5, None, ["u2"], None, "/x", None, 1, ["body"], [("f", ["gone"])])], "query_id long, status string, top_k int, source_id string, session_uuids array<string>, session_ref string, cwd_contains string, match_source string, match_seq long, must_contain array<string>, facets array<struct<label:string,must_contain:array<string>>>")
    ctx = spark.createDataFrame([(1, "The Body")], "query_id long, context string")
    marks = structured_check(s, results, ctx)
    [m] = marks.collect()
    assert (m["mark"], m["assertion_mark"], m["facet_mark"], m["failure_classes"], m["hit_rank"]) == ("fail", "pass", "fail", ["cli_recall_ranking_context"], 2)
    assert scoreboard(marks).first()["hard_fail"] == 1
    assert top_differences(results, results.withColumn("rank", 3 - F.col("rank"))).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("codex", f"codex:{s}", f"/f/{s}", i * 10, "user" if i % 2 == 0 else "assistant", f"2024-01-0{1 + i % 9}", f"text {s} {i}") for s in range(3) for i in range(7)]
    columns = [f.split()[0] for f in stream.EVENTS.split(", ")]
    inbox, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    write(inbox / "1.json", "".join(json.dumps(dict(zip(columns, r))) + "\n" for r in rows if r[3] < 30))

    def drain():
        q = stream.reduce_sessions(stream.read_segments(spark, str(inbox))).writeStream.outputMode("update").option("checkpointLocation", str(log)).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    drain()
    write(inbox / "2.json", "".join(json.dumps(dict(zip(columns, r))) + "\n" for r in rows if r[3] >= 20))  # one record comes twice
    drain()
    got = spark.read.parquet(str(out)).groupBy("session_key").agg(F.max_by(F.struct("next_seq", "first_user", "last_user", "last_assistant", "low", "high"), "next_seq").alias("s")).select("session_key", "s.*").collect()
    m = spark.createDataFrame(rows, stream.EVENTS).withColumn("n", F.col("raw_start"))
    m = project.number_messages(m, order_col="raw_start")
    want = m.groupBy("session_key").agg(*(c.alias(n) for n, c in project.session_digest().items())).select("session_key", "message_count", "first_user", "last_user", "last_assistant", "low", "high").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_index_sink_equals_rebuild(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"text number {i}", "", "", "", "") for i in range(6)], "doc_id string, body_text string, title_text string, summary_text string, compact_text string, reasoning_text string")
    sink = stream.index_sink(str(tmp_path))
    for n in (0, 1, 1):  # a batch that is run again leaves one copy
        sink(docs.where(F.col("doc_id").cast("int") % 2 == n), n)
    from quarryline.operators.index import build_index

    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("term", "doc_id", "field", "positions").collect())
    assert key(spark.read.parquet(f"{tmp_path}/postings")) == key(build_index(docs).postings.withColumn("doc_id", F.col("doc_id")))


def test_streamed_index_can_be_read(spark, tmp_path):
    from quarryline.operators.index import build_index, term_stats

    docs = spark.createDataFrame([(str(i), f"text number {i % 3} text", "", "", "", "") for i in range(6)], "doc_id string, body_text string, title_text string, summary_text string, compact_text string, reasoning_text string")
    sink = stream.index_sink(str(tmp_path))
    for n in (0, 1, 1):
        sink(docs.where(F.col("doc_id").cast("int") % 2 == n), n)
    index, df = stream.streamed_index(spark, str(tmp_path))
    whole = build_index(docs)
    assert tuple(index.corpus.first()) == tuple(whole.corpus.first())
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in term_stats(whole).collect()}


def test_stream_of_sessions_in_several_files(spark, tmp_path):
    """Offsets count per file, repeats do not count, and summaries stay distinct and in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [f.split()[0] for f in stream.EVENTS.split(", ")]
    row = lambda path, at, role, text: dict(zip(columns, ("codex", "codex:s", path, at, role, f"2024-01-0{1 + at % 9}", text)))
    first = [row("/a", i, "user", f"a{i}") for i in range(3)] + [row("/a", 3, "compact", "so  far"), row("/a", 4, "compact", "so far")]
    second = [row("/b", i, "assistant", f"b{i}") for i in range(3)] + [row("/b", 3, "compact", "and more")]
    inbox, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    for n, rows in enumerate((first, second + first, second)):
        write(inbox / f"{n}.json", "".join(json.dumps(r) + "\n" for r in rows))
        events = stream.drop_repeats(stream.read_segments(spark, str(inbox)))
        q = stream.reduce_sessions(events).writeStream.outputMode("update").option("checkpointLocation", str(log)).foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{out}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(out)).orderBy(F.desc("next_seq"), F.desc(F.length("compact_text"))).first()
    assert (got["next_seq"], got["first_user"], got["last_assistant"], got["compact_text"]) == (6, "a0", "b2", "so far | and more")


def test_syncs_from_version_to_version(spark, tmp_path):
    """A first sync by a version on disk, a second that finds nothing new."""
    from quarryline.operators import refresh

    lines = "".join(json.dumps(o) + "\n" for o in ({"type": "user", "sessionId": "c1", "cwd": "/c", "timestamp": "2024-01-01T00:00:00Z", "content": "hello"}, {"type": "assistant", "sessionId": "c1", "content": "hi"}))
    row = ("claude-code", "/l", "/l/x.jsonl", len(lines), 1.0, lines.encode(), None)
    files = spark.createDataFrame([row], "source_id string, source_root string, file_path string, size long, mtime_ms double, content binary, error string")
    first = refresh.refresh(files, refresh.empty_tables(spark))
    refresh.published(first.tables, str(tmp_path / "base"))
    again = refresh.refresh(files, refresh.current_tables(spark, str(tmp_path / "base")))
    assert [(r["added"], r["skipped"]) for r in (first.report.first(), again.report.first())] == [(1, 0), (0, 1)]
    assert again.tables["documents"].count() == 3 and again.tables["coverage"].count() == 1
    bad = files.withColumns({"error": F.lit("gone"), "content": F.lit(None).cast("binary")})
    strict = refresh.refresh(bad, again.tables)
    assert strict.status == "failed" and strict.tables["coverage"].isEmpty() and strict.tables["sessions"].count() == 1
