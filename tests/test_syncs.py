"""Files by ranges, segments, and syncs of folders."""

import json
import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from quarryline.operators import maintain, refresh, segments
from quarryline.operators.index import build_index, term_stats
from quarryline.sources import files, jsonl
from quarryline.storage import keep


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def said(key, *texts):
    rows = [{"type": "user" if i % 2 == 0 else "assistant", "sessionId": key, "cwd": "/c", "timestamp": f"2024-01-01T00:00:{i:02}Z", "content": t} for i, t in enumerate(texts)]
    return "".join(json.dumps(r) + "\n" for r in rows)


# Lines


def plain_lines(data):
    at, out = 0, []
    while (nl := data.find(b"\n", at)) >= 0:
        line = data[at:nl].removesuffix(b"\r")
        try:
            if line.strip(b" "):
                out.append((at, at + len(line), line.decode()))
        except UnicodeDecodeError:
            pass
        at = nl + 1
    return out


def test_offsets_are_equal_at_any_split(spark, tmp_path):
    rng = random.Random(1)
    data = {}
    for i in range(6):
        pieces = [b"ab", "é😀".encode(), b"\n", b"\r\n", b" ", b"\xff", b"x" * 90]
        data[f"f{i}.jsonl"] = b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 120)))
    for name, content in data.items():
        write(tmp_path / "r/deep" / name, content)
    listed = files.listed(spark.createDataFrame([("pi", str(tmp_path / "r"))], "source_id string, source_root string")).withColumn("from_byte", F.lit(0).cast("long"))
    assert listed.count() == 6
    want = sorted((n, *row) for n, content in data.items() for row in plain_lines(content))
    for split in (1, 7, 64, 1 << 20):
        got = files.lines(listed, split).collect()
        assert sorted((os.path.basename(r["file_path"]), r["raw_start"], r["raw_end"], r["value"]) for r in got) == want
    whole = jsonl.lines(jsonl.read_files(spark, str(tmp_path / "r"), "pi")).collect()
    assert sorted((os.path.basename(r["file_path"]), r["raw_start"], r["raw_end"], r["value"]) for r in whole) == want
    files.register(spark)
    source = spark.read.format("transcript_lines").option("source", "pi").option("splitBytes", "40").load(str(tmp_path / "r"))
    assert sorted((os.path.basename(r["file_path"]), r["raw_start"], r["raw_end"], r["value"]) for r in source.collect()) == want


def test_frames_are_read_apart(spark, tmp_path):
    """Frames cut within lines, of unknown and known size, with a frame to skip; a torn last one; one that is none."""
    rng = random.Random(2)
    lines = [json.dumps({"n": i, "x": "é" * rng.randint(0, 40)}) for i in range(400)]
    body = "".join(x + "\n" for x in lines).encode()
    packer, cuts = zstandard.ZstdCompressor(write_checksum=True), sorted(rng.sample(range(len(body)), 9))
    parts = [packer.compress(body[a:b]) for a, b in zip([0, *cuts], [*cuts, len(body)])]
    open_ended = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    parts[3] = open_ended.compress(body[cuts[2] : cuts[3]]) + open_ended.flush()
    parts.insert(5, (0x184D2A53).to_bytes(4, "little") + (7).to_bytes(4, "little") + b"skipped")
    write(tmp_path / "z/a.zst", b"".join(parts))
    incompressible = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEF\n") for _ in range(400_000))
    write(tmp_path / "z/torn.zstd", zstandard.ZstdCompressor().compress(incompressible)[:-60_000])
    write(tmp_path / "z/bad.zst", b"no frames at all")
    write(tmp_path / "z/empty.zst", b"")
    listed = files.listed(spark.createDataFrame([("dsh", str(tmp_path / "z"))], "source_id string, source_root string")).withColumn("from_byte", F.lit(0).cast("long"))
    for split in (1, 600, 1 << 20):
        rows = files.lines(listed, split).collect()
        of = lambda name: sorted((r["line_no"], r["value"]) for r in rows if r["file_path"].endswith(name) and r["error"] is None)
        assert [v for _, v in of("a.zst")] == lines
        torn = [v for _, v in of("torn.zstd")]
        assert len(torn) > 1000 and torn == [x.decode() for x in incompressible.split(b"\n") if x][: len(torn)]
        assert [r["error"] is not None for r in rows if r["file_path"].endswith("bad.zst")] == [True]


def test_listing_gives_faults_as_rows(spark, tmp_path):
    write(tmp_path / "ok/a/b/x.jsonl", "{}\n")
    write(tmp_path / "ok/y.jsonl", "")
    write(tmp_path / "ok/z.txt", "no")
    os.symlink(tmp_path / "nowhere.jsonl", tmp_path / "ok/a/gone.jsonl")
    roots = spark.createDataFrame([("pi", str(tmp_path / "ok") + "/"), ("codex", str(tmp_path / "none"))], "source_id string, source_root string")
    got = {os.path.basename(r["file_path"]): r for r in files.listed(roots).collect()}
    assert set(got) == {"x.jsonl", "y.jsonl", "gone.jsonl", "none"}
    assert {n for n, r in got.items() if r["error"]} == {"gone.jsonl", "none"} and got["y.jsonl"]["size"] == 0
    assert got["x.jsonl"]["source_root"] == str(tmp_path / "ok")
    missing = spark.createDataFrame([("pi", str(tmp_path / "was.jsonl"), 5, 0)], "source_id string, file_path string, size long, from_byte long")
    [row] = files.lines(missing).collect()
    assert row["error"] and row["value"] is None


def test_a_large_sparse_file_is_planned_in_ranges(spark, tmp_path):
    path = tmp_path / "big/s.jsonl"
    write(path, "")
    size = 3 * (1 << 30) + 17
    with open(path, "r+b") as f:
        f.truncate(size)
        f.seek(size - 9)
        f.write(b'\n{"a":1}\n')
    listed = files.listed(spark.createDataFrame([("pi", str(tmp_path / "big"))], "source_id string, source_root string")).withColumn("from_byte", F.lit(0).cast("long"))
    planned = sorted((r["start"], r["end"]) for r in files.ranges(listed, 1 << 28).collect())
    assert planned[0][0] == 0 and planned[-1][1] == size and all(a[1] == b[0] for a, b in zip(planned, planned[1:])) and len(planned) == 13
    parts = files._LineReader({"path": str(tmp_path / "big"), "source": "pi", "splitbytes": str(1 << 28)}).partitions()
    assert sorted(p.value[2:4] for p in parts) == planned
    last = files.range_lines("pi", str(path), *planned[-1], size, None, None, None)
    assert [(r[3], r[5]) for r in last] == [(size - 8, '{"a":1}')]


def test_digests_of_whole_and_prefix(spark, tmp_path):
    import hashlib

    write(tmp_path / "d/a.jsonl", b"one\ntwo\nrest")
    f = files.listed(spark.createDataFrame([("pi", str(tmp_path / "d"))], "source_id string, source_root string"))
    for n in (None, 0, 4, 12, 40):
        [r] = files.digested(f, F.lit(n)).collect()
        assert r["content_sha"] == hashlib.sha256(b"one\ntwo\nrest").hexdigest() and r["read_bytes"] == 8 and r["error"] is None
        assert r["prefix_sha"] == (hashlib.sha256(b"one\ntwo\nrest"[:n]).hexdigest() if n is not None and n <= 12 else None)
    [r] = files.digested(f.withColumn("size", F.lit(99).cast("long")), F.lit(4)).collect()
    assert r["error"] and r["content_sha"] is None


# Segments


def test_segments_merge_geometrically():
    sizes, written = [], 0
    for n in [1] * 200:
        sizes.append(n)
        first = segments.first_to_merge(sizes)
        written += sum(sizes[first:])
        sizes[first:] = [sum(sizes[first:])]
    assert sum(sizes) == 200 and len(sizes) <= 8 and written <= 200 * 9
    assert segments.first_to_merge([1000, 10, 1]) == 2


def test_store_equals_a_dictionary(spark, tmp_path):
    """Random commits; every version reads as it was, until its files are collected."""
    rng = random.Random(3)
    store = segments.Store(spark, f"file://{tmp_path}/s", {"t": segments.Layout("k string, v long", ("k",), ("k",)), "u": segments.Layout("k string", ("k",))})
    assert store.versions() == [] and store.tables()["t"].isEmpty()
    truth, seen = {}, []
    for step in range(9):
        keys = rng.sample("abcdefghij", rng.randint(0, 4))
        gone = [*keys, *rng.sample("abcdefghij", 2)]
        rows = [(k, step * 10 + i) for k in keys for i in range(2)]
        for k in gone:
            truth.pop(k, None)
        for k, v in rows:
            truth.setdefault(k, []).append(v)
        change = segments.Change(spark.createDataFrame(rows, "k string, v long"), spark.createDataFrame([(k,) for k in gone], "k string"))
        seen.append((store.commit({"t": change}), {k: sorted(v) for k, v in truth.items()}))
    read = lambda v: {r["k"]: sorted(r["v"]) for r in store.tables(v)["t"].groupBy("k").agg(F.collect_list("v").alias("v")).collect()}
    assert [v for v, _ in seen] == store.versions()
    for version, want in seen:
        assert read(version) == want
    assert len(store.manifest()["t"]) < 9 and store.tables()["u"].isEmpty()
    assert store.collect(keep=1) and store.collect(keep=1) == [] and read(seen[-1][0]) == seen[-1][1]
    with pytest.raises(ValueError, match="meanwhile"):
        store.commit({}, based_on=seen[0][0])


# Syncs


def tree(spark, base):
    return spark.createDataFrame([("claude-code", f"{base}/claude"), ("pi", f"{base}/pi")], "source_id string, root string")


def look(spark, base, only=None):
    roots = tree(spark, base)
    roots = roots.where(F.col("source_id") == only) if only else roots
    return files.listed(roots.withColumnRenamed("root", "source_root")), roots


def sync(spark, store, base, only=None, **options):
    found, roots = look(spark, base, only)
    return maintain.sync(store, found, roots=roots, **options)


def bodies(tables):
    return {r["session_key"]: r["b"] for r in tables["documents"].where("kind = 'message'").groupBy("session_key").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "seq", "body_text"))).alias("b")).collect()}


def pi_said(key, *texts):
    rows = [{"type": "session", "id": key, "cwd": "/p", "timestamp": "2024-01-01T00:00:00Z"}, *({"type": "message", "timestamp": "2024-01-01T00:00:01Z", "message": {"role": "user", "content": t}} for t in texts)]
    return "".join(json.dumps(r) + "\n" for r in rows)


def index_rows(index):
    return {(r["term"], r["doc_id"], r["field"], tuple(r["positions"])) for r in index.postings.collect()}, {tuple(r) for r in index.doc_stats.collect()}, tuple(index.corpus.first()), {tuple(r) for r in term_stats(index).collect()}


def test_store_of_syncs_keeps_tables_and_index(spark, tmp_path):
    store = maintain.open_store(spark, f"file://{tmp_path}/store")
    write(tmp_path / "claude/a.jsonl", said("a", "red lamp", "blue lamp"))
    write(tmp_path / "claude/x/b.jsonl", said("b", "green door"))
    write(tmp_path / "pi/c.jsonl", pi_said("c", "old stone"))
    first = sync(spark, store, tmp_path)
    assert first.status == "published" and len(bodies(store.tables())) == 3
    assert sync(spark, store, tmp_path).status == "unchanged" and len(store.versions()) == 1

    write(tmp_path / "claude/a.jsonl", said("a", "red lamp", "blue lamp", "and more"))  # grows
    write(tmp_path / "claude/x/b.jsonl", said("b", "another door", "here"))  # rewritten
    write(tmp_path / "claude/d.jsonl", said("d", "fresh"))
    os.remove(tmp_path / "pi/c.jsonl")
    report = {r["source_id"]: (r["added"], r["updated"], r["skipped"]) for r in sync(spark, store, tmp_path).report.collect()}
    assert report == {"claude-code": (1, 2, 0)}
    t = store.tables()
    assert bodies(t) == {"claude-code:a": ["0 red lamp", "1 blue lamp", "2 and more"], "claude-code:b": ["0 another door", "1 here"], "claude-code:d": ["0 fresh"], "pi:c": ["0 old stone"]}
    assert index_rows(maintain.index_of(t)) == index_rows(build_index(t["documents"]))

    done = sync(spark, store, tmp_path, prune=True)
    assert {(r["source_id"], r["removed"]) for r in done.report.collect()} >= {("pi", 1)}
    t = store.tables()
    assert set(bodies(t)) == {"claude-code:a", "claude-code:b", "claude-code:d"} and t["events"].where("source_id = 'pi'").isEmpty()
    assert index_rows(maintain.index_of(t)) == index_rows(build_index(t["documents"]))
    assert {(r["source_id"], r["file_count"]) for r in t["coverage"].collect()} == {("claude-code", 3), ("pi", 0)}
    assert set(bodies(store.tables(store.versions()[0]))) == {"claude-code:a", "claude-code:b", "pi:c"}


def test_what_a_sync_writes_goes_with_the_change(spark, tmp_path):
    for i in range(60):
        write(tmp_path / f"claude/{i % 7}/{i}.jsonl", said(f"s{i}", *(f"word{i} {j}" for j in range(4))))
    store = maintain.open_store(spark, f"file://{tmp_path}/store")
    sync(spark, store, tmp_path, "claude-code")
    whole = {t: s[-1].n_rows for t, s in store.manifest().items()}
    write(tmp_path / "claude/0/0.jsonl", said("s0", *(f"word0 {j}" for j in range(5))))
    sync(spark, store, tmp_path, "claude-code")
    for table, held in store.manifest().items():
        if table not in ("coverage", "chars"):
            assert [s.n_rows for s in held[:-1]] == [whole[table]] and held[-1].n_rows * 10 < whole[table], table
    assert len(bodies(store.tables())["claude-code:s0"]) == 5


def test_unchanged_files_are_not_opened(spark, tmp_path):
    """Contents that change without size or time are not seen, since nobody looks; with the time they are."""
    write(tmp_path / "claude/a.jsonl", said("a", "first word"))
    store = maintain.open_store(spark, f"file://{tmp_path}/store")
    sync(spark, store, tmp_path, "claude-code")
    at = os.stat(tmp_path / "claude/a.jsonl").st_mtime_ns
    write(tmp_path / "claude/a.jsonl", said("a", "other word"))
    os.utime(tmp_path / "claude/a.jsonl", ns=(at, at))
    assert sync(spark, store, tmp_path, "claude-code").status == "unchanged"
    os.utime(tmp_path / "claude/a.jsonl", ns=(at + 5_000_000, at + 5_000_000))
    assert sync(spark, store, tmp_path, "claude-code").status == "published"
    assert bodies(store.tables()) == {"claude-code:a": ["0 other word"]}
    os.utime(tmp_path / "claude/a.jsonl", ns=(at + 9_000_000, at + 9_000_000))  # only touched
    done = sync(spark, store, tmp_path, "claude-code")
    assert done.status == "published" and done.report.first()["skipped"] == 1
    assert sync(spark, store, tmp_path, "claude-code").status == "unchanged"


def test_one_source_leaves_the_other_alone(spark, tmp_path):
    write(tmp_path / "claude/a.jsonl", said("a", "one"))
    write(tmp_path / "pi/c.jsonl", pi_said("c", "two"))
    store = maintain.open_store(spark, f"file://{tmp_path}/store")
    sync(spark, store, tmp_path)
    os.remove(tmp_path / "claude/a.jsonl")
    sync(spark, store, tmp_path, "claude-code", prune=True)
    t = store.tables()
    assert set(bodies(t)) == {"pi:c"} and sorted((r["source_id"], r["file_count"]) for r in t["coverage"].collect()) == [("claude-code", 0), ("pi", 1)]
    assert refresh.status(*[look(spark, tmp_path)[0], t]).where("source_id = 'pi'").first()["freshness"] == "fresh"


def test_faults_strict_and_best_effort(spark, tmp_path):
    write(tmp_path / "claude/a.jsonl", said("a", "one"))
    write(tmp_path / "pi/c.jsonl", pi_said("c", "two"))
    store = maintain.open_store(spark, f"file://{tmp_path}/store")
    sync(spark, store, tmp_path)
    write(tmp_path / "claude/b.jsonl", said("b", "new"))
    os.symlink(tmp_path / "nowhere", tmp_path / "claude/broken.jsonl")
    assert sync(spark, store, tmp_path, "claude-code").status == "failed"
    t = store.tables()
    assert set(bodies(t)) == {"claude-code:a", "pi:c"} and [r["source_id"] for r in t["coverage"].collect()] == ["pi"]
    done = sync(spark, store, tmp_path, "claude-code", best_effort=True, prune=True)
    assert done.status == "published" and done.report.first()["errors"] == 1
    t = store.tables()
    assert set(bodies(t)) == {"claude-code:a", "claude-code:b", "pi:c"} and [r["source_id"] for r in t["coverage"].collect()] == ["pi"]


def test_compressed_and_odd_files_in_a_sync(spark, tmp_path):
    session = {"type": "session", "id": "z", "cwd": "/z", "createdAt": 1704067200000}
    message = {"type": "user/message", "time": 1704067201000, "data": {"source": {"kind": "user"}, "content": [{"type": "text", "text": "packed words"}]}}
    body = "".join(json.dumps(o) + "\n" for o in (session, message)).encode()
    write(tmp_path / "dsh/p/s/session.jsonl.zstd", zstandard.ZstdCompressor().compress(body[:30]) + zstandard.ZstdCompressor().compress(body[30:]))
    write(tmp_path / "claude/a.jsonl", said("a", "before").encode() + b'{"x":"\xff"}\n' + said("a", "after").encode())
    roots = spark.createDataFrame([("dsh", f"{tmp_path}/dsh"), ("claude-code", f"{tmp_path}/claude")], "source_id string, root string")
    found = files.listed(roots.withColumnRenamed("root", "source_root"))
    store = maintain.open_store(spark, f"file://{tmp_path}/store")
    maintain.sync(store, found, roots=roots)
    assert bodies(store.tables()) == {"dsh:z": ["0 packed words"], "claude-code:a": ["0 before", "1 after"]}
    write(tmp_path / "dsh/p/t/session.jsonl.zstd", b"no frame")
    assert maintain.sync(store, files.listed(roots.withColumnRenamed("root", "source_root")), roots=roots).status == "failed"


def test_second_look_at_growing_shrinking_and_vanishing_files(spark, tmp_path):
    day = "2026/08/15"
    meta = lambda key, *texts: "".join(json.dumps(o) + "\n" for o in ({"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": key, "cwd": "/w"}}, *({"timestamp": "2024-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "user_message", "message": t}} for t in texts)))

    def world(name):
        base = tmp_path / name
        for key in ("a", "b"):
            write(base / f"codex/{day}/{key}.jsonl", meta(key, f"first {key}"))
        roots = spark.createDataFrame([("codex", f"{base}/codex")], "source_id string, root string")
        store = maintain.open_store(spark, f"file://{base}/store")
        find_files = lambda: files.listed(roots.withColumnRenamed("root", "source_root"))
        return base / f"codex/{day}/a.jsonl", store, roots, find_files

    def run(case, change, *, indexed=True, **options):
        path, store, roots, find_files = world(case)
        if indexed:
            maintain.sync(store, find_files(), roots=roots)
            write(path, meta("a", "first a", "second a"))

        def look_again():
            change(path)
            return find_files()

        done = maintain.sync(store, keep(find_files()), roots=roots, look_again=look_again, **options)
        verdict = done.looks.first()
        return done.status, (verdict["kind"], verdict["reason"]), bodies(store.tables()), store.tables()["coverage"].count()

    grow = lambda p: write(p, p.read_bytes() + meta("a", "late").encode())
    assert run("same", lambda p: None) == ("published", ("stable", None), {"codex:a": ["0 first a", "1 second a"], "codex:b": ["0 first b"]}, 1)
    assert run("grown", grow) == ("published", ("append_only", "source_content_changed"), {"codex:a": ["0 first a", "1 second a"], "codex:b": ["0 first b"]}, 1)
    assert run("new", grow, indexed=False) == ("published", ("deferred", "active_source_deferred"), {"codex:b": ["0 first b"]}, 0)
    old = {"codex:a": ["0 first a"], "codex:b": ["0 first b"]}
    assert run("shrunk", lambda p: write(p, meta("a"))) == ("failed", ("rejected", "source_not_append_only"), old, 0)
    assert run("rewritten", lambda p: write(p, meta("a", "other a", "second a", "more"))) == ("failed", ("rejected", "projected_prefix_not_proven"), old, 0)
    assert run("gone", os.remove) == ("failed", ("rejected", "source_file_set_changed"), old, 0)
    assert run("best", lambda p: write(p, meta("a")), best_effort=True) == ("published", ("rejected", "source_not_append_only"), old, 0)


def test_tail_of_growing_files_equals_one_read(spark, tmp_path):
    from quarryline.streaming import tail

    tail.register(spark)
    rng = random.Random(4)
    out, log, root = tmp_path / "out", tmp_path / "log", tmp_path / "logs"
    pieces = [b'{"a":1}', "é".encode(), b"\n", b"\n", b"\r\n", b"xyz"]
    for step in range(4):
        for i in range(3 if step else 2):
            path = root / f"d{i}/f.jsonl"
            write(path, (path.read_bytes() if path.exists() else b"") + b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))))
        rows = spark.readStream.format("transcript_tail").option("source", "pi").option("splitBytes", "16").load(str(root))
        q = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted((r["file_path"], r["raw_start"], r["raw_end"], r["value"]) for r in spark.read.parquet(str(out)).collect())
        want = sorted((str(p), *row) for p in root.rglob("*.jsonl") for row in plain_lines(p.read_bytes()))
        assert got == want, step
    assert tail.last_line_end(str(root / "d0/f.jsonl"), 0, os.path.getsize(root / "d0/f.jsonl")) == (root / "d0/f.jsonl").read_bytes().rfind(b"\n") + 1


def test_selector_counts_by_running_sums(spark):
    """Every kind of selector, over nested roots and missing dates, against a plain count."""
    from quarryline.operators import catalog

    rng = random.Random(5)
    days = [None] + [f"2024-01-{d:02}" for d in range(1, 9)]
    rows = [(f"k{i}", rng.choice(["pi", "dsh"]), f"/r/{rng.choice('ab')}/{rng.choice('cd')}/{i}.jsonl", rng.choice(["/p", "/q", ""]), rng.choice(days), rng.randint(1, 9)) for i in range(300)]
    s = spark.createDataFrame([(*r, r[-1] + 1) for r in rows], "session_key string, source_id string, file_path string, cwd string, path_date string, message_count long, document_count long")
    wanted = []
    for i in range(120):
        kind = rng.choice(["all", "cwd", "date_range", "cwd_date_range"])
        lo, hi = sorted(rng.sample(days[1:] + ["2023-01-01", "2025-01-01"], 2))
        wanted.append((i, (kind, rng.choice(["pi", "dsh", "codex"]), rng.choice(["/r", "/r/a", "/r/b/c", "/r/a/", "/x"]).rstrip("/"), rng.choice(["/p", "/q"]) if "cwd" in kind else None, *((lo, hi) if "date" in kind else (None, None)))))
    w = spark.createDataFrame(wanted, "selector_id long, s struct<kind:string,source:string,root:string,cwd:string,fromDate:string,toDate:string>")

    def inside(row, sel):
        kind, source, root, cwd, lo, hi = sel
        _, src, path, c, d, _ = row
        return src == source and path.startswith(root + "/") and ("cwd" not in kind or c == cwd) and ("date" not in kind or (d is not None and lo <= d <= hi))

    want = {}
    for i, sel in wanted:
        hit = [r for r in rows if inside(r, sel)]
        want[i] = (len(hit), sum(r[5] for r in hit), sum(r[5] + 1 for r in hit))
    assert {r["selector_id"]: tuple(r)[1:] for r in catalog.selector_counts(s, w).collect()} == want


def test_files_with_nothing_more_to_say_are_not_written_between_two_looks(spark, tmp_path):
    """Of two files that may grow, one has one message only: it stays as it was, and its source only grew."""
    from quarryline.plans.registry import QUERIES, load

    load()
    rows = [(4, 0, "user", "one word"), (4, 1, "assistant", "two words"), (84, 0, "user", "the only one"), *((i, 0, "user", "a word") for i in (5, 6, 7))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["source_id"]: (r["kind"], r["reason"]) for r in QUERIES["sync_second_look"](spark, str(tmp_path)).collect()}
    stable = ("stable", None)
    assert found == {"codex": ("append_only", "source_content_changed"), "claude-code": stable, "pi": stable, "dsh": stable}


def test_indexed_bytes_end_with_the_last_complete_line(spark):
    """Also where that line is the last one, and soon where lines are long."""
    import time

    contents = [b"", b"a", b"\n", b"abc\ndef\n", b"abc\ndef", b"abc\n\n", "é\nü\n".encode(), b"a\nb\r\n", b"a\nbc\xc2\x85", b"\xff\xfe\nx"]
    rows = spark.createDataFrame([(bytearray(c),) for c in contents], "content binary").select("content", refresh.indexed_bytes(F.col("content")).alias("n"))
    assert {bytes(r["content"]): r["n"] for r in rows.collect()} == {c: c.rfind(b"\n") + 1 for c in contents}
    long = spark.range(1).select(F.encode(F.concat(F.repeat(F.lit("x"), 200_000), F.lit("\ny")), "UTF-8").alias("content"))
    began = time.time()
    assert long.select(refresh.indexed_bytes(F.col("content"))).first()[0] == 200_001
    assert time.time() - began < 20  # the square of the line's length took minutes
