"""Queries over syncs of real folders into a store of segments, with their SQL twins.

The folders are written from the conversations, in the shared folder, so all work grows with them.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import catalog, find, maintain, project, refresh, segments
from quarryline.operators import index as ix
from quarryline.plans import corpora
from quarryline.plans.library import DOC_SQL, docs, register
from quarryline.plans.search import CONV_QUERIES_SQL, CONV_SQL, NOW, candidates_sql, conv, conversation_queries, merged_sql, ranked_sql, result_rows, scored_sql
from quarryline.plans.upkeep import GROWN, REWRITTEN, TOUCHED, C_SQL, case_of, files_before, files_now, first_sync
from quarryline.sources import files as where
from quarryline.storage import keep, shared_path

#: What stays after the sources' touched files of one source went away.
_GONE_SQL = "source_id = 'pi' AND (native_session_id::BIGINT // 4) % 5 = 3"
LEFT_SQL = "WITH " + ",".join([
    corpora.CONV_MESSAGES_SQL.replace("conv_m AS", "conv_all AS"), f"conv_m AS (SELECT * FROM conv_all WHERE NOT ({_GONE_SQL}))",
    project.sessions_sql("conv_m", "conv_s"), project.documents_sql("conv_m", "conv_s", "conv_d"), ix.index_sql("conv_d", "conv"),
])


def _writer(batches):
    """Writes (file_path, content); compressed names get a frame for each of two halves."""
    for batch in batches:
        paths = []
        for path, content in zip(*(c.to_pylist() for c in batch.columns)):
            system, inner = where.located(path)
            system.create_dir(inner.rpartition("/")[0])
            if path.endswith(".zst"):
                cut = len(content) // 2
                content = b"".join(zstandard.ZstdCompressor().compress(part) for part in (content[:cut], content[cut:]))
            with system.open_output_stream(inner, compression=None) as f:
                f.write(content)
            paths.append(path)
        yield pa.record_batch([pa.array(paths, pa.string())], ["file_path"])


def write_tree(files: DataFrame, base: str) -> None:
    """Files (file_path, content, source_id) below a folder; those of the compressed source are compressed."""
    path = F.concat(F.lit(base), "file_path")
    path = F.when(F.col("source_id") == "dsh", F.regexp_replace(path, "jsonl$", "zst")).otherwise(path)
    files.select(path.alias("file_path"), "content").mapInArrow(_writer, "file_path string").write.format("noop").mode("overwrite").save()


def roots_of(spark: SparkSession, base: str, sources=corpora.SOURCES) -> DataFrame:
    return spark.createDataFrame([(s, f"{base}/logs/{s}") for s in sources], "source_id string, root string")


def _rooted(roots: DataFrame) -> DataFrame:
    return roots.withColumnRenamed("root", "source_root")


def sync_folder(store: segments.Store, roots: DataFrame, **options) -> refresh.Refreshed:
    """A sync of everything below some roots."""
    return maintain.sync(store, where.listed(_rooted(roots)), roots=roots, **options)


_stores: dict[tuple, segments.Store] = {}


def synced_store(spark: SparkSession, sf_dir: str, *, pruned: bool = False) -> segments.Store:
    """A store after a first sync, one of all that changed, and if asked one that prunes what went away.

    Queries of one session over one folder share it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, pruned)
    if key not in _stores:
        _stores[key] = _synced(spark, sf_dir, pruned)
    return _stores[key]


def _synced(spark: SparkSession, sf_dir: str, pruned: bool) -> segments.Store:
    folder = shared_path(spark)
    base = where.plain(folder)
    store, roots = maintain.open_store(spark, f"{folder}/store"), roots_of(spark, base)
    write_tree(files_before(spark, sf_dir), base)
    sync_folder(store, roots)
    write_tree(files_now(spark, sf_dir).where(case_of(F.col("file_path")).isin(0, GROWN, REWRITTEN)), base)
    sync_folder(store, roots)
    if pruned:
        left = where.listed(_rooted(roots)).where(~((F.col("source_id") == "pi") & (case_of(F.col("file_path")) == TOUCHED)))
        maintain.sync(store, left, roots=roots, prune=True)
    return store


_SHOWN = ["doc_id", "session_key", "kind", "seq", "role"]


@register("sync_folders_documents", CONV_SQL + " SELECT doc_id, session_key, kind, seq, role, trim(body_text) AS body_text, trim(title_text) AS title_text FROM conv_d")
def folder_documents(spark, sf_dir):
    """Two syncs of folders, one source compressed, into segments: the same documents as one full read."""
    d = synced_store(spark, sf_dir).tables()["documents"]
    return d.select(*_SHOWN, F.trim("body_text").alias("body_text"), F.trim("title_text").alias("title_text"))


@register(
    "sync_folders_versions",
    C_SQL + """, g AS (SELECT count(*) FILTER (k <> 0) AS first_sessions, count(*) AS second_sessions, count(*) FILTER (NOT (source_id = 'pi' AND k = 3)) AS third_sessions FROM c)
    SELECT 0 AS version, first_sessions AS sessions FROM g UNION ALL SELECT 1, second_sessions FROM g UNION ALL SELECT 2, third_sessions FROM g""",
)
def folder_versions(spark, sf_dir):
    """Sessions of each version: a reader of an older one still sees what it saw."""
    store = synced_store(spark, sf_dir, pruned=True)
    counts = [store.tables(v)["sessions"].agg(F.lit(i).alias("version"), F.count("*").alias("sessions")) for i, v in enumerate(store.versions())]
    return reduce(DataFrame.unionByName, counts)


@register("sync_index_postings", LEFT_SQL + ' SELECT term, doc_id, field, count(*) AS "count", min(pos) AS "first" FROM conv_post GROUP BY 1, 2, 3')
def folder_postings(spark, sf_dir):
    """The index that three syncs kept, with additions, rewritten and pruned sessions: that of the documents left."""
    p = maintain.index_of(synced_store(spark, sf_dir, pruned=True).tables()).postings
    return p.select("term", "doc_id", "field", F.size("positions").cast("long").alias("count"), F.array_min("positions").cast("long").alias("first"))


@register("sync_index_corpus", LEFT_SQL + " SELECT n, round(avgdl, 6) AS avgdl FROM conv_corpus")
def folder_corpus(spark, sf_dir):
    """Number and average length of the documents that the kept index counts."""
    return maintain.index_of(synced_store(spark, sf_dir, pruned=True).tables()).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


@register(
    "sync_index_find",
    ",".join([LEFT_SQL, CONV_QUERIES_SQL, scored_sql(), candidates_sql(10), ranked_sql(10), merged_sql(10)]),
)
def folder_find(spark, sf_dir):
    """A search over base and delta segments: what a search over an index built anew finds."""
    t = synced_store(spark, sf_dir, pruned=True).tables()
    queries = conversation_queries(conv(spark, sf_dir)).join(t["sessions"].select(F.col("session_key").alias("query_id")), "query_id", "left_semi")
    return result_rows(find.find(keep(queries), t["documents"], t["sessions"], maintain.index_of(t), now=NOW))


# A sync changes nothing of roots it does not look at


def _one_source(spark: SparkSession, sf_dir: str, source: str, stays: Column, **options) -> dict[str, DataFrame]:
    """Tables after a first sync of all, and a second of one source's files that are still there."""
    tables = first_sync(spark, sf_dir)
    files = files_before(spark, sf_dir).where((F.col("source_id") == source) & stays)
    return refresh.refresh(files, tables, **options).tables


@register("sync_prune_one_source", C_SQL + " SELECT session_key FROM c WHERE k <> 0 AND NOT (source_id = 'codex' AND k = 3)")
def prune_one(spark, sf_dir):
    """Pruning by a sync of one source takes that source's lost files only."""
    tables = _one_source(spark, sf_dir, "codex", case_of(F.col("file_path")) != TOUCHED, prune=True)
    return tables["sessions"].select("session_key")


@register("sync_coverage_one_source", C_SQL + " SELECT source_id, source_root AS root, count(*) FILTER (source_id <> 'codex' OR k <> 3) AS file_count FROM c WHERE k <> 0 GROUP BY 1, 2")
def cover_one(spark, sf_dir):
    """A sync of one source renews its proof and leaves one of each other source."""
    tables = _one_source(spark, sf_dir, "codex", case_of(F.col("file_path")) != TOUCHED, prune=True)
    return tables["coverage"].select("source_id", "root", "file_count")


@register("sync_failed_one_source", C_SQL + " SELECT DISTINCT source_id, source_root AS root FROM c WHERE k <> 0 AND source_id <> 'pi'")
def fail_one(spark, sf_dir):
    """A strict sync that fails withdraws the proof of its own source only."""
    tables = first_sync(spark, sf_dir)
    bad = files_now(spark, sf_dir).where("source_id = 'pi'").withColumns({"error": F.lit("unreadable"), "content": F.lit(None).cast("binary")})
    return refresh.refresh(bad, tables).tables["coverage"].select("source_id", "root")


@register("sync_shared_path", CONV_SQL + " SELECT source_id, session_key, message_count FROM conv_s WHERE source_id IN ('claude-code', 'pi') UNION ALL SELECT 'pi', 'pi:' || native_session_id, message_count FROM conv_s WHERE source_id = 'claude-code' AND false")
def shared(spark, sf_dir):
    """Two sources with files of one name: each keeps its own sessions."""
    files = keep(files_now(spark, sf_dir).where("source_id in ('claude-code', 'pi')"))
    number = F.floor(F.regexp_extract("file_path", r"([0-9]+)\.jsonl$", 1).cast("long") / 4).cast("string")
    named = files.withColumns({"source_root": F.lit("/logs"), "file_path": F.concat(F.lit("/logs/"), number, F.lit(".jsonl"))})
    return refresh.refresh(named, refresh.empty_tables(spark)).tables["sessions"].select("source_id", "session_key", "message_count")


@register("sync_compressed", CONV_SQL + " SELECT doc_id, kind, seq, role, trim(body_text) AS body_text FROM conv_d WHERE source_id = 'dsh'")
def compressed(spark, sf_dir):
    """Files of the compressed source with their contents at hand."""
    files = files_now(spark, sf_dir).where("source_id = 'dsh'")
    packed = files.withColumn("file_path", F.concat("file_path", F.lit(".zst")))

    def pack(batches):
        for batch in batches:
            at = batch.schema.get_field_index("content")
            made = [zstandard.ZstdCompressor().compress(c) for c in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, pa.binary()))

    packed = packed.mapInArrow(pack, packed.schema).withColumn("size", F.octet_length("content").cast("long"))
    d = refresh.refresh(packed, refresh.empty_tables(spark)).tables["documents"]
    return d.select("doc_id", "kind", "seq", "role", F.trim("body_text").alias("body_text"))


@register("sync_bad_bytes", CONV_SQL + " SELECT session_key, message_count FROM conv_s WHERE source_id <> 'dsh'")
def bad_bytes(spark, sf_dir):
    """A line that is not UTF-8 in front of each file's last one is passed over; all others are read."""
    files = files_now(spark, sf_dir).where("source_id <> 'dsh'")
    raw = F.decode("content", "ISO-8859-1")
    odd = F.regexp_replace(raw, r"([^\n]*\n)$", '{"type":"ÿ"}\n$1')
    files = files.withColumn("content", F.encode(odd, "ISO-8859-1")).withColumn("size", F.octet_length("content").cast("long"))
    return refresh.refresh(files, refresh.empty_tables(spark)).tables["sessions"].select("session_key", "message_count")


@register(
    "ranged_lines",
    r"""WITH f AS (SELECT doc_id, string_split(coalesce(text, '') || chr(10), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS value, unnest(range(len(ls))) AS i, len(ls) AS n FROM f),
    o AS (SELECT *, coalesce(sum(strlen(value) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_start FROM l)
    SELECT doc_id, raw_start, raw_start + strlen(value) AS raw_end, sha256(value) AS value_sha256 FROM o WHERE trim(value) <> '' AND i < n - 1""",
)
def ranged(spark, sf_dir):
    """Texts as files, read in ranges of 200 bytes: every line once, with its offsets."""
    base = where.plain(shared_path(spark))
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    content = F.encode(F.concat("text", F.lit("\n")), "UTF-8")
    path = F.concat(F.lit("/d/"), (F.col("doc_id") % 50).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jsonl"))
    write_tree(d.select(F.lit("pi").alias("source_id"), path.alias("file_path"), content.alias("content")), base)
    files = where.listed(spark.createDataFrame([("pi", f"{base}/d")], "source_id string, source_root string"))
    rows = where.lines(files.withColumn("from_byte", F.lit(0).cast("long")), split_bytes=200)
    name = F.regexp_extract("file_path", r"([0-9]+)\.jsonl$", 1).cast("long")
    return rows.select(name.alias("doc_id"), "raw_start", "raw_end", F.sha2("value", 256).alias("value_sha256"))


# What changes while a sync runs, and syncs of a part


def _second_sync(spark: SparkSession, sf_dir: str) -> tuple[refresh.Refreshed, segments.Store]:
    """A sync during which the first source's files grow."""
    folder = shared_path(spark)
    base = where.plain(folder)
    store, roots = maintain.open_store(spark, f"{folder}/store"), roots_of(spark, base)
    write_tree(files_before(spark, sf_dir), base)
    sync_folder(store, roots)

    def look_again():
        chosen = (F.col("source_id") == "codex") & (case_of(F.col("file_path")) == GROWN)
        was = files_before(spark, sf_dir).where(chosen).select(*refresh.FILE, F.col("size").alias("was"))
        # A file that has nothing more to say is not written: with a new time only, it would not be one that grew.
        write_tree(files_now(spark, sf_dir).where(chosen).join(was, refresh.FILE).where("size > was").drop("was"), base)
        return where.listed(_rooted(roots))

    return sync_folder(store, roots, look_again=look_again), store


@register(
    "sync_second_look",
    C_SQL + """ SELECT source_id, CASE WHEN source_id = 'codex' AND bool_or(k = 1) THEN 'append_only' ELSE 'stable' END AS kind,
    CASE WHEN source_id = 'codex' AND bool_or(k = 1) THEN 'source_content_changed' END AS reason FROM c WHERE k <> 0 GROUP BY 1""",
)
def looks(spark, sf_dir):
    """What became of each source between the two looks of a sync."""
    return _second_sync(spark, sf_dir)[0].looks


@register("sync_proven_prefix", C_SQL + " SELECT session_key, CASE WHEN k = 1 THEN 1 ELSE message_count END AS message_count FROM c WHERE k <> 0")
def proven_prefix(spark, sf_dir):
    """Files that grow during a sync count as they were at its first look."""
    return _second_sync(spark, sf_dir)[1].tables()["sessions"].select("session_key", "message_count")


@register("sync_scoped", CONV_SQL + " SELECT session_key, cwd, message_count FROM conv_s WHERE source_id = 'claude-code' AND cwd = '/work/p3'")
def scoped(spark, sf_dir):
    """A sync of one directory of one source takes no other sessions."""
    part = {"kind": "cwd", "source": "claude-code", "root": "/logs/claude-code", "cwd": "/work/p3"}
    files = files_now(spark, sf_dir).where("source_id = 'claude-code'")
    return refresh.refresh(files, refresh.empty_tables(spark), selector=part).tables["sessions"].select("session_key", "cwd", "message_count")


@register(
    "sync_scoped_prune",
    C_SQL + " SELECT session_key FROM c WHERE k <> 0 AND NOT (source_id = 'codex' AND cwd = '/work/p4' AND k = 3)",
)
def scoped_prune(spark, sf_dir):
    """Pruning by a sync of a part takes lost files of that part only."""
    part = {"kind": "cwd", "source": "codex", "root": "/logs/codex", "cwd": "/work/p4"}
    files = files_before(spark, sf_dir).where((F.col("source_id") == "codex") & (case_of(F.col("file_path")) != TOUCHED))
    return refresh.refresh(files, first_sync(spark, sf_dir), selector=part, prune=True).tables["sessions"].select("session_key")


@register(
    "sync_scoped_proofs",
    C_SQL + """, p AS (SELECT source_id, source_root AS root, count(*) FILTER (k <> 0) AS broad, count(*) FILTER (source_id = 'codex' AND cwd = '/work/p4') AS narrow FROM c GROUP BY 1, 2)
    SELECT 'good' AS mode, source_id, root, broad AS file_count FROM p WHERE broad > 0 UNION ALL SELECT 'good', source_id, root, narrow FROM p WHERE source_id = 'codex'
    UNION ALL SELECT 'bad', source_id, root, broad FROM p WHERE source_id <> 'codex' AND broad > 0""",
)
def scoped_proofs(spark, sf_dir):
    """A proof of a part stands beside the broad one; a sync of a part that fails withdraws both."""
    part = {"kind": "cwd", "source": "codex", "root": "/logs/codex", "cwd": "/work/p4"}
    tables, files = first_sync(spark, sf_dir), files_now(spark, sf_dir).where("source_id = 'codex'")
    good = refresh.refresh(files, tables, selector=part).tables["coverage"]
    bad = refresh.refresh(files.withColumn("error", F.lit("unreadable")), tables, selector=part).tables["coverage"]
    shown = lambda df, mode: df.select(F.lit(mode).alias("mode"), "source_id", "root", "file_count")
    return shown(good, "good").unionByName(shown(bad, "bad"))


_WORD_SQL = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::BIGINT AS d{i}" for i in range(4))
_SET_SQL = DOC_SQL + f" SELECT source_id, source_root, count(*) AS file_count, {_WORD_SQL} FROM (SELECT source_id, source_root, sha256(file_path) AS h FROM doc_s) GROUP BY 1, 2"


@register("file_set_digests", _SET_SQL)
def set_digests(spark, sf_dir):
    """Order-free digests of the file sets."""
    return catalog.file_set_digest(docs(spark, sf_dir)[1], with_content=False)


@register("file_set_digests_by_change", _SET_SQL)
def set_digests_by_change(spark, sf_dir):
    """The same from the digests of other sets and what went and came."""
    s = keep(docs(spark, sf_dir)[1].select("source_id", "source_root", "file_path"))
    odd = F.crc32("file_path") % 3
    lost = s.where(odd == 1).withColumn("file_path", F.concat("file_path", F.lit("~")))
    of = lambda df: catalog.file_set_digest(df, with_content=False)
    return catalog.digest_after(of(s.where(odd != 0).unionByName(lost)), of(lost), of(s.where(odd == 0)))
