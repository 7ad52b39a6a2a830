"""Syncs over a store: the tables and the search index of a version are published together.

What a sync changes of the documents, it changes of the index: the postings of changed
documents are a new segment, and the postings of sessions that were replaced or removed
are told by the session's key.  So a search after a sync finds what it would in an index
built anew, and the sync does not touch the other documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import refresh
from quarryline.operators.index import Index, build_index
from quarryline.operators.segments import Change, Layout, Store

POSTINGS = "term string, doc_id string, field int, positions array<int>, session_key string"
DOC_STATS = "doc_id string, dl bigint, session_key string"
CHARS = "char string, doc_id string, session_key string"


def open_store(spark: SparkSession, base: str) -> Store:
    """The store below a folder, empty if nothing was published there."""
    empty = refresh.empty_tables(spark)
    order = {"sessions": ("session_key",), "documents": ("session_key", "seq"), "events": ("source_id", "file_path", "line_no")}
    layouts = {t: Layout(df.schema, refresh.KEYS[t], order.get(t, ())) for t, df in empty.items()}
    layouts["postings"] = Layout(POSTINGS, ("session_key",), ("term", "doc_id"))
    layouts["doc_stats"] = Layout(DOC_STATS, ("session_key",))
    layouts["chars"] = Layout(CHARS, ("session_key",), ("char", "doc_id"))
    return Store(spark, base, layouts)


def index_change(documents: Change) -> dict[str, Change]:
    """What a change of the documents is to the index."""
    made = build_index(documents.rows)
    key = F.regexp_replace("doc_id", "#[0-9]*$", "").alias("session_key")
    parts = {"postings": made.postings, "doc_stats": made.doc_stats, "chars": made.chars}
    return {t: Change(df.select("*", key), documents.gone) for t, df in parts.items()}


def index_of(tables: dict[str, DataFrame]) -> Index:
    """The search index of a version's tables."""
    stats = tables["doc_stats"].select("doc_id", "dl")
    corpus = stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(tables["postings"].drop("session_key"), stats, corpus, tables["chars"].drop("session_key"))


def sync(store: Store, files: DataFrame, **options) -> refresh.Refreshed:
    """A sync (options as ``refresh.refresh`` has them) against the store's newest version, and the version it makes."""
    version = next(reversed(store.versions()), None)
    tables = store.tables(version)
    done = refresh.refresh(files, {t: tables[t] for t in refresh.TABLES}, **options)
    changes = dict(done.changes)
    if "documents" in changes:
        changes |= index_change(changes["documents"])
    if changes:
        store.commit(changes, based_on=version)
    return done
