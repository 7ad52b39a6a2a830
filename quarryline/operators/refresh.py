"""A whole sync: files to a new version of the tables, reading only what changed.

The version's tables are sessions, documents, source_files (a file's state), events
(what was accepted of each file, from which its session can be put together again) and
coverage.  A file of the size and time that its state has is not opened.  A file that only
grew is read from where it was left: its stored events and those of the new lines make the
same session as a full read would.

A sync looks at some roots (of a source each), or at a part of one that a selector names, and
changes nothing of any other: neither their sessions, when it prunes, nor the proofs of their
coverage.  A sync that fails withdraws all proofs of its roots, wider and narrower ones too,
since the fault may lie in any.

With a second look at the folders, after the files were read, only what is proven by then is
committed: files that only grew count as they were at the first look, if their first bytes
are still the same.

``files`` come from ``files.listed`` and are read by ranges, or bring their ``content``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import audit, catalog, project, selectors, sync
from quarryline.operators.segments import Change, merged
from quarryline.sources import adapters, jsonl
from quarryline.sources import files as where
from quarryline.storage import keep

FILE = ["source_id", "file_path"]
STATE = (
    "source_id string, file_path string, source_root string, size bigint, mtime_ms double, content_sha string, indexed_bytes bigint, next_seq bigint, "
    "session_key string, cwd string, path_date string, accepted_fingerprint string, outcome string, epoch int"
)
EVENTS = (
    "source_id string, file_path string, line_no bigint, raw_start bigint, raw_end bigint, event string, role string, text string, "
    "timestamp string, id string, cwd string, model string"
)
COVERAGE = (
    "selector_key string, source_id string, root string, record_version string, fingerprint string, "
    "file_set_fingerprint string, file_count bigint"
)
TABLES = ("sessions", "documents", "source_files", "events", "coverage")
#: What a row of a table is replaced by; the tables that follow the sessions, and those that follow the files.
KEYS = {"sessions": ("session_key",), "documents": ("session_key",), "source_files": tuple(FILE), "events": tuple(FILE), "coverage": ("selector_key",)}


@dataclass
class Refreshed:
    """status (published, unchanged, failed), the tables in force afterwards, counts per source, what changed by table.

    ``looks`` (source_id, kind, reason) says what became of the sources between two looks, if there were two.
    """

    status: str
    tables: dict[str, DataFrame]
    report: DataFrame
    changes: dict[str, Change]
    looks: DataFrame | None = None


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables before the first sync."""
    message = "source_id string, native_session_id string, session_key string, session_uuid string, source_root string, file_path string, cwd string, path_date string, seq bigint, role string, timestamp string, body_text string"
    m = spark.createDataFrame([], message)
    s = project.build_sessions(m)
    made = {"source_files": STATE, "events": EVENTS, "coverage": COVERAGE}
    return {"sessions": s, "documents": project.build_documents(m, s)} | {t: spark.createDataFrame([], k) for t, k in made.items()}


def published(tables: dict[str, DataFrame], base: str, violations: DataFrame | None = None) -> str:
    """Writes the tables as a version in force; see ``sync.publish``."""
    return sync.publish(tables, base, violations)


def current_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    path = sync.current(spark, base)
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def inspected(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that can be read, with what ``sync.classify_files`` says of them; ``from_byte`` is where to read on.

    ``files``: source_id, source_root, file_path, size, mtime_ms, error (null: readable), and content or not.
    Contents are looked at, and digested, where the listing's size or time is not the state's.
    A file that turns out unreadable has an ``error`` and no action.  The place of a file,
    which a touch must not change, is what was found in it, so it is the state's own.
    """
    names = ("size", "mtime_ms", "cwd", "path_date", "content_sha", "epoch", "indexed_bytes", "next_seq", "session_key")
    s = state.select(*FILE, *(F.col(c).alias(f"s_{c}") for c in names))
    own = ("size", "mtime_ms", "epoch", "content_sha", "cwd", "path_date", "indexed_bytes")
    known = files.where("error is null").join(s.select(*FILE, *(f"s_{c}" for c in own)), FILE, "left")
    same = F.coalesce((F.col("size") == F.col("s_size")) & (F.col("mtime_ms") == F.col("s_mtime_ms")) & (F.col("s_epoch") == sync.EPOCH), F.lit(False))
    still = known.where(same).withColumns({"content_sha": F.col("s_content_sha"), "prefix_sha": F.col("s_content_sha"), "read_bytes": F.col("s_indexed_bytes")})
    rest = known.where(~same)
    if "content" in files.columns:
        still = still.withColumn("content", F.lit(None).cast("binary"))
        first = F.least(F.coalesce("s_size", F.lit(0)), F.octet_length("content")).cast("int")
        digests = {"content_sha": F.sha2("content", 256), "prefix_sha": F.sha2(F.substring(F.col("content"), F.lit(1), first), 256)}
        rest = rest.withColumns(digests | {"read_bytes": indexed_bytes(F.col("content"))})
    else:
        rest = where.digested(rest, F.col("s_size"))
    scan = still.unionByName(rest).withColumns({"cwd": F.col("s_cwd"), "path_date": F.col("s_path_date")}).drop(*(f"s_{c}" for c in own))
    found = sync.classify_files(scan, s)
    packed = F.col("file_path").rlike(where.COMPRESSED)
    action = F.when(F.col("error").isNull(), F.when(packed & (F.col("action") == "append"), "full").otherwise(F.col("action")))
    found = found.withColumn("action", action)
    return found.withColumn("from_byte", F.when(F.col("action") == "append", F.col("s_indexed_bytes")).otherwise(0))


def _touched(found: DataFrame) -> DataFrame:
    return found.where(F.col("action").isin("full", "append"))


def read_lines(found: DataFrame) -> DataFrame:
    """Lines of the files to project from ``from_byte`` on; a fault of a file is a row with ``error``."""
    touched = _touched(found)
    if "content" not in found.columns:
        return where.lines(touched)
    packed = F.col("file_path").rlike(where.COMPRESSED)
    plain = jsonl.lines(touched.where(~packed)).join(touched.select(*FILE, "from_byte"), FILE).where("raw_start >= from_byte").drop("from_byte")
    plain = plain.withColumn("error", F.lit(None).cast("string"))
    return plain.unionByName(jsonl.lines_zstd(touched.where(packed)))


def adapted(rows: DataFrame) -> DataFrame:
    """Events of lines of all sources."""
    fresh = None
    for source, adapt in adapters.ADAPTERS.items():
        part = adapt(rows.where(F.col("source_id") == source))
        fresh = part if fresh is None else fresh.unionByName(part)
    return fresh


def indexed_bytes(content: Column) -> Column:
    """Bytes up to the last complete line, in time linear in the content."""
    raw = F.decode(content, "ISO-8859-1")
    return (F.length(raw) - F.length(F.substring_index(raw, "\n", -1))).cast("long")


def cursor_faults(found: DataFrame, messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(rule, key, detail) of grown files whose new messages do not follow the stored ones, or whose session is another one."""
    grown = found.where("action = 'append'").select(*FILE, "s_next_seq", "s_session_key", "from_byte")
    first = messages.join(grown, FILE).where("raw_start >= from_byte").groupBy(*FILE).agg(F.min("seq").alias("first"), F.max("s_next_seq").alias("want"))
    seq = first.where("first <> want").select(F.lit("append_cursor").alias("rule"), F.col("file_path").alias("key"), F.col("first").cast("string").alias("detail"))
    other = grown.join(outcomes.select(*FILE, "session_key"), FILE).where("session_key <> s_session_key")
    return seq.unionByName(other.select(F.lit("append_session").alias("rule"), F.col("file_path").alias("key"), F.col("session_key").alias("detail")))


def _report(found: DataFrame, unread: DataFrame, outcomes: DataFrame, fates: DataFrame | None) -> DataFrame:
    """Counts per source: scanned, added, updated, skipped, filtered, removed, retained_cold, errors."""
    seen = found.select(*FILE, "action", F.col("s_session_key").isNotNull().alias("had")).join(outcomes.select(*FILE, "outcome"), FILE, "left")
    done = F.col("action").isin("full", "append")
    projected = done & (F.col("outcome") == "projected")
    marks = seen.select("source_id", F.when(~done, "skipped").when(projected & F.col("had"), "updated").when(projected, "added").when(F.col("outcome") == "filtered", "filtered").otherwise("skipped").alias("mark"))
    marks = marks.unionByName(unread.select("source_id", F.lit("errors").alias("mark")))
    if fates is not None:
        marks = marks.unionByName(fates.where("fate <> 'kept'").select("source_id", F.col("fate").alias("mark")))
    n = lambda *v: F.count_if(F.col("mark").isin(*v))
    kinds = ("added", "updated", "skipped", "filtered", "removed", "retained_cold", "errors")
    return marks.groupBy("source_id").agg(n(*kinds[:4], "errors").alias("scanned"), *(n(k).alias(k) for k in kinds))


def second_look(files: DataFrame, found: DataFrame, after: DataFrame) -> DataFrame:
    """(source_id, file_path, state), as ``sync.file_transitions`` has them, of a listing and a later one.

    Files that have grown are read again, as far as they were, to prove that these bytes are the same.
    """
    listed = [*FILE, "size", "mtime_ms"]
    now = after.where("error is null")
    grown = now.join(found.select(*FILE, F.col("size").alias("was"), F.col("content_sha").alias("was_sha")), FILE).where("size > was")
    grown = grown.withColumn("size", F.col("was"))
    proven = where.digested(grown, F.lit(None)).select(*FILE, F.coalesce(F.col("content_sha") == F.col("was_sha"), F.lit(False)).alias("prefix_matches"))
    known = found.select(*FILE, F.col("s_session_key").isNotNull().alias("was_indexed"), F.col("action").isin("full", "append").alias("projected"))
    return sync.file_transitions(files.where("error is null").select(*listed), now.select(*listed), known.join(proven, FILE, "left"))


def _inside(selector: dict | None) -> Column:
    """A row with cwd and path_date is in the selected part."""
    return F.lit(True) if selector is None else selectors.contains(selectors.as_column(selector), F.col("cwd"), F.col("path_date"))


def _below(roots: DataFrame) -> DataFrame:
    return roots.withColumnRenamed("root", "source_root")


def _withdrawn(tables: dict[str, DataFrame], roots: DataFrame) -> Change:
    """Without any proof of these roots."""
    gone = tables["coverage"].join(roots, ["source_id", "root"], "left_semi").select("selector_key")
    return Change(tables["coverage"].limit(0), gone)


def refresh(files: DataFrame, tables: dict[str, DataFrame], *, roots: DataFrame | None = None, selector: dict | None = None, best_effort: bool = False, prune: bool = False, cold: DataFrame | None = None, look_again: Callable[[], DataFrame] | None = None) -> Refreshed:
    """The tables after a sync over ``files``, a whole scan of ``roots`` (source_id, root; if not given, those of the files).

    ``selector`` (of one root) takes only files of its directory or dates.  ``look_again``
    lists the roots once more, after the files were read.

    Strict: a file that cannot be read, or a source that changed in a way that cannot be
    proven harmless, stops the sync; nothing changes but that the coverage of the roots is no
    longer claimed.  Best effort: the other files are taken, but nothing is pruned and no
    coverage is claimed.  ``prune`` drops sessions of the part whose file is gone, but for
    archived ones (``cold``: native_session_id).
    """
    place = ["source_id", "source_root"]
    files = keep(files)  # folders are listed once
    if roots is None:
        roots = keep(files.select("source_id", F.col("source_root").alias("root")).distinct())
    roots = roots.select("source_id", "root").distinct()
    state = tables["source_files"].join(_below(roots), place, "left_semi")
    if selector is None and look_again is None and _as_it_was(files, state) and _proven(tables, roots):
        return Refreshed("unchanged", tables, _report_unchanged(files), {})
    found = keep(inspected(files, state))
    unread = files.where("error is not null").select(*FILE, "error").unionByName(found.where("error is not null").select(*FILE, "error"))
    found = found.where("error is null").drop("error")
    no_outcomes = found.select(*FILE, F.lit(None).cast("string").alias("outcome")).where("false")

    rows = keep(read_lines(found))
    faults = rows.where("error is not null").groupBy(*FILE).agg(F.min("error").alias("error"))
    unread, looks, omitted, unsure = unread.unionByName(faults), None, None, roots.limit(0)
    if look_again is not None:
        after = keep(look_again())
        states = keep(second_look(files, found, after))
        looks = keep(sync.verdicts(states))
        unread = unread.unionByName(after.where("error is not null").select(*FILE, "error"))
        omitted = states.where(~F.col("state").isin("same", "append")).select(*FILE)
        unsure = roots.join(looks.where("kind in ('rejected', 'deferred')"), "source_id", "left_semi")
    unread = unread.distinct()
    broken = not unread.isEmpty()
    rejected = looks is not None and not looks.where("kind = 'rejected'").isEmpty()
    if (broken or rejected) and not best_effort:
        return _finished("failed", tables, {"coverage": _withdrawn(tables, roots)}, _report(found, unread, no_outcomes, None), looks)
    for left_out in (unread if broken else None, omitted):  # a file that fails while it is read, or is not proven, stays as it was
        if left_out is not None:
            found = found.join(left_out.select(*FILE), FILE, "left_anti")
            rows = rows.join(left_out.select(*FILE), FILE, "left_anti")

    grown = found.where("action = 'append'").select(*FILE)
    events = keep(adapted(rows.drop("error")).unionByName(tables["events"].join(grown, FILE, "left_semi")))
    messages, outcomes = adapters.project_files(events)
    if selector is not None:
        outcomes = outcomes.where(_inside(selector))
        taken = keep(outcomes.select(*FILE).unionByName(found.where(~F.col("action").isin("full", "append") & _inside(selector)).select(*FILE)))
        found, events, messages = (df.join(taken, FILE, "left_semi") for df in (found, events, messages))
        events = keep(events)
    messages = keep(messages.drop("source_root").join(found.select(*FILE, "source_root"), FILE))
    touched = _touched(found).select(*FILE)
    outcomes = keep(touched.join(outcomes, FILE, "left").withColumn("outcome", F.coalesce("outcome", F.lit("skipped"))))
    sessions = keep(project.build_sessions(messages, outcomes))
    documents = keep(project.build_documents(messages, sessions))
    violations = audit.violations(sessions, documents).unionByName(cursor_faults(found, messages, outcomes))
    if not violations.isEmpty():
        raise ValueError("the tables break their rules; nothing was published")

    gone_sessions = tables["sessions"].join(touched, FILE, "left_semi").select("session_key").unionByName(sessions.select("session_key"))
    states = keep(_states(found, state, outcomes, messages))
    gone_files = touched
    fates = None
    if prune and not broken:
        there = files.select(*FILE) if selector is None else found.select(*FILE).unionByName(omitted if omitted is not None else touched.limit(0))
        here = cold if cold is not None else sessions.select("native_session_id").where("false")
        held = tables["sessions"].join(_below(roots), place, "left_semi").where(_inside(selector))
        fates = keep(sync.prune(held, there, here).select("session_key", "source_id", "file_path", "fate"))
        out = fates.where("fate = 'removed'")
        bare = state.where(F.col("session_key").isNull() & _inside(selector)).join(there, FILE, "left_anti").select(*FILE)
        gone_sessions = gone_sessions.unionByName(out.select("session_key"))
        gone_files = gone_files.unionByName(out.select(*FILE)).unionByName(bare)
    gone_sessions, gone_files = keep(gone_sessions.distinct()), keep(gone_files.distinct())
    changes = {
        "sessions": Change(sessions, gone_sessions), "documents": Change(documents, gone_sessions),
        "events": Change(events, gone_files), "source_files": Change(states, gone_files.unionByName(states.select(*FILE)).distinct()),
    }
    if broken:
        changes["coverage"] = _withdrawn(tables, roots)
    else:
        now = merged([Change(state, gone_files.limit(0)), changes["source_files"]], KEYS["source_files"])
        sure = roots.join(unsure, ["source_id", "root"], "left_anti")
        proven = keep(proofs(now, sure, selector))
        withdrawn = _withdrawn(tables, unsure).gone
        changes["coverage"] = Change(proven, proven.select("selector_key").unionByName(withdrawn))
    return _finished("published", tables, changes, _report(found, unread, outcomes, fates), looks)


def _finished(status: str, tables: dict[str, DataFrame], changes: dict[str, Change], report: DataFrame, looks: DataFrame | None) -> Refreshed:
    """Tables in force with the changes; nothing that stays is written again."""
    now = {t: merged([Change(df, c.gone.limit(0)), c], KEYS[t]) if (c := changes.get(t)) else df for t, df in tables.items()}
    return Refreshed(status, now, report, changes, looks)


def _as_it_was(files: DataFrame, state: DataFrame) -> bool:
    """Is every listed file known with its size and time, and every known file listed?"""
    s = state.select(*FILE, F.col("size").alias("s_size"), F.col("mtime_ms").alias("s_mtime"), F.col("epoch").alias("s_epoch"))
    same = F.col("error").isNull() & (F.col("size") == F.col("s_size")) & (F.col("mtime_ms") == F.col("s_mtime")) & (F.col("s_epoch") == sync.EPOCH)
    return files.select(*FILE, "size", "mtime_ms", "error").join(s, FILE, "full").where(~F.coalesce(same, F.lit(False))).isEmpty()


def _report_unchanged(files: DataFrame) -> DataFrame:
    n = F.count("*")
    none = [F.lit(0).cast("long").alias(k) for k in ("filtered", "removed", "retained_cold", "errors")]
    return files.groupBy("source_id").agg(n.alias("scanned"), F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("updated"), n.alias("skipped")).select("source_id", "scanned", "added", "updated", "skipped", *none)


def _proven(tables: dict[str, DataFrame], roots: DataFrame) -> bool:
    """Is there a current proof of all of each root?"""
    current = tables["coverage"].where(F.col("record_version") == project.INDEX_VERSION).select("selector_key")
    return _selected(roots, None).join(current, "selector_key", "left_anti").isEmpty()


def _selected(roots: DataFrame, selector: dict | None) -> DataFrame:
    """Roots with the selector that a sync covers, all of a root or the given part, and its key."""
    own = selectors.as_column(selector or {"kind": "all"})
    s = own.withField("source", F.col("source_id")).withField("root", F.col("root"))
    return roots.withColumn("selector_key", selectors.storage_key(s))


def _states(found: DataFrame, state: DataFrame, outcomes: DataFrame, messages: DataFrame) -> DataFrame:
    """The states that change: of files that were read, and of those only touched, which get their new time."""
    counts = messages.groupBy(*FILE).agg((F.max("seq") + 1).alias("next_seq"))
    at = {"indexed_bytes": F.col("read_bytes"), "epoch": F.lit(sync.EPOCH)}
    read = _touched(found).drop("cwd", "path_date").withColumns(at)
    read = read.join(outcomes.select(*FILE, "session_key", "cwd", "path_date", "accepted_fingerprint", "outcome"), FILE)
    read = read.join(counts, FILE, "left").withColumn("next_seq", F.coalesce("next_seq", F.lit(0)))
    read = read.withColumn("session_key", F.when(F.col("outcome") == "projected", F.col("session_key")))
    times = found.where("action = 'refresh'").select(*FILE, F.col("mtime_ms").alias("now_ms"))
    moved = state.join(times, FILE).withColumn("mtime_ms", F.col("now_ms"))
    columns = [c.split()[0] for c in STATE.split(", ")]
    return moved.select(*columns).unionByName(read.select(*columns))


def proofs(files: DataFrame, roots: DataFrame, selector: dict | None = None) -> DataFrame:
    """A coverage record for each of the roots (source_id, root), or the selected part of one, from the files' states."""
    place = ["source_id", "source_root"]
    files = files.where(_inside(selector))
    of = lambda name, with_content: catalog.file_set_digest(files, with_content=with_content).select(*place, "file_count", catalog.digest_text().alias(name))
    each = _below(_selected(roots, selector)).join(of("fingerprint", True).join(of("file_set_fingerprint", False).drop("file_count"), place), place, "left")
    none = F.lit("set-v1:0")  # of a root without files
    return each.select(
        "selector_key", "source_id", F.col("source_root").alias("root"), F.lit(project.INDEX_VERSION).alias("record_version"),
        F.coalesce("fingerprint", none).alias("fingerprint"), F.coalesce("file_set_fingerprint", none).alias("file_set_fingerprint"), F.coalesce("file_count", F.lit(0).cast("long")).alias("file_count"),
    )


def status(files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Per source and root of a scan: what the index holds, how fresh its proof is, and what to do.

    A changed content with the same file set may be queried as it is only if every changed
    file of the source has its indexed bytes as a prefix; otherwise, or if files came or
    went, a sync is recommended.
    """
    place = ["source_id", "source_root"]
    found = inspected(files, tables["source_files"])
    unread = files.where("error is not null").select(*place).unionByName(found.where("error is not null").select(*place))
    found = found.where("error is null")
    # An unproven change cannot be a file whose stored bytes are still its first ones.
    unproven = F.col("s_size").isNotNull() & (F.col("action") == "full")
    changed = found.groupBy(*place).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("s_size").isNull()).alias("new_files"),
        F.count_if(F.col("action").isin("full", "append") & F.col("s_size").isNotNull()).alias("changed_files"), F.count_if(unproven).alias("unproven"),
    )
    lost = tables["source_files"].join(files.select(*FILE), FILE, "left_anti").groupBy(*place).agg(F.count("*").alias("lost_files"))
    failed = files.select(*place, F.lit(0).alias("n")).unionByName(unread.withColumn("n", F.lit(1))).groupBy(*place).agg(F.sum("n").alias("errors"))
    held = tables["sessions"].groupBy(*place).agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.min("started_at").alias("first_started_at"), F.max("ended_at").alias("last_ended_at"))
    whole = _selected(tables["source_files"].select("source_id", F.col("source_root").alias("root")).unionByName(tables["coverage"].select("source_id", "root")).distinct(), None)
    current = tables["coverage"].where(F.col("record_version") == project.INDEX_VERSION).select("selector_key")
    known = whole.join(current, "selector_key", "left_semi").select("source_id", F.col("root").alias("source_root"), F.lit(True).alias("covered"))
    j = failed.join(changed, place, "left").join(lost, place, "left").join(held, place, "left").join(known, place, "left")
    j = j.fillna(0, ["files", "bytes", "new_files", "changed_files", "unproven", "lost_files", "sessions", "messages"])
    other_set = (F.col("new_files") > 0) | (F.col("lost_files") > 0) | (F.col("errors") > 0)
    reason = F.when(F.col("covered").isNull(), "missing").when(other_set, "source_set_changed").when(F.col("changed_files") > 0, "source_content_changed").otherwise("none")
    freshness = F.when(reason == "none", "fresh").when(reason == "missing", "missing").otherwise("stale")
    advisory = (F.col("source_id") == "codex") & (reason == "source_content_changed") & (F.col("unproven") == 0)
    action = F.when((freshness == "fresh") | advisory, "query").otherwise("sync")
    return j.withColumns({"freshness": freshness, "stale_reason": reason, "recommended_action": action}).drop("covered")
