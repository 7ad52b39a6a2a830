"""Candidates to ranked sessions, and the results of several sources to one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import has_bounded_phrase, has_trailing_arguments, let, shortest_ordered_span, term_hits, tokenize
from quarryline.operators.recall import TEXT_FIELDS, session_columns
from quarryline.storage import keep

#: Fixed values of the session score.
DAY_MS = 86_400_000.0
#: Texts of the display row that results show or test.
SHOWN_TEXTS = ("body_text", "compact_text", "reasoning_text")
#: Columns of a candidate's session, and what results call them.
SAID = {"session_summary": "summary_text"} | {c: c for c in ("session_uuid", "title", "cwd", "started_at", "ended_at", "message_count")}


def is_message() -> Column:
    return F.col("kind") == "message"


def content() -> Column:
    """What a candidate's text is: its body, or the profile's fields."""
    return F.when(is_message(), F.col("body_text")).otherwise(F.concat_ws("\n", "title_text", "summary_text", "compact_text", "reasoning_text"))


def _phrase(text: Column, a: Column) -> Column:
    plain = (a["normalized"] != "") & text.contains(a["normalized"])
    return F.when(a["is_path_like"], has_bounded_phrase(text, a["normalized"])).otherwise(plain)


def path_bonus(text: Column, a: Column) -> Column:
    """Extra score of a command-like query whose terms stand in order in the text."""
    n = F.size(a["terms"])

    def by_gap(span):
        gap = span - n
        return F.when(span.isNull(), 0.0).when(gap == 0, 8.0).when(gap <= 3, 24.0 - 2.0 * gap).when(gap <= n, 10.0 - gap).otherwise(0.0)

    loose = let(shortest_ordered_span(tokenize(text), a["terms"]), by_gap)
    bounded = F.when(has_trailing_arguments(text, a["normalized"]), 60.0).otherwise(36.0)
    return F.when(~a["is_path_like"] | (n < 2), 0.0).otherwise(F.when(has_bounded_phrase(text, a["normalized"]), bounded).otherwise(loose)).cast("double")


def row_score(a: Column) -> Column:
    """Score of one candidate for its query's analysis."""
    user = is_message() & (F.col("role") == "user")

    def points(text):
        return F.when(_phrase(text, a), 8.0).otherwise(0.0) + path_bonus(text, a) + 2.0 * term_hits(text, a["terms"])

    # The text is put in lower case once, however many tests look at it.
    return -F.col("fts_score") + let(F.lower(content()), points) + F.when(is_message(), 4.0).otherwise(0.0) + F.when(user, 2.0).otherwise(0.0)


def title_restates(title: Column, a: Column) -> Column:
    """The title repeats the command and says something else besides."""
    rest = F.replace(title, a["normalized"], F.lit(" "))
    return a["is_path_like"] & has_bounded_phrase(title, a["normalized"]) & (F.size(tokenize(rest)) >= 2)


def epoch_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text)).cast("double")


def recency(ended_at: Column, now: str) -> Column:
    """18 points now, 0.15 less a day, never below 0; later times count as now, other texts as 0."""
    days = F.greatest(epoch_ms(F.lit(now)) - epoch_ms(ended_at), F.lit(0.0)) / DAY_MS
    return F.when(epoch_ms(ended_at).isNull(), 0.0).otherwise(F.greatest(18.0 - days * 0.15, F.lit(0.0)))


def session_ref(source: Column, uuid: Column, key: Column) -> Column:
    return F.when(source == "codex", uuid).when(key == "", F.concat_ws(":", source, uuid)).otherwise(key)


def parse_session_ref(ref: Column) -> Column:
    """Struct (source_id, native) of a reference; without a known source's prefix it is the first source's."""
    known = F.regexp_extract(ref, r"^(codex|claude-code|pi|dsh):(.+)$", 1)
    return F.struct(F.when(known != "", known).otherwise("codex").alias("source_id"), F.when(known != "", F.regexp_replace(ref, r"^[a-z-]+:", "")).otherwise(ref).alias("native"))


def group_sessions(rows: DataFrame) -> DataFrame:
    """Candidates with a row score to one row a query and session.

    The display row is a message if any matched, then the best score, then the
    earliest candidate; the score is of the best row of any kind.  Columns of the session
    are kept where the candidates have them.
    """
    message = is_message().cast("int")
    texts = [c for c in SHOWN_TEXTS if c in rows.columns]
    shown = F.max_by(F.struct("kind", "seq", "role", "timestamp", "doc_id", *texts), F.struct(message, "score", -F.col("cand_pos")))
    said = [F.min_by(c, "cand_pos").alias(n) for c, n in SAID.items() if c in rows.columns]
    return rows.groupBy("query_id", "source_id", "session_key").agg(
        F.max("score").alias("best"),
        shown.alias("shown"),
        F.count("*").alias("match_count"),
        F.sum(1 - message).alias("profile_hits"),
        F.sum((is_message() & (F.col("role") == "user")).cast("int")).alias("user_hits"),
        F.min("cand_pos").alias("first_pos"),
        *said,
    )


def score_sessions(grouped: DataFrame, queries: DataFrame, now: str) -> DataFrame:
    """Adds the session score; queries hold (query_id, a)."""
    s = grouped.join(queries.select("query_id", "a"), "query_id")
    a, title = F.col("a"), F.lower("title")
    s = s.withColumn("restates", title_restates(title, a))
    points = (
        F.col("best")
        + F.when(_phrase(title, a) & ~F.col("restates"), 30.0).otherwise(0.0)
        + 10.0 * F.when(F.col("restates"), 0).otherwise(term_hits(title, a["terms"]))
        + 18.0 * term_hits(F.lower("cwd"), a["terms"])
        + 4.0 * F.least("user_hits", F.lit(3))
        + 2.0 * F.least("profile_hits", F.lit(2))
        + 1.5 * F.least("match_count", F.lit(6))
        + recency(F.col("ended_at"), now)
        - F.when(F.col("restates"), 20.0).otherwise(0.0)
    )
    return s.withColumn("score", points)


def matched_fields(shown: Column, title: Column, summary: Column, a: Column) -> Column:
    """["message"], or the profile fields that hold a term or the whole query."""
    texts = [("title", title), ("summary", summary), ("compact", shown["compact_text"]), ("reasoning_summary", shown["reasoning_text"])]
    hit = lambda t: (t != "") & (F.exists(a["terms"], lambda x: F.lower(t).contains(x)) | ((a["normalized"] != "") & F.lower(t).contains(a["normalized"])))
    profile = F.filter(F.array(*(F.when(hit(t), name) for name, t in texts)), lambda x: x.isNotNull())
    return F.when(shown["kind"] == "message", F.array(F.lit("message"))).otherwise(profile)


def needles(a: Column) -> Column:
    """What one of must stand in a field that a query matches: its terms and the whole of it, without those that hold another one."""
    every = F.filter(F.array_distinct(F.concat(a["terms"], F.array(a["normalized"]))), lambda x: x != "")
    return F.filter(every, lambda x: ~F.exists(every, lambda y: (x != y) & x.contains(y)))


#: Needles that are sent to the tasks at a time.
SENT_NEEDLES = 1 << 16


def holdings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, field, no): the needles (no, needle) that each text (key, field, text) holds.

    A text's pieces of the needles' lengths are looked up, so the time goes with the texts and not
    with texts times needles.
    """
    found = []
    n = max(1, -(-wanted.count() // SENT_NEEDLES))
    for i in range(n):
        some = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("needle"), F.lit(n)) == i)
        lengths = some.agg(F.sort_array(F.collect_set(F.length("needle"))).alias("lengths"))  # one row
        at = texts.where("text <> ''").crossJoin(F.broadcast(lengths)).where("size(lengths) > 0")
        at = at.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text"))))
        tails = at.select("key", "field", F.substring(F.col("text"), F.col("at"), F.array_max("lengths")).alias("tail"), "lengths")
        pieces = tails.select("key", "field", "tail", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("tail"))
        pieces = pieces.select("key", "field", F.substring(F.col("tail"), F.lit(1), F.col("n")).alias("needle"))
        found.append(pieces.join(F.broadcast(some), "needle").select("key", "field", "no"))
    return reduce(DataFrame.unionByName, found).distinct()


#: Queries, and profiles, of a cell in which all of them meet.
CELL = (4096, 512)


def matched_profiles(queries: DataFrame, sessions: DataFrame, *, cell: tuple[int, int] = CELL) -> DataFrame:
    """(query_id, session_key, fields): all pairs of a query (query_id, source_id, a) and a session of its source, with the profile fields that match.

    The pairs are the result, so its size is quadratic.  What each profile holds is found before, for all
    queries' needles, and pairs compare numbers.  They are made in cells of a part of a source's
    queries and a part of its sessions, so no task has more than a few cells' pairs.
    """
    asked = keep(queries.select("source_id", "query_id", needles(F.col("a")).alias("wanted")))
    one = asked.select("source_id", "query_id", F.explode_outer("wanted").alias("needle"))
    wanted = keep(one.where("needle is not null").select("needle").distinct().withColumn("no", F.monotonically_increasing_id()))
    q = keep(one.join(wanted, "needle", "left").groupBy("source_id", "query_id").agg(F.collect_set("no").alias("wanted")))
    profiles = keep(sessions.select("source_id", "session_key", F.lower("title").alias("title"), F.lower("summary_text").alias("summary")))
    texts = profiles.select(F.col("session_key").alias("key"), F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("title", "summary")))))
    held = holdings(texts, wanted).groupBy("key").agg(*(F.collect_set(F.when(F.col("field") == c, F.col("no"))).alias(c) for c in ("title", "summary")))
    s = keep(profiles.select("source_id", "session_key").join(held.withColumnRenamed("key", "session_key"), "session_key", "left"))

    n = [df.groupBy("source_id").count().agg(F.count("*").alias("sources"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first() for df in (q, s)]
    sides = [max(1, -(-x["most"] // rows)) for x, rows in zip(n, cell)]
    part = lambda key, side: F.pmod(F.xxhash64(key), F.lit(side)).cast("int")
    each = lambda side: F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    q = q.withColumn("q_part", part("query_id", sides[0])).withColumn("s_part", each(sides[1]))
    s = s.withColumn("s_part", part("session_key", sides[1])).withColumn("q_part", each(sides[0]))
    keys, cells = ["source_id", "q_part", "s_part"], max(1, n[0]["sources"]) * sides[0] * sides[1]
    # The cells' number is stated, else Spark would put these few rows into few tasks, or all of a source into one.
    both = q.repartition(cells, *keys).join(s.repartition(cells, *keys), keys)

    def hit(field):  # most queries have two needles or one; looking for these makes nothing for a pair
        has = lambda i: F.coalesce(F.array_contains(field, F.get("wanted", F.lit(i))), F.lit(False))
        return F.when(has(0) | has(1) | ((F.size("wanted") > 2) & F.coalesce(F.arrays_overlap(field, "wanted"), F.lit(False))), field)

    return both.select("query_id", "session_key", F.concat_ws(",", hit("title"), hit("summary")).alias("fields"))


def ranked_sessions(cands: DataFrame, queries: DataFrame, now: str, *, limit: int = 10, sort: str = "relevance", documents: DataFrame | None = None, sessions: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """The first sessions per query and source, in order, with their display row.

    Candidates come with all columns, or as keys and with ``documents`` and ``sessions``:
    then a key meets its document, and its group its session, for the score only, and what
    ``whole_results`` gives back is left there.
    Time sorts keep the newest 2 x limit sessions first and score only those; the
    final order is by time, then score.  With ``first``, only so many of the sessions come out, and
    of those that a time sort keeps, only those are scored that may be among them.
    """
    part = ["query_id", "source_id"]
    time = {"ended": "ended_at", "started": "started_at"}.get(sort)
    if time:
        newest = cands.groupBy(*part, "session_key").agg(F.min_by(time, "cand_pos").alias("at"), F.min("cand_pos").alias("pos"))
        w = Window.partitionBy(*part).orderBy(F.desc("at"), "pos", "session_key")
        newest = newest.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2 * limit)
        if first is not None:
            newest = newest.withColumn("newer", F.rank().over(Window.partitionBy(*part).orderBy(F.desc("at")))).where(F.col("newer") <= first)
        cands = cands.join(newest.select(*part, "session_key"), [*part, "session_key"], "left_semi")
    rows = cands
    if documents is not None:
        rows = cands.select("query_id", "doc_id", "fts_score", "cand_pos").join(documents.select("doc_id", "source_id", "session_key", "kind", "seq", "role", "timestamp", *TEXT_FIELDS), "doc_id")
    rows = rows.join(queries.select("query_id", "a"), "query_id")
    rows = rows.withColumn("score", row_score(F.col("a"))).drop("a")
    if documents is not None:
        rows = rows.drop(*TEXT_FIELDS)
    grouped = group_sessions(rows)
    if sessions is not None:
        grouped = grouped.join(session_columns(sessions).select("session_key", *(F.col(c).alias(n) for c, n in SAID.items())), "session_key")
    s = score_sessions(grouped, queries, now)
    s = s.withColumn("session_ref", session_ref(F.col("source_id"), F.col("session_uuid"), F.col("session_key")))
    if sessions is not None:
        s = s.select(*part, "session_key", "session_ref", "score", "started_at", "ended_at", "first_pos", "match_count", "shown")
    order = [F.desc(time), F.desc("score"), "source_id", "session_ref"] if time else [F.desc("score"), F.desc("ended_at"), "first_pos"]
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= min(limit, first or limit))


def whole_results(ranked: DataFrame, documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions ranked by keys, with their analysis a, as results show them."""
    texts = documents.select(F.col("doc_id").alias("shown_id"), F.struct(*SHOWN_TEXTS).alias("texts"))
    said = session_columns(sessions).select("session_key", *(F.col(c).alias(n) for c, n in SAID.items() if n not in ranked.columns))
    s = ranked.join(texts, F.col("shown.doc_id") == F.col("shown_id")).join(said, "session_key")
    return as_results(s.withColumn("shown", F.struct("shown.*", "texts.*")))


def as_results(ranked: DataFrame) -> DataFrame:
    """Ranked sessions with the texts of their display rows, as results show them."""
    shown = F.col("shown")
    return ranked.select(
        "query_id", "source_id", "rank", "session_ref", "session_key", "session_uuid", "score", "title", "summary_text", "cwd", "started_at", "ended_at", "match_count",
        F.when(shown["kind"] == "message", "message").otherwise("session").alias("match_source"), shown["seq"].alias("match_seq"),
        F.when(shown["kind"] != "message", "session").when(shown["role"] == "user", "user").otherwise("assistant").alias("match_role"), shown["timestamp"].alias("match_timestamp"),
        matched_fields(shown, F.col("title"), F.col("summary_text"), F.col("a")).alias("matched_fields"), F.col("message_count").alias("session_message_count"),
        F.when(shown["kind"] == "message", shown["body_text"]).otherwise(F.concat_ws("\n", "title", "summary_text", shown["compact_text"], shown["reasoning_text"])).alias("content"),
    )


def rank(cands: DataFrame, queries: DataFrame, now: str, *, limit: int = 10, sort: str = "relevance") -> DataFrame:
    """Results per query and source from candidates with all columns."""
    return as_results(ranked_sessions(cands, queries, now, limit=limit, sort=sort))


def merge(results: DataFrame, *, limit: int = 10, sort: str = "relevance") -> DataFrame:
    """One list a query from the sources' lists.

    A session that comes twice keeps its better rank.  By relevance the score becomes
    1 / (60 + rank); with one source only, its own scores and order stay.
    """
    w = Window.partitionBy("query_id", "source_id", "session_ref").orderBy("rank", F.desc("score"))
    one = results.withColumn("copy", F.row_number().over(w)).where("copy = 1").drop("copy")
    many = F.size(F.collect_set("source_id").over(Window.partitionBy("query_id"))) > 1
    one = one.withColumn("many", many)
    time = {"ended": "ended_at", "started": "started_at"}.get(sort)
    score = F.col("score") if time else F.when(F.col("many"), 1.0 / (60.0 + F.col("rank"))).otherwise(F.col("score"))
    one = one.withColumn("score", score)
    ties = [F.desc("score"), "source_id", "session_ref"]
    order = [F.desc(time), *ties] if time else [F.desc("score"), F.desc("ended_at"), "source_id", "session_ref"]
    ranked = one.withColumn("merged", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("merged") <= limit).withColumn("rank", F.col("merged")).drop("merged", "many")
