"""The whole search: recall, fallback, ranking, merging, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.relax import diagnosis, next_action, refinement, relaxed_queries
from quarryline.operators import coverage, read
from quarryline.operators.index import Index
from quarryline.operators.rank import merge, ranked_sessions, whole_results
from quarryline.operators.recall import analyzed_queries, candidate_keys, distinct_queries, for_each, in_batches
from quarryline.storage import keep


def with_fallback(strict: DataFrame, queries: DataFrame, documents: DataFrame, sessions: DataFrame, index: Index, **options) -> DataFrame:
    """Keys of the candidates of distinct analysed queries; one without any gets those of its relaxed forms, in their order.

    A document that several forms find counts once, for the first of them.
    """
    open_ = queries.where(F.size(relaxed_queries(F.col("query"))) > 0)
    if open_.isEmpty():  # no query has other forms
        return strict
    strict = keep(strict)
    missed = open_.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    forms = missed.select(*(c for c in missed.columns if c not in ("query", "a")), F.posexplode(relaxed_queries(F.col("query"))).alias("form", "query"))
    forms = keep(forms).withColumns({"whole_id": F.col("query_id"), "query_id": F.concat_ws("\x01", F.col("query_id").cast("string"), F.col("form").cast("string"))})
    if forms.isEmpty():
        return strict
    more = candidate_keys(forms.drop("whole_id", "form"), documents, sessions, index, **options)
    more = more.join(forms.select("query_id", "whole_id", "form"), "query_id")
    more = more.withColumn("query_id", F.col("whole_id").cast(queries.schema["query_id"].dataType)).drop("whole_id")
    once = Window.partitionBy("query_id", "doc_id").orderBy("form")
    more = more.withColumn("n", F.row_number().over(once)).where("n = 1")
    place = Window.partitionBy("query_id", "source_id").orderBy("form", "cand_pos")
    more = more.withColumn("cand_pos", F.row_number().over(place)).drop("n", "form")
    return strict.unionByName(more)


def find(queries: DataFrame, documents: DataFrame, sessions: DataFrame, index: Index, *, now: str, limit: int = 10, sort: str = "relevance", scope: Column | None = None, exclude: DataFrame | None = None, per_source: bool = False) -> DataFrame:
    """Ranked sessions of each query (query_id, query); merged over the sources unless ``per_source``.

    Queries that ask the same are searched, ranked and merged once; texts are joined to
    what is left.
    """
    one, ids = distinct_queries(queries)
    q = keep(analyzed_queries(one))
    options = {"limit": limit, "sort": sort, "scope": scope, "exclude": exclude}

    def ranked_of(some: DataFrame, strict: DataFrame) -> DataFrame:
        # A batch of queries is sent to the tasks, so what meets the texts is keys only, and texts are not shuffled again.
        found = keep(with_fallback(strict, some, documents, sessions, index, **options))
        rows = ranked_sessions(found, F.broadcast(some.select("query_id", "a")), now, limit=limit, sort=sort, documents=documents, sessions=sessions)
        return rows if per_source else merge(rows, limit=limit, sort=sort)

    ranked = in_batches(q, documents, sessions, index, ranked_of, **options)
    return whole_results(for_each(ranked.join(q.select("query_id", "a"), "query_id"), ids), documents, sessions)


def first_results(queries: DataFrame, documents: DataFrame, sessions: DataFrame, index: Index, *, now: str, limit: int = 10, sorts: tuple[str, ...] = ("relevance", "ended"), scope: Column | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(sort, query_id, rank, session_ref): the first result that ``find`` gives each query by each of the sorts.

    What is found is scored once for all sorts, and no texts are joined to the results.  The first of all is the
    first of its source, by every sort, so the others are not ranked.
    """
    one, ids = distinct_queries(queries)
    q = keep(analyzed_queries(one))
    options = {"limit": limit, "scope": scope, "exclude": exclude}

    def ranked_of(some: DataFrame, strict: DataFrame, sort: str) -> DataFrame:
        found = keep(with_fallback(strict, some, documents, sessions, index, sort=sort, **options))
        rows = ranked_sessions(found, F.broadcast(some.select("query_id", "a")), now, limit=limit, sort=sort, documents=documents, sessions=sessions, first=1)
        return merge(rows, limit=1, sort=sort).select("query_id", "rank", "session_ref")

    return for_each(in_batches(q, documents, sessions, index, ranked_of, sort=sorts, **options), ids)


def find_summary(queries: DataFrame, results: DataFrame, sessions: DataFrame, scopes: DataFrame, records: DataFrame) -> DataFrame:
    """Per query: n_results, scanned_message_count, complete, freshness, next_action, and for none found diagnosis and suggestions.

    ``scopes`` (request_id, requested) are the selectors that were searched, one a source or
    more; ``records`` the coverage proofs.  All scopes must be proven for the whole to be.
    """
    counts = results.groupBy("query_id").agg(F.count("*").alias("n_results"))
    scanned = sessions.agg(F.coalesce(F.sum("message_count"), F.lit(0)).alias("scanned_message_count"))
    proven = coverage.stored_coverage(records, scopes)
    states = proven.agg(F.bool_and("complete").alias("complete"), F.collect_set("freshness").alias("states"), F.count("*").alias("n_scopes"))  # four states at most
    q = queries.select("query_id", "query").join(counts, "query_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    q = q.crossJoin(F.broadcast(scanned)).crossJoin(F.broadcast(states))  # one row each
    q = q.withColumn("freshness", coverage.merged_freshness(F.col("states")))
    none = F.col("n_results") == 0
    act = next_action(F.col("n_scopes") == 1, F.col("n_results"), F.col("freshness"))
    tips = F.when(none, refinement(F.col("query")))
    return q.select(
        "query_id", "n_results", "scanned_message_count", "complete", "freshness", act.alias("next_action"), F.when(none, diagnosis(F.col("freshness"))).alias("diagnosis"),
        tips["suggested_queries"].alias("suggested_queries"),
    )


def read_range(requests: DataFrame, messages: DataFrame, documents: DataFrame, sessions: DataFrame, index: Index, *, now: str, before: int = read.BEFORE, after: int = read.AFTER, limit: int = read.MAX_CHARS) -> DataFrame:
    """Messages round what answers each request (request_id, session_key, query, and seq if that is known).

    A request without an anchor comes as one row with its status and no message.  Texts over
    ``limit`` are cut to the part round the query.
    """
    asked = requests if "seq" in requests.columns else requests.withColumn("seq", F.lit(None).cast("long"))
    open_ = asked.where("seq is null and query <> ''").select(F.col("request_id").alias("query_id"), "session_key", "query")
    hits = find(open_, documents, sessions, index, now=now, limit=4, per_source=True)
    resolved = keep(read.resolve_anchors(asked, hits))
    anchors = resolved.where("anchor_seq is not null").select(F.col("request_id").alias("anchor_id"), "session_key", F.col("anchor_seq").alias("seq"), F.lit(before).alias("before"), F.lit(after).alias("after"), "query")
    near = read.neighbourhood(messages, anchors).withColumn("elision", read.elide(F.col("body_text"), F.col("query"), limit))
    near = near.select(F.col("anchor_id").alias("request_id"), "seq", "role", "timestamp", "elision")
    return resolved.select("request_id", "session_key", "anchor_seq", "status").join(near, "request_id", "left")
