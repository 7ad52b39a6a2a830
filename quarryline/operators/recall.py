"""Candidates of many queries at once: scope, match, score, bounded order.

A query's terms are ANDed: every term must occur in a document, in any fields.  A
term of several second-stage terms is a phrase within one field.  Scores are
BM25 over weighted fields, negated, so lower is better; N, document frequencies
and lengths are those of the whole index, not of the scope.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import CJK, analyze_query, phrase_of
from quarryline.operators.index import K1, WEIGHTS, B, Index
from quarryline.storage import keep, passing

TEXT_FIELDS = list(WEIGHTS)
#: Pairs of a query and a document of its rarest term that are looked at in one batch, if the index has not more postings of query terms.
LEAST_PAIRS = 1 << 20
#: Terms of the queries of one batch, which are sent to the tasks.
MOST_SENT = 1 << 16
SESSION_COLUMNS = ["title", "cwd", "started_at", "ended_at", "session_uuid", "native_session_id", "path_date", "file_path", "message_count"]


def budget(limit: int, sort: str = "relevance") -> int:
    """Candidates kept per query and source."""
    return max(12 * limit, 50) if sort == "relevance" else max(4 * limit, 50)


def analyzed_queries(queries: DataFrame) -> DataFrame:
    """Adds the analysis of column query as struct a."""
    return queries.withColumn("a", analyze_query(F.col("query")))


def term_documents(terms: DataFrame, index: Index) -> DataFrame:
    """(doc_id, held): a map of each document's query terms, by their numbers, to their weighted frequencies.

    ``terms`` are distinct (token, no); each is looked up once however many queries share it.
    """
    parts = terms.withColumn("phrase", phrase_of(F.col("token")))
    parts = parts.select("no", F.size("phrase").alias("k"), F.posexplode("phrase").alias("at", "term"))
    found = parts.join(index.postings, "term")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS.values())), F.col("field") + 1)
    single = found.where("k = 1").select("no", "doc_id", "field", F.size("positions").alias("count"))
    # A phrase starts where each of its terms, moved back by its place in the phrase, stands.
    moved = found.where("k > 1").select("no", "k", "at", "doc_id", "field", F.transform("positions", lambda p: p - F.col("at")).alias("starts"))
    multi = moved.groupBy("no", "doc_id", "field").agg(F.first("k").alias("k"), F.collect_list("starts").alias("all"))
    both = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    multi = multi.where("size(all) = k").select("no", "doc_id", "field", F.size(both).alias("count")).where("count > 0")
    # A document's terms are gathered where they lie and dealt by documents once; its fields are summed there.
    dealt = single.unionByName(multi).groupBy("doc_id").agg(F.collect_list(F.struct("no", (F.col("count") * weight).alias("f"))).alias("all"))
    summed = dealt.select("doc_id", F.inline("all")).groupBy("doc_id", "no").agg(F.sum("f").alias("f"))
    return summed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("no", "f"))).alias("held"))


def distinct_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that ask the same, once, under one of their ids; and (query_id, one): the id of each query's like.

    The same are those of equal query and, where there are such columns, session_key and source_id.
    """
    asks = ["query", *(c for c in ("session_key", "source_id") if c in queries.columns)]
    q = keep(queries.select("query_id", *asks))
    one = q.groupBy(*asks).agg(F.min("query_id").alias("one"))
    same = reduce(Column.__and__, (F.col(f"q.{c}").eqNullSafe(F.col(f"o.{c}")) for c in asks))
    return one.withColumnRenamed("one", "query_id"), q.alias("q").join(one.alias("o"), same).select("q.query_id", "o.one")


def for_each(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of distinct queries for every query that asks the same."""
    return rows.withColumnRenamed("query_id", "one").join(ids, "one").select(*rows.columns)


@dataclass(frozen=True)
class Lookup:
    """What the index says of the terms of many queries, each looked up once for all of them.

    asked (query_id, own, parts, no, df): a query's terms, as numbers, with their document frequencies
    and the rarest of them; held: a document's terms and their frequencies, its length and what is
    said of its place, null where that does not count; owned: may queries have a session of their own?
    """

    asked: DataFrame
    held: DataFrame
    owned: bool

    @property
    def td(self) -> DataFrame:
        """(no, f, doc_id) of all terms and the documents that hold them."""
        return self.held.select(F.explode("held").alias("no", "f"), "doc_id")


def looked_up(queries: DataFrame, index: Index, places: DataFrame | None = None) -> Lookup:
    """The terms of analysed queries, and the documents of ``places`` that count if given; see ``scored``."""
    own = places is not None and "session_key" in queries.columns
    session = F.col("session_key") if own else F.lit(None).cast("string")
    terms = queries.where("a.mode = 'terms'").select("query_id", session.alias("own"), F.size("a.terms").alias("n_terms"), F.explode("a.terms").alias("token"))
    # Numbers stand for terms in what is shuffled; they are fixed once written.
    words = keep(terms.select("token").distinct().withColumn("no", F.monotonically_increasing_id()))
    held = term_documents(words, index).join(index.doc_stats, "doc_id")
    lookup = Lookup(terms, keep(held if places is None else held.join(places, "doc_id", "left")), own)
    df = lookup.td.groupBy("no").agg(F.count("*").alias("df"))
    # A query's own terms, the rarest first.
    parts = F.sort_array(F.collect_list(F.struct("df", "token", "no")))
    asked = terms.join(words.join(df, "no"), "token").groupBy("query_id", "own", "n_terms").agg(parts.alias("parts")).where("size(parts) = n_terms")
    rarest = F.col("parts")[0]
    asked = asked.select("query_id", "own", F.transform("parts", lambda p: F.struct(p["df"].alias("df"), p["no"].alias("no"))).alias("parts"), rarest["no"].alias("no"), rarest["df"].alias("df"))
    return replace(lookup, asked=keep(asked))


def batches_of(lookup: Lookup) -> int:
    """Batches in which no more pairs than the terms have postings are looked at, so that these pairs' room goes with the index."""
    pairs = lookup.asked.where("own is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-pairs // max(LEAST_PAIRS, lookup.td.count())))


def sendings_of(queries: DataFrame) -> int:
    """Batches in which the queries have some ``MOST_SENT`` terms at most, so that a batch of them can be sent to the tasks."""
    size = queries.agg(F.coalesce(F.sum(F.size("a.terms") + 1), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-size // MOST_SENT))


def scored(asked: DataFrame, lookup: Lookup, index: Index, places: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, fts_score) of all documents that hold all terms of a query, for a batch of those asked.

    The batch goes to the documents: of a document's terms, each meets the queries whose rarest
    it is, and the document's other terms are at hand there.  So a frequent word costs no more than
    the rare one it stands beside, and only what is found is shuffled.
    With ``places`` (doc_id, session_key and more), as the lookup has them, only these documents
    count, come with what is said of them, and a query with a session of its own looks at that only.
    """
    said = [] if places is None else [c for c in places.columns if c != "doc_id"]
    there = lookup.held if places is None else lookup.held.where("session_key is not null")
    there = there.select("*", F.explode(F.map_keys("held")).alias("no"))
    # The two rarest terms are tried and scored without a lambda, which costs a pair more than all else; few queries have more.
    parts = F.col("parts")
    asked = asked.withColumns({"other": F.get(parts, F.lit(1)), "more": F.when(F.size(parts) > 2, F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))})
    asked = asked.crossJoin(F.broadcast(index.corpus))  # one row

    def gain(p):
        raw = F.log((F.col("n") - p["df"] + 0.5) / (p["df"] + 0.5))
        f = F.element_at("held", p["no"])
        return F.when(raw > 0, raw).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    def met(some: DataFrame, on: list[str]) -> DataFrame:
        pairs = there.join(F.broadcast(some.select(*on, "query_id", "df", "other", "more", "n", "avgdl")), on)
        pairs = pairs.where(F.col("other").isNull() | F.array_contains(F.map_keys("held"), F.col("other.no")))
        rare = gain(F.struct(F.col("df"), F.col("no"))) + F.coalesce(gain(F.col("other")), F.lit(0.0))
        few, many = pairs.where("more is null"), pairs.where("more is not null").where(F.forall("more", lambda p: F.map_contains_key("held", p["no"])))
        rows = [(few, rare), (many, F.aggregate("more", rare, lambda sum_, p: sum_ + gain(p)))]
        return reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", (-score).alias("fts_score"), *said) for x, score in rows])

    found = met(asked.where("own is null"), ["no"])
    if lookup.owned:
        found = found.unionByName(met(asked.where("own is not null").withColumn("session_key", F.col("own")), ["no", "session_key"]))
    return found


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def literal_matches(queries: DataFrame, documents: DataFrame, chars: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, fts_score 0) for queries of lone CJK characters, which have no terms.

    With ``chars`` (char, doc_id) the documents that hold all of a needle's characters are
    looked up, and texts are read only of those where the needle is more than one character.
    Without it all texts are read; the queries are a stated set and are few, so they go to the
    tasks.  Case is ignored for A-Z only.
    """
    needles = queries.where("a.mode = 'literal'").select("query_id", F.translate("a.needle", UPPER, LOWER).alias("needle"))
    texts = [F.translate(F.col(c), UPPER, LOWER) for c in TEXT_FIELDS]
    zero = F.lit(0.0).alias("fts_score")
    if chars is not None:
        parts = F.array_distinct(F.regexp_extract_all("needle", F.lit(f"([{CJK}])"), F.lit(1)))
        wanted = needles.select("query_id", "needle", F.size(parts).alias("n"), F.explode(parts).alias("char"))
        held = wanted.join(chars, "char").groupBy("query_id", "doc_id").agg(F.first("needle").alias("needle"), F.first("n").alias("n"), F.count("*").alias("got")).where("got = n")
        sure = held.where(F.length("needle") == 1).select("query_id", "doc_id", zero)
        unsure = held.where(F.length("needle") > 1).join(documents.select("doc_id", F.array(*texts).alias("texts")), "doc_id")
        return sure.unionByName(unsure.where(F.exists("texts", lambda t: t.contains(F.col("needle")))).select("query_id", "doc_id", zero))
    # Without such queries no row is left, and Spark drops the scan of the texts.
    gathered = needles.agg(F.collect_list(F.struct("query_id", "needle")).alias("needles")).where(F.size("needles") > 0)
    whole = documents.select("doc_id", F.array(*texts).alias("texts")).crossJoin(F.broadcast(gathered))  # one row
    hit = F.filter("needles", lambda n: F.exists("texts", lambda t: t.contains(n["needle"])))
    return whole.select("doc_id", F.explode(hit).alias("q")).select("q.query_id", "doc_id", zero)


def candidate_keys(queries: DataFrame, documents: DataFrame, sessions: DataFrame, index: Index, **options) -> DataFrame:
    """Scoped candidates (query_id, source_id, session_key, doc_id, fts_score, cand_pos), at most a budget per query and source.

    ``queries`` holds query_id and query, and may hold session_key (search one session) and
    source_id; those that ask the same are searched once.  Options are those of ``in_batches``.
    """
    one, ids = distinct_queries(queries)
    ids = keep(ids)
    return in_batches(keep(analyzed_queries(one)), documents, sessions, index, lambda q, found: for_each(found, ids), **options)


def candidates(queries: DataFrame, documents: DataFrame, sessions: DataFrame, index: Index, *, texts: bool = True, **options) -> DataFrame:
    """``candidate_keys`` with the columns of their documents and sessions."""
    rows = candidate_keys(queries, documents, sessions, index, **options).select("query_id", "doc_id", "fts_score", "cand_pos")
    return rows.join((documents if texts else documents.drop(*TEXT_FIELDS)).join(session_columns(sessions), "session_key"), "doc_id")


def session_columns(sessions: DataFrame) -> DataFrame:
    """What candidates and results say of their sessions."""
    return sessions.select("session_key", F.col("summary_text").alias("session_summary"), *SESSION_COLUMNS)


def in_batches(queries: DataFrame, documents: DataFrame, sessions: DataFrame, index: Index, of: Callable[..., DataFrame], *, scope: Column | None = None, exclude: DataFrame | None = None, limit: int = 10, sort: str | tuple[str, ...] = "relevance") -> DataFrame:
    """What ``of`` makes of analysed queries, no two of which ask the same, and of the keys of their candidates (with the time if that orders them).

    Terms are looked up once for all queries.  These then go by batches, each of which is written
    before the next one starts, so that what is shuffled at a time goes with the index, not
    with the pairs of all queries and documents.  With several sorts, what a batch finds is scored once
    for all of them; ``of`` is also told the sort, which its rows get as a column.

    ``scope`` is a predicate on session columns and on those of documents that are
    no texts, ``exclude`` has (source_id or null, ref) rows.  Both apply to the documents before
    any query meets them; a candidate carries only what orders it.
    """
    there = documents.drop(*TEXT_FIELDS).join(session_columns(sessions), "session_key")
    there = there if scope is None else there.where(scope)
    if exclude is not None:
        there = excluded(there, exclude)
    sorts = (sort,) if isinstance(sort, str) else sort
    times = {s: {"ended": "ended_at", "started": "started_at"}.get(s) for s in sorts}
    stamps = sorted({t or "ended_at" for t in times.values()})
    places = there.select("doc_id", "session_key", "source_id", "seq", *stamps)

    def best(rows: DataFrame, by: str) -> DataFrame:
        time = times[by]
        order = [F.desc(time), F.asc("fts_score")] if time else [F.asc("fts_score"), F.desc("ended_at"), F.coalesce("seq", F.lit(-1))]
        w = Window.partitionBy("query_id", "source_id").orderBy(*order, "doc_id")
        first = rows.withColumn("cand_pos", F.row_number().over(w)).where(F.col("cand_pos") <= budget(limit, by))
        return first.select("query_id", "source_id", "session_key", "doc_id", "fts_score", "cand_pos", *([time] if time else []))

    with passing(queries.sparkSession) as stay:
        lookup = looked_up(queries, index, places)
        literal = keep(literal_matches(queries, documents, index.chars).join(places, "doc_id"))
        done, n = [], max(batches_of(lookup), sendings_of(queries))
        for i in range(n):
            mine = F.lit(True) if n == 1 else F.pmod(F.xxhash64("query_id"), F.lit(n)) == i
            with passing(queries.sparkSession):
                q = queries.where(mine)
                rows = scored(lookup.asked.where(mine), lookup, index, places).unionByName(literal.where(mine))
                for column in ("session_key", "source_id"):
                    if column in q.columns:
                        own = q.select("query_id", F.col(column).alias("own"))
                        rows = rows.join(own, "query_id").where(F.col("own").isNull() | (F.col("own") == F.col(column))).drop("own")
                if isinstance(sort, str):
                    done.append(stay(of(q, best(rows, sort))))
                    continue
                rows = keep(rows)
                done += [stay(of(q, best(rows, by), by).withColumn("sort", F.lit(by))) for by in sorts]
    return reduce(DataFrame.unionByName, done)


def exclusions(values: DataFrame) -> DataFrame:
    """Column value to (only_source, ref): "source:id" is for that source, other values for any."""
    v = values.select(F.trim("value").alias("v")).where("v <> ''").distinct()
    named = v.withColumn("s", F.regexp_extract("v", r"^(codex|claude-code|pi|dsh):(.+)$", 1))
    return named.select(F.when(F.col("s") != "", F.col("s")).alias("only_source"), F.when(F.col("s") != "", F.expr("substring(v, length(s) + 2)")).otherwise(F.col("v")).alias("ref")).distinct()


def excluded(rows: DataFrame, exclude: DataFrame) -> DataFrame:
    """Rows of no excluded session; a reference is a session's uuid or its native id."""
    gone = exclude.withColumnRenamed("only_source", "x_source").withColumnRenamed("ref", "x_ref")
    any_source = F.col("x_source").isNull() | (F.col("x_source") == F.col("source_id"))
    out = rows
    for ref in ("native_session_id", "session_uuid"):
        out = out.join(gone, (F.col(ref) == F.col("x_ref")) & any_source, "left_anti")
    return out
