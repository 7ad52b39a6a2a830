"""Reading a session: pages, neighbourhoods of anchors, elision, snippets, evidence actions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarryline.functions.text import let, literal_pattern, query_terms

#: Defaults of reads, and sizes of snippets.
BEFORE, AFTER, PAGE, MAX_CHARS = 2, 2, 40, 800
CONTEXT_BEFORE, CONTEXT_AFTER, PLAIN = 40, 80, 160
MIDDLE, PREFIX, SUFFIX = "\n[... elided middle ...]\n", "[... elided prefix ...]\n", "\n[... elided suffix ...]"


def page(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages of each request (session_key, offset, limit), with total and has_more."""
    totals = messages.groupBy("session_key").agg(F.count("*").alias("total"))
    r = requests.join(totals, "session_key")
    on = (F.col("m.session_key") == F.col("r.session_key")) & (F.col("m.seq") >= F.col("r.offset")) & (F.col("m.seq") < F.col("r.offset") + F.col("r.limit"))
    more = F.col("r.offset") + F.least("r.limit", F.greatest(F.col("r.total") - F.col("r.offset"), F.lit(0))) < F.col("r.total")
    return r.alias("r").join(messages.alias("m"), on).select("m.*", "r.total", more.alias("has_more"))


def neighbourhood(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Messages from ``before`` before to ``after`` after each anchor (anchor_id, session_key, seq, before, after)."""
    low = F.greatest(F.col("a.seq") - F.col("a.before"), F.lit(0))
    on = (F.col("m.session_key") == F.col("a.session_key")) & F.col("m.seq").between(low, F.col("a.seq") + F.col("a.after"))
    return anchors.alias("a").join(messages.alias("m"), on).select("a.anchor_id", F.col("a.seq").alias("anchor_seq"), *(["a.query"] if "query" in anchors.columns else []), "m.*")


def resolve_anchors(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Requests (request_id, session_key, seq, query) with an anchor: the seq asked for, else the best message hit.

    ``hits`` are in-session results (query_id = request_id).  A session that matched only by its
    profile has no anchor, which is a status and never message 0.
    """
    top = hits.where("match_source = 'message'").groupBy(F.col("query_id").alias("request_id")).agg(F.min_by("match_seq", "rank").alias("hit_seq"))
    j = requests.join(top, "request_id", "left")
    seq = F.coalesce("seq", "hit_seq")
    status = F.when(seq.isNotNull(), "anchored").when(F.coalesce("query", F.lit("")) == "", "missing_anchor").otherwise("anchor_not_found")
    return j.withColumns({"anchor_seq": seq, "status": status})


def elide(text: Column, query: Column | None = None, limit: int = MAX_CHARS) -> Column:
    """Struct (text, original, omitted, strategy) of a text cut to ``limit`` characters; strategy is null if it fits.

    With a query that the text holds, the cut keeps the part round it and, if there is
    room, the start; otherwise head and tail stay.
    """
    if limit == 0:
        limit = 1 << 30

    def cut(v):
        t, n, at, size = v["t"], v["n"], v["at"], v["size"]
        sub = lambda a, b: F.substring(t, a + 1, b - a)
        head, tail = -(-limit // 2), limit // 2
        ends = F.concat(sub(F.lit(0), F.lit(head)), F.lit(MIDDLE), sub(n - tail, n))
        budget = F.greatest(F.lit(limit), size)
        stop = F.least(F.greatest(at - F.floor((budget - size) / 2).cast("int"), F.lit(0)) + budget, n)
        start = F.greatest(stop - budget, F.lit(0))
        lead = F.least(F.floor(budget / 4).cast("int"), start)
        suffix = F.when(stop < n, F.lit(SUFFIX)).otherwise("")
        window = F.concat(F.when(start > 0, F.lit(PREFIX)).otherwise(""), sub(start, stop), suffix)
        near = F.when(lead < 32, window).when(start <= lead, F.concat(sub(F.lit(0), stop), suffix)).otherwise(F.concat(sub(F.lit(0), lead), F.lit(MIDDLE), sub(start, stop)))
        shown = F.when(lead < 32, stop - start).when(start <= lead, stop).otherwise(lead + stop - start)
        around = at.isNotNull()
        long = n > limit
        return F.struct(
            F.when(~long, t).when(around, near).otherwise(ends).alias("text"), n.alias("original"), F.when(~long, 0).when(around, n - shown).otherwise(n - head - tail).alias("omitted"),
            F.when(long, F.when(around, "around_query").otherwise("head_tail")).alias("strategy"),
        )

    none = F.lit(None).cast("int")
    if query is None:
        place = F.struct(none.alias("at"), none.alias("size"))
    else:
        low = F.lower(text)
        terms = F.sort_array(F.transform(query_terms(query), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
        tries = F.concat(F.array(query), F.transform(terms, lambda s: s["x"]))
        found = F.filter(F.transform(tries, lambda x: F.struct((F.instr(low, F.lower(x)) - 1).alias("at"), F.length(x).alias("size"))), lambda s: s["at"] >= 0)
        place = F.when(F.coalesce(query, F.lit("")) != "", F.get(found, F.lit(0)))
    return let(F.struct(text.alias("t"), F.length(text).alias("n"), place["at"].alias("at"), F.coalesce(place["size"], F.lit(0)).alias("size")), cut)


def evidence_action(seq: Column, query: Column, source: Column, ref: Column) -> Column:
    """How to read the evidence behind a result, as a struct."""
    asked = F.when(query != "", query)
    page_ = seq.isNull() & asked.isNull()
    when = lambda v: F.when(~page_, F.lit(v).cast("int"))
    return F.struct(
        F.when(page_, "read-page").otherwise("read-range").alias("kind"), F.when(seq.isNull(), "session_level_match").otherwise("message_match").alias("reason"), source.alias("source_id"), ref.alias("session_ref"),
        seq.alias("seq"), asked.alias("query"), when(BEFORE).alias("before"), when(AFTER).alias("after"), F.when(page_, F.lit(0)).alias("offset"), F.when(page_, F.lit(PAGE)).alias("limit"),
    )


def with_evidence(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results with the action that reads their evidence, as struct ``evidence``."""
    r = results.join(queries.select("query_id", "query"), "query_id")
    action = evidence_action(F.col("match_seq"), F.col("query"), F.col("source_id"), F.col("session_ref"))
    return r.withColumn("evidence", action).drop("query")


def _units(s: str) -> list[str]:
    """UTF-16 units of a text, so that offsets count as the index's clients count them."""
    data = s.encode("utf-16-le", "surrogatepass")
    return [data[i : i + 2].decode("utf-16-le", "surrogatepass") for i in range(0, len(data), 2)]


def _joined(units: str) -> str:
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def mark_terms(text: str, needles: list[str]) -> str:
    """Longest needles first, no overlaps, case ignored."""
    low, hits = text.lower(), []
    for needle in dict.fromkeys(n for n in needles if n):
        at = low.find(needle)
        while at >= 0:
            hits.append((at, -len(needle)))
            at = low.find(needle, at + len(needle))
    out, done = [], 0
    for at, size in sorted(hits):
        if at >= done:
            out += [text[done:at], "<mark>", text[at : at - size], "</mark>"]
            done = at - size
    return "".join(out) + text[done:]


def snippet_of(text: str, query: str, terms: list[str]) -> str:
    """A window of the text round the query, else round the place that holds most of its terms."""
    text, query, terms = ("".join(_units(x)) for x in (text, query, "\x00".join(terms)))
    terms = [t for t in dict.fromkeys(terms.lower().split("\x00")) if t]
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: offsets must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    needle = query.lower()
    at = low.find(needle) if needle else -1
    if at >= 0:
        spans, needles = (max(at - CONTEXT_BEFORE, 0), min(at + len(needle) + CONTEXT_AFTER, len(text))), [needle]
    else:
        best, spans, needles = None, None, terms
        for term in terms:
            at = low.find(term)
            while at >= 0:
                a, b = max(at - CONTEXT_BEFORE, 0), min(at + len(term) + CONTEXT_AFTER, len(text))
                counts = [(low[a:b].count(t), len(t)) for t in terms]
                value = (1000 * sum(n > 0 for n, _ in counts) + 10 * sum(n * size for n, size in counts) + sum(n for n, _ in counts), -at)
                if best is None or value > best:
                    best, spans = value, (a, b)
                at = low.find(term, at + len(term))
        if spans is None:
            return _joined(text[:PLAIN])
    a, b = spans
    return _joined(("…" if a > 0 else "") + mark_terms(text[a:b], needles) + ("…" if b < len(text) else ""))


def _snippets(texts: pa.Array, queries: pa.Array, terms: pa.Array) -> pa.Array:
    return pa.array([snippet_of(t or "", q or "", k or []) for t, q, k in zip(texts.to_pylist(), queries.to_pylist(), terms.to_pylist())], pa.string())


def snippet(text: Column, query: Column, terms: Column) -> Column:
    """Snippets of results, after the limits; never of all candidates."""
    return F.arrow_udf(_snippets, StringType())(text, query, terms)


def literal_snippet(text: Column, needle: Column) -> Column:
    """Window round the first place of a literal needle, marked, with native expressions."""

    def cut(v):
        t, n, at, size = v["t"], v["n"], v["at"], v["size"]
        a, b = F.greatest(at - CONTEXT_BEFORE, F.lit(0)), F.least(at + size + CONTEXT_AFTER, n)
        window = F.substring(t, a + 1, b - a)
        marked = F.regexp_replace(window, F.concat(F.lit("(?iu)("), literal_pattern(v["needle"]), F.lit(")")), F.lit("<mark>$1</mark>"))
        return F.when(at < 0, F.substring(t, 1, PLAIN)).otherwise(F.concat(F.when(a > 0, "…").otherwise(""), marked, F.when(b < n, "…").otherwise("")))

    return let(F.struct(text.alias("t"), F.length(text).alias("n"), (F.instr(F.lower(text), F.lower(needle)) - 1).alias("at"), F.length(needle).alias("size"), needle.alias("needle")), cut)


def rank_messages(messages: DataFrame) -> DataFrame:
    """First and latest message per role of each session."""
    w = Window.partitionBy("session_key", "role")
    return messages.withColumns({"first": F.col("seq") == F.min("seq").over(w), "latest": F.col("seq") == F.max("seq").over(w)}).where("first or latest")
