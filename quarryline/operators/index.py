"""The inverted index as tables: postings, document lengths and corpus statistics.

Terms are second-stage terms of five weighted fields.  Postings hold a term's
positions per document and field; phrases are adjacent positions in one field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import CJK, has_cjk, index_terms, let
from quarryline.storage import keep, shared_path

#: Field weights of the relevance score, and its two parameters.
WEIGHTS = {"body_text": 1.0, "title_text": 8.0, "summary_text": 3.0, "compact_text": 4.0, "reasoning_text": 1.2}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, field, positions), doc_stats(doc_id, dl), corpus(n, avgdl; one row), chars(char, doc_id).

    ``chars`` are the CJK characters of each document, for queries that have no terms;
    without it, these read all texts.
    """

    postings: DataFrame
    doc_stats: DataFrame
    corpus: DataFrame
    chars: DataFrame | None = None

    def write(self, path: str) -> None:
        """Files are sorted by term, so a lookup skips most row groups; a frequent term spans files."""
        self.postings.sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings", compression="zstd")
        if self.chars is not None:
            self.chars.sortWithinPartitions("char", "doc_id").write.parquet(f"{path}/chars", compression="zstd")
        self.doc_stats.write.parquet(f"{path}/doc_stats", compression="zstd")
        self.corpus.write.parquet(f"{path}/corpus", compression="zstd")

    def saved(self) -> Index:
        """The index written once to the shared folder, as every batch of queries should use it."""
        path = shared_path(self.postings.sparkSession)
        self.write(path)
        return Index.read(self.postings.sparkSession, path, chars=self.chars is not None)

    @staticmethod
    def read(spark, path: str, *, chars: bool = True) -> Index:
        tables = ("postings", "doc_stats", "corpus", *(["chars"] if chars else []))
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in tables))


def analyzed(documents: DataFrame) -> DataFrame:
    """(doc_id, fields, chars): the terms of each field, in the order of the weights, and the CJK characters of all."""
    whole = F.concat_ws("", *(F.col(f) for f in WEIGHTS))
    found = F.array_distinct(F.regexp_extract_all(whole, F.lit(f"([{CJK}])"), F.lit(1)))
    chars = F.when(has_cjk(whole), found).otherwise(F.array().cast("array<string>"))
    return documents.select("doc_id", F.array(*(index_terms(F.col(f)) for f in WEIGHTS)).alias("fields"), chars.alias("chars"))


def term_positions(terms: Column) -> Column:
    """Array of (term, positions) of a field's terms, by term."""

    def grouped(s):
        starts = F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (x["t"] != F.get(s, k - 1)["t"]), k)), lambda k: k.isNotNull())

        def cut(b):
            part = lambda at, j: F.slice(s, at + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - at)
            return F.transform(b, lambda at, j: F.struct(F.get(s, at)["t"].alias("term"), F.transform(part(at, j), lambda x: x["i"]).alias("positions")))

        return let(starts, cut)

    return let(F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), grouped)


def build_index(documents: DataFrame) -> Index:
    """All documents, of all sources, are one corpus.

    Texts are analysed once; the tables follow from the terms.  A document's postings are
    grouped within its row, so nothing is shuffled but the corpus statistics.
    """
    a = keep(analyzed(documents))
    placed = a.select("doc_id", F.posexplode("fields").alias("field", "terms")).where(F.size("terms") > 0)
    postings = placed.select("doc_id", "field", F.inline(term_positions(F.col("terms")))).select("term", "doc_id", "field", "positions")
    # A document without terms counts too.
    doc_stats = a.select("doc_id", F.aggregate("fields", F.lit(0).cast("long"), lambda n, t: n + F.size(t)).alias("dl"))
    corpus = doc_stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, doc_stats, corpus, a.select(F.explode("chars").alias("char"), "doc_id"))


def term_stats(index: Index) -> DataFrame:
    """(term, df): documents that hold the term in any field."""
    return index.postings.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))


def _translate_sql(expr: str) -> str:
    from quarryline.functions.text import FOLD_FROM, FOLD_TO

    return f"translate({expr}, '{FOLD_FROM}', '{FOLD_TO}')"


#: First-stage tokens in SQL; right for texts without CJK.
SQL_WORD = r"(?:\p{L}\p{M}*(?:[''.:’·]\p{L}\p{M}*)*|\p{Nd}(?:[.,;'']\p{Nd})*|[\p{M}_])+"


def tokens_sql(expr: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({expr}, '{SQL_WORD}'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nd}}]')), lambda x: lower(x))"


def index_terms_sql(expr: str) -> str:
    return f"list_transform(regexp_extract_all(array_to_string({tokens_sql(expr)}, ' '), '[\\p{{L}}\\p{{N}}]+'), lambda x: {_translate_sql('lower(x)')})"


def index_sql(documents: str, prefix: str) -> str:
    """Common tables {prefix}_post (term, doc_id, field, pos; a row a place), _dl and _corpus."""
    fields = ", ".join(f"{{'field': {i}, 'terms': {index_terms_sql(f)}}}" for i, f in enumerate(WEIGHTS))
    return f"""
{prefix}_an AS (SELECT doc_id, f.field AS field, f.terms AS terms FROM (SELECT doc_id, unnest([{fields}]) AS f FROM {documents})),
{prefix}_post AS (SELECT doc_id, field, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM {prefix}_an WHERE len(terms) > 0),
{prefix}_dl AS (SELECT doc_id, sum(len(terms))::BIGINT AS dl FROM {prefix}_an GROUP BY 1),
{prefix}_corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {prefix}_dl)
"""
