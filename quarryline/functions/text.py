"""Text analysis as native expressions: tokens, query analysis, phrase tests, UTF-16 sizes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
_L = rf"[\p{{L}}&&[^{CJK}]]"
#: A word: letters, marks and underscores, digit runs, and the punctuation that joins letters or digits.
WORD = rf"(?:[_\p{{M}}\p{{L}}&&[^{CJK}]]++|\p{{Nd}}++|(?<=[\p{{L}}\p{{M}}&&[^{CJK}]])['.:’·](?={_L})|(?<=\p{{Nd}})[.,;'](?=\p{{Nd}}))++"
PIECE = rf"([{CJK}]{{2,}}+|{WORD})"
#: Index terms are runs of letters and numbers.
TERM = r"[\p{L}\p{N}\p{Co}]+"
#: What makes an index term depend on the token it stands in.
UNPLAIN = rf"[{CJK}\p{{No}}\p{{Nl}}\p{{Co}}\u03A3\u0130]"

#: English words that carry no meaning of their own in a query.
STOP_WORDS = (
    "a an and any are as at be been by can did do does for from had has have how i in is it last latest of on or recent "
    "recently that the this to was we week were what when where whether which who why"
).split()


def _fold_table() -> tuple[str, str]:
    """Lower-case letters with one combining mark, and the letters without it."""
    marked, plain = [], []
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and unicodedata.combining(parts[1]) and c == c.lower() and parts[0].isalpha():
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


FOLD_FROM, FOLD_TO = _fold_table()


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokenize(text: Column) -> Column:
    """First-stage tokens: overlapping pairs of a CJK run (single characters drop), other words in lower case."""
    pieces = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(1)), lambda x: x.rlike(r"[\p{L}\p{Nd}]"))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.flatten(F.transform(pieces, lambda x: F.when(x.rlike(rf"^[{CJK}]{{2,}}$"), pairs(x)).otherwise(F.array(F.lower(x)))))


def tokenized_text(text: Column) -> Column:
    """The tokens as the index gets them."""
    return F.array_join(tokenize(text), " ")


def fold(token: Column) -> Column:
    """Lower case without single marks, as the index compares terms."""
    low = F.lower(token)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, FOLD_FROM, FOLD_TO)).otherwise(low)


def staged_terms(text: Column) -> Column:
    """Second-stage terms of any text, by way of its tokens."""
    return F.transform(F.regexp_extract_all(tokenized_text(text), F.lit(TERM), F.lit(0)), fold)


def index_terms(text: Column) -> Column:
    """Second-stage terms of an analysed text, in order.

    Without CJK, numbers other than digits, and the two letters whose lower case
    depends on what is around or has a mark, tokens cut no run of letters and
    digits, so the runs are found in the whole text at once.
    """
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    plain = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    marked = F.regexp_extract_all(F.translate(low, FOLD_FROM, FOLD_TO), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.when(~t.rlike(r"[^\x00-\x7F]"), plain).when(~t.rlike(UNPLAIN), marked).otherwise(staged_terms(t))


def phrase_of(token: Column) -> Column:
    """Second-stage terms of one query token; more than one is a phrase."""
    return F.transform(F.regexp_extract_all(token, F.lit(TERM), F.lit(0)), fold)


def query_terms(text: Column) -> Column:
    """Distinct tokens in order of their first place."""
    return F.array_distinct(tokenize(text))


def has_cjk(text: Column) -> Column:
    return text.rlike(rf"[{CJK}]")


def is_cjk_token(text: Column) -> Column:
    return text.rlike(rf"^[{CJK}]+$")


def analyze_query(query: Column) -> Column:
    """Struct of normalized, terms, is_multi_term, is_path_like, mode (empty, terms, literal) and needle."""

    def shape(v):
        t, terms = v["t"], v["terms"]
        multi = t.rlike(r"(?U)\s")
        mode = F.when(t == "", "empty").when(F.size(terms) > 0, "terms").when(has_cjk(t), "literal").otherwise("empty")
        return F.struct(F.lower(t).alias("normalized"), terms.alias("terms"), multi.alias("is_multi_term"), (multi & v["q"].rlike(r"[\\/._:-]")).alias("is_path_like"), mode.alias("mode"), F.when(mode == "literal", t).alias("needle"))

    q = F.coalesce(query, F.lit(""))
    return let(F.struct(q.alias("q"), strip(q).alias("t"), query_terms(strip(q)).alias("terms")), shape)


def quote_term(term: Column) -> Column:
    """A term as a quoted match expression."""
    return F.concat(F.lit('"'), F.replace(term, F.lit('"'), F.lit('""')), F.lit('"'))


def match_expression(terms: Column) -> Column:
    """Terms joined to the conjunction that an embedded index would be asked."""
    return F.array_join(F.transform(terms, quote_term), " AND ")


def escape_like(text: Column) -> Column:
    """Wildcards of LIKE escaped with a backslash."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def literal_pattern(phrase: Column) -> Column:
    """A regular expression that matches the phrase itself."""
    return F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


_INNER = r"[\p{IsAlphabetic}\p{N}_./-]"


def bounded_pattern(phrase: Column) -> Column:
    return F.concat(F.lit(rf"(?<!{_INNER})"), literal_pattern(phrase), F.lit(rf"(?!{_INNER})"))


def has_bounded_phrase(text: Column, phrase: Column) -> Column:
    """The phrase stands in the text, next to nothing that would continue a word or a path."""
    return (phrase != "") & F.regexp_like(text, bounded_pattern(phrase))


def has_trailing_arguments(text: Column, phrase: Column) -> Column:
    """After a bounded phrase, the rest of its line (80 units) has a path, a file or a flag."""
    args = r"(?:(?=[^\n]{0,79}[./])|(?=[^\n]{0,77}[^\S\n]-[A-Za-z0-9])|(?=[^\n]{0,76}[^\S\n]--[A-Za-z0-9]))"
    return (phrase != "") & F.regexp_like(text, F.concat(bounded_pattern(phrase), F.lit(args)))


def shortest_ordered_span(tokens: Column, terms: Column) -> Column:
    """Tokens from a first term to the last one, taking the next of each in turn; the least such number, or null."""

    def spans(v):
        places = F.transform(v["terms"], lambda t: F.filter(F.transform(v["tokens"], lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()))

        def walk(p):
            def end(start):
                rest = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
                return F.aggregate(rest, start, lambda at, later: F.array_min(F.filter(later, lambda x: x > at)))

            return F.array_min(F.transform(F.get(p, F.lit(0)), lambda s: end(s) - s + 1))

        return let(places, walk)

    return let(F.struct(tokens.alias("tokens"), terms.alias("terms")), spans)


def term_hits(text: Column, terms: Column) -> Column:
    """How many of the terms the text contains."""
    return F.size(F.filter(terms, lambda t: text.contains(t)))


def utf16_length(text: Column) -> Column:
    return F.expr("0") + F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def display_text(text: Column, limit: int) -> Column:
    """One line for people: no marks, blanks collapsed, cut with an ellipsis."""
    t = squeeze(F.regexp_replace(text, "</?mark>", ""))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, max(limit - 1, 0)), F.lit("…"))).otherwise(t)
