"""Tokens, query analysis, phrases, relaxation: random texts against plain versions of the rules, and fixed cases."""

import random

import regex
from pyspark.sql import functions as F

from quarryline.functions import relax
from quarryline.functions import text as T

CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
#: A few of each class that the rules tell apart.
ALPHABET = ["q", "Z", "é", "Ä", "ß", "ж", "_", "\u0301", "4", "٧", "'", ".", ",", ":", ";", "·", "’", "-", "/", " ", "\n", "!", "森", "の", "ミ", "곰", "𠮟", "²", "😀"]


def ask(spark, value, use):
    return spark.createDataFrame([(value,)], "t string").select(use(F.col("t")).alias("r")).first()["r"]


def ask_all(spark, values, use):
    return [r["r"] for r in spark.createDataFrame(list(enumerate(values)), "k long, t string").coalesce(1).select("k", use(F.col("t")).alias("r")).orderBy("k").collect()]


def plain_tokens(text):
    """Tokens by a walk over the characters: runs of CJK in pairs; words with the marks that join letters or digits."""
    kind = lambda c: "cjk" if CJK.match(c) else "letter" if regex.match(r"[\p{L}\p{M}_]", c) else "digit" if regex.match(r"\p{Nd}", c) else ""
    out, i, text = [], 0, text or ""
    while i < len(text):
        if kind(text[i]) == "cjk":
            j = i
            while j < len(text) and kind(text[j]) == "cjk":
                j += 1
            out += [text[k : k + 2] for k in range(i, j - 1)]
            i = j
            continue
        j = i
        while j < len(text):
            here, before, after = kind(text[j]), text[j - 1] if j > i else "", text[j + 1] if j + 1 < len(text) else ""
            joins_letters = text[j] in "'.:’·" and regex.match(r"[\p{L}\p{M}]", before) and regex.match(r"\p{L}", after) and not CJK.match(after)
            joins_digits = text[j] in ".,;'" and regex.match(r"\p{Nd}", before) and regex.match(r"\p{Nd}", after)
            if here in ("letter", "digit") or joins_letters or joins_digits:
                j += 1
            else:
                break
        if regex.search(r"[\p{L}\p{Nd}]", text[i:j]):
            out.append(text[i:j].lower())
        i = max(j, i + 1)
    return out


def random_texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 24))) for _ in range(n)] + ["", None]


def test_tokens_of_random_texts(spark):
    texts = random_texts(1)
    got = ask_all(spark, texts, T.tokenize)
    assert got == [plain_tokens(t) for t in texts]
    assert sum(map(len, got)) > 1000


def test_query_terms_are_the_tokens_once(spark):
    texts = random_texts(2)
    assert ask_all(spark, texts, T.query_terms) == [list(dict.fromkeys(plain_tokens(t))) for t in texts]


def test_index_terms_are_the_tokens_cut_and_folded(spark):
    import unicodedata

    def fold(word):
        parts = [unicodedata.normalize("NFD", c) for c in word.lower()]
        return "".join(p[0] if len(p) == 2 and unicodedata.combining(p[1]) else unicodedata.normalize("NFC", p) for p in parts)

    texts = [t for t in random_texts(3) if t and "\u0301" not in t]
    want = [[fold(x) for x in regex.findall(r"[\p{L}\p{N}]+", " ".join(plain_tokens(t)))] for t in texts]
    assert ask_all(spark, texts, T.index_terms) == want


def test_analysis_of_random_queries(spark):
    texts = random_texts(4)
    for text, a in zip(texts, ask_all(spark, texts, T.analyze_query)):
        t = regex.sub(r"^\s+|\s+$", "", text or "")
        terms = list(dict.fromkeys(plain_tokens(t)))
        mode = "terms" if terms else "literal" if CJK.search(t) else "empty"
        several = bool(regex.search(r"\s", t))
        path = several and any(c in (text or "") for c in "\\/._:-")
        assert (a["normalized"], a["terms"], a["is_multi_term"], a["is_path_like"], a["mode"]) == (t.lower(), terms, several, path, mode), text


def test_escaped_patterns_match_only_themselves(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("xy%_\\", k=rng.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = df.crossJoin(df.withColumnRenamed("t", "u")).withColumn("p", T.escape_like(F.col("t"))).where(F.expr("u like p"))
    assert all(r["t"] == r["u"] for r in pairs.collect()) and pairs.count() >= 60


def test_quoted_terms_read_back(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices('kv" *', k=rng.randint(0, 6))) for _ in range(60)]
    for text, quoted in zip(texts, ask_all(spark, texts, T.quote_term)):
        assert quoted[0] == quoted[-1] == '"' and quoted[1:-1].replace('""', '"') == text and quoted.count('"') == 2 + 2 * text.count('"')


def test_long_words_do_not_overflow(spark):
    assert ask(spark, "a" * 200_000 + " b", T.tokenize) == ["a" * 200_000, "b"]


def test_cjk_predicates(spark):
    texts = [t or "" for t in random_texts(7)] + ["森の", "곰", ""]
    got = list(zip(ask_all(spark, texts, T.has_cjk), ask_all(spark, texts, T.is_cjk_token)))
    assert got == [(bool(CJK.search(t)), bool(t) and all(CJK.match(c) for c in t)) for t in texts]


def test_bounded_phrases_and_arguments(spark):
    has = lambda text, phrase: ask(spark, text, lambda c: T.has_bounded_phrase(c, F.lit(phrase)))
    assert has("then python tools/run.py build it", "python tools/run.py build")
    assert not has("ipython tools/run.py build", "python tools/run.py build")
    assert not has("python tools/run.py build-all", "python tools/run.py build")
    assert not has("abc", "")
    args = lambda text: ask(spark, text, lambda c: T.has_trailing_arguments(c, F.lit("do it")))
    assert args("do it a/b") and args("do it --flag") and args("do it -f") and not args("do it now\n-f") and not args("do it " + "x " * 60 + "a.b")


def test_shortest_ordered_span(spark):
    span = lambda tokens, terms: spark.range(1).select(T.shortest_ordered_span(F.array(*map(F.lit, tokens)), F.array(*map(F.lit, terms)))).first()[0]
    assert span("a x b c".split(), "a b c".split()) == 4
    assert span("a a b x c a b c".split(), "a b c".split()) == 3
    assert span("b a".split(), "a b".split()) is None


def test_relaxed_queries(spark):
    assert ask(spark, "重试 retry-policies", relax.relaxed_queries) == ["retry policies", "retry policy"]
    assert ask(spark, "where are the query_flows", relax.relaxed_queries) == ["query_flows", "query flows", "query flow", "query_flow"]
    assert ask(spark, "健康检查 token caches", relax.relaxed_queries) == ["token caches", "token cache"]
    assert ask(spark, "token caches", relax.relaxed_queries) == []
    assert ask(spark, "the entries of it", relax.relaxed_queries) == ["entries", "entry"]


def test_refinement(spark):
    r = ask(spark, "健康检查 deployment in prod", relax.refinement)
    assert r["over_constrained"] and r["suggested_queries"] == ["deployment", "prod", "健康检查"]
    assert ask(spark, "one", relax.refinement)["suggested_queries"] == []


def test_index_terms_of_plain_texts_equal_the_staged_ones(spark):
    texts = ["", None, "A b_c d.e_f 12,5 x1y2 it's", "Ünïcode — naïve ÉCOLE éa ǅ ẞ", "x² ½ Ⅷ a²b", "ΑΣ ΑΣ.Β ΣΑ", "İstanbul DİL", "汉字 and latin한글x", "٣٤ ab٣ 𝐀𝟘 ⓐb z", "a​b_́c ª º 'x' ..y", "Straße:Nr·3 5.6.7 __ ʼn"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.index_terms(F.col("t")).alias("got"), T.staged_terms(F.col("t")).alias("want")).collect():
        assert r["got"] == r["want"], r["t"]
