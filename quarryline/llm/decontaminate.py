"""Benchmark decontamination by exact word n-grams.

Benchmark items become a hash set of normalised word windows that every task
holds; documents are scanned once, window by window.  The set is only sent to
the tasks if its own size in memory, which is worked out from the items' words
first, is under ``broadcast_bytes``, a small part of a worker.  A larger benchmark takes
the other way: windows of the distinct texts and of the items meet in a join on
the window itself.  Both give the same.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructField, StructType

from quarryline.llm.common import PLAIN_WORD, ascii_lower

#: Most bytes of memory that a window, a word and an item take in a ``WindowSet``.
WINDOW_BYTES, WORD_BYTES, ITEM_BYTES = 420, 220, 400

#: A-Z to a-z; other ASCII but 0-9 and a-z to a blank; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class WindowSet:
    """Windows of the items as tuples of word numbers, by length."""

    def __init__(self, items: list[tuple], size: int):
        self.number: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], tuple]] = defaultdict(dict)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in plain_words(text)]
            n, own = min(size, len(ids)), (item,)
            known = self.windows[n] if n else {}
            for i in range(len(ids) - n + 1 if n else 0):
                window = tuple(ids[i : i + n])
                held = known.setdefault(window, own)
                if item not in held:
                    known[window] = (*held, item)
        self.windows = dict(self.windows)

    def scan(self, data: bytes) -> tuple[int, list[int], list[int], list]:
        """Words of a text, the maximal runs of hit words (end exclusive), and the items found."""
        words = plain_words(data)
        get = self.number.get
        ids = [get(w, 0) for w in words]
        runs, start = [], None  # runs of words that any item has
        for i, x in enumerate(ids):
            if x:
                if start is None:
                    start = i
            elif start is not None:
                runs.append((start, i))
                start = None
        if start is not None:
            runs.append((start, len(ids)))
        found: set = set()
        spans = []
        for n, known in self.windows.items():
            for a, b in runs:
                for i in range(a, b - n + 1):
                    if (items := known.get(tuple(ids[i : i + n]))) is not None:
                        found.update(items)
                        spans.append((i, i + n))
        starts, ends = [], []
        for a, b in sorted(spans):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        return len(words), starts, ends, sorted(found)


def _hits(item: DataType) -> StructType:
    ints = ArrayType(IntegerType())
    kinds = {"n_words": LongType(), "hit_starts": ints, "hit_ends": ints, "items": ArrayType(item)}
    return StructType([StructField(n, k) for n, k in kinds.items()])


def _scan_udf(windows: WindowSet, item: DataType):
    names = _hits(item).names

    def scan(texts: pa.Array) -> pa.Array:
        rows = (windows.scan(x.as_py() or b"") for x in texts.cast(pa.large_binary()))
        return pa.array([dict(zip(names, r)) for r in rows], to_arrow_type(_hits(item)))

    return F.arrow_udf(scan, _hits(item))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(PLAIN_WORD), F.lit(0))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    broadcast_bytes: int = 48 << 20,
    out: str = "hits",
) -> DataFrame:
    """Adds the struct ``out``: words, runs of hit words, and items found, sorted.

    A window is ``size`` consecutive words of an item; an item of fewer words is
    one window.  Null and empty texts have no words; items without words, or with
    a null id or text, match nothing; equal items all count; ids may be numbers or
    strings.  A column of the name ``out`` is replaced, others stay, and repeated rows
    get equal results.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("body"))
    items = items.where("item is not null and body is not null").distinct()
    n = F.size(_words(F.col("body"))).cast("long")
    counts = items.agg(F.sum(F.greatest(n - size + 1, F.lit(1))), F.sum(n + F.octet_length("body") / WORD_BYTES), F.count("*")).first()
    need = sum((c or 0) * each for c, each in zip(counts, (WINDOW_BYTES, WORD_BYTES, ITEM_BYTES)))
    if need <= broadcast_bytes:
        windows = WindowSet([(r["item"], r["body"].encode("utf-8", "surrogatepass")) for r in items.collect()], size)
        return docs.withColumn(out, _scan_udf(windows, items.schema["item"].dataType)(F.col(text_col)))
    return _by_join(docs, items, text_col, size, out)


def _grams(words: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))


def _merged_runs(spans: DataFrame, key: str) -> DataFrame:
    """(key, s, e): starts and ends of the runs that spans (key, at, end) make together, in time n log n."""
    order = Window.partitionBy(key).orderBy("at", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("at") > before, F.lit(True)).cast("int")
    numbered = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    runs = numbered.groupBy(key, "run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    sorted_ = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("runs"))  # of one text
    return sorted_.select(key, F.transform("runs", lambda r: r["at"]).alias("s"), F.transform("runs", lambda r: r["end"]).alias("e"))


def _by_join(docs: DataFrame, items: DataFrame, text_col: str, size: int, out: str) -> DataFrame:
    """The way for a benchmark too large to send: a join on the windows.

    Works on distinct texts by their digest, so copies cost one scan, and makes windows of
    the lengths that items have.  A text names a window once for all its places, so a common
    short item has a row a text; AQE splits such a window's rows.
    """
    known = items.withColumn("words", _words(F.col("body"))).where(F.size("words") > 0)
    known = known.withColumn("n", F.least(F.size("words"), F.lit(size)))
    known = known.select("item", "n", F.explode(_grams(F.col("words"), F.col("n"))).alias("gram")).distinct()
    lengths = [r[0] for r in known.select("n").distinct().collect()]  # from 1 to size
    key = f"__{out}_key"
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    texts = keyed.groupBy(key).agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    texts = texts.withColumn("words", _words(F.col("body")))
    wanted = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    grams = texts.select(key, F.explode(wanted).alias("n"), "words").where(F.size("words") >= F.col("n"))
    grams = grams.select(key, "n", F.posexplode(_grams(F.col("words"), F.col("n"))).alias("at", "gram"))
    places = grams.join(known.select("n", "gram").distinct(), ["n", "gram"], "left_semi")
    places = places.groupBy(key, "n", "gram").agg(F.collect_list("at").alias("ats"))
    hits = places.join(known, ["n", "gram"])
    items_of = hits.groupBy(key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = hits.select(key, F.explode("ats").alias("at"), "n").select(key, "at", (F.col("at") + F.col("n")).alias("end")).distinct()
    runs = items_of.join(_merged_runs(spans, key), key).select(key, "items", F.struct("s", "e").alias("r"))
    none = F.array().cast("array<int>")
    whole = texts.select(key, F.size("words").cast("long").alias("n")).join(runs, key, "left")
    item = items.schema["item"].dataType
    columns = (F.col("n"), F.coalesce("r.s", none), F.coalesce("r.e", none), F.coalesce("items", F.array().cast(ArrayType(item))))
    whole = whole.select(key, F.struct(*(c.alias(x) for c, x in zip(columns, _hits(item).names))).alias(out))
    return keyed.drop(out).join(whole, key, "left").drop(key)


def hit_words(hits: Column) -> Column:
    """Number of words under the struct's runs."""
    return F.aggregate(F.zip_with(hits["hit_ends"], hits["hit_starts"], lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


DECONTAMINATION_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bl AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM bl)),
dw AS (SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bl) WHERE len(ws) >= n)),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
x AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (rid) LEFT JOIN x USING (rid)
"""
