"""Quality classifier: compressed size under dictionaries of good and bad text.

Zstandard dictionaries are built from the text of documents labelled good and
bad.  A document is cut into pieces (all of it, not a prefix), each piece is
compressed with either dictionary, and the normalised difference of the two
sums, (bad - good) / (bad + good), says which class the text resembles.  A
logistic curve fitted on labelled documents that gave no dictionary text turns
the difference into the probability of the good class.

Dictionaries are of one size, at most an eighth of the text of the class that has less of
it; also few labels give trained ones.

Fitting reads a bounded sample: at most ``max_labelled`` labelled documents, the
first by a hash of the id, and of those at most ``max_pieces`` pieces a class.
The driver holds only these pieces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import trained_dictionary


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the logistic curve; small, sent with the tasks."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    piece_bytes: int
    level: int

    def score(self, text: Column) -> Column:
        """Probability of the good class, 0 to 1; null and empty texts get the curve's value at 0."""
        return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * self.difference(text) + F.lit(self.intercept)))), 12)

    def difference(self, text: Column) -> Column:
        """Normalised size difference in [-1, 1]; above 0: closer to the good text."""
        return _difference_udf(self.good, self.bad, self.piece_bytes, self.level)(text)


def _difference_udf(good: bytes, bad: bytes, piece: int, level: int):
    cached: list = []

    @F.arrow_udf("double")
    def difference(texts: pa.Array) -> pa.Array:
        if not cached:
            for blob in (good, bad):
                d = zstandard.ZstdCompressionDict(blob)
                if blob:
                    d.precompute_compress(level=level)
                cached.append(zstandard.ZstdCompressor(level=level, dict_data=d if blob else None, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        to_good, to_bad = cached
        out = []
        for value in texts.cast(pa.large_binary()):
            data = value.as_py() or b""
            g = b = 0
            for at in range(0, len(data), piece):
                part = data[at : at + piece]
                g += len(to_good(part))
                b += len(to_bad(part))
            out.append((b - g) / (b + g) if b + g else 0.0)
        return pa.array(out, pa.float64())

    return difference


def fit_compression_model(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    allowed: Column | None = None,
    max_labelled: int = 6000,
    max_pieces: int = 3000,
    piece_bytes: int = 1024,
    dictionary_bytes: int = 65536,
    level: int = 3,
) -> CompressionModel:
    """Fits the model on at most ``max_labelled`` labelled documents.

    ``allowed`` limits which ids may be learnt from.  Rows with a null id, text
    or label teach nothing; an id labelled more than once counts once per label.
    Without labels of both classes the score is the smoothed share of good ones.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    if allowed is not None:
        labels = labels.where(allowed)
    labels = labels.where("id is not null and y in (0, 1)").distinct()
    chosen = labels.orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    known = texts.join(F.broadcast(chosen), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)))

    piece = piece_bytes
    pieces = (
        known.where("part = 0")
        .select("y", F.encode("text", "UTF-8").alias("data"))
        .select("y", F.explode(F.transform(F.sequence(F.lit(0), ((F.octet_length("data") - 1) / piece).cast("int")), lambda i: F.substring("data", i * piece + 1, F.lit(piece)))).alias("p"))
    )
    ranked = [pieces.where(F.col("y") == y).orderBy(F.xxhash64("p"), "p").limit(max_pieces) for y in (1, 0)]
    taught: dict[int, list[bytes]] = {0: [], 1: []}
    for row in ranked[0].union(ranked[1]).collect():
        taught[row["y"]].append(bytes(row["p"]))
    # Both dictionaries get the size that the class with less text allows, so that neither helps more for its size.
    size = min(dictionary_bytes, *(max(256, sum(map(len, taught[y])) // 8) for y in (0, 1)))
    good, bad = (trained_dictionary(taught[y], size) for y in (1, 0))
    model = CompressionModel(good, bad, 0.0, 0.0, piece_bytes, level)

    points = [(r["x"], r["y"]) for r in known.where("part = 1").select("y", model.difference(F.col("text")).alias("x")).collect()]
    slope, intercept = _logistic(points) if taught[0] and taught[1] else (0.0, _prior([*[y for _, y in points], *([1] * len(taught[1])), *([0] * len(taught[0]))]))
    return CompressionModel(model.good, model.bad, slope, intercept, piece_bytes, level)


def _prior(ys: list[int]) -> float:
    return math.log((sum(ys) + 1) / (len(ys) - sum(ys) + 1))


def _logistic(points: list[tuple[float, int]], ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Newton's method for a one-variable logistic regression with a light ridge on the scaled slope."""
    if not points:
        return 0.0, 0.0
    ys = [y for _, y in points]
    if len(set(ys)) < 2:
        return 0.0, _prior(ys)
    n = len(points)
    mean = sum(x for x, _ in points) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x, _ in points) / n) or 1.0
    zs = [(x - mean) / sd for x, _ in points]
    a, b = 0.0, _prior(ys)
    for _ in range(rounds):
        ga, gb, haa, hab, hbb = ridge * n * a, 0.0, ridge * n, 0.0, 1e-9
        for z, y in zip(zs, ys):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * z + b))))
            w = p * (1 - p)
            ga += (p - y) * z
            gb += p - y
            haa += w * z * z
            hab += w * z
            hbb += w
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-4.0, min(4.0, da)), b - max(-4.0, min(4.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return a / sd, b - a * mean / sd
