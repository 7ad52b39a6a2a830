"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits; two link at ``distance`` (4) or fewer differing bits.
The bits are cut into three blocks, and of two linked fingerprints at least one
block differs in at most one bit.  Within a block, anchors are the words of a
covering code of radius 1: a Hamming(15, 11) code on the first 15 bits, all
values on the others.  A fingerprint's home is its nearest anchor, and it is
replicated to every anchor within radius + 1 of it, so linked fingerprints meet
at the home of either.  At each anchor they are compared, and a spanning forest
of the links found comes out, never all pairs.

A block has some 2^17 anchors and a fingerprint 14 replicas in it on average, so an
anchor's load is N / 2^17 x 14.  Anchors over ``cell_rows`` are covered again by the
same rule over the bits of the other two blocks, in three parts of 14 or 15 bits, one
of which differs in at most one bit: that cuts their load by some 2^14 / 15 for 45
replicas of each.  So 10^10 fingerprints make 42 replicas each at the first level, in
anchors of a million rows, and these 45 each at the second, in anchors of a
thousand.  What is still over ``cell_rows`` there, fingerprints that are alike in
most bits, goes to a grid of cells, so that any two of them meet in one.  Equal
fingerprints, such as those of exact copies, are one node from the start.

Components are found by alternating star contraction, a few joins and
aggregations a round over the forest edges, each round written to the shared
folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarryline.llm.common import CLEAN, join_counted, remove_folder, settings, shared_path, stash

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCKS = ((0, 21), (21, 21), (42, 22))
_CODE_BITS = 15


def shingle_hashes(data: bytes, size: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of every shingle of ``size`` words; of the whole sequence if there are fewer."""
    words = data.translate(_FOLD).split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, seed)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(data: bytes, size: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; 0 for a text without words."""
    hashes = np.array(shingle_hashes(data, size, seed), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(counts * 2 > len(hashes)))


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    values = np.fromiter((fingerprint(x.as_py() or b"") for x in texts.cast(pa.large_binary())), np.uint64, len(texts))
    return pa.array(values.view(np.int64))


def simhash(text: Column) -> Column:
    """Fingerprint as a signed 64-bit number; a null text has no words."""
    return _fingerprints(text)


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value: its nearest code word, and all code words within 2 (padded with -1)."""
    values = np.arange(1 << _CODE_BITS, dtype=np.int64)
    syndrome = np.zeros_like(values)
    for i in range(_CODE_BITS):  # the column of bit i is i + 1
        syndrome ^= np.where(values >> i & 1, i + 1, 0)
    flip = np.concatenate(([0], 1 << np.arange(_CODE_BITS)))
    home = values ^ flip[syndrome]
    near = np.full((len(values), 8), -1, np.int64)
    near[:, 0] = home
    pairs = {s: [int(flip[a] | flip[a ^ s]) for a in range(1, 16) if 0 < a ^ s and a < a ^ s] for s in range(1, 16)}
    for s, masks in pairs.items():
        rows = np.flatnonzero(syndrome == s)
        near[rows, 1 : 1 + len(masks)] = values[rows, None] ^ np.array(masks)
    return home, near


def _anchors(batches):
    """Rows (anchor, fp, home): the home of each fingerprint and the anchors within radius + 1 of it."""
    home, near = _code_tables()
    is_code = home == np.arange(len(home))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        bits = fps.view(np.uint64)
        out_a, out_f, out_h = [], [], []

        def emit(block, code, rest, which, homes):
            out_a.append(code | rest << _CODE_BITS | block << 32)
            out_f.append(fps[which])
            out_h.append(np.full(len(which), homes))

        for block, (at, width) in enumerate(BLOCKS):
            value = (bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
            code, rest = value & ((1 << _CODE_BITS) - 1), value >> _CODE_BITS
            every, spare = np.arange(len(fps)), width - _CODE_BITS
            emit(block, home[code], rest, every, True)
            for k in range(1, 8):
                some = np.flatnonzero(near[code, k] >= 0)
                emit(block, near[code[some], k], rest[some], some, False)
            exact = np.flatnonzero(is_code[code])
            for i in range(spare):
                emit(block, home[code], rest ^ 1 << i, every, False)
                for j in range(i):
                    emit(block, code[exact], rest[exact] ^ (1 << i | 1 << j), exact, False)
        yield pa.record_batch([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_f)), pa.array(np.concatenate(out_h))], ["anchor", "fp", "home"])


def _forest(fps: np.ndarray, homes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among an anchor's fingerprints; one end of a link is at home there."""
    left = np.ones(len(fps), bool)
    bits = fps.view(np.uint64)
    edges = []
    for first in np.flatnonzero(homes):
        if not left[first]:
            continue
        left[first] = False
        queue = [int(first)]
        while queue:
            u = queue.pop()
            open_ = np.flatnonzero(left if homes[u] else left & homes)
            new = open_[np.bitwise_count(bits[open_] ^ bits[u]) <= distance]
            left[new] = False
            edges += [(int(fps[u]), int(fps[v])) for v in new]
            queue += new.tolist()
    return edges


def _compare(distance: int, order: list[str]):
    """Batches sorted by group (the columns ``order``) to forest edges; a group may run over several batches."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table):
            keys = np.stack([table.column(c).to_numpy() for c in order])
            fps, homes = table.column("fp").to_numpy(), table.column("home").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = np.concatenate(([0], cuts, [len(fps)]))
            edges = []
            sizes = np.diff(bounds)
            homed = np.add.reduceat(homes.astype(np.int64), bounds[:-1]) if len(fps) else sizes
            for k in np.flatnonzero((sizes > 1) & (homed > 0)):
                a, b = bounds[k], bounds[k + 1]
                edges += _forest(fps[a:b], homes[a:b], distance)
            return pa.record_batch([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in order)
            if tuple(held[0].column(c)[0].as_py() for c in order) == last:
                continue  # one group so far
            table = pa.Table.from_batches(held)
            open_ = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(order, last)])
            done = len(open_) - int(open_.sum())
            yield flush(table.slice(0, done))
            held = table.slice(done).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _second_anchors(batches):
    """Rows (anchor, sub, fp, home) of crowded anchors: parts of the bits outside the anchor's block, as they are and with one bit flipped.

    A fingerprint is at home where its part is as it is, if it is at home at the anchor.
    """
    for batch in batches:
        anchor = batch.column(0).to_numpy()
        bits = batch.column(1).to_numpy().view(np.uint64)
        home = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        block = anchor >> 32
        for own, (at, width) in enumerate(BLOCKS):
            rows = np.flatnonzero(block == own)
            if not len(rows):
                continue
            low = bits[rows] & np.uint64((1 << at) - 1)
            rest = low | (bits[rows] >> np.uint64(at + width)) << np.uint64(at)
            cuts = [0, 14, 28, 64 - width]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                value = (rest >> np.uint64(a) & np.uint64((1 << b - a) - 1)).astype(np.int64)
                for flip in (0, *(1 << i for i in range(b - a))):
                    sub = value ^ flip | (part + 1) << 16
                    columns = (anchor[rows], sub, bits[rows].view(np.int64), home[rows] & (flip == 0))
                    yield pa.record_batch([pa.array(c) for c in columns], ["anchor", "sub", "fp", "home"])


def _gridded(dealt: DataFrame, crowds: DataFrame, keys: list[str], cell_rows: int) -> DataFrame:
    """Adds ``cell``: a crowd of n gets s x s cells, s = ceil(n / cell_rows), homes by row and the others by column."""
    side = F.ceil(F.col("count") / cell_rows)
    both = dealt.join(crowds.withColumn("side", side).drop("count"), keys, "left").withColumn("side", F.coalesce("side", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("side"))
    spread = F.sequence(F.lit(0).cast("bigint"), F.col("side") - 1)
    row = F.explode(F.transform(spread, lambda j: own * F.col("side") + j)).alias("cell")
    column = F.explode(F.transform(spread, lambda i: i * F.col("side") + own)).alias("cell")
    return both.where("home").select(*keys, "fp", "home", row).unionByName(both.select(*keys, "fp", F.lit(False).alias("home"), column))


def links(fps: DataFrame, *, distance: int = 4, cell_rows: int = 8192) -> DataFrame:
    """Forest edges (u, v) over distinct fingerprints in column fp; joined up, they give every component.

    ``distance`` may be up to 5: of three blocks, one then differs in at most one bit.
    """
    if distance > 5:
        raise ValueError("three blocks of radius 1 find links of 5 bits at most")
    first = fps.select("fp").mapInArrow(_anchors, "anchor bigint, fp bigint, home boolean")
    crowds = stash(first.groupBy("anchor").count().where(F.col("count") > cell_rows))
    zero = F.lit(0).cast("bigint")
    dealt = first.withColumns({"sub": zero, "cell": zero})
    if not crowds.isEmpty():
        second = stash(first.join(crowds.select("anchor"), "anchor", "left_semi").select("anchor", "fp", "home"))
        second = second.mapInArrow(_second_anchors, "anchor bigint, sub bigint, fp bigint, home boolean")
        keys = ["anchor", "sub"]
        left = stash(second.groupBy(*keys).count().where(F.col("count") > cell_rows))
        plain = first.join(crowds.select("anchor"), "anchor", "left_anti").withColumns({"sub": zero, "cell": zero})
        dealt = plain.unionByName(_gridded(second, left, keys, cell_rows))
    order = ["anchor", "sub", "cell"]
    sorted_ = dealt.repartition(*order).sortWithinPartitions(*order, F.desc("home"), "fp").select("fp", "home", *order)
    return sorted_.mapInArrow(_compare(distance, order), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the component's smallest node."""
    spark = edges.sparkSession

    def save(df):
        path = shared_path(spark)
        with settings(spark, CLEAN):
            df.write.parquet(path)
        back = spark.read.schema("u bigint, v bigint").parquet(path)
        return path, back, back.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    path, e, mark = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        # Large star: every neighbour above a node is hung on the smallest of its neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the neighbours below a node, and the node, are hung on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        under = large.join(low, "u")
        small = under.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        was, old = path, mark
        path, e, mark = save(small)
        remove_folder(spark, was)
        if mark == old:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """(id, fp, component_id) for every document; a component's id is the smallest id in it.

    Repeated rows and equal ids each keep their row.  Null ids take part and may
    leave a component without an id if it has no other.
    """
    marked = stash(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp")))
    nodes = stash(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_rows")))
    roots = components(links(nodes, distance=distance))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    joined = join_counted(grouped.select("root", "fp"), named, "root", "n").select("fp", "component_id")
    label = nodes.join(joined, "fp", "left").select("fp", "n_rows", F.coalesce("component_id", "least").alias("component_id"))
    return join_counted(marked, label, "fp", "n_rows").select("id", "fp", "component_id")
