"""Near-duplicates by the exact Jaccard similarity of word shingles.

MinHash bands propose pairs, the whole sets of shingle hashes decide. BANDS bands of ROWS minima miss a pair of similarity s with
probability (1 - s^ROWS)^BANDS: below 1e-7 at 0.8, less above. Small buckets are compared pairwise, sifted inside the join by SKETCH
low bits of minima: two minima differ in their bit with probability (1 - s) / 2, and at 0.8 more than APART of the bits differ with
probability below 1e-7 as well.

Members of larger buckets are first compared with one centre per bucket. Texts that share a passage, or are distant copies of one text,
meet there without being near copies of each other, so the members that remain in different components aren't paired by bucket but by
the rarest of their shingles: with shingles in rising order of frequency, two sets of similarity 4/5 or more share one of the first
n // 5 + 1 of theirs, and after the first one that they share enough others must be left in both. That holds for all such pairs, and the
shingles of a passage come last in texts that have their own words. Of the components that share a shingle the largest is only compared
with the others, not within itself. Members of a shingle that many share are dealt over a grid of cells of HOT by HOT members.

Texts with the same set of shingles are one node from the start. Links of fingerprints may come first: those that the sets confirm make
components, and the bands only compare nodes of different ones. Buckets within one component go as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, let_go, pick, small_batches, written
from .components import keep_best, roots
from .simhash import majority, shingle_hashes

WIDTH = 5
#: Least similarity of near copies, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 4
#: Buckets of more nodes are compared with a centre first.
SMALL = 16
#: Members of a shingle that meet in one cell, on each side.
HOT = 256
CHUNK = 1 << 7
#: Bits of a sketch (as many minima as the bands have, and as many more), and how many may differ: six deviations over the mean at 0.8.
SKETCH, APART = 256, 54
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, SKETCH, 1), np.uint64)
_XOR, _ODD = _SEEDS[0], _SEEDS[1] | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, width))


def _minima(h: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for k in range(0, len(h), CHUNK):
        np.minimum(least, ((h[k : k + CHUNK] ^ _XOR) * _ODD).min(axis=1), out=least)
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band, the band's number included."""
    data, step = least.astype("<u8").tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[step * b : step * (b + 1)], b) for b in range(BANDS)], np.uint64).view(np.int64)


def _sketch(least: np.ndarray) -> np.ndarray:
    """The minima's lowest bits, 64 in a long."""
    return np.packbits((least & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8")


def signature(text: Column) -> Column:
    """x (digest of the set of shingles), n (its size), f (SimHash of all shingles), bands (keys), sketch (SKETCH bits)."""
    longs = SKETCH // 64

    @F.arrow_udf("struct<x: long, n: long, f: long, bands: array<long>, sketch: array<long>>")
    @lean("jaccard")
    def f(texts: pa.Array) -> pa.Array:
        xs, ns, fs, keys, sketches, offsets = [], [], [], [], [], [0]
        for t in texts.to_pylist():
            every = shingle_hashes(t, WIDTH)
            h = np.unique(every)
            xs.append(xxhash.xxh64_intdigest(h.astype("<u8").tobytes()))
            ns.append(len(h))
            fs.append(majority(every))
            least = _minima(h)
            sketches.append(_sketch(least))
            if len(h):
                keys.append(_band_keys(least))
            offsets.append(BANDS * len(keys))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
        signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (xs, fs)]
        flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(xs) + 1) * longs, pa.int32()), pa.array(flat.astype(np.int64)))
        return pa.StructArray.from_arrays([signed[0], pa.array(ns, pa.int64()), signed[1], bands, sketch], ["x", "n", "f", "bands", "sketch"])

    return f(text)


@F.arrow_udf(T.BinaryType())
@lean("jaccard")
def _packed(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t).tobytes() for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(T.LongType())
@lean("jaccard")
def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of hashes that both sets hold."""
    sets = [[np.frombuffer(s.as_buffer(), np.uint64) for s in c] for c in (a, b)]
    return pa.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(*sets, strict=True)], pa.int64())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is SIMILARITY or more."""
    num, den = SIMILARITY
    found = pairs.join(sets.toDF("a", "na", "sa"), "a").join(sets.toDF("b", "nb", "sb"), "b")
    # k / (na + nb - k) >= num / den in integers
    return found.where(_shared("sa", "sb") * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _proposed(nodes: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints propose links: a fingerprint's first node stands for it, and its others go with it."""
    first = written(nodes.groupBy(F.col("f").alias("x")).agg(F.min("x").alias("node"), F.count("*").alias("c")), "fingerprints")
    links = propose(first.select("x"))
    ends = links.join(first.select(F.col("x").alias("a"), F.col("node").alias("na")), "a").join(first.select(F.col("x").alias("b"), F.col("node").alias("nb")), "b")
    shared = first.where("c > 1").select(F.col("x").alias("f"), "node")
    own = nodes.select("f", "x").join(shared, "f").where("x <> node")
    return ends.select(*_ordered(F.col("na"), F.col("nb"))).union(own.select(*_ordered(F.col("x"), F.col("node"))))


def _sets(nodes: DataFrame, texts: DataFrame, some: DataFrame) -> DataFrame:
    """x, n and s (the packed set) of some nodes (column x)."""
    wanted = some.distinct().join(nodes, "x").select("x", "n", "t")
    return written(texts.join(wanted, "t").dropDuplicates(["x"]).select("x", "n", _packed("text").alias("s")), "shingles")


def _settled(nodes: DataFrame, texts: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the nodes that proposed links connect, as far as the sets confirm them."""
    pairs = written(_proposed(nodes, propose).distinct(), "proposed")
    sets = _sets(nodes, texts, pairs.select(F.explode(F.array("a", "b")).alias("x")))
    own = roots(_verified(pairs, sets))
    let_go(pairs, sets)
    return own


def _components(nodes: DataFrame, texts: DataFrame, small: int, propose: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(node, root) of the nodes (x, n, f, bands, t) with a near copy; texts has t and text."""
    num, den = SIMILARITY
    settled = nodes.sparkSession.createDataFrame([], "node long, root long") if propose is None else _settled(nodes, texts, propose)
    rows = _placed(nodes.select("x", "n", "bands"), settled).select("x", "n", "root", F.explode("bands").alias("key"))
    centre = F.min(F.struct(F.xxhash64("x", "key"), "x", "n", "root")).alias("centre")
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), centre).where("lo <> hi")
    found = rows.join(shared, "key").select("key", "x", "n", "root", "c", F.col("centre.x").alias("cx"), F.col("centre.n").alias("cn"), F.col("centre.root").alias("croot"))
    members = written(found.join(nodes.select("x", "sketch"), "x"), "buckets")

    def alike(n: str, m: str) -> Column:  # sizes that allow the similarity
        return F.least(n, m) * den >= F.greatest(n, m) * num

    def close(p: str, q: str) -> Column:  # sketches that allow it
        return sum((F.bit_count(F.col(p)[i].bitwiseXOR(F.col(q)[i])) for i in range(SKETCH // 64)), F.lit(0)) <= APART

    few = members.where(F.col("c") <= small)
    left = few.select("key", F.col("x").alias("a"), "n", "root", F.col("sketch").alias("p"))
    right = few.select("key", F.col("x").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("sketch").alias("q"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("root") != F.col("other")) & alike("n", "m") & close("p", "q")).select("a", "b")
    many = members.where(F.col("c") > small)
    stars = many.where((F.col("root") != F.col("croot")) & alike("n", "cn")).select(*_ordered(F.col("x"), F.col("cx")))
    sets = _sets(nodes, texts, members.select("x"))
    own = _merged(settled, _verified(pairs.union(stars).distinct(), sets))
    # Members of a large bucket that are in different components still have to be compared with each other.
    placed = _placed(many.select("key", "x", "n"), own)
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = written(placed.join(split, "key").select("x", "n", "root").distinct(), "split-buckets")
    let_go(members, settled)
    if rest.isEmpty():
        let_go(sets)
        return own
    cross = _sharing_rare(rest, sets)
    joined = _merged(own, _verified(cross, sets))
    let_go(sets, rest, cross, own)
    return joined


def _placed(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """nodes (x and more) with the root of their component in own (node, root); a node that has none is its own."""
    return nodes.join(own, nodes["x"] == own["node"], "left").withColumn("root", F.coalesce("root", "x")).drop("node")


def _merged(own: DataFrame, links: DataFrame) -> DataFrame:
    """Components own (node, root), joined by further links (a, b) of nodes, some of which own may not have."""
    ends = links.join(own.toDF("a", "ra"), "a", "left").join(own.toDF("b", "rb"), "b", "left")
    top = roots(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).toDF("root", "top")
    known = own.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = top.select(F.col("root").alias("node"), F.col("top").alias("root")).join(own, "node", "left_anti")
    return written(known.union(fresh), "merged")


@F.arrow_udf(T.ArrayType(T.LongType()))
@lean("jaccard")
def _hashes(sets: pa.Array) -> pa.Array:
    """The hashes of packed sets, as signed longs."""
    flat = [np.frombuffer(s.as_buffer(), np.int64) for s in sets]
    offsets = np.cumsum([0, *map(len, flat)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))


def _cells(members: Column) -> Column:
    """How many cells of HOT members so many fill."""
    return F.ceil(members / HOT)


def _cell(member: str, cells: str) -> Column:
    """The one cell of a member, of so many."""
    return F.pmod(F.xxhash64(member), F.col(cells))


def _every(cells: str) -> Column:
    """A row for each of so many cells."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(cells) - 1))


def _sharing_rare(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rest (x, n, root) with different roots, among them all of similarity SIMILARITY or more: see above."""
    num, den = SIMILARITY
    every = written(rest.join(sets.select("x", "s"), "x").select("x", "n", "root", F.explode(_hashes("s")).alias("h")), "set-members")
    ranked = every.join(every.groupBy("h").agg(F.count("*").alias("df")), "h").withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy("df", "h")))
    near = (F.col("df") > 1) & ((F.col("i") - 1) * den <= F.col("n") * (den - num))
    prefix = written(ranked.where(near).select("h", "x", "n", "root", "i", _cells(F.col("df")).alias("slots")), "prefixes")
    by_root = prefix.groupBy("h", "root", "slots").agg(F.count("*").alias("c"))
    sizes = by_root.groupBy("h", "slots").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("k")).where("k > 1")
    sizes = sizes.select("h", F.col("m.root").alias("largest"), _cells(F.col("all") - F.col("m.c")).alias("rows"), _cells(F.col("all")).alias("columns"), _every("slots").alias("slot"))
    live = written(prefix.withColumn("slot", _cell("x", "slots")).drop("slots").join(sizes, ["h", "slot"]).drop("slot"), "split-prefixes")
    here = live.where("root <> largest").withColumn("row", _cell("x", "rows")).withColumn("column", _every("columns")).drop("rows", "columns")
    other = live.select("h", F.col("x").alias("y"), F.col("n").alias("m"), F.col("root").alias("root2"), F.col("i").alias("j"), _every("rows").alias("row"), _cell("x", "columns").alias("column"))
    pairs = here.join(other, ["h", "row", "column"]).where(F.col("root") != F.col("root2"))
    left = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + 1  # at the first shared shingle all that both can share
    fit = (left * (num + den) >= (F.col("n") + F.col("m")) * num) & (F.least("n", "m") * den >= F.greatest("n", "m") * num)
    found = written(pairs.where(fit).select(*_ordered(F.col("x"), F.col("y"))).distinct(), "sharing")
    let_go(every, prefix, live)
    return found


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, propose: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row of docs for each group of near copies, with all its columns: the one with the smallest id, and of several texts with
    that id the one with the smallest hash. Groups are the components of pairs of similarity SIMILARITY or more. Rows without an id
    stay; texts without words are one group; texts of any length are compared whole. propose takes distinct fingerprints (column x)
    and gives links (a, b) between them that are candidates before the bands'."""
    small_batches(docs.sparkSession)
    base = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("t", F.xxhash64("text"))
    rows = written(base.select("doc_id", "t", signature(F.col("text")).alias("s")).select("doc_id", "t", "s.*"), "signatures")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("first")
    nodes = written(rows.groupBy("x").agg(first, F.min("t").alias("t"), F.first("n").alias("n"), F.first("f").alias("f"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    own = _components(nodes, base.select("t", "text"), small, propose)
    linked = written(nodes.join(own, nodes["x"] == own["node"], "left").select("x", F.coalesce("root", "x").alias("root"), "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("best"))
    best = written(linked.select("x", "root").join(least, "root").select("x", "best"), "fates")
    let_go(nodes, own, linked)
    return keep_best(docs, rows.select("doc_id", "t", "x").join(best, "x"), id_col, text_col)
