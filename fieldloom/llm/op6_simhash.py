"""Near-duplicates by SimHash and segment popcounts.

Distinct fingerprints are cut into 32 segments of two bits; the bit counts of the segments (0 to 2 each) are their embedding, in 32
dimensions. It's held in one long as counts in unary (00, 01, 11), so that the Manhattan distance of two embeddings is the number of
bits in which they differ. A flipped bit moves one count by one, so that is a lower bound of the Hamming distance.

The range join runs on grids: with the segments in k blocks, a Manhattan distance up to d leaves at least k - d blocks untouched. The
blocks are in m groups; with k - d = m (t - 1) + 1, some group has t untouched blocks, so every pair in range shares a cell in one of
the grids spanned by t blocks of one group. Cells are joined, grid by grid; the join's condition drops pairs over the Manhattan
distance, then verifies the Hamming distance, and emits a pair in the first grid only that holds it. Few grids make few copies of a
fingerprint and large cells; t and m are the cheapest whose commonest cells still hold few fingerprints. Groups make the copies grow
in small steps with the number of fingerprints, and fewer of them for the same cells (7 for 8 segments, where one group needs 15).

Cells over HEAVY fingerprints aren't joined pairwise. Their fingerprints emit every value within d / 2 flips; two share such a
value if and only if they are within d, so linking each to the smallest one of each value gives the same components, exactly and
in linear work.

keep_similar applies the operator to texts in a pipeline, where near copies are texts of a Jaccard similarity of 0.8 or more over
five-word shingles. Links of five-word fingerprints come first: those that the sets confirm settle the closest copies, however many there
are. At 0.8 fingerprints differ in ten bits or so, out of reach of any exact range join on 64 bits, so MinHash bands (jaccard.py) go on
from the components of the links and compare only what they left apart.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import let_go, pick, small_batches, written
from .components import keep_best, roots
from .simhash import fingerprint

DISTANCE = 4
HEAVY = 2048
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: Column, width: int = 4, seed: int = 42) -> Column:
    """The fingerprint as a long (its 64 bits)."""

    @F.arrow_udf("long")
    def f(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(t, width, seed)) for t in texts.to_pylist()], pa.int64())

    return f(text)


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def embedding(x: Column) -> Column:
    """Bit counts of the 32 two-bit segments of x in unary: the low bit of a segment if it has a bit, the high one if it has both."""
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings."""
    return F.bit_count(a.bitwiseXOR(b))


def blocks_for(n: int, distance: int = DISTANCE, heavy: int = HEAVY) -> tuple[int, int]:
    """The cheapest (own blocks of a grid, groups of blocks) for n random fingerprints. A copy of a fingerprint in a grid costs about
    as much as 200 comparisons; two counts agree with probability 3/8, and the commonest count has probability 1/2, so that no cell
    should exceed three quarters of heavy."""
    costs, least = {}, {}
    for own in range(1, 9):
        for groups in range(1, distance + 2):
            edges, parts = _blocks(own, groups, distance)
            if groups > 1 and own == 1 or own > 1 and len(edges) > 33:
                continue
            copies = sum(comb(len(p), own) for p in parts)
            costs[own, groups] = copies * (1 + n * 0.375 ** (32 * own / (len(edges) - 1)) / 200)
            least[own, groups] = min(sum(sorted(edges[b + 1] - edges[b] for b in p)[:own]) for p in parts if len(p) >= own)
    fit = [k for k in costs if 4 * n * 0.5 ** least[k] <= 3 * heavy] or [k for k in costs if least[k] == max(least.values())]
    return min(fit, key=lambda k: costs[k])


def _blocks(own: int, groups: int, distance: int) -> tuple[list[int], list[range]]:
    """The first segment of each block, with the end, and the blocks of each group: so many that, whichever `distance` blocks are
    touched, some group has `own` untouched ones."""
    k = distance + groups * (own - 1) + 1
    return [32 * i // k for i in range(k + 1)], [range(k * g // groups, k * (g + 1) // groups) for g in range(groups)]


def _cells(fps: DataFrame, own: int, groups: int, distance: int) -> tuple[DataFrame, list[int], list[int]]:
    """x, e (embedding), grid (number), cell: a row for each grid. And the masks of blocks, and the bits of the blocks of each grid."""
    edges, parts = _blocks(own, groups, distance)
    masks = [sum(3 << 2 * lane for lane in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    grids, bits = [], []
    for blocks in (c for p in parts for c in combinations(p, own)):
        mask = sum(masks[b] for b in blocks)
        grids.append(F.struct(F.lit(len(bits)).alias("grid"), F.col("e").bitwiseAND(F.lit(_signed(mask))).alias("cell")))
        bits.append(sum(1 << b for b in blocks))
    return fps.select("x", embedding(F.col("x")).alias("e")).select("x", "e", F.inline(F.array(*grids))), masks, bits


def _first(apart: Column, groups: int, masks: list[int], grids: list[int]) -> Column:
    """Whether the grid is the first that holds a pair whose embeddings differ in these bits. Short code, as it's part of the join."""
    same = lambda m: apart.bitwiseAND(F.lit(_signed(m))) == 0
    if groups > 1:
        number = F
        for i, g in enumerate(grids):
            number = number.when(same(sum(m for b, m in enumerate(masks) if g >> b & 1)), i)
        return number == F.col("grid")
    equal = sum((F.when(same(m), 1 << i).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    own = F.element_at(F.array(*[F.lit(g) for g in grids]), F.col("grid") + 1)
    upto = F.element_at(F.array(*[F.lit((1 << g.bit_length()) - 1) for g in grids]), F.col("grid") + 1)  # all blocks up to its last
    return equal.bitwiseAND(upto) == own


def links(fps: DataFrame, distance: int = DISTANCE, heavy: int = HEAVY, n: int | None = None) -> DataFrame:
    """(a, b): links between fingerprints (column x, distinct) at this Hamming distance or less. All of them between fingerprints
    whose shared cells are small; for the others enough of them for the same components."""
    if distance % 2:
        raise ValueError("distance must be even")
    own, groups = blocks_for(fps.count() if n is None else n, distance)
    cells, masks, grids = _cells(fps, own, groups, distance)
    crowded = written(cells.groupBy("grid", "cell").count().where(F.col("count") > heavy).select("grid", "cell"), "crowded")
    none = crowded.isEmpty()
    rest = cells if none else cells.join(crowded, ["grid", "cell"], "left_anti")
    side = lambda name: rest.select("grid", "cell", F.col("x").alias(name), F.col("e").alias(f"e{name}"))
    pair = side("a").join(side("b"), ["grid", "cell"])  # one shuffle, read by both sides
    a, b, apart = F.col("a"), F.col("b"), F.col("ea").bitwiseXOR(F.col("eb"))
    near = (a < b) & (manhattan(F.col("ea"), F.col("eb")) <= distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)
    found = pair.where(near).where(_first(apart, groups, masks, grids)).select("a", "b")
    if none:
        return found
    # A pair may share a crowded cell as its first one and a small one later; here it's found by the crowded way in any case.
    packed = cells.join(crowded, ["grid", "cell"], "left_semi").select("x").distinct()
    flips = packed.select("x")
    bits = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)])
    for _ in range(distance // 2):
        base = flips.columns[-1]
        flips = flips.withColumn("bit", F.explode(bits)).select("x", F.col(base).bitwiseXOR(F.col("bit")).alias("value")).distinct()
    star = flips.groupBy("value").agg(F.min("x").alias("a"))
    return found.union(flips.join(star, "value").where("a <> x").select("a", F.col("x").alias("b")).distinct())


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return written(rows.select("doc_id", F.xxhash64("text").alias("t"), simhash(F.col("text")).alias("x")), "fingerprints")


def _with_best(rows: DataFrame, distance: int, heavy: int) -> DataFrame:
    """rows (doc_id, t, x) with best, the smallest (doc_id, t) reachable over links. Tables are written before they are joined by
    a key that many rows may share, so that adaptive execution can split it."""
    nodes = written(rows.groupBy("x").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("first")), "nodes")
    own = roots(links(nodes.select("x"), distance, heavy))
    linked = written(own.join(nodes, own["node"] == nodes["x"]).select("x", "root", "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    member = written(linked.select("x", "root").join(least, "root").select("x", "least"), "members")
    fate = written(nodes.join(member, "x", "left").select("x", F.coalesce("least", "first").alias("best")), "fates")
    let_go(nodes, own, linked, member)
    return rows.join(fate, "x")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex), component_id, kept (its id is the component's).

    Edge cases: a null or empty text has fingerprint zero, which links like any other; null ids are passed over when the smallest
    is looked for (a component of null ids only has a null id and keeps nothing); repeated rows are all returned; an empty table
    gives an empty one; other columns are left out whatever their names; texts of any length are hashed whole."""
    rows = _with_best(_fingerprints(docs, id_col, text_col), distance, heavy)
    component = F.col("best.doc_id")
    return rows.select("doc_id", hex64(F.col("x")).alias("fingerprint"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """One row of docs for each component of fingerprints, with all its columns: the one with the smallest id, and of several texts
    with that id the one with the smallest hash. Rows without an id stay."""
    return keep_best(docs, _with_best(_fingerprints(docs, id_col, text_col), distance, heavy), id_col, text_col)


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = jaccard.SMALL) -> DataFrame:
    """One row of docs for each group of near copies (five-word shingles, Jaccard similarity 0.8 or more, chains followed), with all
    its columns: the one with the smallest id. Edge cases as in jaccard.keep_one."""
    return jaccard.keep_one(docs, id_col, text_col, small, propose=links)
