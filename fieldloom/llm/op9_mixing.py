"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

1. Sizes are summed by source. Sources, which may be as many as hosts, are numbered in code-point order by a range sort. Targets are
   shared by weight with a ceiling of `ceiling` times a source's size (water filling: sources whose share lies above their ceiling
   are filled, the rest is shared anew, until none is above; each round is one sum over the sources).
2. Within a source documents stand in the order of a hash of id and text. The words before each are its cumulative demand. A hot
   source is cut into blocks by the first digits of the hash: sums of blocks are accumulated first, then words inside a block, so
   that no task holds a source.
3. A source's target covers its axis of words as often as it goes: whole passes, then the words of a last one up to the target.
4. Every source has a schedule: its relative weight over training time 0 to 1, linear between knots. Its integral is the share of
   the source's target that is due by a time; inverting it at a copy's middle word gives the copy's position, by which rows are
   range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, let_go, partitions, word_count, written

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
CEILING = 3
Knots = tuple[tuple[float, float], ...]
#: Knots (time, relative weight) of the sources in code-point order, null last, repeating: heavy sources fade out, light ones come in
#: late.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
)
#: The same by weight.
SCHEDULE: dict[int, Knots] = dict(zip(WEIGHTS, SCHEDULES, strict=True))
BLOCK_DOCS = 2048


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start, weight at it, slope, integral up to it, integral of all) of each piece of a schedule."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    if knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) < 0 or min(areas) <= 0:
        raise ValueError("a schedule goes from 0 to 1 with weights of which no two neighbours are zero")
    return [(a[0], a[1], (b[1] - a[1]) / (b[0] - a[0]), sum(areas[:i]), sum(areas)) for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False))]


def inverse(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which this share of the integral is due."""
    out = None
    for t0, w0, slope, before, total in segments(knots):
        due = F.greatest(share * F.lit(total) - F.lit(before), F.lit(0.0))
        time = F.lit(t0) + F.lit(2.0) * due / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * due))
        time = F.when(due > 0, time).otherwise(F.lit(t0))
        out = time if out is None else F.when(share * F.lit(total) >= F.lit(before), time).otherwise(out)
    return F.least(out, F.lit(1.0))


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with nth, the number of its source in code-point order, null last. Ranges are counted first, so that no task holds all."""
    ranges = partitions(sizes.sparkSession)
    dealt = sizes.repartitionByRange(ranges, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = dealt.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("nth", F.row_number().over(own) - 1).join(base, "range").withColumn("nth", F.col("nth") + F.col("base")).drop("range", "base")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size), a row for each source -> with nth, weight and target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    x = written(_numbered(sizes).withColumn("weight", weight), "mix-weights")
    most, big = F.col("source_size") * ceiling, "decimal(38,0)"
    open_, share = x, x.agg(F.sum("source_size").alias("left"), F.sum("weight").alias("sharers")).first()
    left, sharers = share["left"] or 0, share["sharers"] or 1

    def full(left: int, sharers: int) -> Column:
        """A source whose share reaches its ceiling, in whole numbers."""
        return most.cast(big) * F.lit(sharers) <= F.col("weight").cast(big) * F.lit(left)

    rounds = [(left, sharers)]
    while True:
        more = open_.where(full(left, sharers)).agg(F.sum(most).alias("most"), F.sum("weight").alias("weight")).first()
        if not more["weight"] or more["weight"] == sharers:
            break
        open_ = open_.where(~full(left, sharers))
        left, sharers = left - more["most"], sharers - more["weight"]
        rounds.append((left, sharers))
    # The level only rises from round to round, so that a source that was full stays full at the last one.
    left, sharers = rounds[-1]
    share_of = F.col("weight") * F.lit(float(left)) / F.lit(sharers)
    return x.withColumn("target", F.when(full(left, sharers), most.cast("double")).otherwise(share_of)).select("source", "source_size", "nth", "weight", "target")


def _placed(rows: DataFrame, n: int, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """rows (doc_id, source, size, text_key, ...) with nth of the source, source_size, target, due (target in whole words), before,
    taken, copies."""
    digits = 0
    while 16**digits * BLOCK_DOCS < n:
        digits += 1
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key").cast("binary"))
    rows = rows.withColumn("key", key).withColumn("block", F.substring("key", 1, digits)).withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    sums = written(rows.groupBy("sk", "block", "source").agg(F.sum("size").alias("words")), "mix-blocks")
    share = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ceiling)
    share = share.withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))).drop("source")
    earlier = Window.partitionBy("sk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select("sk", "block", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")).join(share, "sk")
    blocks = written(blocks, "mix-targets")
    let_go(sums)
    inside = Window.partitionBy("sk", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, ["sk", "block"])
    x = x.withColumn("before", F.col("base") + F.col("inside")).withColumn("due", F.round("target").cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.expr("due div source_size"))).otherwise(0)
    x = x.withColumn("passes", passes)
    last = F.least(F.greatest(F.col("due") - F.col("passes") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    x = x.withColumn("last", last)
    return x.withColumn("taken", F.col("passes") * F.col("size") + F.col("last")).withColumn(
        "copies", F.when(F.col("size") > 0, F.col("passes") + (F.col("last") > 0).cast("long")).otherwise(0)
    )


def _position(copy: Column, schedules: tuple[Knots, ...], by_source: dict[str | None, Knots]) -> Column:
    """Position of a copy (from 0) of a row of _placed. by_source names the schedules of sources that don't follow the order."""
    if not schedules:
        raise ValueError("at least one schedule")
    own = F.when(copy < F.col("passes"), F.col("size")).otherwise(F.col("last"))
    middle = (copy * F.col("source_size") + F.col("before")).cast("double") + own / F.lit(2.0)
    share = middle / F.col("due")
    out = None
    for source, knots in by_source.items():
        hit = F.col("source").eqNullSafe(F.lit(source))
        out = F.when(hit, inverse(share, knots)) if out is None else out.when(hit, inverse(share, knots))
    for k, knots in enumerate(schedules):
        hit = F.col("nth") % len(schedules) == k
        out = F.when(hit, inverse(share, knots)) if out is None else out.when(hit, inverse(share, knots))
    return F.when(copy < F.col("copies"), out)


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_key"), *more)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, schedules: tuple[Knots, ...] = SCHEDULES, by_source: dict[str | None, Knots] | None = None,
) -> DataFrame:
    """One row per row of docs (columns doc_id, source, text): doc_id, size, source_size, target, taken, copies, position (of the
    first copy, null if none is taken), sorted by position.

    Weights and schedules go to the sources in code-point order, null last, repeating; by_source gives a source its own schedule.
    Edge cases: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own; sources without
    words have target 0; null and repeated ids are told apart by their texts, and rows that agree in both are interchangeable; an
    empty table gives an empty one; other columns are left out whatever their names; long texts are counted whole."""
    rows = written(_rows(docs), "mix-sizes")
    x = _placed(rows, rows.count(), weights, ceiling).withColumn("position", _position(F.lit(0), schedules, by_source or {}))
    return x.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def materialise(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, schedules: tuple[Knots, ...] = SCHEDULES, by_source: dict[str | None, Knots] | None = None,
) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy, range-sorted by position. The last copy of the one document
    where a source's target ends holds the words up to the target, joined by single spaces (n_chars, if there, follows)."""
    rows = _rows(docs, F.struct(*[col(c) for c in docs.columns]).alias("row"))
    x = _placed(rows, docs.count(), weights, ceiling).where("copies > 0")
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    x = x.withColumn("position", _position(F.col("copy"), schedules, by_source or {}))
    x = x.withColumn("cut", (F.col("copy") == F.col("passes")) & (F.col("last") < F.col("size")))
    text = F.col("row.text")
    single = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    x = x.withColumn("new_text", F.when(F.col("cut"), F.call_function("substring_index", single, F.lit(" "), F.col("last").cast("int"))).otherwise(text))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.col("new_text")
        elif c == "n_chars":
            value = F.when(F.col("cut"), F.length("new_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return x.orderBy("position", "key", "copy").select(*columns)
