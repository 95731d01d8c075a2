"""Image statistics on pixel tables (img_id, y, x, v: gray 0..255)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw


def histogram(pixels: DataFrame) -> DataFrame:
    """img_id, v (dense 0..255), n."""
    found = pixels.groupBy("img_id", "v").agg(F.count("*").alias("n"))
    dense = found.select("img_id").distinct().select("img_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return dense.join(found, ["img_id", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def otsu(pixels: DataFrame) -> DataFrame:
    """img_id, threshold: the level with the largest variance between both sides, the first on ties; 128 if one side is always
    empty."""
    up = Window.partitionBy("img_id").orderBy("v")
    every = Window.partitionBy("img_id")
    h = histogram(pixels).withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("v") * F.col("n")).over(up), "w": F.sum("n").over(every), "s": F.sum(F.col("v") * F.col("n")).over(every)})
    h = h.withColumn("w1", F.col("w") - F.col("w0"))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.col("w1")
    score = F.when((F.col("w0") > 0) & (F.col("w1") > 0), F.col("w0").cast("double") * F.col("w1") * gap * gap)
    best = h.withColumn("score", score).groupBy("img_id").agg(F.max_by("v", F.when(F.col("score").isNotNull(), F.struct("score", -F.col("v")))).alias("v"))
    return best.select("img_id", F.coalesce("v", F.lit(128)).alias("threshold"))


def binarise(pixels: DataFrame) -> DataFrame:
    """Above the image's threshold 255, else 0."""
    return pixels.join(otsu(pixels), "img_id").select("img_id", "y", "x", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def median3(pixels: DataFrame) -> DataFrame:
    """3x3 median with the edge extended: img_id, y, x, v, median. Each pixel goes to its nine neighbours, then one aggregation. Where
    pixels are missing it is the middle of the neighbours that exist, the upper one of two."""
    size = pixels.groupBy("img_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = pixels.join(size, "img_id").withColumn("shift", F.explode(shifts))
    # A target outside the page belongs to no pixel; an edge pixel stands in for its missing neighbours instead.
    near = spread.select("img_id", (F.col("y") + F.col("shift.dy")).alias("ty"), (F.col("x") + F.col("shift.dx")).alias("tx"), "h", "w", "v", "y", "x", "shift")
    inside = near.where((F.col("ty").between(0, F.col("h"))) & F.col("tx").between(0, F.col("w")))
    own = inside.select("img_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")
    outside = near.where(~(F.col("ty").between(0, F.col("h")) & F.col("tx").between(0, F.col("w"))))
    # For the page's edge: neighbour (y + dy, x + dx) of (y, x) clamps to a pixel on the edge.
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(c, top))
    wanted = outside.select("img_id", F.col("y").alias("py"), F.col("x").alias("px"), clamp(F.col("ty"), F.col("h")).alias("y"), clamp(F.col("tx"), F.col("w")).alias("x"))
    extra = wanted.join(pixels, ["img_id", "y", "x"]).select("img_id", F.col("py").alias("y"), F.col("px").alias("x"), "v")
    medians = own.union(extra).groupBy("img_id", "y", "x").agg(F.sort_array(F.collect_list("v")).alias("near"))
    medians = medians.select("img_id", "y", "x", F.element_at("near", (F.size("near") / 2).cast("int") + 1).alias("median"))
    return pixels.join(medians, ["img_id", "y", "x"])


def speck_ratio(filtered: DataFrame, jump: int = 40) -> DataFrame:
    """Share of pixels that the median moves by more than jump; filtered has v and median."""
    return filtered.groupBy("img_id").agg(F.avg((F.abs(F.col("v") - F.col("median")) > jump).cast("double")).alias("specks"))


def row_profile(pixels: DataFrame) -> DataFrame:
    """Ink by row."""
    return pixels.groupBy("img_id", "y").agg(F.sum(255 - F.col("v")).alias("ink"))


def profile_score(pixels: DataFrame) -> DataFrame:
    """Population variance of the change of ink from row to row: highest when lines are level."""
    rows = Window.partitionBy("img_id").orderBy("y")
    change = row_profile(pixels).withColumn("change", (F.col("ink") - F.lag("ink").over(rows)).cast("double"))
    return change.groupBy("img_id").agg(F.var_pop("change").alias("score"))


def vignette(pixels: DataFrame, strength: float) -> DataFrame:
    """Darken towards the corners: 1 - strength * r^2, r = 1 in the corner."""
    size = pixels.groupBy("img_id").agg((F.max("y") / F.lit(2.0)).alias("cy"), (F.max("x") / F.lit(2.0)).alias("cx"))
    x = pixels.join(size, "img_id")
    r2 = ((F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))) / F.greatest(F.col("cy") * F.col("cy") + F.col("cx") * F.col("cx"), F.lit(1e-9))
    return x.select("img_id", "y", "x", F.floor(F.col("v") * (F.lit(1.0) - F.lit(strength) * r2)).cast("int").alias("v"))


def salt_and_pepper(pixels: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """rate / 2 of the pixels become black and as many white, by a digest of their place."""
    u: Column = draw(1_000_000, F.lit(seed), F.col("img_id"), F.col("y"), F.col("x")) / F.lit(1e6)
    return pixels.withColumn("v", F.when(u < rate / 2, 0).when(u < rate, 255).otherwise(F.col("v")))


def remove_specks(pixels: DataFrame, jump: int = 40, share: float = 0.004) -> DataFrame:
    """The median of images with enough specks to be worth its blur, other images as they are: img_id, y, x, v."""
    filtered = median3(pixels)
    worth = speck_ratio(filtered, jump).where(F.col("specks") >= share).select("img_id", F.lit(True).alias("worth"))
    out = filtered.join(worth, "img_id", "left")
    return out.select("img_id", "y", "x", F.when(F.col("worth"), F.col("median")).otherwise(F.col("v")).alias("v"))
