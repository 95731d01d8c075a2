"""Connected components of an edge table, by randomised contraction in Spark; and the one row of each that stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, free_name, let_go, written


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; root is the same for connected nodes and only for them.

    Each round every node points to the one of itself and its neighbours with the smallest hash, salted by the round, and edges
    move to what their ends point to; an expected constant share of the nodes drops out, so rounds grow with the logarithm of the
    longest chain. Every round is a written table, so lineage stays short. The pointers of all rounds are then followed back."""
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select("a", "b"), "edges")
    pointers = []
    while not edges.isEmpty():
        at = F.lit(len(pointers))
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", at), "b")).alias("m"), F.xxhash64("node", at).alias("own"))
        to = written(near.select("node", F.when(F.col("m.col1") < F.col("own"), F.col("m.b")).otherwise(F.col("node")).alias("to")), "pointers")
        pointers.append(to)
        moved = edges.join(to.toDF("a", "a2"), "a").join(to.toDF("b", "b2"), "b").where("a2 <> b2")
        moved = written(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        let_go(edges)
        edges = moved
    let_go(edges)
    if not pointers:
        return spark.createDataFrame([], "node long, root long")
    out = pointers[-1].toDF("node", "root")
    for to in reversed(pointers[:-1]):
        out = to.join(out.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    out = written(out, "roots")
    let_go(*pointers)
    return out


def keep_best(docs: DataFrame, fate: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, with all their columns. fate has a row for each of docs: doc_id, t (xxhash64 of the text) and best
    (struct of both, of the row of its group that stays). Of rows that agree in id and text one stays; rows without an id stay."""
    names = [free_name(docs, n) for n in ("_text_hash", "_drop_id", "_drop_hash")]
    h = names[0]
    ids = fate.where("doc_id IS NOT NULL")
    drop = ids.where(F.struct("doc_id", "t") > F.col("best")).select("doc_id", "t").distinct().toDF(*names[1:])
    twice = written(ids.groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t").toDF(*names[1:]), "repeated")
    own = (col(id_col) == col(names[1])) & (col(h) == col(names[2]))
    left = docs.withColumn(h, F.xxhash64(col(text_col))).join(drop, own, "left_anti")
    if not twice.isEmpty():
        again = left.join(twice, own, "left_semi").withColumn(names[1], F.row_number().over(Window.partitionBy(col(id_col), col(h)).orderBy(F.lit(0))))
        left = left.join(twice, own, "left_anti").unionByName(again.where(col(names[1]) == 1).drop(names[1]))
    return left.drop(h)
