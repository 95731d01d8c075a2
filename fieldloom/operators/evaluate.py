"""Predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, similarity
from ..schema import FIELDS, OWN, UNKNOWN


def last_wins(predictions: DataFrame) -> DataFrame:
    """Of several predictions for a document the last one."""
    last = Window.partitionBy("id_documento").orderBy(F.desc("ord"))
    return predictions.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def missing(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Documents of truth without a prediction."""
    return truth.join(predictions.select("id_documento"), "id_documento", "left_anti")


def state(expected: Column, got: Column) -> Column:
    return F.when(expected == got, "correcto").when(got == "", "omitido").otherwise("incorrecto")


def unpivot(records: DataFrame, column: str = "campos", value: str = "valor") -> DataFrame:
    """A row per record and field, in field order; a field that isn't there is empty."""
    rows = records.select("*", F.posexplode(F.array(*map(F.lit, FIELDS))).alias("ord_campo", "campo"))
    return rows.withColumn(value, F.coalesce(F.try_element_at(column, F.col("campo")), F.lit(""))).drop(column)


def paired(truth: DataFrame, predictions: DataFrame, *more: str) -> DataFrame:
    """A row per record of truth: ord, id_documento, more (columns of truth), the values on both sides in field order (esperados,
    obtenidos; null where there is none) and whether there is a prediction (hay). Values are taken out of their maps first, so that rows
    are dealt out and sorted without the names of the fields."""
    names, campos = F.array(*map(F.lit, FIELDS)), F.col("campos")
    values = F.when(F.map_keys(campos) == names, F.map_values(campos)).otherwise(F.transform(names, lambda f: F.try_element_at(campos, f)))
    got = last_wins(predictions.select("ord", "id_documento", values.alias("obtenidos"))).select("id_documento", "obtenidos", F.lit(True).alias("hay"))
    rows = truth.select("ord", "id_documento", *more, values.alias("esperados")).join(got, "id_documento", "left")
    return rows.withColumn("hay", F.coalesce("hay", F.lit(False)))


def _right(expected: Column, got: Column) -> Column:
    """Whether values are equal when collapsed; those that are equal as they are need not be."""
    return F.when(expected.eqNullSafe(got), F.lit(True)).otherwise(collapse(expected) == collapse(got))


def with_similarity_of(rows: DataFrame) -> DataFrame:
    """Similarity (similitud) in Python, on wrong values only."""
    wrong = F.col("estado") == "incorrecto"
    ratio = similarity(F.when(wrong, F.col("esperado")), F.when(wrong, F.col("obtenido")))
    return rows.withColumn("ratio", ratio).withColumn("similitud", F.coalesce("ratio", F.when(F.col("estado") == "correcto", 1.0).otherwise(0.0))).drop("ratio")


def compare(truth: DataFrame, predictions: DataFrame, with_similarity: bool = True) -> DataFrame:
    """One row per record of truth and field (schema COMPARISON). Documents without a prediction count as not read; predictions
    without truth are passed over. Similarity runs in Python on wrong values only."""
    rows = paired(truth, predictions).select("ord", "id_documento", F.posexplode(F.array(*map(F.lit, FIELDS))).alias("ord_campo", "campo"), "esperados", "obtenidos")
    rows = rows.select("ord", "id_documento", "ord_campo", "campo", F.get("esperados", F.col("ord_campo")).alias("e"), F.get("obtenidos", F.col("ord_campo")).alias("o"))
    e, o = F.col("e"), F.col("o")
    found = F.when(_right(e, o), "correcto").otherwise(state(collapse(e), collapse(o)))
    rows = rows.select("ord", "id_documento", "ord_campo", "campo", collapse(e).alias("esperado"), collapse(o).alias("obtenido"), found.alias("estado"))
    return with_similarity_of(rows) if with_similarity else rows.withColumn("similitud", F.lit(None).cast("double"))


def packed(truth: DataFrame, predictions: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """What compare finds (without similarity), as one row per record of truth that holds no values but those that aren't right: ord,
    id_documento, hay, the dimensions of the document's last record, fallas (the rows of compare that aren't right), propios (the fields that
    returned the own party's value); entero (all records of the document are right in every field) and primero (true once a document)."""
    nth = lambda side, n: F.get(side, n)
    unlike = F.filter(F.array(*map(F.lit, range(len(FIELDS)))), lambda n: ~nth("esperados", n).eqNullSafe(nth("obtenidos", n)))
    names = F.array(*map(F.lit, FIELDS))
    row = lambda n: F.struct(n.alias("ord_campo"), F.get(names, n).alias("campo"), collapse(nth("esperados", n)).alias("esperado"), collapse(nth("obtenidos", n)).alias("obtenido"))
    wrong = F.filter(F.transform(unlike, row), lambda r: r["esperado"] != r["obtenido"])
    own = F.array(*[F.struct(F.lit(FIELDS.index(f)).alias("n"), F.lit(f).alias("campo"), F.lit(v).alias("valor"), F.lit(v.split()[0]).alias("palabra")) for f, v in OWN.items()])
    hit = lambda o: nth("obtenidos", o["n"]).contains(o["palabra"]) & (collapse(nth("obtenidos", o["n"])) == o["valor"])
    rows = paired(truth, predictions, *dimensions).select("ord", "id_documento", "hay", *dimensions, wrong.alias("fallas"), F.filter(own, hit)["campo"].alias("propios"))
    same = Window.partitionBy("id_documento").orderBy("id_documento")  # rows come from the join in this order
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "ord", "id_documento", "hay", "fallas", "propios", F.max(F.struct("ord", *dimensions)).over(whole).alias("_last"),
        F.bool_and(F.size("fallas") == 0).over(whole).alias("entero"), (F.row_number().over(same) == 1).alias("primero"),
    )
    value = lambda d: F.coalesce(F.when(F.col("id_documento").isNotNull(), F.col("_last")[d].cast("string")), F.lit(UNKNOWN))
    return rows.select("*", *[value(d).alias(d) for d in dimensions]).drop("_last")


def failed(packs: DataFrame, *more: str) -> DataFrame:
    """The rows of compare that aren't right, without similarity; and other columns of packs."""
    rows = packs.select("ord", "id_documento", *more, F.inline("fallas"))
    return rows.withColumn("estado", state(F.col("esperado"), F.col("obtenido"))).withColumn("similitud", F.lit(None).cast("double"))


def counted(packs: DataFrame, dimensions: tuple[str, ...], with_similarity: bool) -> DataFrame:
    """The accumulators of every metric by field and dimensions: what isn't right is counted, the rest of the documents is."""
    bad = failed(packs, *dimensions)
    bad = (with_similarity_of(bad) if with_similarity else bad).groupBy("campo", *dimensions).agg(*counts()).drop("total", "correctos")
    rows = packs.groupBy(*dimensions).agg(F.count("*").alias("total")).crossJoin(F.broadcast(_fields(packs.sparkSession))).join(bad, ["campo", *dimensions], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("incorrectos", "omitidos")}).withColumn("correctos", F.col("total") - F.col("incorrectos") - F.col("omitidos"))
    return rows.withColumn("suma", F.coalesce("suma", F.lit(0.0)) + (F.col("correctos").cast("double") if with_similarity else F.lit(0.0)))


def added(found: DataFrame, *by: str) -> DataFrame:
    """Metrics from counted, by the values of columns; by field all fields in order."""
    rows = found.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "correctos", "incorrectos", "omitidos")], F.coalesce(F.sum("suma"), F.lit(0.0)).alias("suma"))
    return _of_fields(rows) if by == ("campo",) else _rates(rows)


def _rates(rows: DataFrame) -> DataFrame:
    """Counts to rates; an empty group has rates of zero."""
    share = lambda c: F.coalesce(F.col(c) / F.expr("nullif(total, 0)"), F.lit(0.0))
    return rows.withColumns({"exactitud": share("correctos"), "tasa_error": share("incorrectos"), "tasa_omision": share("omitidos"), "similitud_media": share("suma")}).drop("suma")


def counts() -> list[Column]:
    """The accumulator of every metric, so that Spark combines it on the map side."""
    one = lambda s: F.count_if(F.col("estado") == s)
    return [F.count("*").alias("total"), one("correcto").alias("correctos"), one("incorrecto").alias("incorrectos"), one("omitido").alias("omitidos"), F.coalesce(F.sum("similitud"), F.lit(0.0)).alias("suma")]


def summary(results: DataFrame) -> DataFrame:
    return _rates(results.agg(*counts()))


def _fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FIELDS)), "ord_campo int, campo string")


def by_field(results: DataFrame) -> DataFrame:
    """All fields in order, also those without rows."""
    return _of_fields(results.groupBy("campo").agg(*counts()))


def _of_fields(found: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "correctos", "incorrectos", "omitidos")} | {"suma": F.coalesce("suma", F.lit(0.0))}
    return _rates(_fields(found.sparkSession).join(found, "campo", "left").withColumns(zero))


def by_document(results: DataFrame) -> DataFrame:
    """documentos, completos (every field right), exactitud."""
    return _whole(results.groupBy("id_documento").agg(F.bool_and(F.col("estado") == "correcto").alias("entero")))


def by_document_of(packs: DataFrame) -> DataFrame:
    """The same from packed."""
    return _whole(packs.where("primero"))


def _whole(documents: DataFrame) -> DataFrame:
    out = documents.agg(F.count("*").alias("documentos"), F.count_if("entero").alias("completos"))
    return out.withColumn("exactitud", F.coalesce(F.col("completos") / F.expr("nullif(documentos, 0)"), F.lit(0.0)))


def _with_dimensions(results: DataFrame, truth: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    last = Window.partitionBy("id_documento").orderBy(F.desc("ord"))
    values = truth.select("id_documento", "ord", *dimensions).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "ord")
    rows = results.join(values, "id_documento", "left")
    return rows.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)) for d in dimensions})


def breakdown(results: DataFrame, truth: DataFrame, dimension: str) -> DataFrame:
    """Metrics by the value of a column of truth, sorted."""
    return _rates(_with_dimensions(results, truth, (dimension,)).groupBy(dimension).agg(*counts())).orderBy(dimension)


def breakdowns(results: DataFrame, truth: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Metrics for each value of each dimension in one pass: dimension, valor and the metrics."""
    rows = _with_dimensions(results, truth, dimensions)
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(*counts(), *[F.grouping(d).alias(f"_{d}") for d in dimensions])
    which = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.col(d)) for d in dimensions])
    return _rates(sets.withColumn("dimension", which).withColumn("valor", value).drop(*dimensions, *[f"_{d}" for d in dimensions]))


def worst_fields(results: DataFrame, limit: int = 5) -> DataFrame:
    """The fields with the lowest accuracy below 1, ties in field order."""
    return by_field(results).where("exactitud < 1").orderBy("exactitud", "ord_campo").limit(limit)


def failures(results: DataFrame, limit: int = 3) -> DataFrame:
    """The first failures of every field, in order of the truth."""
    first = Window.partitionBy("campo").orderBy("ord")
    return results.where("estado <> 'correcto'").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)


def own_party(results: DataFrame) -> DataFrame:
    """How often a field returned the own party's value: campo, cantidad; fields without a case are left out."""
    own = results.sparkSession.createDataFrame(list(OWN.items()), "campo string, propio string")
    hit = results.join(own, "campo").where((F.col("obtenido") == F.col("propio")) & (F.col("obtenido") != ""))
    return hit.groupBy("campo").agg(F.count("*").alias("cantidad"))


def own_party_ranked(results: DataFrame) -> DataFrame:
    """The same, most frequent first, with their rank (nth); at most one row for each field."""
    order = Window.orderBy(F.desc("cantidad"), "campo")
    return own_party(results).withColumn("nth", F.row_number().over(order))


def own_party_total(results: DataFrame) -> DataFrame:
    """All of these cases (total)."""
    return own_party(results).agg(F.coalesce(F.sum("cantidad"), F.lit(0)).alias("total"))


def first_ids(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The first documents in order of ord: nth, id_documento."""
    first = rows.orderBy("ord").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("ord")).alias("nth"), "id_documento")


def blanks(predictions: DataFrame) -> DataFrame:
    """campos (number of fields), en_blanco (fields that weren't read)."""
    value = F.explode(F.map_values("campos")).alias("valor")
    return predictions.select(value).agg(F.count("*").alias("campos"), F.count_if(F.col("valor") == "").alias("en_blanco"))


def blanks_of_last(predictions: DataFrame) -> DataFrame:
    """blanks() of the last prediction for each document. Records are counted before they are dealt out, so that counts are sorted, not maps."""
    values = F.map_values("campos")
    each = predictions.select("id_documento", "ord", F.size(values).alias("n"), F.size(F.filter(values, lambda v: v == "")).alias("blank"))
    total = lambda c: F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0))), F.lit(0))
    return last_wins(each).agg(total("n").alias("campos"), total("blank").alias("en_blanco"))


def methods(predictions: DataFrame) -> DataFrame:
    """metodo, documentos, segundos, media."""
    return predictions.groupBy("metodo").agg(F.count("*").alias("documentos"), F.sum("segundos").alias("segundos"), F.avg("segundos").alias("media"))
