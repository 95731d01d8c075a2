"""Truth and predictions with known deviations, for the evaluation queries; and texts with known damage.

A prediction differs from the truth by its document's number n (ord): n % 13 = 0 has none; n % 11 = 3 lacks giro; n % 11 = 5 has one more
letter in nombre_representante; n % 11 = 7 returns the own party's razon_social; n % 17 = 0 was predicted before, wrongly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIELDS, OWN


def _campos(values: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[values.get(f, F.col(f).cast("string")) for f in FIELDS]))


def predictions(rows: DataFrame) -> DataFrame:
    n = F.col("ord")
    changed = _campos(
        {
            "giro": F.when(n % 11 == 3, "").otherwise(F.col("giro")),
            "nombre_representante": F.when(n % 11 == 5, F.concat("nombre_representante", F.lit("x"))).otherwise(F.col("nombre_representante")),
            "razon_social": F.when(n % 11 == 7, OWN["razon_social"]).otherwise(F.col("razon_social")),
        }
    )
    record = lambda order, campos: [order.alias("ord"), "id_documento", F.concat("id_documento", F.lit(".pdf")).alias("origen"), F.when(n % 3 == 0, "tesseract").otherwise("nativo").alias("metodo"), F.lit(0.25).alias("segundos"), F.lit(1000).alias("caracteres"), campos.alias("campos")]
    good = rows.where(n % 13 != 0).select(*record(n * 2, changed))
    earlier = rows.where((n % 17 == 0) & (n % 13 != 0)).select(*record(n * 2 - 1, _campos({f: F.lit("?") for f in FIELDS})))
    return good.union(earlier)


def damaged(rendered: DataFrame) -> DataFrame:
    """Texts (texto) with damage by document: n % 11 = 3 alters the last body digit of the company's tax number (its check digit
    then rejects it), n % 11 = 5 drops the note's number, n % 11 = 7 misspells the representative."""
    n = F.col("ord")
    body = F.substring_index("rut_empresa", "-", 1)
    last = (F.substring(body, -1, 1).cast("int") + 1) % 10
    wrong = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), last.cast("string"), F.lit("-"), F.substring_index("rut_empresa", "-", -1))
    text = F.col("texto")
    return rendered.withColumn(
        "texto",
        F.when(n % 11 == 3, F.replace(text, F.col("rut_empresa"), wrong))
        .when(n % 11 == 5, F.replace(text, F.col("numero_pagare"), F.lit("")))
        .when(n % 11 == 7, F.replace(text, F.col("nombre_representante"), F.concat("nombre_representante", F.lit("x"))))
        .otherwise(text),
    )
