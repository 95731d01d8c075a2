"""Contracts from the star schema, by integer arithmetic on the order's and the customer's key: the same rows on every engine and
for every partitioning, and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.draws import draw as drawn_number
from ..functions.identifiers import let


#: So that the last task to end is a small share of the work.
TASKS_A_CORE = 4


def pick(words: tuple[str, ...] | str, nth: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (nth % len(words)).cast("int"))


def div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def doc_id(n: Column) -> Column:
    """SINT-0001; more digits if need be. Numbers that need no zeros aren't formatted."""
    return F.when((n > 999) | (n < -99), F.concat(F.lit("SINT-"), n.cast("string"))).otherwise(F.format_string("SINT-%04d", n))


def _rut(body: Column) -> Column:
    """A tax number with its check digit. Bodies are numbers of eight digits here, for any key. The sign is looked up in a lambda: that
    keeps the contract's projection out of whole-stage code, where all of it is one method (too long for the JIT, it seems: without the
    lambda contracts took twice the time)."""
    total = sum((F.call_function("div", body, F.lit(10**k)) % 10 * (k % 6 + 2) for k in range(1, 8)), body % 10 * 2)
    sign = let(total % 11, lambda r: F.substr(F.lit("0K987654321"), (r + 1).cast("int"), F.lit(1)))
    part = lambda at, n: F.substring(body.cast("string"), at, n)
    return F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("-"), sign)


def contracts(keys: DataFrame) -> DataFrame:
    """keys (i, c: bigint) -> ord, id_documento, plantilla, perfil_escaneo, ciudad and the fifteen fields, typed; other columns
    of keys follow."""
    i, c = F.col("i"), F.col("c")
    letters = [pick(S.PLATE_FIRST_LETTERS, i), *[pick(S.PLATE_LETTERS, div(i, k)) for k in (3, 54, 972)]]
    plate = F.concat(*letters, F.lpad((i % 100).cast("string"), 2, "0"))
    brands = tuple(S.BRANDS)
    models = F.array(*[F.array(*map(F.lit, S.BRANDS[b])) for b in brands])
    brand = (i % len(brands)).cast("int")
    office = F.when(c % 20 < 7, F.concat(F.lit(", oficina "), (c % 179 + 2).cast("string"))).otherwise("")
    address = F.concat(pick(S.STREET_TYPES, c), F.lit(" "), pick(S.STREETS, div(c, 3)), F.lit(" "), (c * 37 % 9900 + 100).cast("string"), office, F.lit(", "), pick(S.COMMUNES, c * 7))
    first = div(i, 7) % len(S.SURNAMES)
    person = F.concat_ws(" ", pick(S.FIRST_NAMES, i * 5 + 1), pick(S.SURNAMES, first), pick(S.SURNAMES, first + 1 + div(i, 3) % (len(S.SURNAMES) - 1)))
    start = F.date_add(F.lit(S.START_MIN).cast("date"), (i % 1642).cast("int"))
    term = F.get(F.array(*map(F.lit, S.TERMS)), (i % len(S.TERMS)).cast("int"))
    layout = F.when(i % 10 < 4, "formal").when(i % 10 < 7, "tabular").otherwise("compacta")
    return keys.select(
        (i + 1).alias("ord"),
        doc_id(i + 1).alias("id_documento"),
        layout.alias("plantilla"),
        pick((S.NO_PROFILE, *S.PROFILES), div(i, 10)).alias("perfil_escaneo"),
        pick(S.CITIES, i).alias("ciudad"),
        plate.alias("ppu"),
        pick(brands, i).alias("marca"),
        F.get(F.get(models, brand), (div(i, len(brands)) % 3).cast("int")).alias("modelo"),
        (i % (S.LAST_YEAR - S.FIRST_YEAR + 1) + S.FIRST_YEAR).cast("int").alias("ano"),
        F.concat_ws(" ", pick(S.COMPANY_CORES, c), pick(S.COMPANY_TRADES, div(c, 16)), pick(S.COMPANY_SUFFIXES, c)).alias("razon_social"),
        _rut((c * 7919 + 13) % 999_998 + S.RUT_COMPANY_FIRST + 2).alias("rut_empresa"),
        pick(S.TRADES, c * 3 + 1).alias("giro"),
        address.alias("domicilio"),
        person.alias("nombre_representante"),
        _rut((i * 104_729 + 7) % 9_999_998 + S.RUT_PERSON_FIRST + 2).alias("rut_representante"),
        F.date_format(start, "yyyy-MM-dd").alias("fecha_inicio"),
        F.date_format(F.add_months(start, term), "yyyy-MM-dd").alias("fecha_termino"),
        term.cast("int").alias("plazo_meses"),
        (F.lit(S.FEE_MIN) + i % ((S.FEE_MAX - S.FEE_MIN) // S.FEE_STEP + 1) * S.FEE_STEP).cast("bigint").alias("valor_cuota"),
        (i * 31 % (S.NOTE_MAX - S.NOTE_MIN + 1) + S.NOTE_MIN).cast("string").alias("numero_pagare"),
        *[k for k in keys.columns if k not in ("i", "c")],
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per order. A contract costs far more than its 16 bytes of key, so keys are dealt out evenly first: splits of a file
    hold whole row groups, many or none."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("c"))
    return rows.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def drawn(spark: SparkSession, n: int, seed: int, layout: str | None = None, profile: str = S.NO_PROFILE) -> DataFrame:
    """n contracts from a seed: every draw is a digest of seed, row and purpose, so rows don't depend on each other. profile may be
    mixto (any of the three) or ninguno."""
    if n < 1:
        raise ValueError("at least one contract")
    if layout is not None and layout not in S.LAYOUTS:
        raise ValueError(f"layouts: {', '.join(S.LAYOUTS)}")
    if profile not in (S.NO_PROFILE, S.MIXED_PROFILE, *S.PROFILES):
        raise ValueError(f"profiles: {', '.join((S.NO_PROFILE, S.MIXED_PROFILE, *S.PROFILES))}")

    def draw(what: str, k: int) -> Column:
        return drawn_number(k, F.lit(seed), F.col("id"), F.lit(what))

    made = contracts(spark.range(n).select("id", draw("contract", 1_749_600).alias("i"), draw("company", 999_998).alias("c")))
    choice, low = None, 0.0
    for name, share in S.LAYOUTS.items():
        low += share
        hit = draw("layout", 1_000_000) < F.lit(round(low * 1_000_000))
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    chosen = {
        "ord": F.col("id") + 1,
        "id_documento": doc_id(F.col("id") + 1),
        "plantilla": F.lit(layout) if layout else choice,
        "perfil_escaneo": pick(tuple(S.PROFILES), draw("profile", 3)) if profile == S.MIXED_PROFILE else F.lit(profile),
    }
    return made.withColumns(chosen).drop("id")


def truth_records(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Contracts as ground-truth records."""
    formats = None
    for name, values in S.FORMATS.items():
        value = F.struct(*[F.lit(v).alias(k) for k, v in zip(("fecha", "monto", "patente", "etiqueta_rut_persona"), values, strict=True)])
        formats = F.when(F.col("plantilla") == name, value) if formats is None else formats.when(F.col("plantilla") == name, value)
    scans = F.when(F.col("perfil_escaneo") == S.NO_PROFILE, F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.concat(F.lit("escaneos/"), "id_documento", F.lit("_p01.jpg"))))
    fields = F.map_from_arrays(F.array(*map(F.lit, S.FIELDS)), F.array(*[F.col(f).cast("string") for f in S.FIELDS]))
    return rows.select(
        "ord", "id_documento", "plantilla", "perfil_escaneo", F.lit(seed).alias("semilla"), formats.alias("formatos_usados"),
        F.struct(F.concat(F.lit("pdf/"), "id_documento", F.lit(".pdf")).alias("pdf"), scans.alias("escaneos")).alias("archivos"), fields.alias("campos"),
    )
