import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dates, identifiers, numbers, text


def column(spark, build, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def independent_sign(body):
    total, factor = 0, 2
    for d in reversed(str(body)):
        total += int(d) * factor
        factor = 2 if factor == 7 else factor + 1
    return {11: "0", 10: "K"}.get(11 - total % 11, str(11 - total % 11))


def test_check_digit(spark):
    bodies = [1, 12, 11111111, 99000001, 50000001, *range(99_000_000, 99_000_400)]
    assert column(spark, identifiers.check_digit, bodies, "long") == [independent_sign(b) for b in bodies]
    with pytest.raises(Exception, match="no digit"):
        column(spark, identifiers.check_digit, ["abc"])


def test_rut(spark):
    assert column(spark, lambda v: identifiers.format_rut(v, F.lit("7")), ["99123456", "0099123456"]) == ["99.123.456-7"] * 2
    bad = ["99.123.456-0", "99123456", "", "-", "abc-1", None]
    assert column(spark, identifiers.rut_valid, [*bad, "99.453.789-K", "99453789-k"]) == [False] * 6 + [True, True]
    read = ["99453789-K", "99.453.789-K", "99 453 789-k", "99.453.789-3", "", None]
    assert column(spark, identifiers.checked_rut, read) == ["99.453.789-K"] * 3 + [""] * 3
    assert column(spark, lambda v: identifiers.checked_rut(v, True), ["994S3789-K", "11111111-9", "9945378g-K"]) == ["99.453.789-K", "", ""]
    assert column(spark, identifiers.canonical_rut, ["99.123.456—7"]) == ["9.912.345-6"]  # an em dash is no separator here


def test_plates(spark):
    assert column(spark, identifiers.canonical_plate, ["YWXT31", "YWXT-31", "YWXT·31", "ywxt 31", None]) == ["YWXT31"] * 4 + [""]
    assert column(spark, identifiers.plate_shape, ["ABC12", "BCDF123", "BCDF-12", "bcdf12", "", "BCDF12\n", "BCDF12"]) == [False] * 6 + [True]
    assert column(spark, identifiers.plate_letters, ["BCDF12", "ABCD12", "MBCD12"]) == [True, False, False]
    assert column(spark, identifiers.checked_plate, ["XKDF12", "XKOF12", "XK12"]) == ["XKDF12", "", "XK12"]


def test_dates(spark):
    same = ["07/06/2022", "07-06-2022", "07.06.2022", "7/6/2022", "7 de junio de 2022", "7 de junio del 2022", "el 7 de JUNIO de 2022, hoy", "desde 07 / 06 / 2022 y"]
    assert column(spark, dates.parse_date, same) == ["2022-06-07"] * 8
    assert column(spark, dates.parse_date, ["", None, "sin fecha", "32/13/2022", "31 de febrero de 2022", "31/02/2022 o 7 de junio de 2022"]) == [""] * 6
    days = [datetime.date(2022, 6, 7), datetime.date(2024, 12, 31)]
    assert column(spark, dates.in_words, days, "date") == ["7 de junio de 2022", "31 de diciembre de 2024"]
    assert column(spark, lambda v: dates.in_digits(v, "-"), days, "date") == ["07-06-2022", "31-12-2024"]


def test_months_between_inverts_adding(spark):
    starts = [datetime.date(2023, 1, 1) + datetime.timedelta(n) for n in range(400)]
    for months in (1, 12, 18, 25):
        assert set(column(spark, lambda v: dates.months_between(v, F.add_months(v, months)), starts, "date")) == {months}


def test_money(spark):
    assert column(spark, numbers.parse_money, ["$205.000", "$205.000.-", "205.000", "Renta mensual $205.000", "doscientos cinco mil pesos ($205.000)", "sin monto", None]) == [205000] * 5 + [None] * 2
    assert column(spark, numbers.parse_int, ["36 meses", "x12", "plazo 7, 8", None]) == [36, None, 7, None]


def test_number_words(spark):
    cases = {
        0: "cero", 21: "veintiuno", 100: "cien", 101: "ciento uno", 1000: "mil", 21000: "veintiún mil", 31000: "treinta y un mil", 101000: "ciento un mil",
        205000: "doscientos cinco mil", 999999: "novecientos noventa y nueve mil novecientos noventa y nueve", 1001: "mil uno", 500: "quinientos",
    }
    assert column(spark, numbers.number_words, list(cases), "long") == list(cases.values())
    assert column(spark, numbers.with_suffix, [450000], "long") == ["$450.000.-"]
    with pytest.raises(Exception, match="999,999"):
        column(spark, numbers.number_words, [1_000_000], "long")


def test_text(spark):
    assert column(spark, text.clean, ["  Loma  Blanca   Transportes S.A. ,", "a  b\x1c;", None]) == ["Loma Blanca Transportes S.A.", "a b", ""]
    words = ["Valparaíso Concepción", "Ñuñoa nº", "ﬁ ½ Ω", None]
    bare = ["".join(c for c in unicodedata.normalize("NFKD", w or "") if not unicodedata.combining(c)) for w in words]
    assert column(spark, text.strip_accents_any, words) == bare
    assert column(spark, text.strip_accents, words[:2]) == bare[:2]
    assert column(spark, text.lax, ["Avenida Los Pinos 1450, piso 6"]) == ["avenidalospinos1450piso6"]
    assert column(spark, text.useful, ["x" * 199, "x" * 200, "", None]) == [False, True, False, False]
    assert column(spark, text.ellipsis, ["x" * 46, "x" * 47, "", None]) == ["x" * 46, "x" * 45 + "…", "(vacio)", "(vacio)"]
    assert column(spark, text.percent, [0.944], "double") == ["  94.4%"]


def test_similarity(spark):
    rows = spark.createDataFrame([("Kargo", "Karqo"), ("Kargo", None)], "a string, b string")
    assert [r.s for r in rows.select(text.similarity("a", "b").alias("s")).collect()] == [0.8, None]
