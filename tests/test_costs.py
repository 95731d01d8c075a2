"""Short cuts that save time give what the long way gives."""

import os
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from fieldloom.functions import identifiers, text
from fieldloom.operators import evaluate, extract
from fieldloom.sources import pdf

SF = "/root/testdata/sf0.001"


def test_letters_as_classes_are_folded_letters(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c string")
    letters = "abcdefghijklmnopqrstuvwxyz"
    forms = {c: (extract.letter(c), f"[{extract._MARKED.get(c, c)}]") for c in letters} | {c.upper(): (extract.letter(c, False), c) for c in letters}
    unlike = [F.count_if(F.col("c").rlike(f"(?U)^{new}$") != F.col("c").rlike(f"(?iU)^{old}$")).alias(k) for k, (new, old) in forms.items()]
    assert set(chars.agg(*unlike).first()) == {0}
    assert not any(re.search(r"\(\?\w*i", extract._FLAGS + p) for r in extract.RULES.values() for p in r.patterns)


def test_collapsed_like_split(spark):
    r = random.Random(3)
    spaces = [" ", "  ", "\t", "\n", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", "é", "​", "x", "ab"]
    rows = ["".join(r.choices(spaces, k=r.randrange(12))) for _ in range(2000)]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, x string").select("i", text.collapse(F.col("x")).alias("y")).orderBy("i").collect()
    assert [g.y for g in got] == [" ".join(x.split()) for x in rows]
    assert "(?=" in text._ODD_SPACES


def test_check_digits_of_any_length(spark):
    def sign(body):
        total = sum(int(d) * (2 + k % 6) for k, d in enumerate(reversed(body)))
        return "0123456789K"[(11 - total % 11) % 11]

    r = random.Random(4)
    bodies = ["0", "000", "9" * 18, "9" * 19, "0" * 30 + "7"] + ["".join(r.choices("0123456789", k=n)) for n in range(1, 45)]
    rows = spark.createDataFrame([(i, b, f"{b}-{sign(b)}") for i, b in enumerate(bodies)], "i int, b string, x string").orderBy("i")
    assert [x.s for x in rows.select(identifiers.check_digit(F.col("b")).alias("s")).collect()] == [sign(b) for b in bodies]
    for x in rows.select("x", identifiers.canonical_rut(F.col("x")).alias("c"), identifiers.checked_rut(F.col("x")).alias("v")).collect():
        assert x.v == (x.c or ""), x  # too long to be printed: nothing


def test_dates_behind_any_label_and_mid_word(spark):
    x = "reinicio: 1/2/2020 y FECHA  DE INICIO 03-04-2021, desde el 5 de mayo del 2022; ınıcıo 6.7.2023 y sin el 8/9/2024"
    row = spark.createDataFrame([(x,)], "x string").select(extract.candidates(text.collapse(F.col("x")), extract.RULES["fecha_inicio"].patterns).alias("c")).first()
    assert row.c == ["1/2/2020", "03-04-2021", "6.7.2023", "5 de mayo del 2022"]


def test_lines_like_textwrap():
    r = random.Random(1)
    for _ in range(4000):
        some = r.choice(["ab -é", "a ", "abc —- ", "ab\t \n", "a-b  \x1f"])
        t = "".join(r.choice(some) if r.random() < 0.4 else "x" for _ in range(r.choice([0, 1, 91, 92, 93, 94, 200, 400])))
        t = " ".join(t.split()) if r.random() < 0.7 else t
        assert pdf.broken(t) == textwrap.wrap(t, pdf.WIDTH, break_long_words=False, break_on_hyphens=False)
    hard = r"a (b) \c \(d\) é"
    assert pdf.read(pdf.write(hard)) == [hard]


def test_blanks_of_the_last_prediction(spark):
    rows = [(1, "a", {"x": "", "y": ""}), (2, "a", {"x": "", "y": "1", "z": None}), (1, "b", {"x": "2"}), (2, "b", None), (1, "c", {})]
    rows = spark.createDataFrame(rows, "ord long, id_documento string, campos map<string, string>")
    for some in (rows, rows.where("id_documento = 'b'"), rows.where("ord > 9")):
        got, want = evaluate.blanks_of_last(some), evaluate.blanks(evaluate.last_wins(some))
        assert got.collect() == want.collect() and got.dtypes == want.dtypes


def test_no_maps_are_sorted_for_one_value(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    for name in ("last_wins_dedupe", "blank_field_count"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan()
        windows = [plan]
        while windows and windows[0].nodeName() != "Window":
            n = windows.pop(0)
            windows += [n.children().apply(k) for k in range(n.children().size())]
        assert "MapType" not in windows[0].schema().toString() and "campos:map" not in windows[0].schema().simpleString()


def test_fields_that_a_query_does_not_ask_for_are_not_searched(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    plan = entry.queries()["prediction_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    rows = spark.createDataFrame([(1, "a", "plazo 12 meses"), (2, "b", None)], "ord long, id_documento string, texto string")
    got = extract.predictions(rows).orderBy("ord").collect()
    assert all(set(r.campos) == set(extract.FIELDS) for r in got) and [r.campos["plazo_meses"] for r in got] == ["12", ""]


def test_candidates_are_searched_once_for_both_choices(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    plan = entry.queries()["first_non_own"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(extract.RULES["giro"].patterns)


def test_metrics_need_no_row_for_each_value(spark, monkeypatch):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")

    def never(*_, **__):
        raise AssertionError("a row for each value")

    monkeypatch.setattr(evaluate, "compare", never)
    kept = spark._jsc.getPersistentRDDs().size()
    n = spark.read.parquet(f"{SF}/orders.parquet")
    assert entry.queries()["metrics_json"](spark, SF).first() == (15 * n.count(), n.where("(o_orderkey + 1) % 13 = 0").count())
    assert spark._jsc.getPersistentRDDs().size() == kept
