"""Finders give what the patterns give."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from fieldloom import schema as S
from fieldloom.functions import text
from fieldloom.operators import extract, leaps
from fieldloom.plans import predicted, render, synth
from fieldloom.sources import documents

SF = "/root/testdata/sf0.001"


def test_alphabet_has_the_same_classes_in_both_languages(spark):
    chars = spark.createDataFrame([(c,) for c in leaps.ALPHABET], "c string")
    for cls in (r"\w", r"\d", r"\s", r"\p{L}"):
        java = {r.c for r in chars.where(F.col("c").rlike(f"(?U){cls}")).collect()}
        assert java == {c for c in leaps.ALPHABET if leaps.compiled(cls).match(c)}, cls
    java = {r.c for r in chars.where(F.concat(F.lit("-"), "c", F.lit("-")).rlike(r"(?U)-\b.\b-")).collect()}
    assert java == {c for c in leaps.ALPHABET if re.match(r"-\b.\b-", f"-{c}-")}
    for c, k in ((r.c, r.k) for r in chars.select("c", F.lower(text.strip_accents(F.col("c"))).alias("k")).collect()):
        assert leaps._HINTS[ord(c)] == ord(k), c


def damaged_texts(n):
    r = random.Random(5)
    words = [w for f in extract.LABELS.values() for w in f] + [w for f in extract.ENDS.values() for w in f] + [w for s in extract.SENTENCES.values() for f in s for w in f]
    words += [*extract.PERSON_HINTS, *extract.COMPANY_HINTS, *extract.NUMBER_SIGNS, "meses", "pesos (", "$", "de", "Ñandú", "·", "—", "x", "º", "²", "ﬁ"]
    digits = ["1", "12", "123", "1234", "2017", "1.234", "99.453.789-K", "51110460-2", "51.110.460 - 2", "51 110 460-2", "3/4/2020", "3 - 4 - 2020", "5 de mayo de 2021", "7 DE Junio del 2022", "XKWT31", "XKWT-31", "XKWT·31", "XKWT 31"]
    case = lambda w: r.choice([w, w, w.upper(), w.lower(), text.bare(w), "".join(r.choice([c, c.upper()]) for c in w)])
    out = []
    for _ in range(n):
        some = [case(r.choice(words)) if r.random() < 0.55 else r.choice(digits) if r.random() < 0.8 else "".join(r.choices("aeioun nsk.:,-1(", k=r.randrange(1, 40))) for _ in range(r.randrange(1, 40))]
        out.append("".join(w + r.choice([" ", " ", " ", ": ", " : ", ":", ", ", ",", "", ".", "-"]) for w in some))
    return out


def test_finders_like_patterns(spark):
    contracts = render.render(synth.drawn(spark, 600, 11))
    rows = contracts.select("texto").union(predicted.damaged(contracts).select("texto"))
    r, whole = random.Random(6), [x.texto for x in rows.collect()]
    for x in whole[:600]:  # letters of a contract are lost, doubled or changed
        x = list(x)
        for _ in range(r.randrange(1, 60)):
            x[r.randrange(len(x))] = r.choice(["", " ", "-", ".", "á", "E", "n", "1", ":", "'"])
        whole.append("".join(x))
    docs = spark.createDataFrame([(x,) for x in [*whole, *damaged_texts(6000), "", None]], "t string").select(text.collapse(F.col("t")).alias("x")).repartition(4).cache()
    made = docs.withColumn("f", extract.found(F.col("x")))
    assert made.where("f.ppu_0 IS NOT NULL").count() > 0.6 * docs.count() > made.where("f.ppu_0 IS NULL").count() > 100
    pairs = [(f"f.{f}_{k}", extract.candidates(F.col("x"), (p,))) for f, rule in extract.RULES.items() for k, p in enumerate(rule.patterns)]
    pairs.append(("f.ruts", extract.rut_tokens(F.col("x"))))
    plain = made.where("f.ppu_0 IS NOT NULL")
    unlike = plain.agg(*[F.count_if(~F.col(name).cast("string").eqNullSafe(want.cast("string"))).alias(name[2:]) for name, want in pairs]).first().asDict()
    assert not any(unlike.values()), {k: n for k, n in unlike.items() if n}
    filled = plain.agg(*[F.count_if(F.size(name) > 0).alias(name[2:]) for name, _ in pairs]).first().asDict()
    assert all(n > 20 for n in filled.values()), filled


def test_whole_records_of_unusual_texts(spark):
    """An alphabet that the finders pass over: the patterns do the whole work."""
    rows = render.render(synth.drawn(spark, 30, 3))
    odd = rows.withColumn("texto", F.concat("texto", F.lit(" ﬁn — 文")))
    one, two = ([tuple(r) for r in extract.extract(x).orderBy("ord").select(*S.FIELDS).collect()] for x in (rows.drop(*S.FIELDS), odd.drop(*S.FIELDS)))
    assert one == two and all(None not in r for r in one)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_queries_use_the_finders(spark):
    for name in ("extract_all", "native_accuracy_by_layout", "prediction_records_ocr", "extract_ppu", "classify_ruts", "candidates_ordered"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan, name


def test_engines_are_checked_in_one_job(spark, monkeypatch):
    """Not in a few tasks first, then in more."""
    monkeypatch.setattr(documents, "_readers", {})
    documents.register("nativo", lambda b: [b.decode()])
    group = "engines-checked"
    files = spark.range(64).repartition(16).select(F.concat(F.lit("in/"), "id", F.lit(".pdf")).alias("path"), F.repeat(F.lit("a"), 300).cast("binary").alias("content"))
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = documents.read(files)
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds]
        assert [s.numTasks for s in stages if s.numTasks == 16], stages
        assert not [s for s in stages if s.numTasks == 4 and s.numCompletedTasks == 4 and s.name.startswith("isEmpty")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 64
