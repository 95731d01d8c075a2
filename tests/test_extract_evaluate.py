import pytest
from pyspark.sql import functions as F

from fieldloom import schema as S
from fieldloom.operators import evaluate, extract
from fieldloom.plans import predicted, render, report, synth
from fieldloom.sources import records

PERFECT = {
    "ppu": "YWXT31", "marca": "Kirumo", "modelo": "Kargo", "ano": "2017", "razon_social": "Loma Blanca Transportes S.A.", "rut_empresa": "99.453.789-K",
    "giro": "Transporte de carga por carretera", "domicilio": "Pasaje El Peumo 4463, Valparaíso", "nombre_representante": "Tamara Donoso Lagos",
    "rut_representante": "50.513.214-9", "fecha_inicio": "2022-06-07", "fecha_termino": "2023-06-07", "plazo_meses": "12", "valor_cuota": "205000", "numero_pagare": "126681",
}


def truth(spark, n=2):
    rows = [(i, f"SINT-{i:04d}", ["formal", "tabular"][i % 2], "limpio", PERFECT) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "ord long, id_documento string, plantilla string, perfil_escaneo string, campos map<string, string>")


def predictions(spark, *changes):
    rows = [(i, f"SINT-{i:04d}", PERFECT | c) for i, c in enumerate(changes, 1) if c is not None]
    return spark.createDataFrame(rows, "ord long, id_documento string, campos map<string, string>")


def drawn(spark, n=240):
    return synth.drawn(spark, n, 2026, profile=S.MIXED_PROFILE).cache()


def test_native_text_is_read_without_error(spark):
    rows = drawn(spark)
    assert {r.plantilla for r in rows.select("plantilla").distinct().collect()} == set(S.LAYOUTS)
    found = evaluate.compare(synth.truth_records(rows), extract.predictions(render.render(rows)))
    wrong = found.where("estado <> 'correcto'").collect()
    assert not wrong, wrong[:3]
    assert evaluate.own_party(found).count() == 0
    assert evaluate.by_document(found).first().exactitud == 1.0


def test_draws_do_not_depend_on_partitions_or_layout(spark):
    a = drawn(spark, 50).orderBy("ord").drop("plantilla").collect()
    b = synth.drawn(spark, 50, 2026, layout="formal", profile=S.MIXED_PROFILE).repartition(7).orderBy("ord").drop("plantilla").collect()
    assert a == b
    for bad in (dict(n=0), dict(n=1, layout="x"), dict(n=1, profile="x")):
        with pytest.raises(ValueError):
            synth.drawn(spark, bad.pop("n"), 1, **bad)


def test_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(1, "SINT-0001", ""), (2, "SINT-0002", None)], "ord long, id_documento string, texto string")
    for r in extract.predictions(rows).collect():
        assert set(r.campos) == set(S.FIELDS) and set(r.campos.values()) == {""}


def test_ruts_by_context(spark):
    text = "RUT EMP.: 99.283.060-3 GIRO: x DOMICILIO: y REP. LEGAL: Ana Soto RUT: 51.110.460-2 y 😀 sin nada " + "z" * 80 + " 11.111.111-1"
    row = spark.createDataFrame([(text,)], "t string").select(extract.rut_tokens(F.col("t")).alias("r")).select(extract.ruts_of(F.col("r"), "company").alias("c"), extract.ruts_of(F.col("r"), "person").alias("p")).first()
    assert (row.c, row.p) == (["99.283.060-3"], ["51.110.460-2"])


def test_altered_check_digit_is_left_out(spark):
    rows = spark.createDataFrame([("RUT empresa 99.453.789-9 Giro",)], "texto string")
    assert extract.extract(rows, fields=("rut_empresa",)).first().rut_empresa is None


def test_states(spark):
    cases = [("Kargo", "Kargo", "correcto"), ("Kargo", "", "omitido"), ("Kargo", "Karqo", "incorrecto"), ("2017", "2017", "correcto"), ("", "", "correcto")]
    rows = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r.want == r.got for r in rows.select("want", evaluate.state(F.col("a"), F.col("b")).alias("got")).collect())
    found = evaluate.compare(truth(spark, 1), predictions(spark, {"razon_social": "  Loma   Blanca Transportes S.A. ", "modelo": "Karqo"}))
    by = {r.campo: r for r in found.collect()}
    assert by["razon_social"].estado == "correcto" and by["modelo"].estado == "incorrecto" and 0.5 < by["modelo"].similitud < 1


def test_metrics(spark):
    found = evaluate.compare(truth(spark), predictions(spark, {}, {"modelo": "x"})).cache()
    s, d = evaluate.summary(found).first(), evaluate.by_document(found).first()
    assert (s.total, s.correctos) == (30, 29) and (d.documentos, d.completos, d.exactitud) == (2, 1, 0.5)
    assert {r.plantilla: r.correctos for r in evaluate.breakdown(found, truth(spark), "plantilla").collect()} == {"tabular": 15, "formal": 14}
    sets = {(r.dimension, r.valor): r.total for r in evaluate.breakdowns(found, truth(spark), S.DIMENSIONS).collect()}
    assert sets == {("plantilla", "formal"): 15, ("plantilla", "tabular"): 15, ("perfil_escaneo", "limpio"): 30}


def test_missing_and_repeated_predictions(spark):
    got = predictions(spark, {})
    assert [r.id_documento for r in evaluate.missing(truth(spark), got).collect()] == ["SINT-0002"]
    d = evaluate.by_document(evaluate.compare(truth(spark), got)).first()
    assert (d.documentos, d.completos) == (2, 1)
    twice = got.union(spark.createDataFrame([(0, "SINT-0001", {"ppu": "?"})], got.schema))
    assert evaluate.by_document(evaluate.compare(truth(spark, 1), twice)).first().completos == 1


def test_own_party_worst_and_examples(spark):
    changes = [{"modelo": "", "marca": ""}, {"modelo": ""}, {"modelo": ""}, {"razon_social": S.OWN["razon_social"]}]
    found = evaluate.compare(truth(spark, 4), predictions(spark, *changes)).cache()
    assert [(r.campo, r.cantidad) for r in evaluate.own_party(found).collect()] == [("razon_social", 1)]
    assert [r.campo for r in evaluate.worst_fields(found).collect()] == ["modelo", "marca", "razon_social"]
    assert [r.id_documento for r in evaluate.failures(found, 2).where("campo = 'modelo'").orderBy("nth").collect()] == ["SINT-0001", "SINT-0002"]


def test_empty_tables(spark):
    found = evaluate.compare(truth(spark, 1).where("ord > 9"), predictions(spark, {}))
    assert evaluate.summary(found).first().exactitud == 0.0
    assert evaluate.by_field(found).count() == 15
    assert evaluate.by_document(found).first().exactitud == 0.0


def test_report_and_json(spark, tmp_path):
    rows = drawn(spark, 40)
    truth_, got = synth.truth_records(rows), predicted.predictions(rows)
    found = report.gather(evaluate.compare(truth_, got).cache(), truth_, got)
    text = report.text(found, "prueba")
    assert "prueba" in text and "## By campo" in text and "## By plantilla" in text and "3 documents have no prediction" in text
    assert '"missing"' in report.as_json(found)
    report.write(found, evaluate.compare(truth_, got), f"{tmp_path}/r")
    assert records.read_results(spark, f"{tmp_path}/r/resultados").count() == 600


def _odd(spark):
    """Documents with two records, without an id, without values, with fields in another order, and predictions of all sorts."""
    turned = dict(reversed(PERFECT.items()))
    rows = [(i, f"SINT-{i:04d}", ["formal", "tabular", None][i % 3], ["limpio", "medio"][i % 2], PERFECT if i % 4 else turned) for i in range(1, 25)]
    rows += [(30, "SINT-0003", "compacta", None, PERFECT | {"ppu": "otra"}), (31, None, "formal", "medio", PERFECT), (32, None, "formal", "medio", {}), (33, "SINT-0033", "formal", "medio", None)]
    truth_ = spark.createDataFrame(rows, "ord long, id_documento string, plantilla string, perfil_escaneo string, campos map<string, string>")
    own = S.OWN["razon_social"].replace(" ", " \t ")
    changes = {2: {"giro": ""}, 3: {"razon_social": own}, 4: {"ppu": " YWXT31\n", "modelo": None}, 5: {"rut_empresa": S.OWN["rut_empresa"]}, 6: {"giro": "x", "ano": "2018"}, 8: {"razon_social": own}}
    got = [(i, f"SINT-{i:04d}", (turned if i % 5 == 0 else PERFECT) | changes.get(i, {})) for i in range(1, 20)]
    got += [(0, "SINT-0002", {"ppu": "?"}), (50, "SINT-0007", {"ppu": "?", "otro": "x"}), (51, "SINT-0009", None), (52, None, PERFECT), (53, "SINT-9999", PERFECT), (54, "SINT-0033", {})]
    return truth_, spark.createDataFrame(got, "ord long, id_documento string, campos map<string, string>")


@pytest.mark.parametrize("with_similarity", [True, False])
def test_measured_like_gathered(spark, with_similarity):
    import json

    truth_, got = _odd(spark)
    for made in (truth_, truth_.where("ord > 99")):
        long = report.gather(evaluate.compare(made, got, with_similarity).cache(), made, got)
        short = report.measure(made, got, with_similarity)
        assert json.loads(report.as_json(short), parse_float=lambda x: round(float(x), 9)) == json.loads(report.as_json(long), parse_float=lambda x: round(float(x), 9))
        assert report.text(short) == report.text(long)


def test_malformed_lines_are_errors(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id_documento": "a", "campos": {}}\n\n{"id_documento": "b", \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        records.read_truth(spark, str(tmp_path / "m.jsonl")).collect()
    (tmp_path / "n.jsonl").write_text('{"id_documento": "a", "campos": {"ano": 2017}}\n \n{"id_documento": "b"}\n')
    assert [(r.id_documento, r.campos) for r in records.read_truth(spark, str(tmp_path / "n.jsonl")).orderBy("ord").collect()] == [("a", {"ano": "2017"}), ("b", None)]


def test_similarity_against_its_definition(spark):
    """Twice the matching characters over all, where matches are the longest common block and, recursively, those beside it."""
    import random

    from fieldloom.functions.text import similarity

    def matches(a, b):
        best = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), default=(0, 0, 0))
        k, i, j = best[0], -best[1], -best[2]
        return k and k + matches(a[:i], b[:j]) + matches(a[i + k :], b[j + k :])

    rng = random.Random(4)
    pairs = [("".join(rng.choice("abcñ ") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abcñ ") for _ in range(rng.randint(0, 12)))) for _ in range(300)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.s for r in frame.select("i", similarity("a", "b").alias("s")).collect()}
    assert got == {i: round(2 * matches(a, b) / (len(a) + len(b)), 4) if a or b else 1.0 for i, (a, b) in enumerate(pairs)}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    """Generate, extract from the PDFs and evaluate; missing inputs and a second, cleaned batch."""
    from fieldloom.__main__ import main
    from fieldloom.sources import documents

    monkeypatch.setattr(documents, "_readers", {})
    out = str(tmp_path)
    assert main(["extract", "--entrada", f"{out}/nowhere", "--salida", f"{out}/p"]) == 1
    assert main(["evaluate", "--predicciones", f"{out}/p", "--ground-truth", f"{out}/manifiesto"]) == 1
    assert main(["generate", "--cantidad", "6", "--salida", out, "--solo-pdf"]) == 0
    assert main(["extract", "--entrada", f"{out}/pdf", "--motor", "auto", "--salida", f"{out}/p"]) == 0
    assert main(["evaluate", "--predicciones", f"{out}/p", "--ground-truth", f"{out}/manifiesto", "--json", f"{out}/m"]) == 0
    assert "100.0% of 90 values are right" in capsys.readouterr().out
    done = records.read_predictions(spark, f"{out}/p").collect()
    assert {(r.metodo, r.origen) for r in done} == {("nativo", f"SINT-000{i}.pdf") for i in range(1, 7)} and all(r.segundos >= 0 for r in done)
    assert main(["extract", "--entrada", f"{out}/pdf/SINT-0002.pdf", "--motor", "nativo", "--salida", f"{out}/q"]) == 0
    assert [r.id_documento for r in records.read_predictions(spark, f"{out}/q").collect()] == ["SINT-0002"]
    assert main(["generate", "--cantidad", "2", "--salida", out, "--solo-pdf", "--limpiar"]) == 0
    assert sorted(p.name for p in (tmp_path / "pdf").glob("*.pdf")) == ["SINT-0001.pdf", "SINT-0002.pdf"]


def test_records_round_trip(spark, tmp_path):
    made = synth.truth_records(drawn(spark, 20))
    records.write_lines(made, f"{tmp_path}/m")
    assert sorted(records.read_truth(spark, f"{tmp_path}/m").collect()) == sorted(made.collect())
    lacking = made.withColumn("campos", F.map_filter("campos", lambda k, v: k != "giro"))
    with pytest.raises(Exception, match="missing fields: giro"):
        records.validated(lacking).collect()
    assert records.validated(made).count() == 20
