"""python -m fieldloom generate | extract | evaluate"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import evaluate, extract
from .plans import render, report, synth
from .sources import documents, records, sinks

FOLDERS = ("pdf", "escaneos")
TABLES = ("manifiesto", "textos")


def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.limpiar:
        print(f"{records.clean(spark, a.salida, (*FOLDERS, *TABLES))} files deleted")
    profile = S.NO_PROFILE if a.solo_pdf else a.perfil
    rows = synth.drawn(spark, a.cantidad, a.semilla, a.plantilla, profile)
    records.write_lines(synth.truth_records(rows, a.semilla), f"{a.salida}/manifiesto")
    texts = render.render(rows)
    texts.select("ord", "id_documento", "texto").write.mode("overwrite").json(f"{a.salida}/textos")
    files = sinks.pdfs(texts)
    print(sinks.write_files(files, a.salida).count(), "PDFs")
    if profile != S.NO_PROFILE:
        named = files.join(rows.select(F.concat(F.lit("pdf/"), "id_documento", F.lit(".pdf")).alias("path"), "perfil_escaneo"), "path")
        try:
            print(sinks.write_files(sinks.scans(named, F.col("perfil_escaneo"), a.semilla), a.salida).count(), "scans")
        except Exception as e:
            if "EngineMissing" not in str(e):
                raise
            print("no scans: drawing the pages of a PDF needs PyMuPDF (--solo-pdf leaves them out)", file=sys.stderr)
            return 1
    for dimension in S.DIMENSIONS:
        for r in rows.groupBy(dimension).count().orderBy(dimension).collect():
            print(f"{dimension:<16} {r[0]:<12} {r[1]}")
    return 0


def run_extract(spark: SparkSession, a: argparse.Namespace) -> int:
    if not records.exists(spark, a.entrada):
        print(f"there is no {a.entrada}", file=sys.stderr)
        return 1
    if a.motor == "texto":
        docs = spark.read.schema("ord long, id_documento string, texto string").json(a.entrada)
    else:
        documents.discover()
        found = documents.read(documents.scan(spark, a.entrada).withColumn("ord", F.monotonically_increasing_id()), a.motor)
        docs = found.select("ord", "id_documento", "path", "metodo", "segundos", "texto")
    if docs.isEmpty():
        print("no documents", file=sys.stderr)
        return 1
    records.write_lines(extract.predictions(docs), a.salida)
    done = records.read_predictions(spark, a.salida)
    print(evaluate.blanks(done).first(), *evaluate.methods(done).collect(), sep="\n")
    return 0


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    for path in (a.predicciones, a.ground_truth):
        if not records.exists(spark, path):
            print(f"there is no {path}", file=sys.stderr)
            return 1
    truth, predictions = records.read_truth(spark, a.ground_truth), records.read_predictions(spark, a.predicciones)
    results = evaluate.compare(truth, predictions).cache()
    found = report.gather(results, truth, predictions)
    print(report.text(found, a.etiqueta))
    if a.json:
        report.write(found, results, a.json)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fieldloom")
    commands = parser.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate")
    g.add_argument("--cantidad", type=int, default=30)
    g.add_argument("--semilla", type=int, default=2026)
    g.add_argument("--perfil", default="medio", choices=(*S.PROFILES, S.MIXED_PROFILE))
    g.add_argument("--plantilla", choices=tuple(S.LAYOUTS))
    g.add_argument("--salida", required=True)
    g.add_argument("--solo-pdf", action="store_true")
    g.add_argument("--limpiar", action="store_true")
    g.set_defaults(run=generate)
    e = commands.add_parser("extract")
    e.add_argument("--entrada", required=True)
    e.add_argument("--motor", default="texto", choices=("texto", documents.AUTO, *documents.ENGINES))
    e.add_argument("--salida", required=True)
    e.set_defaults(run=run_extract)
    v = commands.add_parser("evaluate")
    v.add_argument("--predicciones", required=True)
    v.add_argument("--ground-truth", required=True)
    v.add_argument("--json")
    v.add_argument("--etiqueta", default="")
    v.set_defaults(run=run_evaluate)
    args = parser.parse_args(argv)
    return args.run(SparkSession.builder.appName("fieldloom").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
