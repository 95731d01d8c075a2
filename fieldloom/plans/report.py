"""The evaluation for people and for programs. Only aggregates and a few examples reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import ellipsis
from ..operators import evaluate
from ..schema import DIMENSIONS

EXAMPLES, WORST, NAMED = 3, 5, 5
_RATES = (("right", "exactitud"), ("wrong", "tasa_error"), ("not read", "tasa_omision"))


def gather(results: DataFrame, truth: DataFrame, predictions: DataFrame) -> dict:
    """Everything that the report and the JSON document need. results should be cached or stored, as it is read several times."""
    lacking = evaluate.missing(truth, predictions)
    worst = evaluate.worst_fields(results, WORST).collect()
    failed = evaluate.failures(results.where(F.col("campo").isin([r.campo for r in worst])), EXAMPLES) if worst else None
    return {
        "summary": evaluate.summary(results).first(),
        "documents": evaluate.by_document(results).first(),
        "missing": (lacking.count(), [r.id_documento for r in evaluate.first_ids(lacking, NAMED).collect()]),
        "fields": evaluate.by_field(results).orderBy("ord_campo").drop("ord_campo").collect(),
        "dimensions": {d: evaluate.breakdown(results, truth, d).collect() for d in DIMENSIONS},
        "own": evaluate.own_party_ranked(results).orderBy("nth").drop("nth").collect(),
        "own_total": evaluate.own_party_total(results).first()[0],
        "worst": worst,
        "examples": _shown(failed) if failed is not None else [],
    }


def measure(truth: DataFrame, predictions: DataFrame, with_similarity: bool = True) -> dict:
    """What gather finds, without a row for each value: records are joined once, and a row of each keeps the values that aren't right.
    Everything is counted from these rows."""
    packs = evaluate.packed(truth, predictions, DIMENSIONS).cache()
    counts = evaluate.counted(packs, DIMENSIONS, with_similarity).cache()
    try:
        lacking = packs.where(~F.col("hay"))
        fields = evaluate.added(counts, "campo").orderBy("ord_campo").collect()
        worst = sorted((r for r in fields if r.exactitud < 1), key=lambda r: r.exactitud)[:WORST]  # ties stay in field order
        failed = evaluate.failures(evaluate.failed(packs).where(F.col("campo").isin([r.campo for r in worst])), EXAMPLES) if worst else None
        own = packs.select(F.explode("propios").alias("campo")).groupBy("campo").agg(F.count("*").alias("cantidad")).orderBy(F.desc("cantidad"), "campo").collect()
        return {
            "summary": evaluate.added(counts).first(),
            "documents": evaluate.by_document_of(packs).first(),
            "missing": (lacking.count(), [r.id_documento for r in evaluate.first_ids(lacking, NAMED).collect()]),
            "fields": [Row(**{k: v for k, v in r.asDict().items() if k != "ord_campo"}) for r in fields],
            "dimensions": {d: evaluate.added(counts, d).orderBy(d).collect() for d in DIMENSIONS},
            "own": own,
            "own_total": sum(r.cantidad for r in own),
            "worst": worst,
            "examples": _shown(evaluate.with_similarity_of(failed) if with_similarity else failed) if worst else [],
        }
    finally:
        counts.unpersist()
        packs.unpersist()


def _shown(failed: DataFrame) -> list[Row]:
    """Failures with values short enough to be printed."""
    return failed.orderBy("campo", "nth").withColumns({c: ellipsis(F.col(c)) for c in ("esperado", "obtenido")}).collect()


def _table(head: str, rows: list[Row]) -> list[str]:
    """A Markdown table of rates by the values of a column."""
    out = [f"| {head} | {' | '.join(n for n, _ in _RATES)} | values |", "|-|-|-|-|-|"]
    return out + [f"| {r[head]} | {' | '.join(f'{r[c]:.1%}' for _, c in _RATES)} | {r.total} |" for r in rows]


def text(found: dict, label: str = "") -> str:
    """The report, in Markdown."""
    s, d, (lack, named) = found["summary"], found["documents"], found["missing"]
    out = [f"# Extraction{f': {label}' if label else ''}", ""]
    out.append(f"{s.exactitud:.1%} of {s.total} values are right ({s.correctos}); {s.incorrectos} are wrong and {s.omitidos} were not read.")
    out.append(f"{d.completos} of {d.documentos} documents are right in every field ({d.exactitud:.1%}).")
    if lack:
        out.append(f"{lack} documents have no prediction: {', '.join(named)}{', …' if lack > NAMED else ''}.")
    for dimension, rows in found["dimensions"].items():
        if len(rows) > 1:
            out += ["", f"## By {dimension}", "", *_table(dimension, rows)]
    out += ["", "## By campo", "", *_table("campo", found["fields"]), "", f"## The own party's values: {found['own_total']}", ""]
    out += [f"- {r.campo}: {r.cantidad}" for r in found["own"]]
    out += ["", f"## The weakest fields: {len(found['worst'])}"]
    for r in found["worst"]:
        out += ["", f"{r.campo}, {r.exactitud:.1%} right, mean similarity {r.similitud_media:.2f}:", ""]
        out += [f"- {e.id_documento}, {e.estado}: «{e.obtenido}» for «{e.esperado}»" for e in found["examples"] if e.campo == r.campo]
    return "\n".join(out) + "\n"


def as_json(found: dict) -> str:
    """The metrics as one document. The rows compared aren't in it, as they grow with the corpus; write puts them beside it."""
    plain = lambda x: x.asDict() if isinstance(x, Row) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x
    return json.dumps(plain(found), ensure_ascii=False, sort_keys=True)


def write(found: dict, results: DataFrame, path: str) -> None:
    """path/metricas: one JSON document; path/resultados: the rows compared, as JSON lines."""
    spark = results.sparkSession
    spark.createDataFrame([(as_json(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metricas")
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/resultados")
