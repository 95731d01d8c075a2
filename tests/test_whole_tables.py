"""Queries over whole tables, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from fieldloom.sources import documents


def same(spark, folder, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    rows = sorted(map(tuple, got.collect()))
    want = con.sql(entry.oracle_sql()[name])
    assert got.columns == want.columns and rows == sorted(want.fetchall())
    return rows


def test_accents_of_whole_texts(spark, tmp_path):
    rows = [(1, "x" * 300 + " Ñandú ºª", "en"), (2, "Öl é", None), (3, "ação", "pt")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(same(spark, tmp_path, "strip_accents", "documents"))
    assert got == {1: "x" * 300 + " Nandu oa", 2: "Ol e", 3: "acao"}


def test_specks_of_every_image(spark, tmp_path):
    keys = [k for k in range(64 * 6 - 30) if k < 64 or k % 7 % (2 + k // 64) != 1]  # whole, with gaps, and a short last one
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r[0] for r in same(spark, tmp_path, "speck_ratio", "orders")] == list(range(6))
    same(spark, tmp_path, "speck_removal", "orders")


def test_files_without_a_reader_are_not_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "_readers", {})
    documents.register("nativo", lambda b: [b.decode()])
    (tmp_path / "a.pdf").write_bytes(b"largo " * 60)
    assert [r.id_documento for r in documents.read(documents.scan(spark, str(tmp_path))).collect()] == ["a"]
    for name in ("b.pdf", "c.jpg"):
        (tmp_path / name).write_bytes(b"corto")
        with pytest.raises(documents.EngineMissing):
            documents.read(documents.scan(spark, str(tmp_path)))
        (tmp_path / name).unlink()
