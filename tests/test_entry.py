"""The driver's contract, on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
SAMPLE = ["canonical_rut", "ocr_repair", "parse_date", "number_words", "synth_contracts", "extract_all", "damaged_accuracy_by_field", "breakdown_grouping_sets", "failure_examples_k", "worst_fields_topk", "otsu_threshold", "source_policy", "manifest_json_roundtrip", "unpivot_fields"]


def test_every_query_has_a_name_and_most_have_sql():
    assert len(OWN) > 70
    assert {n for n in OWN if n not in entry.oracle_sql()} == {"similarity", "compare_with_similarity"}


def test_entry(spark):
    assert [r.exactitud for r in entry.entry(spark).collect()] == [1.0, 1.0, 1.0]


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
