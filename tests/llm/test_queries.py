"""The registered queries: their columns, their rows, and their SQL where there is some."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import registry

COLUMNS = {
    "op1_nbsvm": ("documents", [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]),
    "op2_warc": ("pages", [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]),
    "op3_mixing": ("documents", [("doc_id", "bigint"), ("source", "string"), ("n_tokens", "bigint"), ("weight", "double"), ("copies", "bigint"), ("epoch", "bigint"), ("block", "int"), ("time", "double"), ("place", "bigint")]),
    "op4_hyperminhash": ("documents", [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]),
    "op5_style_tree": ("pages", [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]),
    "op6_bpe": ("documents", [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]),
    "op7_divergence": ("documents", [("doc_id", "bigint"), *((c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean")]),
    "op8_crf": ("documents", [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]),
    "op9_brown_lm": ("documents", [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]),
    "lm_base_counts": ("documents", [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double")]),
    "op10_hyperplanes": ("embeddings", [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]),
}


def test_all_are_registered():
    assert set(registry.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf, name):
    table, columns = COLUMNS[name]
    got = registry.QUERIES[name](spark, sf)
    assert got.dtypes[: len(columns)] == columns
    key = columns[0][0]
    if name == "op3_mixing":  # readings: each row as often as its copies say
        assert got.groupBy(key).agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.min("epoch").alias("lo"), F.max("epoch").alias("hi")).where("n <> c OR lo <> 1 OR hi <> c").count() == 0
        return
    assert sorted(r[key] for r in got.select(key).collect()) == sorted(r[key] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = registry.QUERIES[name](spark, sf).toArrow(), con.sql(registry.ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in names), strict=True)))
    assert rows(got) == rows(want)
