"""The column store on the survey's columnar fixtures."""

import pytest
from pyspark.sql import functions as F

from tessera import errors as E
from tessera.sources.column_store import ColumnStore


@pytest.fixture
def store(spark, tmp_path):
    store = ColumnStore(spark, str(tmp_path / "store"))
    for name, kind in (("id", "int"), ("category", "string"), ("value", "int")):
        store.add_column(name, kind)
    assert store.insert([{"id": i, "category": chr(65 + i % 3), "value": 10 * i} for i in range(100)]) == 100
    return store


def test_scan_and_aggregate(store):
    assert store.scan(["id"], F.col("value") > 500).count() == 49
    row = store.aggregate([("count", "*", "n"), ("sum", "value", "s")]).first()
    assert (row["n"], row["s"]) == (100, 49500)
    assert store.aggregate([("count", "*", "n")], ["category"]).count() == 3
    assert store.aggregate([("max", "value", "m")], ["category"], F.col("id") < 3).count() == 3


def test_segments_and_skipping(spark, store, tmp_path):
    small = ColumnStore(spark, str(tmp_path / "small"), segment_rows=10)
    small.add_column("v", "int")
    small.insert(spark.range(100).repartitionByRange(4, "id").select(F.col("id").cast("int").alias("v")))
    zones = small.zone_maps("v").collect()
    assert sum(z["row_count"] for z in zones) == 100 and all(z["row_count"] <= 10 for z in zones) and len(zones) >= 10
    got = [r["v"] for r in small.scan_column("v", ">=", 95).collect()]
    assert set(range(95, 100)) <= set(got) and len(got) <= 20
    # one of four files is read
    assert len(small.rows().inputFiles()) == 4 and len([f for f in small.scan_column("v", ">=", 95).inputFiles() if "-zones/" not in f]) == 1
    assert small.scan_column("v", ">", 1000).count() == 0
    assert small.scan_column("v").count() == 100
    small.add_column("w", "string")
    small.insert([{"v": 1, "w": "x"}, {"v": None}])
    assert sum(z["null_count"] for z in small.zone_maps("w").collect()) == 101 and small.scan_column("w", "=", "x").count() >= 1
    assert small.scan(where=F.col("w").isNull()).count() == 101 and small.scan(["w"], F.col("v") == 1).count() == 2


def test_compression(spark, tmp_path):
    store = ColumnStore(spark, str(tmp_path / "runs"))
    store.add_column("a", "string")
    store.add_column("n", "bigint")
    assert store.compression({"n": "rle"}) == {"n": 1.0}
    store.insert(spark.range(2000).coalesce(1).select(F.when(F.col("id") < 1000, "A").otherwise("B").alias("a"), F.lit(7).cast("long").alias("n")))
    got = store.compression({"a": "rle", "n": "rle"})
    assert got["a"] == 1.0 and got["n"] == pytest.approx(16000 / (4 + 250 + 4 + 13))


def test_errors(store):
    for bad in (lambda: store.add_column("id", "int"), lambda: store.scan(["nope"]), lambda: store.zone_maps("nope")):
        with pytest.raises(E.CatalogError):
            bad()
    with pytest.raises(E.StatementError):
        store.compression({"id": "zip"})
