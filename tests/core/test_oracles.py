"""Every query of the catalogue against its SQL in DuckDB, by names, types and values."""

import datetime
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = lambda v: v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v
    return names, sorted(repr([plain(v) for v in r]) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, sf, duck, name):
    got = rows(catalogue.QUERIES[name](spark, sf).toArrow())
    assert got == rows(duck.sql(catalogue.ORACLES[name]).to_arrow_table())


#: Queries that say nothing on these data: an empty input is their feature.
EMPTY = {"index_duplicates"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - EMPTY))
def test_no_query_is_vacuous(name):
    duck = duckdb.connect()
    for f in Path("/root/testdata/sf0.01").glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert duck.sql(f"SELECT count(*) FROM ({catalogue.ORACLES[name]})").fetchall()[0][0] > 0


def test_unmanaged_zone_scan_keeps_either_side(spark, tmp_path):
    """segments by both limits, by the upper alone, by the lower alone, by none, on the limits, and without customers."""
    customers = {0: (3, 14000), 1: (50, 9001), 2: (49, 8999), 3: (50, 8999), 4: (50, 9000), 5: (0, 50), 6: (None, None), 7: (None, 9000), 8: (None, 7)}
    values = ", ".join(f"({'NULL' if s == 9 else s * 4096 + k}, {'NULL' if c is None else c})" for s, cs in {**customers, 9: (1, 9999)}.items() for k, c in enumerate(cs))
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT a::BIGINT AS o_orderkey, b::BIGINT AS o_custkey FROM (VALUES {values}) AS t(a, b)) TO '{tmp_path}/orders.parquet'")
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = catalogue.QUERIES["zone_map_scan_unmanaged"](spark, str(tmp_path)).toArrow()
    assert set(got.column("segment").to_pylist()) == {0, 1, 2, 4, 5, 7, 8}
    assert rows(got) == rows(duck.sql(catalogue.ORACLES["zone_map_scan_unmanaged"]).to_arrow_table())
