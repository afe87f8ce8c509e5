"""The façade and the operators on the survey's users and orders, and one test for each decided fix."""

import pytest
from pyspark.sql import functions as F

from tessera import errors as E
from tessera.api import open_database
from tessera.functions.scalar import divide, floor_mod
from tessera.operators import columnar, dml, index, metrics, versions
from tessera.operators.aggregates import aggregate, measure
from tessera.operators.relational import join, limit, scan
from tessera.plans import statements as S
from tessera.session import EngineConfig
from tessera.streaming import windows

USERS = [(1, "Alice", 30, True), (2, "Bob", 25, True), (3, "Charlie", 35, False), (4, "Diana", 28, True), (5, "Eve", 22, False)]
ORDERS = [(1, 1, 100.50), (2, 1, 200.00), (3, 2, 50.25), (4, 3, 75.00)]


@pytest.fixture
def db(spark):
    with open_database(spark=spark) as db:
        db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name VARCHAR(100), age INTEGER, active BOOLEAN)")
        db.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER, total FLOAT)")
        db.execute("INSERT INTO users VALUES " + ", ".join(f"({i}, '{n}', {a}, {str(x).upper()})" for i, n, a, x in USERS))
        db.execute("INSERT INTO orders VALUES " + ", ".join(f"({i}, {u}, {t})" for i, u, t in ORDERS))
        yield db


def ids(db, sql):
    return [r["id"] for r in db.query(sql)]


def test_select_where_order_limit(db):
    assert len(list(db.query("SELECT * FROM users"))) == 5
    assert ids(db, "SELECT id FROM users WHERE active = TRUE ORDER BY id") == [1, 2, 4]
    assert ids(db, "SELECT id FROM users WHERE age > 28 ORDER BY id") == [1, 3]
    assert ids(db, "SELECT id FROM users ORDER BY id LIMIT 2 OFFSET 2") == [3, 4]
    assert [r["name"] for r in db.query("SELECT name FROM users WHERE active ORDER BY age DESC LIMIT 2;")] == ["Alice", "Diana"]
    assert [r["name"] for r in db.query("SELECT name FROM users ORDER BY active DESC, age ASC")] == ["Bob", "Diana", "Alice", "Eve", "Charlie"]


def test_joins_and_groups(db):
    count = lambda sql: next(db.query(sql))["n"]
    assert count("SELECT COUNT(*) AS n FROM users u INNER JOIN orders o ON u.id = o.user_id") == 4
    assert count("SELECT COUNT(*) AS n FROM users u LEFT JOIN orders o ON u.id = o.user_id") == 6
    assert count("SELECT COUNT(*) AS n FROM orders o RIGHT JOIN users u ON u.id = o.user_id") == 6
    assert count("SELECT COUNT(*) AS n FROM users CROSS JOIN orders") == 20
    rows = list(db.query("SELECT user_id, COUNT(*) AS n, SUM(total) AS s FROM orders GROUP BY user_id ORDER BY user_id"))
    assert [(r["user_id"], r["n"], r["s"]) for r in rows] == [(1, 2, 300.5), (2, 1, 50.25), (3, 1, 75.0)]


def test_changes_are_written(db):
    assert db.execute("INSERT INTO users VALUES (6, 'Frank', 40, TRUE), (7, 'Gail', NULL, FALSE)") == 2
    assert db.execute("UPDATE users SET age = age + 1 WHERE active = TRUE AND id < 6") == 3
    assert [r["age"] for r in db.query("SELECT age FROM users WHERE id IN (1, 2, 4) ORDER BY id")] == [31, 26, 29]
    assert db.execute("DELETE FROM users WHERE active = FALSE") == 3
    assert ids(db, "SELECT id FROM users ORDER BY id") == [1, 2, 4, 6]
    assert db.execute("DELETE FROM users WHERE age > 1000") == 0
    assert db.execute("INSERT INTO orders SELECT id + 10, id, 1.5 FROM users") == 4
    db.checkpoint()
    assert len(list(db.query("SELECT * FROM orders"))) == 8


def test_constraints(db):
    with pytest.raises(E.UniqueError):
        db.execute("INSERT INTO users VALUES (1, 'Twin', 1, TRUE)")
    with pytest.raises(E.NotNullError):
        db.execute("INSERT INTO users (name) VALUES ('nobody')")
    db.execute("CREATE TABLE t (a INTEGER, b VARCHAR(3) NOT NULL, c TEXT DEFAULT 'x, y', d BLOB, PRIMARY KEY (a, b))")
    with pytest.raises(E.LengthError):  # two bytes each
        db.execute("INSERT INTO t (a, b) VALUES (1, 'éé')")
    db.execute("INSERT INTO t (a, b) VALUES (1, 'abc'), (1, 'abd')")
    assert [r["c"] for r in db.query("SELECT c FROM t")] == ["x, y", "x, y"]
    assert len(list(db.query("SELECT * FROM users"))) == 5


def test_catalogue_errors(db):
    with pytest.raises(E.TableExistsError):
        db.execute("CREATE TABLE users (id INT)")
    with pytest.raises(E.TableNotFoundError):
        db.execute("DROP TABLE nothing")
    assert db.execute("DROP TABLE IF EXISTS nothing") == 0
    db.execute("DROP TABLE orders")
    assert db.tables == ["users"]
    for bad in ("ALTER TABLE users", "INSERT INTO users VALUES (1)", "CREATE TABLE x (a STRANGE)", "", "UPDATE users SET nope = 1", "INSERT INTO users (id, nope) VALUES (9, 9)"):
        with pytest.raises(E.StatementError):
            db.execute(bad)
    with pytest.raises(E.StatementError):
        db.execute("SELECT 1")
    with pytest.raises(E.StatementError):
        list(db.query("DELETE FROM users"))


def test_transactions(db):
    with db.connect() as c:
        c.begin()
        c.execute("INSERT INTO users VALUES (8, 'Hal', 9, TRUE)")
        assert len(list(c.query("SELECT * FROM users"))) == 6
        assert len(list(db.query("SELECT * FROM users"))) == 5  # not seen from outside
        c.rollback()
        assert len(list(db.query("SELECT * FROM users"))) == 5
        c.begin()
        c.execute("INSERT INTO users VALUES (8, 'Hal', 9, TRUE)")
        c.commit()
        assert len(list(db.query("SELECT * FROM users"))) == 6
        with pytest.raises(E.TransactionError):
            c.commit()
    a, b = db.connect(), db.connect()
    a.begin()
    b.begin()
    a.execute("UPDATE users SET age = 1 WHERE id = 1")
    b.execute("UPDATE users SET age = 2 WHERE id = 1")
    a.commit()
    with pytest.raises(E.WriteConflictError):
        b.commit()
    assert next(db.query("SELECT age FROM users WHERE id = 1"))["age"] == 1


def test_metrics_and_close(db):
    list(db.query("SELECT 1 AS one"))
    text = db.export_metrics()
    assert 'queries_total{kind="select"} 1' in text and "# TYPE query_seconds histogram" in text and 'le="+Inf"' in text
    assert "Filter" in db.explain("SELECT id FROM users WHERE age > 3")
    db.close()
    with pytest.raises(E.ClosedError):
        db.execute("DROP TABLE users")


def test_null_logic_is_three_valued(db):
    one = lambda sql: next(db.query(f"SELECT {sql} AS v"))["v"]
    assert one("NOT CAST(NULL AS BOOLEAN)") is None and one("NULL = NULL") is None
    assert one("1 IN (2, NULL)") is None and one("FALSE AND CAST(NULL AS BOOLEAN)") is False
    assert one("UPPER('')") == "" and one("LENGTH('')") == 0 and one("'a\nb' LIKE 'a%b'") is True and one("'abc' LIKE 'a.c'") is False


def test_scalars(spark):
    df = spark.createDataFrame([(-7, 3), (7, -3), (7, 3), (7, 0), (None, 3)], "a int, n int")
    assert [r[0] for r in df.select(floor_mod(F.col("a"), F.col("n"))).collect()] == [2, -2, 1, None, None]
    assert [r[0] for r in df.select(divide(F.col("a"), F.col("n"))).collect()][3:] == [None, None]


def test_statement_reader():
    got = S.parse("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(10) DEFAULT 'x' NOT NULL, c DOUBLE DEFAULT (1 + 2) NULL)")
    assert [(c.name, c.type_text, c.nullable, c.default) for c in got.columns] == [("a", "INT", False, None), ("b", "VARCHAR(10)", False, "'x'"), ("c", "DOUBLE", True, "(1 + 2)")]
    got = S.parse("insert into t (a, b) values (f(1, 2), 'it''s, ok'), (-3, NULL)")
    assert got.rows == [["f(1, 2)", "'it''s, ok'"], ["-3", "NULL"]]
    got = S.parse("UPDATE t SET a = (b + 1), b = 'where' WHERE a = 1 AND b <> 2")
    assert got.changes == {"a": "(b + 1)", "b": "'where'"} and got.where == "a = 1 AND b <> 2"
    assert S.parse("DELETE FROM t").where is None


def test_relational_rules(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "a int, b int")
    assert scan(df, alias="t", prefix=True).columns == ["t.a", "t.b"]
    with pytest.raises(E.StatementError):
        join(df, df, how="left")
    with pytest.raises(E.StatementError):
        limit(df, -1)
    with pytest.raises(E.StatementError):
        measure("median", "a")
    row = aggregate(df.where("a > 9"), [measure("count"), measure("sum", "a")]).first()
    assert (row[0], row[1]) == (0, None)
    assert aggregate(df, [measure("count", "a", "n")]).first()["n"] == 1


def test_index(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert index.contains(df, "k", 5) and not index.contains(df, "k", 500)
    assert [r.k for r in index.key_range(df, "k", 3, 6).collect()] == [3, 4, 5, 6]
    with pytest.raises(E.UniqueError):
        index.inserted(df, spark.range(1).withColumnRenamed("id", "k"), "k")
    with pytest.raises(E.CatalogError):
        index.removed(df, "k", 500)
    assert index.removed(df, "k", 5).count() == 99


def test_segments(spark):
    values = [1, 1, 1, 1, 2, 2, 3, 3, 3, 3, 3]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v int")
    seg = columnar.segment_of("k", 65536)
    assert columnar.rle_runs(df, "v", seg, "k").first()["runs"] == 3
    df = spark.createDataFrame(list(enumerate([10, 11, 12, 13, 14, 15, 10, 11, 12])), "k long, v int")
    row = columnar.codec_sizes(df, "v", seg, "k").first()
    assert row["bits"] == 3 and row["plain_bytes"] == 4 + 2 + 36 and row["bitpack_bytes"] == 6 + 9 + 4
    df = spark.createDataFrame(list(enumerate(["apple", "banana", "apple", "cherry", "banana", "apple"])), "k long, v string")
    assert columnar.codec_sizes(df, "v", seg, "k").first()["entries"] == 3
    zones = columnar.zone_maps(spark.createDataFrame(list(enumerate([5, 10, None, 20, 15])), "k long, v int"), "v", seg)
    row = zones.first()
    assert (row["min_value"], row["max_value"], row["null_count"], row["row_count"]) == (5, 20, 1, 5)
    assert zones.where(columnar.may_contain(7)).count() == 1 and zones.where(columnar.may_contain(4)).count() == 0
    assert zones.where(columnar.may_contain(None)).count() == 1
    assert zones.where(columnar.may_match_range(21, 30)).count() == 0 and zones.where(columnar.may_match_range(0, 5)).count() == 1


@pytest.mark.parametrize("op", ["=", "<", "<=", ">", ">="])
def test_zone_scan_loses_nothing(spark, op):
    df = spark.range(1000).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"))
    got = columnar.zone_scan(df, "v", columnar.segment_of("k", 16), op, 50)
    sign = "=" if op == "=" else op
    assert got.where(f"v {sign} 50").count() == df.where(f"v {sign} 50").count()


def test_versions(spark):
    rows = [(1, 10, 20, 1, 2, "V1"), (1, 20, None, 2, None, "V2"), (2, None, None, 9, None, "mine")]
    v = spark.createDataFrame(rows, "rid long, xmin_ts long, xmax_ts long, xmin long, xmax long, data string")
    read = lambda *a: {r["rid"]: r["data"] for r in versions.snapshot_read(v, *a).collect()}
    assert read(9) == {} and read(10) == {1: "V1"} and read(19) == {1: "V1"} and read(20) == {1: "V2"}
    assert read(15, 9) == {1: "V1", 2: "mine"}
    assert [r.rid for r in versions.write_conflicts(v, v.select("rid").distinct(), 15).collect()] == [1]


def test_log_replay(spark):
    log = spark.createDataFrame(
        [(1, 1, "BEGIN", None, None, None, None), (2, 1, "INSERT", 5, 0, None, "a"), (3, 2, "BEGIN", None, None, None, None), (4, 2, "UPDATE", 5, 0, "a", "b"), (5, 1, "COMMIT", None, None, None, None), (6, 2, "INSERT", 10, 1, None, "c")],
        "lsn long, txn_id long, log_type string, page_id long, slot_id long, before_image string, after_image string",
    )
    assert {r.txn_id: r.status for r in versions.analysis(log).collect()} == {1: "COMMIT", 2: "ACTIVE"}
    assert {r.page_id for r in versions.dirty_pages(log).collect()} == {5, 10}
    assert {(r.page_id, r.image) for r in versions.redo(log).collect()} == {(5, "b"), (10, "c")}
    assert {(r.page_id, r.image) for r in versions.undo(log).collect()} == {(5, "a"), (10, None)}
    assert [(r.page_id, r.slot_id, r.image) for r in versions.recover(log).collect()] == [(5, 0, "a")]
    assert versions.last_checkpoint(log).first()[0] is None


def test_metric_registry():
    m = metrics.Registry()
    for _ in range(100):
        m.observe("t", 0.05, buckets=(0.1, 0.5, 1.0, 5.0))
        m.observe("t", 0.3)
    assert 0 <= m.percentile("t", 0.5) <= 0.1 and 0.1 < m.percentile("t", 0.99) <= 0.5 and m.percentile("x", 0.5) is None
    with pytest.raises(ValueError):
        m.inc("n", -1)


def test_config():
    assert EngineConfig("olap").settings()["spark.sql.cbo.enabled"] == "true"
    for bad in ({"preset": "none"}, {"segment_rows": 0}, {"slow_query_ms": -1}):
        with pytest.raises(E.ConfigurationError):
            EngineConfig(**bad)


def test_updates_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    assert {tuple(r) for r in dml.delete(df, F.col("b") > 1).collect()} == {(1, None)}
    assert {tuple(r) for r in dml.update(df, {"b": F.lit(0)}, F.col("b") > 1).collect()} == {(1, None), (2, 0)}


def test_plans(spark, sf):
    from tessera.plans import catalogue

    plan = lambda name: catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan("scan_pushed") and "l_comment" not in plan("scan_pushed")
    assert "TakeOrderedAndProject" in plan("topk")
    assert "SortMergeJoin" in plan("join_merge") and "ShuffledHashJoin" in plan("join_hash") and "BroadcastHashJoin" in plan("join_broadcast")


def test_stream(spark, sf):
    got = windows.run_to_memory(spark, sf, "events.parquet")
    want = windows.replay(spark, f"{sf}/events.parquet")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
