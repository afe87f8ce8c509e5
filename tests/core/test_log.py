"""The write-ahead log, recovery, and transactions that touch the same table."""

import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera import errors as E
from tessera.api import Database, open_database
from tessera.operators import versions
from tessera.operators.metrics import Registry
from tessera.session import EngineConfig
from tessera.sources.log import Clock, Log


def table(db, name="t"):
    return sorted(tuple(r.values()) for r in db.query(f"SELECT * FROM {name}"))


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/db"


def folders(db, name="t"):
    return db.files.names(f"{db.path}/t{db._tables[name].number}")


def filled(spark, path):
    db = Database("d", path, spark)
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v VARCHAR(9) DEFAULT 'x')")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd')")
    return db


def test_log_is_numbered_and_whole(spark, path):
    clock = Clock()
    log = Log(spark, f"{path}/log", clock)
    assert log.frame().count() == 0
    assert log.append([(1, "BEGIN", None, None, None, None), (1, "INSERT", 5, 0, None, "a")]) == 2
    assert log.append([(1, "COMMIT", None, None, None, None)]) == 3
    assert [(r.lsn, r.log_type) for r in versions.from_lsn(log.frame(), 2).collect()] == [(2, "INSERT"), (3, "COMMIT")]
    with pytest.raises(E.WriteConflictError):
        Log(spark, f"{path}/log", Clock()).append([(9, "BEGIN", None, None, None, None)])
    seen, threads = [], [threading.Thread(target=lambda: seen.extend(clock.next() for _ in range(500))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(seen) == list(range(4, 2004))


def test_a_killed_session_reopens_at_its_last_commit(spark, path):
    db = filled(spark, path)
    db.execute("UPDATE t SET v = 'A' WHERE k = 1")
    db.execute("DELETE FROM t WHERE k = 2")
    open_one = db.connect()
    open_one.begin()
    open_one.execute("INSERT INTO t VALUES (9, 'lost')")
    open_one.execute("DELETE FROM t WHERE k = 1")
    aborted = db.connect()
    aborted.begin()
    aborted.execute("INSERT INTO t VALUES (8, 'gone')")
    aborted.rollback()
    before = table(db)
    # no close: the next session finds what is on disk
    again = Database("d", path, spark)
    assert table(again) == before == [(1, "A"), (3, "c"), (4, "d")]
    assert {r.status for r in versions.analysis(again.log.frame()).where("last_lsn > 0").collect()} == {"ACTIVE", "ABORT", "COMMIT"}
    assert len(folders(again)) == len(again._tables["t"].rows) + len(again._tables["t"].gone)
    with pytest.raises(E.UniqueError):
        again.execute("INSERT INTO t VALUES (3, 'twice')")
    again.execute("INSERT INTO t (k) VALUES (7)")
    again.checkpoint()
    again.execute("CREATE TABLE u (a INTEGER)")
    again.execute("INSERT INTO u VALUES (1)")
    again.execute("DROP TABLE u")
    again.execute("DELETE FROM t WHERE k = 4")
    third = Database("d", path, spark)
    assert table(third) == [(1, "A"), (3, "c"), (7, "x")] and third.tables == ["t"]
    assert third.clock.now >= again.clock.now


def test_transactions_on_different_rows_go_together(spark, path):
    db = filled(spark, path)
    a, b = db.connect(), db.connect()
    a.begin()
    b.begin()
    a.execute("UPDATE t SET v = 'A' WHERE k = 1")
    b.execute("UPDATE t SET v = 'B' WHERE k = 2")
    b.execute("UPDATE t SET v = 'BB' WHERE k = 2")
    b.execute("DELETE FROM t WHERE k = 4")
    b.execute("INSERT INTO t VALUES (5, 'e')")
    a.commit()
    b.commit()
    assert table(db) == [(1, "A"), (2, "BB"), (3, "c"), (5, "e")]


@pytest.mark.parametrize("between", ["UPDATE t SET v = 'z' WHERE k = 1", "DELETE FROM t WHERE k = 1", "INSERT INTO t VALUES (6, 'z')"])
@pytest.mark.parametrize("compact", [False, True])
def test_the_first_committer_wins(spark, path, between, compact):
    db = filled(spark, path)
    c = db.connect()
    c.begin()
    c.execute("INSERT INTO t VALUES (6, 'mine')" if "INSERT" in between else "DELETE FROM t WHERE k = 1")
    db.execute(between)
    if compact:
        db.checkpoint()
    after = table(db)
    with pytest.raises(E.WriteConflictError):
        c.commit()
    assert table(db) == after and not c.in_transaction
    live = db._tables["t"]
    assert folders(db) == sorted(map(str, live.rows + live.gone))
    c.begin()
    c.execute("DELETE FROM t WHERE k = 3")
    db.execute("INSERT INTO t VALUES (20, 'other')")
    db.checkpoint()
    c.commit()
    assert (3, "c") not in table(db) and (20, "other") in table(db)


def test_a_dropped_table_does_not_come_back(spark, path):
    db = filled(spark, path)
    c = db.connect()
    c.begin()
    c.execute("INSERT INTO t VALUES (9, 'i')")
    assert len(list(c.query("SELECT * FROM t"))) == 5
    db.execute("DROP TABLE t")
    db.execute("CREATE TABLE t (other DOUBLE)")
    with pytest.raises(E.WriteConflictError):
        c.commit()
    assert [f.name for f in db.table("t").schema] == ["other"] and table(db) == []


def test_nothing_is_left_of_what_is_refused_or_replaced(spark, path):
    db = filled(spark, path)
    assert len(folders(db)) == 1
    for bad, error in (("INSERT INTO t VALUES (1, 'twice')", E.UniqueError), ("INSERT INTO t VALUES (5, 'p'), (5, 'q')", E.UniqueError), ("INSERT INTO t VALUES (6, 'much too long')", E.LengthError), ("UPDATE t SET k = 1", E.UniqueError), ("UPDATE t SET k = 2 WHERE k = 1", E.UniqueError), ("INSERT INTO t VALUES (1 / 0, 'x')", Exception)):
        with pytest.raises(error):
            db.execute(bad)
        assert len(folders(db)) == 1, bad
    assert db.execute("UPDATE t SET k = k + 1") == 4 and table(db)[0] == (2, "a")
    assert db.statistics("t") | {"bytes": 0} == {"folders": 3, "bytes": 0, "rows": 4, "dead": 4, "utilisation": 0.5}
    db.checkpoint()
    assert len(folders(db)) == 1 and db.statistics("t")["utilisation"] == 1.0 and len(table(db)) == 4


def test_rows_by_id(spark, path):
    db = filled(spark, path)
    ids = {r["k"]: tuple(r["rid"]) for r in db.rows_with_ids("t").collect()}
    assert len(set(ids.values())) == 4 and db.get("t", ids[2]) == {"k": 2, "v": "b"}
    assert db.update_row("t", ids[2], v="B") == 1 and db.get("t", ids[2]) is None and db.update_row("t", ids[2], v="C") == 0
    assert db.delete_row("t", ids[3]) == 1 and db.delete_row("t", ids[3]) == 0
    assert table(db) == [(1, "a"), (2, "B"), (4, "d")]
    db.checkpoint()
    assert db.get("t", ids[4]) == {"k": 4, "v": "d"}
    with pytest.raises(E.ColumnNotFoundError):
        db.update_row("t", ids[1], nope=1)


def test_metrics_of_a_database(spark):
    with open_database(spark=spark, config=EngineConfig(slow_query_ms=0)) as db:
        db.execute("CREATE TABLE t (k INTEGER)")
        db.execute("INSERT INTO t VALUES (1), (2)")
        c = db.connect()
        c.begin()
        c.execute("DELETE FROM t")
        c.commit()
        assert list(db.query("SELECT * FROM t")) == []
        get = db.metrics.get
        assert get("rows_written_total") == 4 and get("rows_read_total") == 0 and get("connections") == 1 and get("slow_queries_total", kind="insert") == 1
        assert get("transactions_total", status="committed") == 1 and db.metrics.percentile("transaction_seconds", 0.5, status="committed") > 0
        c.close()
        assert get("connections") == 0
        assert db.column_store("x").segment_rows == 65536


def test_text_format_escapes(spark):
    m = Registry()
    m.inc("n", text="a\nb", path='c:\\d "e"\n')
    m.add("g", 2)
    m.add("g", -3)
    assert m.render() == '# TYPE g gauge\ng -1\n# HELP n a\\nb\n# TYPE n counter\nn{path="c:\\\\d \\"e\\"\\n"} 1\n'
    m.reset()
    assert m.render() == ""


def test_unknown_names_are_errors(spark, path):
    db = filled(spark, path)
    for sql in ("SELECT nope FROM t", "SELECT k FROM t a JOIN t b ON a.k = b.k", "SELECT nofunction(k) FROM t", "SELECT * FROM nothing"):
        with pytest.raises(AnalysisException):
            list(db.query(sql))
    assert db.dataframe("SELECT k * 1.5D AS a, LENGTH(v) AS b, 1 AS c, 'x' AS d, NULL AS e FROM t").dtypes == [("a", "double"), ("b", "int"), ("c", "int"), ("d", "string"), ("e", "void")]
    assert db.table("t").where(F.col("k") > 2).count() == 2
    with pytest.raises(E.ColumnError):
        db.execute("CREATE TABLE u (_f INTEGER)")
