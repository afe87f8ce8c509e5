"""A database façade: SQL statements over versioned Parquet tables with a write-ahead log.

A table is a list of folders of Parquet files, of which none is ever changed: folders of rows, and folders
with the ids of rows that are gone. An insert adds rows, a delete adds ids, an update adds both, so a change
costs what it touches. Publishing appends the change to the log and swaps the lists. A connection inside
a transaction reads and writes lists of its own and publishes them on commit. If others have published
meanwhile, its changes are added to theirs, unless both have changed or deleted the same row, brought in
the same key, or the table is not the same one any more (first committer wins).

Opening a folder that has a log replays it from the last checkpoint on; what no finished transaction
has published is deleted. One session writes to a folder at a time.
"""

from __future__ import annotations

import contextlib
import json
import shutil
import tempfile
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import errors as E
from tessera.functions.types import parse_type
from tessera.operators import dml, versions
from tessera.operators.metrics import Registry
from tessera.plans import statements as S
from tessera.session import EngineConfig, is_local
from tessera.sources.column_store import ColumnStore
from tessera.sources.log import Clock, Files, Log

#: A row's id: the folder that brought it in and its number there.
RID = T.StructType([T.StructField("_f", T.LongType()), T.StructField("_n", T.LongType())])


@dataclass(frozen=True)
class Table:
    """A table's definition and the folders that hold its rows and the ids of rows that are gone; number
    tells it from others of its name, version is the time of its last publication."""

    number: int
    name: str
    schema: T.StructType
    not_null: tuple[str, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    key: tuple[str, ...] = ()
    rows: tuple[int, ...] = ()
    gone: tuple[int, ...] = ()
    version: int = 0

    def definition(self) -> str:
        return json.dumps({"name": self.name, "schema": self.schema.json(), "not_null": self.not_null, "lengths": self.lengths, "defaults": self.defaults, "key": self.key})

    @classmethod
    def defined(cls, number: int, text: str) -> Table:
        x = json.loads(text)
        return cls(number, x["name"], T.StructType.fromJson(json.loads(x["schema"])), tuple(x["not_null"]), x["lengths"], x["defaults"], tuple(x["key"]))

    def slots(self) -> dict[int, str]:
        """What the log holds of it, by slot."""
        return {0: self.definition(), **dict.fromkeys(self.rows, "rows"), **dict.fromkeys(self.gone, "gone")}


class Database:
    """Tables in a folder (a local, temporary one if no path is given; on a cluster a shared one)."""

    def __init__(self, name: str = "main", path: str | None = None, spark: SparkSession | None = None, enable_metrics: bool = True, config: EngineConfig | None = None) -> None:
        base = spark or SparkSession.builder.getOrCreate()
        self.name, self.spark, self.config = name, base.newSession(), config or EngineConfig()
        self.spark.conf.set("spark.sql.caseSensitive", "true")
        self._temporary = path is None
        if path is None:
            if not is_local(base):
                raise E.ConfigurationError("a database on a cluster needs the path of a shared folder")
            path = tempfile.mkdtemp(prefix=f"tessera-{name}-")
        self.path = path.rstrip("/")
        self.files = Files(self.spark, self.path)
        self.clock = Clock()
        self.log = Log(self.spark, f"{self.path}/_log", self.clock)
        self._tables: dict[str, Table] = {}
        self._running: list[Connection] = []
        self._lock = threading.RLock()
        self.metrics = Registry() if enable_metrics else None
        self.closed = False
        self._recover()

    # statements

    def execute(self, sql: str) -> int:
        """Runs a DDL or DML statement; returns the affected rows (0 for DDL)."""
        self._open()
        parsed = S.parse(sql)
        if isinstance(parsed, S.Select):
            raise E.StatementError("a SELECT is a query")
        with self._lock, self._timed(type(parsed).__name__.lower()):
            lists = dict(self._tables)
            if isinstance(parsed, S.CreateTable):
                count = self._create(parsed, lists)
            elif isinstance(parsed, S.DropTable):
                count = self._drop(parsed, lists)
            else:
                count = self._change(parsed, lists)
            self._publish(lists)
            return count

    def query(self, sql: str) -> Iterator[dict]:
        """The rows of a SELECT as dicts, read as they come."""
        self._open()
        yield from self._select(sql, self._tables)

    def dataframe(self, sql: str) -> DataFrame:
        """A SELECT as a DataFrame. Take it again after a checkpoint, which deletes what it replaces."""
        self._open()
        return self._frame(sql, self._tables)

    def connect(self) -> Connection:
        self._open()
        return Connection(self)

    @property
    def tables(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str) -> DataFrame:
        return self._read(self._known(name, self._tables))

    def explain(self, sql: str) -> str:
        """The plan that Spark makes of a SELECT."""
        frame = self.dataframe(sql)
        return frame._jdf.queryExecution().explainString(frame.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # rows by id

    def rows_with_ids(self, name: str) -> DataFrame:
        """The rows of a table with their ids in a column rid."""
        t = self._known(name, self._tables)
        return self._stored(t).select(F.struct("_f", "_n").alias("rid"), *t.schema.names)

    def get(self, name: str, rid: tuple[int, int]) -> dict | None:
        row = self._stored(self._known(name, self._tables)).where(_is(rid)).drop(*RID.names).first()
        return row.asDict() if row else None

    def update_row(self, name: str, rid: tuple[int, int], **values) -> int:
        """Changes a row by its id; it gets a new one. Returns how many rows were changed."""
        with self._lock:
            lists = dict(self._tables)
            count = self._update(self._known(name, lists), lists, {c: F.lit(v) for c, v in values.items()}, _is(rid))
            self._publish(lists)
            return count

    def delete_row(self, name: str, rid: tuple[int, int]) -> int:
        with self._lock:
            lists = dict(self._tables)
            count = self._delete(self._known(name, lists), lists, _is(rid))
            self._publish(lists)
            return count

    def statistics(self, name: str) -> dict[str, float]:
        """Folders, bytes, live and dead rows of a table, and the share of live rows."""
        t = self._known(name, self._tables)
        live, dead = self._stored(t).count(), self._ids(t).count() if t.gone else 0
        return {"folders": len(t.rows) + len(t.gone), "bytes": self.files.size(f"{self.path}/t{t.number}"), "rows": live, "dead": dead, "utilisation": live / (live + dead) if live + dead else 1.0}

    def column_store(self, name: str) -> ColumnStore:
        """A columnar table beside the others, in segments of the configured size."""
        return ColumnStore(self.spark, f"{self.path}/columns/{name}", self.config.segment_rows)

    # upkeep

    def checkpoint(self) -> None:
        """Writes every table that has several folders anew as one, notes the whole catalogue in the log, from
        where the next opening starts, and deletes what no running transaction reads any more."""
        self._open()
        with self._lock:
            lists = dict(self._tables)
            for name, t in lists.items():
                if len(t.rows) + len(t.gone) > 1:
                    lists[name] = replace(t, rows=(self._write(t, self._stored(t), ids=True),), gone=())
            self._publish(lists)
            txn = self.clock.next()
            slots = [(txn, "INSERT", t.number, k, None, x) for t in self._tables.values() for k, x in t.slots().items()]
            self.log.append([(txn, "CHECKPOINT", None, None, None, None), (txn, "BEGIN", None, None, None, None), *slots, (txn, "COMMIT", None, None, None, None)])
            self._vacuum()

    def export_metrics(self) -> str:
        return self.metrics.render() if self.metrics else ""

    def close(self) -> None:
        if not self.closed:
            for c in list(self._running):
                c.rollback()
            self.closed = True
            if self._temporary:
                shutil.rmtree(self.path, ignore_errors=True)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # inside

    def _open(self) -> None:
        if self.closed:
            raise E.ClosedError("the database is closed")

    @contextlib.contextmanager
    def _timed(self, kind: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        if self.metrics:
            took = time.perf_counter() - began
            self.metrics.inc("queries_total", kind=kind)
            self.metrics.observe("query_seconds", took, kind=kind)
            if 1000 * took > self.config.slow_query_ms:
                self.metrics.inc("slow_queries_total", kind=kind)

    def _count(self, name: str, n: float, **labels: str) -> None:
        if self.metrics:
            self.metrics.inc(name, n, **labels)

    def _recover(self) -> None:
        """The tables that the log's finished transactions have left."""
        if not self.files.names(self.log.folder):
            return
        log = self.log.frame()
        top = log.agg(*(F.max(c).alias(c) for c in ("lsn", "txn_id", "page_id", "slot_id"))).first()
        self.clock._now = max(x or 0 for x in top)
        since = versions.last_checkpoint(log).first()[0] or 0
        found: dict[int, dict[int, str]] = {}
        for r in versions.recover(versions.from_lsn(log, since), since).collect():  # as many as there are folders
            found.setdefault(r["page_id"], {})[r["slot_id"]] = r["image"]
        for number, slots in found.items():
            t = Table.defined(number, slots.pop(0))
            folders = {kind: tuple(sorted(k for k, x in slots.items() if x == kind)) for kind in ("rows", "gone")}
            self._tables[t.name] = replace(t, **folders, version=self.clock.now)
        self._vacuum()

    def _publish(self, lists: dict[str, Table], txn: int | None = None) -> None:
        """Logs the difference to the published tables and swaps them."""
        old, new = ({t.number: t for t in x.values()} for x in (self._tables, lists))
        changes = []
        for number in sorted(old.keys() | new.keys()):
            a, b = (x[number].slots() if number in x else {} for x in (old, new))
            changes += [("DELETE", number, k, a[k], None) for k in sorted(a.keys() - b.keys())] + [("INSERT", number, k, None, b[k]) for k in sorted(b.keys() - a.keys())]
        if changes:
            begin = [] if txn else [("BEGIN", None, None, None, None)]
            txn = txn or self.clock.next()
            at = self.log.append((txn, *x) for x in [*begin, *changes, ("COMMIT", None, None, None, None)])
            touched = {x[1] for x in changes}
            lists = {n: replace(t, version=at) if t.number in touched else t for n, t in lists.items()}
            if gone := old.keys() - new.keys():
                self._tables = lists
                for number in gone:
                    self.spark.catalog.dropTempView(old[number].name)
                self._vacuum()
        self._tables = lists

    def _vacuum(self) -> None:
        """Deletes folders that neither the published tables nor running transactions name."""
        with self._lock:
            used: dict[int, set[int]] = {}
            for lists in [self._tables, *(c._lists for c in self._running), *(c._base for c in self._running)]:
                for t in lists.values():
                    used.setdefault(t.number, set()).update(t.rows, t.gone)
            for folder in self.files.names(self.path):
                if folder[:1] != "t" or not folder[1:].isdigit():
                    continue
                if int(folder[1:]) not in used:
                    self.files.delete(f"{self.path}/{folder}")
                    continue
                for k in self.files.names(f"{self.path}/{folder}"):
                    if int(k) not in used[int(folder[1:])]:
                        self.files.delete(f"{self.path}/{folder}/{k}")

    def _forget(self, t: Table, *folders: int) -> None:
        for k in folders:
            self.files.delete(self._folder(t, k))

    def _known(self, name: str, lists: dict[str, Table]) -> Table:
        if name not in lists:
            raise E.TableNotFoundError(f"no table {name}")
        return lists[name]

    def _folder(self, t: Table, k: int) -> str:
        return f"{self.path}/t{t.number}/{k}"

    def _in(self, t: Table, *folders: int) -> DataFrame:
        """Rows of some folders with their ids."""
        whole = T.StructType([*t.schema.fields, *RID.fields])
        return self.spark.read.schema(whole).parquet(*(self._folder(t, k) for k in folders)) if folders else self.spark.createDataFrame([], whole)

    def _ids(self, t: Table, *folders: int) -> DataFrame:
        """The ids of rows that are gone."""
        some = folders or t.gone
        return self.spark.read.schema(RID).parquet(*(self._folder(t, k) for k in some)) if some else self.spark.createDataFrame([], RID)

    def _stored(self, t: Table) -> DataFrame:
        """A table's rows with their ids."""
        rows = self._in(t, *t.rows)
        return rows.join(self._ids(t), RID.names, "left_anti") if t.gone else rows

    def _read(self, t: Table) -> DataFrame:
        return self._stored(t).select(*t.schema.names)

    def _write(self, t: Table, rows: DataFrame, ids: bool = False) -> int:
        """Writes a folder; rows get ids of it unless they keep theirs."""
        k = self.clock.next()
        if not ids:
            rows = rows.select(*t.schema.names, F.lit(k).cast("long").alias("_f"), F.monotonically_increasing_id().alias("_n"))
        try:
            rows.write.mode("error").parquet(self._folder(t, k))
        except BaseException:
            self._forget(t, k)
            raise
        return k

    def _frame(self, sql: str, lists: dict[str, Table]) -> DataFrame:
        with self._lock:
            for name, t in lists.items():
                self._read(t).createOrReplaceTempView(f"`{name}`")
            return self.spark.sql(sql.strip().rstrip(";"))

    def _select(self, sql: str, lists: dict[str, Table]) -> Iterator[dict]:
        if not isinstance(S.parse(sql), S.Select):
            raise E.StatementError("only a SELECT is a query")
        with self._timed("select"):
            frame, n = self._frame(sql, lists), 0
            for row in frame.toLocalIterator():
                n += 1
                yield row.asDict()
            self._count("rows_read_total", n)

    def _create(self, s: S.CreateTable, lists: dict[str, Table]) -> int:
        if s.table in lists:
            raise E.TableExistsError(f"table {s.table} is already there")
        kinds = {c.name: parse_type(c.type_text) for c in s.columns}
        if bad := set(kinds) & set(RID.names):
            raise E.ColumnError(f"column {min(bad)} has a reserved name")
        schema = T.StructType([T.StructField(c.name, kinds[c.name][0], True, {"primary_key": c.primary_key}) for c in s.columns])
        lists[s.table] = Table(self.clock.next(), s.table, schema, tuple(c.name for c in s.columns if not c.nullable), {n: k[1] for n, k in kinds.items() if k[1] is not None}, {c.name: c.default for c in s.columns if c.default is not None}, tuple(s.primary_key))
        return 0

    def _drop(self, s: S.DropTable, lists: dict[str, Table]) -> int:
        if s.table in lists:
            del lists[s.table]
        elif not s.if_exists:
            raise E.TableNotFoundError(f"no table {s.table}")
        return 0

    def _change(self, s, lists: dict[str, Table]) -> int:
        t = self._known(s.table, lists)
        if isinstance(s, S.Insert):
            count = self._insert(t, lists, self._new_rows(s, t, lists))
        else:
            where = F.expr(s.where) if s.where else F.lit(True)
            count = self._delete(t, lists, where) if isinstance(s, S.Delete) else self._update(t, lists, {c: F.expr(e) for c, e in s.changes.items()}, where)
        self._count("rows_written_total", count)
        return count

    def _insert(self, t: Table, lists: dict[str, Table], rows: DataFrame) -> int:
        k = self._write(t, rows)
        staged = self._in(t, k)
        with self._or_forget(t, k):
            dml.check(staged, list(t.not_null), t.lengths, list(t.key))
            self._check_key(t, staged, self._stored(t))
            count = staged.count()
        lists[t.name] = replace(t, rows=(*t.rows, k))
        return count

    def _delete(self, t: Table, lists: dict[str, Table], where: Column) -> int:
        k = self._write(t, self._stored(t).where(where).select(*RID.names), ids=True)
        count = self._ids(t, k).count()
        if count:
            lists[t.name] = replace(t, gone=(*t.gone, k))
        else:
            self._forget(t, k)
        return count

    def _update(self, t: Table, lists: dict[str, Table], changes: dict[str, Column], where: Column) -> int:
        if unknown := set(changes) - set(t.schema.names):
            raise E.ColumnNotFoundError(f"unknown column {', '.join(sorted(unknown))}")
        mine = dict(lists)
        count = self._delete(t, mine, where)
        if not count:
            return 0
        left, touched = mine[t.name], set(changes)
        out = left.gone[-1]
        with self._or_forget(t, out):
            k = self._write(t, dml.update(self._in(t, *t.rows).join(self._ids(t, out), RID.names, "left_semi"), changes))
        with self._or_forget(t, out, k):
            staged, key = self._in(t, k), list(t.key) if touched & set(t.key) else []
            dml.check(staged, [c for c in t.not_null if c in touched], {c: n for c, n in t.lengths.items() if c in touched}, key)
            if key:
                self._check_key(t, staged, self._stored(left))
        lists[t.name] = replace(left, rows=(*t.rows, k))
        return count

    @contextlib.contextmanager
    def _or_forget(self, t: Table, *folders: int) -> Iterator[None]:
        """Deletes folders of a change that is refused."""
        try:
            yield
        except BaseException:
            self._forget(t, *folders)
            raise

    def _check_key(self, t: Table, new: DataFrame, old: DataFrame) -> None:
        """Raises if new rows have a key that old ones have: the new keys look for theirs, no group is made."""
        if t.key and not new.select(*t.key).join(old.select(*t.key), list(t.key), "left_semi").limit(1).isEmpty():
            raise E.UniqueError(f"duplicate primary key ({', '.join(t.key)})")

    def _new_rows(self, s: S.Insert, t: Table, lists: dict[str, Table]) -> DataFrame:
        names = s.columns or t.schema.names
        if unknown := set(names) - set(t.schema.names):
            raise E.ColumnNotFoundError(f"unknown column {', '.join(sorted(unknown))}")
        if s.select is not None:
            rows = self._frame(s.select, lists)
            if len(rows.columns) != len(names):
                raise E.StatementError(f"{len(rows.columns)} values for {len(names)} columns")
            rows = rows.toDF(*names)
        else:
            for row in s.rows:
                if len(row) != len(names):
                    raise E.StatementError(f"{len(row)} values for {len(names)} columns")
            casts = [f"CAST(({{}}) AS {t.schema[n].dataType.simpleString()})" for n in names]
            rows = self.spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(c.format(v) for c, v in zip(casts, row, strict=True)) + ")" for row in s.rows)).toDF(*names)
        return dml.conform(rows, self.spark.createDataFrame([], t.schema), {c: F.expr(e) for c, e in t.defaults.items()})

    def _merged(self, base: dict[str, Table], mine: dict[str, Table]) -> dict[str, Table]:
        """The published tables with a transaction's changes added; raises if they do not go together."""
        out = dict(self._tables)
        for name, t in mine.items():
            old = base[name]
            if t is old:
                continue
            now = out.get(name)
            if now is None or now.number != t.number:
                raise E.WriteConflictError(f"table {name} is not the one that the transaction began with")
            rows, gone = ([k for k in new if k not in was] for new, was in ((t.rows, old.rows), (t.gone, old.gone)))
            if now.version != old.version:
                theirs = [k for k in now.gone if k not in old.gone]
                ended = self._ids(t, *theirs).select(F.struct("_f", "_n").alias("rid"), F.lit(None).cast("long").alias("xmin_ts"), F.lit(now.version).alias("xmax_ts")) if theirs else None
                if gone and (self._compacted(old, now) or ended is not None):
                    writes = self._ids(t, *gone).join(self._in(old, *rows).select(*RID.names), RID.names, "left_anti") if rows else self._ids(t, *gone)
                    writes = writes.select(F.struct("_f", "_n").alias("rid"))
                    lost = versions.write_conflicts(ended, writes, old.version) if ended is not None else writes.limit(0)
                    if self._compacted(old, now):  # what others deleted before they compacted is not listed any more
                        lost = lost.union(writes.join(self._stored(now).select(F.struct("_f", "_n").alias("rid")), "rid", "left_anti"))
                    if not lost.limit(1).isEmpty():
                        raise E.WriteConflictError(f"a row of table {name} was changed by another transaction")
                if rows and t.key:
                    new = self._in(t, *rows).join(self._ids(t, *gone), RID.names, "left_anti") if gone else self._in(t, *rows)
                    others = self._stored(replace(now, gone=(*now.gone, *gone)))
                    try:
                        self._check_key(t, new, others)
                    except E.UniqueError as e:
                        raise E.WriteConflictError(f"another transaction brought in a key of table {name}") from e
            out[name] = replace(now, rows=(*now.rows, *rows), gone=(*now.gone, *gone))
        return out

    @staticmethod
    def _compacted(old: Table, now: Table) -> bool:
        return not set(old.rows) <= set(now.rows)


def _is(rid: tuple[int, int]) -> Column:
    return (F.col("_f") == rid[0]) & (F.col("_n") == rid[1])


class Connection:
    """A session with transactions. Outside one, every statement is published at once."""

    def __init__(self, db: Database) -> None:
        self.db, self.closed = db, False
        self._lists: dict[str, Table] | None = None
        self._base: dict[str, Table] = {}
        self._txn, self._at = 0, 0.0
        self._gauge(1)

    def _gauge(self, by: int) -> None:
        if self.db.metrics:
            self.db.metrics.add("connections", by)

    @property
    def in_transaction(self) -> bool:
        return self._lists is not None

    def begin(self) -> None:
        self._open()
        if self.in_transaction:
            raise E.TransactionStateError("a transaction is already running")
        with self.db._lock:
            self._base, self._lists = dict(self.db._tables), dict(self.db._tables)
            self._txn, self._at = self.db.clock.next(), time.perf_counter()
            self.db.log.append([(self._txn, "BEGIN", None, None, None, None)])
            self.db._running.append(self)

    def commit(self) -> None:
        self._open()
        self._inside()
        with self.db._lock:
            try:
                self.db._publish(self.db._merged(self._base, self._lists), self._txn)
            except BaseException:
                self._end("aborted")
                raise
            self._end("committed")

    def rollback(self) -> None:
        self._open()
        self._inside()
        with self.db._lock:
            self._end("aborted")

    def _inside(self) -> None:
        if not self.in_transaction:
            raise E.TransactionStateError("no transaction is running")

    def _end(self, status: str) -> None:
        """Leaves the transaction; if it is given up, its folders go."""
        if status == "aborted":
            self.db.log.append([(self._txn, "ABORT", None, None, None, None)])
            for name, t in self._lists.items():
                old = self._base[name]
                self.db._forget(t, *(set(t.rows + t.gone) - set(old.rows + old.gone)))
        self._lists, self._base = None, {}
        self.db._running.remove(self)
        self.db._vacuum()  # it may have been the last to read what a checkpoint replaced
        if self.db.metrics:
            self.db.metrics.inc("transactions_total", status=status)
            self.db.metrics.observe("transaction_seconds", time.perf_counter() - self._at, status=status)

    def execute(self, sql: str) -> int:
        self._open()
        if not self.in_transaction:
            return self.db.execute(sql)
        parsed = S.parse(sql)
        if isinstance(parsed, S.CreateTable | S.DropTable):
            raise E.StatementError("DDL is not part of a transaction")
        if isinstance(parsed, S.Select):
            raise E.StatementError("a SELECT is a query")
        with self.db._timed(type(parsed).__name__.lower()):
            return self.db._change(parsed, self._lists)

    def query(self, sql: str) -> Iterator[dict]:
        self._open()
        yield from self.db._select(sql, self._lists if self.in_transaction else self.db._tables)

    def close(self) -> None:
        if not self.closed:
            if self.in_transaction:
                self.rollback()
            self.closed = True
            self._gauge(-1)

    def _open(self) -> None:
        if self.closed:
            raise E.ClosedError("the connection is closed")
        self.db._open()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_database(path: str | None = None, name: str = "main", **how) -> Database:
    return Database(name, path, **how)
