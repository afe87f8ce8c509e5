"""The named queries of the engine and, for each, the same result in plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.api import Database
from tessera.functions.scalar import divide, floor_mod
from tessera.operators import columnar, dml, index, metrics, versions
from tessera.operators.aggregates import aggregate, measure
from tessera.operators.relational import join, limit, project, scan, sort, top_k
from tessera.sources.column_store import ColumnStore
from tessera.sources.tables import load
from tessera.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


@query(
    """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 2) AS avg_price,
              min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderstatus <> 'P' AND o_totalprice BETWEEN 1000 AND 400000
       GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10"""
)
def flagship_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue by nation: filter, two joins, aggregate, top-k."""
    orders = load(spark, sf, "orders").where((F.col("o_orderstatus") != "P") & F.col("o_totalprice").between(1000, 400000))
    joined = orders.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = joined.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("revenue"),
        F.round(F.avg("o_totalprice"), 2).alias("avg_price"),
        F.min("o_orderdate").alias("first_ts"),
        F.max("o_orderdate").alias("last_ts"),
    )
    return found.orderBy(F.col("revenue").desc(), "n_name").limit(10)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders")


def _add(name: str, sql: str, plan: Query) -> None:
    QUERIES[name], ORACLES[name] = plan, sql


C = F.col

# scans and projections
_add("scan_all", "SELECT * FROM nation", lambda s, d: scan(load(s, d, "nation")))
_add("scan_project", "SELECT o_orderkey, o_totalprice AS price FROM orders", lambda s, d: project(_orders(s, d), o_orderkey=C("o_orderkey"), price=C("o_totalprice")))
_add("scan_alias", "SELECT o.o_orderkey AS key, o.o_orderstatus AS status FROM orders o", lambda s, d: scan(_orders(s, d), alias="o").select(C("o.o_orderkey").alias("key"), C("o.o_orderstatus").alias("status")))
_add("scan_prefixed", 'SELECT r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region', lambda s, d: scan(load(s, d, "region"), alias="r", prefix=True))
_add("scan_pushed", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03", lambda s, d: scan(load(s, d, "lineitem"), ["l_orderkey", "l_quantity"], [C("l_quantity") > 45, C("l_discount") < 0.03]))

# predicates
_KEYS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE "
_keys = lambda s, d, *p: scan(_orders(s, d), ["o_orderkey", "o_orderstatus", "o_totalprice"], list(p))
_add("filter_eq", _KEYS + "o_orderstatus = 'F'", lambda s, d: _keys(s, d, C("o_orderstatus") == "F"))
_add("filter_ne", _KEYS + "o_orderstatus <> 'F'", lambda s, d: _keys(s, d, C("o_orderstatus") != "F"))
_add("filter_range", _KEYS + "o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderkey >= 10 AND o_custkey < 1000", lambda s, d: _keys(s, d, C("o_totalprice") > 100000, C("o_totalprice") <= 200000, C("o_orderkey") >= 10, C("o_custkey") < 1000))
_add("filter_and_or", _KEYS + "(o_orderstatus = 'F' AND o_totalprice < 50000) OR (o_orderstatus = 'O' AND o_totalprice > 300000)", lambda s, d: _keys(s, d, ((C("o_orderstatus") == "F") & (C("o_totalprice") < 50000)) | ((C("o_orderstatus") == "O") & (C("o_totalprice") > 300000))))
_add("filter_not", _KEYS + "NOT (o_orderstatus = 'F' OR o_totalprice < 100000)", lambda s, d: _keys(s, d, ~((C("o_orderstatus") == "F") | (C("o_totalprice") < 100000))))
_add("filter_timestamp", _KEYS + "o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'", lambda s, d: _keys(s, d, F.expr("o_orderdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'")))
_PARTS = "SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE "
_parts = lambda s, d, *p: scan(load(s, d, "part"), ["p_partkey", "p_name", "p_brand", "p_size"], list(p))
_add("filter_in", _PARTS + "p_size IN (1, 5, 9, 49)", lambda s, d: _parts(s, d, C("p_size").isin(1, 5, 9, 49)))
_add("filter_not_in", _PARTS + "NOT (p_size IN (1, 5, 9, 49))", lambda s, d: _parts(s, d, ~C("p_size").isin(1, 5, 9, 49)))
_add("filter_between", _PARTS + "p_size BETWEEN 10 AND 20", lambda s, d: _parts(s, d, C("p_size").between(10, 20)))
_add("filter_not_between", _PARTS + "NOT (p_size BETWEEN 10 AND 20)", lambda s, d: _parts(s, d, ~C("p_size").between(10, 20)))
_add("filter_like", _PARTS + "p_brand LIKE '%1%'", lambda s, d: _parts(s, d, C("p_brand").like("%1%")))
_add("filter_like_underscore", _PARTS + "p_brand LIKE '_rand#_2'", lambda s, d: _parts(s, d, C("p_brand").like("_rand#_2")))
_add("filter_not_like", _PARTS + "NOT (p_name LIKE '%a.c%' OR p_brand LIKE 'Brand#1%')", lambda s, d: _parts(s, d, ~(C("p_name").like("%a.c%") | C("p_brand").like("Brand#1%"))))
_add("filter_column", "SELECT doc_id FROM labels WHERE CAST(toxic AS BOOLEAN)", lambda s, d: load(s, d, "labels").where(C("toxic").cast("boolean")).select("doc_id"))

_LINES = "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, l_extendedprice FROM lineitem"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("discount"), "l_extendedprice")


_add("filter_is_null", f"SELECT * FROM ({_LINES}) WHERE discount IS NULL", lambda s, d: _lines(s, d).where(C("discount").isNull()))
_add("filter_is_not_null", f"SELECT * FROM ({_LINES}) WHERE discount IS NOT NULL", lambda s, d: _lines(s, d).where(C("discount").isNotNull()))
_add(
    "null_logic",
    f"""SELECT (discount > 0.05) AND (l_extendedprice > 30000) AS a, (discount > 0.05) OR (l_extendedprice > 30000) AS o, NOT (discount > 0.05) AS n, discount IN (0.01, NULL) AS i,
              discount BETWEEN 0.02 AND NULL AS b, discount = NULL AS e, count(*) AS n_rows FROM ({_LINES}) GROUP BY ALL""",
    lambda s, d: _lines(s, d)
    .select(
        ((C("discount") > 0.05) & (C("l_extendedprice") > 30000)).alias("a"),
        ((C("discount") > 0.05) | (C("l_extendedprice") > 30000)).alias("o"),
        (~(C("discount") > 0.05)).alias("n"),
        F.expr("discount IN (0.01D, NULL)").alias("i"),
        F.expr("discount BETWEEN 0.02D AND NULL").alias("b"),
        F.expr("discount = CAST(NULL AS DOUBLE)").alias("e"),
    )
    .groupBy("a", "o", "n", "i", "b", "e")
    .agg(F.count(F.lit(1)).alias("n_rows")),
)

# scalar expressions
_add(
    "expr_arith",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity + l_linenumber AS plus, l_quantity - 10 AS minus FROM lineitem",
    lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", (C("l_extendedprice") * (1 - C("l_discount")) * (1 + C("l_tax"))).alias("charge"), (C("l_quantity") + C("l_linenumber")).alias("plus"), (C("l_quantity") - 10).alias("minus")),
)
_add("expr_div", "SELECT o_orderkey, o_totalprice / o_custkey AS q, o_totalprice / nullif(o_orderkey % 3, 0) AS z FROM orders WHERE o_custkey > 0", lambda s, d: _orders(s, d).where("o_custkey > 0").select("o_orderkey", divide(C("o_totalprice"), C("o_custkey")).alias("q"), divide(C("o_totalprice"), C("o_orderkey") % 3).alias("z")))
_add("expr_mod", "SELECT o_orderkey, o_custkey % 7 AS m FROM orders", lambda s, d: _orders(s, d).select("o_orderkey", (C("o_custkey") % 7).alias("m")))
_add("expr_floor_mod", "SELECT o_orderkey, (((o_orderkey - 5000) % 7) + 7) % 7 AS m, (((5000 - o_orderkey) % -3) + -3) % -3 AS n FROM orders", lambda s, d: _orders(s, d).select("o_orderkey", floor_mod(C("o_orderkey") - 5000, F.lit(7)).alias("m"), floor_mod(5000 - C("o_orderkey"), F.lit(-3)).alias("n")))
_add("expr_neg", "SELECT c_custkey, -c_acctbal AS neg FROM customer", lambda s, d: load(s, d, "customer").select("c_custkey", (-C("c_acctbal")).alias("neg")))
_add("expr_precedence", "SELECT o_orderkey, 1 + o_custkey * 2 % 5 - -3 AS v FROM orders WHERE NOT o_orderstatus = 'F' AND o_custkey < 50 OR o_orderkey < 20", lambda s, d: _orders(s, d).where("NOT o_orderstatus = 'F' AND o_custkey < 50 OR o_orderkey < 20").select("o_orderkey", F.expr("1 + o_custkey * 2 % 5 - -3").alias("v")))
_add("fn_upper_lower_length", "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS INTEGER) AS len FROM customer", lambda s, d: load(s, d, "customer").select("c_custkey", F.upper("c_name").alias("up"), F.lower("c_mktsegment").alias("low"), F.length("c_name").alias("len")))
_add("fn_text", "SELECT doc_id, CAST(length(text) AS INTEGER) AS len, upper(lang) AS lang FROM documents", lambda s, d: load(s, d, "documents").select("doc_id", F.length("text").alias("len"), F.upper("lang").alias("lang")))
_add("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS bal FROM customer WHERE c_acctbal < 0", lambda s, d: load(s, d, "customer").where("c_acctbal < 0").select("c_custkey", F.abs("c_acctbal").alias("bal")))

# joins
_rich = "(SELECT * FROM orders WHERE o_totalprice > 300000)"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")


def _rich_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).where("o_totalprice > 300000").select("o_orderkey", "o_custkey", "o_totalprice")


_PAIR = "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer {} JOIN " + _rich + " ON c_custkey = o_custkey"


def _pair(how: str, strategy: str | None = None) -> Query:
    def plan(s: SparkSession, d: str) -> DataFrame:
        return join(_customers(s, d), _rich_orders(s, d), C("c_custkey") == C("o_custkey"), how, strategy).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")

    return plan


for _how, _word in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _add(f"join_{_how}", _PAIR.format(_word), _pair(_how))
_add("join_hash", _PAIR.format("INNER"), _pair("inner", "hash"))
_add("join_merge", _PAIR.format("LEFT"), _pair("left", "merge"))
_add("join_broadcast", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", lambda s, d: join(_customers(s, d), load(s, d, "nation"), C("c_nationkey") == C("n_nationkey")).select("c_custkey", "n_name"))
_add("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", lambda s, d: join(_customers(s, d), _rich_orders(s, d), C("c_custkey") == C("o_custkey"), "semi").select("c_custkey"))
_add("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", lambda s, d: join(_customers(s, d), _rich_orders(s, d), C("c_custkey") == C("o_custkey"), "anti").select("c_custkey"))
_add("join_left_where_right", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000", lambda s, d: join(_customers(s, d), _orders(s, d), C("c_custkey") == C("o_custkey"), "left").where("o_totalprice > 400000").select("c_custkey", "o_orderkey"))
_add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", lambda s, d: join(load(s, d, "region"), load(s, d, "nation"), how="cross").select("r_name", "n_name"))
_add("join_cross_on", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey <> n_regionkey", lambda s, d: join(load(s, d, "region"), load(s, d, "nation"), C("r_regionkey") != C("n_regionkey"), "cross").select("r_name", "n_name"))
_add("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey", lambda s, d: join(load(s, d, "nation").alias("a"), load(s, d, "nation").alias("b"), F.expr("a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey")).select(C("a.n_name").alias("low"), C("b.n_name").alias("high")))
_add("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", lambda s, d: join(load(s, d, "supplier").alias("a"), load(s, d, "supplier").alias("b"), F.expr("a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")).select(C("a.s_suppkey").alias("a"), C("b.s_suppkey").alias("b")))
_add(
    "join_multiway",
    """SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' GROUP BY r_name, n_name""",
    lambda s, d: load(s, d, "lineitem")
    .join(_orders(s, d).where("o_orderstatus = 'O'"), C("l_orderkey") == C("o_orderkey"))
    .join(load(s, d, "customer"), C("o_custkey") == C("c_custkey"))
    .join(load(s, d, "nation"), C("c_nationkey") == C("n_nationkey"))
    .join(load(s, d, "region"), C("n_regionkey") == C("r_regionkey"))
    .groupBy("r_name", "n_name")
    .agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total")),
)
_add("join_left_labels", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", lambda s, d: join(load(s, d, "documents").select("doc_id").alias("d"), load(s, d, "labels").alias("l"), F.expr("d.doc_id = l.doc_id"), "left").select("d.doc_id", "quality", "toxic"))

_add("join_using", "SELECT custkey, o_orderkey, c_name FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders) JOIN (SELECT c_custkey AS custkey, c_name FROM customer) USING (custkey)", lambda s, d: _orders(s, d).select(C("o_custkey").alias("custkey"), "o_orderkey").join(_customers(s, d).select(C("c_custkey").alias("custkey"), "c_name"), "custkey").select("custkey", "o_orderkey", "c_name"))

# index lookups
_add("index_point", "SELECT * FROM orders WHERE o_orderkey = 77", lambda s, d: index.point(_orders(s, d), "o_orderkey", 77))
_add("index_range", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200 ORDER BY o_orderkey", lambda s, d: index.key_range(_orders(s, d), "o_orderkey", 100, 200))
_add("index_ordered", "SELECT * FROM supplier ORDER BY s_suppkey", lambda s, d: index.ordered(load(s, d, "supplier"), "s_suppkey"))
_add("index_min_max", "SELECT min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(o_orderkey) AS entries FROM orders", lambda s, d: index.bounds(_orders(s, d), "o_orderkey"))
_add("index_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS entries FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", lambda s, d: index.duplicates(load(s, d, "lineitem"), "l_orderkey", "l_linenumber"))

# aggregates
_add(
    "agg_global",
    "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_shipdate) AS lo, max(l_discount) AS hi FROM lineitem",
    lambda s, d: aggregate(load(s, d, "lineitem"), [measure("count", alias="n"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_extendedprice"), 4).alias("a"), measure("min", "l_shipdate", "lo"), measure("max", "l_discount", "hi")]),
)
_add("agg_grouped", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag", lambda s, d: aggregate(load(s, d, "lineitem"), [measure("count", alias="n"), F.round(F.sum("l_extendedprice"), 2).alias("s")], ["l_returnflag"]))
_add(
    "agg_multi_group",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    lambda s, d: aggregate(
        load(s, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'"),
        [F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), measure("count", alias="n")],
        ["l_returnflag", "l_linestatus"],
    ),
)
_add("agg_count_star", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", lambda s, d: aggregate(_orders(s, d), [measure("count", alias="n")], ["o_orderstatus"]))
_add("agg_count_distinct", "SELECT count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders", lambda s, d: aggregate(_orders(s, d), [measure("count_distinct", "o_custkey", "n"), measure("sum_distinct", "o_custkey", "s")]))
_add("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", lambda s, d: aggregate(_orders(s, d), [measure("count", alias="n")], ["o_custkey"], C("n") > 15))
_add("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", lambda s, d: aggregate(_orders(s, d).where("o_orderkey < 0"), [measure("count", alias="n"), measure("sum", "o_totalprice", "s"), measure("max", "o_orderkey", "m")]))
_add("agg_nulls", f"SELECT count(*) AS n, count(discount) AS m, round(avg(discount), 6) AS a FROM ({_LINES})", lambda s, d: aggregate(_lines(s, d), [measure("count", alias="n"), measure("count", "discount", "m"), F.round(F.avg("discount"), 6).alias("a")]))
_add("agg_expression_key", "SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY 1", lambda s, d: aggregate(_orders(s, d), [measure("count", alias="n")], [(C("o_custkey") % 10).alias("k")]))
_add("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", lambda s, d: load(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))

_add("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", lambda s, d: load(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))
_add("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", lambda s, d: load(s, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))
_add("agg_approx_distinct", "SELECT o_orderstatus, true AS near, count(*) AS n FROM orders GROUP BY o_orderstatus", lambda s, d: aggregate(_orders(s, d), [(F.abs(F.approx_count_distinct("o_custkey", 0.02) - F.count_distinct("o_custkey")) <= 0.1 * F.count_distinct("o_custkey")).alias("near"), measure("count", alias="n")], ["o_orderstatus"]))

# sort, limit, top-k
_SORTED = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY {}"


def _sorted(keys: Callable[[], list]) -> Query:
    return lambda s, d: sort(_orders(s, d).select("o_orderkey", "o_totalprice", "o_orderstatus"), *keys())


_add("sort_asc", _SORTED.format("o_totalprice ASC NULLS FIRST, o_orderkey"), _sorted(lambda: [C("o_totalprice").asc(), "o_orderkey"]))
_add("sort_desc", _SORTED.format("o_totalprice DESC NULLS LAST, o_orderkey"), _sorted(lambda: [C("o_totalprice").desc(), "o_orderkey"]))
_add("sort_mixed", _SORTED.format("o_orderstatus DESC, o_totalprice ASC, o_orderkey"), _sorted(lambda: [C("o_orderstatus").desc(), C("o_totalprice").asc(), "o_orderkey"]))
_add("sort_expr", _SORTED.format("abs(o_totalprice - 100000), o_orderkey"), _sorted(lambda: [F.abs(C("o_totalprice") - 100000), "o_orderkey"]))
_add("sort_full", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey", lambda s, d: sort(load(s, d, "customer"), C("c_acctbal").desc(), "c_custkey").select("c_custkey", "c_acctbal"))
_add("sort_hidden_key", "SELECT c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey", lambda s, d: sort(load(s, d, "customer"), C("c_acctbal").desc(), "c_custkey").select("c_name"))
_add("sort_nulls", f"SELECT * FROM ({_LINES}) ORDER BY discount ASC NULLS FIRST, l_orderkey, l_linenumber, l_extendedprice", lambda s, d: sort(_lines(s, d), C("discount").asc(), "l_orderkey", "l_linenumber", "l_extendedprice"))
_add("limit", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 7", lambda s, d: limit(sort(load(s, d, "supplier").select("s_suppkey"), "s_suppkey"), 7))
_add("limit_offset", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 7 OFFSET 5", lambda s, d: limit(sort(load(s, d, "supplier").select("s_suppkey"), "s_suppkey"), 7, 5))
_add("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem ORDER BY ALL DESC LIMIT 10", lambda s, d: top_k(load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), 10, *(C(c).desc() for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"))))

# columns: zone maps and codecs, in segments of 4096 keys
def _seg() -> Column:
    return columnar.segment_of("o_orderkey", 4096)


_ZONES = "SELECT o_orderkey // 4096 AS segment, min(o_custkey) AS min_value, max(o_custkey) AS max_value, count(*) FILTER (o_custkey IS NULL) AS null_count, count(*) AS row_count FROM orders GROUP BY 1"
_add("zone_map_stats", _ZONES, lambda s, d: columnar.zone_maps(_orders(s, d), "o_custkey", _seg()))
_add("zone_map_point", f"SELECT * FROM ({_ZONES}) WHERE 77 BETWEEN min_value AND max_value", lambda s, d: columnar.zone_maps(_orders(s, d), "o_custkey", _seg()).where(columnar.may_contain(77)))
_add("zone_map_nulls", f"SELECT * FROM ({_ZONES.replace('o_custkey', 'v').replace('FROM orders', 'FROM (SELECT o_orderkey, nullif(o_orderkey, 500) AS v FROM orders)')}) WHERE null_count > 0", lambda s, d: columnar.zone_maps(_orders(s, d).withColumn("v", F.nullif("o_orderkey", F.lit(500))), "v", _seg()).where(columnar.may_contain(None)))
_add("zone_map_range", "SELECT * FROM (SELECT o_orderkey // 4096 AS segment, min(o_orderkey) AS min_value, max(o_orderkey) AS max_value, count(*) FILTER (o_orderkey IS NULL) AS null_count, count(*) AS row_count FROM orders GROUP BY 1) WHERE NOT (max_value < 5000 OR min_value > 9000)", lambda s, d: columnar.zone_maps(_orders(s, d), "o_orderkey", _seg()).where(columnar.may_match_range(5000, 9000)))
_stores: dict[tuple[str, str], ColumnStore] = {}


def _order_store(spark: SparkSession, sf: str) -> ColumnStore:
    """Orders as a columnar table, written once for a Spark application and data directory."""
    at = spark.sparkContext.applicationId, sf
    if at not in _stores:
        store = ColumnStore(spark, f"{windows.scratch(spark)}/orders-{uuid.uuid4().hex}")
        for f in _orders(spark, sf).select("o_orderkey", "o_custkey").schema:
            store.add_column(f.name, f.dataType)
        store.insert(_orders(spark, sf).select("o_orderkey", "o_custkey"), _seg())
        _stores[at] = store
    return _stores[at]


_add("zone_map_scan", "SELECT o_orderkey, o_orderkey // 4096 AS segment FROM orders WHERE o_orderkey // 4096 IN (SELECT o_orderkey // 4096 FROM orders GROUP BY 1 HAVING max(o_orderkey) >= 9000)", lambda s, d: _order_store(s, d).scan_segments(["o_orderkey", "_segment"], "o_orderkey", ">=", 9000).select("o_orderkey", C("_segment").cast("long").alias("segment")))
_add("zone_map_scan_unmanaged", "SELECT o_orderkey, o_orderkey // 4096 AS segment FROM orders WHERE o_orderkey // 4096 IN (SELECT o_orderkey // 4096 FROM orders GROUP BY 1 HAVING max(o_custkey) >= 9000 OR min(o_custkey) < 50)", lambda s, d: columnar.zone_scan(_orders(s, d).select("o_orderkey", "o_custkey"), "o_custkey", _seg(), ">=", 9000, ("<", 50)).drop("o_custkey"))
_coded = lambda s, d: _orders(s, d).withColumn("v", F.nullif("o_orderpriority", F.lit("3-MEDIUM")))
_DECODED = "SELECT o_orderkey // 4096 AS segment, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) - 1 AS place, {} AS value FROM orders"
_PRIORITY = _DECODED.format("nullif(o_orderpriority, '3-MEDIUM')")
_places = lambda df: df.select("segment", C("place").cast("long").alias("place"), "value")
_add("rle_round_trip", _PRIORITY, lambda s, d: _places(columnar.rle_decode(columnar.rle_encode(_coded(s, d), "v", _seg(), "o_orderkey"))))
_add("dictionary_round_trip", _PRIORITY, lambda s, d: _places(columnar.dictionary_decode(*columnar.dictionary_encode(_coded(s, d), "v", _seg(), "o_orderkey"))))
_add("bitpack_round_trip", _DECODED.format("nullif(o_custkey, 77)"), lambda s, d: _places(columnar.bitpack_decode(columnar.bitpack_encode(_orders(s, d).withColumn("v", F.nullif("o_custkey", F.lit(77))), "v", _seg(), "o_orderkey"))))
_RUNS = """SELECT segment, count(*) AS runs, count(*) FILTER (v IS NULL) AS null_runs, CAST(sum(5 + CASE WHEN v IS NULL THEN 0 ELSE 4 + strlen(v) END) AS BIGINT) AS run_bytes FROM (
  SELECT o_orderkey // 4096 AS segment, v, row_number() OVER w = 1 OR v IS DISTINCT FROM lag(v) OVER w AS first FROM (SELECT *, nullif(o_orderstatus, 'P') AS v FROM orders)
  WINDOW w AS (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey)) WHERE first GROUP BY segment"""
_add("rle_runs", _RUNS, lambda s, d: columnar.rle_runs(_orders(s, d).withColumn("v", F.nullif("o_orderstatus", F.lit("P"))), "v", _seg(), "o_orderkey"))
_add("dict_cardinality", "SELECT o_orderkey // 4096 AS segment, count(DISTINCT o_orderpriority) AS entries, 4 + CAST(ceil(count(*) / 8) AS BIGINT) + 4 + CAST(sum(DISTINCT_BYTES) AS BIGINT) + 4 * count(*) AS dictionary_bytes FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN row_number() OVER (PARTITION BY o_orderkey // 4096, o_orderpriority ORDER BY o_orderkey) = 1 THEN 8 + strlen(o_orderpriority) ELSE 0 END AS DISTINCT_BYTES FROM orders) GROUP BY 1", lambda s, d: columnar.codec_sizes(_orders(s, d), "o_orderpriority", _seg(), "o_orderkey").select("segment", "entries", "dictionary_bytes"))
_add("bitpack_width", "SELECT o_orderkey // 4096 AS segment, CAST(CASE WHEN max(o_custkey) = min(o_custkey) THEN 1 ELSE length(bin(max(o_custkey) - min(o_custkey))) END AS INTEGER) AS bits FROM orders GROUP BY 1", lambda s, d: columnar.codec_sizes(_orders(s, d), "o_custkey", _seg(), "o_orderkey").select("segment", "bits"))
_add(
    "compression_ratio",
    """SELECT 'bitpack' AS codec, avg(8.0 * n / greatest(1, 4 + CAST(ceil(n / 8) AS BIGINT) + 9 + CAST(ceil(n * bits / 8) AS BIGINT))) AS ratio FROM (
       SELECT count(*) AS n, CASE WHEN max(o_custkey) = min(o_custkey) THEN 1 ELSE length(bin(max(o_custkey) - min(o_custkey))) END AS bits FROM orders GROUP BY o_orderkey // 4096)""",
    lambda s, d: columnar.compression_ratio(_orders(s, d), "o_custkey", _seg(), "o_orderkey", "bitpack"),
)

# changes of tables, as the rows after them
_CUST = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def _cust(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")


_add("dml_insert", f"{_CUST} UNION ALL VALUES (-1, 'new', 1.5), (-2, NULL, NULL)", lambda s, d: dml.insert(_cust(s, d), s.createDataFrame([(-1, "new", 1.5), (-2, None, None)], "c_custkey long, c_name string, c_acctbal double")))
_add("dml_insert_defaults", f"{_CUST} UNION ALL SELECT s_suppkey + 1000000, s_name, 7.0 FROM supplier", lambda s, d: dml.insert(_cust(s, d), load(s, d, "supplier").select((C("s_suppkey") + 1000000).alias("c_custkey"), C("s_name").alias("c_name")), {"c_acctbal": F.lit(7)}))
_add("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer", lambda s, d: dml.update(_cust(s, d), {"c_name": F.upper("c_name"), "c_acctbal": C("c_acctbal") + 1}, C("c_acctbal") < 0))
_add("dml_delete", f"{_CUST} WHERE NOT coalesce(nullif(c_acctbal, 0) < 0, false)", lambda s, d: dml.delete(_cust(s, d), F.nullif("c_acctbal", F.lit(0.0)) < 0))

_add("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS v(k, t) UNION ALL SELECT 1 + 2, 'x'", lambda s, d: s.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL) AS v(k, t) UNION ALL SELECT 1 + 2, 'x'"))


def facade_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table after statements of all kinds and two transactions that touch different rows."""
    db = Database("facade", f"{windows.scratch(spark)}/facade-{uuid.uuid4().hex}", spark)
    db.execute("CREATE TABLE c (k INTEGER PRIMARY KEY, name VARCHAR(30) NOT NULL, bal DOUBLE DEFAULT 0)")
    load(spark, sf, "customer").createOrReplaceGlobalTempView("facade_customer")
    db.execute("INSERT INTO c SELECT CAST(c_custkey AS INT), c_name, c_acctbal FROM global_temp.facade_customer")
    db.execute("INSERT INTO c (k, name) VALUES (-1, 'one'), (-2, 'two')")
    a, b = db.connect(), db.connect()
    a.begin()
    b.begin()
    a.execute("UPDATE c SET bal = bal + 1 WHERE bal < 0")
    b.execute("DELETE FROM c WHERE bal > 9000")
    a.commit()
    b.commit()
    a.begin()
    a.execute("DELETE FROM c")
    a.rollback()
    db.execute("UPDATE c SET name = UPPER(name), k = k * 10 WHERE k < 0")
    return Database("facade", db.path, spark).table("c")


_add("facade_statements", "SELECT CAST(c_custkey AS INTEGER) AS k, c_name AS name, CASE WHEN c_acctbal < 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer WHERE c_acctbal <= 9000 UNION ALL VALUES (-10, 'ONE', 0.0), (-20, 'TWO', 0.0)", facade_statements)

# versions and the log: a history made of the events
_HISTORY = "SELECT user_id AS rid, event_id AS xmin_ts, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS xmax_ts, value AS data FROM events"


def _history(spark: SparkSession, sf: str) -> DataFrame:
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return load(spark, sf, "events").select(C("user_id").alias("rid"), C("event_id").alias("xmin_ts"), after.alias("xmax_ts"), C("value").alias("data"))


#: Transactions of five events, many of which never end; their numbers grow in the order of the log.
_LOG = """SELECT 2 * event_id + 1 AS lsn, event_id // 5 AS txn_id, CASE event_type WHEN 'click' THEN 'INSERT' WHEN 'view' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' WHEN 'purchase' THEN 'COMMIT' ELSE 'ABORT' END AS log_type,
  event_id % 50 AS page_id, event_id % 7 AS slot_id, value - 1 AS before_image, value AS after_image FROM events
  UNION ALL SELECT DISTINCT 10 * (event_id // 5), event_id // 5, 'BEGIN', NULL, NULL, NULL, NULL FROM events"""
_CHANGED = "log_type IN ('INSERT', 'UPDATE', 'DELETE')"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    kind = F.when(C("event_type") == "click", "INSERT").when(C("event_type") == "view", "UPDATE").when(C("event_type") == "error", "DELETE").when(C("event_type") == "purchase", "COMMIT").otherwise("ABORT")
    txn = F.expr("event_id div 5").alias("txn_id")
    rows = events.select((2 * C("event_id") + 1).alias("lsn"), txn, kind.alias("log_type"), (C("event_id") % 50).alias("page_id"), (C("event_id") % 7).alias("slot_id"), (C("value") - 1).alias("before_image"), C("value").alias("after_image"))
    begins = events.select(txn).distinct().select((10 * C("txn_id")).alias("lsn"), "txn_id", F.lit("BEGIN").alias("log_type"), *(F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("slot_id", "long"), ("before_image", "double"), ("after_image", "double"))))
    return rows.unionByName(begins)


_STATUS = f"SELECT txn_id, coalesce(arg_max(log_type, lsn) FILTER (log_type IN ('COMMIT', 'ABORT')), 'ACTIVE') AS status, max(lsn) AS last_lsn FROM ({_LOG}) GROUP BY txn_id"
_add("mvcc_snapshot", f"SELECT rid, arg_max(data, xmin_ts) AS data FROM ({_HISTORY}) WHERE xmin_ts <= 5000 AND (xmax_ts IS NULL OR xmax_ts > 5000) GROUP BY rid", lambda s, d: versions.snapshot_read(_history(s, d), 5000))
_add("mvcc_latest", f"SELECT rid, data FROM ({_HISTORY}) WHERE xmax_ts IS NULL", lambda s, d: versions.snapshot_read(_history(s, d), 2**61))
_add("mvcc_conflicts", "SELECT DISTINCT user_id AS rid FROM events WHERE event_id > 9900", lambda s, d: versions.write_conflicts(_history(s, d), load(s, d, "events").select(C("user_id").alias("rid")).distinct(), 9900))
_add("wal_analysis", _STATUS, lambda s, d: versions.analysis(_log(s, d)))
_add("wal_dirty_pages", f"SELECT page_id, min(lsn) AS rec_lsn FROM ({_LOG}) WHERE {_CHANGED} GROUP BY page_id", lambda s, d: versions.dirty_pages(_log(s, d)))
_add("wal_from_lsn", f"SELECT * FROM ({_LOG}) WHERE lsn >= 501 ORDER BY lsn", lambda s, d: versions.from_lsn(_log(s, d), 501))
_REDO = f"SELECT page_id, slot_id, arg_max(after_image, lsn) AS image, arg_max(log_type, lsn) AS last FROM ({_LOG}) WHERE {_CHANGED} GROUP BY page_id, slot_id"
_add("wal_redo", f"SELECT page_id, slot_id, image FROM ({_REDO}) WHERE last <> 'DELETE'", lambda s, d: versions.redo(_log(s, d)))
_UNDO = f"SELECT page_id, slot_id, arg_min(before_image, lsn) AS image FROM ({_LOG}) WHERE {_CHANGED} AND txn_id IN (SELECT txn_id FROM ({_STATUS}) WHERE status = 'ACTIVE') GROUP BY page_id, slot_id"
_add("wal_undo", _UNDO, lambda s, d: versions.undo(_log(s, d)))
_add(
    "wal_recover",
    f"""SELECT coalesce(r.page_id, u.page_id) AS page_id, coalesce(r.slot_id, u.slot_id) AS slot_id, CASE WHEN u.page_id IS NOT NULL THEN u.image ELSE r.image END AS image
        FROM (SELECT * FROM ({_REDO}) WHERE last <> 'DELETE') r FULL JOIN ({_UNDO}) u ON r.page_id = u.page_id AND r.slot_id = u.slot_id WHERE CASE WHEN u.page_id IS NOT NULL THEN u.image ELSE r.image END IS NOT NULL""",
    lambda s, d: versions.recover(_log(s, d)),
)

# metrics
_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0)
_HISTOGRAM = "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate(_BOUNDS)) + ", count(value) AS count, round(sum(value), 4) AS sum FROM events GROUP BY event_type"
_add("metrics_counter", "SELECT event_type, round(sum(value), 4) AS total, count(*) AS samples FROM events GROUP BY event_type", lambda s, d: metrics.counter(load(s, d, "events"), "value", "event_type").withColumn("total", F.round("total", 4)))
_add("metrics_histogram", _HISTOGRAM, lambda s, d: metrics.histogram(load(s, d, "events"), "value", _BOUNDS, "event_type").withColumn("sum", F.round("sum", 4)))


def _quantile_sql(p: float) -> str:
    cases = []
    for i, b in enumerate(_BOUNDS):
        low, below = (_BOUNDS[i - 1], f"le_{i - 1}") if i else (0.0, "0")
        cases.append(f"WHEN le_{i} >= count * {p} THEN {low} + CASE WHEN le_{i} - {below} > 0 THEN (count * {p} - {below}) / (le_{i} - {below}) ELSE 0 END * ({b} - {low})")
    return f"SELECT event_type, round(CASE {' '.join(cases)} ELSE {_BOUNDS[-1]} END, 6) AS p50 FROM ({_HISTOGRAM})"


_add("metrics_percentile", _quantile_sql(0.5), lambda s, d: metrics.histogram(load(s, d, "events"), "value", _BOUNDS, "event_type").select("event_type", F.round(metrics.bucket_percentile(0.5, _BOUNDS), 6).alias("p50")))
_add("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", lambda s, d: windows.stream(s, d, "events"))

# set operations
_add("set_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region", lambda s, d: load(s, d, "nation").select(C("n_name").alias("name")).union(load(s, d, "region").select("r_name")).distinct())
_add("set_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0", lambda s, d: load(s, d, "customer").select(C("c_nationkey").alias("k")).subtract(load(s, d, "supplier").where("s_nationkey % 2 = 0").select("s_nationkey")))
_add("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", lambda s, d: load(s, d, "customer").select(C("c_nationkey").alias("k")).intersect(load(s, d, "supplier").select("s_nationkey")))
_add("window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders", lambda s, d: _orders(s, d).select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(C("o_totalprice").desc())).cast("long").alias("r")))
