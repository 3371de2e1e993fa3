"""Registered relational queries and, where SQL can say the same, their SQL.

Results are compared without order, so queries that sort return each row's
place under a total key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import Avg, Count, Max, Min, Sum
from .operators import checks, codes, joins, metrics, reshape
from .operators.aggregate import group_by
from .operators.distinct import distinct, duplicates
from .operators.keys import Split
from .operators.sort import placed, resort, segment_counts, sort, sort_distinct, sort_run
from .plans import bushy, intersect_distinct, join_then_group, left_deep, right_deep
from .sources import generate, runfile
from .storage import shared_path

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- filter and reshape


@_query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def filter_even_key(spark, d):
    return reshape.keep(_table(spark, d, "orders"), F.col("o_orderkey") % 2 == 0)


@_query("SELECT l_suppkey AS c0, l_linenumber AS c1, l_orderkey AS c2, l_partkey AS c3, l_quantity AS c4 FROM lineitem")
def transpose_blocks(spark, d):
    rows = _table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return reshape.transpose(rows, 2).toDF("c0", "c1", "c2", "c3", "c4")


@_query("SELECT o_orderkey, o_custkey FROM orders, range(3)")
def multiply_rows(spark, d):
    return reshape.multiply(_table(spark, d, "orders", "o_orderkey", "o_custkey"), 3)


@_query("SELECT o_orderkey, o_custkey FROM orders")
def shuffle_rows(spark, d):
    return reshape.shuffle(_table(spark, d, "orders", "o_orderkey", "o_custkey"), 7)


@_query("SELECT c_custkey, c_nationkey FROM customer")
def partition_rows(spark, d):
    return reshape.hash_partition(_table(spark, d, "customer", "c_custkey", "c_nationkey"), 16, "c_nationkey")


# --- sorts: the place of each row, counted as the sort has laid it


_SORT_SQL = "SELECT o_custkey, o_totalprice, o_orderkey, row_number() OVER (ORDER BY {}) AS place FROM orders"


@_query(_SORT_SQL.format("o_custkey, o_totalprice, o_orderkey"))
def sort_full(spark, d):
    rows = _table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderkey")
    return placed(sort(rows))


@_query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders")
def sort_prefix(spark, d):
    rows = _table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return placed(sort(rows, 2))


@_query("SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS place FROM orders")
def sort_list(spark, d):
    rows = _table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    order = ["o_orderpriority", "o_orderstatus", "o_orderkey"]
    return placed(sort(rows, order))


@_query("SELECT count(*) AS rows, 0::BIGINT AS violations FROM orders")
def sort_in_order(spark, d):
    return checks.order_violations(sort(_table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderkey")))


@_query("SELECT s_suppkey, s_nationkey FROM supplier")
def sort_runs(spark, d):
    return sort_run(_table(spark, d, "supplier", "s_suppkey", "s_nationkey"))


_LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)", name="sort_distinct_places")
def _sort_distinct(spark, d):
    rows = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    return placed(sort_distinct(rows))


@_query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey", name="sort_distinct_prefix")
def _sort_distinct_prefix(spark, d):
    return sort_distinct(_table(spark, d, "orders", "o_custkey", "o_orderkey"), 1)


_SPLIT = Split(("l_suppkey",), ("l_orderkey",), ("l_partkey", "l_linenumber"))
_SEGMENT_SQL = "SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_linenumber, l_orderkey) AS place FROM (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)"
_RESORTED_SQL = "SELECT count(*) AS rows, 0::BIGINT AS violations FROM lineitem"


def _abc(spark, d):
    return sort(_table(spark, d, "lineitem", *_SPLIT.abc), _SPLIT.abc)


for _strategy in ("segmented", "unsegmented", "runs_ignored"):
    _query(_RESORTED_SQL, name=f"resort_{_strategy}")(lambda spark, d, s=_strategy: checks.order_violations(resort(_abc(spark, d), _SPLIT, s), _SPLIT.acb))


@_query(_SEGMENT_SQL)
def resort_places(spark, d):
    rows = group_by(_table(spark, d, "lineitem", *_SPLIT.abc), _SPLIT.abc, Count("n"))
    again = placed(resort(rows, _SPLIT), "__at")
    first = F.min("__at").over(Window.partitionBy(*_SPLIT.a))
    return again.withColumn("place", F.col("__at") - first + 1).drop("__at")


@_query("SELECT count(DISTINCT l_suppkey) AS segments, count(DISTINCT (l_suppkey, l_orderkey)) AS runs FROM lineitem")
def segments_and_runs(spark, d):
    return segment_counts(_table(spark, d, "lineitem", *_SPLIT.abc), _SPLIT)


# --- duplicate removal

for _strategy in ("hash", "sort", "stream"):
    _query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem", name=f"{_strategy}_distinct")(lambda spark, d, s=_strategy: distinct(_table(spark, d, "lineitem", "l_partkey", "l_suppkey"), strategy=s))


@_query("SELECT DISTINCT l_orderkey FROM lineitem")
def prefix_distinct(spark, d):
    return distinct(_table(spark, d, "lineitem", "l_orderkey"), 1)


@_query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def prefix_distinct_first(spark, d):
    return distinct(_table(spark, d, "orders", "o_custkey", "o_orderkey"), 1, "stream", tiebreak=["o_orderkey"])


@_query("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS num_dupes FROM lineitem")
def duplicate_count(spark, d):
    return duplicates(_table(spark, d, "lineitem", "l_orderkey", "l_linenumber"))


# --- grouping

_AGGREGATES = {"count": (Count("result"), "count(*)"), "sum": (Sum("l_linenumber", "result"), "CAST(sum(l_linenumber) AS BIGINT)"), "avg": (Avg("l_partkey", "result"), "CAST(sum(l_partkey) AS BIGINT) // count(l_partkey)"), "max": (Max("l_partkey", "result"), "max(l_partkey)"), "min": (Min("l_partkey", "result"), "min(l_partkey)")}
for _strategy in ("hash", "stream", "sort"):
    for _which, (_aggregate, _expression) in _AGGREGATES.items():
        _query(f"SELECT l_orderkey, l_linenumber, {_expression} AS result FROM lineitem GROUP BY l_orderkey, l_linenumber", name=f"groupby_{_strategy}_{_which}")(lambda spark, d, s=_strategy, a=_aggregate: group_by(_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), 2, a, strategy=s))


@_query("SELECT l_suppkey, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum, max(l_partkey) AS max FROM lineitem GROUP BY l_suppkey")
def groupby_several(spark, d):
    return group_by(_table(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_partkey"), 1, Count(), Sum("l_linenumber"), Max("l_partkey"))


# --- semi joins

_OPEN = "SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"
for _strategy in ("merge", "hash", "broadcast", "auto"):
    _query(_OPEN, name=f"semi_{_strategy}")(lambda spark, d, s=_strategy: joins.left_semi(_table(spark, d, "orders"), _table(spark, d, "lineitem").filter("l_quantity > 45"), [("o_orderkey", "l_orderkey")], s))


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, d):
    return joins.left_anti(_table(spark, d, "customer", "c_custkey"), _table(spark, d, "orders").filter("o_totalprice > 400000"), [("c_custkey", "o_custkey")])


@_query("SELECT l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_linenumber = 1 AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)")
def semi_prefix(spark, d):
    lines = _table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_linenumber")
    return joins.left_semi_prefix(lines.select("l_partkey", "l_suppkey"), lines.filter("l_linenumber = 1").toDF("a", "b", "c"), 2)


_TREE = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING'))
AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 25) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)"""


def _five(spark, d):
    return (
        _table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), _table(spark, d, "orders", "o_orderkey", "o_custkey"),
        _table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"), _table(spark, d, "part").filter("p_size < 25").select("p_partkey"), _table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey"),
    )


@_query(_TREE)
def semi_tree_left_deep(spark, d):
    lines, orders, customers, parts, suppliers = _five(spark, d)
    theirs = joins.left_semi(orders, customers, [("o_custkey", "c_custkey")])
    return left_deep(lines, [(parts, [("l_partkey", "p_partkey")]), (suppliers, [("l_suppkey", "s_suppkey")]), (theirs, [("l_orderkey", "o_orderkey")])])


@_query(_TREE)
def semi_tree_right_deep(spark, d):
    lines, orders, customers, parts, suppliers = _five(spark, d)
    found = right_deep([lines, orders, customers], [[("l_orderkey", "o_orderkey")], [("o_custkey", "c_custkey")]], "merge")
    return left_deep(found, [(parts, [("l_partkey", "p_partkey")]), (suppliers, [("l_suppkey", "s_suppkey")])])


@_query(_TREE)
def semi_tree_bushy(spark, d):
    lines, orders, customers, parts, suppliers = _five(spark, d)
    left = (lines, [(parts, [("l_partkey", "p_partkey")]), (suppliers, [("l_suppkey", "s_suppkey")])])
    return bushy(left, (orders, [(customers, [("o_custkey", "c_custkey")])]), [("l_orderkey", "o_orderkey")], "hash")


_JOIN_GROUP = "SELECT l_orderkey, count(*) AS count FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY l_orderkey"
for _join, _group, _name in (("merge", "hash", "join_group"), ("merge", "stream", "join_group_stream"), ("hash", "hash", "join_group_hash")):
    _query(_JOIN_GROUP, name=_name)(lambda spark, d, j=_join, g=_group: join_then_group(_table(spark, d, "lineitem", "l_orderkey"), _table(spark, d, "orders").filter("o_orderstatus = 'F'"), [("l_orderkey", "o_orderkey")], ["l_orderkey"], Count(), join=j, group=g))


@_query("SELECT l_partkey AS part FROM lineitem WHERE l_quantity > 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2", name="intersect_distinct")
def _intersect_distinct(spark, d):
    lines = _table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_linenumber")
    return intersect_distinct(lines.filter("l_quantity > 25").select(F.col("l_partkey").alias("part")), lines.filter("l_linenumber = 2").select("l_partkey"))


# --- codes

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _codes_sql(table: str, keys: list[str] = _KEYS, tie: str = ", l_suppkey") -> str:
    """Offset and value of each row against the one before, by lag."""
    lags = ", ".join(f"lag({k}) OVER w AS b{i}" for i, k in enumerate(keys))
    offset = f"CASE WHEN nth = 1 OR {keys[0]} IS DISTINCT FROM b0 THEN 0 " + " ".join(f"WHEN {k} IS DISTINCT FROM b{i} THEN {i}" for i, k in enumerate(keys) if i) + f" ELSE {len(keys)} END"
    order, values = ", ".join(keys), " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(keys))
    return f"""SELECT *, CASE "offset" {values} END AS "value" FROM (
SELECT {order}, {offset} AS "offset" FROM (SELECT *, row_number() OVER w AS nth, {lags} FROM {table} WINDOW w AS (ORDER BY {order}{tie})))"""


_ROWS = "(SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem)"
_PICK = 'SELECT l_orderkey, l_linenumber, l_partkey, "offset", "value" FROM ({})'


def _coded(spark, d, strategy_rows=None):
    rows = _table(spark, d, "lineitem", *_KEYS, "l_suppkey") if strategy_rows is None else strategy_rows
    return codes.derive(rows.withColumn("l_linenumber", F.col("l_linenumber").cast("long")), _KEYS, tiebreak=["l_suppkey"])


@_query(_PICK.format(_codes_sql(_ROWS)))
def codes_derive(spark, d):
    return _coded(spark, d).select(*_KEYS, "offset", "value")


@_query(_PICK.format(_codes_sql(_ROWS)))
def codes_applied(spark, d):
    rows = _table(spark, d, "lineitem", *_KEYS, "l_suppkey").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return codes.applied(sort(rows, [*_KEYS, "l_suppkey"]), _KEYS).select(*_KEYS, "offset", "value")


@_query('SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey, "offset", "value" FROM (' + _codes_sql(_ROWS, _SPLIT.acb, "") + ")")
def codes_resort(spark, d):
    rows = _table(spark, d, "lineitem", *_SPLIT.abc).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return codes.resort(codes.derive(rows, _SPLIT.abc), _SPLIT).select(*_SPLIT.acb, "offset", "value")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS count, CAST(sum(l_partkey) AS BIGINT) AS sum, max(l_suppkey) AS max FROM lineitem GROUP BY l_orderkey, l_linenumber")
def groupby_codes(spark, d):
    return codes.group_by(_coded(spark, d), _KEYS, 2, Count(), Sum("l_partkey"), Max("l_suppkey"), tiebreak=["l_suppkey"])


@_query('SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN "offset" = 3 THEN 0 ELSE ((32 - "offset")::BIGINT << 25) | "value" END AS packed FROM (' + _codes_sql(_ROWS) + ")")
def codes_packed(spark, d):
    return _coded(spark, d).select(*_KEYS, codes.packed().alias("packed"))


@_query(_PICK.format(_codes_sql("(SELECT * FROM " + _ROWS + " WHERE l_partkey % 3 = 0)")))
def codes_after_filter(spark, d):
    return codes.repaired(_coded(spark, d), F.col("l_partkey") % 3 == 0, _KEYS, tiebreak=["l_suppkey"]).select(*_KEYS, "offset", "value")


@_query(_PICK.format(_codes_sql("(SELECT * FROM " + _ROWS + " WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))")))
def codes_after_semi(spark, d):
    open_orders = _table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return codes.semi(_coded(spark, d), open_orders, [("l_orderkey", "o_orderkey")], _KEYS, tiebreak=["l_suppkey"]).select(*_KEYS, "offset", "value")


@_query(_PICK.format(_codes_sql("(SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, 0 AS l_suppkey FROM lineitem)")))
def codes_distinct(spark, d):
    return codes.distinct(_coded(spark, d), _KEYS).select(*_KEYS, "offset", "value")


@_query("SELECT count(DISTINCT l_orderkey) AS groups FROM lineitem")
def codes_group_boundaries(spark, d):
    return codes.boundaries(_coded(spark, d), 1).agg(F.count(F.lit(1)).alias("groups"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, \"offset\" FROM (" + _codes_sql(_ROWS) + ") WHERE \"offset\" < 2")
def codes_run_boundaries(spark, d):
    return codes.boundaries(_coded(spark, d), 2).select(*_KEYS, "offset")


@_query('SELECT CAST(coalesce(sum(least("offset" + 1, 3)) - 1, 0) AS BIGINT) AS column_comparisons FROM (' + _codes_sql(_ROWS) + ")")
def truncation_cost(spark, d):
    return codes.truncation_cost(_coded(spark, d), _KEYS)


# --- checks


@_query("SELECT 0::BIGINT AS violations")
def check_equal(spark, d):
    rows = _table(spark, d, "orders", "o_orderkey", "o_custkey")
    return checks.differences(rows, sort(rows))


@_query("SELECT 0::BIGINT AS violations")
def check_positions(spark, d):
    rows = _table(spark, d, "orders", "o_custkey", "o_orderkey")
    return checks.position_differences(sort(rows), resort(rows, Split(("o_custkey",), (), ("o_orderkey",))))


@_query("SELECT count(*) AS rows, count(*) AS rows_written, count(*) AS rows_read FROM orders")
def sort_metrics(spark, d):
    return metrics.run_metrics(sort(_table(spark, d, "orders", "o_custkey", "o_orderkey"))).select("rows", "rows_written", "rows_read")


@_query("SELECT count(*) AS rows, 0::BIGINT AS violations FROM orders")
def check_sorted_unique(spark, d):
    return checks.order_violations(sort(_table(spark, d, "orders", "o_orderkey")), strict=True)


@_query("SELECT 0::BIGINT AS violations")
def check_codes(spark, d):
    return checks.code_violations(_coded(spark, d), _KEYS, tiebreak=["l_suppkey"])


# --- sources and sinks


@_query("SELECT o_orderkey AS c0, o_custkey AS c1, o_orderkey + 1 AS tid FROM orders")
def run_file_round_trip(spark, d):
    runfile.register(spark)
    path = shared_path(spark, "runs")
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("c0"), F.col("o_custkey").alias("c1"), (F.col("o_orderkey") + 1).alias("tid"))
    rows.write.format("runfile").mode("append").save(path)
    return spark.read.format("runfile").load(path).select("c0", "c1", "tid")


# --- generators: rows by hash, so that only their properties are known

_N = 20_000


def _profile(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), *(F.countDistinct(c).alias(f"{c}_values") for c in columns), F.countDistinct(*columns).alias("different"))


@_query(f"SELECT {_N}::BIGINT AS rows, 1::BIGINT AS c0_values, 2::BIGINT AS c1_values, 4::BIGINT AS c2_values, 100::BIGINT AS c7_values, 800::BIGINT AS different")
def gen_increasing(spark, d):
    return _profile(generate.increasing_ranges(spark, _N, 1), "c0", "c1", "c2", "c7")


@_query(f"SELECT {_N}::BIGINT AS rows, 8::BIGINT AS c0_values, 1::BIGINT AS c1_values, 16::BIGINT AS c2_values, 128::BIGINT AS different")
def gen_bits(spark, d):
    return _profile(generate.with_bits(spark, _N, [3, 0, 4], 1), "c0", "c1", "c2")


@_query(f"SELECT {_N}::BIGINT AS rows, 1::BIGINT AS c0_values, 7::BIGINT AS c1_values, 5::BIGINT AS c2_values, 35::BIGINT AS different")
def gen_domains(spark, d):
    return _profile(generate.with_domains(spark, _N, [0, 7, 5], 1), "c0", "c1", "c2")


@_query(f"SELECT {_N}::BIGINT AS rows, 200::BIGINT AS c0_values, 150::BIGINT AS c1_values, {_N}::BIGINT AS different")
def gen_unique(spark, d):
    return _profile(generate.unique_rows(spark, _N, [200, 150], seed=1), "c0", "c1")


@_query(f"SELECT {_N}::BIGINT AS rows, 1::BIGINT AS c0_values, {_N // 4}::BIGINT AS different")
def gen_duplicates(spark, d):
    return _profile(generate.duplicates(spark, _N, 8, 4, 3, 1, 1), "c0", "c1", "c2").drop("c1_values", "c2_values")


@_query()
def gen_about_distinct(spark, d):
    return _profile(generate.about_distinct(spark, _N, 5_000, 2, 1), "c0", "c1")


@_query(f"SELECT {_N}::BIGINT AS rows, 50::BIGINT AS c1_values, 10::BIGINT AS c2_values, 4::BIGINT AS c4_values, 2000::BIGINT AS different")
def gen_segments(spark, d):
    return _profile(generate.segments(spark, _N, (50, 10, 4), (2, 1, 2), 1), "c1", "c2", "c4")
