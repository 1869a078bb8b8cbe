"""Registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.aggregates import whole_column
from .operators.relational import SortKey, add_column, filter_rows, group_rows, join_rows, select_columns, sort_keys
from .operators.table import Table
from .operators.views import SortedView
from .plans.pipeline import build_pipeline, mini_filter, mini_group
from .sources.storage import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _small(spark: SparkSession, df: DataFrame, name: str) -> Table:
    return Table.from_dataframe(name, df)


_SPEC = [("total", "o_totalprice", "sum"), ("average", "o_totalprice", "avg"), ("n", "o_totalprice", "count"), ("p95", "o_totalprice", "p95")]


@_query("""SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS average, count(o_totalprice) AS n,
  round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders WHERE o_totalprice >= 200000 GROUP BY 1""")
def flagship_cascade(spark, sf):
    kept = filter_rows(read_table(spark, sf, "orders"), "o_totalprice >= 200000")
    return _rounded(_rounded(group_rows(kept, ["o_orderpriority"], _SPEC), "total", "average", digits=2), "p95")


# -- predicates

_PREDICATES = {
    "filter_compare": ("l_quantity >= 45", "l_quantity >= 45"),
    "filter_and_or_not": ("l_quantity < 5 AND l_discount > 0.05 OR NOT l_tax <= 0.07", "l_quantity < 5 AND l_discount > 0.05 OR NOT l_tax <= 0.07"),
    "filter_parens": ("(l_returnflag = 'R' or l_returnflag = 'A') and !(l_linenumber != 1)", "l_returnflag IN ('R', 'A') AND l_linenumber = 1"),
    "filter_not_equal": ("l_returnflag != 'N' AND l_linenumber == 2", "l_returnflag <> 'N' AND l_linenumber = 2"),
    "filter_unknown_column": ("nothing > 5 OR l_linenumber = 3", "l_linenumber = 3"),
    "filter_type_mismatch_false": ("l_returnflag = 5 OR l_quantity > 49.5", "l_quantity > 49.5"),
    "filter_temporal_null_only": ("l_shipdate = '1995-01-01' OR NOT l_shipdate IS NULL AND l_quantity = 1", "l_quantity = 1"),
}
for _name, (_expr, _where) in _PREDICATES.items():
    _query(f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE {_where}", _name)(
        lambda spark, sf, e=_expr: select_columns(filter_rows(read_table(spark, sf, "lineitem"), e), ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])
    )

_NULLED = {
    "filter_not_over_null": ("NOT q > 30", "NOT coalesce(q > 30, false)"),
    "filter_is_null": ("q IS NULL", "q IS NULL"),
    "filter_is_not_null": ("q is not null AND q >= 48", "q IS NOT NULL AND q >= 48"),
    "filter_null_literal": ("q = null OR q = 7", "q = 7"),
}
for _name, (_expr, _where) in _NULLED.items():
    _query(f"SELECT * FROM (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 10) AS q FROM lineitem) WHERE {_where}", _name)(
        lambda spark, sf, e=_expr: filter_rows(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(10.0)).alias("q")), e)
    )


@_query("SELECT * FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events) WHERE NOT isnan(v) AND v > 50", "filter_nan")
def _filter_nan(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v")
    return filter_rows(read_table(spark, sf, "events").select("event_id", v), "v > 50")


@_query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def filter_string_eq(spark, sf):
    return select_columns(filter_rows(read_table(spark, sf, "events"), "event_type = 'purchase'"), ["event_id", "user_id"])


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'B%' AND c_acctbal > 0")
def filter_udf(spark, sf):
    df = read_table(spark, sf, "customer")
    return select_columns(filter_rows(df, lambda r: r["c_mktsegment"].startswith("B") and r["c_acctbal"] > 0), ["c_custkey", "c_mktsegment"])


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_over_filter(spark, sf):
    return select_columns(filter_rows(filter_rows(read_table(spark, sf, "orders"), "o_totalprice > 100000"), "o_orderstatus = 'F'"), ["o_orderkey"])


@_query("SELECT i FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal FROM customer) WHERE c_acctbal > 9000")
def filter_expr_indices(spark, sf):
    table = _small(spark, read_table(spark, sf, "customer").orderBy("c_custkey"), "customer")
    return spark.createDataFrame([(i,) for i in table.filter_expr("c_acctbal > 9000")], "i long")


@_query("""SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS place, l_orderkey, l_linenumber, l_quantity, l_comment_length FROM
  (SELECT *, length(l_returnflag || l_linestatus) AS l_comment_length FROM lineitem)""")
def root_over_sorted_lineitem(spark, sf):
    """Every row of a root over an ordered, shuffled frame, with its place."""
    from .operators.table import POSITION

    df = read_table(spark, sf, "lineitem").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    df = df.select("l_orderkey", "l_linenumber", "l_quantity", F.length(F.concat("l_returnflag", "l_linestatus")).cast("long").alias("l_comment_length"))
    rows = Table.from_dataframe("lineitem", df).to_df(hidden=True)
    return rows.select(F.col(POSITION).alias("place"), "l_orderkey", "l_linenumber", "l_quantity", "l_comment_length")


# -- projections and computed columns


@_query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def project(spark, sf):
    return select_columns(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity"])


_NET = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"


@_query(_NET)
def computed_expr(spark, sf):
    df = add_column(read_table(spark, sf, "lineitem"), "net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))
    return select_columns(df, ["l_orderkey", "l_linenumber", "net"])


@_query("SELECT s_suppkey, upper(s_name) AS loud, s_nationkey * 2 AS twice FROM supplier")
def computed_udf(spark, sf):
    from pyspark.sql import types as T

    df = add_column(read_table(spark, sf, "supplier"), "loud", lambda r: r["s_name"].upper(), T.StringType())
    return select_columns(add_column(df, "twice", lambda r: r["s_nationkey"] * 2, T.IntegerType()), ["s_suppkey", "loud", "twice"])


# -- joins


def _people(spark, sf):
    """Two sides of events with orphans each way."""
    e = read_table(spark, sf, "events")
    left = e.where("event_type = 'purchase' AND user_id < 100").select("event_id", "user_id", "value")
    right = e.where("event_type = 'error' AND user_id >= 50").select("event_id", "user_id", "ts")
    return left, right


for _how in ("inner", "left", "right", "full"):
    _query(
        f"""SELECT a.event_id, a.user_id, a.value, b.event_id AS right_event_id, b.user_id AS right_user_id, b.ts AS right_ts
        FROM (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id < 100) a
        {_how.upper()} JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND user_id >= 50) b ON a.user_id = b.user_id""",
        f"join_{_how}",
    )(lambda spark, sf, h=_how: join_rows(*_people(spark, sf), on="user_id", how=h, many=True))


@_query("SELECT d.doc_id, d.lang, l.doc_id AS right_doc_id, l.quality AS right_quality, l.toxic AS right_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_default_left(spark, sf):
    return join_rows(read_table(spark, sf, "documents").select("doc_id", "lang"), read_table(spark, sf, "labels"), on="doc_id")


@_query("""SELECT a.l_orderkey, a.l_linenumber, b.l_orderkey AS right_l_orderkey, b.l_linenumber AS right_l_linenumber, b.l_tax AS right_l_tax
  FROM lineitem a LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 25) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def join_composite(spark, sf):
    df = read_table(spark, sf, "lineitem")
    right = filter_rows(df, "l_quantity > 25").select("l_orderkey", "l_linenumber", "l_tax")
    return join_rows(df.select("l_orderkey", "l_linenumber"), right, on=["l_orderkey", "l_linenumber"])


@_query("""WITH a AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer), b AS (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier)
  SELECT c_custkey, a.k, s_suppkey AS right_s_suppkey, b.k AS right_k FROM a FULL JOIN b ON a.k = b.k""")
def join_null_keys(spark, sf):
    a = read_table(spark, sf, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = read_table(spark, sf, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("k"))
    return join_rows(a, b, on="k", how="outer", many=True)


@_query("""WITH a AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'NaN'::DOUBLE ELSE c_nationkey::DOUBLE END AS k FROM customer),
  b AS (SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'NaN'::DOUBLE ELSE s_nationkey::DOUBLE END AS k FROM supplier)
  SELECT c_custkey, s_suppkey AS right_s_suppkey FROM a LEFT JOIN b ON a.k = b.k AND NOT isnan(a.k)""")
def join_nan_keys(spark, sf):
    key = lambda c: F.when(F.col(c) == 3, F.lit(float("nan"))).otherwise(F.col(c).cast("double")).alias("k")
    a = read_table(spark, sf, "customer").select("c_custkey", key("c_nationkey"))
    b = read_table(spark, sf, "supplier").select("s_suppkey", key("s_nationkey"))
    return select_columns(join_rows(a, b, on="k", many=True), ["c_custkey", "right_s_suppkey"])


@_query("SELECT a.event_type, b.event_type AS right_event_type, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id GROUP BY 1, 2")
def join_many_to_many(spark, sf):
    counts = read_table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    both = join_rows(counts, counts, on="user_id", how="inner")  # counts multiply: the pairs themselves are never made
    return both.groupBy("event_type", "right_event_type").agg(F.sum(F.col("n") * F.col("right_n")).alias("n"))


@_query("SELECT c_mktsegment AS right_c_mktsegment, round(sum(o_totalprice), 2) AS total, count(o_totalprice) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_then_group(spark, sf):
    joined = join_rows(read_table(spark, sf, "orders"), read_table(spark, sf, "customer"), how="inner", left_on="o_custkey", right_on="c_custkey")
    return _rounded(group_rows(joined, "right_c_mktsegment", [("total", "o_totalprice", "sum"), ("n", "o_totalprice", "count")]), "total", digits=2)


# -- aggregates

for _kind, _sql in (
    ("sum", "round(sum(l_extendedprice), 2)"), ("avg", "round(avg(l_extendedprice), 4)"), ("min", "min(l_extendedprice)"),
    ("max", "max(l_extendedprice)"), ("count_non_null", "count(l_extendedprice)"),
):
    _query(f"SELECT {_sql} AS v FROM lineitem", f"agg_{_kind}")(lambda spark, sf, k=_kind: _whole(read_table(spark, sf, "lineitem"), k))


def _whole(df, kind):
    v = whole_column(df, kind, "l_extendedprice")
    return df.agg((F.round(v, {"sum": 2, "avg": 4}[kind]) if kind in ("sum", "avg") else v).alias("v"))


@_query("SELECT 0.0::DOUBLE AS s, NULL::DOUBLE AS a, count(l_returnflag) AS n FROM lineitem")
def agg_non_numeric(spark, sf):
    df = read_table(spark, sf, "lineitem")
    return df.agg(*[whole_column(df, k, "l_returnflag").alias(n) for k, n in (("sum", "s"), ("avg", "a"), ("count_non_null", "n"))])


_ALL = [(f, "l_quantity", f) for f in ("sum", "count", "avg", "min", "max", "median")]


@_query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS sum, count(l_quantity) AS count, round(avg(l_quantity), 6) AS avg, min(l_quantity) AS min,
  max(l_quantity) AS max, median(l_quantity) AS median FROM lineitem GROUP BY 1""")
def group_all_functions(spark, sf):
    return _rounded(_rounded(group_rows(read_table(spark, sf, "lineitem"), "l_returnflag", _ALL), "sum", digits=2), "avg", digits=6)


@_query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price, max(l_linenumber)::DOUBLE AS line FROM lineitem GROUP BY 1, 2")
def group_multi_key(spark, sf):
    return _rounded(group_rows(read_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [("price", "l_extendedprice", "sum"), ("line", "l_linenumber", "maximum")]), "price", digits=2)


_PS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "percentile(0.333)": 0.333}


@_query("SELECT l_linestatus, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS q{i}" for i, p in enumerate(_PS.values())) + " FROM lineitem GROUP BY 1")
def group_percentiles(spark, sf):
    df = group_rows(read_table(spark, sf, "lineitem"), "l_linestatus", [(f"q{i}", "l_extendedprice", n) for i, n in enumerate(_PS)])
    return _rounded(df, *[f"q{i}" for i in range(len(_PS))])


@_query("SELECT nullif(event_type, 'error') AS k, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def group_null_key(spark, sf):
    df = read_table(spark, sf, "events").select(F.nullif("event_type", F.lit("error")).alias("k"), "value")
    return _rounded(group_rows(df, "k", [("n", "value", "count"), ("total", "value", "sum")]), "total")


@_query("SELECT CASE WHEN event_id % 5 = 0 THEN 'NaN' ELSE CAST(event_id % 5 AS VARCHAR) END AS k, count(*) AS n FROM events GROUP BY 1")
def group_nan_key(spark, sf):
    key = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("event_id") % 5).cast("double"))
    df = group_rows(read_table(spark, sf, "events").select(key.alias("k"), "value"), "k", [("n", "value", "count")])
    return df.select(F.when(F.isnan("k"), "NaN").otherwise(F.col("k").cast("long").cast("string")).alias("k"), "n")


@_query("""SELECT event_type, count(v) AS n, round(sum(v), 4) AS total, min(v) AS low FROM
  (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1""")
def group_nan_excluded(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v")
    df = read_table(spark, sf, "events").select("event_type", v)
    return _rounded(group_rows(df, "event_type", [("n", "v", "count"), ("total", "v", "sum"), ("low", "v", "min")]), "total")


@_query("SELECT c_mktsegment, 0::BIGINT AS n, NULL::DOUBLE AS total FROM customer GROUP BY 1")
def group_count_non_numeric(spark, sf):
    return group_rows(read_table(spark, sf, "customer"), "c_mktsegment", [("n", "c_name", "count"), ("total", "c_name", "sum")])


@_query("SELECT CAST(ts AS DATE) AS day, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def group_date(spark, sf):
    df = read_table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return _rounded(group_rows(df, "day", [("n", "value", "count"), ("mean", "value", "mean")]), "mean", digits=6)


@_query("SELECT count(c_acctbal) AS n, round(sum(c_acctbal), 2) AS total FROM customer HAVING count(*) > 0")
def group_empty_by(spark, sf):
    return _rounded(group_rows(read_table(spark, sf, "customer"), [], [("n", "c_acctbal", "count"), ("total", "c_acctbal", "sum")]), "total", digits=2)


@_query("SELECT count(c_acctbal) AS n FROM customer WHERE c_acctbal > 1e12 HAVING count(*) > 0")
def group_empty_input(spark, sf):
    return group_rows(filter_rows(read_table(spark, sf, "customer"), "c_acctbal > 1000000000000"), [], [("n", "c_acctbal", "count")])


@_query("SELECT * FROM (SELECT o_custkey, count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) WHERE n >= 15")
def group_then_filter(spark, sf):
    df = group_rows(read_table(spark, sf, "orders"), "o_custkey", [("n", "o_totalprice", "count"), ("total", "o_totalprice", "sum")])
    return _rounded(filter_rows(df, "n >= 15"), "total", digits=2)


# -- sorts and slices: the rank is a column, as results are compared without order

_SORTS = {
    "sort_asc": (lambda: sort_keys(["c_acctbal", "c_custkey"]), "c_acctbal, c_custkey"),
    "sort_desc": (lambda: sort_keys(["c_acctbal", "c_custkey"], True), "c_acctbal DESC, c_custkey DESC"),
    "sort_multi": (lambda: sort_keys(["c_mktsegment", "c_acctbal", "c_custkey"], [False, True, False]), "c_mktsegment, c_acctbal DESC, c_custkey"),
    "sort_nulls_first": (lambda: sort_keys(["b", "c_custkey"], [True, False]), "b DESC NULLS FIRST, c_custkey"),
    "sort_nulls_last": (lambda: [SortKey.descending("b"), SortKey.ascending("c_custkey")], "b DESC NULLS LAST, c_custkey"),
}
for _name, (_keys, _order) in _SORTS.items():
    _query(
        f"SELECT row_number() OVER (ORDER BY {_order}) - 1 AS place, c_custkey FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer)", _name
    )(lambda spark, sf, k=_keys: _ranked(spark, sf, k()))


def _ranked(spark, sf, keys):
    df = read_table(spark, sf, "customer").withColumn("b", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")))
    view = SortedView("s", Table.from_dataframe("customer", df.select("c_custkey", "c_mktsegment", "c_acctbal", "b")), keys)
    return view.ordered().select(F.col("__at").alias("place"), "c_custkey")


def _frame(spark, rows: list[dict], ddl: str) -> DataFrame:
    """Rows that a call has returned to the driver."""
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)


def _top_orders(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Table.from_dataframe("orders", orders).sort(["o_totalprice", "o_orderkey"], [True, False])


def _slice(spark, sf, key):
    return _frame(spark, _top_orders(spark, sf)[key], "o_orderkey long, o_totalprice double")


_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "topk_slice")(lambda spark, sf: _slice(spark, sf, slice(10)))
_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "slice_range")(lambda spark, sf: _slice(spark, sf, slice(5, 15)))
_query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders)
  WHERE i BETWEEN 8 AND 40 AND i % 4 = 0""", "slice_backwards_by_step")(lambda spark, sf: _slice(spark, sf, slice(40, 6, -4)))


@_query("SELECT o_orderpriority, count(o_totalprice) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000 GROUP BY 1")
def filter_sort_group_chain(spark, sf):
    table = Table.from_dataframe("orders", read_table(spark, sf, "orders"))
    view = table.filter("o_orderstatus = 'O' AND o_totalprice > 50000").sort("o_totalprice", True).group_by("o_orderpriority", [("n", "o_totalprice", "count"), ("top", "o_totalprice", "max")])
    return view.to_df()


# -- ticks: a root over all customers, edits by place, views brought up to date

_EDITED = """WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)"""


def _nation(spark, sf):
    return Table.from_dataframe("nation", read_table(spark, sf, "nation").orderBy("n_nationkey"))


def _customers(spark, sf):
    return Table.from_dataframe("customer", read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").orderBy("c_custkey"))


def _new(key: int, nation: int, balance: float | None = 10.5) -> dict:
    return {"c_custkey": key, "c_name": f"new {key}", "c_nationkey": nation, "c_acctbal": balance}


@_query(f"{_EDITED}, e AS (SELECT c_nationkey FROM c UNION ALL SELECT 1) SELECT c_nationkey, count(*) AS n FROM e GROUP BY 1")
def tick_insert(spark, sf):
    t = _customers(spark, sf)
    view = t.group_by("c_nationkey", [("n", "c_nationkey", "count")])
    t.append_row(_new(-1, 1))
    t.tick()
    return view.to_df()


@_query(f"{_EDITED} SELECT c_custkey, CASE WHEN i = 3 THEN 'renamed' ELSE c_name END AS c_name FROM c WHERE i = 3 OR c_name <> 'nothing'")
def tick_update(spark, sf):
    t = _customers(spark, sf)
    view = t.filter("c_name != 'nothing'").maintain()
    t.set_value(3, "c_name", "renamed")
    t.tick()
    return view.to_df().select("c_custkey", "c_name")


@_query(f"{_EDITED} SELECT c_custkey, c_nationkey FROM c WHERE i NOT IN (0, 5, 100) AND c_nationkey >= 10")
def tick_delete(spark, sf):
    t = _customers(spark, sf)
    kept = t.filter("c_nationkey >= 10").maintain()
    t.delete_row(0)
    t.delete_row(4)
    t.tick()
    t.delete_row(98)
    t.tick()
    return kept.to_df().select("c_custkey", "c_nationkey")


@_query(f"""{_EDITED}, e AS (SELECT c_custkey, CASE WHEN i = 7 THEN 4 ELSE c_nationkey END AS c_nationkey FROM c WHERE i <> 2 UNION ALL SELECT -50, 2 UNION ALL SELECT -51, 4)
  SELECT c_nationkey, count(*) AS n, sum(c_custkey)::DOUBLE AS total, round(avg(c_custkey), 6) AS mean FROM e GROUP BY 1""")
def tick_batch(spark, sf):
    t = _customers(spark, sf)
    groups = t.group_by("c_nationkey", [("n", "c_custkey", "count"), ("total", "c_custkey", "sum"), ("mean", "c_custkey", "avg")]).maintain()
    t.set_value(7, "c_nationkey", 4)
    t.delete_row(2)
    t.append_rows([_new(-50, 2), _new(-51, 4)])
    t.tick()
    return _rounded(groups.to_df(), "mean", digits=6)


@_query(f"""{_EDITED} SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high, median(c_acctbal) AS mid, round(sum(c_acctbal), 2) AS total
  FROM c WHERE i NOT IN (0, 1, 2) GROUP BY 1""")
def tick_group_min_retract(spark, sf):
    t = _customers(spark, sf)
    groups = t.group_by("c_nationkey", [("low", "c_acctbal", "min"), ("high", "c_acctbal", "max"), ("mid", "c_acctbal", "median"), ("total", "c_acctbal", "sum")]).maintain()
    t.delete_rows([0, 1, 2])
    t.tick()
    return _rounded(groups.to_df(), "total", digits=2)


@_query(f"""{_EDITED}, a AS (SELECT c_custkey, CASE WHEN i = 1 THEN 4 ELSE c_nationkey END AS c_nationkey FROM c),
  b AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT 99, 'far')
  SELECT c_custkey, c_nationkey, n_nationkey AS right_n_nationkey, n_name AS right_n_name FROM a FULL JOIN b ON c_nationkey = n_nationkey""")
def tick_join_both_sides(spark, sf):
    left, right = _customers(spark, sf), _nation(spark, sf)
    joined = left.join(right, how="full", left_on="c_nationkey", right_on="n_nationkey").maintain()
    left.set_value(1, "c_nationkey", 4)
    right.delete_row(2)
    right.append_row({"n_nationkey": 99, "n_name": "far", "n_regionkey": 0})
    left.tick()
    return joined.to_df().select("c_custkey", "c_nationkey", "right_n_nationkey", "right_n_name")


@_query("""WITH l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
  e AS (SELECT l_returnflag, l_linenumber, CASE WHEN i % 100 = 0 THEN -1.0 ELSE l_quantity END AS l_quantity FROM l)
  SELECT l_returnflag, count(l_linenumber) AS n, sum(l_linenumber)::DOUBLE AS lines, max(l_quantity) AS high, min(l_quantity) AS low FROM e GROUP BY 1""")
def tick_percent_of_lineitem(spark, sf):
    """Every hundredth row of lineitem edited in one batch, under a maintained group and a maintained filter."""
    rows = read_table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("l_returnflag", "l_linenumber", "l_quantity")
    t = Table.from_dataframe("lineitem", rows)
    groups = t.group_by("l_returnflag", [("n", "l_linenumber", "count"), ("lines", "l_linenumber", "sum"), ("high", "l_quantity", "max"), ("low", "l_quantity", "min")])
    views = [groups.maintain(), t.filter("l_quantity < 0").maintain()]
    t.set_values([(i, "l_quantity", -1.0) for i in range(0, len(t), 100)])
    t.tick()
    return views[0].to_df()


# -- rows and places of a root: every call's answer as rows


def _answers(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(name, None if value is None else str(value)) for name, value in rows], "asked string, answer string")


def _said(*pairs: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS asked, CAST(({sql}) AS VARCHAR) AS answer" for name, sql in pairs)


@_query(f"""{_EDITED}, e AS (SELECT c_custkey, i + CASE WHEN i >= 500 THEN 1 ELSE 0 END + CASE WHEN i >= 3 THEN 1 ELSE 0 END AS place FROM c
  UNION ALL SELECT -1, 3 UNION ALL SELECT -2, 501) SELECT c_custkey, place FROM e""")
def positional_insert(spark, sf):
    from .operators.table import POSITION

    t = _customers(spark, sf)
    t.insert_row(500, _new(-2, 1))
    t.insert_row(3, _new(-1, 1))
    return t.to_df(hidden=True).select("c_custkey", F.col(POSITION).alias("place"))


@_query(_EDITED + " " + _said(
    ("row 7", "SELECT c_name FROM c WHERE i = 7"), ("last", "SELECT c_name FROM c ORDER BY i DESC LIMIT 1"), ("value", "SELECT c_nationkey FROM c WHERE i = 42"),
    ("after an edit", "SELECT 'changed'"), ("beyond", "SELECT 'IndexError'"), ("unknown column", "SELECT 'KeyError'"), ("rows", "SELECT count(*) FROM c"),
    ("empty", "SELECT 'False'"), ("columns", "SELECT 'c_custkey,c_name,c_nationkey,c_acctbal'"), ("name", "SELECT 'customer'")))
def point_reads(spark, sf):
    t = _customers(spark, sf)
    out = [("row 7", t[7]["c_name"]), ("last", t[-1]["c_name"]), ("value", t.get_value(42, "c_nationkey")), ("rows", len(t)), ("empty", t.is_empty()), ("columns", ",".join(t.column_names())), ("name", t.name())]
    for name, call in (("beyond", lambda: t.get_row(len(t))), ("unknown column", lambda: t.get_value(0, "none"))):
        try:
            call()
        except (IndexError, KeyError) as e:
            out.append((name, type(e).__name__))
    t.set_value(42, "c_name", "changed")
    return _answers(spark, [*out, ("after an edit", t.get_row(42)["c_name"])])


@_query(f"{_EDITED} SELECT i, c_custkey FROM c WHERE i BETWEEN 10 AND 30 AND i % 5 = 0 UNION ALL SELECT i, c_custkey FROM c WHERE i >= (SELECT count(*) FROM c) - 3")
def root_slices(spark, sf):
    t = _customers(spark, sf)
    n = len(t)
    return spark.createDataFrame([(i, r["c_custkey"]) for i, r in [*zip(range(10, 31, 5), t[10:31:5]), *zip((n - 1, n - 2, n - 3), t[: -4 : -1])]], "i long, c_custkey long")


@_query(f"{_EDITED} SELECT i, c_custkey, c_nationkey FROM c")
def iterate_rows(spark, sf):
    """All rows by iteration, in order, and a column by its name."""
    t = _customers(spark, sf)
    return spark.createDataFrame([(i, r["c_custkey"], k) for i, (r, k) in enumerate(zip(t, t["c_nationkey"]))], "i long, c_custkey long, c_nationkey int")


@_query("SELECT unnest(['a_1', 'b', 'name']) AS referenced")
def predicate_columns(spark, sf):
    from .functions.predicate import columns, parse

    return spark.createDataFrame([(c,) for c in columns(parse("name = 'x' AND (b > 2 OR NOT a_1 IS NULL) OR b < 1"))], "referenced string")


@_query("SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS place, c_custkey FROM customer")
def sort_ties_keep_order(spark, sf):
    view = _customers(spark, sf).sort("c_nationkey")
    return view.ordered().select(F.col("__at").alias("place"), "c_custkey")


@_query(f"{_EDITED}, s AS (SELECT i, row_number() OVER (ORDER BY c_acctbal DESC, i) - 1 AS place FROM c) SELECT place, i AS parent FROM s WHERE place IN (0, 5, 100)")
def sort_parent_index(spark, sf):
    view = _customers(spark, sf).sort("c_acctbal", descending=True)
    return spark.createDataFrame([(p, view.get_parent_index(p)) for p in (0, 5, 100)], "place long, parent long")


@_query("""SELECT o_orderkey, c_custkey AS right_c_custkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 3) ON o_custkey = c_custkey""")
def join_view(spark, sf):
    from .operators.views import JoinView

    orders, some = Table.from_dataframe("orders", read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")), _customers(spark, sf).filter("c_nationkey = 3")
    return JoinView("j", orders, some, "o_custkey", "c_custkey").to_df().select("o_orderkey", "right_c_custkey")


@_query("SELECT c_nationkey, count(c_acctbal) AS n, max(c_acctbal) AS high FROM customer GROUP BY 1")
def aggregate_view(spark, sf):
    from .functions.aggregates import AggregateFunction
    from .operators.views import AggregateView

    return AggregateView("a", _customers(spark, sf), ["c_nationkey"], [("n", "c_acctbal", AggregateFunction.COUNT), ("high", "c_acctbal", AggregateFunction.MAX)]).to_df()


@_query("SELECT first_place, c_nationkey, n FROM (SELECT c_nationkey, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS first_place, count(*) AS n FROM customer GROUP BY 1)")
def groups_in_order_of_first_rows(spark, sf):
    view = _customers(spark, sf).group_by("c_nationkey", [("n", "c_custkey", "count")])
    return view.ordered().select(F.col("__at").alias("first_place"), "c_nationkey", "n")


# -- the change log, ticks and the registry


@_query(f"""{_EDITED} SELECT 0 AS seq, 'update' AS op, 4 AS index, 4 AS row_id, (SELECT c_name FROM c WHERE i = 4) AS old, 'x' AS new
  UNION ALL SELECT 1, 'delete', 2, 2, NULL, NULL UNION ALL SELECT 2, 'insert', (SELECT count(*) - 1 FROM c), (SELECT count(*) FROM c), NULL, NULL""")
def change_log(spark, sf):
    t = _customers(spark, sf)
    t.set_value(4, "c_name", "x")
    t.delete_row(2)
    t.append_row(_new(-1, 0))
    return spark.createDataFrame([(c.seq, c.op, c.index, c.row_id, c.old, c.new) for c in t.log.changes_from(0)], "seq int, op string, index long, row_id long, old string, new string")


@_query(_said(("from 2", "SELECT 3"), ("compacted", "SELECT 3"), ("too old", "SELECT NULL"), ("numbers go on", "SELECT 5"), ("generations", "SELECT 1"),
              ("truncated", "SELECT 4"), ("drained", "SELECT 2"), ("left", "SELECT 0"), ("cleared", "SELECT 0"), ("pending", "SELECT 'False'")))
def change_log_cursors(spark, sf):
    t = _nation(spark, sf)
    for i in range(5):
        t.set_value(i, "n_name", f"name {i}")
    out = [("from 2", len(t.log.changes_from(2)))]
    t.log.compact(2)
    out += [("compacted", len(t.log)), ("too old", t.log.changes_from(1)), ("numbers go on", t.log.total), ("generations", t.changeset_generation())]
    t.log.truncate(4)
    out += [("truncated", t.log.total), ("drained", len(t.log.drain())), ("left", len(t.log))]
    t.delete_row(0)
    t.clear_changeset()
    return _answers(spark, [*out, ("cleared", t.pending_changes_count()), ("pending", t.has_pending_changes())])


@_query(_said(("registered", "SELECT 2"), ("no changes", "SELECT 0"), ("before the tick", "SELECT count(*) FROM nation"), ("ticked", "SELECT 2"), ("after the tick", "SELECT count(*) + 1 FROM nation"),
              ("pending", "SELECT 0"), ("one less", "SELECT 1"), ("version", "SELECT 1"), ("refreshed", "SELECT count(*) + 2 FROM nation"), ("unchanged", "SELECT 'False'"), ("over a view", "SELECT 2"),
              ("display", "SELECT 'Table ''nation'' [' || (count(*) + 2) || ' rows x 3 columns]' FROM nation"), ("parents", "SELECT 'FilterView'")))
def registry_and_freshness(spark, sf):
    t = _nation(spark, sf)
    view, groups = t.filter("n_nationkey >= 0"), t.group_by("n_regionkey", [("n", "n_nationkey", "count")])
    out = [("registered", t.registered_view_count()), ("no changes", t.tick())]
    t.append_row({"n_nationkey": 100, "n_name": "late", "n_regionkey": 1})
    out += [("before the tick", len(view)), ("ticked", t.tick()), ("after the tick", len(view)), ("pending", t.pending_changes_count()), ("version", t.version())]
    del groups
    out.append(("one less", t.registered_view_count()))
    t.append_row({"n_nationkey": 101, "n_name": "later", "n_regionkey": 1})
    view.refresh()
    chained = view.filter("n_nationkey >= 100")
    return _answers(spark, [*out, ("refreshed", len(view)), ("unchanged", view.sync()), ("over a view", len(chained)), ("display", t.display()), ("parents", type(chained.parents[0]).__name__)])


@_query(f"""{_EDITED}, e AS (SELECT CASE WHEN i = 9 THEN 0 ELSE c_nationkey END AS c_nationkey, c_acctbal FROM c WHERE i <> 1)
  SELECT c_nationkey, count(c_acctbal) AS n FROM e WHERE c_acctbal > 0 GROUP BY 1 HAVING count(c_acctbal) > 2""")
def view_over_view_ticks(spark, sf):
    t = _customers(spark, sf)
    view = t.filter("c_acctbal > 0").group_by("c_nationkey", [("n", "c_acctbal", "count")]).filter("n > 2")
    t.set_value(9, "c_nationkey", 0)
    t.delete_row(1)
    t.tick()
    return view.to_df()


# -- the sync protocol: messages as a client sends them


def _session(spark, sf):
    from .streaming.protocol import Replica, Server

    server, said, copy = Server(), [], Replica()
    server.add(_nation(spark, sf))
    session = server.connect(lambda m: (said.append(m), copy.receive(m)))
    return (lambda **m: session.handle({"table_name": "nation", **m})), said, copy


_CLIENT = ({"type": "Subscribe"}, {"type": "Query"}, {"type": "InsertRow", "row": {"n_nationkey": 77, "n_name": "Atoll", "n_regionkey": 3}},
           {"type": "UpdateCell", "row_id": 2, "column": "n_name", "value": "Second"}, {"type": "DeleteRow", "row_id": 5})


@_query("""WITH c AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS row_id FROM nation)
  SELECT row_id, n_nationkey, CASE WHEN row_id = 2 THEN 'Second' ELSE n_name END AS n_name, n_regionkey FROM c WHERE row_id <> 5
  UNION ALL SELECT count(*) + 1, 77, 'Atoll', 3 FROM c""")
def protocol_replica(spark, sf):
    """What a client has after a snapshot and the deltas that follow it."""
    send, _, copy = _session(spark, sf)
    for message in _CLIENT:
        send(**message)
    return spark.createDataFrame([(i, r["n_nationkey"], r["n_name"], r["n_regionkey"]) for i, r in copy.rows.items()], "row_id long, n_nationkey long, n_name string, n_regionkey int")


@_query("SELECT unnest(range(6)) AS i, unnest(['Subscribed', 'TableData', 'RowInserted', 'CellUpdated', 'RowDeleted', 'Error']) AS type, unnest([NULL, 0, 1, 2, 3, NULL]) AS seq")
def protocol_messages(spark, sf):
    send, said, _ = _session(spark, sf)
    for message in (*_CLIENT, {"type": "changed"}):
        send(**message)
    return spark.createDataFrame([(i, m["type"], m.get("seq")) for i, m in enumerate(said)], "i long, type string, seq int")


@_query("SELECT n_regionkey, sum(n_nationkey)::DOUBLE AS total, count(*) AS n FROM nation WHERE n_nationkey >= 5 GROUP BY 1")
def protocol_pipeline(spark, sf):
    """A pipeline in the wire's own JSON, and the rows of the view data that come back."""
    import json

    send, said, _ = _session(spark, sf)
    send(**json.loads("""{"type": "SetPipeline", "nodes": [
      {"id": "kept", "source_id": "base", "kind": "filter", "predicate": "n_nationkey >= 5"},
      {"id": "ranked", "source_id": "kept", "kind": "sort", "keys": [{"column": "n_nationkey", "descending": true}]},
      {"id": "by", "source_id": "ranked", "kind": "group", "group_by": ["n_regionkey"],
       "aggs": [{"alias": "total", "op": "sum", "column": "n_nationkey"}, {"alias": "n", "op": "count", "column": null}]}]}"""))
    rows = [r["row"] for m in said if m["type"] == "ViewData" and m["node_id"] == "by" for r in m["rows"]]
    return _frame(spark, rows, "n_regionkey int, total double, n long")


@_query(_said(("date", "SELECT '2031-07-09'"), ("datetime", "SELECT '2031-07-09T08:05:00.250Z'"), ("number", "SELECT '2.5'"), ("no number", "SELECT NULL"), ("text", "SELECT 'x'"), ("flag", "SELECT 'True'"),
              ("date back", "SELECT '2031-07-09'"), ("datetime back", "SELECT '2031-07-09 08:05:00.250000'"), ("no date", "SELECT 'ValueError'")))
def wire_values(spark, sf):
    import datetime as dt

    from .streaming.protocol import from_wire, to_wire
    from .types import ColumnType as K

    day, at = dt.date(2031, 7, 9), dt.datetime(2031, 7, 9, 8, 5, 0, 250_000)
    out = [("date", to_wire(day)), ("datetime", to_wire(at)), ("number", to_wire(2.5)), ("no number", to_wire(float("nan"))), ("text", to_wire("x")), ("flag", to_wire(True))]
    out += [("date back", from_wire("2031-07-09", K.DATE)), ("datetime back", from_wire("2031-07-09T08:05:00.250Z", K.DATETIME))]
    try:
        from_wire("soon", K.DATE)
    except ValueError as e:
        out.append(("no date", type(e).__name__))
    return _answers(spark, out)


@_query("SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal NULLS LAST, c_custkey) - 1 AS place, c_custkey FROM customer")
def mini_sorting(spark, sf):
    from .plans.pipeline import mini_sort
    from .sources.storage import numbered

    rows = read_table(spark, sf, "customer").orderBy(*mini_sort("c_mktsegment desc, c_acctbal, c_custkey"))
    return numbered(rows, "place")[0].select("place", "c_custkey")


@_query("SELECT event_type, count(value) AS n, max(value) AS high FROM events GROUP BY 1")
def stream_groups(spark, sf):
    """Running groups over the events table as a stream, as they stand at its end."""
    import uuid

    from .sources.storage import shared_path
    from .streaming.changes import streamed_groups

    name = f"groups_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(read_table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    groups = streamed_groups(stream, ["event_type"], [("n", "value", "count"), ("high", "value", "max")])
    writer = groups.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_path(spark, "groups-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@_query("SELECT e.event_id AS id, e.event_type AS kind, e.value + 1 AS value FROM events e WHERE event_id % 3 <> 0")
def stream_changes(spark, sf):
    """All events as inserts, updates of each and deletes of every third, from files in any order, into a durable table."""
    from pyspark.sql import types as T

    from .sources.storage import shared_path
    from .streaming.changes import StreamedTable

    folder, events = shared_path(spark, "log"), read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    change = lambda df, op, step: df.select((F.col("id") * 10 + step).alias("seq"), F.lit(op).alias("op"), F.col("id").alias("row_id"), "id", "kind", "value")
    table = StreamedTable(spark, folder, T.StructType(events.schema.fields), shared_path(spark, "state"))
    for df in (change(events.withColumn("value", F.col("value") + 1), "update", 2), change(events.where("id % 3 = 0"), "delete", 3), change(events, "insert", 1)):
        df.write.mode("append").parquet(folder)
        table.run()
    return StreamedTable(spark, folder, table.row, table.checkpoint).table()


# -- text round trips


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf):
    return Table.from_csv("n", _nation(spark, sf).to_csv(), spark).to_df()


@_query("SELECT r_name, r_regionkey FROM region")
def json_roundtrip(spark, sf):
    return Table.from_json("r", Table.from_dataframe("region", read_table(spark, sf, "region")).to_json(), spark).to_df()


@_query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def pandas_roundtrip(spark, sf):
    return Table.from_pandas("s", Table.from_dataframe("supplier", read_table(spark, sf, "supplier")).to_pandas(), spark).to_df()


@_query("SELECT count(DISTINCT n_name) AS unique_strings, count(n_name) AS total_references FROM nation")
def interner_stats(spark, sf):
    t = Table.from_dataframe("nation", read_table(spark, sf, "nation"), use_string_interning=True)
    s = t.interner_stats()
    return spark.createDataFrame([(s["unique_strings"], s["total_references"])], "unique_strings long, total_references long")


# -- pipelines from specs


@_query("SELECT o_orderstatus, count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.9), 4) AS high FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def pipeline_spec(spark, sf):
    nodes = [
        {"id": "big", "source_id": "base", "kind": "filter", "predicate": "o_totalprice > 150000"},
        {"id": "ranked", "source_id": "big", "kind": "sort", "keys": [{"column": "o_totalprice", "descending": True}]},
        {"id": "by", "source_id": "ranked", "kind": "group", "group_by": ["o_orderstatus"], "aggs": [
            {"alias": "n", "op": "count", "column": "o_totalprice"}, {"alias": "high", "op": "p90", "column": "o_totalprice"}]},
    ]
    return _rounded(build_pipeline(Table.from_dataframe("orders", read_table(spark, sf, "orders")), nodes)["by"].to_df(), "high")


@_query("""SELECT coalesce(o_orderpriority, '-') AS o_orderpriority, round(sum(o_totalprice), 2) AS a, count(*) AS n FROM orders
  WHERE (o_orderstatus = 'O' OR o_totalprice > 300000) AND lower(o_orderpriority) LIKE '%urgent%' GROUP BY 1""")
def mini_language(spark, sf):
    df = read_table(spark, sf, "orders")
    kept = df.where(mini_filter("o_orderstatus = O or o_totalprice > 300000 and o_orderpriority contains urgent", df.schema))
    return _rounded(mini_group(kept, "o_orderpriority | a=sum(o_totalprice), n=count()"), "a", digits=2)


@_query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 20")
def stream_filter(spark, sf):
    """Every row of the events table through a stream and into a stored table."""
    from .streaming.changes import streamed_filter
    from .sources.storage import shared_path

    path = shared_path(spark, "stream")
    schema = read_table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    kept = streamed_filter(stream, "event_type = 'click' AND value > 20").select("event_id", "user_id", "value")
    kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(path)
