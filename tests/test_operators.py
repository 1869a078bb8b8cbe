import pytest
from pyspark.sql import functions as F

from rivulet.functions.aggregates import AggregateFunction
from rivulet.operators.relational import add_column, filter_rows, group_rows, join_rows, select_columns, sort_keys
from rivulet.operators.table import Table
from rivulet.types import ColumnType as K
from rivulet.types import Schema

NAN = float("nan")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_join_modes_and_orphans(spark):
    """Rivers and gauges by basin: two gauges on one basin, a basin without any, gauges on no known river, keys in other columns."""
    rivers = spark.createDataFrame([("Elbe", 7), ("Oder", 3), ("Ems", 3), ("Main", 12)], "river string, basin int")
    gauges = spark.createDataFrame([(7, "up", 1.5), (7, "down", 2.25), (20, "lost", None), (3, "mid", 0.5), (None, "dry", 0.0)], "zone int, spot string, level double")
    got = {h: rows(join_rows(rivers, gauges, left_on="basin", right_on="zone", how=h).select("river", "right_spot")) for h in ("inner", "left", "right", "full", "outer", "FULL_OUTER")}
    met, alone, lost = [("Elbe", "down"), ("Elbe", "up"), ("Ems", "mid"), ("Oder", "mid")], [("Main", None)], [(None, "dry"), (None, "lost")]
    assert got == {"inner": met, **{h: sorted(x, key=repr) for h, x in (("left", met + alone), ("right", met + lost), *((f, met + alone + lost) for f in ("full", "outer", "FULL_OUTER")))}}
    assert join_rows(rivers, gauges, left_on="basin", right_on="zone").columns == ["river", "basin", "right_zone", "right_spot", "right_level"]


def test_null_and_nan_keys_never_match(spark):
    x = spark.createDataFrame([(1.0, 1), (NAN, 2), (None, 3)], "k double, v int")
    assert [join_rows(x, x, on="k", how=h).count() for h in ("inner", "left", "right", "full")] == [1, 3, 3, 5]


def test_join_errors(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,)], "k long")
    for kwargs in ({"on": "k"}, {"left_on": "k", "right_on": []}, {"on": "z"}, {"on": "k", "left_on": "k"}, {}):
        with pytest.raises(ValueError):
            join_rows(a, b, **kwargs)
    assert join_rows(a, b, on="k", strict_types=False, how="inner").count() == 1
    with pytest.raises(ValueError):
        join_rows(a.withColumn("right_k", F.lit(1)), a, on="k")


def test_groups(spark):
    df = spark.createDataFrame([("N", 10.0), ("N", NAN), ("N", 20.0), (None, 5.0), ("S", None)], "r string, v double")
    got = rows(group_rows(df, "r", [("s", "v", "sum"), ("n", "v", "count"), ("m", "v", "med"), ("p", "v", "p25"), ("c", "r", "count")]))
    assert got == [("N", 30.0, 2, 15.0, 12.5, 0), ("S", None, 0, None, None, 0), (None, 5.0, 1, 5.0, 5.0, 0)]
    zero = spark.createDataFrame([(0.0, 1), (-0.0, 2), (NAN, 3), (NAN, 4)], "k double, v int")
    assert group_rows(zero, "k", [("n", "v", "count")]).count() == 2
    assert group_rows(df.limit(0), [], [("n", "v", "count")]).count() == 0
    for bad in ([("x", "v", "stddev")], [], [("x", "nope", "sum")]):
        with pytest.raises(ValueError):
            group_rows(df, "r", bad)
    with pytest.raises(ValueError):
        AggregateFunction.PERCENTILE(1.5)


def test_projection_and_computed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert select_columns(df, ["s", "i", "s"]).columns == ["s", "i"]
    with pytest.raises(ValueError):
        select_columns(df, ["nope"])
    assert rows(add_column(df, "t", lambda r: r["i"] * 2)) == [(1, "a", 2), (2, "b", 4)]
    assert rows(add_column(df, "i", F.col("i") + 1)) == [(2, "a"), (3, "b")]
    assert filter_rows(df, lambda r: r["s"] == "b").count() == 1


def test_callables_get_the_columns_they_name(spark):
    from rivulet.operators.relational import _named

    names, limit = ["i", "s", "t"], 3
    assert _named(lambda r: r["i"] > limit and r["t"] == "x", names) == ["i", "t"]
    assert _named(lambda r: r["i"] > max(r.values()), names) == names and _named(lambda r: [r][0]["i"], names) == names
    assert _named(lambda r: 1, names) == ["i"] and _named(str, names) == names
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for fn in (lambda r: r["s"] is None, lambda r: r.get("s") is None, lambda r: dict(r)["s"] is None):
        assert rows(filter_rows(df, fn)) == [(2, None)]
    plan = filter_rows(df, lambda r: r["i"] > 1)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_sort_defaults_and_ties(spark):
    t = Table("t", Schema([("n", K.STRING, False), ("v", K.FLOAT64, True)]), spark=spark)
    t.append_rows([{"n": "a", "v": 2.0}, {"n": "b", "v": None}, {"n": "c", "v": 1.0}, {"n": "d", "v": 2.0}])
    assert [r["n"] for r in t.sort("v")] == ["b", "c", "a", "d"]
    assert [r["n"] for r in t.sort("v", descending=True)] == ["b", "a", "d", "c"]
    assert t.sort("v").get_parent_index(1) == 2
    with pytest.raises(ValueError):
        sort_keys(["a", "b"], [True])


def test_keys_of_many_rows_on_both_sides(spark):
    """Blocks of rows: every mode gives what the plain join gives, with keys of more rows than a block, without partner, null, NaN and both zeros."""
    key = "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN double('NaN') WHEN id % 5 = 2 THEN {z}D WHEN id % 5 = 3 THEN {other}D ELSE 1.5D END AS k"
    a = spark.range(0, 6_000, 1, 3).selectExpr(key.format(z="0.0", other="7.0"), "id", "id AS __pos")
    b = spark.range(0, 1_500, 1, 2).selectExpr(key.format(z="-0.0", other="8.0"), "array(id) AS ids", "id AS __pos")
    count = [F.count("*"), *[F.sum(F.coalesce(c, F.lit(-1))) for c in ("id", F.col("right_ids")[0])], F.sum(F.xxhash64("id", F.col("right_ids")[0], F.nanvl("k", F.lit(9.0)), F.nanvl("right_k", F.lit(9.0)), "__lpos", "__rpos") % 1_000_003)]
    for how in ("inner", "left", "right", "full"):
        plain, many = (join_rows(a, b, on="k", how=how, many=m) for m in (False, True))
        assert plain.columns == many.columns and plain.dtypes == many.dtypes
        assert plain.agg(*count).first() == many.agg(*count).first()
        assert many.count() == 2 * 1_200 * 300 + (how in ("left", "full")) * 3_600 + (how in ("right", "full")) * 900


def test_a_full_join_holds_no_key_in_memory(spark):
    """All pairs of a key used to be held at once; a frame that gives other rows each time is read once."""
    a, b = spark.range(10).selectExpr("id % 2 AS k", "id"), spark.range(10).selectExpr("id % 3 AS k", "id")
    for many in (False, True):
        assert "FullOuter" not in join_rows(a, b, on="k", how="full", many=many)._jdf.queryExecution().executedPlan().toString()
    odd = spark.range(200).select(F.rand().alias("k"))
    twice = join_rows(odd, odd, on="k", how="full")
    assert twice.where("k IS NULL OR right_k IS NULL").count() in (0, 400) and twice.select("k").dropna().count() == 200


def test_pairs_of_few_keys_are_made_by_all_tasks(spark):
    """All pairs of the 24 nations used to be made by the one task that read the customers."""
    import __spark_entry__ as entry

    for name in ("join_nan_keys", "join_null_keys", "join_inner", "join_left", "join_right", "join_full"):
        assert "REPARTITION_BY_NUM" in entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
