import itertools

import pytest
from pyspark.sql import types as T

from rivulet.functions.predicate import PredicateError, columns, compile_predicate, evaluate, parse

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("i", T.IntegerType()), ("d", T.DoubleType()), ("s", T.StringType()), ("b", T.BooleanType()), ("day", T.DateType()))])
ROWS = [(i, d, s, b, None) for i, d, s, b in itertools.product((None, 1, 5), (None, 2.5, float("nan")), (None, "x"), (None, True, False))]
LEAVES = ["i > 1", "i != 1", "d >= 2.5", "d < 3", "d != 2.5", "s = 'x'", "s = 5", "b = true", "b > false", "nope = 1", "nope IS NULL", "i IS NOT NULL", "i = null", "day = '2024-01-01'", "i <= 4.5"]


def test_compiled_equals_two_valued_evaluation(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    shapes = ["{a}", "NOT {a}", "{a} AND NOT {b}", "NOT ({a} OR {b})", "{a} OR {b} AND NOT ({b} AND {a})"]
    named = {}
    for k, (a, b) in enumerate(zip(LEAVES, LEAVES[3:] + LEAVES[:3])):
        for j, shape in enumerate(shapes):
            named[f"c{k}_{j}"] = shape.format(a=a, b=b)
    got = df.select(*[compile_predicate(parse(e), SCHEMA).alias(n) for n, e in named.items()]).collect()
    for row, result in zip(ROWS, got):
        values = dict(zip(SCHEMA.names, row))
        for n, e in named.items():
            assert bool(result[n]) == evaluate(parse(e), values), (e, values)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as int) i").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(compile_predicate("NOT i > 3", df.schema))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(LessThanOrEqual(i,3),IsNull(i))]" in plan


@pytest.mark.parametrize("text", ["", "a >", "a = 1 b", "(a = 1", "a ~ 1", "a = 9223372036854775808", "AND a = 1", "a IS 5"])
def test_malformed(text):
    with pytest.raises(PredicateError):
        parse(text)


def test_columns_and_escapes():
    assert columns(parse("b = 1 AND (a > 2 OR NOT b IS NULL)")) == ["a", "b"]
    assert parse(r"s = 'it\'s'").value == "it's"
    assert evaluate(parse("A = 1 or b = 2 AND c = 3"), {"A": 1}) is True
