import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from rivulet.operators.delta import IncrementalFilter, IncrementalGroup, IncrementalJoin
from rivulet.operators.relational import filter_rows, group_rows, join_rows
from rivulet.operators.table import Table
from rivulet.types import ColumnType as K
from rivulet.types import Schema

BERTHS = Schema([("ship", K.STRING, False), ("draught", K.FLOAT64, True), ("crew", K.INT32, True)])
FLEET = [("Marlin", 4.25, 11), ("Otter", None, 3), ("Petrel", 7.5, None), ("Quail", 2.0, 5), ("Raven", 7.5, 40), ("Skua", 3.0, 9)]


def harbour(spark):
    t = Table("harbour", BERTHS, spark=spark)
    t.append_rows([dict(zip(("ship", "draught", "crew"), r)) for r in FLEET])
    return t


def ships(t):
    return "".join(r["ship"][0] for r in t)


def test_crud_and_positions(spark):
    t = harbour(spark)
    t.insert_row(2, {"ship": "Nautilus", "draught": 9.0, "crew": None})
    t.delete_row(4)
    t.delete_row(0)
    t.set_value(3, "crew", 41)
    t.insert_row(len(t), {"ship": "Zebra", "draught": None, "crew": 0})
    assert ships(t) == "ONPRSZ" and t.get_value(3, "crew") == 41
    assert t[-2]["ship"] == "Skua" and [r["ship"][0] for r in t[::-2]] == ["Z", "R", "N"] and t["draught"][1] == 9.0
    assert t.version() == len(FLEET) + 5 == t.pending_changes_count()
    assert [t.index_of(i) for i in t.row_ids()] == list(range(6)) and t.index_of(0) is None
    for bad, kind in ((lambda: t.get_row(6), IndexError), (lambda: t.get_value(6, "crew"), KeyError), (lambda: t.delete_row(-1), IndexError), (lambda: t["mast"], KeyError)):
        with pytest.raises(kind):
            bad()


def test_strict_and_atomic(spark):
    t, good = harbour(spark), {"ship": "Wren", "draught": 1.5, "crew": 2}
    for change in ({"ship": None}, {"crew": "2"}, {"mast": 1}, {"crew": 1 << 31}, {"crew": True}, {"draught": "deep"}):
        with pytest.raises((ValueError, TypeError)):
            t.append_rows([good, good | change])
    with pytest.raises(ValueError):
        t.append_row({"ship": "Wren"})
    with pytest.raises((ValueError, TypeError)):
        t.set_values([(0, "crew", 1), (1, "crew", "many")])
    assert ships(t) == "MOPQRS" and t.version() == len(FLEET) and t.append_rows([]) == 0 and t[0]["crew"] == 11
    with pytest.raises(ValueError):
        Table("x", BERTHS, storage="odd", spark=spark)


def test_iteration_sees_mutation(spark):
    t = harbour(spark)
    with pytest.raises(RuntimeError):
        for _ in t:
            t.delete_row(0)


def test_column_aggregates(spark):
    none = Table("none", BERTHS, spark=spark)
    assert (none.sum("crew"), none.avg("crew"), none.max("draught"), none.count_non_null("ship")) == (0.0, None, None, 0)
    t = harbour(spark)
    assert (t.sum("crew"), t.avg("crew"), t.min("crew"), t.max("crew"), t.count_non_null("crew")) == (68.0, 13.6, 3.0, 40.0, 5)
    assert (t.sum("draught"), t.count_non_null("draught"), t.sum("ship"), t.avg("ship"), t.count_non_null("ship")) == (24.25, 5, 0.0, None, 6)
    t.append_row({"ship": "Tern", "draught": float("nan"), "crew": None})
    assert t.min("draught") == 2.0 and t.max("draught") == 7.5 and t.sum("draught") != t.sum("draught")


def test_tick_freshness_and_registry(spark):
    t = harbour(spark)
    assert t.tick() == 0
    deep, crews = t.filter("draught >= 4"), t.group_by("draught", [("hands", "crew", "sum")])
    t.append_rows([{"ship": "Umber", "draught": 4.25, "crew": 30}, {"ship": "Vole", "draught": 0.5, "crew": 1}])
    assert ships(deep) == "MPR" and crews[0]["hands"] == 11.0 and t.has_pending_changes()
    assert t.tick() == 2 and ships(deep) == "MPRU" and crews[0]["hands"] == 41.0 and len(crews) == 6
    assert t.tick() == 0 and not t.has_pending_changes() and t.registered_view_count() == 2
    del deep
    assert t.registered_view_count() == 1
    chained = t.filter("crew > 4").sort("crew", True)
    t.delete_row(4)
    assert ships(chained) == "RUMSQ"
    t.tick()
    assert ships(chained) == "UMSQ" and ships(t.select(["ship"])) == ships(t)


def test_edits_in_batches_on_a_stored_base(spark):
    t = Table.from_dataframe("d", spark.range(500).selectExpr("cast(id as int) k", "id * 2.0D v").orderBy("k"))
    expect = [[i, i * 2.0] for i in range(500)]
    for _ in range(2):
        assert t.set_values([(i, "v", -1.0) for i in range(0, len(t), 7)]) == len(range(0, len(t), 7))
        expect = [[k, -1.0 if i % 7 == 0 else v] for i, (k, v) in enumerate(expect)]
        gone = set(range(3, len(t), 11))
        assert t.delete_rows(gone) == len(gone)
        expect = [r for i, r in enumerate(expect) if i not in gone]
        t.flush()
        assert [[r["k"], r["v"]] for r in t] == expect
        assert [t.index_of(t.row_ids()[i]) for i in (0, 50, len(t) - 1)] == [0, 50, len(t) - 1]
    with pytest.raises(IndexError):
        t.delete_rows([0, len(t)])
    assert len(t) == len(expect)


def test_maintained_views_read_in_order(spark):
    """Kept rows are read in the table's order though places have shifted, and a float's retraction leaves what a new build gives."""
    t = harbour(spark)
    deep, by = t.filter("draught >= 3").maintain(), t.group_by("draught", [("low", "crew", "min"), ("n", "ship", "count")]).maintain()
    hands = t.group_by("draught", [("hands", "crew", "sum"), ("mean", "crew", "avg")]).maintain()
    t.insert_row(1, {"ship": "Zebra", "draught": 3.0, "crew": 100})
    t.delete_row(0)
    t.set_value(1, "draught", 8.0)
    assert t.tick() == 3 and ships(deep) == "ZOPRS" and len(deep) == 5 and deep[1]["ship"] == "Otter"
    assert [r["draught"] for r in by] == [3.0, 8.0, 7.5, 2.0] and by[0]["low"] == 9.0 and by.get_row(2)["low"] == 40.0
    assert sorted((r["draught"], r["hands"], r["mean"]) for r in hands) == [(2.0, 5.0, 5.0), (3.0, 109.0, 54.5), (7.5, 40.0, 40.0), (8.0, 3.0, 3.0)]
    sums = Table("sums", BERTHS, spark=spark)
    sums.append_rows([{"ship": s, "draught": d, "crew": None} for s, d in (("a", 1e17), ("a", 1.0))])
    total = sums.group_by("ship", [("total", "draught", "sum")]).maintain()
    sums.delete_row(0)
    sums.tick()
    assert total[0]["total"] == 1.0
    with pytest.raises(TypeError):
        deep.sort("ship").maintain()


def test_many_ticks_put_the_layers_together(spark, monkeypatch):
    from rivulet.operators import delta

    monkeypatch.setattr(delta, "SYNCS", 3)
    t = harbour(spark)
    views = [t.filter("crew > 2").maintain(), t.group_by("draught", [("n", "crew", "count")]).maintain(), t.group_by("draught", [("top", "crew", "max")]).maintain(), t.join(t, on="draught", how="full").maintain()]
    for i in range(7):
        t.set_value(i % len(t), "crew", 50 + i)
        if i == 4:
            t.delete_row(0)
        t.tick()
    for view in views:
        fresh = view.build()
        assert same(view.to_df(), fresh.select(*view.column_names()))


def test_a_large_batch_of_edits_neither_rewrites_the_table_nor_reads_single_rows(spark, monkeypatch):
    """Every further batch beyond the limit used to write the whole table, and each edit after that to read its row by a job of its own."""
    from rivulet.operators import table

    monkeypatch.setattr(table, "FLUSH_ROWS", 20)
    t = Table.from_dataframe("d", spark.range(0, 2000, 1, 3).selectExpr("cast(id as int) k", "nullif(id, -1) * 2.0D v", "cast(id as string) s").orderBy("k"))
    expect = [[i, i * 2.0, str(i)] for i in range(2000)]
    flushes, at = [], t._at
    t._unedited = t._unedited[0], lambda place, stop=None: flushes.append(place) or at(place) if stop is None else at(place, stop)
    t._at = t._unedited[1]
    monkeypatch.setattr(t, "flush", lambda: flushes.append("flush"))
    old = t.to_df()
    for i in range(0, 2000, 40):
        expect[i][1] = -1.0
    assert t.set_values([(i, "v", -1.0) for i in range(0, 2000, 40)]) == 50
    edits = [(i, c, x) for i in range(40, 1200, 40) for c, x in (("v", None if i % 80 else 7.5), ("s", f"new {i}"))]
    for i, c, x in edits:
        expect[i]["kvs".index(c)] = x
    assert t.set_values(edits) == len(edits) and not flushes
    assert [list(r.values()) for r in t] == expect and [c.old for c in t.log.changes_from(50)][:2] == [-1.0, "40"]
    assert t[40] == {"k": 40, "v": None if 40 % 80 else 7.5, "s": "new 40"} and t[1960]["v"] == -1.0 and t[41]["s"] == "41"
    assert old.where("v < 0").isEmpty()
    monkeypatch.undo()
    t.delete_row(40)
    t.set_value(40, "s", "after")
    expect[41][2] = "after"
    t.flush()
    assert [list(r.values()) for r in t] == expect[:40] + expect[41:]


def test_maintained_extremes_are_moved_not_built_anew(spark, monkeypatch):
    """Least and greatest values follow their number of occurrences; a group is read again only when an extreme has left altogether."""
    from rivulet.operators import delta

    def never(*_):
        raise AssertionError("built anew")

    t = harbour(spark)
    t.append_rows([{"ship": s, "draught": d, "crew": c} for s, d, c in (("Tern", 7.5, 40), ("Umber", float("nan"), 2), ("Vole", None, 50), ("Wren", 7.5, 1))])
    agg = [("lo", "crew", "min"), ("hi", "crew", "max"), ("total", "crew", "sum")]
    views = [t.group_by("draught", agg).maintain(), t.group_by([], agg[:2]).maintain()]
    files = [v._kept.layers.base.inputFiles() for v in views]
    assert all(files) and all("/kept-" in f for fs in files for f in fs)
    steps = (
        lambda: (t.set_value(4, "crew", 7), t.set_value(0, "crew", 1), t.set_value(2, "draught", float("nan"))),
        lambda: (t.delete_row(8), t.append_row({"ship": "Yawl", "draught": 7.5, "crew": -3}), t.set_value(1, "crew", None)),
    )
    for i, step in enumerate(steps):
        with monkeypatch.context() as m:
            m.setattr(delta, "group_rows", never)
            step()
            t.tick()
        for v in views:
            assert same(v.to_df(), v.build().select(*v.column_names())), i


def test_flush_and_base_edits(spark):
    t = Table.from_dataframe("d", spark.range(60).selectExpr("cast(id as int) k", "nullif(id, -1) * 2.0D v"))
    expect = [[i, i * 2.0] for i in range(60)]
    rng = random.Random(3)
    for step in range(40):
        kind, at = rng.randrange(3), rng.randrange(len(expect))
        if kind == 0:
            t.delete_row(at)
            del expect[at]
        elif kind == 1:
            t.insert_row(at, {"k": 1000 + step, "v": None})
            expect.insert(at, [1000 + step, None])
        else:
            t.set_value(at, "v", float(step))
            expect[at][1] = float(step)
        if step == 20:
            t.flush()
    assert [[r["k"], r["v"]] for r in t] == expect
    assert t.filter_expr("k >= 1000") == [i for i, (k, _) in enumerate(expect) if k >= 1000]


def same(a, b):
    show = lambda df: sorted(repr([None if x is None else round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    return show(a) == show(b.select(*a.columns))


def test_incremental_equals_rebuild(spark):
    """Random edits in batches; after each, every kept view equals one built from scratch."""
    rng = random.Random(7)
    schema = Schema([("k", K.INT32, True), ("v", K.FLOAT64, True)])
    row = lambda: {"k": rng.choice([None, 0, 1, 2, 3]), "v": rng.choice([None, float("inf"), float("nan"), *map(float, range(300, 700, 50))])}
    a, b = Table("a", schema, spark=spark), Table("b", schema, spark=spark)
    for t in (a, b):
        t.append_rows([row() for _ in range(8)])
    agg = [("s", "v", "sum"), ("n", "v", "count"), ("m", "v", "avg")]
    kept, sums, ranks = IncrementalFilter(a, "v >= 500"), IncrementalGroup(a, "k", agg), IncrementalGroup(a, ["k"], [("lo", "v", "min"), ("md", "v", "median")])
    joins = {h: IncrementalJoin(a, b, on="k", how=h) for h in ("left", "full")}
    for _ in range(4):
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice((a, b))
            kind = rng.randrange(4)
            if kind == 0 or len(t) < 3:
                t.append_row(row())
            elif kind == 1:
                t.delete_row(rng.randrange(len(t)))
            else:
                t.set_value(rng.randrange(len(t)), "kv"[kind - 2], row()["kv"[kind - 2]])
        for view in (kept, sums, ranks, *joins.values()):
            view.sync()
        assert same(kept.to_df(), filter_rows(a.to_df(), "v >= 500"))
        assert same(sums.to_df(), group_rows(a.to_df(), "k", agg))
        assert same(ranks.to_df(), group_rows(a.to_df(), "k", [("lo", "v", "min"), ("md", "v", "median")]))
        for h, j in joins.items():
            assert same(j.to_df(), join_rows(a.to_df(), b.to_df(), on="k", how=h)), h


def test_text_round_trips(spark):
    text = 'i,f,b,s,d,t\n1,2.5,true,"a,""b""",2024-01-31,2024-01-31T10:00:00.250\n,,,,,\n3000000000,1,FALSE,x\n'
    t = Table.from_csv("c", text, spark=spark)
    assert [k for _, k, _ in t.schema] == [K.INT64, K.FLOAT64, K.BOOL, K.STRING, K.DATE, K.DATETIME]
    assert t[0] == {"i": 1, "f": 2.5, "b": True, "s": 'a,"b"', "d": dt.date(2024, 1, 31), "t": dt.datetime(2024, 1, 31, 10, 0, 0, 250000)}
    assert t[1]["d"] is None and len(t) == 2
    again = Table.from_csv("c", t.to_csv(), spark=spark)
    assert list(again) == list(t)
    j = Table.from_json("j", '[{"b": 1, "a": null}, {"a": 2.5, "b": 5000000000, "z": 1}]', spark=spark)
    assert j.column_names() == ["a", "b"] and [k for _, k, _ in j.schema] == [K.FLOAT64, K.INT64]
    for bad in ("[]", "{}", '[{"a": 1}, {}]', '[{"a": 1}, {"a": "x"}]', '[{"a": [1]}]'):
        with pytest.raises(ValueError):
            Table.from_json("j", bad, spark=spark)
    p = Table.from_pandas("p", t.to_pandas(), spark=spark)
    assert p.column_names() == t.column_names() and p[0]["s"] == 'a,"b"'


def test_csv_files(spark, tmp_path):
    from rivulet.sources.text import read_csv_files

    (tmp_path / "x.csv").write_text("i,f,s,d\n1,2.5,a,2024-01-01\n2,3,,2024-02-02\n")
    df = read_csv_files(spark, str(tmp_path / "x.csv"))
    assert [t for _, t in df.dtypes] == ["int", "double", "string", "date"] and df.where("s IS NULL").count() == 1


def test_ordered_wide_base_keeps_every_row(spark):
    """An ordered base is laid out anew each time it is computed; the table's places must not depend on that."""
    n = 300_000
    wide = spark.range(0, n, 1, 6).select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("k"), "id", *[F.concat(F.lit("x" * i), F.col("id")).alias(f"c{i}") for i in range(8)])
    t = Table.from_dataframe("wide", wide.orderBy("k", "id"))
    assert len(t) == n and t.to_df().count() == n
    ks = t.to_df(hidden=True).select("k", "id", "__pos").orderBy("__pos").toPandas()
    assert ks["__pos"].tolist() == list(range(n)) and list(zip(ks["k"], ks["id"])) == sorted(zip(ks["k"], ks["id"]))
    kept = t.filter("id >= 299000")
    assert len(t.filter_expr("id >= 299000")) == len(kept) == 1000
    assert [r["id"] for r in t[5:8]] == ks["id"].tolist()[5:8] and t[n - 1]["id"] == ks["id"].iloc[-1]
    top = t.sort("id", True)
    assert [r["id"] for r in top[1000:1003]] == [n - 1001, n - 1002, n - 1003]
    assert top.get_parent_index(0) == ks["id"].tolist().index(n - 1)


def test_root_over_files_is_neither_copied_nor_scanned_for_a_row(spark, tmp_path):
    spark.range(0, 1000, 1, 4).selectExpr("id", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    t = Table.from_dataframe("t", spark.read.parquet(str(tmp_path / "t")).withColumn("w", F.col("v") + 1))
    assert sorted(r["id"] for r in t) == list(range(1000)) and t[700] == list(t)[700]
    assert all(f.startswith((tmp_path / "t").as_uri()[:8]) and "/t/" in f for f in t.to_df().inputFiles())
    plan = t._at(700)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "row_index" in plan
    t.set_value(700, "v", -1)
    t.delete_row(0)
    assert t[699]["v"] == -1 and len(t) == 999 == t.to_df().count()
    nested = t.group_by("v", [("n", "id", "count")]).sort("n")
    assert nested.get_parent_index(3) == 3
