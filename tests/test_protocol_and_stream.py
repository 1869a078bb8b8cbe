from pyspark.sql import types as T

from rivulet.operators.table import Table
from rivulet.plans.pipeline import SpecError, build_pipeline, mini_filter, mini_group, mini_sort
from rivulet.streaming.changes import StreamedTable, log_schema
from rivulet.streaming.protocol import Replica, Server
from rivulet.types import ColumnType as K
from rivulet.types import Schema

import pytest

SCHEMA = Schema([("bird", K.STRING, False), ("weight", K.FLOAT64, True), ("seen", K.DATE, True)])


def aviary(spark):
    server, t, said, copy = Server(), Table("aviary", SCHEMA, spark=spark), [], Replica()
    t.append_rows([{"bird": "kite", "weight": 0.9, "seen": None}, {"bird": "crane", "weight": 5.5, "seen": None}])
    server.add(t)
    session = server.connect(lambda m: (said.append(m), copy.receive(m)))
    return (lambda **m: session.handle({"table_name": "aviary", **m})), t, said, copy


def test_sessions_and_replicas(spark):
    send, t, said, copy = aviary(spark)
    for m in ({"type": "Subscribe"}, {"type": "Query"}, {"type": "DeleteRow", "row_id": 1}, {"type": "InsertRow", "row": {"bird": "rook", "weight": None, "seen": "2019-11-30"}},
              {"type": "UpdateCell", "row_id": 3, "column": "weight", "value": 0.45}, {"type": "UpdateCell", "row_id": 1, "column": "weight", "value": 1.0}):
        send(**m)
    assert [m["type"] for m in said] == ["Subscribed", "TableData", "RowDeleted", "RowInserted", "CellUpdated", "Error"]
    assert said[1]["rows"][1] == {"row_id": 2, "row": {"bird": "crane", "weight": 5.5, "seen": None}}
    assert copy.rows == {2: {"bird": "crane", "weight": 5.5, "seen": None}, 3: {"bird": "rook", "weight": 0.45, "seen": "2019-11-30"}}


def test_pipelines_over_the_wire(spark):
    send, t, said, _ = aviary(spark)
    nodes = [{"id": "heavy", "source_id": "base", "kind": "filter", "predicate": "weight > 0.5"}, {"id": "by", "source_id": "heavy", "kind": "group", "group_by": ["bird"], "aggs": [{"alias": "kg", "op": "sum", "column": "weight"}]}]
    send(type="SetPipeline", nodes=nodes)
    send(type="InsertRow", row={"bird": "kite", "weight": 1.0, "seen": None})
    last = [m for m in said if m["type"] == "ViewData" and m["node_id"] == "by"]
    assert [[r["row"] for r in m["rows"]] for m in last] == [[{"bird": "kite", "kg": 0.9}, {"bird": "crane", "kg": 5.5}], [{"bird": "kite", "kg": 1.9}, {"bird": "crane", "kg": 5.5}]]
    send(type="SetPipeline", nodes=[nodes[0] | {"source_id": "nowhere"}])
    assert said[-1]["type"] == "ViewError" and said[-1]["node_id"] == "heavy"


def test_clients_reach_no_other_method(spark):
    """Names of the session's own methods are no messages: nothing is broadcast, the log stays."""
    send, t, said, _ = aviary(spark)
    send(type="Subscribe")
    for kind in ("changed", "_changed", "refresh", "place", "handle", "view_data", "", None, 7, "_Query"):
        send(type=kind, row_id=1, seq=99)
    assert [m["type"] for m in said] == ["Subscribed", *["Error"] * 10] and t.pending_changes_count() == 2
    for message in ({}, {"type": "DeleteRow", "row_id": True}, {"type": "DeleteRow", "row_id": "1"}, {"type": "UpdateCell", "row_id": 1, "column": "wing", "value": 1}):
        send(**message)
    assert len(t) == 2 and all(m["type"] == "Error" for m in said[1:])


def test_replicas_ask_again():
    now = [0.0]
    r = Replica(lambda: now[0])
    assert r.wants_snapshot() and not r.wants_snapshot()
    now[0] = 3.5
    assert r.wants_snapshot()
    r.receive({"type": "TableData", "seq": 5, "rows": []})
    r.receive({"type": "RowDeleted", "seq": 7, "row_id": 1})
    assert not r.wants_snapshot()
    now[0] = 7.0
    assert r.wants_snapshot() and not r.wants_snapshot()
    r.receive({"type": "TableData", "seq": 7, "rows": [{"row_id": 4, "row": {"v": 1}}]})
    now[0] = 20.0
    assert not r.wants_snapshot() and r.rows == {4: {"v": 1}}


def test_replica_gaps():
    r = Replica()
    insert = lambda s: {"type": "RowInserted", "seq": s, "row_id": s, "row": {"v": s}}
    for m in (insert(4), {"type": "TableData", "seq": 2, "rows": []}, insert(2), insert(3)):
        r.receive(m)
    assert sorted(r.rows) == [3, 4] and r.seq == 4


def test_spec_errors(spark):
    t = Table("aviary", SCHEMA, spark=spark)
    group = {"kind": "group", "group_by": ["bird"], "aggs": [{"alias": "x", "op": "sum", "column": "weight"}]}
    for node in (group | {"group_by": []}, group | {"aggs": [{"alias": "x", "op": "sum", "column": None}]}, group | {"aggs": [{"alias": "x", "op": "p101", "column": "weight"}]},
                 {"kind": "filter", "predicate": "weight >"}, {"kind": "filter", "expr": "weight > 1"}, {"kind": "sort", "keys": [{"column": "weight"}]}, {"kind": "odd"}):
        with pytest.raises(SpecError):
            build_pipeline(t, [{"id": "n", "source_id": "base", **node}])
    assert build_pipeline(t, [{"id": "n", "source_id": "base", **group, "aggs": [{"alias": "x", "op": "count"}]}])["n"].column_names() == ["bird", "x"]


def test_mini_language(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 5.0), ("ab", 2.0)], "s string, v double")
    assert df.where(mini_filter("v > 4 or s contains b and v = 2", df.schema)).count() == 1
    assert [r["v"] for r in df.orderBy(*mini_sort("v desc, s")).collect()] == [None, 5.0, 2.0, 1.0]
    assert [tuple(r) for r in mini_group(df, "s | t=sum(v), n=count()").collect()] == [("-", 5.0, 1), ("a", 1.0, 1), ("ab", 2.0, 1), ("b", 0.0, 1)]


def test_streamed_changes(spark, tmp_path):
    """A new object on the same checkpoint goes on; late, repeated and older changes neither undo nor revive."""
    row = T.StructType.fromDDL("reed string, depth double")
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    write = lambda *rows: spark.createDataFrame(list(rows), log_schema(row)).coalesce(1).write.mode("append").parquet(folder)
    now = lambda t: sorted(map(tuple, t.table().collect()))
    write((11, "insert", 1, "a", 1.0), (12, "insert", 2, "b", 2.0), (15, "update", 1, "a", 9.0))
    first = StreamedTable(spark, folder, row, state)
    seen = []
    first.on_batch(lambda df, n: seen.append((n, df.count())))
    first.run()
    assert now(first) == [("a", 9.0), ("b", 2.0)] and seen == [(0, 2)]
    again = StreamedTable(spark, folder, row, state)
    assert now(again) == now(first)
    again.run()
    assert again.batches == 0 and now(again) == now(first)
    write((20, "delete", 2, "b", 2.0), (21, "insert", 3, "c", 3.0))
    again.run()
    write((14, "update", 2, "b", 7.0), (13, "update", 1, "old", 0.0))  # older than the delete and than the last update
    third = StreamedTable(spark, folder, row, state)
    third.run()
    assert now(third) == [("a", 9.0), ("c", 3.0)] == now(first)
    batch = spark.createDataFrame([(20, "delete", 2, "b", 2.0), (21, "insert", 3, "c", 3.0)], log_schema(row))
    third._batch(batch, 2)  # the same batch once more, as after a crash
    assert now(third) == [("a", 9.0), ("c", 3.0)] and len(third._written()) <= 3
    write((30, "insert", 2, "b", 8.0))
    StreamedTable(spark, folder, row, state).run()
    assert now(first) == [("a", 9.0), ("b", 8.0), ("c", 3.0)]


def test_streamed_groups(spark, tmp_path):
    from rivulet.streaming.changes import streamed_groups

    spark.createDataFrame([("x", 1.0), ("x", float("nan")), ("y", None), (None, 4.0)], "k string, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    groups = streamed_groups(spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in")), ["k"], [("n", "v", "count"), ("s", "v", "sum")])
    groups.writeStream.outputMode("complete").format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("grown").collect()), key=repr) == [("x", 1, 1.0), ("y", 0, None), (None, 1, 4.0)]


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from rivulet.sources.storage import shared_folder

    conf = SimpleNamespace(get=lambda key: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_folder(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master=master)))
