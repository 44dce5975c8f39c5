"""Definitions, routing, wire format, streams, transactions and the shell client on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import __main__ as shell
from graphloom.errors import GraphError
from graphloom.model import nodes
from graphloom.operators.browse import clamped, node_detail, nodes_batch, page
from graphloom.operators.graph import Graph
from graphloom.operators.registry import Entry, Registry
from graphloom.operators.search import full_text_search, near, phrase, prefix, words
from graphloom.plans.planner import Find
from graphloom.sources import definitions
from graphloom.sources.routed import RoutedStore
from graphloom.sources.store import CHANGES, SnapshotStore, change
from graphloom.sources.wire import export_json, import_json
from graphloom.streaming.changes import fold_into, read_changes

NOW = "2024-01-01 00:00:00"
TOUR, DEP = ("tour", "t1"), ("dep", "d1")


@pytest.fixture
def store(spark, tmp_path):
    made = SnapshotStore(spark, f"file://{tmp_path}/g")
    rows = [change("put", 1, TOUR, data={"name": "A walk", "notes": [{"x": "by the sea"}], "n": 3}), change("put", 2, DEP), change("put", 3, TOUR, "has", DEP, {"n": 1})]
    made.apply(spark.createDataFrame(rows, CHANGES), NOW)
    return made


def test_definitions_from_folder_and_graph(spark, store, tmp_path):
    schema = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "n": {"type": "integer"}, "at": {"type": "object", "properties": {"city": {"type": "string"}}}}}
    for at, value in (("nodes/tour/schema.json", schema), ("edges/has/edge.json", {"from": "tour", "to": ["dep", "other"], "targetGraph": "sub"})):
        path = tmp_path / "e" / at
        path.parent.mkdir(parents=True)
        path.write_text(json.dumps(value))
    registry, warnings = definitions.discover(str(tmp_path / "e"))
    assert registry.topology("tour") == [("tour", "has", "dep", "sub"), ("tour", "has", "other", "sub")] and registry.target_graph("has") == "sub" and len(warnings) == 2
    (tmp_path / "e/edges/has/edge.json").write_text("{")
    with pytest.raises(GraphError):
        definitions.discover(str(tmp_path / "e"))
    assert definitions.struct_of(schema).simpleString() == "struct<name:string,n:bigint,at:struct<city:string>>"
    assert [r["path"] for r in definitions.field_rules(schema)] == ["name", "n", "at", "at.city"]
    assert definitions.typed_payloads(store.graph(), Entry("tour", json_schema=schema)).first()[:3] == ("t1", "A walk", 3)
    store.apply(spark.createDataFrame([definitions.define_node_type(1, "tour", schema), definitions.define_edge_type(2, "has", "tour", "dep")], CHANGES), NOW)
    own = definitions.registry_of(store.graph(), Registry([Entry("tour")]))
    assert own.entries["tour", "is", "tour"].json_schema is None and ("tour", "has", "dep") in own.entries
    with pytest.raises(GraphError):
        definitions.define_node_type(1, "nodeType", {})


def test_routing(spark, store, tmp_path):
    other = SnapshotStore(spark, f"file://{tmp_path}/o")
    routed = RoutedStore(store, {"logs": other}, lambda uid, name, path: "logs" if name == "log" else None)
    assert routed.name_of("t1/log/x/deep") == "logs" and routed.store_of("t1/log/x/deep") is other and routed.store_of("t1/plain") is store and "core.transactions" not in routed.capabilities
    rows = spark.createDataFrame([change("put", 1, ("line", "l"), scope="t1/log")], CHANGES)
    routed.apply(rows, NOW, "t1/log")
    assert routed.graph("t1/log").get_node("l").count() == 1 and routed.read_all().groupBy("store").count().count() == 2
    with pytest.raises(GraphError):
        routed.apply(rows, NOW)


def test_wire_and_transactions(spark, store, tmp_path):
    export_json(store.read(), f"file://{tmp_path}/lines")
    back = import_json(spark, f"file://{tmp_path}/lines")
    as_rows = lambda df: sorted(map(tuple, df.withColumn("data", F.to_json("data")).collect()), key=str)
    assert as_rows(back) == as_rows(store.read())
    tries = []

    def body(graph):
        tries.append(graph.get_node("t1").count())
        if len(tries) == 1:  # another writer comes between
            store.apply(spark.createDataFrame([change("put", 1, ("dep", "d2"))], CHANGES), NOW)
        return spark.createDataFrame([change("update", 1, TOUR, data={"n": 4})], CHANGES)

    assert store.run_transaction(body, NOW) == 3 and tries == [1, 1] and store.read().count() == 4
    assert store.run_transaction(lambda g: None, NOW) == 3
    up = Registry([Entry("tour", migrations=[(0, 1, "to_json(named_struct('m', get_json_object(data, '$.n')))")])])
    assert store.compact_migrations(up)[0] == 1 and store.compact_migrations(up)[0] == 0
    assert up.stamped(store.read()).where("docId = 't1'").first()["v"] == 1
    assert store.bulk_remove_edges(Find(aUid="t1", where=[]))["deleted"] == 1 and store.read().count() == 3
    store.delete_graph("", nested=True)
    assert store.read().count() == 0


def test_stream_of_changes(spark, store, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([change("put", 1, TOUR, data={"n": 9}), change("update", 2, ("dep", "nobody"), data={"a": 1})], CHANGES).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        fold_into(read_changes(spark, source), store, f"file://{tmp_path}/cp", NOW).awaitTermination()
    assert store.version() == 2 and store.graph().find_nodes("tour", [("n", "==", 9)]).count() == 1 and store.read().count() == 3


def test_browsing(store, capsys, spark):
    g = store.graph()
    assert [clamped(x) for x in (None, 0, 999)] == [25, 1, 200]
    assert {(r["side"], r["docId"][:2]) for r in node_detail(g, "t1").collect()} == {("node", "t1"), ("out", next(iter(g.find_edges(Find(axbType="has", aType="tour")).collect()))["docId"][:2])}
    assert {r["uid"]: r["node"] is None for r in nodes_batch(g, ["t1", "zz"]).collect()} == {"t1": False, "zz": True}
    assert page(g, Find(aType="tour")).count() == 1 and not page(g, Find(axbType="is"), limit=2).first()["hasMore"]
    first = page(g, Find(axbType="is"), "aUid", limit=1).first()
    assert first["hasMore"] and page(g, Find(axbType="is"), "aUid", cursor=(first["sortKey"], first["docId"]), limit=1).first()["aUid"] == "t1"
    assert full_text_search(g, "sea", 5).first()["docId"] == "t1" and full_text_search(g, near("walk sea", within=3), 5).count() == 1 and full_text_search(g, near("walk sea", within=1), 5).count() == 0
    assert full_text_search(g, words("walk") & ~prefix("s"), 5).count() == 0
    assert full_text_search(g, phrase("sea walk"), 5).count() == 0
    shell.main([store.path, "find-nodes", "tour", "--where", "n >= 2"], spark)
    shell.main([store.path, "traverse", "d1", "<has:5"], spark)
    out = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert [o["from"] for o in out] == ["t1", "t1"] and [o["relation"] for o in out] == ["is", "has"]


def test_empty_table(spark):
    g = Graph(nodes(spark.createDataFrame([], "id string"), "x", F.col("id")))
    assert g.find_nodes("x").count() == 0 and full_text_search(g, "a", 3).count() == 0 and node_detail(g, "q").count() == 0
