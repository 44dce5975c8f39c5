"""Partitioned versions: what a commit rewrites, races, routed stores, documents beside the graph."""

import threading

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.patch import DELETE
from graphloom.plans.planner import Find
from graphloom.sources.collections import Collection, CollectionStore
from graphloom.sources.routed import RoutedStore
from graphloom.sources.store import CHANGES, SnapshotStore, change, changes_of

NOW = "2024-01-01 00:00:00"


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGES)


def test_only_touched_partitions_are_written(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/g", buckets=4)
    rows = [change("put", k, ("t", f"n{k}"), data={"k": k}) for k in range(40)] + [change("put", 50 + k, ("t", f"n{k}"), "to:x/y z", ("t", "n0"), {"w": k}) for k in range(20)]
    assert store.apply(changes(spark, *rows), NOW) == 1
    first = store.table.parts(1)
    assert len(set(first.values())) == 1 and {p[0] for p in first} == {"is", "to:x/y z"}
    assert store.apply(changes(spark, change("put", 0, ("t", "n3"), data={"k": -3})), NOW) == 2
    second = store.table.parts(2)
    assert sum(second[p] != first[p] for p in second) == 1 and store.read().count() == 60 and store.read(1).where("docId = 'n3'").select(F.to_json("data")).first()[0] == '{"k":3}'
    n, version = store.bulk_delete(Find(axbType="to:x/y z", where=[("w", ">=", 0)]))
    assert (n, version) == (20, 3) and {p[0] for p in store.table.parts(3)} == {"is"} and store.read().count() == 40
    assert store.bulk_delete(Find(axbType="is", where=[("k", ">", 99)])) == (0, 3)
    assert store.delete_graph() == 4 and store.table.parts(4) == {} and store.read().count() == 0
    assert store.apply(changes(spark, change("put", 0, ("t", "again"))), NOW) == 5
    assert SnapshotStore(spark, store.path, buckets=9).buckets(5) == 4  # as it was made


def test_one_of_two_racing_writers_wins(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/g")
    store.apply(changes(spark, change("put", 0, ("t", "a"))), NOW)
    start, outcomes = threading.Barrier(2), []

    def write(k):
        start.wait()
        try:
            outcomes.append(store.apply(changes(spark, change("put", 0, ("t", f"w{k}"))), NOW, base=1))
        except GraphError as e:
            outcomes.append(e.code)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, outcomes)) == ["2", "CONFLICT"] and store.read().count() == 2
    added = [f"w{k}" for k in range(2)]

    def add(k):
        start.wait()
        store.run_transaction(lambda g: changes(spark, change("put", 0, ("t", f"x{k}"))), NOW, attempts=4)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r["aUid"] for r in store.read().collect()} - set(added) == {"a", "x0", "x1"} and store.version() == 4
    with pytest.raises(GraphError):
        store.table._claim(4, "{}")  # a marker that is there


def test_edge_with_node(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/g")
    edge = (("t", "a"), "to", ("u", "b"))
    assert store.put_edge_with_node(edge, NOW, {"n": 1}, {"w": 1}) == 1 and store.read().count() == 2
    with pytest.raises(GraphError) as e:
        store.put_edge_with_node(edge, NOW)
    assert e.value.code == "CONFLICT" and store.version() == 1
    assert store.put_edge_with_node(edge, NOW, {"n": 2}, {"v": 2}, new_side="a") == 2
    data = {r["docId"]: r["j"] for r in store.read().select("docId", F.to_json("data").alias("j")).collect()}
    assert data.pop("a") == '{"n":2}' and data.pop("b") == '{"n":1}' and list(data.values()) == ['{"v":2,"w":1}']
    with pytest.raises(GraphError):
        store.put_edge_with_node(edge, NOW, new_side="c")


def test_routed_cascades_and_failures(spark, tmp_path):
    base, logs = SnapshotStore(spark, f"file://{tmp_path}/b"), SnapshotStore(spark, f"file://{tmp_path}/l")
    routed = RoutedStore(base, {"logs": logs}, lambda uid, name, path: "logs" if name == "log" else None, {"logs": {"log"}})
    rows = [change("put", 0, ("t", "a")), change("put", 1, ("t", "b")), change("put", 2, ("t", "a"), "to", ("t", "b")), change("put", 3, ("n", "n1"), scope="a/notes"), change("put", 4, ("l", "l1"), data={"k": 1}, scope="a/log"), change("put", 5, ("l", "l2"), scope="b/log")]
    assert [(o.store, o.rows, o.version, o.error) for o in routed.apply_all(changes(spark, *rows), NOW)] == [("", 4, 1, None), ("logs", 2, 1, None)]
    bad = routed.apply_all(changes(spark, change("update", 0, ("t", "nobody"), data={"x": 1}), change("put", 1, ("l", "l3"), scope="c/log")), NOW)
    assert bad[0].version is None and bad[0].error.startswith("NOT_FOUND") and bad[1].version == 2 and base.version() == 1
    assert {(r["store"], r["aUid"]) for r in routed.find_edges_global(Find(axbType="is", aType="l", limit=0), "log").collect()} == {("logs", "l1"), ("logs", "l2"), ("logs", "l3")}
    assert [r["aUid"] for r in routed.find_edges_global(Find(axbType="is", bType="n", limit=0), "notes").collect()] == ["n1"]
    assert [(o.store, o.rows, o.version) for o in routed.remove_node_cascade("a")] == [("", 3, 2), ("logs", 1, 3)]
    assert [(o.store, o.rows, o.version) for o in routed.remove_node_cascade("a")] == [("", 0, 2), ("logs", 0, 3)]
    assert sorted(r["aUid"] for r in routed.read_all().collect()) == ["b", "l2", "l3"]
    with pytest.raises(GraphError):
        RoutedStore(base, {}, lambda *a: "gone").store_of("a/log")


def test_documents_beside_the_graph(spark, tmp_path):
    dogs = Collection("dogs", "homes/{home}/pets", "kind", "dog")
    store = CollectionStore(spark, f"file://{tmp_path}", dogs, "id string, kind string, name string, age long", {"home": "h1"}, buckets=3)
    assert store.read().count() == 0
    docs = spark.createDataFrame([("d1", "Rex", 3), (None, "Ida", None)], "id string, name string, age int")
    assert store.create(docs) == 1
    got = {r["name"]: r for r in store.read().collect()}
    assert got["Rex"].asDict() == {"id": "d1", "kind": "dog", "name": "Rex", "age": 3} and got["Ida"]["id"] and got["Ida"]["kind"] == "dog"
    patch = spark.createDataFrame([("d1", 4)], "id string, age long")
    assert store.update(patch, 1, F.col("age") == 3) == 2
    for call, code in (
        (lambda: store.create(docs.where("id = 'd1'")), "CONFLICT"), (lambda: store.update(patch, 1), "CONFLICT"), (lambda: store.update(patch, expected=F.col("age") == 3), "CONFLICT"), (lambda: store.update(patch.withColumn("id", F.lit("d9"))), "NOT_FOUND"),
        (lambda: store.delete(patch.withColumn("id", F.lit("d9"))), "NOT_FOUND"), (lambda: store.update(patch.withColumn("x", F.lit(1))), "INVALID_QUERY"), (lambda: store.update(patch.union(patch)), "INVALID_QUERY"), (lambda: store.create(docs.where("id = 'd1'").withColumn("id", F.lit("d5")).union(docs.where("id = 'd1'").withColumn("id", F.lit("d5")))), "CONFLICT"),
    ):
        with pytest.raises(GraphError) as e:
            call()
        assert e.value.code == code
    assert store.version() == 2 and store.read().where("id = 'd1'").first().asDict() == {"id": "d1", "kind": "dog", "name": "Rex", "age": 4}
    assert store.delete(patch.select("id"), expected=F.col("age") == 4) == 3 and store.read().count() == 1 and store.read(2).count() == 2


def test_write_back_on_read(spark, tmp_path):
    from graphloom.operators.registry import Entry, Registry

    store = SnapshotStore(spark, f"file://{tmp_path}/g")
    store.apply(changes(spark, *[change("put", k, ("t", f"n{k}"), data={"k": k}) for k in range(6)]), NOW)
    registry = Registry([Entry("t", migrations=[(0, 1, "to_json(named_struct('k', get_json_object(data, '$.k')))")])])
    some = Find(aType="t", axbType="is", where=[("k", "<", 2)])
    rows, version = store.read_migrated(registry, some)
    assert version == 2 and sorted(r["v"] for r in rows.collect()) == [1, 1]
    assert sorted((r["docId"], r["v"]) for r in store.read().collect()) == [(f"n{k}", 1 if k < 2 else None) for k in range(6)]
    assert store.read_migrated(registry, Find(aType="t", axbType="is", where=[("k", "==", "0")]))[1] == 2  # nothing old
    rows, version = store.read_migrated(registry, Find(aType="t", axbType="is", where=[("k", ">", 2)]), base=1)
    assert version == 1 and rows.count() == 3 and store.version() == 2  # a writer was faster


def test_changes_rewrite_one_type(spark, tmp_path):
    """A change of rows of one type leaves the partitions of other types; one that gives a row another type takes its old one along."""
    store = SnapshotStore(spark, f"file://{tmp_path}/g", buckets=1)
    store.apply(changes(spark, *[change("put", k, (kind, f"{kind}{k}"), data={"k": k}) for k in range(8) for kind in ("t", "u")]), NOW)
    first = store.table.parts(1)
    store.apply(changes(spark, change("put", 0, ("t", "t3"), data={"x": 1})), NOW)
    second = store.table.parts(2)
    assert len(first) == 2 and sum(second[p] != first[p] for p in second) == 1
    store.apply(changes(spark, change("put", 0, ("u", "t3"), data={"y": 2}), change("remove", 0, ("u", "t4")), change("update", 0, ("v", "t5"), data={"z": 3})), NOW)
    rows = {r["docId"]: (r["aType"], r["j"]) for r in store.read().select("docId", "aType", F.to_json("data").alias("j")).collect()}
    assert store.read().count() == len(rows) == 15 and "t4" not in rows
    assert rows["t3"] == ("u", '{"k":3,"x":1,"y":2}') and rows["t5"] == ("t", '{"k":5,"z":3}') and rows["u3"] == ("u", '{"k":3}')


def test_versions_without_kinds_are_read_and_written(spark, tmp_path):
    """A store whose marker names no kinds keeps its partitions, of all types together."""
    store = SnapshotStore(spark, f"file://{tmp_path}/g", buckets=2)
    rows = changes(spark, *[change("put", k, (kind, f"{kind}{k}"), data={"k": k}) for k in range(8) for kind in ("t", "u")])
    settings = store._settings
    store._settings = lambda version: {"buckets": 2, "kinds": 1}
    store.apply(rows, NOW)
    marker = tmp_path / "g" / "version-1"
    marker.write_text(marker.read_text().replace(', "kinds": 1', ""))
    store._settings = settings
    assert store._settings(1) == {"buckets": 2, "kinds": 1}
    store.apply(changes(spark, change("put", 0, ("u", "t3"), data={"y": 2})), NOW)
    assert {p[1] for p in store.table.parts(2)} == {"0", "1"} and store.read().count() == 16
    assert store.read().where("docId = 't3'").select("aType", F.to_json("data")).first()[:] == ("u", '{"k":3,"y":2}')


def _two_types(spark, path):
    """A store of two types in one share, and what its partitions of type u are."""
    store = SnapshotStore(spark, f"file://{path}/g", buckets=1)
    store.apply(changes(spark, *[change("put", k, (kind, f"{kind}{k}"), data={"k": k}) for k in range(4) for kind in ("t", "u")]), NOW)
    parts = store.table.touched(store._read(1).where("aType = 'u'"))
    return store, {part: store.table.parts(1)[part] for part, _ in parts}


def _untouched(store, others):
    now = store.table.parts(store.version())
    return store.version() == 2 and len(now) > len(others) and others.items() <= now.items()


def test_write_back_keeps_other_types(spark, tmp_path):
    from graphloom.operators.registry import Entry, Registry

    store, others = _two_types(spark, tmp_path)
    registry = Registry([Entry("t", migrations=[(0, 1, "to_json(named_struct('k', get_json_object(data, '$.k')))")])])
    rows, version = store.read_migrated(registry, Find(aType="t", axbType="is", where=[("k", "<", 2)]))
    assert version == 2 and rows.count() == 2 and _untouched(store, others)
    assert sorted((r["docId"], r["v"]) for r in store.read().where("v is not null").collect()) == [("t0", 1), ("t1", 1)] and store.read().count() == 8


def test_transaction_keeps_other_types(spark, tmp_path):
    store, others = _two_types(spark, tmp_path)
    body = lambda g: changes_of(g.find_edges(Find(aType="t", axbType="is", where=[("k", ">", 1)], limit=0)), "update", data={"state": "rich"})
    assert store.run_transaction(body, NOW) == 2 and _untouched(store, others)
    assert sorted(r[0] for r in store.read().where("aType = 't'").select(F.to_json("data")).collect()) == ['{"k":0}', '{"k":1}', '{"k":2,"state":"rich"}', '{"k":3,"state":"rich"}']


def test_replacements_keep_other_types(spark, tmp_path):
    store, others = _two_types(spark, tmp_path)
    assert store.apply(changes_of(store.read().where("aType = 't' and aUid < 't2'"), "replace", data={"name": "closed"}), NOW) == 2 and _untouched(store, others)
    assert sorted(r[0] for r in store.read().where("aType = 't'").select(F.to_json("data")).collect()) == ['{"k":2}', '{"k":3}', '{"name":"closed"}', '{"name":"closed"}']


def test_updates_keep_other_types(spark, tmp_path):
    store, others = _two_types(spark, tmp_path)
    assert store.apply(changes_of(store.read().where("aType = 't' and aUid < 't2'"), "update", data={"k": DELETE, "state": "new"}), NOW) == 2 and _untouched(store, others)
    rows = store.read().where("aType = 't'").select(F.to_json("data"), F.col("createdAt") == F.lit(NOW).cast("timestamp")).collect()
    assert sorted(tuple(r) for r in rows) == [('{"k":2}', True), ('{"k":3}', True), ('{"state":"new"}', True), ('{"state":"new"}', True)]
