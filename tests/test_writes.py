import json

import pytest
from pyspark.sql import functions as F

from graphloom import write_queries
from graphloom.errors import GraphError
from graphloom.functions.patch import DELETE
from graphloom.model import TRIPLE_SCHEMA, triples
from graphloom.operators.graph import Graph
from graphloom.operators.search import find_nearest
from graphloom.sources.collections import Collection, collection_page, discover_collections
from graphloom.sources.store import CHANGES, SnapshotStore, change, changes_of

NOW = "2024-06-01 00:00:00"


@pytest.fixture()
def vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [3.0]), ("d", None)], "k string, e array<double>")
    return Graph(triples(rows, "item", F.col("k"), "is", "item", F.col("k"), {"e": F.col("e")}))


def test_distance_lands_in_the_payload(vectors):
    got = find_nearest(vectors, "e", [1.0, 0.0], 5, result_field="near.by").select("aUid", F.to_json("data").alias("d")).collect()
    assert [r["aUid"] for r in got] == ["a", "b"]
    assert json.loads(got[0]["d"]) == {"e": [1, 0], "near": {"by": 0}}
    for bad in ("data", "aUid"):
        with pytest.raises(GraphError):
            find_nearest(vectors, "e", [1.0, 0.0], 5, result_field=bad)


def test_all_rows_within_a_threshold(spark, tmp_path):
    """More rows than the largest limit lie within the threshold; the query gives them all."""
    from graphloom import queries

    rows = spark.range(1500).selectExpr("id AS vec_id", f"transform(array({', '.join(map(str, queries.VECTOR))}), x -> cast(x * (id + 1) AS float)) AS embedding", "cast(id % 5 = 0 AS int) + 1 AS label")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["nearest_threshold"](spark, str(tmp_path)).collect()
    assert sorted(r["aUid"] for r in got) == sorted(f"item-{k}" for k in range(1500) if k % 5)
    with pytest.raises(GraphError):
        find_nearest(Graph(rows), "embedding", [1.0], None)


def test_changes_of_rows(spark, vectors, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.read().columns == [c.split()[0] for c in TRIPLE_SCHEMA.split(", ")]
    store.apply(changes_of(vectors.rows, "put"), NOW)
    assert store.read().count() == 4
    store.apply(changes_of(store.read().where("aUid = 'a'"), "update", data={"e": DELETE, "x": {"y": 1}}), NOW)
    assert json.loads(store.graph().get_node("a").select(F.to_json("data")).first()[0]) == {"x": {"y": 1}}
    store.apply(changes_of(store.read().where("aUid <> 'a'"), "remove"), NOW)
    assert [r["aUid"] for r in store.read().collect()] == ["a"]
    with pytest.raises(GraphError):
        changes_of(store.read(), "put", data={"x": DELETE})
    with pytest.raises(GraphError):
        changes_of(store.read(), "upsert")


def test_lost_race(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    one = spark.createDataFrame([change("put", 0, ("t", "x"), data={"n": 1})], CHANGES)
    store.apply(one, NOW)
    with pytest.raises(GraphError, match="CONFLICT"):
        store.apply(one, NOW, base=0)
    assert store.version() == 1


def test_collections(spark, tmp_path):
    for name, text in {"good": '{"path": "graph/{node}/logs", "typeField": "kind", "typeValue": "audit", "orderBy": {"field": "at"}}', "bad": "{ no", "none": None}.items():
        (tmp_path / "collections" / name).mkdir(parents=True)
        if text:
            (tmp_path / "collections" / name / "collection.json").write_text(text)
    found, warnings = discover_collections(str(tmp_path))
    assert list(found) == ["good"] and len(warnings) == 2
    good = found["good"]
    assert good.located({"node": "n1"}) == "graph/n1/logs" and not good.descending
    for params in ({}, {"node": "a/b"}, {"node": ".."}):
        with pytest.raises(GraphError):
            good.located(params)
    docs = spark.createDataFrame([("a", "audit", 2), ("b", "audit", 1), ("c", "other", 0), ("d", "audit", None), ("e", "audit", 2)], "id string, kind string, at int")
    page = collection_page(docs, good, limit=2).collect()
    assert [(r["id"], r["hasMore"]) for r in page] == [("b", True), ("a", True)]
    assert [(r["id"], r["hasMore"]) for r in collection_page(docs, good, cursor="a").collect()] == [("e", False)]
    assert [r["id"] for r in collection_page(docs, good, where=(("at", ">", 1), ("at", "in", 5), ("x y", "==", 1))).collect()] == ["a", "e"]
    with pytest.raises(GraphError, match="NOT_FOUND"):
        collection_page(docs, good, cursor="zz")
    assert collection_page(docs.limit(0), Collection("all", "x")).collect() == []


def test_write_queries_have_their_sql():
    assert set(write_queries.QUERIES) == set(write_queries.ORACLE_SQL)
