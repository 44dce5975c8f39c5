"""Planner, patches, store and traversal on a small graph; queries against their SQL run in the driver."""

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.patch import DELETE, apply_patch, flatten_patch
from graphloom.model import child_scope, edge_doc_id, matches_scope, nodes, scope_names, triples
from graphloom.operators.graph import Graph, Hop
from graphloom.operators.search import find_nearest, near, phrase, prefix, words
from graphloom.plans import planner
from graphloom.plans.planner import Find
from graphloom.sources.store import CHANGES, SnapshotStore, change


def test_ids_and_scopes():
    assert edge_doc_id("tourA", "hasDeparture", "dep1") == "c:tourA:hasDeparture:dep1"
    assert child_scope("", "u", "g") == "u/g" and scope_names("u/g/v/h") == "g/h"
    with pytest.raises(GraphError):
        child_scope("", "a/b", "g")
    assert matches_scope("root", "") and matches_scope("a/*", "a/b") and matches_scope("**/b", "a/x/b") and not matches_scope("*", "a/b")


def test_planner():
    assert planner.point_key(Find(aUid="a", axbType="is", bUid="a")) == "a"
    assert planner.point_key(Find(aUid="a", axbType="x", bUid="b", where=[("k", "==", 1)])) is None
    assert (planner.effective_limit(None), planner.effective_limit(0), planner.effective_limit(7)) == (500, None, 7)
    with pytest.raises(GraphError) as e:
        planner.guard(Find(aType="t").filters())
    assert e.value.code == "QUERY_SAFETY"
    with pytest.warns(UserWarning, match="narrow"):
        assert planner.guard(Find(aType="t").filters(), "warn")
    assert planner.guard(Find(axbType="x", bUid="b").filters()) is None


def test_patches():
    ops = flatten_patch({"a": {"b": 1, "c": {}}, "d": DELETE, "e": [1, {"x": None}]})
    assert ops == [(["a", "b"], "set", 1), (["a", "c"], "set", {}), (["d"], "remove", None), (["e"], "set", [1, {"x": None}])]
    assert apply_patch('{"a":5,"d":1,"z":0}', ops) == '{"a":{"b":1,"c":{}},"e":[1,{"x":null}],"z":0}'
    for bad in ({"a": [DELETE]}, {"": 1}, {"a": b"x"}, {"a": float("nan")}):
        with pytest.raises(GraphError):
            flatten_patch(bad)


@pytest.fixture(scope="module")
def graph(spark):
    tours = spark.createDataFrame([("t1", "north", 10.0, [1.0, 0.0]), ("t2", "south", 20.0, [0.0, 1.0]), ("t3", None, 30.0, [1.0, 1.0])], "id string, region string, price double, vec array<double>")
    deps = spark.createDataFrame([("t1", "d1", 1), ("t1", "d2", 2), ("t1", "d3", 3), ("t2", "d3", 4)], "t string, d string, n int")
    table = nodes(tours, "tour", F.col("id"), {"region": F.col("region"), "price": F.col("price"), "vec": F.col("vec")}).unionByName(triples(deps, "tour", F.col("t"), "has", "dep", F.col("d"), {"n": F.col("n")}))
    return Graph(table.cache())


def test_reads(graph):
    ids = lambda df: sorted(r["aUid"] for r in df.collect())
    assert ids(graph.find_nodes("tour", [("region", "!=", "north")])) == ["t2"]
    assert ids(graph.find_nodes("tour", [("region", "not-in", ["north"])])) == ["t2"]
    assert ids(graph.find_nodes("tour", [("price", "==", "10")])) == [] and ids(graph.find_nodes("tour", [("price", ">", 15)])) == ["t2", "t3"]
    assert [r["aUid"] for r in graph.find_nodes("tour", order_by=("data.region", "asc")).collect()] == ["t3", "t1", "t2"]
    assert graph.edge_exists("t1", "has", "d1") and not graph.edge_exists("t3", "has", "d1")
    for bad in (lambda: graph.find_edges(Find()), lambda: graph.find_nodes("tour", order_by=("region", "asc")), lambda: graph.find_nodes("tour", [("a b", "==", 1)])):
        with pytest.raises(GraphError):
            bad()
    assert [r["aUid"] for r in find_nearest(graph, "vec", [1.0, 0.0], 2, "COSINE", find=Find(aType="tour", axbType="is")).collect()] == ["t1", "t3"]


def test_traversal(graph):
    rows = graph.traverse(["t1", "t2"], [Hop("has", limit=2, order_by=("data.n", "desc"))]).collect()
    assert sorted((r["aUid"], r["bUid"]) for r in rows) == [("t1", "d2"), ("t1", "d3"), ("t2", "d3")]
    assert graph.run_engine_traversal(["t1", "t2"], [Hop("has", limit=5)]).count() == 3
    back = graph.traverse(["d3"], [Hop("has", "reverse"), Hop("has")]).where("depth = 2")
    assert sorted({r["bUid"] for r in back.collect()}) == ["d1", "d2", "d3"]
    assert graph.traverse(["t1", "t2"], [Hop("has")], max_reads=1).count() == 3
    with pytest.raises(GraphError):
        graph.traverse(["t1"], [])
    totals = graph.traversal_totals(["t2", "t1"], [Hop("has", limit=2, order_by=("data.n", "asc")), Hop("has", "reverse")], max_reads=4).first()
    assert totals.asDict() == {"hops": 2, "totalReads": 4, "edges": 6, "nodes": 3, "truncated": True}


def test_first_reader_wins(spark):
    """A uid that two graphs lead to is read in the graph that came first, not in the smallest."""
    rows = [("", "start", "split", "srcB", 1), ("", "start", "split", "srcA", 2), ("srcA/sub", "srcA", "rel", "shared", 1), ("srcB/sub", "srcB", "rel", "shared", 1), ("srcA/sub", "shared", "next", "a", 1), ("srcB/sub", "shared", "next", "b", 1)]
    df = spark.createDataFrame(rows, "s string, a string, x string, b string, n int")
    table = None
    for relation in ("split", "rel", "next"):
        part = triples(df.where(F.col("x") == relation), "t", F.col("a"), relation, "t", F.col("b"), {"n": F.col("n")}, F.col("s"))
        table = part if table is None else table.unionByName(part)
    g = Graph(table)
    hops = [Hop("split", order_by=("data.n", "asc")), Hop("rel", target_graph="sub"), Hop("next")]
    assert [r["bUid"] for r in g.traverse(["start"], hops).where("depth = 3").collect()] == ["b"]
    turned = [Hop("split", order_by=("data.n", "desc")), *hops[1:]]
    assert [r["bUid"] for r in g.traverse(["start"], turned).where("depth = 3").collect()] == ["a"]
    report = [(r["sources"], r["reads"], r["truncated"]) for r in g.traversal_report(["start"], hops, max_reads=2).orderBy("depth").collect()]
    assert report == [(1, 1, False), (2, 1, True), (1, 0, True)]


def test_engine_caps_differ(spark):
    """The first hop's cap is of all sources together; later caps are of each parent; a target is read once."""
    edges = [("s1", f"m{i}") for i in range(6)] + [("s2", "m0")] + [(f"m{i}", f"e{j}") for i in range(6) for j in range(i, i + 4)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "a string, b string, n int")
    g = Graph(triples(df, "t", F.col("a"), "to", "t", F.col("b"), {"n": F.col("n")}))
    order = ("data.n", "asc")
    rows = g.run_engine_traversal(["s1", "s2"], [Hop("to", limit=2, order_by=order), Hop("to", limit=2, order_by=order)]).collect()
    assert sorted((r["depth"], r["aUid"], r["bUid"]) for r in rows) == [(1, "s1", f"m{i}") for i in range(4)] + [(2, "m0", "e0"), (2, "m0", "e1"), (2, "m1", "e2"), (2, "m2", "e3"), (2, "m3", "e4")]
    for bad in (lambda: g.run_engine_traversal(["s1"], []), lambda: g.run_engine_traversal(["s1"], [Hop("to", limit=None)]), lambda: g.run_engine_traversal(["s1"], [Hop("to")] * 6), lambda: g.run_engine_traversal(["s1"], [Hop("to", limit=5)], max_reads=4)):
        with pytest.raises(GraphError):
            bad()


def test_text_queries():
    both = (words("a B") | prefix("d*")) & ~phrase("e, a")
    assert [(u.op, u.parts) for u in both.units()] == [("phrase", ("a",)), ("phrase", ("b",)), ("prefix", ("d",)), ("phrase", ("e", "a"))]
    for bad in (lambda: words(""), lambda: phrase("--"), lambda: near("a b", within=-1), lambda: near()):
        with pytest.raises(GraphError):
            bad()


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/g")
    rows = lambda *cs: spark.createDataFrame(list(cs), CHANGES)
    t1, d1 = ("tour", "t1"), ("dep", "d1")
    store.apply(rows(change("put", 1, t1, data={"a": {"x": 1}, "p": 5}), change("put", 2, t1, data={"a": {"y": 2}}), change("put", 3, t1, "has", d1), change("put", 4, ("turn", "u"), scope="t1/log")), "2024-01-01 00:00:00")
    got = {r["docId"]: r for r in store.read().withColumn("j", F.to_json("data")).drop("data").collect()}
    assert got["t1"]["j"] == '{"a":{"x":1,"y":2},"p":5}' and len(got) == 3
    store.apply(rows(change("update", 1, t1, data={"a": {"x": DELETE}}), change("remove", 2, t1, "has", d1)), "2024-02-01 00:00:00")
    row = store.read().where("docId = 't1'").select(F.to_json("data"), F.month("createdAt"), F.month("updatedAt")).first()
    assert tuple(row) == ('{"a":{"y":2},"p":5}', 1, 2) and store.read().count() == 2 and store.read(1).count() == 3
    with pytest.raises(GraphError) as e:
        store.apply(rows(change("update", 1, ("tour", "nobody"), data={"a": 1})), "2024-02-01 00:00:00")
    assert e.value.code == "NOT_FOUND"
    with pytest.raises(GraphError) as e:
        store.commit(store.read(), 1)
    assert e.value.code == "CONFLICT"
    assert store.bulk_update(Find(aType="tour", axbType="is", where=[("p", ">=", 5)]), {"q": True}, "2024-03-01 00:00:00")[0] == 1
    assert store.graph().find_nodes("tour", [("q", "==", True)]).count() == 1
    assert store.remove_node_cascade("t1")[0] == 2 and store.read().count() == 0


def test_registry(graph):
    from graphloom.operators.registry import Entry, Registry, schema_errors

    schema = {"type": "object", "required": ["price"], "properties": {"price": {"type": "number", "minimum": 0, "maximum": 25}, "region": {"enum": ["north", "south"]}}}
    registry = Registry([Entry("tour", json_schema=schema, allowed_in=["root"], migrations=[(0, 1, "to_json(named_struct('cost', get_json_object(data, '$.price')))")]), Entry("tour", "has", "dep")])
    assert schema_errors(schema, {"region": "x"}) == ["/: lacks price", "/region: must be one of the listed values"]
    assert [r["aUid"] for r in registry.audit(graph.rows).collect()] == ["t3"]
    rows = registry.migrated(graph.find_nodes("tour")).select("aUid", F.to_json("data").alias("j"), "v").orderBy("aUid").collect()
    assert (rows[0]["j"], rows[0]["v"]) == ('{"cost":"10"}', 1) or (rows[0]["j"], rows[0]["v"]) == ('{"cost":"10.0"}', 1)
    with pytest.raises(GraphError):
        registry.validate("tour", "is", "tour", {"price": 1}, "u/sub")
    with pytest.raises(GraphError):
        Entry("x", migrations=[(1, 2, "data")])


def test_near_equals_sqlite(spark):
    """Least windows of phrases, against the full-text index of SQLite, and on a very long text."""
    import random
    import sqlite3

    from graphloom.operators.search import full_text_search

    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    table = nodes(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "doc", F.concat(F.lit("d"), F.col("i")), {"t": F.col("t")})
    g = Graph(table.cache())
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table x using fts5(t)")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text index")
    db.executemany("insert into x(rowid, t) values (?, ?)", [(i + 1, t) for i, t in enumerate(texts)])
    for parts, within in ((("a b", "c"), 2), (("a", "b", "c"), 0), (("a", "b", "c"), 3), (("a b c", "c d"), 4), (("a", "a"), 1), (("a b", "b a"), 0)):
        asked = "NEAR(" + " ".join(f'"{p}"' for p in parts) + f", {within})"
        want = {f"d{r[0] - 1}" for r in db.execute("select rowid from x where x match ?", (asked,))}
        got = {r["docId"] for r in full_text_search(g, near(*parts, within=within), 1000).collect()}
        assert got == want, asked
    long = " ".join(["x"] * 60_000 + ["sea"] + ["y"] * 9 + ["walk"] + ["sea"] * 60_000)
    g = Graph(nodes(spark.createDataFrame([(1, long)], "i long, t string"), "doc", F.lit("d"), {"t": F.col("t")}))
    assert full_text_search(g, near("sea walk y", within=9), 5).count() == 1 and full_text_search(g, near("sea x walk", within=8), 5).count() == 0
    with pytest.raises(GraphError):
        near(*["a"] * 65)


def test_exact_numbers(spark):
    from decimal import Decimal

    big = 1 << 53
    payloads = [str(big), str(big + 1), f"{big}.5", f"{float(big)}e0", "9007199254740994.0", "1e300", "100000000000000000000001", "100000000000000000000000", '"9007199254740993"', "null", "0.5", "-9007199254740993"]
    df = spark.createDataFrame([(f"n{i}", '{"x": ' + p + "}") for i, p in enumerate(payloads)], "id string, j string")
    g = Graph(nodes(df, "t", F.col("id"), {"x": F.lit(0)}).drop("data").join(df.select(F.col("id").alias("aUid"), F.parse_json("j").alias("data")), "aUid"))
    found = lambda op, v: sorted(r["aUid"] for r in g.find_nodes("t", [("x", op, v)], limit=0).collect())
    assert found("==", big) == ["n0", "n3"] and found("==", big + 1) == ["n1"] and found("==", Decimal(f"{big}.5")) == ["n2"]
    assert found(">", big) == ["n1", "n2", "n4", "n5", "n6", "n7"] and found("<", -big) == ["n11"] and found(">", 10**23) == ["n5", "n6"]
    assert found("in", [big + 1, 10**23, 0.5]) == ["n1", "n10", "n7"] and "n2" in found("not-in", [big, big + 1])
    long = [*range(1, 2000), big + 1, 10**23, "9007199254740993", 0.5]
    assert found("in", long) == ["n1", "n10", "n7", "n8"] and found("not-in", long) == ["n0", "n11", "n2", "n3", "n4", "n5", "n6"]
    order = [r["aUid"] for r in g.find_nodes("t", [("x", ">=", big), ("x", "<=", big + 2)], order_by=("data.x", "desc")).collect()]
    assert order == ["n4", "n1", "n2", "n0", "n3"]
    ints = Graph(g.table.where("aUid in ('n0', 'n1')"))
    assert ints.aggregate({"s": ("sum", "data.x", 0), "m": ("max", "data.x", 0)}, Find(aType="t", axbType="is")).first()[:] == (Decimal(2 * big + 1), Decimal(big + 1))
    for bad in (("avg", "data.x", 0), ("sum", "aUid", 0), ("sum", "data.x", 39)):
        with pytest.raises(GraphError):
            g.aggregate({"s": bad}, Find(aType="t", axbType="is"))
    with pytest.raises(GraphError):
        g.find_nodes("t", [("x", "==", Decimal("Infinity"))])
