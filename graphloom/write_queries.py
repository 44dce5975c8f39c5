"""Queries that write: each seeds a snapshot store from the star tables, changes it and reads it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions.patch import DELETE
from graphloom.model import NODE
from graphloom.operators.graph import Graph
from graphloom.operators.registry import Entry, Registry
from graphloom.operators.search import find_nearest
from graphloom.plans.planner import Find
from graphloom.sources.collections import Collection, CollectionStore, collection_page
from graphloom.sources.folders import new_folder
from graphloom.sources.routed import RoutedStore
from graphloom.sources.store import CHANGES, SnapshotStore, change, changes_of
from graphloom.sources.tables import star_branches, star_triples
from graphloom.streaming.changes import fold_into, read_changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "2024-06-01 00:00:00"
BUILDING = Find(aType="customer", axbType=NODE, where=[("segment", "==", "BUILDING")], limit=0)


def query(sql: str):
    """Registers a function of a store that holds all rows of the star tables."""

    def keep(fn: Callable[[SnapshotStore], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            store = SnapshotStore(spark, new_folder(spark, fn.__name__), buckets=4)
            store.commit(star_triples(spark, sf_dir), 0, shuffle=False)  # each table's rows come by themselves
            return fn(store)

        QUERIES[fn.__name__] = run
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def _rows(store: SnapshotStore, *kinds: str) -> DataFrame:
    return store.read().where(F.col("aType").isin(*kinds) & F.col("axbType").isin(NODE, "inNation", "inRegion"))


def _text(name: str) -> Column:
    return paths.typed(paths.data_path(name), "string").alias(name.split(".")[-1])


def _number(name: str) -> Column:
    return F.round(paths.typed(paths.data_path(name), "number"), 6).alias(name.split(".")[-1])


def _customers(store: SnapshotStore, *cols: Column) -> DataFrame:
    return store.graph().find_nodes("customer", limit=0).select("aUid", *cols, (F.col("updatedAt") == F.lit(NOW).cast("timestamp")).alias("touched"), (F.col("createdAt") == F.lit(NOW).cast("timestamp")).alias("made"))


def _customer_sql(cols: str, hit: str, made: bool) -> str:
    return f"SELECT 'customer-' || c_custkey AS aUid, {cols}, {hit} AS touched, {hit if made else 'FALSE'} AS made FROM customer"


_HIT = "c_mktsegment = 'BUILDING'"


@query(_customer_sql(f"c_mktsegment AS segment, CASE WHEN {_HIT} THEN 0.5 ELSE round(c_acctbal, 6) END AS acctbal, CASE WHEN {_HIT} THEN 'gold' END AS level", _HIT, True))
def put_merge(store: SnapshotStore) -> DataFrame:
    """Puts merge into payloads, nested fields too."""
    rows = store.graph().find_edges(BUILDING)
    store.apply(changes_of(rows, "put", data={"acctbal": 0.5, "rank": {"level": "gold"}}), NOW)
    return _customers(store, _text("segment"), _number("acctbal"), _text("rank.level"))


@query(_customer_sql(f"CASE WHEN NOT {_HIT} THEN c_mktsegment END AS segment, CASE WHEN {_HIT} THEN 'closed' ELSE c_name END AS name", _HIT, True))
def replace_nodes(store: SnapshotStore) -> DataFrame:
    """Replacements leave nothing of the old payload."""
    rows = store.graph().find_edges(BUILDING)
    store.apply(changes_of(rows, "replace", data={"name": "closed"}), NOW)
    return _customers(store, _text("segment"), _text("name"))


@query(_customer_sql(f"CASE WHEN NOT {_HIT} THEN c_mktsegment END AS segment, c_name AS name, CASE WHEN {_HIT} THEN 'new' END AS state", _HIT, False))
def update_delete_field(store: SnapshotStore) -> DataFrame:
    """An update removes a field and sets another; the time of creation stays."""
    rows = store.graph().find_edges(BUILDING)
    store.apply(changes_of(rows, "update", data={"segment": DELETE, "state": "new"}), NOW)
    return _customers(store, _text("segment"), _text("name"), _text("state"))


_NEGATIVE = Find(aType="customer", axbType=NODE, where=[("acctbal", "<", 0)])


@query("SELECT 'customer-' || c_custkey AS aUid, 'is' AS axbType FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'customer-' || c_custkey, 'inNation' FROM customer")
def bulk_delete(store: SnapshotStore) -> DataFrame:
    store.bulk_delete(_NEGATIVE)
    return _rows(store, "customer").select("aUid", "axbType")


@query(_customer_sql("round(c_acctbal, 6) AS acctbal, CASE WHEN c_acctbal < 0 THEN 'owes' END AS state", "c_acctbal < 0", False))
def bulk_update(store: SnapshotStore) -> DataFrame:
    store.bulk_update(_NEGATIVE, {"state": "owes"}, NOW)
    return _customers(store, _number("acctbal"), _text("state"))


@query("SELECT 'nation-' || n_nationkey AS aUid, 'is' AS axbType FROM nation UNION ALL SELECT 'nation-' || n_nationkey, 'inRegion' FROM nation WHERE n_regionkey <> 2")
def bulk_remove_edges(store: SnapshotStore) -> DataFrame:
    store.bulk_remove_edges(Find(axbType="inRegion", bUid="region-2"))
    return _rows(store, "nation").select("aUid", "axbType")


@query(
    "SELECT 'nation-' || n_nationkey AS aUid, 'is' AS axbType, 'nation-' || n_nationkey AS bUid FROM nation WHERE n_nationkey <> 3 "
    "UNION ALL SELECT 'nation-' || n_nationkey, 'inRegion', 'region-' || n_regionkey FROM nation WHERE n_nationkey <> 3 "
    "UNION ALL SELECT 'supplier-' || s_suppkey, 'is', 'supplier-' || s_suppkey FROM supplier "
    "UNION ALL SELECT 'supplier-' || s_suppkey, 'inNation', 'nation-' || s_nationkey FROM supplier WHERE s_nationkey <> 3",
)
def cascade_delete(store: SnapshotStore) -> DataFrame:
    store.remove_node_cascade("nation-3")
    return _rows(store, "nation", "supplier").select("aUid", "axbType", "bUid")


@query(
    "SELECT 'nation-' || n_nationkey AS aUid, n_name AS name, CASE WHEN n_nationkey = 1 THEN 2 END AS rank FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT 'nation-99', 'ATLANTIS', 7",
)
def batch_fold(store: SnapshotStore) -> DataFrame:
    """Puts, updates and removals of one batch hold in their order and land in one snapshot."""
    nation = lambda k: ("nation", f"nation-{k}")
    batch = [
        change("put", 0, nation(99), data={"name": "ATLANTIS", "rank": 1}),
        change("update", 1, nation(99), data={"rank": 7}),
        change("update", 2, nation(1), data={"rank": 2}),
        change("remove", 3, nation(2)),
        change("put", 4, nation(98), data={"name": "MU"}),
        change("remove", 5, nation(98)),
    ]
    store.apply(store.spark.createDataFrame(batch, CHANGES), NOW)
    return store.graph().find_nodes("nation", limit=0).select("aUid", _text("name"), paths.typed(paths.data_path("rank"), "number").cast("int").alias("rank"))


@query(_customer_sql("CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer) THEN 'rich' END AS state", "c_acctbal > (SELECT avg(c_acctbal) FROM customer)", False))
def transaction(store: SnapshotStore) -> DataFrame:
    """A transaction whose writes depend on what it reads of one version."""

    def body(graph: Graph) -> DataFrame:
        mean = graph.aggregate({"mean": ("avg", "data.acctbal")}, Find(aType="customer", axbType=NODE)).first()["mean"]
        rows = graph.find_edges(Find(aType="customer", axbType=NODE, where=[("acctbal", ">", mean)], limit=0))
        return changes_of(rows, "update", data={"state": "rich"})

    store.run_transaction(body, NOW)
    return _customers(store, _text("state"))


@query(_customer_sql("CASE WHEN c_acctbal < 0 THEN 'streamed' END AS state", "c_acctbal < 0", False))
def stream_fold(store: SnapshotStore) -> DataFrame:
    """A stream of changes, folded into the store until it has read all that has arrived."""
    feed = new_folder(store.spark, "feed")
    rows = store.graph().find_edges(Find(aType="customer", axbType=NODE, where=[("acctbal", "<", 0)], limit=0))
    changes_of(rows, "update", data={"state": "streamed"}).write.parquet(feed)
    fold_into(read_changes(store.spark, feed), store, new_folder(store.spark, "offsets"), NOW).awaitTermination()
    return _customers(store, _text("state"))


@query(
    "SELECT 'bulk_delete' AS change, count(*) FILTER (c_acctbal < 0) AS n FROM customer UNION ALL SELECT 'bulk_update', count(*) FILTER (c_acctbal > 5000) FROM customer "
    "UNION ALL SELECT 'bulk_remove_edges', count(*) FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'cascade', (SELECT 1 + count(*) FROM supplier WHERE s_nationkey = 3) + (SELECT count(*) FROM customer WHERE c_nationkey = 3) + 1 "
    "UNION ALL SELECT 'left', (SELECT count(*) FILTER (c_acctbal >= 0) + count(*) FILTER (c_nationkey <> 3) FROM customer)"
)
def affected_rows(store: SnapshotStore) -> DataFrame:
    """How many rows each conditional write met."""
    met = [
        ("bulk_delete", store.bulk_delete(_NEGATIVE)[0]),
        ("bulk_update", store.bulk_update(Find(aType="customer", axbType=NODE, where=[("acctbal", ">", 5000)]), {"state": "rich"}, NOW)[0]),
        ("bulk_remove_edges", store.bulk_remove_edges(Find(axbType="inRegion", bUid="region-2"))["deleted"]),
        ("cascade", store.remove_node_cascade("nation-3")[0]),
        ("left", _rows(store, "customer").count()),
    ]
    return store.spark.createDataFrame(met, "change string, n long")


@query("SELECT 'conv-' || conv_id || '/turns' AS scope, 'turn-' || conv_id || '-' || turn AS bUid, axbType FROM conversations, (VALUES ('is'), ('hasTurn')) v(axbType) WHERE conv_id <> 4")
def cascade_nested(store: SnapshotStore) -> DataFrame:
    """A node goes with the graphs that are nested under it, all others stay."""
    store.remove_node_cascade("conv-4")
    return store.read().where("scope <> ''").select("scope", "bUid", "axbType")


@query("SELECT 'region-' || r_regionkey AS aUid, r_name AS name, CASE r_regionkey WHEN 0 THEN 5 WHEN 2 THEN 6 END AS v FROM region")
def versions_kept(store: SnapshotStore) -> DataFrame:
    """Updates and puts without a version keep that of the row; a replacement drops it."""
    region = lambda k: ("region", f"region-{k}")
    first = [change("put", k, region(k), data={"rank": k}, v=5) for k in (0, 1, 2)]
    store.apply(store.spark.createDataFrame(first, CHANGES), NOW)
    names = {r["aUid"]: r["name"] for r in store.graph().find_nodes("region").select("aUid", _text("name")).collect()}
    then = [change("update", 0, region(0), data={"rank": 9}), change("replace", 1, region(1), data={"name": names["region-1"]}), change("put", 2, region(2), data={"rank": 8}, v=6)]
    store.apply(store.spark.createDataFrame(then, CHANGES), NOW)
    return store.graph().find_nodes("region").select("aUid", _text("name"), "v")


_ROUTES = {"turns": "talk", "replies": "notes"}


def _replies(rows: DataFrame) -> DataFrame:
    """Under each turn a graph of replies with one node."""
    turns = rows.where("aType = 'turn'")
    return turns.withColumns({"scope": F.concat_ws("/", "scope", "aUid", F.lit("replies")), "aType": F.lit("reply"), "bType": F.lit("reply")})


def _routed(spark: SparkSession, sf_dir: str) -> RoutedStore:
    """All rows of the star tables, with the turns in a store of their own and the replies to them in another."""
    rows = star_triples(spark, sf_dir)
    base, talk, notes = (SnapshotStore(spark, new_folder(spark, n), buckets=4) for n in ("base", "talk", "notes"))
    base.commit(rows.where("scope = ''"), 0)
    talk.commit(rows.where("scope <> ''"), 0)
    notes.commit(_replies(rows), 0)
    return RoutedStore(base, {"talk": talk, "notes": notes}, lambda uid, name, scope: _ROUTES.get(name), {"talk": {"turns"}, "notes": {"replies"}, "": set()})


def routed_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested graphs in stores of their own; a read over all stores says where rows lie."""
    return _routed(spark, sf_dir).read_all().groupBy("store", "aType", "axbType").agg(F.count("*").alias("n"))


_BASE = [("region", "is", "region"), ("nation", "is", "nation"), ("customer", "is", "customer"), ("supplier", "is", "supplier"), ("part", "is", "part"), ("order", "is", "orders"), ("event", "is", "events"), ("doc", "is", "documents"), ("item", "is", "embeddings")]
_BASE += [("nation", "inRegion", "nation"), ("customer", "inNation", "customer"), ("supplier", "inNation", "supplier"), ("customer", "placed", "orders"), ("user", "did", "events")]
QUERIES["routed_stores"] = routed_stores
ORACLE_SQL["routed_stores"] = " UNION ALL ".join(
    [f"SELECT '' AS store, '{a}' AS aType, '{x}' AS axbType, count(*) AS n FROM {t}" for a, x, t in _BASE]
    + [f"SELECT '{s}', '{a}', '{x}', count(*) FROM conversations" for s, a, x in (("talk", "turn", "is"), ("talk", "conversation", "hasTurn"), ("notes", "reply", "is"))]
)


def routed_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search over the graphs of all stores, by globs; order and limit hold for all together."""
    found = _routed(spark, sf_dir).find_edges_global(Find(axbType=NODE, where=[("aType", "in", ["turn", "reply"]), ("role", "==", "user")], order_by=("aUid", "desc"), limit=60), within=["**/replies", "turns"])
    return found.select("store", "scope", "aUid")


_TURN = "'turn-' || conv_id || '-' || turn"
QUERIES["routed_global"] = routed_global
ORACLE_SQL["routed_global"] = (
    f"WITH t AS (SELECT 'talk' AS store, 'conv-' || conv_id || '/turns' AS scope, {_TURN} AS aUid FROM conversations WHERE role = 'user'), a AS (FROM t UNION ALL SELECT 'notes', scope || '/' || aUid || '/replies', aUid FROM t) "
    "SELECT store, scope, aUid FROM (SELECT *, row_number() OVER (ORDER BY aUid DESC) AS r, count(*) OVER () AS n FROM a) WHERE r <= 60"
)


def routed_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by the name of the graphs reads only stores that can have such."""
    return _routed(spark, sf_dir).find_edges_global(Find(axbType=NODE, bType="reply", limit=0), "replies").select("store", "aUid")


QUERIES["routed_by_name"] = routed_by_name
ORACLE_SQL["routed_by_name"] = f"SELECT 'notes' AS store, {_TURN} AS aUid FROM conversations"


def routed_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node goes with the graphs under it in two other stores; each store tells what it did, and what is left is counted."""
    stores = _routed(spark, sf_dir)
    told = spark.createDataFrame([(o.store, o.rows, o.version, o.error) for o in stores.remove_node_cascade("conv-4")], "store string, dropped long, version int, error string")
    return told.join(stores.read_all().groupBy("store").agg(F.count("*").alias("left_rows")), "store", "left")


QUERIES["routed_cascade"] = routed_cascade
ORACLE_SQL["routed_cascade"] = (
    f"WITH n AS (SELECT count(*) AS n, count(*) FILTER (conv_id = 4) AS m FROM conversations), b AS (SELECT {' + '.join(f'(SELECT count(*) FROM {t})' for _, _, t in _BASE)} AS b) "
    "SELECT '' AS store, 0 AS dropped, 1 AS version, CAST(NULL AS VARCHAR) AS error, b AS left_rows FROM b UNION ALL SELECT 'notes', m, 2, NULL, n - m FROM n UNION ALL SELECT 'talk', 2 * m, 2, NULL, 2 * (n - m) FROM n"
)


def routed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of many scopes, each to the store of its scope as a commit of its own."""
    stores = _routed(spark, sf_dir)
    rows = stores.read_all().where("aType in ('turn', 'reply', 'region') and axbType = 'is'").drop("store")
    told = stores.apply_all(changes_of(rows, "update", data={"seen": True}), NOW)
    seen = stores.read_all().where(F.try_variant_get("data", "$.seen", "boolean")).groupBy("store", "aType").agg(F.count("*").alias("n"))
    return seen.join(spark.createDataFrame([(o.store, o.rows, o.version) for o in told], "store string, changes long, version int"), "store")


QUERIES["routed_changes"] = routed_changes
ORACLE_SQL["routed_changes"] = " UNION ALL ".join(f"SELECT '{s}' AS store, '{a}' AS aType, count(*) AS n, count(*) AS changes, 2 AS version FROM {t}" for s, a, t in (("", "region", "region"), ("talk", "turn", "conversations"), ("notes", "reply", "conversations")))


_LATER = Registry([Entry("nation", migrations=[(0, 1, "to_json(named_struct('label', lower(get_json_object(data, '$.name'))))"), (1, 2, "to_json(named_struct('label', concat(get_json_object(data, '$.label'), '!')))")])])


@query("SELECT 'nation-' || n_nationkey AS aUid, lower(n_name) || '!' AS label, 2 AS v, CASE WHEN n_nationkey < 10 THEN 2 END AS stored FROM nation")
def write_back_on_read(store: SnapshotStore) -> DataFrame:
    """A read brings old payloads up and writes back those that it found; a later read finds the others as they were."""
    first = [f"nation-{k}" for k in range(10)]
    found, version = store.read_migrated(_LATER, Find(aType="nation", axbType=NODE, where=[("aUid", "in", first)], limit=0))
    rest = Graph(store.read(version), registry=_LATER).find_edges(Find(aType="nation", axbType=NODE, where=[("aUid", "not-in", first)], limit=0))
    kept = store.graph(version=version).find_nodes("nation", limit=0).select("docId", F.col("v").alias("stored"))
    return found.unionByName(rest).join(kept, "docId").select("aUid", _text("label"), "v", "stored")


@query("SELECT 'customer-' || c_custkey AS aUid, CASE c_custkey WHEN 7 THEN 'seven' ELSE c_name END AS name, 1 AS rewritten, true AS others_kept FROM customer")
def put_one_partition(store: SnapshotStore) -> DataFrame:
    """A put of one row writes one partition; all others stay in the folder that they were in."""
    before = store.table.parts(store.version())
    version = store.apply(store.spark.createDataFrame([change("put", 0, ("customer", "customer-7"), data={"name": "seven"})], CHANGES), NOW)
    after = store.table.parts(version)
    changed = [part for part in after if after[part] != before.get(part)]
    return store.graph().find_nodes("customer", limit=0).select("aUid", _text("name"), F.lit(len(changed)).alias("rewritten"), F.lit(before.keys() == after.keys()).alias("others_kept"))


@query("SELECT 'nation-' || n_nationkey AS aUid, 'inRegion' AS axbType, 'region-' || n_regionkey AS bUid FROM nation UNION ALL SELECT 'nation-77', 'inRegion', 'region-1' UNION ALL SELECT 'nation-' || n_nationkey, 'is', 'nation-' || n_nationkey FROM nation UNION ALL SELECT 'nation-77', 'is', 'nation-77'")
def put_edge_with_node(store: SnapshotStore) -> DataFrame:
    """An edge and its new node in one version; with a node that is there, the edge alone."""
    version = store.put_edge_with_node((("nation", "nation-77"), "inRegion", ("region", "region-1")), NOW, {"name": "MU"}, new_side="a")
    assert version == 2
    return _rows(store, "nation").select("aUid", "axbType", "bUid")


_POINT = [1.0] + [0.0] * 63


def nearest_in_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance as a field of the payload."""
    near = find_nearest(Graph(star_branches(spark, sf_dir)), "embedding", _POINT, 20, "EUCLIDEAN", find=Find(aType="item", axbType=NODE), result_field="found.distance")
    return near.select("aUid", _number("found.distance"))


QUERIES["nearest_in_payload"] = nearest_in_payload
ORACLE_SQL["nearest_in_payload"] = (
    f"SELECT 'item-' || vec_id AS aUid, round(list_distance(embedding::DOUBLE[], {_POINT}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_POINT}::DOUBLE[]), 'item-' || vec_id LIMIT 20"
)


def collection_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the purchases among the events, newest first, after the first one."""
    purchases = Collection("purchases", "{table}.parquet", "event_type", "purchase", "ts", True, ("value", "event_id"))
    docs = spark.read.parquet(f"{sf_dir}/{purchases.located({'table': 'events'})}")
    first = docs.where("event_type = 'purchase'").agg(F.max_by("event_id", F.struct("ts", "event_id"))).first()[0]
    page = collection_page(docs, purchases, "event_id", (("value", ">", 10), ("props", "==", "not a field of filters"), ("value", "~", 3)), first, 50)
    return page.select("event_id", F.round("value", 6).alias("value"), "hasMore")


QUERIES["collection_docs"] = collection_docs
ORACLE_SQL["collection_docs"] = (
    "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT ts AS t, event_id AS i FROM p ORDER BY ts DESC, event_id DESC LIMIT 1), "
    "r AS (SELECT p.* FROM p, c WHERE value > 10 AND (ts < t OR (ts = t AND event_id < i)) ORDER BY ts DESC, event_id DESC LIMIT 51) "
    "SELECT event_id, round(value, 6) AS value, (SELECT count(*) > 50 FROM r) AS hasMore FROM r ORDER BY ts DESC, event_id DESC LIMIT 50"
)


_PURCHASES = Collection("purchases", "{table}", "event_type", "purchase", "ts", True, ("value", "event_id"))


def collection_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases beside the graph: dear ones marked, cheap ones dropped, copies of the marked ones made; each write on the version before."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("id", F.col("event_id").cast("string"))
    root = new_folder(spark, "plain")
    store = CollectionStore(spark, root, _PURCHASES, "id string, event_id long, event_type string, value double, props string", {"table": "events"})
    first = store.create(events.where("event_type = 'purchase'").select("id", "event_id", "value", "props"), 0)
    dear = store.read().where("value > 40").select("id", F.lit("dear").alias("props"))
    second = store.update(dear, first, expected=F.col("value") > 40)
    third = store.delete(store.read().where("value < 5").select("id"), second)
    store.create(store.read().where("props = 'dear'").select(F.concat(F.lit("copy-"), "id").alias("id"), "event_id", "value"), third)
    return store.read().select("id", "event_type", F.round("value", 6).alias("value"), "props")


QUERIES["collection_writes"] = collection_writes
ORACLE_SQL["collection_writes"] = (
    "WITH p AS (SELECT *, value > 40 AS dear FROM events WHERE event_type = 'purchase' AND (value >= 5 OR value IS NULL)) "
    "SELECT CAST(event_id AS VARCHAR) AS id, event_type, round(value, 6) AS value, CASE WHEN dear THEN 'dear' ELSE props END AS props FROM p UNION ALL SELECT 'copy-' || event_id, event_type, round(value, 6), NULL FROM p WHERE dear"
)
