"""Queries over the star schema as a graph, each with its SQL on the plain tables."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.model import doc_id_column, is_ancestor, type_uid_column
from graphloom.operators.browse import node_detail, nodes_batch, observed_fields, observed_types, page, summaries
from graphloom.operators.graph import Graph, Hop, after, search_everywhere
from graphloom.operators.registry import Entry, Registry
from graphloom.operators.search import find_nearest, full_text_search, geo_search, near, phrase, prefix, words
from graphloom.plans.planner import Find
from graphloom.sources.definitions import typed_payloads
from graphloom.sources.tables import line_triples, star_branches, star_triples
from graphloom.sources.wire import from_wire, to_wire
from graphloom.streaming.changes import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_VEC = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"


def query(name: str, sql: str, lines: bool = False):
    def keep(fn: Callable[[Graph], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Graph(star_triples(spark, sf_dir).unionByName(line_triples(spark, sf_dir)) if lines else star_branches(spark, sf_dir)))

        QUERIES[name] = run
        ORACLE_SQL[name] = sql
        return fn

    return keep


def _edge_id(a: str, x: str, b: str) -> str:
    key = f"{a} || ':{x}:' || {b}"
    return f"substr(sha256({key}), 1, 1) || ':' || {key}"


def _num(name: str, alias: str | None = None):
    return F.round(paths.typed(paths.data_path(name), "number"), 6).alias(alias or name)


def _str(name: str, alias: str | None = None):
    return paths.typed(paths.data_path(name), "string").alias(alias or name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers of one nation: two hops."""
    g = Graph(star_branches(spark, sf_dir))
    hops = [Hop("inNation", "reverse", aType="customer", limit=None), Hop("placed", limit=None)]
    return g.traverse(["nation-3"], hops, None).where("depth = 2").select("aUid", "bUid", _num("total"))


_NODE = "'customer-' || c_custkey"
_PLACED = _edge_id("'customer-' || o_custkey", "placed", "'order-' || o_orderkey")
_ORDERS = "'customer-' || o_custkey AS aUid, 'order-' || o_orderkey AS bUid"

query("get_node", f"SELECT {_NODE} AS docId, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey = 7")(lambda g: g.get_node("customer-7").select("docId", _str("name"), _num("acctbal")))
query("get_edge", "SELECT 'customer-' || c_custkey AS aUid, 'nation-' || c_nationkey AS bUid FROM customer WHERE c_custkey = 7 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)")(
    lambda g: g.get_edge("customer-7", "inNation", g.find_edges(Find(aUid="customer-7", axbType="inNation")).first()["bUid"]).select("aUid", "bUid")
)
query("edge_exists_semi", f"SELECT {_edge_id(_NODE, 'inNation', chr(39) + 'nation-5' + chr(39))} AS docId FROM customer WHERE c_nationkey = 5")(
    lambda g: g.existing(g.find_nodes("customer", limit=0).select(F.expr("concat('customer-', substring_index(aUid, '-', -1))").alias("aUid"), F.lit("inNation").alias("axbType"), F.lit("nation-5").alias("bUid")).select(doc_id_column().alias("docId")))
)
query("find_nodes_type", "SELECT 'nation-' || n_nationkey AS aUid, n_name AS name FROM nation")(lambda g: g.find_nodes("nation").select("aUid", _str("name")))
query("find_nodes_where_eq", f"SELECT {_NODE} AS aUid FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda g: g.find_nodes("customer", [("segment", "==", "BUILDING")], limit=0).select("aUid"))
query("find_nodes_where_range", f"SELECT {_NODE} AS aUid, c_acctbal AS acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000")(
    lambda g: g.find_nodes("customer", [("acctbal", ">=", 1000), ("data.acctbal", "<", 5000)], limit=0).select("aUid", _num("acctbal"))
)
query("find_nodes_wrong_type", "SELECT 'x' AS aUid WHERE false")(lambda g: g.find_nodes("customer", [("acctbal", "==", "1000")], limit=0).select("aUid"))
query("find_nodes_ne", f"SELECT {_NODE} AS aUid FROM customer WHERE c_mktsegment <> 'BUILDING'")(lambda g: g.find_nodes("customer", [("segment", "!=", "BUILDING")], limit=0).select("aUid"))
query("find_nodes_bool", f"SELECT {_NODE} AS aUid FROM customer WHERE c_acctbal < 0")(lambda g: g.find_nodes("customer", [("active", "==", False)], limit=0).select("aUid"))
query("find_nodes_null", f"SELECT {_NODE} AS aUid, 'is' AS axbType FROM customer WHERE c_acctbal < 0")(
    lambda g: g.find_nodes("customer", [("segment", "==", None)], limit=0).unionByName(g.find_nodes("customer", [("missing", "!=", None), ("acctbal", "<", 0)], limit=0)).unionByName(g.find_nodes("customer", [("active", "in", [None, False])], limit=0)).select("aUid", "axbType")
)
query("find_nodes_in", f"SELECT {_NODE} AS aUid FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")(lambda g: g.find_nodes("customer", [("segment", "in", ["BUILDING", "MACHINERY", 5])], limit=0).select("aUid"))
query("find_nodes_not_in", f"SELECT {_NODE} AS aUid FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")(lambda g: g.find_nodes("customer", [("segment", "not-in", ["BUILDING", "MACHINERY"])], limit=0).select("aUid"))
query("array_contains", "SELECT 'part-' || p_partkey AS aUid FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT min(string_split(p_name, ' ')[1]) FROM part))")(
    lambda g: g.find_nodes("part", [("tags", "array-contains", g.find_nodes("part", limit=0).agg(F.min(F.split_part(paths.typed("$.name", "string"), F.lit(" "), F.lit(1)))).first()[0])], limit=0).select("aUid")
)
query("array_contains_any", "SELECT 'part-' || p_partkey AS aUid FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue', 'part'])")(lambda g: g.find_nodes("part", [("tags", "array-contains-any", ["red", "blue", "part"])], limit=0).select("aUid"))
query("find_edges_forward", f"SELECT {_ORDERS}, o_totalprice AS total FROM orders WHERE o_custkey = 11")(lambda g: g.find_edges(Find(aUid="customer-11", axbType="placed")).select("aUid", "bUid", _num("total")))
query("find_edges_reverse", f"SELECT {_NODE} AS aUid FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier-' || s_suppkey FROM supplier WHERE s_nationkey = 3")(
    lambda g: g.find_edges(Find(axbType="inNation", bUid="nation-3", limit=0)).select("aUid")
)
query("find_edges_type_scoped", "SELECT 'supplier-' || s_suppkey AS aUid, 'nation-' || s_nationkey AS bUid FROM supplier")(lambda g: g.find_edges(Find(aType="supplier", axbType="inNation", limit=0)).select("aUid", "bUid"))
query("find_edges_default_limit", f"SELECT {_PLACED} AS docId FROM orders ORDER BY docId LIMIT 500")(lambda g: g.find_edges(Find(aType="customer", axbType="placed")).select("docId"))
query("find_edges_order_limit", f"SELECT {_ORDERS}, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, {_PLACED} LIMIT 25")(
    lambda g: g.find_edges(Find(aType="customer", axbType="placed", order_by=("data.total", "desc"), limit=25)).select("aUid", "bUid", _num("total"))
)
query("edge_doc_ids", f"SELECT {_PLACED} AS docId FROM orders WHERE o_totalprice > 100000")(lambda g: g.find_edges(Find(axbType="placed", bType="order", where=[("total", ">", 100000)], limit=0)).select("docId"))
query("projection", "SELECT 'order-' || o_orderkey AS aUid, o_orderstatus AS status, o_totalprice AS \"data.total\", CAST(NULL AS VARCHAR) AS missing FROM orders")(
    lambda g: g.find_edges_projected(Find(aType="order", axbType="is", limit=0), ["aUid", "status", "data.total", "missing", "status"], {"status": "string", "data.total": "number", "missing": "string"})
)
_AGG = "count(*) AS n, round(coalesce(sum({0}), 0), 2) AS total, round(coalesce(avg({0}), 'NaN'::DOUBLE), 4) AS mean, coalesce(min({0}), 0) AS low, coalesce(max({0}), 0) AS high"
_SPEC = {"n": ("count",), "total": ("sum", "data.total"), "mean": ("avg", "data.total"), "low": ("min", "data.total"), "high": ("max", "data.total")}
_rounded = lambda df: df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})
query("aggregate_all", f"SELECT {_AGG.format('o_totalprice')} FROM orders")(lambda g: _rounded(g.aggregate(_SPEC, Find(aType="customer", axbType="placed"))))
query("aggregate_filtered", f"SELECT {_AGG.format('o_totalprice')} FROM orders WHERE o_totalprice >= 150000")(lambda g: _rounded(g.aggregate(_SPEC, Find(aType="customer", axbType="placed", where=[("total", ">=", 150000)]))))
query("aggregate_empty", "SELECT 0::BIGINT AS n, 0::DOUBLE AS total, 'NaN'::DOUBLE AS mean, 0::DOUBLE AS low, 0::DOUBLE AS high")(
    lambda g: _rounded(g.aggregate(_SPEC, Find(aType="customer", axbType="placed", where=[("total", "<", -1)])))
)
query("aggregate_grouped", f"SELECT o_orderstatus AS status, {_AGG.format('o_totalprice')} FROM orders GROUP BY o_orderstatus")(lambda g: _rounded(g.aggregate(_SPEC, Find(aType="order", axbType="is"), group_by=["status"])))
query("expand_forward", f"SELECT {_ORDERS} FROM orders WHERE o_custkey IN (1, 2, 4, 7)")(lambda g: g.expand([f"customer-{i}" for i in (1, 2, 4, 7)], "placed").select("aUid", "bUid"))
query("expand_reverse_table", "SELECT 'customer-' || c_custkey AS aUid, 'nation-' || c_nationkey AS bUid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")(
    lambda g: g.expand(g.find_edges(Find(axbType="inRegion", bUid="region-1")).select("aUid"), "inNation", "reverse", a_type="customer").select("aUid", "bUid")
)
query("expand_soft_cap", f"SELECT {_ORDERS} FROM orders WHERE o_custkey IN (1, 2, 4) ORDER BY o_totalprice, {_PLACED} LIMIT 6")(
    lambda g: g.expand(["customer-1", "customer-2", "customer-4"], "placed", limit_per_source=2, order_by=("data.total", "asc")).select("aUid", "bUid")
)
query("expand_strict_cap", f"SELECT {_ORDERS} FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, {_PLACED}) <= 2")(
    lambda g: g.expand(g.find_nodes("customer", limit=0).select("aUid"), "placed", limit_per_source=2, order_by=("data.total", "desc"), strict=True).select("aUid", "bUid")
)
query("expand_hydrated", f"SELECT {_ORDERS}, o_orderstatus AS status FROM orders WHERE o_custkey BETWEEN 1 AND 20")(
    lambda g: g.expand([f"customer-{i}" for i in range(1, 21)], "placed", hydrate=True).select("aUid", "bUid", F.try_variant_get("target.data", "$.status", "string").alias("status"))
)
QUERIES["traverse_two_hops"] = flagship
ORACLE_SQL["traverse_two_hops"] = f"SELECT {_ORDERS}, round(o_totalprice, 6) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3"
query("traverse_limited", f"""
WITH e1 AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY {_edge_id(_NODE, 'inNation', chr(39) + 'nation-3' + chr(39))} LIMIT 4),
e2 AS (SELECT {_ORDERS}, o_totalprice FROM orders WHERE o_custkey IN (FROM e1) AND o_totalprice > 50000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, {_PLACED}) <= 3)
SELECT aUid, bUid, 2 AS depth FROM e2 UNION ALL SELECT 'customer-' || c_custkey, 'nation-3', 1 FROM e1""")(
    lambda g: g.traverse(["nation-3"], [Hop("inNation", "reverse", aType="customer", limit=4), Hop("placed", where=(("total", ">", 50000),), order_by=("data.total", "desc"), limit=3)], None).select("aUid", "bUid", "depth")
)
query("traverse_three_hops", "SELECT DISTINCT 'region-' || n_regionkey AS bUid, 3 AS depth FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey IN (1, 2, 3, 4, 5, 6, 7)")(
    lambda g: g.traverse([f"order-{i}" for i in range(1, 8)], [Hop("placed", "reverse", limit=None), Hop("inNation", limit=None), Hop("inRegion", limit=None)], None).where("depth = 3").select("bUid", "depth").distinct()
)
query("traverse_cross_graph", "SELECT 'conv-' || conv_id AS aUid, 'turn-' || conv_id || '-' || turn AS bUid, 'conv-' || conv_id || '/turns' AS scope FROM conversations WHERE conv_id IN (1, 2, 3)")(
    lambda g: g.traverse(["conv-1", "conv-2", "conv-3"], [Hop("hasTurn", target_graph="turns", limit=None)]).select("aUid", "bUid", "scope")
)
query("engine_traversal", f"WITH e AS (SELECT {_ORDERS}, {_PLACED} AS docId, o_custkey FROM orders WHERE o_custkey IN (1, 2, 4) ORDER BY docId LIMIT 9) SELECT aUid, bUid FROM e")(
    lambda g: g.run_engine_traversal(["customer-1", "customer-2", "customer-4"], [Hop("placed", limit=3)]).select("aUid", "bUid")
)
query("subgraph_nodes", "SELECT 'turn-' || conv_id || '-' || turn AS aUid, role FROM conversations WHERE conv_id = 4")(lambda g: g.subgraph("conv-4", "turns").find_nodes("turn").select("aUid", _str("role")))
query("find_edges_global", "SELECT 'turn-' || conv_id || '-' || turn AS bUid FROM conversations WHERE turn >= 3")(
    lambda g: g.find_edges_global(Find(aType="conversation", axbType="hasTurn", where=[("turn", ">=", 3)], limit=0), "turns").select("bUid")
)
query("scope_ancestors", "SELECT 'turn-' || conv_id || '-' || turn AS bUid FROM conversations WHERE conv_id = 2")(lambda g: g.candidates([("axbType", "==", "hasTurn")], everywhere=True).where("axbType = 'hasTurn'").where(is_ancestor(F.col("scope"), F.lit("conv-2"))).select("bUid"))
for _m, _f, _way in (("EUCLIDEAN", "list_distance", "ASC"), ("COSINE", "list_cosine_distance", "ASC"), ("DOT_PRODUCT", "list_inner_product", "DESC")):
    query(f"nearest_{_m.lower()}", f"SELECT 'item-' || vec_id AS aUid, round({_f}(embedding::DOUBLE[], {_VEC}), 6) AS distance FROM embeddings ORDER BY {_f}(embedding::DOUBLE[], {_VEC}) {_way}, 'item-' || vec_id LIMIT 20")(
        lambda g, m=_m: find_nearest(g, "embedding", VECTOR, 20, m, find=Find(aType="item", axbType="is")).select("aUid", F.round("distance", 6).alias("distance"))
    )
query("nearest_threshold", f"SELECT 'item-' || vec_id AS aUid FROM embeddings WHERE label = 1 AND list_cosine_distance(embedding::DOUBLE[], {_VEC}) <= 1.0")(
    lambda g: find_nearest(g, "embedding", VECTOR, None, "COSINE", 1.0, Find(aType="item", axbType="is", where=[("label", "==", 1)])).select("aUid")
)
_LAT, _LNG = "(((c_custkey * 37) % 1800) / 10 - 90)", "(((c_custkey * 91) % 3600) / 10 - 180)"
_HAV = f"2 * 6371008.8 * asin(sqrt(pow(sin(radians({_LAT} - 10) / 2), 2) + cos(radians(10)) * cos(radians({_LAT})) * pow(sin(radians({_LNG} - 20) / 2), 2)))"
query("geo_search", f"SELECT {_NODE} AS aUid, round({_HAV}, 3) AS distance FROM customer WHERE {_HAV} <= 3000000 ORDER BY {_HAV}, {_NODE} LIMIT 30")(
    lambda g: geo_search(g, "lat", "lng", 10, 20, 3_000_000, 30, find=Find(aType="customer", axbType="is")).select("aUid", F.round("distance", 3).alias("distance"))
)


def _bm25(terms: list[str], match: str, limit: int) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN (docs - d{i} + 0.5) / (d{i} + 0.5) > 1 THEN ln((docs - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END"
    score = " ".join(f"- {idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / a))" for i in range(len(terms)))
    others = " + ".join(f"(SELECT count(*) FROM {t})" for t in ("region", "nation", "customer", "supplier", "part", "orders", "events", "embeddings", "nation", "customer", "supplier", "orders", "events"))
    return f"""
WITH d AS (SELECT 'doc-' || doc_id AS docId, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT docId, len(t) AS n, {tf} FROM d),
s AS (SELECT count(*) + {others} AS docs, sum(n) / (count(*) + {others}) AS a, {df} FROM c)
SELECT docId, round(0 {score}, 6) AS score FROM c, s WHERE {match} ORDER BY 0 {score}, docId LIMIT {limit}"""


query("full_text_and", _bm25(["license", "version"], "f0 > 0 AND f1 > 0", 25))(lambda g: full_text_search(g, "license version", 25, ["text"]).select("docId", F.round("score", 6).alias("score")))
query("full_text_or_not", _bm25(["license", "mit", "gnu"], "(f0 > 0 OR f1 > 0) AND NOT f2 > 0", 40))(lambda g: full_text_search(g, (words("license") | words("MIT")) & ~words("gnu"), 40, ["text"]).select("docId", F.round("score", 6).alias("score")))
query("page_after", f"SELECT 'order-' || o_orderkey AS docId, o_totalprice AS total FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice, 'order-' || o_orderkey LIMIT 26")(
    lambda g: after(g.find_nodes("order", limit=0).withColumn("total", paths.typed("$.total", "number")), F.col("total"), (100000.0, ""), 25).select("docId", "total")
)
query("search_everywhere", "SELECT docId, matchType FROM (SELECT 'nation-3' AS docId, 'docId' AS matchType, 0 AS m UNION ALL SELECT " + _edge_id("'nation-3'", "inRegion", "'region-' || n_regionkey") + ", 'aUid', 1 FROM nation WHERE n_nationkey = 3 UNION ALL SELECT " + _edge_id(_NODE, "inNation", "'nation-3'") + ", 'bUid', 2 FROM customer WHERE c_nationkey = 3 UNION ALL SELECT " + _edge_id("'supplier-' || s_suppkey", "inNation", "'nation-3'") + ", 'bUid', 2 FROM supplier WHERE s_nationkey = 3) ORDER BY m, docId LIMIT 50")(
    lambda g: search_everywhere(g, "nation:nation-3", 50).select("docId", "matchType")
)
_KINDS = [(kind, "is", kind, table) for kind, table in (("region",) * 2, ("nation",) * 2, ("customer",) * 2, ("supplier",) * 2, ("part",) * 2, ("order", "orders"), ("event", "events"), ("doc", "documents"), ("item", "embeddings"))]
_KINDS += [("nation", "inRegion", "region", "nation"), ("customer", "inNation", "nation", "customer"), ("supplier", "inNation", "nation", "supplier"), ("customer", "placed", "order", "orders"), ("user", "did", "event", "events")]
_COUNTED = " UNION ALL ".join(f"SELECT '{a}' AS aType, '{x}' AS axbType, '{b}' AS bType, count(*) AS n FROM {t}" for a, x, b, t in _KINDS)
query("observed_schema", _COUNTED + " UNION ALL SELECT 'turn', 'is', 'turn', count(*) FROM conversations UNION ALL SELECT 'conversation', 'hasTurn', 'turn', count(*) FROM conversations")(
    lambda g: g.everything.groupBy("aType", "axbType", "bType").agg(F.count("*").alias("n"))
)
query("type_uids", "SELECT r_name AS name, substr(translate(to_base64(unhex(sha256('nodeType:' || r_name))), '+/', '-_'), 1, 21) AS uid FROM region")(
    lambda g: g.find_nodes("region").select(_str("name")).select("name", type_uid_column(F.lit("nodeType"), F.col("name")).alias("uid"))
)

_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem)"
_LINE = "'line-' || l_orderkey || '-' || n"
query("order_lines", f"SELECT 'order-' || l_orderkey AS aUid, {_LINE} AS bUid, n FROM {_LINES}", lines=True)(
    lambda g: g.expand(g.find_nodes("order", limit=0).select("aUid"), "hasLine").select("aUid", "bUid", F.try_variant_get("data", "$.n", "long").alias("n"))
)
query("traverse_order_parts", f"SELECT {_LINE} AS aUid, 'part-' || l_partkey AS bUid, 2 AS depth FROM {_LINES} WHERE l_orderkey IN (1, 2, 3, 4, 5) UNION ALL SELECT 'order-' || l_orderkey, {_LINE}, 1 FROM {_LINES} WHERE l_orderkey IN (1, 2, 3, 4, 5)", lines=True)(
    lambda g: g.traverse([f"order-{i}" for i in range(1, 6)], [Hop("hasLine", limit=None), Hop("ofPart", limit=None)], None).select("aUid", "bUid", "depth")
)
query("aggregate_lines", "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL", lines=True)(
    lambda g: g.aggregate({"n": ("count",), "quantity": ("sum", "data.quantity"), "discount": ("avg", "data.discount")}, Find(aType="lineitem", axbType="is"), group_by=["returnflag", "linestatus"]).withColumns({"quantity": F.round("quantity", 2), "discount": F.round("discount", 6)})
)
query("traverse_keep_condition", "SELECT 'order-' || o_orderkey AS bUid FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND c_custkey % 3 = 0 AND o_orderkey % 2 = 1")(
    lambda g: g.traverse(["nation-7"], [Hop("inNation", "reverse", aType="customer", limit=None, keep=F.expr("cast(substr(aUid, 10) as long) % 3 = 0")), Hop("placed", limit=None, keep=F.expr("cast(substr(bUid, 7) as long) % 2 = 1"))], None).where("depth = 2").select("bUid")
)
query("traversal_report", """
WITH s AS (SELECT 'customer-' || c_custkey AS u, c_custkey FROM customer WHERE c_nationkey = 3), r AS (FROM s ORDER BY sha256(u || ':inNation:nation-3')[1], u || ':inNation:nation-3' LIMIT 6)
SELECT 1 AS depth, 'inNation' AS axbType, 1 AS sources, 1 AS reads, count(*) AS edges, count(DISTINCT u) AS targets, false AS truncated FROM s
UNION ALL SELECT 2, 'placed', (SELECT count(*) FROM s), (SELECT count(*) FROM r), count(*), count(DISTINCT o_orderkey), (SELECT count(*) FROM s) > 6 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM r)""")(
    lambda g: g.traversal_report(["nation-3"], [Hop("inNation", "reverse", aType="customer", limit=None), Hop("placed", limit=None)], max_reads=7)
)
_REGISTRY = Registry([Entry("conversation", "hasTurn", "turn", target_graph="turns"), Entry("region", migrations=[(0, 1, "to_json(named_struct('label', lower(get_json_object(data, '$.name'))))")])])
query("traverse_registry_graph", "SELECT 'turn-' || conv_id || '-' || turn AS bUid FROM conversations WHERE conv_id IN (5, 6)")(
    lambda g: Graph(g.table, registry=_REGISTRY).traverse(["conv-5", "conv-6"], [Hop("hasTurn", limit=None)]).select("bUid")
)
query("migrate_on_read", "SELECT 'region-' || r_regionkey AS aUid, lower(r_name) AS label, 1 AS v FROM region")(lambda g: Graph(g.table, registry=_REGISTRY).find_nodes("region").select("aUid", _str("label"), "v"))
_PART = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "size": {"type": "integer", "maximum": 40}, "price": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}}}
query("audit_schema", "SELECT 'part-' || p_partkey AS docId, 'VALIDATION_ERROR: /size: breaks maximum 40' AS violation FROM part WHERE p_size > 40")(
    lambda g: Registry([Entry("part", json_schema=_PART)]).audit(g.find_nodes("part", limit=0)).select("docId", "violation")
)


def _audited(name: str, kind: str, schema: dict, table: str, key: str, told: list[tuple[str, str]]) -> None:
    """An audit of one kind by a schema; told has the violations in order, each with what breaks the rule."""
    said = ", ".join(f"CASE WHEN {when} THEN '{what}' END" for what, when in told)
    sql = f"SELECT docId, 'VALIDATION_ERROR: ' || array_to_string(v, '; ') AS violation FROM (SELECT '{kind}-' || {key} AS docId, list_filter([{said}], lambda x: x IS NOT NULL) AS v FROM {table}) WHERE len(v) > 0"
    query(name, sql)(lambda g: Registry([Entry(kind, json_schema=schema)]).audit(g.find_nodes(kind, limit=0)).select("docId", "violation"))


_TAG = "string_split(p_name, ' ')"
_audited("audit_contains", "part", {"properties": {"tags": {"maxItems": 2, "contains": {"pattern": "[aeiou]$"}}}}, "part", "p_partkey", [("/tags: has a size out of bounds", f"len({_TAG}) > 2"), ("/tags: contains too few or too many", f"len(list_filter({_TAG}, lambda x: regexp_matches(x, '[aeiou]$'))) = 0")])
_audited("audit_items", "part", {"properties": {"tags": {"prefixItems": [{"maxLength": 4}], "items": {"pattern": "^[a-p0-9]"}, "uniqueItems": True}}}, "part", "p_partkey", [
    ("/tags/0: has a size out of bounds", f"length({_TAG}[1]) > 4"), ("/tags/1: must match ^[a-p0-9]", f"len({_TAG}) > 1 AND NOT regexp_matches({_TAG}[2], '^[a-p0-9]')"), ("/tags/2: must match ^[a-p0-9]", f"len({_TAG}) > 2 AND NOT regexp_matches({_TAG}[3], '^[a-p0-9]')"),
    ("/tags/3: must match ^[a-p0-9]", f"len({_TAG}) > 3 AND NOT regexp_matches({_TAG}[4], '^[a-p0-9]')"), ("/tags/4: must match ^[a-p0-9]", f"len({_TAG}) > 4 AND NOT regexp_matches({_TAG}[5], '^[a-p0-9]')"), ("/tags: repeats an item", f"len(list_distinct({_TAG})) < len({_TAG})"),
])
_audited("audit_conditional", "customer", {"if": {"properties": {"segment": {"const": "BUILDING"}}}, "then": {"properties": {"acctbal": {"minimum": 0}}}, "else": {"properties": {"acctbal": {"exclusiveMaximum": 5000}}}}, "customer", "c_custkey", [
    ("/acctbal: breaks minimum 0", "c_mktsegment = 'BUILDING' AND c_acctbal < 0"), ("/acctbal: breaks exclusiveMaximum 5000", "c_mktsegment <> 'BUILDING' AND c_acctbal >= 5000"),
])
_audited("audit_references", "supplier", {"properties": {"name": {"$ref": "#/$defs/label"}, "acctbal": {"$ref": "#sum"}}, "$defs": {"label": {"type": "string", "pattern": "[02468]$"}, "x": {"$anchor": "sum", "type": "number", "minimum": 100}}}, "supplier", "s_suppkey", [
    ("/name: must match [02468]$", "NOT regexp_matches(s_name, '[02468]$')"), ("/acctbal: breaks minimum 100", "s_acctbal < 100"),
])
_audited("audit_patterns", "part", {"patternProperties": {"^pri": {"maximum": 1000}, "^size$": {"multipleOf": 2}}, "additionalProperties": {"type": ["string", "array"]}, "propertyNames": {"maxLength": 5}}, "part", "p_partkey", [("/price: breaks maximum 1000", "p_retailprice > 1000"), ("/size: breaks multipleOf 2", "p_size % 2 <> 0")])
_audited("audit_formats", "order", {"properties": {"priority": {"format": "hostname"}, "status": {"enum": ["O", "F"]}}}, "orders", "o_orderkey", [("/priority: must be of format hostname", "NOT regexp_full_match(o_orderpriority, '[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?')"), ("/status: must be one of the listed values", "o_orderstatus NOT IN ('O', 'F')")])
_audited("audit_combined", "customer", {"anyOf": [{"properties": {"acctbal": {"minimum": 1000}}}, {"properties": {"segment": {"const": "MACHINERY"}}}], "oneOf": [{"properties": {"active": {"const": True}}}, {"properties": {"acctbal": {"maximum": 3000}}}], "not": {"properties": {"segment": {"enum": ["BUILDING"]}}}}, "customer", "c_custkey", [
    ("/: fits none of anyOf", "c_acctbal < 1000 AND c_mktsegment <> 'MACHINERY'"), ("/: must fit one of oneOf", "(c_acctbal >= 0) = (c_acctbal <= 3000)"), ("/: fits what it must not", "c_mktsegment = 'BUILDING'"),
])


def _replies(g: Graph) -> Graph:
    """The turns, and under each of them a graph of replies with one node."""
    turns = g.candidates([("aType", "==", "turn"), ("axbType", "==", "is")], everywhere=True).where("aType = 'turn'")
    inner = turns.withColumns({"scope": F.concat_ws("/", "scope", "aUid", F.lit("replies")), "aType": F.lit("reply"), "bType": F.lit("reply")})
    return Graph(turns.unionByName(inner))


_REPLY = "'conv-' || conv_id || '/turns/turn-' || conv_id || '-' || turn || '/replies' AS scope, 'turn-' || conv_id || '-' || turn AS aUid"
query("global_by_globs", f"SELECT {_REPLY} FROM conversations WHERE role = 'user'")(
    lambda g: _replies(g).find_edges_global(Find(axbType="is", bType="reply", where=[("role", "==", "user")], limit=0), within=["turns/*", "root"]).select("scope", "aUid")
)
query("audit_scopes", f"SELECT {_REPLY}, 'REGISTRY_SCOPE: reply is reply isn''t allowed in turns/replies' AS violation FROM conversations")(
    lambda g: Registry([Entry("turn", allowed_in=["**"]), Entry("reply", allowed_in=["root", "replies", "turns/replies/**/*"])]).audit(_replies(g).table).select("scope", "aUid", "violation")
)
query("migrate_bound", "SELECT 'nation-' || n_nationkey AS aUid, 'the data of data' AS kind, n_name AS name, 2 AS v FROM nation")(
    lambda g: Registry([Entry("nation", migrations=[(0, 1, "to_json(named_struct('kind', 'the data of data', 'name', get_json_object(data, '$.name')))"), (1, 2, "to_json(map_concat(from_json(data, 'map<string,string>'), map('more', 'data')))")])]).migrated(g.find_nodes("nation")).where(F.try_variant_get("data", "$.more", "string") == "data").select("aUid", _str("kind"), _str("name"), "v")
)
query("typed_payloads", "SELECT 'part-' || p_partkey AS docId, p_name AS name, p_size::BIGINT AS size, p_retailprice AS price, len(string_split(p_name, ' ')) AS n_tags FROM part")(
    lambda g: typed_payloads(g, Entry("part", json_schema=_PART)).select("docId", "name", "size", "price", F.size("tags").alias("n_tags"))
)
query("node_detail", f"SELECT 'customer-7' AS docId, 'node' AS side UNION ALL SELECT {_PLACED}, 'out' FROM orders WHERE o_custkey = 7 UNION ALL SELECT {_edge_id(_NODE, 'inNation', chr(39) + 'nation-' + chr(39) + ' || c_nationkey')}, 'out' FROM customer WHERE c_custkey = 7")(
    lambda g: node_detail(g, "customer-7").select("docId", "side")
)
query("nodes_batch", "SELECT 'part-' || k AS uid, p_name AS name FROM (VALUES (1), (5), (-4)) t(k) LEFT JOIN part ON p_partkey = k")(
    lambda g: nodes_batch(g, ["part-1", "part-5", "part--4", "part-1"]).select("uid", F.try_variant_get("node.data", "$.name", "string").alias("name"))
)
query("page_edges", f"SELECT {_PLACED} AS docId, round(o_totalprice, 6) AS total, true AS hasMore FROM orders WHERE o_totalprice < 200000 ORDER BY o_totalprice DESC, 1 LIMIT 25")(
    lambda g: page(g, Find(axbType="placed"), "data.total", True, (200000.0, ""), 25).select("docId", _num("total"), "hasMore")
)
query("page_offset", "SELECT 'part-' || p_partkey AS aUid FROM part ORDER BY p_retailprice, 'part-' || p_partkey LIMIT 10 OFFSET 20")(
    lambda g: g.find_nodes("part", limit=0).orderBy(*Graph.order(("data.price", "asc"))).offset(20).limit(10).select("aUid")
)
query("summaries", "SELECT 'nation-' || n_nationkey AS \"from\", 'inRegion' AS relation, 'region-' || n_regionkey AS \"to\", 'nation' AS fromType, 'region' AS toType, CAST(NULL AS VARCHAR) AS data, '2024-01-01T00:00:00.000Z' AS createdAt FROM nation")(
    lambda g: summaries(g.find_edges(Find(axbType="inRegion", bType="region"))).drop("updatedAt")
)
query("observed_types", _COUNTED)(observed_types)
_FIELDS = {
    ("region", "is", "region", "region"): "name STRING",
    ("nation", "is", "nation", "nation"): "name STRING",
    ("customer", "is", "customer", "customer"): "name STRING, acctbal DOUBLE, segment STRING, lat DOUBLE, lng DOUBLE, active BOOLEAN",
    ("supplier", "is", "supplier", "supplier"): "name STRING, acctbal DOUBLE",
    ("part", "is", "part", "part"): "name STRING, brand STRING, type STRING, size BIGINT, price DOUBLE, tags ARRAY<STRING>",
    ("order", "is", "order", "orders"): "status STRING, total DOUBLE, priority STRING",
    ("event", "is", "event", "events"): "type STRING, value DOUBLE",
    ("doc", "is", "doc", "documents"): "text STRING, lang STRING, source STRING, chars BIGINT",
    ("item", "is", "item", "embeddings"): "embedding ARRAY<DOUBLE>, label BIGINT",
    ("customer", "placed", "order", "orders"): "total DOUBLE",
    ("user", "did", "event", "events"): "type STRING, value DOUBLE",
}
query("observed_fields", " UNION ALL ".join(f"SELECT '{a}' AS aType, '{x}' AS axbType, '{b}' AS bType, '{f.split()[0]}' AS field, count(*) AS n, '{f.split()[1]}' AS type FROM {t}" for (a, x, b, t), fs in _FIELDS.items() for f in fs.split(", ")))(
    observed_fields
)
query("wire_round_trip", "SELECT 'supplier-' || s_suppkey AS docId, s_name AS name, s_acctbal AS acctbal, TIMESTAMP '2024-01-01 00:00:00' AS createdAt FROM supplier")(
    lambda g: from_wire(to_wire(g.find_nodes("supplier", limit=0))).select("docId", _str("name"), _num("acctbal"), "createdAt")
)
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')".replace("{{", "{").replace("}}", "}")
_WORDED = lambda said: _TOKENS.replace("{}", said, 1)
_SAID = {
    "'region-' || r_regionkey": ("r_name", "region"),
    "'nation-' || n_nationkey": ("n_name", "nation"),
    _NODE: ("concat_ws(' ', c_name, c_mktsegment)", "customer"),
    "'supplier-' || s_suppkey": ("s_name", "supplier"),
    "'part-' || p_partkey": ("concat_ws(' ', p_name, p_brand, p_type)", "part"),
    "'order-' || o_orderkey": ("concat_ws(' ', o_orderstatus, o_orderpriority)", "orders"),
    "'event-' || event_id": ("event_type", "events"),
    _edge_id("'user-' || user_id", "did", "'event-' || event_id"): ("event_type", "events"),
    "'doc-' || doc_id": ("concat_ws(' ', text, lang, source)", "documents"),
}
query("full_text_all_fields", " UNION ALL ".join(f"SELECT {key} AS docId FROM {t} WHERE list_has_any({_WORDED(said)}, ['purchase', 'machinery', 'asia'])" for key, (said, t) in _SAID.items()))(
    lambda g: full_text_search(g, words("purchase") | words("machinery") | words("ASIA"), 1 << 30).select("docId")
)
_DOCS = f"WITH d AS (SELECT 'doc-' || doc_id AS docId, {_WORDED('text')} AS t FROM documents) "
query("full_text_phrase", _DOCS + "SELECT docId FROM d WHERE len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'general' AND t[i + 1] = 'public' AND t[i + 2] = 'license')) > 0")(
    lambda g: full_text_search(g, phrase("General Public License"), 1 << 30, ["text"]).select("docId")
)
query("full_text_prefix", _DOCS + "SELECT docId FROM d WHERE len(list_filter(t, lambda x: starts_with(x, 'licen'))) > 0 AND NOT list_contains(t, 'apache')")(
    lambda g: full_text_search(g, prefix("licen") & ~words("apache"), 1 << 30, ["text"]).select("docId")
)
query("full_text_near", _DOCS + """, p AS (SELECT docId, list_filter(range(1, len(t)), lambda i: t[i] = 'public' AND t[i + 1] = 'license') AS a, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'version') AS b FROM d)
SELECT docId FROM p WHERE len(list_filter(a, lambda i: len(list_filter(b, lambda j: greatest(i, j) - i - 2 <= 6 AND greatest(i, j) - j - 1 <= 6)) > 0)) > 0""")(
    lambda g: full_text_search(g, near("Public License", "version", within=6), 1 << 30, ["text"]).select("docId")
)
query("engine_two_hops", f"""
WITH e1 AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY {_edge_id(_NODE, 'inNation', chr(39) + 'nation-3' + chr(39))} LIMIT 6)
SELECT {_ORDERS}, 2 AS depth FROM orders WHERE o_custkey IN (FROM e1) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_PLACED}) <= 2 UNION ALL SELECT 'customer-' || c_custkey, 'nation-3', 1 FROM e1""")(
    lambda g: g.run_engine_traversal(["nation-3"], [Hop("inNation", "reverse", aType="customer", limit=6), Hop("placed", limit=2)], max_reads=12).select("aUid", "bUid", "depth")
)
query("self_loops_skipped", f"SELECT 'region-' || n_regionkey AS bUid FROM nation WHERE n_regionkey < 3")(
    lambda g: Graph(g.find_nodes("region", limit=0).unionByName(g.find_edges(Find(axbType="inRegion", aType="nation", limit=0)).withColumn("axbType", F.lit("is")))).expand(g.find_edges(Find(axbType="inRegion", bType="region", where=[("bUid", "in", ["region-0", "region-1", "region-2"])], limit=0)).select("bUid"), "is", "reverse").select("bUid")
)
query("aggregate_other_types", "SELECT count(*) AS n, 0::DOUBLE AS total, 'NaN'::DOUBLE AS mean, 0::DOUBLE AS low FROM customer")(
    lambda g: g.aggregate({"n": ("count",), "total": ("sum", "data.name"), "mean": ("avg", "data.segment"), "low": ("min", "data.active")}, Find(aType="customer", axbType="is"))
)
query("page_nodes", "SELECT 'part-' || p_partkey AS docId, 'part-' || p_partkey AS \"sortKey\", (SELECT count(*) FROM part WHERE 'part-' || p_partkey > 'part-1') > 30 AS hasMore FROM part WHERE 'part-' || p_partkey > 'part-1' ORDER BY 1 LIMIT 30")(
    lambda g: page(g, Find(aType="part"), cursor=("part-1", "part-1"), limit=30, edges=False).select("docId", "sortKey", "hasMore")
)
query("geo_filtered", f"SELECT {_NODE} AS aUid FROM customer WHERE {_HAV} <= 3000000 AND c_mktsegment = 'BUILDING' AND c_acctbal > 0")(
    lambda g: geo_search(g, "lat", "lng", 10, 20, 3_000_000, 1 << 30, False, Find(aType="customer", axbType="is", where=[("segment", "==", "BUILDING"), ("acctbal", ">", 0)])).select("aUid")
)
query("filter_times", "SELECT 'nation-' || n_nationkey AS aUid FROM nation")(
    lambda g: g.find_nodes("nation", [("createdAt", ">=", datetime.datetime(2023, 12, 31)), ("updatedAt", "<", datetime.datetime(2024, 1, 3))], limit=0).select("aUid")
)
def _talks(g: Graph) -> Graph:
    """The conversations with, in each one's graph, edges from its turns to the roles that spoke them."""
    said = g.candidates([("aType", "==", "turn"), ("axbType", "==", "is")], everywhere=True).where("axbType = 'is' and aType = 'turn'")
    said = said.withColumns({"axbType": F.lit("saidBy"), "bType": F.lit("role"), "bUid": F.concat(F.lit("role-"), paths.typed("$.role", "string")), "data": F.parse_json(F.lit("{}"))}).withColumn("docId", doc_id_column())
    turns = g.candidates([("axbType", "==", "hasTurn")], everywhere=True)
    return Graph(turns.unionByName(said))


def _starts(g: Graph) -> list[str]:
    """Ten conversations, not in the order of their names."""
    return [f"conv-{k}" for k in (9, 4, 7, 1, 12, 3, 15, 2, 8, 5)]


_ARRIVED = """
WITH s AS (SELECT * FROM (VALUES (9, 1), (4, 2), (7, 3), (1, 4), (12, 5), (3, 6), (15, 7), (2, 8), (8, 9), (5, 10)) t(conv_id, place)),
t AS (SELECT conv_id, place, turn, role, 'turn-' || conv_id || '-' || turn AS u, row_number() OVER (ORDER BY place, turn DESC, {0}) AS rank FROM conversations JOIN s USING (conv_id))""".format(_edge_id("'conv-' || conv_id", "hasTurn", "'turn-' || conv_id || '-' || turn"))
_HOPS = [Hop("hasTurn", target_graph="turns", limit=None, order_by=("data.turn", "desc")), Hop("saidBy", limit=None), Hop("saidBy", "reverse", limit=None)]
query("traverse_first_reader", _ARRIVED + """, r AS (SELECT role, arg_min(conv_id, rank) AS conv_id FROM t GROUP BY role)
SELECT 'turn-' || c.conv_id || '-' || c.turn AS aUid, 'role-' || c.role AS bUid, 'conv-' || c.conv_id || '/turns' AS scope, 3 AS depth FROM conversations c JOIN r USING (role, conv_id)
UNION ALL SELECT u, 'role-' || role, 'conv-' || conv_id || '/turns', 2 FROM t""")(
    lambda g: _talks(g).traverse(_starts(g), _HOPS, None).where("depth > 1").select("aUid", "bUid", "scope", "depth")
)
query("traverse_budget", _ARRIVED + " SELECT u AS aUid, 'role-' || role AS bUid FROM t WHERE rank <= 7")(lambda g: _talks(g).traverse(_starts(g), _HOPS[:2], 17).where("depth = 2").select("aUid", "bUid"))
query("traverse_default_budget", f"SELECT {_ORDERS} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12 ORDER BY c_nationkey, {_edge_id(_NODE, 'inNation', chr(39) + 'nation-' + chr(39) + ' || c_nationkey')} LIMIT 88)")(
    lambda g: g.traverse([f"nation-{k}" for k in range(12)], [Hop("inNation", "reverse", aType="customer", limit=None), Hop("placed", limit=None)]).where("depth = 2").select("aUid", "bUid")
)
query("traversal_totals", _ARRIVED + """
SELECT 3 AS hops, 10 + (SELECT count(*) FROM t) + (SELECT count(DISTINCT role) FROM t) AS "totalReads", 2 * (SELECT count(*) FROM t) + n AS edges, n AS nodes, false AS truncated
FROM (SELECT count(*) AS n FROM conversations JOIN (SELECT role, arg_min(conv_id, rank) AS conv_id FROM t GROUP BY role) r USING (role, conv_id)) x""")(
    lambda g: _talks(g).traversal_totals(_starts(g), _HOPS, None)
)
query("engine_caps", f"""
WITH e1 AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY {_edge_id(_NODE, 'inNation', "'nation-' || c_nationkey")}) AS rank FROM customer QUALIFY rank <= 25 * 40),
e2 AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, {_PLACED}) AS place FROM orders WHERE o_custkey IN (SELECT c_custkey FROM e1) QUALIFY place <= 2)
SELECT 1 AS depth, 'customer-' || c_custkey AS aUid, 'nation-' || c_nationkey AS bUid FROM e1
UNION ALL SELECT 2, 'customer-' || o_custkey, 'order-' || o_orderkey FROM e2
UNION ALL SELECT 3, 'customer-' || o_custkey, 'order-' || o_orderkey FROM e2 WHERE place = 1""")(
    lambda g: g.run_engine_traversal([f"nation-{k}" for k in range(25)], [Hop("inNation", "reverse", aType="customer", limit=40), Hop("placed", limit=2, order_by=("data.total", "desc")), Hop("placed", "reverse", limit=1)]).select("depth", "aUid", "bUid")
)


def _dated_orders(g: Graph) -> Graph:
    """The orders with a date in ISO form and an object in their payloads."""
    about = F.struct(F.struct(paths.typed("$.status", "string").alias("state"), (F.expr("cast(substr(aUid, 7) as long)") % 3).alias("class")).alias("about"), F.date_format(F.timestamp_add("DAY", F.expr("cast(substr(aUid, 7) as int) % 900"), F.lit(datetime.datetime(2023, 1, 1))), "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return Graph(g.find_nodes("order", limit=0).withColumn("data", F.to_variant_object(about)))


query("filter_payload_dates", "SELECT 'order-' || o_orderkey AS aUid FROM orders WHERE o_orderkey % 900 BETWEEN 59 AND 364")(
    lambda g: _dated_orders(g).find_nodes("order", [("at", ">=", datetime.datetime(2023, 3, 1)), ("data.at", "<=", datetime.datetime(2023, 12, 31))], limit=0).select("aUid")
)
query("filter_payload_objects", "SELECT 'order-' || o_orderkey AS aUid FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 1")(
    lambda g: _dated_orders(g).find_nodes("order", [("about", "==", {"state": "O", "class": 1}), ("about", "!=", {"class": 2, "state": "F"})], limit=0).select("aUid")
)
query("filter_payload_object_list", "SELECT 'order-' || o_orderkey AS aUid FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderkey % 3 = 2")(
    lambda g: _dated_orders(g).find_nodes("order", [("about", "in", [{"state": "O", "class": 2}, {"state": "F", "class": 2}, "O", 2])], limit=0).select("aUid")
)
_BIG = 1 << 53


def _numbered_orders(g: Graph) -> Graph:
    """The orders with numbers that doubles can't tell apart, some of them as decimals or doubles."""
    key = F.expr("cast(substr(aUid, 7) as long)")
    big = F.expr(f"{_BIG} + cast(substr(aUid, 7) as long)")
    payload = F.when(key % 3 == 0, F.to_json(F.struct(F.concat(big, F.lit(".5")).cast("decimal(38,1)").alias("big")))).otherwise(F.to_json(F.struct(big.alias("big"))))
    return Graph(g.find_nodes("order", limit=0).withColumn("data", F.parse_json(payload)))


_NUMBERED = f"(SELECT *, CAST({_BIG} AS DECIMAL(38, 1)) + o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0 END AS big FROM orders)"
for _op, _sql in (("==", "= {0} + 7"), (">", "> {0} + 7"), ("<=", "<= {0} + 9"), ("!=", "<> {0} + 7")):
    query({"==": "exact_eq", ">": "exact_gt", "<=": "exact_le", "!=": "exact_ne"}[_op], f"SELECT 'order-' || o_orderkey AS aUid FROM {_NUMBERED} WHERE big {_sql.format(_BIG)}")(
        lambda g, op=_op: _numbered_orders(g).find_nodes("order", [("big", op, _BIG + (9 if op == "<=" else 7))], limit=0).select("aUid")
    )
query("exact_in", f"SELECT 'order-' || o_orderkey AS aUid FROM {_NUMBERED} WHERE big IN ({_BIG} + 2, {_BIG} + 4, {_BIG} + 9.5)")(
    lambda g: _numbered_orders(g).find_nodes("order", [("big", "in", [_BIG + 2, _BIG + 4, decimal.Decimal(_BIG) + decimal.Decimal("9.5"), 5, "x"])], limit=0).select("aUid")
)
query("exact_order", f"SELECT 'order-' || o_orderkey AS aUid FROM {_NUMBERED} WHERE o_orderkey % 3 <> 0 ORDER BY big DESC LIMIT 40")(
    lambda g: (h := _numbered_orders(g)) and Graph(h.table.where("cast(substr(aUid, 7) as long) % 3 <> 0")).find_nodes("order", order_by=("data.big", "desc"), limit=40).select("aUid")
)
query("exact_sum", f"SELECT CAST(CAST(sum(big) AS DECIMAL(38, 1)) AS VARCHAR) AS total, CAST(CAST(min(big) AS DECIMAL(38, 1)) AS VARCHAR) AS low, CAST(CAST(max(big) AS DECIMAL(38, 1)) AS VARCHAR) AS high FROM {_NUMBERED}")(
    lambda g: _numbered_orders(g).aggregate({"total": ("sum", "data.big", 1), "low": ("min", "data.big", 1), "high": ("max", "data.big", 1)}, Find(aType="order", axbType="is")).select(*(F.col(c).cast("string").alias(c) for c in ("total", "low", "high")))
)
query("long_list_in", "SELECT 'doc-' || doc_id AS aUid FROM documents WHERE n_chars % 2 = 0 AND n_chars < 200000 OR lang = 'x'")(
    lambda g: g.find_nodes("doc", [("chars", "in", [*range(0, 200_000, 2), "7", True])], limit=0).select("aUid")
)
query("long_list_not_in", "SELECT 'order-' || o_orderkey AS aUid FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey <= 300000 OR o_orderkey > 300000")(
    lambda g: g.find_nodes("order", [("aUid", "not-in", [f"order-{k}" for k in range(0, 300_001, 3)]), ("status", "not-in", [f"s{k}" for k in range(100_000)])], limit=0).select("aUid")
)
query("long_list_expand", f"SELECT {_ORDERS} FROM orders WHERE o_custkey BETWEEN 1 AND 100000 AND o_custkey % 2 = 0")(
    lambda g: g.expand([f"customer-{k}" for k in range(2, 100_001, 2)], "placed").select("aUid", "bUid")
)
QUERIES["windowed_counts"] = lambda spark, sf_dir: windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], "1 day").select(F.col("start").cast("timestamp").alias("start"), "event_type", "n")
ORACLE_SQL["windowed_counts"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
