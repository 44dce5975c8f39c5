"""The star schema and its companions as one triple table.

Branches have literal types, so a filter on types leaves only the tables it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import nodes, triples
from graphloom.sources.branches import Branch, Branches, Uid


#: The tables' columns; with them a query starts without reading footers of tables it never scans.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def uid(kind: str, *cols: str):
    return Uid(kind, cols).column()


def star_branches(spark: SparkSession, sf_dir: str) -> Branches:
    """The star schema's branches; a query builds those that its filters leave."""

    def t(name: str):
        return lambda: spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    c, k = F.col, F.col("c_custkey")
    lat, lng = ((k * 37) % 1800) / 10 - 90, ((k * 91) % 3600) / 10 - 180
    region, nation, customer, supplier, part, order = (Uid(n, (x,)) for n, x in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("order", "o_orderkey")))
    event, turn, talk = Uid("event", ("event_id",)), Uid("turn", ("conv_id", "turn")), Uid("conv", ("conv_id",))
    return Branches(spark, (
        Branch(t("region"), "region", region, data={"name": "r_name"}),
        Branch(t("nation"), "nation", nation, data={"name": "n_name"}),
        Branch(t("customer"), "customer", customer, data={"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment", "lat": lat.cast("double"), "lng": lng.cast("double"), "active": c("c_acctbal") >= 0}),
        Branch(t("supplier"), "supplier", supplier, data={"name": "s_name", "acctbal": "s_acctbal"}),
        Branch(t("part"), "part", part, data={"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice", "tags": F.split("p_name", " ")}),
        Branch(t("orders"), "order", order, data={"status": "o_orderstatus", "total": "o_totalprice", "priority": "o_orderpriority"}),
        Branch(t("events"), "event", event, data={"type": "event_type", "value": "value"}),
        Branch(t("documents"), "doc", Uid("doc", ("doc_id",)), data={"text": "text", "lang": "lang", "source": "source", "chars": "n_chars"}),
        Branch(t("embeddings"), "item", Uid("item", ("vec_id",)), data={"embedding": c("embedding").cast("array<double>"), "label": "label"}),
        Branch(t("nation"), "nation", nation, "inRegion", "region", Uid("region", ("n_regionkey",))),
        Branch(t("customer"), "customer", customer, "inNation", "nation", Uid("nation", ("c_nationkey",))),
        Branch(t("supplier"), "supplier", supplier, "inNation", "nation", Uid("nation", ("s_nationkey",))),
        Branch(t("orders"), "customer", Uid("customer", ("o_custkey",)), "placed", "order", order, {"total": "o_totalprice"}),
        Branch(t("events"), "user", Uid("user", ("user_id",)), "did", "event", event, {"type": "event_type", "value": "value"}),
        Branch(t("conversations"), "turn", turn, data={"role": "role", "text": "text"}, scope=(talk, "turns")),
        Branch(t("conversations"), "conversation", talk, "hasTurn", "turn", turn, {"turn": "turn"}, scope=(talk, "turns")),
    ))


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_branches(spark, sf_dir).frame()


def line_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: nodes, and their edges from orders and to parts and suppliers.

    Lines have no key, so they are numbered within their order by all columns.
    """
    lines = spark.read.schema(SCHEMAS["lineitem"]).parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*lines.columns)))
    c, line = F.col, uid("line", "l_orderkey", "n")
    payload = {"quantity": c("l_quantity"), "price": c("l_extendedprice"), "discount": c("l_discount"), "tax": c("l_tax"), "returnflag": c("l_returnflag"), "linestatus": c("l_linestatus")}
    parts = [
        nodes(lines, "lineitem", line, payload),
        triples(lines, "order", uid("order", "l_orderkey"), "hasLine", "lineitem", line, {"n": c("n")}),
        triples(lines, "lineitem", line, "ofPart", "part", uid("part", "l_partkey"), {"quantity": c("l_quantity")}),
        triples(lines, "lineitem", line, "suppliedBy", "supplier", uid("supplier", "l_suppkey"), {"quantity": c("l_quantity")}),
    ]
    return reduce(DataFrame.unionByName, parts)
