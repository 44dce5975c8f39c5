"""Reads that a tool on top of a graph asks for: details, batches, pages, summaries, existing types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import invalid
from graphloom.functions import paths
from graphloom.model import NODE
from graphloom.operators.graph import Graph
from graphloom.plans.planner import Find

OPERATORS = ("==", "!=", "<", "<=", ">", ">=")


def clamped(limit: int | None, default: int = 25, most: int = 200) -> int:
    return default if limit is None else max(1, min(most, limit))


def node_detail(graph: Graph, uid: str, limit: int = 50) -> DataFrame:
    """The node and its edges of both directions with `side` (node, out, in), at most limit + 1 of each direction."""
    rows = graph.rows
    node = rows.where(F.col("docId") == uid).withColumn("side", F.lit("node"))
    edges = rows.where(F.col("axbType") != NODE)
    cut = lambda df, side: df.orderBy("docId").limit(limit + 1).withColumn("side", F.lit(side))
    return node.unionByName(cut(edges.where(F.col("aUid") == uid), "out")).unionByName(cut(edges.where(F.col("bUid") == uid), "in"))


def nodes_batch(graph: Graph, uids: list[str]) -> DataFrame:
    """One row for each of up to 100 uids, in `node` the node or null."""
    if len(uids) > 100:
        raise invalid("a batch has 100 uids at most")
    asked = graph.spark.createDataFrame([(u,) for u in dict.fromkeys(uids)], "uid string")
    known = graph.candidates([("aUid", "in", uids), ("axbType", "==", NODE)])
    found = known.where(F.col("docId").isin(uids) & (F.col("axbType") == NODE)) if uids else known.where("false")
    found = found.select(F.col("docId").alias("_id"), F.struct("aType", "aUid", "data", "v").alias("node"))
    return asked.join(found, F.col("uid") == F.col("_id"), "left").drop("_id")


def page(graph: Graph, find: Find, sort: str = "aUid", descending: bool = False, cursor: tuple | None = None, limit: int | None = None, edges: bool = True) -> DataFrame:
    """A page of rows with `sortKey` and `hasMore`, after the cursor (last sort key, last docId).

    Edge pages leave nodes out unless the relation is given.  Keys of data fields
    are their numbers if the cursor's is a number, else their strings.
    """
    if any(op not in OPERATORS for _, op, _ in find.where):
        raise invalid("a page filters by comparison only")
    limit = clamped(limit)
    rows = graph._where(graph.candidates(find.filters()), find.filters())
    if edges and find.axbType is None:
        rows = rows.where(F.col("axbType") != NODE)
    numeric = cursor is not None and isinstance(cursor[0], int | float)
    path = paths.data_path(sort)
    if path is None:
        key = F.col(sort)
    elif cursor is None:
        key = F.coalesce(paths.typed(path, "string"), F.to_json(paths.variant_at(path)))
    else:
        key = paths.typed(path, "number" if numeric else "string")
    order: list[Column]
    if path is not None and cursor is None:
        order = Graph.order((f"data.{path[2:]}", "desc" if descending else "asc"))
    else:
        order = [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col("docId").asc()]
    if cursor is not None:
        value, doc_id = F.lit(cursor[0]), cursor[1]
        rows = rows.where((key < value if descending else key > value) | ((key == value) & (F.col("docId") > doc_id)))
    more = rows.withColumn("sortKey", key).orderBy(*order).limit(limit + 1)
    total = more.agg(F.count("*").alias("_n"))
    return more.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("hasMore", F.col("_n") > limit).drop("_n")  # one row


def summaries(rows: DataFrame) -> DataFrame:
    """Short rows: from, relation, to, their types, payload as JSON (null if empty), times as ISO strings."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    return rows.select(
        F.col("aUid").alias("from"), F.col("axbType").alias("relation"), F.col("bUid").alias("to"), F.col("aType").alias("fromType"), F.col("bType").alias("toType"),
        F.nullif(F.to_json("data"), F.lit("{}")).alias("data"), iso("createdAt"), iso("updatedAt"),
    )


def observed_types(graph: Graph) -> DataFrame:
    """The kinds of triples that there are, with their numbers."""
    return graph.rows.groupBy("aType", "axbType", "bType").agg(F.count("*").alias("n"))


def observed_fields(graph: Graph) -> DataFrame:
    """The top-level fields of each kind's payloads, with the widest type seen and their numbers."""
    entries = graph.rows.select("aType", "axbType", "bType", F.explode(F.map_entries(F.expr("cast(data as map<string, variant>)"))).alias("e"))
    return entries.groupBy("aType", "axbType", "bType", F.col("e.key").alias("field")).agg(F.count("*").alias("n"), F.schema_of_variant_agg("e.value").alias("type"))
