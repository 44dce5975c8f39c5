"""Traversals hop by hop, with frontiers in order of arrival.

A frontier is the distinct targets of a hop.  Where a budget or several graphs make
the order matter, each target belongs to the source that came first, and is numbered
after those of earlier sources: targets are sorted by ranges, and a range's numbers
start after the sizes of the ranges before it.  The sizes give the number of sources
too, so a budget costs no count of its own.  Each hop's edges are written once to the
shared folder (Spark drops them with `spark.cleaner.referenceTracking.cleanCheckpoints`),
and serve both the result and the next hop.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import GraphError, invalid
from graphloom.model import NODE
from graphloom.plans.planner import Find
from graphloom.sources.folders import kept

if TYPE_CHECKING:
    from graphloom.operators.graph import Graph, Hop

#: Sources that a traversal reads if it isn't told otherwise.
DEFAULT_READS = 100
#: Hops of an engine traversal at most.
ENGINE_DEPTH = 5


@dataclass(frozen=True)
class Step:
    """One hop: its sources, those that were read, and its edges; numbers where the order was kept."""

    hop: Hop
    wanted: DataFrame
    read: DataFrame
    edges: DataFrame
    sources: int | None = None
    reads: int | None = None

    @property
    def far(self) -> str:
        return "bUid" if self.hop.direction == "forward" else "aUid"


def numbered(df: DataFrame, order: list[Column], name: str = "_rank") -> tuple[DataFrame, int]:
    """df with its numbers 1, 2, ... in an order, and how many there are."""
    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_range")).count().orderBy("_range").collect()  # one for each range
    start, starts = 0, []
    for r in sizes:
        starts.append((r["_range"], start))
        start += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "_range long, _start long")
    out = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_start", "_at"), start


def _near_far(hop: Hop) -> tuple[str, str]:
    if hop.direction not in ("forward", "reverse"):
        raise invalid(f"unknown direction {hop.direction!r}")
    return ("aUid", "bUid") if hop.direction == "forward" else ("bUid", "aUid")


def _edges_of(graph: Graph, hop: Hop) -> DataFrame:
    filters = [*Find(aType=hop.aType, axbType=hop.axbType, bType=hop.bType).filters(), *hop.where]
    edges = graph._where(graph.candidates(filters, everywhere=True), filters)
    if hop.axbType == NODE:
        edges = edges.where("aUid <> bUid")
    return edges if hop.keep is None else edges.where(hop.keep)


def _first(edges: DataFrame, hop: Hop, keep: list[str]) -> tuple[DataFrame, list[Column]]:
    """The columns `keep` of the edge by which each target came first, and the order of the targets.

    Of one source only one edge leads to a target, so its source's number decides alone.
    """
    _, far = _near_far(hop)
    keys, ways = _order(hop)
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    first = edges.groupBy(F.col(far).alias("_uid")).agg(F.min_by(F.struct(*keep, *named), "_rank").alias("_e"), F.min("_rank").alias("_from"))
    order = [F.col("_from"), *(F.col(f"_e._k{i}").desc_nulls_last() if way == "desc" else F.col(f"_e._k{i}").asc_nulls_first() for i, way in enumerate(ways))]
    return first, order


def _order(hop: Hop) -> tuple[list[Column], list[str]]:
    from graphloom.operators.graph import Graph

    keys = Graph.order_keys(hop.order_by[0]) if hop.order_by else []
    return [*keys, F.col("docId")], [*([hop.order_by[1]] * len(keys) if hop.order_by else []), "asc"]


def _started(graph: Graph, starts: DataFrame | list[str], ordered: bool) -> tuple[DataFrame, int | None]:
    """The first frontier; a list is in its own order, a table in that of its uids."""
    if isinstance(starts, list):
        given = list(dict.fromkeys(starts))
        df = graph.spark.createDataFrame([(s, graph.scope, k) for k, s in enumerate(given, 1)], "_uid string, _scope string, _rank long")
        return df, len(given)
    df = starts.select(F.col(starts.columns[0]).alias("_uid")).distinct().withColumn("_scope", F.lit(graph.scope))
    return numbered(df, [F.col("_uid")]) if ordered else (df.withColumn("_rank", F.lit(0).cast("long")), None)


def steps(graph: Graph, starts: DataFrame | list[str], hops: list[Hop], max_reads: int | None) -> list[Step]:
    """All hops.  A hop with a target graph goes on in that graph under each source, the others where their source was found."""
    if not hops:
        raise GraphError("TRAVERSAL_ERROR", "a traversal needs a hop")
    names = [h.target_graph or (graph.registry.target_graph(h.axbType) if graph.registry else None) for h in hops]
    ordered = max_reads is not None or any(names[:-1])
    frontier, sources = _started(graph, starts, ordered)
    out, left = [], max_reads
    for depth, (hop, graph_name) in enumerate(zip(hops, names, strict=True), 1):
        near, far = _near_far(hop)
        wanted, total, reads = frontier, sources, sources
        if left is not None:
            reads = min(total, max(left, 0))
            left -= reads
            if reads < total:
                frontier = frontier.where(F.col("_rank") <= reads)
        read = frontier
        if graph_name and hop.direction == "forward":
            prefix = F.lit(graph.scope + "/" if graph.scope else "")
            frontier = frontier.withColumn("_scope", F.concat(prefix, "_uid", F.lit(f"/{graph_name}")))
        edges = _edges_of(graph, hop).join(frontier, (F.col(near) == F.col("_uid")) & (F.col("scope") == F.col("_scope"))).drop("_uid", "_scope")
        if hop.limit:
            keys, ways = _order(hop)
            w = Window.partitionBy("scope", near).orderBy(*(k.desc_nulls_last() if way == "desc" else k.asc_nulls_first() for k, way in zip(keys, ways, strict=True)))
            edges = edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= hop.limit).drop("_r")
        edges = edges.withColumn("depth", F.lit(depth))
        if depth < len(hops):
            edges = kept(edges)
            if ordered:
                first, order = _first(edges, hop, ["scope"])
                frontier, sources = numbered(first.select("_uid", F.col("_e.scope").alias("_scope"), "_from", "_e"), order)
                frontier = frontier.select("_uid", "_scope", "_rank")
            else:
                frontier = edges.select(F.col(far).alias("_uid"), F.col("scope").alias("_scope")).distinct().withColumn("_rank", F.lit(0).cast("long"))
                sources = None
        out.append(Step(hop, wanted, read, edges.drop("_rank"), total, reads))
    return out


def report(found: list[Step]) -> DataFrame:
    """One row for each hop: depth, axbType, sources (those to read), reads, edges, targets, truncated."""
    parts = []
    for depth, step in enumerate(found, 1):
        one = step.edges.agg(F.count("*").alias("edges"), F.countDistinct(step.far).alias("targets"))
        for df, known, name in ((step.wanted, step.sources, "sources"), (step.read, step.reads, "reads")):
            one = one.withColumn(name, F.lit(known).cast("long")) if known is not None else one.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # single rows
        parts.append(one.select(F.lit(depth).alias("depth"), F.lit(step.hop.axbType).alias("axbType"), "sources", "reads", "edges", "targets", F.expr("reads < sources").alias("truncated")))
    return reduce(DataFrame.unionByName, parts)


def totals(found: list[Step]) -> DataFrame:
    """One row for the whole run: hops, totalReads, edges (of all hops), nodes (edges of the last hop), truncated."""
    last = F.max_by("edges", "depth")
    return report(found).agg(F.count("*").alias("hops"), F.sum("reads").alias("totalReads"), F.sum("edges").alias("edges"), last.alias("nodes"), F.bool_or("truncated").alias("truncated"))


def engine(graph: Graph, sources: list[str], hops: list[Hop], max_reads: int | None = None) -> DataFrame:
    """A chain of hops with one edge for each target at each depth.

    The first hop has one limit for all its sources together (their number times its
    own), later hops one for each source.  A target keeps the edge by which it came
    first, before the next hop reads it.  With max_reads, a chain whose limits allow
    more edges at its deepest hop is refused.
    """
    if not hops:
        raise GraphError("TRAVERSAL_ERROR", "a traversal needs a hop")
    if len(hops) > ENGINE_DEPTH:
        raise GraphError("TRAVERSAL_ERROR", f"an engine traversal has {ENGINE_DEPTH} hops at most")
    if any(not h.limit for h in hops):
        raise invalid("every hop of an engine traversal needs a limit")
    if max_reads is not None and math.prod([max(1, len(sources)), *[h.limit for h in hops]]) > max_reads:
        raise GraphError("TRAVERSAL_ERROR", f"the limits allow more than {max_reads} reads")
    frontier, parts = None, []
    for depth, hop in enumerate(hops, 1):
        near, _ = _near_far(hop)
        edges = _edges_of(graph, hop).where(F.col("scope") == graph.scope)
        keys, ways = _order(hop)
        order = [k.desc_nulls_last() if way == "desc" else k.asc_nulls_first() for k, way in zip(keys, ways, strict=True)]
        if frontier is None:
            given = graph.spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "_uid string")
            edges = edges.join(given, F.col(near) == F.col("_uid"), "left_semi").orderBy(*order).limit(len(sources) * hop.limit)
            edges, _ = numbered(edges, order)
        else:
            edges = edges.join(frontier, F.col(near) == F.col("_uid")).drop("_uid")
            w = Window.partitionBy(near).orderBy(*order)
            edges = edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= hop.limit).drop("_r")
        columns = [c for c in edges.columns if c != "_rank"]
        first, by = _first(edges, hop, columns)
        if depth < len(hops):
            first, _ = numbered(first, by)
        parts.append(first.select(*(F.col(f"_e.{c}").alias(c) for c in columns), F.lit(depth).alias("depth")))
        frontier = first if depth == len(hops) else first.select("_uid", "_rank")
    return reduce(DataFrame.unionByName, parts)
