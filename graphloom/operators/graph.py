"""Graph handles: lazy reads, aggregates, expansion and traversal of one graph."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.errors import invalid
from graphloom.functions import paths
from graphloom.model import NODE, child_scope, edge_doc_id, in_scope
from graphloom.operators import traversal
from graphloom.plans import planner
from graphloom.plans.planner import Find
from graphloom.sources.branches import Branches

if TYPE_CHECKING:
    from graphloom.operators.registry import Registry


@dataclass(frozen=True)
class Hop:
    """One step of a traversal; `where` filters edges, `limit` holds for each source."""

    axbType: str
    direction: str = "forward"
    aType: str | None = None
    bType: str | None = None
    where: tuple = ()
    order_by: tuple[str, str] | None = None
    limit: int | None = 10
    target_graph: str | None = None
    keep: Column | None = None  # any condition on the edge's columns; it counts before the limit


@dataclass(frozen=True)
class Graph:
    """A triple table, and the scope of one graph in it."""

    table: DataFrame | Branches
    scope: str = ""
    scan_mode: str = "error"
    registry: Registry | None = None  # its target graphs hold for hops that name none; reads migrate payloads

    @property
    def spark(self) -> SparkSession:
        return self.table.spark if isinstance(self.table, Branches) else self.table.sparkSession

    @property
    def everything(self) -> DataFrame:
        """The rows of all graphs."""
        return self.table.frame() if isinstance(self.table, Branches) else self.table

    @property
    def rows(self) -> DataFrame:
        return self.candidates([])

    def candidates(self, filters: list, everywhere: bool = False) -> DataFrame:
        """Rows of this graph (or of all) among which those that meet the filters are; a table of branches builds no others."""
        rows = self.table.narrowed(filters, None if everywhere else self.scope) if isinstance(self.table, Branches) else self.table
        return rows if everywhere else rows.where(F.col("scope") == self.scope)

    def subgraph(self, parent_uid: str, name: str = "graph") -> Graph:
        return replace(self, scope=child_scope(self.scope, parent_uid, name))

    # point reads
    def get_doc(self, doc_id: str) -> DataFrame:
        return self._migrated(self.candidates(planner.key_filters(doc_id)).where(F.col("docId") == doc_id).limit(1))

    def get_node(self, uid: str) -> DataFrame:
        return self.get_doc(uid)

    def get_edge(self, a_uid: str, axb_type: str, b_uid: str) -> DataFrame:
        return self.get_doc(edge_doc_id(a_uid, axb_type, b_uid))

    def edge_exists(self, a_uid: str, axb_type: str, b_uid: str) -> bool:
        return not self.get_edge(a_uid, axb_type, b_uid).isEmpty()

    def existing(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (docId, ...) that the graph has."""
        return keys.join(self.rows.select("docId"), "docId", "left_semi")

    def _migrated(self, df: DataFrame) -> DataFrame:
        return self.registry.migrated(df) if self.registry else df

    # filtered scans
    @staticmethod
    def _ordered(df: DataFrame, order_by: tuple[str, str] | None, limit: int | None, kind: object = 0.0) -> DataFrame:
        if order_by:
            df = df.orderBy(*Graph.order(order_by, kind))
        elif limit:
            df = df.orderBy("docId")
        return df.limit(limit) if limit else df

    @staticmethod
    def order(order_by: tuple[str, str], kind: object = 0.0) -> list[Column]:
        name, way = order_by
        return [k.desc_nulls_last() if way == "desc" else k.asc_nulls_first() for k in Graph.order_keys(name)] + [F.col("docId").asc()]

    @staticmethod
    def order_keys(name: str) -> list[Column]:
        """The columns that a field is ordered by: one for each type that it may have."""
        path = paths.data_path(name, bare=False)
        return [F.col(name)] if path is None else [paths.typed(path, "number"), F.when(F.abs(paths.typed(path, "number")) >= paths.EXACT, paths.exact(path, 18)), paths.typed(path, "string"), paths.typed(path, "boolean")]

    def _where(self, df: DataFrame, filters: list) -> DataFrame:
        return reduce(lambda rows, f: paths.matched(rows, *f), filters, df)

    def find_edges(self, find: Find, allow_scan: bool = False) -> DataFrame:
        key = planner.point_key(find)
        if key is not None:
            return self.get_doc(key)
        filters = find.filters()
        if not filters:
            raise invalid("find_edges needs a filter")
        planner.guard(filters, self.scan_mode, allow_scan)
        return self._migrated(self._ordered(self._where(self.candidates(filters), filters), find.order_by, planner.effective_limit(find.limit)))

    def find_nodes(self, a_type: str, where: list | None = None, order_by: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
        return self.find_edges(Find(aType=a_type, axbType=NODE, where=where or [], order_by=order_by, limit=limit))

    def find_edges_global(self, find: Find, name: str | None = None, allow_scan: bool = False, within: list[str] | None = None) -> DataFrame:
        """The same filters over every graph whose last name is `name`, or whose names fit one of the globs `within`."""
        if planner.point_key(find) is not None:
            raise invalid("a global search can't be for one edge")
        if not name and not within:
            raise invalid("a global search needs the name of a graph, or globs")
        filters = find.filters()
        planner.guard(filters, self.scan_mode, allow_scan)
        everywhere = self.candidates(filters, everywhere=True)
        if name:
            everywhere = everywhere.where(F.element_at(F.split("scope", "/"), -1) == name)
        if within:
            everywhere = everywhere.where(in_scope(F.col("scope"), within))
        return self._migrated(self._ordered(self._where(everywhere, filters), find.order_by, planner.effective_limit(find.limit)))

    def find_edges_projected(self, find: Find, select: list[str], kinds: dict[str, str] | None = None, allow_scan: bool = False) -> DataFrame:
        """Columns named as asked; kinds gives flat types (number, string, boolean) for data fields."""
        if not select:
            raise invalid("select needs a field")
        filters = find.filters()
        planner.guard(filters, self.scan_mode, allow_scan)
        rows = self._ordered(self._where(self.candidates(filters), filters), find.order_by, planner.effective_limit(find.limit))
        cols = []
        for name in dict.fromkeys(select):
            path = None if name == "v" else paths.data_path(name)
            kind = (kinds or {}).get(name)
            cols.append((F.col(name) if path is None else paths.typed(path, kind) if kind else paths.variant_at(path)).alias(name))
        return rows.select(*cols)

    # aggregates
    def aggregate(self, aggregates: dict[str, tuple], find: Find | None = None, group_by: list[str] | None = None, allow_scan: bool = False) -> DataFrame:
        """One row (or one for each group); sum, min and max of nothing are 0, avg is NaN.

        An aggregate is (count,), (op, field), or (op, field, digits): the last over decimals with
        that many digits after the point, exact where doubles aren't.
        """
        if not aggregates:
            raise invalid("aggregate needs an aggregate")
        for alias in aggregates:
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", alias):
                raise invalid(f"{alias!r} can't name an aggregate")
        find = find or Find()
        if planner.point_key(find) is not None:
            raise invalid("an aggregate can't be over one edge")
        filters = find.filters()
        planner.guard(filters, self.scan_mode, allow_scan)
        cols = []
        for alias, (op, *name) in aggregates.items():
            if op == "count":
                if name:
                    raise invalid("count takes no field")
                cols.append(F.count(F.lit(1)).alias(alias))
                continue
            if op not in ("sum", "avg", "min", "max") or not 1 <= len(name) <= 2:
                raise invalid(f"{op!r} isn't an aggregate of one field")
            if len(name) == 2:
                path = paths.data_path(name[0], bare=False)
                if path is None or op == "avg":
                    raise invalid("exact aggregates are sums, least and greatest values of data fields")
                found = getattr(F, op)(paths.exact(path, name[1]))
                cols.append(F.coalesce(found, F.lit(0).cast(f"decimal(38,{name[1]})")).alias(alias))
                continue
            x = paths.field(name[0], 0.0, bare=False)
            empty = float("nan") if op == "avg" else 0.0
            cols.append(F.coalesce(getattr(F, op)(x), F.lit(empty)).alias(alias))
        rows = self._where(self.candidates(filters), filters)
        if group_by:
            rows = rows.withColumns({g: paths.field(g, "") for g in group_by if paths.data_path(g) is not None})
        return (rows.groupBy(*group_by) if group_by else rows).agg(*cols)

    # fan-out
    def expand(self, sources: DataFrame | list[str], axb_type: str, direction: str = "forward", a_type: str | None = None, b_type: str | None = None, limit_per_source: int | None = None, order_by: tuple[str, str] | None = None, hydrate: bool = False, strict: bool = False) -> DataFrame:
        """Edges of many sources (uids); the limit caps all edges together unless strict."""
        near, far = ("aUid", "bUid") if direction == "forward" else ("bUid", "aUid")
        filters = Find(aType=a_type, axbType=axb_type, bType=b_type).filters()
        if isinstance(sources, list) and len(set(sources)) >= paths.LONG_LIST:
            sources = self.spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "uid string")
        few = [(near, "in", list(set(sources)))] if isinstance(sources, list) and sources else []
        rows = self._where(self.candidates([*filters, *few]), filters)
        if axb_type == NODE:
            rows = rows.where("aUid <> bUid")
        if isinstance(sources, list):
            total = len(set(sources))
            rows = rows.where(F.col(near).isin(*set(sources))) if sources else rows.where(F.lit(False))
        else:
            total = None
            rows = rows.join(sources.select(F.col(sources.columns[0]).alias(near)).distinct(), near, "left_semi")
        if limit_per_source and strict:
            w = Window.partitionBy(near).orderBy(*(self.order(order_by) if order_by else [F.col("docId")]))
            rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit_per_source).drop("_r")
        elif limit_per_source:
            rows = self._ordered(rows, order_by, limit_per_source * (total if total is not None else sources.distinct().count()))
        elif order_by:
            rows = rows.orderBy(*self.order(order_by))
        if hydrate:
            kind = b_type if direction == "forward" else a_type
            known = [("axbType", "==", NODE), *([("aType", "==", kind)] if kind else [])]
            target = self._where(self.candidates(known), known).where(F.col("aUid") == F.col("bUid")).select(F.col("aUid").alias("_t"), F.struct("aType", "aUid", "data", "v").alias("target"))
            rows = rows.join(target, F.col(far) == F.col("_t"), "left").drop("_t")
        return rows

    def traverse(self, starts: DataFrame | list[str], hops: list[Hop], max_reads: int | None = traversal.DEFAULT_READS) -> DataFrame:
        """All edges of all hops, with `depth`; each hop starts from the distinct targets of the last.

        A hop with a target graph goes on in that graph under each source.  Only
        max_reads sources over all hops are read (None: all), first come first; a uid
        that several sources lead to is read where the first of them found it.
        """
        return reduce(DataFrame.unionByName, [s.edges for s in traversal.steps(self, starts, hops, max_reads)])

    def traversal_report(self, starts: DataFrame | list[str], hops: list[Hop], max_reads: int | None = traversal.DEFAULT_READS) -> DataFrame:
        """One row for each hop: depth, axbType, sources (those to read), reads, edges, targets, truncated."""
        return traversal.report(traversal.steps(self, starts, hops, max_reads))

    def traversal_totals(self, starts: DataFrame | list[str], hops: list[Hop], max_reads: int | None = traversal.DEFAULT_READS) -> DataFrame:
        """One row: hops, totalReads, edges, nodes (edges of the last hop), truncated."""
        return traversal.totals(traversal.steps(self, starts, hops, max_reads))

    def run_engine_traversal(self, starts: list[str], hops: list[Hop], max_reads: int | None = None) -> DataFrame:
        """The chain with one edge for each target at each depth, five hops at most; see `traversal.engine`."""
        return traversal.engine(self, starts, hops, max_reads)


def after(df: DataFrame, sort_key: Column, cursor: tuple, limit: int, descending: bool = False) -> DataFrame:
    """A page after the cursor (sort value, docId), one row longer than the limit if there is more."""
    value, doc_id = cursor
    past = sort_key < F.lit(value) if descending else sort_key > F.lit(value)
    rows = df.where(past | ((sort_key == F.lit(value)) & (F.col("docId") > doc_id)))
    return rows.orderBy(sort_key.desc() if descending else sort_key.asc(), "docId").limit(limit + 1)


def search_everywhere(graph: Graph, text: str, limit: int = 20) -> DataFrame:
    """Rows whose document id, source or target is the text (a `type:` before it goes), best match first."""
    bare = F.regexp_replace(F.lit(text), r"^[A-Za-z]{1,30}:", "")
    rank = F.when(F.col("docId") == text, 0).when(F.col("docId") == bare, 0).when(F.col("aUid") == bare, 1).when(F.col("bUid") == bare, 2)
    rows = graph.rows.withColumn("_m", rank).where("_m is not null")
    return rows.orderBy("_m", "docId").limit(limit).withColumn("matchType", F.element_at(F.array(*map(F.lit, ("docId", "aUid", "bUid"))), F.col("_m") + 1)).drop("_m")
