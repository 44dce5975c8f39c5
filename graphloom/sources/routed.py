"""Several stores behind one graph: each scope's rows live in the store that a rule names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.model import scope_names
from graphloom.operators.graph import Graph
from graphloom.plans.planner import Find
from graphloom.sources.store import SnapshotStore

#: What every store here can do.
CAPABILITIES = frozenset({
    "core.read", "core.write", "core.transactions", "core.batch", "core.subgraph", "query.aggregate", "query.select", "query.join", "query.dml",
    "traversal.serverSide", "search.fullText", "search.geo", "search.vector",
})


@dataclass(frozen=True)
class Outcome:
    """What became of one store's part of a change over several: its new version, or why there is none."""

    store: str
    rows: int
    version: int | None
    error: str | None = None


class RoutedStore:
    """The base store (named ""), and others for nested graphs; route(parent uid, graph name, scope path) names one or None.

    A scope goes to the store of its deepest routed graph; below it all stays
    there unless routed on.  holds may tell for a store the names of the graphs that
    it can have: global reads by name leave out stores without it.
    """

    def __init__(self, base: SnapshotStore, others: dict[str, SnapshotStore], route: Callable[[str, str, str], str | None], holds: dict[str, set[str]] | None = None):
        self.base, self.others, self.route, self.holds = base, others, route, holds or {}
        self.capabilities = CAPABILITIES - ({"core.transactions"} if others else set())

    @property
    def stores(self) -> dict[str, SnapshotStore]:
        return {"": self.base, **dict(sorted(self.others.items()))}

    def name_of(self, scope: str) -> str:
        """The name of the store that a scope's rows live in."""
        return _routed(self.route, frozenset(self.others), scope)

    def store_of(self, scope: str) -> SnapshotStore:
        return self.stores[self.name_of(scope)]

    def graph(self, scope: str = "") -> Graph:
        return self.store_of(scope).graph(scope)

    def read_all(self) -> DataFrame:
        """The rows of all stores with `store`; columns and filters reach each store's scan."""
        return self._read(list(self.stores))

    def _read(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.stores[n].read().withColumn("store", F.lit(n)) for n in names])

    def find_edges_global(self, find: Find, name: str | None = None, allow_scan: bool = False, within: list[str] | None = None) -> DataFrame:
        """`Graph.find_edges_global` over the graphs of all stores, with `store`; order and limit are of all together."""
        names = [n for n in self.stores if name is None or n not in self.holds or name in self.holds[n]]
        if not names:
            return self._read([""]).where(F.lit(False))
        return Graph(self._read(names)).find_edges_global(find, name, allow_scan, within)

    def apply(self, changes: DataFrame, now: str, scope: str = "") -> int:
        """Fold changes of one scope into its store, as one commit."""
        if not changes.where(~F.col("scope").eqNullSafe(scope)).isEmpty():
            raise GraphError("ROUTING_ERROR", "routed changes are of one scope")
        return self.store_of(scope).apply(changes, now)

    def apply_all(self, changes: DataFrame, now: str) -> list[Outcome]:
        """Fold changes of any scopes, each store's as a commit of its own: there is none over several stores.

        Scopes are routed in tasks, each distinct one once.  A store that fails doesn't stop the others.
        """
        route, names = self.route, frozenset(self.others)

        @F.pandas_udf("string")
        def place(scopes: pd.Series) -> pd.Series:
            return scopes.map(lambda s: _routed(route, names, s))

        placed = changes.join(changes.select("scope").distinct().withColumn("_store", place("scope")), "scope")
        counts = {r["_store"]: r["count"] for r in placed.groupBy("_store").count().collect()}  # one for each store
        return [self._tried(n, lambda n=n: (counts[n], self.stores[n].apply(placed.where(F.col("_store") == n).drop("_store"), now))) for n in self.stores if n in counts]

    def remove_node_cascade(self, uid: str, scope: str = "") -> list[Outcome]:
        """Drop a node and its edges where it lives, and the graphs nested under it in every store.

        Each store commits by itself; the outcomes tell which commits were made (a version), which
        failed (an error, its rows are still there: the cascade can be asked for again), and where nothing was to do
        (no rows, the version as it was).
        """
        return [self._tried(n, lambda s=s: s.remove_node_cascade(uid, scope)) for n, s in self.stores.items()]

    def delete_graph(self, scope: str) -> list[Outcome]:
        """Drop a graph and all graphs under it, in every store."""
        return [self._tried(n, lambda s=s: (0, s.delete_graph(scope, True))) for n, s in self.stores.items()]

    @staticmethod
    def _tried(name: str, change: Callable[[], tuple[int, int]]) -> Outcome:
        try:
            rows, version = change()
        except GraphError as e:
            return Outcome(name, 0, None, str(e))
        return Outcome(name, rows, version)


def _routed(route: Callable[[str, str, str], str | None], names: frozenset[str], scope: str) -> str:
    found, parts = "", scope.split("/") if scope else []
    for k in range(0, len(parts), 2):
        name = route(parts[k], parts[k + 1], scope_names("/".join(parts[: k + 2])))
        if name is not None:
            if name not in names:
                raise GraphError("ROUTING_ERROR", f"no store is named {name}")
            found = name
    return found
