"""A graph store of immutable Parquet snapshots.

Each commit writes the partitions that it touches and then a marker that names the next
version; what was there stays as it is.  A commit that finds its marker taken has lost a
race and raises CONFLICT, so a writer succeeds against the version that it read only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.errors import GraphError, invalid
from graphloom.functions import paths, patch
from graphloom.model import COLUMNS, NODE, TRIPLE_SCHEMA, doc_id_column
from graphloom.operators.graph import Graph
from graphloom.operators.registry import Registry
from graphloom.plans.planner import Find
from graphloom.sources.folders import kept, stored
from graphloom.sources.parts import Part, PartTable

#: A change set: rows of the triple table with data as JSON, and in `op` put, replace, update or remove; seq orders changes of one row.
CHANGES = "scope string, aType string, aUid string, axbType string, bType string, bUid string, data string, v int, op string, seq long"
OPS = ("put", "replace", "update", "remove")


class GraphStore(Protocol):
    """What every store of graphs does: give its graphs, and fold changes of one into it."""

    def graph(self, scope: str = "") -> Graph: ...

    def apply(self, changes: DataFrame, now: str) -> int: ...


#: The columns as a store keeps them: in partitions of a relation, and of a type of sources and a share of them.
STORED = TRIPLE_SCHEMA + ", _bucket int"
#: Kinds among which a new store deals the types of sources.
KINDS = 256
#: Changed rows up to which a commit sends their keys to all tasks instead of shuffling what it reads.
FEW_KEYS = 100_000
#: Bits of the filter that `_perhaps` sends to all tasks: 64 in each of its rows.
FILTER_BITS = 1 << 25


class SnapshotStore:
    """Versions of a triple table; a commit writes only the partitions (relation, bucket of sources) that it touches.

    The bucket is a share of the sources of one type, counted on from those of other types (as far as
    the kinds of types reach).  A store keeps the number of shares that it was made with: a put of one
    row rewrites about the rows of one relation and type divided by it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        if buckets < 1:
            raise invalid("a store needs a bucket")
        self.spark, self.path = spark, path.rstrip("/")
        self.table, self._buckets = PartTable(spark, path, ("axbType", "_bucket")), buckets

    def buckets(self, version: int) -> int:
        return self.table.marker(version)["settings"].get("buckets", self._buckets)

    def version(self) -> int:
        return self.table.latest()

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.version() if version is None else version).select(*COLUMNS)

    def _read(self, version: int, only: list[Part] | None = None) -> DataFrame:
        return self.table.read(STORED, version, only)

    def graph(self, scope: str = "", version: int | None = None) -> Graph:
        return Graph(self.read(version), scope)

    def _settings(self, version: int) -> dict:
        """The numbers of shares and kinds; a version written before there were kinds has one."""
        return {"buckets": self._buckets, "kinds": 1 if version else KINDS} | self.table.marker(version)["settings"]

    def _placed(self, rows: DataFrame, version: int) -> DataFrame:
        settings = self._settings(version)
        share, kind = F.pmod(F.xxhash64("scope", "aUid"), F.lit(settings["buckets"])), F.pmod(F.xxhash64("aType"), F.lit(settings["kinds"]))
        return rows.withColumn("_bucket", (share + kind * settings["buckets"]).cast("int"))

    def _others(self, keys: DataFrame, touched: list[Part], base: int) -> list[Part]:
        """The partitions in which rows of the keys lie under another type than that of their change."""
        shares, known = self._settings(base)["buckets"], set(touched)
        near = {(relation, int(bucket) % shares) for relation, bucket in touched}
        others = [part for part in self.table.parts(base) if part not in known and (part[0], int(part[1]) % shares) in near]
        if not others:
            return []
        rows = self._read(base, others).select("scope", "docId", "axbType", "_bucket")
        return [part for part, _ in self.table.touched(_perhaps(rows, keys).join(keys, ["scope", "docId"], "left_semi"))]

    def commit(self, rows: DataFrame, base: int, shuffle: bool = True) -> int:
        """All rows of the version after base; CONFLICT if there is one already.

        Rows that come relation by relation and type by type need no shuffle.
        """
        return self._commit(self._placed(rows.select(*COLUMNS), base), base, None, shuffle)

    def _commit(self, rows: DataFrame, base: int, replaced: list[Part] | None, shuffle: bool = True) -> int:
        return self.table.write(rows, base, replaced, self._settings(base), ["aUid", "bUid"], shuffle)

    def apply(self, changes: DataFrame, now: str, base: int | None = None, missing: str = "error") -> int:
        """Fold a change set (columns CHANGES) in order and commit it; `now` stamps what it touches.

        Updates of rows that aren't there raise NOT_FOUND unless missing is "skip".
        """
        base = self.version() if base is None else base
        delta = stored(self._placed(changes, base).withColumn("docId", doc_id_column()))
        counts = self.table.touched(delta)
        keys = delta.select("scope", "docId").distinct()
        keys = F.broadcast(keys) if sum(n for _, n in counts) <= FEW_KEYS else keys.hint("merge")
        touched = [part for part, _ in counts]
        touched += self._others(keys, touched, base)
        rows = self._read(base, touched)
        made = stored(folded(rows.join(keys, ["scope", "docId"], "left_semi"), delta, now))
        if missing == "error" and not made.where("missing").isEmpty():
            raise GraphError("NOT_FOUND", "an update names a row that isn't there")
        rest = rows.join(keys, ["scope", "docId"], "left_anti")
        made = self._placed(made.where("not missing").select(*COLUMNS), base)
        return self._commit(rest.select(*COLUMNS, "_bucket").unionByName(made), base, touched)

    # conditional writes
    def _matching(self, scope: str, find: Find) -> Column:
        hit = F.col("scope") == scope
        for f in find.filters():
            hit = hit & paths.predicate(*f)
        return F.coalesce(hit, F.lit(False))

    def _rewritten(self, hit: Column, base: int | None, made: Callable[[DataFrame], DataFrame] | None = None) -> tuple[int, int]:
        """Drop the rows that meet a condition, or replace them by what made makes of them: (how many, version).

        One scan counts the hits by partition, and only partitions with hits are read again and written.
        """
        base = self.version() if base is None else base
        found = self.table.touched(self._read(base).where(hit))
        if not found:
            return 0, base
        touched = [part for part, _ in found]
        rows = self._read(base, touched)
        rest = rows.where(~hit).select(*COLUMNS, "_bucket")
        if made:
            rest = rest.unionByName(made(rows.where(hit)).select(*COLUMNS, "_bucket"))
        return sum(n for _, n in found), self._commit(rest, base, touched)

    def bulk_delete(self, find: Find, scope: str = "", base: int | None = None) -> tuple[int, int]:
        """(rows deleted, version: a new one if there were any)."""
        if not find.filters():
            raise invalid("a bulk delete needs a filter")
        return self._rewritten(self._matching(scope, find), base)

    def bulk_update(self, find: Find, data: dict, now: str, scope: str = "", base: int | None = None) -> tuple[int, int]:
        """Merge data into the payloads of all matches: (rows updated, version)."""
        operations = patch.flatten_patch(data)
        if not operations:
            raise invalid("a bulk update needs a patch")

        @F.pandas_udf("string")
        def merged(payload: pd.Series) -> pd.Series:
            return payload.map(lambda p: patch.apply_patch(p, operations))

        return self._rewritten(self._matching(scope, find), base, lambda rows: rows.withColumn("data", F.parse_json(merged(F.to_json("data")))).withColumn("updatedAt", F.lit(now).cast("timestamp")))

    def bulk_remove_edges(self, find: Find, scope: str = "", base: int | None = None) -> dict:
        """Drop the matching edges, never nodes: {deleted, batches, errors, version}."""
        if not find.filters():
            raise invalid("a bulk delete needs a filter")
        hit = self._matching(scope, find) & ~((F.col("axbType") == NODE) & (F.col("aUid") == F.col("bUid")))
        n, version = self._rewritten(hit, base)
        return {"deleted": n, "batches": 1, "errors": [], "version": version}

    def delete_graph(self, scope: str = "", nested: bool = False, base: int | None = None) -> int:
        """Drop all rows of a graph, with nested those of the graphs under it too: the version."""
        gone = F.col("scope") == scope
        if nested:
            gone = gone | F.col("scope").startswith(scope + "/" if scope else "")
        return self._rewritten(gone, base)[1]

    def put_edge_with_node(self, edge: tuple[tuple[str, str], str, tuple[str, str]], now: str, node_data: dict | None = None, edge_data: dict | None = None, new_side: str = "b", scope: str = "", attempts: int = 3) -> int:
        """An edge (a, relation, b) and the node at its new side in one version.

        The node is only made if it isn't there; an edge that is there is merged with edge_data.  If both
        are there it raises CONFLICT.  A lost race looks again at the newer version.
        """
        if new_side not in ("a", "b"):
            raise invalid("the new node is at side a or b")
        a, relation, b = edge
        fresh = a if new_side == "a" else b

        def body(graph: Graph) -> DataFrame:
            node, known = not graph.get_node(fresh[1]).isEmpty(), graph.edge_exists(a[1], relation, b[1])
            if node and known:
                raise GraphError("CONFLICT", f"both {fresh[1]} and its edge are there")
            rows = [] if node else [change("put", 0, fresh, data=node_data, scope=scope)]
            return self.spark.createDataFrame([*rows, change("put", 1, a, relation, b, edge_data, scope=scope)], CHANGES)

        return self.run_transaction(body, now, scope, attempts)

    def run_transaction(self, body: Callable[[Graph], DataFrame | None], now: str, scope: str = "", attempts: int = 3) -> int:
        """body(graph as of one version) gives a change set, committed if that version is still the latest.

        A lost race runs body again on the newer version; None commits nothing.
        """
        for left in range(attempts, 0, -1):
            base = self.version()
            changes = body(self.graph(scope, base))
            if changes is None:
                return base
            try:
                return self.apply(changes, now, base)
            except GraphError as e:
                if e.code != "CONFLICT" or left == 1:
                    raise
        raise invalid("a transaction needs an attempt")

    def read_migrated(self, registry: Registry, find: Find, scope: str = "", base: int | None = None) -> tuple[DataFrame, int]:
        """What find finds, in the latest versions of the payloads, and written back so: (rows, version).

        Only old payloads among the rows found are written, in their partitions.  A read doesn't fail for a
        writer that was faster: its rows are then not written back, and the version is the one that was read.
        """
        base = self.version() if base is None else base
        found = kept(replace(self.graph(scope, base), registry=None).find_edges(find))
        old = registry.outdated(found).select("scope", "docId", "axbType", "aType", "aUid")
        touched = [part for part, _ in self.table.touched(self._placed(old, base))]
        if touched:
            rows = self._read(base, touched)
            keys = old.select("scope", "docId")
            fresh = registry.migrated(rows.join(keys, ["scope", "docId"], "left_semi")).select(*COLUMNS, "_bucket")
            rest = rows.join(keys, ["scope", "docId"], "left_anti").select(*COLUMNS, "_bucket")
            try:
                base = self._commit(rest.unionByName(fresh), base, touched)
            except GraphError as e:
                if e.code != "CONFLICT":
                    raise
        return registry.migrated(found), base

    def compact_migrations(self, registry: Registry, base: int | None = None) -> tuple[int, int]:
        """Write old payloads back in their latest version: (rows brought up, new version)."""
        return self._rewritten(F.coalesce(registry.is_outdated(), F.lit(False)), base, registry.migrated)

    def remove_node_cascade(self, uid: str, scope: str = "", base: int | None = None) -> tuple[int, int]:
        """Drop a node, its edges and all graphs nested under it: (rows dropped, new version)."""
        under = (scope + "/" if scope else "") + uid + "/"
        hit = ((F.col("scope") == scope) & ((F.col("aUid") == uid) | (F.col("bUid") == uid))) | F.col("scope").startswith(under)
        return self._rewritten(hit, base)


def _perhaps(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose (scope, docId) may be among the keys: all that are, and few others.

    Half a million numbers at most go to all tasks, so a following join shuffles few rows
    however many there are; it never decides a result.
    """

    def at(df: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("scope", "docId"), F.lit(FILTER_BITS))
        return df.withColumn("_word", F.shiftright(place, 6)).withColumn("_bit", place.bitwiseAND(F.lit(63)).cast("int"))

    bits = at(keys.select("scope", "docId")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return at(rows).join(F.broadcast(bits), "_word").where(F.getbit("_bits", F.col("_bit")) == 1).select(*rows.columns)


#: A row as `folded` reads and writes it: the payload as JSON.
_FOLDED = "scope string, docId string, aType string, aUid string, axbType string, bType string, bUid string, data string, v int, createdAt timestamp, updatedAt timestamp, missing boolean"


def folded(old: DataFrame, delta: DataFrame, now: str) -> DataFrame:
    """The rows that changes (CHANGES and docId) make of the old rows, with `missing` rows for updates of nothing.

    Each row's changes come in their order to one task, after the row itself, and
    are folded as they pass: however many there are, one payload is held.
    """
    stamp = F.lit(now).cast("timestamp")
    ends = ["scope", "docId", "aType", "aUid", "axbType", "bType", "bUid"]
    first = old.select(*ends, F.to_json("data").alias("data"), "v", F.lit("row").alias("op"), F.lit(None).cast("long").alias("seq"), "createdAt", stamp.alias("now"))
    then = delta.select(*ends, "data", "v", "op", "seq", F.lit(None).cast("timestamp").alias("createdAt"), stamp.alias("now"))
    steps = first.union(then).repartition("scope", "docId").sortWithinPartitions("scope", "docId", F.col("seq").asc_nulls_first())

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, row, payload, version, made, missing = None, None, None, None, None, False
        names = [c.split()[0] for c in _FOLDED.split(", ")]

        def done() -> list[tuple]:
            out = [(*row[:7], None, None, None, row.now, True)] if missing else []
            return out if payload is None else [*out, (*row[:7], payload, version, made, row.now, False)]

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"v": "Int32", "createdAt": "datetime64[ns]", "updatedAt": "datetime64[ns]"})

        for batch in batches:
            out: list[tuple] = []
            for step in batch.itertuples(index=False):
                if (step.scope, step.docId) != key:
                    out += done() if key else []
                    key, row, payload, version, made, missing = (step.scope, step.docId), step, None, None, None, False
                stamped = None if pd.isna(step.v) else int(step.v)
                if step.op == "row":
                    payload, version, made = step.data, stamped, step.createdAt
                elif step.op == "remove":
                    payload, version = None, None
                elif step.op == "update" and payload is None:
                    missing = True
                else:
                    fresh = step.op == "replace" or payload is None
                    version = stamped if fresh or stamped is not None else version
                    payload = patch.apply_patch("{}" if fresh else payload, [tuple(o) for o in _operations(step.data)])
                    if step.op != "update":
                        row, made = step, step.now
            yield frame(out)
        if key:
            yield frame(done())

    return steps.mapInPandas(fold, _FOLDED).withColumn("data", F.parse_json("data"))


def _operations(value: str | None) -> list:
    """The operations of a change: a list of them, or a payload whose leaves are set."""
    got = json.loads(value) if value else []
    return patch.flatten_patch(got) if isinstance(got, dict) else got


def change(op: str, seq: int, a: tuple[str, str], axb_type: str = NODE, b: tuple[str, str] | None = None, data: dict | None = None, v: int | None = None, scope: str = "") -> tuple:
    """One row of a change set; a patch travels as its operations."""
    b = b or a
    if op not in OPS:
        raise invalid(f"unknown change {op!r}")
    operations = patch.flatten_patch(data or {}, allow_delete=op == "update")
    return (scope, *a, axb_type, *b, json.dumps(operations), v, op, seq)


def changes_of(rows: DataFrame, op: str, seq: int = 0, data: dict | None = None) -> DataFrame:
    """A change of each row of a triple table: by its own payload, or by one patch for all."""
    if op not in OPS:
        raise invalid(f"unknown change {op!r}")
    own = F.to_json("data") if data is None else F.lit(json.dumps(patch.flatten_patch(data, allow_delete=op == "update")))
    return rows.select("scope", "aType", "aUid", "axbType", "bType", "bUid", own.alias("data"), "v", F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"))


def last_writer(rows: DataFrame) -> DataFrame:
    """One row for each (scope, docId): that updated last."""
    w = Window.partitionBy("scope", "docId").orderBy(F.desc("updatedAt"), F.desc("createdAt"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
