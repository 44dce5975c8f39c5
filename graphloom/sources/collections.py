"""Plain tables beside the graph: found by descriptors in folders, read by path template, served in pages.

A descriptor (`collections/<name>/collection.json`) gives the path, perhaps with
parameters in braces, a constant type filter, the fields and the order of pages.
"""

from __future__ import annotations

import json
import operator
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import GraphError, invalid
from graphloom.sources.folders import kept
from graphloom.sources.parts import PartTable

_PARAMETER = re.compile(r"\{(\w+)\}")
_FIELD = re.compile(r"[A-Za-z_][\w.]*")
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Collection:
    name: str
    path: str
    type_field: str | None = None
    type_value: object = None
    order_by: str | None = None
    descending: bool = False
    fields: tuple[str, ...] = ()  # those that filters may name; none: all
    parent_type: str | None = None
    description: str = ""

    def located(self, params: dict[str, str] | None = None) -> str:
        """The path with its parameters filled in; each is one path segment."""

        def fill(m: re.Match) -> str:
            value = (params or {}).get(m[1])
            if not value or "/" in value or value in (".", ".."):
                raise invalid(f"the path of {self.name} needs {m[1]} as one segment")
            return value

        return _PARAMETER.sub(fill, self.path)


def discover_collections(folder: str) -> tuple[dict[str, Collection], list[str]]:
    """The collections that a folder describes, and warnings about descriptors that can't be used."""
    found, warnings, root = {}, [], f"{folder}/collections"
    for name in sorted(e.name for e in os.scandir(root) if e.is_dir()) if os.path.isdir(root) else []:
        try:
            with open(f"{root}/{name}/collection.json") as f:
                told = json.load(f)
            order = told.get("orderBy") or {}
            fields: tuple[str, ...] = ()
            if os.path.exists(f"{root}/{name}/schema.json"):
                with open(f"{root}/{name}/schema.json") as f:
                    fields = tuple(json.load(f).get("properties", {}))
            found[name] = Collection(name, told["path"], told.get("typeField"), told.get("typeValue"), order.get("field"), order.get("direction") == "desc", fields, told.get("parentNodeType"), told.get("description", ""))
        except (OSError, ValueError, KeyError, AttributeError) as e:
            warnings.append(f"collection {name} is left out: {type(e).__name__}")
    return found, warnings


def read_collection(spark: SparkSession, root: str, collection: Collection, params: dict[str, str] | None = None) -> DataFrame:
    """The documents of a collection that lies as Parquet under root, of its type only."""
    return of_type(spark.read.parquet(f"{root}/{collection.located(params)}"), collection)


class CollectionStore:
    """Versions of a collection's documents; a commit writes only the buckets of ids that it touches.

    schema is that of the documents, with a string id.  Every write takes an optimistic condition: the
    version that it is based on (CONFLICT if there is a newer one), and for updates and deletions a
    column that must hold for each document as it is now (CONFLICT if it doesn't for one; nothing is written).
    """

    def __init__(self, spark: SparkSession, root: str, collection: Collection, schema: str, params: dict[str, str] | None = None, id_col: str = "id", buckets: int = 16):
        self.spark, self.collection, self.schema, self.id_col, self._buckets = spark, collection, schema, id_col, buckets
        self.table = PartTable(spark, f"{root}/{collection.located(params)}", ("_bucket",))
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]

    def version(self) -> int:
        return self.table.latest()

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of the collection's type."""
        return of_type(self._read(self.version() if version is None else version).select(*self.columns), self.collection)

    def _read(self, version: int, only: list | None = None) -> DataFrame:
        return self.table.read(f"{self.schema}, _bucket int", version, only)

    def _settings(self, base: int) -> dict:
        return self.table.marker(base)["settings"] or {"buckets": self._buckets}

    def _placed(self, docs: DataFrame, base: int) -> DataFrame:
        return docs.withColumn("_bucket", F.pmod(F.xxhash64(F.col(self.id_col)), F.lit(self._settings(base)["buckets"])).cast("int"))

    def _typed(self, docs: DataFrame) -> DataFrame:
        """docs with the collection's type set."""
        c = self.collection
        return docs if c.type_field is None or c.type_value is None else docs.withColumn(c.type_field, F.lit(c.type_value))

    def create(self, docs: DataFrame, base: int | None = None) -> int:
        """Add documents, of which each lacks an id or has one that isn't taken (else CONFLICT): the new version."""
        base = self.version() if base is None else base
        new = docs.withColumn(self.id_col, F.coalesce(F.col(self.id_col), F.uuid()) if self.id_col in docs.columns else F.uuid())
        new = self._typed(new)
        for name in set(self.columns) - set(new.columns):
            new = new.withColumn(name, F.lit(None))
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        new = kept(self._placed(new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in self.columns]), base))  # so an id stays what it is
        touched = [part for part, _ in self.table.touched(new)]
        there = self._read(base, touched)
        if not there.join(new, self.id_col, "left_semi").isEmpty() or not new.groupBy(self.id_col).count().where("count > 1").isEmpty():
            raise GraphError("CONFLICT", f"a document of {self.collection.name} has an id that is taken")
        return self._commit(there.unionByName(new), base, touched)

    def update(self, patches: DataFrame, base: int | None = None, expected: Column | None = None) -> int:
        """Merge patches (the id, and columns to set) into documents: what they don't name stays, the type too."""
        base = self.version() if base is None else base
        names = [c for c in patches.columns if c != self.id_col]
        if not names or not set(names) <= set(self.columns):
            raise invalid("an update sets columns of the collection")
        touched, there, found, _ = self._found(patches, base, expected)
        named = found.join(patches.select(self.id_col, F.struct(*names).alias("_new")), self.id_col)
        changed = self._typed(named.withColumns({n: F.col(f"_new.{n}") for n in names})).select(*self.columns, "_bucket")
        return self._commit(there.join(patches, self.id_col, "left_anti").select(*self.columns, "_bucket").unionByName(changed), base, touched)

    def delete(self, ids: DataFrame, base: int | None = None, expected: Column | None = None) -> int:
        """Drop the documents with these ids."""
        base = self.version() if base is None else base
        touched, there, _, keys = self._found(ids, base, expected)
        return self._commit(there.join(keys, self.id_col, "left_anti").select(*self.columns, "_bucket"), base, touched)

    def _found(self, named: DataFrame, base: int, expected: Column | None) -> tuple:
        """The touched buckets, their documents, and those that are named: NOT_FOUND if one isn't there or isn't of the type."""
        keys = self._placed(named.select(self.id_col), base)
        touched = [part for part, _ in self.table.touched(keys)]
        if not keys.groupBy(self.id_col).count().where("count > 1").isEmpty():
            raise invalid("a write names each document once")
        there = self._read(base, touched)
        found = of_type(there, self.collection).join(keys.select(self.id_col), self.id_col, "left_semi")
        if not keys.join(found, self.id_col, "left_anti").isEmpty():
            raise GraphError("NOT_FOUND", f"a document of {self.collection.name} isn't there")
        if expected is not None and not found.where(~F.coalesce(expected, F.lit(False))).isEmpty():
            raise GraphError("CONFLICT", f"a document of {self.collection.name} isn't as expected")
        return touched, there, found, keys.select(self.id_col)

    def _commit(self, docs: DataFrame, base: int, touched: list) -> int:
        return self.table.write(docs, base, touched, self._settings(base), [self.id_col])


def of_type(docs: DataFrame, collection: Collection) -> DataFrame:
    if collection.type_field is None or collection.type_value is None:
        return docs
    return docs.where(F.col(collection.type_field) == F.lit(collection.type_value))


def collection_page(docs: DataFrame, collection: Collection, id_col: str = "id", where: tuple = (), cursor: object = None, limit: int = 50) -> DataFrame:
    """One page with `hasMore`, after the document whose id is the cursor.

    Filters with unknown operators or fields are skipped; documents without the
    field of the order are in no page; ties go by id, in the order's direction.
    """
    limit = max(1, min(100, limit))
    docs = whole = of_type(docs, collection)
    for name, op, value in where:
        known = name in collection.fields if collection.fields else _FIELD.fullmatch(name)
        if known and op in _COMPARE:
            docs = docs.where(_COMPARE[op](F.col(name), F.lit(value)))
    keys = [c for c in (collection.order_by, id_col) if c]
    docs = docs.where(F.col(keys[0]).isNotNull())
    if cursor is not None:
        last = whole.where(F.col(id_col) == F.lit(cursor)).select(F.struct(*keys).alias("_last")).limit(1)
        if last.isEmpty():
            raise GraphError("NOT_FOUND", f"the cursor {cursor!r} is no document of {collection.name}")
        here = F.struct(*keys)
        docs = docs.crossJoin(F.broadcast(last))  # one row
        docs = docs.where(here < F.col("_last") if collection.descending else here > F.col("_last")).drop("_last")
    order = [F.col(k).desc() if collection.descending else F.col(k).asc() for k in keys]
    some = docs.orderBy(*order).limit(limit + 1)
    total = some.agg((F.count("*") > limit).alias("hasMore"))
    return some.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))  # one row
