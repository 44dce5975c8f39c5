"""Type definitions from folders or from the graph itself, and what follows from a schema.

A folder holds nodes/<type>/schema.json and edges/<relation>/{edge,schema}.json;
meta.json beside a schema may give allowedIn and migrations.  In a graph,
definitions are nodes of the types nodeType and edgeType.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os

from pyspark.sql import types as T
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.model import NODE
from graphloom.operators.graph import Graph
from graphloom.operators.registry import Entry, Registry
from graphloom.sources.store import change

META = ("nodeType", "edgeType")
#: Definitions that one graph may hold; they are read to the driver.
MOST_TYPES = 10_000


def type_uid(meta: str, name: str) -> str:
    return base64.urlsafe_b64encode(hashlib.sha256(f"{meta}:{name}".encode()).digest()).decode()[:21]


def _load(path: str, needed: bool = False):
    if not os.path.exists(path):
        if needed:
            raise GraphError("DISCOVERY_ERROR", f"{path} is missing")
        return None
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except ValueError as e:
        raise GraphError("DISCOVERY_ERROR", f"{path} isn't JSON") from e


def _steps(migrations: list[dict] | None) -> list[tuple[int, int, str]]:
    return [(m["fromVersion"], m["toVersion"], m["up"]) for m in migrations or []]


def _edges(name: str, edge: dict, schema: dict | None, meta: dict) -> list[Entry]:
    if not edge.get("from") or not edge.get("to"):
        raise GraphError("DISCOVERY_ERROR", f"relation {name} needs from and to")
    ends = [[x] if isinstance(x, str) else x for x in (edge["from"], edge["to"])]
    return [Entry(a, name, b, schema, meta.get("allowedIn", []), edge.get("targetGraph"), _steps(meta.get("migrations"))) for a in ends[0] for b in ends[1]]


def discover(folder: str) -> tuple[Registry, list[str]]:
    """The registry of a folder, and warnings about relations between types that it lacks."""
    kinds = lambda sub: sorted(e.name for e in os.scandir(f"{folder}/{sub}") if e.is_dir()) if os.path.isdir(f"{folder}/{sub}") else []
    entries, warnings = [], []
    for name in kinds("nodes"):
        at = f"{folder}/nodes/{name}"
        meta = _load(f"{at}/meta.json") or {}
        entries.append(Entry(name, json_schema=_load(f"{at}/schema.json", True), allowed_in=meta.get("allowedIn", []), migrations=_steps(meta.get("migrations"))))
    known = {e.aType for e in entries}
    for name in kinds("edges"):
        at = f"{folder}/edges/{name}"
        made = _edges(name, _load(f"{at}/edge.json", True), _load(f"{at}/schema.json"), _load(f"{at}/meta.json") or {})
        warnings += [f"relation {name} names the unknown type {t}" for t in sorted({t for e in made for t in (e.aType, e.bType)} - known)]
        entries += made
    return Registry(entries), warnings


def define_node_type(seq: int, name: str, json_schema: dict, **more: object) -> tuple:
    """A change row that defines (or replaces) a node type."""
    if name in META:
        raise GraphError("DYNAMIC_REGISTRY", f"{name} is a reserved name")
    return change("replace", seq, (META[0], type_uid(META[0], name)), data={"name": name, "jsonSchema": json_schema, **more})


def define_edge_type(seq: int, name: str, source: str | list[str], target: str | list[str], **more: object) -> tuple:
    if name in META or name == NODE:
        raise GraphError("DYNAMIC_REGISTRY", f"{name} is a reserved name")
    return change("replace", seq, (META[1], type_uid(META[1], name)), data={"name": name, "from": source, "to": target, **more})


def registry_of(graph: Graph, static: Registry | None = None) -> Registry:
    """The registry that a graph's own definitions make; static entries win over it."""
    rows = graph.rows.where(F.col("aType").isin(*META) & (F.col("axbType") == NODE)).select("aType", F.to_json("data").alias("data")).orderBy("docId").limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise GraphError("DYNAMIC_REGISTRY", f"more than {MOST_TYPES} type definitions")
    entries = []
    for row in rows:
        d = json.loads(row["data"])
        if row["aType"] == META[0]:
            entries.append(Entry(d["name"], json_schema=d.get("jsonSchema"), allowed_in=d.get("allowedIn", []), migrations=_steps(d.get("migrations"))))
        else:
            entries += _edges(d["name"], d, d.get("jsonSchema"), d)
    own = Registry(entries)
    return static.merged(own) if static else own


def struct_of(schema: dict) -> T.DataType:
    """The Spark type of payloads that fit a JSON Schema; open objects and mixed types are VARIANT."""
    kinds = schema.get("type")
    kinds = [k for k in ([kinds] if isinstance(kinds, str) else kinds or []) if k != "null"]
    if len(kinds) != 1:
        values = schema.get("enum") or []
        return T.StringType() if values and all(isinstance(v, str) for v in values) else T.VariantType()
    kind = kinds[0]
    if kind == "object":
        known = schema.get("properties")
        if not known:
            return T.VariantType()
        needed = set(schema.get("required", []))
        return T.StructType([T.StructField(n, struct_of(s), n not in needed) for n, s in known.items()])
    if kind == "array":
        return T.ArrayType(struct_of(schema.get("items") or {}))
    return {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.VariantType())


def typed_payloads(graph: Graph, entry: Entry):
    """The rows of one entry with the payload's fields as columns after docId."""
    kind = struct_of(entry.json_schema or {})
    if not isinstance(kind, T.StructType):
        raise GraphError("VALIDATION_ERROR", f"{entry.aType} has no object schema with properties")
    rows = graph.rows.where((F.col("aType") == entry.aType) & (F.col("axbType") == entry.axbType) & (F.col("bType") == entry.bType))
    return rows.select("docId", *[F.try_variant_get("data", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in kind])


def field_rules(schema: dict, prefix: str = "") -> list[dict]:
    """A flat list of a schema's fields: path, type, required, and limits where it has some."""
    out, needed = [], set(schema.get("required", []))
    for name, s in (schema.get("properties") or {}).items():
        limits = {k: s[k] for k in ("enum", "minLength", "maxLength", "pattern", "minimum", "maximum", "description") if k in s}
        out.append({"path": prefix + name, "type": s.get("type", "enum" if "enum" in s else "any"), "required": name in needed, **limits})
        if s.get("type") == "object":
            out += field_rules(s, f"{prefix}{name}.")
    return out
