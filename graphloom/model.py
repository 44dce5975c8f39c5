"""The triple table: one row shape for nodes and edges.

A node is the self-loop (type, uid) -is-> (type, uid).  `scope` is the path of
the nested graph a row lives in (`uid/name/uid/name`, empty at the root), and
`data` is a schemaless payload (VARIANT).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError, invalid

NODE = "is"
TRIPLE_SCHEMA = "scope string, docId string, aType string, aUid string, axbType string, bType string, bUid string, data variant, v int, createdAt timestamp, updatedAt timestamp"
COLUMNS = [c.split()[0] for c in TRIPLE_SCHEMA.split(", ")]
ENVELOPE = ("aType", "aUid", "axbType", "bType", "bUid", "createdAt", "updatedAt")
EPOCH = "2024-01-01 00:00:00"


def edge_doc_id(a_uid: str, axb_type: str, b_uid: str) -> str:
    key = f"{a_uid}:{axb_type}:{b_uid}"
    return f"{hashlib.sha256(key.encode()).hexdigest()[0]}:{key}"


def doc_id_column(a: str = "aUid", x: str = "axbType", b: str = "bUid") -> Column:
    """A node's id is its uid; an edge's starts with a hash digit that spreads keys."""
    key = F.concat_ws(":", a, x, b)
    edge = F.concat_ws(":", F.substring(F.sha2(key, 256), 1, 1), key)
    return F.when((F.col(x) == NODE) & (F.col(a) == F.col(b)), F.col(a)).otherwise(edge)


def type_uid_column(meta: Column, name: Column) -> Column:
    """The deterministic uid of a type definition."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat_ws(":", meta, name), 256))), "+/", "-_"), 1, 21)


def child_scope(scope: str, uid: str, name: str) -> str:
    for part in (uid, name):
        if not part or "/" in part:
            raise GraphError("INVALID_SCOPE", f"{part!r} can't be part of a scope")
    return "/".join(p for p in (scope, uid, name) if p)


def scope_names(scope: str) -> str:
    """The graph names of a scope, without the uids between them."""
    parts = scope.split("/") if scope else []
    if len(parts) % 2:
        raise GraphError("INVALID_SCOPE", f"{scope!r} isn't made of uid/name pairs")
    return "/".join(parts[1::2])


def is_ancestor(scope: Column, uid: Column) -> Column:
    """Whether uid is one of the nodes that a scope is nested in."""
    parts = F.split(scope, "/")
    return F.exists(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p)), lambda p: F.coalesce(p == uid, F.lit(False)))


def scope_names_column(scope: Column) -> Column:
    """`scope_names` of a column of scopes; null where one isn't made of uid/name pairs."""
    parts = F.split(scope, "/")
    names = F.filter(parts, lambda _, i: i % 2 == 1)
    return F.when(scope == "", F.lit("")).when(F.size(parts) % 2 == 0, F.array_join(names, "/"))


def scope_pattern(pattern: str) -> str:
    """A glob of graph names as a regular expression over names that each end in a slash."""
    if pattern == "root":
        return "^$"
    return "^" + "".join({"*": "[^/]+/", "**": "(?:[^/]+/)*"}.get(w, re.escape(w) + "/") for w in pattern.split("/")) + "$"


def in_scope(scope: Column, patterns: list[str]) -> Column:
    """Whether a column of scopes fits one of the globs, as `matches_scope` tells of their names."""
    names = scope_names_column(scope)
    slashed = F.when(names == "", F.lit("")).otherwise(F.concat(names, F.lit("/")))
    return F.coalesce(slashed.rlike("|".join(f"(?:{scope_pattern(p)})" for p in patterns)), F.lit(False))


def matches_scope(pattern: str, scope_path: str) -> bool:
    """Whether a path of graph names fits a glob: * is one name, ** any number, root the empty path."""
    if pattern == "root":
        return scope_path == ""
    want, have = pattern.split("/"), scope_path.split("/") if scope_path else []
    reach = {0}
    for w in want:
        if w == "**":
            reach = {k for start in reach for k in range(start, len(have) + 1)}
        else:
            reach = {k + 1 for k in reach if k < len(have) and w in ("*", have[k])}
    return len(have) in reach


def triples(df: DataFrame, a_type: str | Column, a_uid: Column, axb_type: str, b_type: str | Column, b_uid: Column, data: dict[str, Column] | None = None, scope: Column | None = None) -> DataFrame:
    """Rows of the triple table from columns of any table."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    payload = F.to_variant_object(F.struct(*[c.alias(k) for k, c in data.items()])) if data else F.parse_json(F.lit("{}"))
    out = df.select(
        F.coalesce(scope, F.lit("")).alias("scope") if scope is not None else F.lit("").alias("scope"),
        as_col(a_type).alias("aType"), a_uid.alias("aUid"), F.lit(axb_type).alias("axbType"), as_col(b_type).alias("bType"), b_uid.alias("bUid"),
        payload.alias("data"), F.lit(None).cast("int").alias("v"), F.lit(EPOCH).cast("timestamp").alias("createdAt"), F.lit(EPOCH).cast("timestamp").alias("updatedAt"),
    )
    return out.withColumn("docId", doc_id_column()).select("scope", "docId", "aType", "aUid", "axbType", "bType", "bUid", "data", "v", "createdAt", "updatedAt")


def nodes(df: DataFrame, kind: str, uid: Column, data: dict[str, Column] | None = None, scope: Column | None = None) -> DataFrame:
    return triples(df, kind, uid, NODE, kind, uid, data, scope)


__all__ = ["NODE", "TRIPLE_SCHEMA", "COLUMNS", "ENVELOPE", "EPOCH", "edge_doc_id", "doc_id_column", "type_uid_column", "child_scope", "scope_names", "is_ancestor", "matches_scope", "scope_names_column", "scope_pattern", "in_scope", "triples", "nodes", "invalid"]
