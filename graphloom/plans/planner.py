"""Checks and choices that need no data: access path, scan safety, limits."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from graphloom.errors import GraphError, invalid
from graphloom.model import ENVELOPE, NODE, edge_doc_id

DEFAULT_LIMIT = 500
#: Any one of these sets of fields makes a query selective.
SELECTIVE = ({"aUid", "axbType"}, {"axbType", "bUid"}, {"aType", "axbType"}, {"axbType", "bType"})

Filter = tuple[str, str, object]


@dataclass
class Find:
    """What to find: equality on the envelope, further filters, order and limit."""

    aType: str | None = None
    aUid: str | None = None
    axbType: str | None = None
    bType: str | None = None
    bUid: str | None = None
    where: list[Filter] = field(default_factory=list)
    order_by: tuple[str, str] | None = None
    limit: int | None = None

    def filters(self) -> list[Filter]:
        named = [(f, "==", getattr(self, f)) for f in ("aType", "aUid", "axbType", "bType", "bUid") if getattr(self, f) is not None]
        return named + list(self.where)


def effective_limit(limit: int | None) -> int | None:
    """None means 500 rows, 0 means all."""
    if limit is not None and limit < 0:
        raise invalid("a limit can't be negative")
    return DEFAULT_LIMIT if limit is None else (limit or None)


def point_key(find: Find) -> str | None:
    """The document id, where both ends and the relation are given and nothing else filters."""
    if find.aUid and find.axbType and find.bUid and not find.where:
        return find.aUid if find.axbType == NODE and find.aUid == find.bUid else edge_doc_id(find.aUid, find.axbType, find.bUid)
    return None


def key_filters(doc_id: str) -> list[Filter]:
    """What a document id says of its row: a node's uid, or an edge's ends and relation."""
    parts = doc_id.split(":")
    if len(parts) == 1:
        return [("aUid", "==", doc_id), ("axbType", "==", NODE)]
    if len(parts) == 4:
        return [("aUid", "==", parts[1]), ("axbType", "==", parts[2]), ("bUid", "==", parts[3])]
    return []


def is_selective(filters: list[Filter]) -> bool:
    given = {f for f, _, _ in filters if f in ENVELOPE}
    return any(s <= given for s in SELECTIVE)


def guard(filters: list[Filter], mode: str = "error", allow_scan: bool = False) -> str | None:
    """Refuse (or, with mode warn, warn of) a query that would read a whole graph."""
    if mode == "off" or allow_scan or is_selective(filters):
        return None
    message = "the filters don't narrow the query; add a relation and one end, or allow the scan"
    if mode == "error":
        raise GraphError("QUERY_SAFETY", message)
    warnings.warn(message, stacklevel=3)
    return message
