"""Deep-merge patches: nested dicts become operations on paths, applied to JSON payloads."""

from __future__ import annotations

import json

from graphloom.errors import invalid


class _Delete:
    def __repr__(self) -> str:
        return "DELETE"


#: Marks a field for removal in an update.
DELETE = _Delete()


def flatten_patch(patch: dict, allow_delete: bool = True) -> list[tuple[list[str], str, object]]:
    """(path, set or remove, value) for each leaf; lists and empty dicts are leaves."""
    out: list[tuple[list[str], str, object]] = []

    def plain(value: object) -> None:
        if value is DELETE:
            raise invalid("a deletion can't stand inside a list")
        if isinstance(value, list):
            for v in value:
                plain(v)
        elif isinstance(value, dict):
            for v in value.values():
                plain(v)
        elif not isinstance(value, str | int | float | bool | None) or value != value:
            raise invalid(f"{type(value).__name__} isn't JSON")

    def walk(node: dict, path: list[str]) -> None:
        for key, value in node.items():
            if not isinstance(key, str) or not key:
                raise invalid("keys are strings that aren't empty")
            here = [*path, key]
            if value is DELETE:
                if not allow_delete:
                    raise invalid("only an update can delete a field")
                out.append((here, "remove", None))
            elif isinstance(value, dict) and value:
                walk(value, here)
            else:
                plain(value)
                out.append((here, "set", value))

    walk(patch, [])
    return out


def apply_patch(payload: str | None, operations: list[tuple[list[str], str, object]]) -> str:
    """A JSON payload after the operations, removals first; a scalar on the way becomes an object."""
    data = json.loads(payload) if payload else {}
    for path, kind, value in sorted(operations, key=lambda o: o[1] == "set"):
        node = data
        for key in path[:-1]:
            if not isinstance(node.get(key), dict):
                if kind == "remove":
                    break
                node[key] = {}
            node = node[key]
        else:
            if kind == "remove":
                node.pop(path[-1], None)
            else:
                node[path[-1]] = value
    return json.dumps(data, separators=(",", ":"), sort_keys=True)
