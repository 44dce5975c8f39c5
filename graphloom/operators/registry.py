"""Types of triples: JSON-Schema validation, scope rules and migrations on read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.schema import schema_errors, violations
from graphloom.model import NODE, in_scope, matches_scope, scope_names, scope_names_column

@dataclass
class Entry:
    """One kind of triple; migrations are Spark SQL expressions over `data` (JSON) from version to version."""

    aType: str
    axbType: str = NODE
    bType: str | None = None
    json_schema: dict | None = None
    allowed_in: list[str] = field(default_factory=list)
    target_graph: str | None = None
    migrations: list[tuple[int, int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.bType = self.bType or self.aType
        starts = [a for a, _, _ in self.migrations]
        if len(set(starts)) != len(starts) or any(b <= a for a, b, _ in self.migrations):
            raise GraphError("MIGRATION_ERROR", "migrations go up, one from each version")
        at, steps = 0, {a: b for a, b, _ in self.migrations}
        while steps and at != self.version:
            if at not in steps:
                raise GraphError("MIGRATION_ERROR", f"no migration from version {at}")
            at = steps[at]

    @property
    def version(self) -> int:
        return max((b for _, b, _ in self.migrations), default=0)


class Registry:
    def __init__(self, entries: list[Entry]):
        self.entries = {(e.aType, e.axbType, e.bType): e for e in entries}

    def merged(self, extension: Registry) -> Registry:
        """Both registries; where both know a triple, this one wins."""
        return Registry([*extension.entries.values(), *self.entries.values()])

    def target_graph(self, axb_type: str) -> str | None:
        """The graph that a relation's edges live in, where all its entries agree on one."""
        named = {e.target_graph for e in self.entries.values() if e.axbType == axb_type}
        return named.pop() if len(named) == 1 else None

    def topology(self, a_type: str | None = None) -> list[tuple[str, str, str, str | None]]:
        """(source type, relation, target type, target graph) of all edges, or of those from one type."""
        return sorted((e.aType, e.axbType, e.bType, e.target_graph) for e in self.entries.values() if e.axbType != NODE and a_type in (None, e.aType))

    def stamped(self, rows: DataFrame) -> DataFrame:
        """Rows to write with `v` set to their entry's version; entries without migrations leave it null."""
        stamp = F.lit(None).cast("int")
        for (a, x, b), e in self.entries.items():
            if e.version:
                stamp = F.when((F.col("aType") == a) & (F.col("axbType") == x) & (F.col("bType") == b), F.lit(e.version)).otherwise(stamp)
        return rows.withColumn("v", stamp)

    def outdated(self, rows: DataFrame) -> DataFrame:
        """Rows whose version is below that of their entry."""
        return rows.where(self.is_outdated())

    def is_outdated(self) -> Column:
        due = F.lit(False)
        for (a, x, b), e in self.entries.items():
            due = due | ((F.col("aType") == a) & (F.col("axbType") == x) & (F.col("bType") == b) & (F.coalesce("v", F.lit(0)) < e.version))
        return due

    def validate(self, a_type: str, axb_type: str, b_type: str, data: object, scope: str = "") -> None:
        entry = self.entries.get((a_type, axb_type, b_type))
        if entry is None:
            raise GraphError("REGISTRY_VIOLATION", f"({a_type}, {axb_type}, {b_type}) isn't registered")
        if entry.allowed_in and not any(matches_scope(p, scope_names(scope)) for p in entry.allowed_in):
            raise GraphError("REGISTRY_SCOPE", f"{a_type} {axb_type} {b_type} isn't allowed in {scope_names(scope) or 'root'}")
        errors = schema_errors(entry.json_schema or {}, data)
        if errors:
            raise GraphError("VALIDATION_ERROR", "; ".join(errors[:20]))

    def audit(self, rows: DataFrame) -> DataFrame:
        """The rows that validate() would refuse, with `violation`; the schemas are columns, so no payload leaves the JVM."""
        why = F.concat(F.lit("REGISTRY_VIOLATION: ("), F.concat_ws(", ", "aType", "axbType", "bType"), F.lit(") isn't registered"))
        for (a, x, b), e in self.entries.items():
            told = violations(e.json_schema or True, F.col("data"))
            refused = F.when(F.size(told) > 0, F.concat(F.lit("VALIDATION_ERROR: "), F.array_join(F.slice(told, 1, 20), "; ")))
            if e.allowed_in:
                names = scope_names_column(F.col("scope"))
                at = F.when(names == "", F.lit("root")).otherwise(F.coalesce(names, F.col("scope")))
                refused = F.when(~in_scope(F.col("scope"), e.allowed_in), F.concat(F.lit(f"REGISTRY_SCOPE: {a} {x} {b} isn't allowed in "), at)).otherwise(refused)
            why = F.when((F.col("aType") == a) & (F.col("axbType") == x) & (F.col("bType") == b), refused).otherwise(why)
        return rows.withColumn("violation", why).where("violation is not null")

    def migrated(self, rows: DataFrame) -> DataFrame:
        """Rows with payloads of older versions brought to the latest, step by step.

        In a step `data` is a variable of its own, the payload as JSON, so a step is free to
        have that word in a text; each step's result is worked out once, for the next one.
        """
        state = None
        for (a, x, b), e in self.entries.items():
            if not e.migrations:
                continue
            own = "named_struct('j', to_json(data), 'v', v)"
            for k, (start, end, step) in enumerate(sorted(e.migrations)):
                own = f"element_at(transform(array({own}), s{k} -> if(coalesce(s{k}.v, 0) = {start}, named_struct('j', element_at(transform(array(s{k}.j), data -> {step}), 1), 'v', {end}), s{k})), 1)"
            mine = (F.col("aType") == a) & (F.col("axbType") == x) & (F.col("bType") == b) & (F.coalesce("v", F.lit(0)) < e.version)
            state = F.when(mine, F.expr(own)) if state is None else state.when(mine, F.expr(own))
        if state is None:
            return rows
        columns = rows.columns
        rows = rows.withColumn("_state", state)
        done = F.col("_state").isNotNull()
        return rows.withColumn("data", F.when(done, F.parse_json("_state.j")).otherwise(F.col("data"))).withColumn("v", F.when(done, F.col("_state.v")).otherwise(F.col("v"))).select(*columns)
