"""Nearest neighbours, geo search and ranked full text over one graph."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.errors import invalid
from graphloom.functions import distance, patch, paths
from graphloom.model import COLUMNS
from graphloom.operators.graph import Graph
from graphloom.plans.planner import Find
from graphloom.sources.folders import kept


def _narrowed(graph: Graph, find: Find | None) -> DataFrame:
    filters = find.filters() if find else []
    return graph._where(graph.candidates(filters), filters)


def find_nearest(graph: Graph, field: str, query: list[float], limit: int | None, measure: str = "EUCLIDEAN", threshold: float | None = None, find: Find | None = None, result_field: str | None = None) -> DataFrame:
    """Exact nearest neighbours, with `distance`; rows without a comparable vector drop out.

    A limit of None gives all rows within the threshold, in no order.  With result_field the distance
    is also set in each payload, at that path.
    """
    path = paths.data_path(field)
    if path is None or not query or measure not in distance.MEASURES or (threshold is None if limit is None else not 1 <= limit <= 1000):
        raise invalid("find_nearest needs a data field, a vector, a known measure, and a limit of 1 to 1000 or a threshold")
    vector = F.try_variant_get("data", path, "array<double>")
    rows = _narrowed(graph, find).withColumn("distance", distance.vector_distance(vector, query, measure)).where("distance is not null")
    most = measure == "DOT_PRODUCT"
    if threshold is not None:
        rows = rows.where(F.col("distance") >= threshold if most else F.col("distance") <= threshold)
    order = [F.desc("distance") if most else F.asc("distance"), F.col("docId")]
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    if result_field is None:
        return rows
    at = paths.data_path(result_field)
    if at in (None, "$"):
        raise invalid("the distance needs a field within data")
    keys = at.split(".")[1:]

    @F.pandas_udf(StringType())
    def with_distance(payload: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([patch.apply_patch(p, [(keys, "set", float(d))]) for p, d in zip(payload, found, strict=True)], dtype=object)

    rows = rows.withColumn("data", F.parse_json(with_distance(F.to_json("data"), "distance")))
    return rows if limit is None else rows.orderBy(*order)


def geo_search(graph: Graph, lat_field: str, lng_field: str, lat: float, lng: float, radius: float, limit: int, by_distance: bool = True, find: Find | None = None) -> DataFrame:
    """Rows within a radius in metres, with `distance`; a band of latitudes prunes first."""
    if not (-90 <= lat <= 90 and -180 <= lng <= 180) or radius <= 0 or limit < 1:
        raise invalid("geo_search needs a point on earth, a radius and a limit")
    at, on = (paths.typed(paths.data_path(f), "number") for f in (lat_field, lng_field))
    band = radius / distance.EARTH_METRES * 57.29577951308232 + 1e-9
    rows = _narrowed(graph, find).where(at.between(lat - band, lat + band))
    rows = rows.withColumn("distance", distance.haversine(at, on, lat, lng)).where(F.col("distance") <= radius)
    return rows.orderBy(*([F.col("distance")] if by_distance else []), "docId").limit(limit)


#: Hits up to which a search sends them to all rows instead of shuffling these.
FEW_HITS = 10_000
_LETTER = r"[\p{L}\p{N}]"
_OTHER = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Match:
    """A condition on the words of a text: made by words, phrase, prefix and near, combined by &, | and ~."""

    op: str
    parts: tuple

    def __and__(self, other: Match) -> Match:
        return Match("and", (self, other))

    def __or__(self, other: Match) -> Match:
        return Match("or", (self, other))

    def __invert__(self) -> Match:
        return Match("not", (self,))

    def units(self) -> list[Match]:
        """The distinct words, phrases, prefixes and windows that it counts."""
        if self.op in ("phrase", "prefix", "near"):
            return [self]
        return list(dict.fromkeys(u for part in self.parts for u in part.units()))


def _split(text: str) -> tuple[str, ...]:
    found = tuple(w for w in re.split(r"[^\w]+|_", text.lower()) if w)
    if not found:
        raise invalid("a text condition needs a word")
    return found


def phrase(text: str) -> Match:
    """The words of the text, one after the other."""
    return Match("phrase", _split(text))


def words(text: str) -> Match:
    """All words of the text, anywhere."""
    return reduce(Match.__and__, [Match("phrase", (w,)) for w in _split(text)])


def prefix(text: str) -> Match:
    """A word that starts with the text."""
    return Match("prefix", _split(text)[:1])


def near(*parts: str, within: int = 10) -> Match:
    """All parts, each a phrase, so close that from the end of any of them to the start of the last there are at most
    `within` other words.  One string stands for its words, each a part of its own."""
    if within < 0 or not parts:
        raise invalid("near needs words and a whole distance")
    found = tuple((w,) for w in _split(parts[0])) if len(parts) == 1 else tuple(map(_split, parts))
    if len(found) > 64:
        raise invalid("near takes 64 parts at most")
    return Match("near", (found, within))


def _leaves(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for v in inner for s in _leaves(v)]


@F.pandas_udf(StringType())
def text_leaves(payload: pd.Series) -> pd.Series:
    """All strings within a JSON payload, nested ones too, joined by spaces."""
    return payload.map(lambda p: " ".join(_leaves(json.loads(p))) if p else "")


def _windows(parts: tuple[tuple[str, ...], ...], within: int) -> Column:
    """How many least windows of _w, the words of a text, hold all parts within the distance.

    Each part gives its sorted places; one sweep over all of them keeps the end of each part's
    last occurrence, so the work is linear in the words and sorts the places only.
    """
    tokens = F.col("_w")

    def starts(k: int, part: tuple[str, ...]) -> Column:
        here = lambda t, i: reduce(Column.__and__, [t == part[0], *[F.get(tokens, i + j) == w for j, w in enumerate(part) if j]])
        return F.filter(F.transform(tokens, lambda t, i: F.when(here(t, i), i.cast("long") * 64 + k)), lambda x: x.isNotNull())

    def step(state: Column, place: Column) -> Column:
        at, which = F.shiftright(place, 6), place.bitwiseAND(F.lit(63))
        sizes = F.array(*[F.lit(len(p)).cast("long") for p in parts])
        ends = F.transform(state["ends"], lambda e, i: F.when(i == which, at + F.get(sizes, i)).otherwise(e))
        first = F.array_min(ends)
        hit = (first >= 0) & (at - first <= within) & (first > state["done"])
        return F.struct(ends.alias("ends"), F.when(hit, first).otherwise(state["done"]).alias("done"), (state["n"] + hit.cast("long")).alias("n"))

    places = F.array_sort(F.concat(*[starts(k, p) for k, p in enumerate(parts)]))
    none = F.struct(F.array(*[F.lit(-1).cast("long")] * len(parts)).alias("ends"), F.lit(-1).cast("long").alias("done"), F.lit(0).cast("long").alias("n"))
    return F.coalesce(F.aggregate(places, none, step, lambda state: state["n"]), F.lit(0)).cast("int")


def _count(unit: Match) -> Column:
    """How often a word, prefix or phrase occurs in _t, lower-cased text, or a window in _w."""
    if unit.op == "near":
        return _windows(*unit.parts)
    body = _OTHER.join(re.escape(w) for w in unit.parts)
    end = "" if unit.op == "prefix" else f"(?!{_LETTER})"
    return F.regexp_count("_t", F.lit(f"(?={body}{end})(?<!{_LETTER})"))  # of no width, so occurrences may overlap


def full_text_search(graph: Graph, match: Match | str, limit: int, fields: list[str] | None = None, find: Find | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows that match, best BM25 first (`score`, lower is better), over the words of the data fields (None: all strings of data).

    A string stands for all of its words.  Counts, lengths and frequencies are of
    the whole graph; find narrows the matches afterwards.  One pass over the texts
    keeps each row's id, length and counts; the rest reads those, and the matches
    are joined with their rows at the end.
    """
    if limit < 1 or fields == []:
        raise invalid("full_text_search needs a limit and fields")
    match = words(match) if isinstance(match, str) else match
    said = text_leaves(F.to_json("data")) if fields is None else F.concat_ws(" ", *[paths.typed(paths.data_path(f), "string") for f in fields])
    tf = {u: f"_f{i}" for i, u in enumerate(match.units())}
    rows = graph.rows.withColumn("_t", F.lower(said))
    if any(u.op == "near" for u in tf):
        rows = rows.withColumn("_w", F.filter(F.split("_t", _OTHER), lambda t: t != ""))
    rows = kept(rows.select("docId", F.regexp_count("_t", F.lit(f"{_LETTER}+")).alias("_n"), *[_count(u).alias(c) for u, c in tf.items()]))
    stats = rows.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(c) > 0).alias(f"{c}_d") for c in tf.values()])

    def met(node: Match) -> Column:
        if node in tf:
            return F.col(tf[node]) > 0
        held = [met(part) for part in node.parts]
        return ~held[0] if node.op == "not" else held[0] & held[1] if node.op == "and" else held[0] | held[1]

    score = F.lit(0.0)
    for c in tf.values():
        d = F.col(f"{c}_d")
        idf = F.log((F.col("_docs") - d + 0.5) / (d + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        f = F.col(c)
        score = score - idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    hits = rows.where(met(match)).crossJoin(F.broadcast(stats)).select("docId", score.alias("score"))  # one row
    if find:
        hits = hits.join(_narrowed(graph, find).select("docId"), "docId", "left_semi")
    hits = hits.orderBy("score", "docId").limit(limit)
    if limit <= FEW_HITS:
        hits = F.broadcast(hits)
    return graph.rows.join(hits, "docId").select(*COLUMNS, "score").orderBy("score", "docId")
