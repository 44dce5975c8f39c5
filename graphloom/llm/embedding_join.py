"""Near-duplicate embeddings: an epsilon grid order join on leading principal dimensions.

Unit vectors are turned to principal axes and sorted by the cells of a grid, as wide as
the distance that the cosine allows, on the leading ones.  The sequence is numbered and cut
into blocks of equal length; sixteen blocks are an interval of the next level, and so on.
Each interval has a box (leading coordinates and what the others amount to) and a ball.
From the top, pairs of intervals are joined level by level: pairs whose boxes are farther
apart than the distance are skipped, pairs whose balls lie within it are linked as a
whole, the rest go on.  Pairs of blocks do the same with runs of `RUN` vectors, and multiply
what is left.  Counts and a spanning forest of the links leave a task, never the pairs.

The axes come from at most `AXES_ROWS` vectors picked by hash: they order and prune, and
change no result, as distances are the same in any axes.

Rules: null, empty and zero vectors and those with null or non-finite components link with
nothing; vectors of different lengths don't link with each other; equal vectors, also of
repeated rows, count as links of each other; a null id is counted as a link, and has no
component unless it has linked ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit

#: Vectors that the axes are taken from, and the bytes of doubles that these may have.
AXES_ROWS, AXES_BYTES = 20_000, 32 << 20
#: Leading dimensions of the grid.
LEADING = 16
#: Intervals of one level in one of the next.
FAN = 16
#: Vectors in a block at most (fewer of long ones), and in a run of a block.
BLOCK, RUN = 4096, 32
#: Partners of a block that meet in one group of rows.
SHARE = 16
#: What rounding may add to a squared distance, or take from it.
SLACK = 1e-5

_FOUND = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("value", pa.int64())])


def principal_axes(sample: list[list[float]], width: int, leading: int) -> np.ndarray:
    """The leading principal axes, as columns, of unit vectors filled up with zeros to one width."""
    units = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        units[i, : len(v)] = v
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    units -= units.mean(axis=0) if len(units) else 0
    _, axes = np.linalg.eigh(units.T @ units)
    return np.ascontiguousarray(axes[:, ::-1][:, :leading])


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _units(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64) / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _coordinates(units: np.ndarray, sizes: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Length (far apart for different ones), leading coordinates, and the norm of the rest."""
    lead = units @ axes
    rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1)))
    return np.column_stack([10.0 * sizes, lead, rest])


def _vectors(column: pa.Array) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in column]


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the classes of x[i] and y[i] in label, whose entries are each class's smallest member."""
    while True:
        differ = label[x] != label[y]
        if not differ.any():
            return
        x, y = x[differ], y[differ]
        a, b = label[x], label[y]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while True:
            on = to[to]
            if (on == to).all():
                break
            to = on
        label[:] = to[label]


class _Block:
    """A block's vectors, with boxes and balls of its runs."""

    def __init__(self, nodes: list[int], counts: list[int], sizes: list[int], vectors: bytes, kind: str, axes: np.ndarray) -> None:
        self.nodes, self.counts, self.sizes = np.array(nodes, np.int64), np.array(counts, np.int64), np.array(sizes, np.int64)
        self.units = _units(np.frombuffer(vectors, kind).reshape(len(nodes), -1))
        self.fast = self.units.astype(np.float32)
        place = _coordinates(self.units, self.sizes, axes)
        at = np.arange(0, len(nodes), RUN)
        self.bounds = np.append(at, len(nodes))
        self.low, self.high = np.minimum.reduceat(place, at), np.maximum.reduceat(place, at)
        n = np.diff(self.bounds)
        self.centre = np.add.reduceat(self.units, at) / n[:, None]
        self.radius = np.sqrt(np.maximum.reduceat(((self.units - np.repeat(self.centre, n, axis=0)) ** 2).sum(axis=1), at))
        self.mixed = self.low[:, 0] != self.high[:, 0]
        self.weight = np.add.reduceat(self.counts, at)


def _joined(a: _Block, b: _Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector of a and of b, and the classes of both that the links make (b after a; one block with itself: once)."""
    own, far = a is b, 2 - 2 * least
    na = len(a.nodes)
    shift = 0 if own else na
    label = np.arange(na + (0 if own else len(b.nodes)))
    of_a, of_b = np.zeros(na, np.int64), np.zeros(len(b.nodes), np.int64)
    slack = SLACK * (1 + a.units.shape[1] / 256)
    for s in range(len(a.bounds) - 1):
        gap = np.maximum(0, np.maximum(b.low - a.high[s], a.low[s] - b.high))
        able = (gap * gap).sum(axis=1) <= far + SLACK
        i0, i1 = a.bounds[s], a.bounds[s + 1]
        whole = able & (np.sqrt(((b.centre - a.centre[s]) ** 2).sum(axis=1)) + a.radius[s] + b.radius < math.sqrt(far) - SLACK) & ~b.mixed & (not a.mixed[s]) & (b.low[:, 0] == a.low[s, 0])
        rows = np.arange(i0, i1)
        for t in np.flatnonzero(whole).tolist():
            cols = np.arange(b.bounds[t], b.bounds[t + 1])
            of_a[rows] += b.weight[t]
            of_b[cols] += a.weight[s]
            _unite(label, np.append(rows, np.full(len(cols), i0)), np.append(np.full(len(rows), shift + cols[0]), shift + cols))
        able &= ~whole
        if own and whole[s]:
            of_a[rows] -= a.counts[rows]  # not with itself
        if not able.any():
            continue
        cols = np.flatnonzero(np.repeat(able, np.diff(b.bounds)))
        cosine = a.fast[i0:i1] @ b.fast[cols].T
        i, j = np.nonzero(cosine >= least - slack)
        if not len(i):
            continue
        near = cosine[i, j] <= least + slack
        i, j = i + i0, cols[j]
        keep = a.sizes[i] == b.sizes[j]
        if own:
            keep &= i != j
        check = np.flatnonzero(near & keep)
        if len(check):
            keep[check] = np.einsum("ij,ij->i", a.units[i[check]], b.units[j[check]]) >= least
        i, j = i[keep], j[keep]
        of_a += np.bincount(i, weights=b.counts[j], minlength=na).astype(np.int64)
        if not own:
            of_b += np.bincount(j, weights=a.counts[i], minlength=len(of_b)).astype(np.int64)
        _unite(label, i, shift + j)
    return of_a, of_b, label


def _blocks(rows: DataFrame, axes: np.ndarray, kind: str) -> DataFrame:
    """Numbered vectors (block, rank, node, m, vec) as one row for each block, with its box and ball."""
    width = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def packed() -> pa.RecordBatch:
            nodes, counts, vectors = (sum((p[k] for p in parts), []) for k in range(3))
            sizes = np.array([len(v) for v in vectors], np.int64)
            raw = _matrix(vectors, width)
            units = _units(raw)
            place = _coordinates(units, sizes, axes)
            centre = np.append(units.mean(axis=0), 10.0 * sizes.mean())
            radius = float(np.sqrt(((np.column_stack([units, 10.0 * sizes]) - centre) ** 2).sum(axis=1).max()))
            out = {"block": [block], "nodes": [nodes], "counts": [counts], "sizes": [sizes.tolist()], "vectors": [raw.astype(kind).tobytes()], "low": [place.min(axis=0).tolist()], "high": [place.max(axis=0).tolist()], "centre": [centre.tolist()], "radius": [radius], "n": [len(nodes)], "weight": [sum(counts)], "first": [nodes[0]]}
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if ids[x] != block:
                    if parts:
                        yield packed()
                    block, parts = int(ids[x]), []
                part = batch.slice(x, y - x)
                parts.append((part.column(1).to_pylist(), part.column(2).to_pylist(), _vectors(part.column(3))))
        if parts:
            yield packed()

    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    schema = pa.schema([("block", pa.int64()), ("nodes", longs), ("counts", longs), ("sizes", longs), ("vectors", pa.binary()), ("low", doubles), ("high", doubles), ("centre", doubles), ("radius", pa.float64()), ("n", pa.int64()), ("weight", pa.int64()), ("first", pa.int64())])
    rows = rows.repartition("block").sortWithinPartitions("block", "rank").select("block", "node", "m", "vec")
    return sparkkit.mapped(rows, run, "block long, nodes array<long>, counts array<long>, sizes array<long>, vectors binary, low array<double>, high array<double>, centre array<double>, radius double, n long, weight long, first long")


def _upper(level: DataFrame) -> DataFrame:
    """The intervals of the next level: FAN of this one each, their box and a ball around their balls."""

    def merged(key: tuple, part: pa.Table) -> pa.Table:
        n, low, high, centre = (np.array(part.column(c).to_pylist(), float) for c in ("n", "low", "high", "centre"))
        radius = np.array(part.column("radius").to_pylist())
        mid = (centre * n[:, None]).sum(axis=0) / n.sum()
        first = part.sort_by("block").column("first")[0].as_py()
        out = {"block": [key[0].as_py()], "low": [low.min(axis=0).tolist()], "high": [high.max(axis=0).tolist()], "centre": [mid.tolist()], "radius": [float((np.sqrt(((centre - mid) ** 2).sum(axis=1)) + radius).max())], "n": [int(n.sum())], "weight": [sum(part.column("weight").to_pylist())], "first": [first]}
        return pa.Table.from_pydict(out, schema=schema)

    doubles = pa.list_(pa.float64())
    schema = pa.schema([("block", pa.int64()), ("low", doubles), ("high", doubles), ("centre", doubles), ("radius", pa.float64()), ("n", pa.int64()), ("weight", pa.int64()), ("first", pa.int64())])
    return level.select(*_BOX).groupBy(F.expr(f"block div {FAN}").alias("up")).applyInArrow(merged, "block long, low array<double>, high array<double>, centre array<double>, radius double, n long, weight long, first long")


_BOX = ["block", "low", "high", "centre", "radius", "n", "weight", "first"]


def _apart() -> Column:
    """The squared distance of two boxes."""
    over = lambda x, y: f"zip_with({x}, {y}, (p, q) -> greatest(p - q, 0D))"
    square = lambda x: f"aggregate({x}, 0D, (s, v) -> s + v * v)"
    return F.expr(f"{square(over('low_a', 'high_b'))} + {square(over('low_b', 'high_a'))}")


def _reach() -> Column:
    """The largest distance that two balls allow."""
    return F.expr("sqrt(aggregate(zip_with(centre_a, centre_b, (p, q) -> p - q), 0D, (s, v) -> s + v * v)) + radius_a + radius_b")


def _tested(pairs: DataFrame, level: DataFrame, far: float) -> DataFrame:
    """Pairs (a, b) of intervals of a level that may have links, and whether all their vectors are linked."""
    for x in ("a", "b"):
        pairs = pairs.join(level.select(*(F.col(c).alias(x if c == "block" else f"{c}_{x}") for c in _BOX)), x)
    kept = pairs.where(_apart() <= far + SLACK).withColumn("whole", _reach() < math.sqrt(far) - SLACK)
    return sparkkit.cut(kept.select("a", "b", "whole", "weight_a", "weight_b", "first_a", "first_b"))


def _compared(pairs: DataFrame, blocks: DataFrame, axes: np.ndarray, kind: str, least: float) -> DataFrame:
    """(kind, node, value) of the links of block pairs (a, b): kind 0 is a number of links, kind 1 a node of the same component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            row = batch.to_pylist()[0]
            block = _Block(row["nodes"], row["counts"], row["sizes"], row["vectors"], kind, axes)
            if row["role"] == 0:
                held = block
                continue
            other = held if row["a"] == row["block"] else block
            of_a, of_b, label = _joined(held, other, least)
            nodes = held.nodes if other is held else np.append(held.nodes, other.nodes)
            counts = of_a if other is held else np.append(of_a, of_b)
            some, moved = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(label)))
            kinds = np.append(np.zeros(len(some), np.int32), np.ones(len(moved), np.int32))
            if len(kinds):
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.append(nodes[some], nodes[moved])), pa.array(np.append(counts[some], nodes[label[moved]]))], schema=_FOUND)

    parts = sparkkit.cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts")))
    lead = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("block"))
    rest = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("block"))
    rows = lead.union(rest).join(blocks.select("block", "nodes", "counts", "sizes", "vectors"), "block")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return sparkkit.mapped(rows, run, "kind int, node long, value long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: links are pairs with a cosine of `least` or more, of 0 < least < 1."""
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    spark, far = rows.sparkSession, 2 - 2 * least
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    kind = "<f4" if rows.schema["vec"].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    sound = F.expr("coalesce(forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0), false)")
    alike = sparkkit.stored(rows.where(sound).groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("node", F.monotonically_increasing_id()))
    width = alike.agg(F.max(F.size("vec"))).first()[0] or 1
    picked = alike.select("vec").orderBy(F.xxhash64("vec")).limit(max(64, min(AXES_ROWS, AXES_BYTES // (8 * width)))).collect()
    axes = principal_axes([r[0] for r in picked], width, min(LEADING, width))
    cell = math.sqrt(far)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grid = np.floor(_units(_matrix(_vectors(batch.column(2)), width)) @ axes / cell).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(grid.tolist(), pa.list_(pa.int32()))], names=["node", "m", "vec", "cells"])

    element = "float" if kind == "<f4" else "double"
    placed = sparkkit.mapped(alike.select("node", "m", "vec"), cells, f"node long, m long, vec array<{element}>, cells array<int>")
    length = max(64, min(BLOCK, (1 << 18) // width))
    numbered = sparkkit.ranked(placed.withColumn("size", F.size("vec")), ["size", "cells", "node"], "rank").drop("cells", "size").withColumn("block", F.expr(f"(rank - 1) div {length}"))
    blocks = sparkkit.stored(_blocks(numbered, axes, kind))
    levels = [blocks]
    count = blocks.count()
    while count > FAN:
        levels.append(sparkkit.cut(_upper(levels[-1])))
        count = -(-count // FAN)
    pairs = spark.createDataFrame([(i, j) for i in range(count) for j in range(i, count)], "a long, b long")
    wholes = []
    for at in range(len(levels) - 1, -1, -1):
        tested = _tested(pairs, levels[at], far)
        wholes.append((at, tested.where("whole")))
        pairs = tested.where("not whole").select("a", "b")
        if at:
            below = lambda x: F.explode(F.sequence(F.col(x) * FAN, F.col(x) * FAN + FAN - 1)).alias(x)
            pairs = pairs.select(below("a"), "b").select("a", below("b")).where("a <= b")
    found = sparkkit.cut(_compared(pairs, blocks, axes, kind, least).union(_of_wholes(wholes, blocks)))

    counts = found.where("kind = 0").groupBy("node").agg(F.sum("value").alias("n"))
    label = sparkkit.components(found.where("kind = 1").select(F.col("node").alias("a"), F.col("value").alias("b")))
    linked = alike.join(counts, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = sparkkit.stored(linked.select("vec", "component", "rep", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    low = linked.groupBy("component").agg(F.min("rep").alias("low"))
    known = linked.join(low, "component").select("vec", "n_links", "low")
    out = rows.where(sound).join(known, "vec").select("id", "n_links", "low")
    out = out.union(rows.where(~sound).select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("low").alias("component_id"), F.coalesce(F.col("id") == F.col("low"), F.col("low").isNull()).alias("kept"))


def _of_wholes(wholes: list[tuple[int, DataFrame]], blocks: DataFrame) -> DataFrame:
    """What `_compared` gives, for pairs of intervals (level, pairs) whose vectors are all linked."""
    gains = edges = None
    for at, pairs in wholes:
        pairs = pairs.withColumn("level", F.lit(at))
        both = pairs.select("level", F.col("a").alias("up"), F.col("weight_b").alias("more"), (F.col("a") == F.col("b")).cast("long").alias("own"))
        both = both.union(pairs.where("a <> b").select("level", "b", "weight_a", F.lit(0).cast("long")))
        gains = both if gains is None else gains.union(both)
        first = pairs.where("a <> b").select(F.lit(1).alias("kind"), F.col("first_a").alias("node"), F.col("first_b").alias("value"))
        edges = first if edges is None else edges.union(first)
    gains = gains.groupBy("level", "up").agg(F.sum("more").alias("more"), F.sum("own").alias("own"))
    ups = F.array(*(F.struct(F.lit(at).alias("level"), F.expr(f"block div {FAN**at}").alias("up")) for at, _ in wholes))
    firsts = [p.select(F.lit(at).alias("level"), F.col(x).alias("up"), F.col(f"first_{x}").alias("first")) for at, p in wholes for x in ("a", "b")]
    lead = firsts[0]
    for more in firsts[1:]:
        lead = lead.union(more)
    gains = gains.join(lead.distinct(), ["level", "up"])
    inside = blocks.select("block", F.explode(ups).alias("u")).select("block", "u.*").join(gains, ["level", "up"]).join(blocks.select("block", "nodes", "counts"), "block")
    inside = inside.select("first", "more", "own", F.explode(F.arrays_zip("nodes", "counts")).alias("v"))
    counted = inside.select(F.lit(0).alias("kind"), F.col("v.nodes").alias("node"), (F.col("more") - F.col("own") * F.col("v.counts")).alias("value"))
    joined = inside.where("v.nodes <> first").select(F.lit(1).alias("kind"), F.col("v.nodes").alias("node"), F.col("first").alias("value"))
    return counted.union(joined).union(edges)
