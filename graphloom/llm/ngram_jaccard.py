"""Exact n-gram Jaccard join, as a blocked sparse product with size-derived bounds.

The document by n-gram incidence is multiplied block by block: rows are dealt by
n-gram, so one task holds whole columns, and only the columns that a linked pair
must share are kept (each document's first columns in one global order, rarest
first).  Overlap counts of pairs are summed over the columns; a pair whose count
cannot reach the overlap that its two sizes demand is discarded.  What is left is
counted exactly over both whole shingle sets.

Texts with equal shingle sets are one node (their class), so copies never make
pairs.  Within a column, nodes are first paired with one chosen node of their size
class only; then, between nodes that these links have not yet joined, with every
node of compatible size.  Components therefore lose no link, and a group of
thousands of near copies makes a few pairs for each member.

Rules: a null or wordless text has an empty set, n_shingles 0 and no links; fewer
than n words make one shingle of all words; repeated rows come back once each; a
null id keeps its row with a null component; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

#: Entries of the table of frequent shingles: it orders columns and changes no result.
FREQUENT = 1 << 17
#: Hashes that a task gathers before it counts the frequent ones among them.
CHUNK = 2_000_000
#: Texts of a shingle above which its column is dealt to several tasks, by the texts.
SPREAD = 5_000

_SETS = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for block in textkit.blocks(column):
        words, at = block.word_hashes(lower=True), block.bounds
        for i in range(len(block)):
            yield np.unique(textkit.shingle_hashes(words[at[i] : at[i + 1]], n))


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        held, seen = 0, set()  # 64-bit keys will do here: counts of frequent shingles only order columns

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(gathered), return_counts=True)
            keep = counts >= 2
            values, counts = textkit.signed(values[keep]), counts[keep]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int32)), pa.array(values), pa.array(counts.astype(np.int64)), *[pa.nulls(len(values), pa.int64())] * 2], schema=_SETS)

        for batch in batches:
            sizes, keys = [], []
            for s in shingle_sets(batch.column(1), n):
                key = textkit.key_of(s)
                sizes.append(len(s))
                keys.append(key)
                if len(s) and key[0] not in seen:
                    seen.add(key[0])
                    gathered.append(s)
                    held += len(s)
                    if held >= CHUNK:
                        yield frequent()
                        gathered, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], schema=_SETS)
        if gathered:
            yield frequent()

    return run


def _columns(n: int, threshold: int, frequent, clashing: frozenset[int]):
    """The incidence entries (shingle, part of its column, node, size, place in the global order) that a pair at the threshold must share.

    The part is 0 but in columns of more than SPREAD texts, whose parts are counted from 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks, parts = frequent.value  # sorted by hash; the most frequent has the last rank
        seen: set[int] = set()
        for batch in batches:
            hs, ps, ns, cs = [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                node = textkit.node_of(s, clashing)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                keep = len(s) - -(-threshold * len(s) // 100) + 1
                part = np.zeros(len(s), np.int32)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    is_common = values[at] == s
                    if is_common.any():
                        late = at[is_common]
                        late = late[np.argsort(ranks[late], kind="stable")]
                        s = np.concatenate([s[~is_common], values[late]])
                        part[len(s) - len(late) :] = np.where(parts[late] > 1, 1 + node % parts[late], 0)
                hs.append(s[:keep])
                ps.append(part[:keep])
                ns.append(len(s))
                cs.append(node)
            if hs:
                reps = [len(h) for h in hs]
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(np.concatenate(hs))), pa.array(np.concatenate(ps)), pa.array(np.repeat(np.array(cs, np.int64), reps)), pa.array(np.repeat(np.array(ns, np.int32), reps)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in reps]))], names=["h", "p", "c", "n", "i"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries in the order of shingles and parts: those of columns with several nodes,
    with how many nodes a block shows of the part (its weight; it only ranks nodes).
    A column in parts is known to be shared, so all its entries stay."""
    carried = None  # the last entry, and whether its part had others before it
    for batch in batches:
        if not batch.num_rows:
            continue
        h, p, *rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        before = False
        if carried is not None:
            h, p, *rest = (np.append(x, y) for x, y in zip(carried[0], (h, p, *rest), strict=True))
            before = carried[1]
        same = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
        shared = np.append(same, False) | np.append(before, same) | (p > 0)
        carried = ([x[-1:] for x in (h, p, *rest)], bool(shared[-1]))
        runs = np.cumsum(np.append(False, ~same))
        weight = np.bincount(runs)[runs]
        keep = shared[:-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (h, *rest, weight.astype(np.int32))], names=["h", "c", "n", "i", "w"])
    if carried is not None and carried[1]:
        h, _, *rest = carried[0]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (h, *rest)), pa.array([2], pa.int32())], names=["h", "c", "n", "i", "w"])


def _frequent_table(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles, by hash, with their ranks and the parts of their columns; FREQUENT entries at most."""
    top = sets.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where("n >= 32").orderBy(F.desc("n"), "id").limit(FREQUENT)
    rows = top.toPandas()
    values = rows["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.arange(len(values), 0, -1)[order], (rows["n"].to_numpy(np.int64) // SPREAD + 1)[order]


def linked(docs: DataFrame, pairs: DataFrame, n: int, threshold: int, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(a, b, linked) of pairs (a, b, ra, rb): whether the whole shingle sets of two nodes reach the threshold."""

    def judge(x, y, _payload):
        both = len(x) + len(y) - len(np.union1d(x, y))
        return [(100 * both >= threshold * (len(x) + len(y) - both),)]

    def prepare(text):
        return np.unique(textkit.shingle_hashes(sparkkit.word_ids(text, lower=True), n))

    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    return sparkkit.with_pairs(docs, pairs.withColumn("payload", F.lit(None).cast("binary")), judge, prepare, clashing, "a long, b long, linked boolean", arrow)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs.

    Two texts link where 100 * intersection >= threshold * union of their sets of
    n-word shingles, A-Z lower-cased; component_id is the smallest id reachable.
    threshold is 1 to 100; at 100 texts with equal sets link.
    """
    if not 1 <= threshold <= 100:
        raise ValueError("threshold must be 1 to 100")
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = sparkkit.cut(sparkkit.mapped(docs, _describe(n), "kind int, id long, n long, c long, d long"))
    frequent = sc.broadcast(_frequent_table(sets))
    sets, clashing = sparkkit.one_key_each(sets.where("kind = 0").select("id", "n", "c", "d"))
    nodes = sparkkit.cut(sets.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("rep")))

    entries = sparkkit.mapped(docs.where("id is not null"), _columns(n, threshold, frequent, clashing), "h long, p int, c long, n int, i int")
    entries = entries.repartition("h", "p").sortWithinPartitions("h", "p")
    entries = sparkkit.stored(sparkkit.mapped(entries, _shared, "h long, c long, n int, i int, w int"))

    def least() -> str:  # columns that a pair must share, as its sizes say
        need = lambda x: f"({threshold} * {x} + 99) div 100"
        return f"({threshold} * (na + nb) + {99 + threshold}) div {100 + threshold} - greatest({need('na')}, {need('nb')}) + 1"

    def check(pairs: DataFrame) -> DataFrame:
        ends = [nodes.select(F.col("node").alias(x), F.col("rep").alias(f"r{x}")) for x in ("a", "b")]
        return sparkkit.cut(linked(docs, sparkkit.cut(pairs.join(ends[0], "a").join(ends[1], "b")), n, threshold, clashing))

    sized = f"100 * na >= {threshold} * nb and 100 * nb >= {threshold} * na"

    def stars(rows: DataFrame) -> DataFrame:
        """Pairs of each node with the lowest-ranked node of its column and size class.

        Classes are as wide as two sizes may differ, and come twice, half a class apart.
        """
        step = f"ln(n) / {max(math.log(100 / threshold), 1e-6)}"  # at 100 only equal sizes link
        rows = rows.select("h", "c", "n", "lab", "rank", F.explode(F.array(F.expr(f"cast(2 * floor({step}) as int)"), F.expr(f"cast(2 * floor({step} + 0.5) + 1 as int)"))).alias("k"))
        lead = rows.groupBy("h", "k").agg(F.min(F.struct("rank", "c", "n", "lab")).alias("l"), F.count("*").alias("m")).where("m > 1")
        near = rows.join(lead, ["h", "k"]).where("c <> l.c and lab <> l.lab")
        near = near.select("h", F.least("c", "l.c").alias("a"), F.greatest("c", "l.c").alias("b"), F.expr("if(c < l.c, n, l.n)").alias("na"), F.expr("if(c < l.c, l.n, n)").alias("nb"))
        return near.where(sized).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("c")).where(f"2 * c >= {least()}").select("a", "b")

    def mixed(rows: DataFrame, label: DataFrame) -> DataFrame:
        """The entries of columns in which nodes of several components meet."""
        rows = rows.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("lab", F.coalesce("component", "c")).drop("component")
        meet = rows.groupBy("h").agg(F.min("lab").alias("l0"), F.max("lab").alias("l1")).where("l0 <> l1").select("h")
        return sparkkit.stored(rows.join(meet, "h"))

    # first with the node that has most in common with others, as an original has among its copies
    central = entries.groupBy("c").agg((-F.sum(F.log2("w")) / F.first("n")).alias("rank"))
    tested = check(stars(entries.join(central, "c").withColumn("lab", F.col("c"))))
    links = tested.where("linked").select("a", "b")
    # then with nodes that a hash picks, in four ways; nodes with one hub are joined already
    entries = mixed(entries.drop("w"), sparkkit.hubs(links))
    picked = stars(entries.withColumn("rank", F.xxhash64("c", F.pmod("h", F.lit(4))).cast("double"))).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    again = check(picked)
    tested, links = tested.union(again), links.union(again.where("linked").select("a", "b"))
    # then all that these links have not joined
    entries = mixed(entries.drop("lab"), sparkkit.components(links))
    # the first column that a linked pair shares leaves enough columns after it in both, so it
    # lies among the first few of the smaller one; wide groups of one column then make few pairs
    room = lambda x: f"{100 + threshold} * (n{x} - i{x}) >= {threshold} * (na + nb)"
    size = F.expr(f"cast(floor(ln(n) / (ln({100 / threshold}) + 1e-6)) as int)")  # a linked pair's differ by 1 at most
    x = entries.select("h", F.col("c").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("lab").alias("la"), size.alias("k"))
    y = entries.where(f"{100 + threshold} * (n - i) >= {2 * threshold} * n").select("h", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("lab").alias("lb"), F.explode(F.array(size, size + 1)).alias("k"))
    met = x.join(y, ["h", "k"]).where(f"(na > nb or na = nb and a < b) and la <> lb and {sized} and {room('a')} and {room('b')}")
    left = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    label = sparkkit.components(links.union(check(left).where("linked").select("a", "b")))

    sets = sets.join(label.select("node", "component"), "node", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("lab"))
    low = sparkkit.cut(sets.where("lab is not null and id is not null").groupBy("lab").agg(F.min("id").alias("low")))  # else one shuffle serves both, and a large component stays whole
    out = sets.join(low, "lab", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows with a null id stay."""
    gone = jaccard_components(docs, id_col, text_col, n, threshold).where(f"`{id_col}` <> component_id").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
