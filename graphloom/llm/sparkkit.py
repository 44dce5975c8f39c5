"""Shared Spark building blocks: cut lineage, components, grouped pair work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm import textkit


#: Whether Spark removes a query's shuffle files at its end, where the session does not say.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where that is unset and the master is local it is a temporary folder.  What is written
    there is read from there, so shuffle files go when the query that made them ends.
    """
    if spark.conf.get(_TIDY, None) is None:
        spark.conf.set(_TIDY, "true")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, without its lineage."""
    shared_folder(df.sparkSession)
    return df.select("*").checkpoint()  # a frame keeps the settings with which it was made


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder: for many rows that are read more than once."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their place (1, 2, ...) in the order of keys: sorted by ranges, which are counted and numbered."""
    order = [F.expr(x) for x in keys]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").count().orderBy("_range").collect()  # one for each range
    start, starts = 0, []
    for r in sizes:
        starts.append((r["_range"], start))
        start += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_range long, _start long")
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_start", "_at")


def _stars(e: DataFrame) -> bool:
    """Whether edges (u, v) are stars: no node at both ends, and one v for each u."""
    several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return several.isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node.

    Alternating large-star and small-star rounds: each is a map-side combined
    minimum and a join that adaptive execution can split where a node is hot.
    They go on until the edges are stars, which is checked on all of them.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Bits of the filter that `reduced` broadcasts: 4 MB whatever the input.
FILTER_BITS = 1 << 25


def reduced(docs: DataFrame, ids: DataFrame, inverse: bool = False) -> DataFrame:
    """The rows of docs whose id may be among ids: all that are, and few others.  inverse: the rest.

    A bitmap of hashed ids of fixed size goes to all executors, so a following join
    on id shuffles the texts that it needs; it never decides a result.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    split = lambda df: df.withColumn("_at", at).withColumn("_bucket", F.expr("_at div 32768")).withColumn("_bit", F.expr("_at % 32768"))
    bits = split(ids.select("id")).repartition(32, "_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    found = f"coalesce(shiftright({byte}, cast(_bit % 8 as int)) & 1, 0)"
    kept = split(docs).join(F.broadcast(bits), "_bucket", "left" if inverse else "inner").where(f"{found} = {int(not inverse)}")
    return kept.select(*docs.columns)


def hubs(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): each node with a much linked node that it is joined to.

    Nodes with one hub are surely in one component; nodes of one component may
    have several.  It takes no rounds, unlike `components`.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    around = both.join(degree.select(F.col("u").alias("v"), "d"), "v").groupBy("u").agg(F.max(F.struct("d", "v")).alias("top"))
    near = cut(around.join(degree, "u").select("u", F.greatest("top", F.struct("d", F.col("u").alias("v")))["v"].alias("hub")))
    return near.join(near.select(F.col("u").alias("hub"), F.col("hub").alias("component")), "hub").select(F.col("u").alias("node"), "component")


#: Bytes of an Arrow batch, where the session sets no other bound.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """fn over the Arrow batches of df, in batches of bounded bytes; workers give back a task's memory at its end."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.lean_memory()
        try:
            yield from fn(batches)
        finally:
            textkit.give_back()

    return df.mapInArrow(run, schema)


def one_key_each(texts: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """texts (c, d, ...), 128-bit keys of texts in two halves, with a column `node` that is unique to a text.

    node is c but where two texts share it; those few halves are returned too
    (they go with the square of the texts over 2**65, ten among 2 * 10**10).
    """
    shared = texts.groupBy("c").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 <> d1").select("c").limit(MOST_CLASHES + 1)
    clashing = frozenset(r[0] for r in shared.collect())
    if len(clashing) > MOST_CLASHES:
        raise ValueError("more texts share half a key than chance allows")
    node = F.when(F.col("c").isin(*clashing), F.col("d")).otherwise(F.col("c")) if clashing else F.col("c")
    return texts.withColumn("node", node).drop("c", "d"), clashing


#: Half keys that `one_key_each` accepts as shared by chance.
MOST_CLASHES = 10_000


def with_pairs(
    docs: DataFrame,
    pairs: DataFrame,
    judge: Callable[[object, object, bytes | None], Iterator[tuple] | list[tuple]],
    prepare: Callable[[str], np.ndarray],
    clashing: frozenset[int],
    schema: str,
    arrow: pa.Schema,
    share: int = 128,
) -> DataFrame:
    """Run judge(prepared a, prepared b, payload) for each row (a, b, ra, rb, payload) of pairs.

    a and b are nodes of prepared texts, ra and rb ids of documents that have them;
    docs has (id, text), where several texts of one id are told apart by their nodes.
    All pairs of one a meet in groups of about `share` partners: a's text goes once
    to each group, b's once to each pair, so a hot a is spread over many groups and
    no group is held in memory.  judge yields rows without a and b, which come first
    in schema.
    """
    hot = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"), F.min("ra").alias("lead")))
    lead = hot.select(F.col("lead").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("node"), F.lit(None).cast("binary").alias("payload"))
    rest = pairs.join(hot.select("a", "parts"), "a").select(F.col("rb").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"), "payload")
    roles = lead.union(rest)
    rows = reduced(docs, roles).join(roles, "id").select("a", "part", "role", "node", "text", "payload")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine, done = None, None, None
        for batch in (part for whole in batches for part in textkit.slices(whole)):
            cols = batch.to_pydict()
            out: list[tuple] = []
            for a, part, role, node, text, payload in zip(cols["a"], cols["part"], cols["role"], cols["node"], cols["text"], cols["payload"], strict=True):
                if (a, part, role, node) == done or role == 1 and held != (a, part):
                    continue
                own = prepare(text)
                if textkit.node_of(own, clashing) != node:  # another text of that id
                    continue
                done = (a, part, role, node)
                if role == 0:
                    held, mine = (a, part), own
                else:
                    out += [(a, node, *r) for r in judge(mine, own, payload)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return mapped(rows, run, schema)


def word_ids(text: str | None, lower: bool = False) -> np.ndarray:
    return textkit.one_block(text).word_hashes(lower)
