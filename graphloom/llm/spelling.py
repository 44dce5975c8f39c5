"""Spelling variants: a trie self-join with active-node sets over a partitioned vocabulary.

The vocabulary is dealt to small tries.  Two words that are one edit apart share their
first half or their last half, whichever the edit isn't in; so words are grouped by
length class and first half, and by length class and last half, and each group's trie
holds only what the halves leave.  A group of over `MOST` words is dealt again by the
halves of what is left, until none is; what one or two letters can make needs no dealing.
A pair belongs to one group alone: that of the common first halves if it has such, else
that of the last halves.

Down a group's trie each node carries its active nodes, the prefixes at distance one from
its own; a child's are made from its parent's by a deleted, replaced or inserted letter, or
by the same letter below an active node.  Words that end in active nodes of a word's end
are its near words.  Only their count and the best of them leave the task.

Rules: a null text has no words; a null id reads as an empty one; repeated rows count each;
of equally frequent near words the smallest in code-point order is the form; texts of any
length are read in pieces; empty tables give no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

#: Words of a group above which it is dealt again.
MOST = 4_000
#: Words that a task counts before it passes their counts on.
HELD = 300_000
#: Bytes of a run up to which CRCs are taken side by side.
SHORT = 64

_C3 = 0xC3  # what U+00C0 to U+00FF begin with in UTF-8
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), _C3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def letter_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the maximal runs of A-Z, a-z and U+00C0-U+00FF."""
    inside = _LETTER[buf]
    inside[1:] |= buf[:-1] == _C3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def run_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run after a prefix whose CRC is `before`."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, c = starts[order], before[order] ^ np.uint32(0xFFFFFFFF)
    count = np.bincount(np.minimum(size, SHORT), minlength=SHORT + 1)
    longer = len(size) - np.cumsum(count)  # runs of more than k bytes, for k below SHORT
    for k in range(SHORT):
        m = int(longer[k])
        if not m:
            break
        c[:m] = _CRC[(c[:m] ^ buf[at[:m] + k]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, bounds of texts, first text): blocks of whole texts, and long texts cut where no run is."""
    for block in textkit.blocks(column):
        buf, limit = block.buf, textkit.BLOCK_BYTES
        if len(block) > 1 or len(buf) <= 2 * limit:
            yield buf, block.offs, block.first
            continue
        at = 0
        while at < len(buf):
            end = at + limit
            while end < len(buf):
                gap = np.flatnonzero((buf[end : end + limit] < 128) & ~_LETTER[buf[end : end + limit]])
                if len(gap):
                    end += int(gap[0])
                    break
                end += limit
            yield buf[at:end], np.array([0, min(end, len(buf)) - at]), block.first
            at = end


def _spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """The distinct byte spans with their counts."""
    if not len(starts):
        return
    size = ends - starts
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    lanes = np.ndarray((len(low) + 1,), "<u8", padded.data, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    head = lanes[starts] & keep[np.minimum(size, 8)]
    tail = lanes[np.maximum(ends - 8, starts)] & keep[np.minimum(size, 8)]
    h = textkit.mix(head ^ textkit.mix(tail + size.astype(np.uint64)))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    x, y = order[1:][same], order[:-1][same]
    raw = low.tobytes()
    long = np.flatnonzero(size[x] > 16)  # head and tail are the whole of the others
    alike = bool(np.all((head[x] == head[y]) & (tail[x] == tail[y]) & (size[x] == size[y])))
    if not alike or any(raw[starts[i] : ends[i]] != raw[starts[j] : ends[j]] for i, j in zip(x[long].tolist(), y[long].tolist(), strict=True)):
        yield from Counter(raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)).items()
        return
    bounds = np.append(np.flatnonzero(np.append(True, ~same)), len(order))
    some = order[bounds[:-1]]
    yield from zip((raw[i:j] for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)), np.diff(bounds).tolist(), strict=True)


def word_counts(docs: DataFrame, every: int, least: int) -> DataFrame:
    """(word, n) for docs (id, text): lower-cased runs, of which every `every`-th by its hash has lost a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            heads = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
            for buf, offs, first in _pieces(batch.column(1)):
                low = _LOWER[buf]
                starts, ends, owner = letter_runs(low, offs)
                crc = run_crcs(low, starts, ends, heads[first + owner])
                hit = crc % np.uint32(every) == 0
                for i in np.flatnonzero(hit).tolist():
                    word = low[starts[i] : ends[i]].tobytes().decode()
                    at = int(crc[i]) % len(word)
                    if len(word) > least:
                        held[(word[:at] + word[at + 1 :]).encode()] += 1
                pairs = np.append(0, np.cumsum(low == _C3))
                able = ~hit & (ends - starts - (pairs[ends] - pairs[starts]) >= least)
                for word, n in _spans(low, starts[able], ends[able]):
                    held[word] += n
                if len(held) >= HELD:
                    yield passed()
        if held:
            yield passed()

    return sparkkit.mapped(docs, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_in_group(group: list[tuple[str, str, int]], shorter: int, apart: int | None) -> list[tuple[str, int, int, str]]:
    """(word, near words, -n of the best, the best) for a group of (what the halves leave, word, n).

    Pairs have a shorter side of `shorter` letters, and differ within the first `apart` if that is given.
    """
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for at, (rest, _, _) in enumerate(group):
        node = 0
        for letter in rest:
            below = children[node].get(letter)
            if below is None:
                below = children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
            node = below
        ends[node] = at
    out = []
    waiting: list[tuple[int, list[int] | set[int]]] = [(0, list(children[0].values()))]
    while waiting:
        node, active = waiting.pop()
        if ends[node] >= 0:
            rest, word, _ = group[ends[node]]
            count, best = 0, None
            for other in active:
                if ends[other] < 0:
                    continue
                its, name, n = group[ends[other]]
                if len(rest) > shorter and len(its) > shorter or apart is not None and rest[:apart] == its[:apart]:
                    continue
                count += 1
                if best is None or (-n, name) < best:
                    best = (-n, name)
            if best:
                out.append((word, count, *best))
        below = children[node]
        for letter, child in below.items():
            its = {node, *below.values(), *children[child].values()}
            its.discard(child)
            for other in active:
                step = children[other].get(letter)
                if step is not None:
                    its.add(step)
            waiting.append((child, its))
    return out


_GROUP = ["c", "start", "cut", "bound", "key"]


def _halved(rows: DataFrame) -> DataFrame:
    """Each row of (word, n, c, start, cut, bound) in the groups of its first and of its last half.

    c is the class, the shorter length of a pair, of what lies between start and cut; a pair's
    common prefix must be shorter than bound.
    """
    first = "struct(c - c div 2 as c, start + c div 2 as start, cut as cut, bound as bound)"
    last = "struct(c div 2 as c, start as start, cut + c - c div 2 as cut, least(bound, start + c div 2) as bound)"
    halves = rows.select("word", "n", F.explode(F.expr(f"array({first}, {last})")).alias("g")).select("word", "n", "g.*").where("start < bound")
    return halves.withColumn("key", F.expr("concat(substring(word, 1, start), '|', right(word, cut))"))


def near_words(vocabulary: DataFrame, least: int = 1) -> DataFrame:
    """(word, n_near, best_n, best) for each word of vocabulary (word, n) that has near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def joined() -> list[tuple]:
            if len(group) < 2:
                return []
            c, start, _, bound, _ = key
            return near_in_group(group, c, bound - start if bound < 2**31 - 1 else None)

        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("minus_n", pa.int64()), ("best", pa.string())])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in (part for whole in batches for part in textkit.slices(whole, 4096)):
            cols, out = batch.to_pydict(), []
            for word, n, *its in zip(cols["word"], cols["n"], *(cols[c] for c in _GROUP), strict=True):
                if its != key:
                    out += joined()
                    key, group = its, []
                group.append((word[its[1] : len(word) - its[2]], word, n))
            if out:
                yield pack(out)
        if rows := joined():
            yield pack(rows)

    classes = F.expr(f"filter(array(length(word) - 1, length(word)), c -> c >= {least})")
    rows = _halved(vocabulary.select("word", "n", F.explode(classes).alias("c"), F.lit(0).alias("start"), F.lit(0).alias("cut"), F.lit(2**31 - 1).alias("bound")))
    found = None
    while True:
        sizes = sparkkit.cut(rows.groupBy(*_GROUP).count().where("count > 1"))
        large = F.expr(f"count > {MOST} and c > 1")
        group = rows.join(sizes.where(~large), _GROUP, "left_semi").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        part = sparkkit.mapped(group.select("word", "n", *_GROUP), run, "word string, n_near long, minus_n long, best string")
        found = part if found is None else found.union(part)
        large = sizes.where(large)
        if large.isEmpty():
            break
        rows = _halved(rows.join(large, _GROUP, "left_semi"))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.minus_n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): where following forms ends, by doubling steps."""
    at = sparkkit.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        at = sparkkit.cut(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least: int = 5, times: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of docs with at least `least` code points and `times` occurrences.

    form is the most frequent word one edit away, if it occurs at least `ratio` times as often.
    """
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = sparkkit.cut(word_counts(docs, every, least).where(F.col("n") >= times))
    joined = vocabulary.join(near_words(vocabulary, least), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    out = sparkkit.cut(joined.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
