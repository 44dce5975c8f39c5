"""Best-fit packing of tokenised documents into sequences of one capacity.

Only the histogram of piece lengths (at most `capacity` entries) is planned on the
driver, so the plan costs the same at any size and is still one packing of all
pieces.  Pieces above a third of the capacity fit at most two to a sequence: from
the longest down, each is matched with the longest one that still fits beside it.
The shorter ones then go, longest first, to the tightest gap that takes them.
A piece finds its place by its rank among the pieces of its length: ranks come
from counts of (length, salt) groups, so no length needs one task.

Rules: a null text is empty and makes one token; texts longer than the capacity
are cut into full pieces, the first may be shorter; repeated rows are packed each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

SALTS = 64
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _fast(path: str):
    """A faster encoder over the same vocabulary, and the special tokens that it doesn't know."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in set(shown)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("same", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), special


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that the tokenizer at path gives a text, without added special tokens."""
    fast, special = _fast(path)
    if not any(s in text for s in special):
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        except ValueError:  # its splitter gives up on very long runs of spaces
            pass
    return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4")


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, end_id: int = 0) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) of all documents, end_id after each."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in textkit.slices(whole)):
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(token_ids(text or "", path), np.array([end_id], "<u4"))
                start, piece, length = 0, 0, (len(ids) - 1) % capacity + 1
                while start < len(ids):
                    at.append(i)
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes())))
                    start, piece, length = start + length, piece + 1, capacity
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return sparkkit.mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces of a histogram: (length, first rank, past rank, first sequence, pieces a sequence, offset)."""
    left, rank, runs, gaps = Counter({n: c for n, c in lengths.items() if c}), Counter(), [], {}
    sequences = 0

    def place(length: int, count: int, first: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], rank[length] + count, first, each, offset))
        rank[length] += count
        left[length] -= count

    def leave(first: int, count: int, used: int) -> None:  # sequences with the same gap
        if count and used < capacity:
            gap = capacity - used
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((first, count))

    open_gaps: list[int] = []
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if left[m] and m <= min(n, capacity - n)), None)
            if partner is None:
                count = left[n]
                place(n, count, sequences, 1, 0)
                leave(sequences, count, n)
            else:
                count = left[n] // 2 if partner == n else min(left[n], left[partner])
                if not count:  # one is left of a length that would pair with itself: the next shorter takes it
                    shorter = next((m for m in large if left[m] and m < n), None)
                    count = 1
                    place(n, 1, sequences, 1, 0)
                    if shorter is None:
                        leave(sequences, 1, n)
                    else:
                        place(shorter, 1, sequences, 1, n)
                        leave(sequences, 1, n + shorter)
                elif partner == n:
                    place(n, 2 * count, sequences, 2, 0)
                    leave(sequences, count, 2 * n)
                else:
                    place(n, count, sequences, 1, 0)
                    place(partner, count, sequences, 1, n)
                    leave(sequences, count, n + partner)
            sequences += count
    for n in sorted((n for n in left if left[n] > 0), reverse=True):
        while left[n]:
            at = bisect.bisect_left(open_gaps, n)
            if at == len(open_gaps):
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    place(n, full * each, sequences, each, 0)
                    leave(sequences, full, each * n)
                    sequences += full
                if rest:
                    place(n, rest, sequences, rest, 0)
                    leave(sequences, 1, rest * n)
                    sequences += 1
                continue
            gap = open_gaps[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            each, offset = gap // n, capacity - gap
            full, rest = divmod(min(left[n], count * each), each)
            if full:
                place(n, full * each, first, each, offset)
                leave(first, full, offset + each * n)
            if rest:
                place(n, rest, first + full, rest, offset)
                leave(first + full, 1, offset + rest * n)
            leave(first + full + bool(rest), count - full - bool(rest), offset)
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    docs = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    pieces = sparkkit.cut(tokenized_pieces(docs, id_col, "_text", capacity, tokenizer_path or default_tokenizer()))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(SALTS)))
    counts = sparkkit.cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))  # capacity * SALTS rows at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, r0 long, r1 long, first long, each long, base long")
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start")) - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("k") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), "length").where("rank >= r0 and rank < r1")  # a few runs for each length
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", F.expr("first + (rank - r0) div each").alias("sequence_id"), F.expr("base + (rank - r0) % each * length").alias("offset"))
