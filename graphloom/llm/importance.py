"""Importance resampling towards a target distribution, with an exact distributed draw.

Features are runs of words, hashed to buckets.  A bucket's gain is the logarithm of
its share among the target's features over its share among all documents'; a
document's weight is the floored mean of its features' gains, looked up in one array.
Weight plus Gumbel noise, keyed by the document's id, is its score, so the documents
of highest score are a sample without replacement.

The draw needs the k-th key in the order (score falling, id, row).  It is found by
radix selection: counts of one digit of 16 bits at a time, over the rows that share
the digits found so far, which is 65,536 counts a round at most.  Only drawn rows are
then sorted, by ranges, and ranked from the counts of the ranges.

Rules: a null or wordless text has no features and weight 0; a null id has a null score
and is never drawn; rows with one id have one noise, each is drawn by itself, and those
with equal scores are ranked in any order; a document needs `least_words` words to be drawn;
empty tables give no rows, and an empty target only takes the smoothing's share; texts of
any length are read in pieces; ids are whole numbers; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

#: Words in UTF-8 with A-Z lower-cased: digits, letters and all that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Bits of a digit of the radix selection.
DIGIT = 16


class _Buckets(dict):
    """The bucket of each feature seen lately; a bounded memory of CRCs."""

    def __init__(self, buckets: int, most: int = 1 << 18) -> None:
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; no word is cut."""
    at, data = 0, text or b""
    while at < len(data):
        end = _cut_at(data, at + PIECE)
        yield _WORD.findall(data[at:end].translate(_LOWER))
        at = end


def _cut_at(data: bytes, at: int) -> int:
    """The first place from `at` on that is in no word."""
    gap = _GAP.search(data, at)
    return gap.start() if gap else len(data)


def bucket_arrays(text: bytes | None, n: int, cache: _Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end there) for each piece of a text."""
    tail: list[bytes] = []
    for words in word_lists(text):
        found = list(map(cache.__getitem__, words))
        whole = tail + words
        for m in range(2, n + 1):
            found += [cache[b" ".join(whole[i : i + m])] for i in range(max(0, len(tail) - m + 1), len(whole) - m + 1)]
        yield len(words), np.array(found, np.int64)
        tail = whole[-(n - 1) :] if n > 1 else []


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in (part for whole in batches for part in textkit.slices(whole)):
        yield batch, batch.column(column).cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of a table (text) fall in each bucket, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = _Buckets(buckets), np.zeros(buckets, np.int64)
        for _, column in _texts(batches, 0):
            for text in column:
                for _, found in bucket_arrays(text, n, cache):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = sparkkit.mapped(texts.select(F.col(texts.columns[0]).cast("string")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in target over that in raw."""
    buckets = len(raw)
    ratio = (target + 1.0) * (raw.sum() + float(buckets)) / ((raw + 1.0) * (target.sum() + float(buckets)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """Gumbel noise in thousandths, keyed by the id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) for docs (id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        cache = _Buckets(len(table))
        for batch, column in _texts(batches, 1):
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, column, strict=True):
                n_words = n_features = total = 0
                for words, found in bucket_arrays(text, n, cache):
                    n_words, n_features, total = n_words + words, n_features + len(found), total + int(table[found].sum())
                weight = total // n_features if n_features else 0
                rows.append((n_words, n_features, weight, None if doc_id is None else weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["id", "n_words", "n_features", "weight", "score"])

    return sparkkit.mapped(docs, run, "id long, n_words long, n_features long, weight long, score long")


def not_after_kth(rows: DataFrame, keys: list[str], k: int) -> Column:
    """Whether a row is among the first k of rows in the order of its keys, which are long columns or
    expressions without nulls.  Rows that tie on all keys are all in or all out."""
    if k <= 0:
        return F.lit(False)
    ends = rows.agg(*(f(F.expr(x)).alias(f"{name}{i}") for i, x in enumerate(keys) for name, f in (("low", F.min), ("high", F.max)))).first()
    parts: list[tuple[Column, int]] = []  # columns from 0 on, and their bits
    for i, x in enumerate(keys):
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        if high - low < 1 << 63:
            parts.append((F.expr(x) - F.lit(low), (high - low).bit_length()))
        else:
            parts += [(F.shiftright(F.expr(x), 32) - F.lit(low >> 32), ((high >> 32) - (low >> 32)).bit_length()), (F.expr(x).bitwiseAND(F.lit(0xFFFFFFFF)), 32)]
    same: list[Column] = []  # what the k-th key is known to have
    before: list[Column] = []  # what puts a row before it
    for value, bits in parts:
        known = 0
        for shift in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
            digit = F.shiftright(value, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            within = same + ([F.shiftright(value, shift + DIGIT) == F.lit(known)] if shift + DIGIT < 64 else [])
            counts = rows.where(reduce(Column.__and__, within, F.lit(True))).groupBy(digit.alias("digit")).count().orderBy("digit").collect()
            for found in counts:
                if k <= found["count"]:
                    break
                k -= found["count"]
            known = known << DIGIT | found["digit"]
            head = F.shiftright(value, shift)
            if k == found["count"]:  # all that have these digits are in
                return reduce(Column.__or__, [*before, reduce(Column.__and__, [*same, head <= F.lit(known)])])
        before.append(reduce(Column.__and__, [*same, value < F.lit(known)]))
        same.append(value == F.lit(known))
    return reduce(Column.__or__, [*before, reduce(Column.__and__, same, F.lit(True))])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id_col, n_features, weight, score, rank) for each row of docs; rank is null where it isn't drawn.

    floor(percent * N / 100) of the N documents with at least least_words words are drawn.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(target.select(target_col), n, buckets), bucket_counts(docs.select("text"), n, buckets))
    rows = sparkkit.stored(scored(docs, gain, n, seed).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    keys = ["~score", "id", "row"]
    drawn = able & not_after_kth(rows.where(able), keys, percent * rows.where(able).count() // 100)
    out = sparkkit.ranked(rows.where(drawn), keys, "rank").unionByName(rows.where(~F.coalesce(drawn, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
