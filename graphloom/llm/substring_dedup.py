"""Passages that repeat across documents, found by chaining shared k-mer seeds.

Every window of `window` successive k-mers of words gives its smallest as a seed,
so any run of k + window - 1 equal words shares one.  Equal seeds meet by a
shuffle on the seed; each text is matched with the first one and with the one
before it (in the order of a hash of the words), so matches are at most twice the
occurrences, never all pairs.  The texts of a seed that has more than a fixed part
of all occurrences are dealt to several groups by their hashes; the first text goes
to each of them, so no task meets a hot seed whole.  For each pair of texts the
ordered matches are chained: a chain's score is its matched words less a cost for
gaps on both sides, and the best predecessor of a match is found in a Fenwick tree
over places in the other text.  Chains are then aligned word by word over both
texts: ends are extended while that pays, gaps are aligned, and a passage is
reported where at least `min_words` words match at the rate `identity`; where the
whole of a chain does not reach it, its best runs are.

Two partners a seed can miss a passage whose seeds have different first texts.  So an
exact pass follows: in the stretches of a text whose seeds all occur in other texts,
every run of `min_words` words that no passage covers whole meets its equals by a
shuffle on its 128-bit hash, and all but the first text that holds it repeat that one.
After it, no such run is left uncovered in two texts, whatever partners were tried.

Passages with changed words may have partners of the same kind.  So what is left is
compared without regard to partners: places where two shared seeds lie from `LEAST`
parts of `min_words` to `REACH` words apart, one of them in more than three texts (all pairs of fewer were
tried), and no passage covers both, meet by a
shuffle on the two seeds (the n-th with the n-th), and all pairs of texts that meet
so are aligned, unless the words around both places have fewer in common than a
passage has matches.

Words are runs of non-space bytes, A-Z lower-cased.  Texts of equal word sequences
are one document for matching; all but the smallest id of them are passages from
their first word to their last.  Of two different texts, that with the larger hash
is said to repeat the other.

Rules: null, empty and short texts have no passages; repeats within one document
are not reported; runs under k + window - 1 words may share no seed, so `min_words`
is no less; repeated rows with one id are one document; an id with several
texts has the passages of each; a null id is left alone; an empty table gives no
rows; other columns are ignored by `passages` and kept by `cut_passages`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

K, WINDOW = 5, 10
#: Words between two matches on one diagonal that join them into one segment.
JOIN_GAP = 30
#: Unmatched words on either side that end a passage.
BREAK_GAP = 12
GAP_COST = 0.25
#: Words on either side of a chain of seeds in which all k-mers are compared; more where the chain goes on.
AROUND = 64
#: Least words of a chain, in hundredths of those of a passage; words within which two seeds of what is left are one place.
LEAST, REACH = 40, 100
#: Places of what is left that are compared with each other at once.
TILE = 512
#: A seed is hot from so many texts on, and from this part of all occurrences of seeds.
HOT, HOT_PART = 20_000, 16_384
#: Groups of seeds that are counted before single ones are.
BUCKETS = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def seeds(words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window-smallest k-mer hashes of a word sequence, and their places."""
    if len(words) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = textkit.shingle_hashes(words, k)
    if len(h) <= window:
        at = np.array([int(h.argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(h, window)
        at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return h[at], at


def _own_words(column: pa.Array) -> Iterator[np.ndarray]:
    for b in textkit.blocks(column):
        words = b.word_hashes(lower=True)
        for i in range(len(b)):
            yield words[b.bounds[i] : b.bounds[i + 1]]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words and the key of each text."""
    for batch in batches:
        rows = [(len(w), *textkit.key_of(w)) for w in _own_words(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64())))], names=["id", "n", "c", "d"])


def _seed_rows(k: int, window: int, least: int, clashing: frozenset[int]):
    """(h, c, p): a seed, a text that has it, and the seed's places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task give their seeds once
        for batch in batches:
            hs, cs, ps, ns = [], [], [], []
            for own in _own_words(batch.column(1)):
                if len(own) < least:
                    continue
                node = textkit.node_of(own, clashing)
                if node not in seen:
                    seen.add(node)
                    h, p = seeds(own, k, window)
                    order = np.argsort(h, kind="stable")
                    h, p = h[order], p[order].astype(np.int32)
                    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    hs.append(h[first])
                    ps.append(p)
                    ns.append(np.diff(np.append(first, len(h))))
                    cs.append(node)
            if hs:  # one row for each seed of a text, however often it comes there
                places = np.concatenate(ps)
                ends = np.append(0, np.cumsum(np.concatenate(ns)) * 4).astype(np.int32)
                places = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(places)])
                owners = np.repeat(np.array(cs, np.int64), [len(h) for h in hs])
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(np.concatenate(hs))), pa.array(owners), places], names=["h", "c", "p"])

    return run


def _dealt(rows: DataFrame, least: int) -> DataFrame:
    """Seed rows with the group s in which they are matched: 0, but for hot seeds.

    least bounds hot seeds from below; at most HOT_PART seeds have their part of all
    rows, so the table of hot seeds is bounded.  Counts are exact: only buckets of
    seeds that hold as many rows as a hot seed are counted seed by seed.
    """
    bucket = F.pmod("h", F.lit(BUCKETS)).cast("int")
    sizes = sparkkit.cut(rows.groupBy(bucket.alias("k")).agg(F.count("*").alias("n")))
    hot = max(least, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // HOT_PART))
    large = sizes.where(f"n >= {hot}").select("k")  # no more than BUCKETS
    among = rows.withColumn("k", bucket).join(F.broadcast(large), "k", "left_semi")
    table = sparkkit.cut(among.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("first")).where(f"n >= {hot}"))
    if table.isEmpty():
        return rows.withColumn("s", F.lit(0))
    table = table.select("h", "first", F.ceil(F.col("n") / (hot // 2)).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(table), "h", "left")
    own = F.array(F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    groups = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("c") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    return rows.select("h", "c", "p", F.explode(groups).alias("s"))


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From seeds (h, s, c, p) in the order of (seed, group, node): matches of each node's occurrences
    with those of the group's first node and of the node before it, the n-th with the n-th; of the first
    node, where it isn't alone, its places with themselves.  w is false only where the group has three nodes
    at most, of which all pairs are matched so."""
    held = last_key = None  # of the seed that is still open: its occurrences in its first node and its last
    for batch in batches:
        if not batch.num_rows:
            continue
        h, s, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        again = np.append(last_key == (h[0], s[0], c[0]), (h[1:] == h[:-1]) & (s[1:] == s[:-1]) & (c[1:] == c[:-1]))
        last_key = (h[-1], s[-1], c[-1])
        if again.any():  # the same text from another task
            batch = batch.filter(pa.array(~again))
            if not batch.num_rows:
                continue
            h, s, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        packed = batch.column(3).cast(pa.binary())
        bounds = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4)
        p = np.frombuffer(packed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.int32)
        times = np.diff(bounds) // 4
        h, s, c = np.repeat(h, times), np.repeat(s, times), np.repeat(c, times)
        fresh, told = 0, False
        if held is not None:
            fresh, told = len(held[0]), held[2][0] != held[2][-1]  # its first node's places were given
            h, s, c, p = (np.append(x, y) for x, y in zip(held, (h, s, c, p), strict=True))
        other_seed = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        starts = np.flatnonzero(np.append(True, other_seed | (c[1:] != c[:-1])))  # of groups (seed, share, node)
        sizes = np.diff(np.append(starts, len(h)))
        new_seed = np.append(True, other_seed)[starts]
        lead = np.maximum.accumulate(np.where(new_seed, np.arange(len(starts)), 0))
        group = np.repeat(np.arange(len(starts)), sizes)
        nth = np.arange(len(h)) - starts[group]
        own = np.arange(len(h)) >= fresh
        share = np.cumsum(new_seed) - 1
        wide = (np.bincount(share) > 3) | (s[starts][new_seed] > 0)
        wide[[0, -1]] = True  # they may go on in other batches
        wide = wide[share][group]
        for other, keep in ((lead[group], own & (lead[group] != group)), (group - 1, own & (group - 1 > lead[group]))):
            if keep.any():
                o = other[keep]
                at = starts[o] + np.minimum(nth[keep], sizes[o] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[keep], c[at], p[keep], p[at], wide[keep])], names=["b", "a", "p", "q", "w"])
        leads = new_seed & ~np.append(new_seed[1:], True)
        leads[0] &= not told
        keep = leads[group]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[keep], c[keep], p[keep], p[keep], wide[keep])], names=["b", "a", "p", "q", "w"])
        first, last = lead[-1], len(starts) - 1
        keep = np.isin(group, [first, last])
        held = (h[keep], s[keep], c[keep], p[keep])


class Fenwick:
    """Prefix maxima of (value, item) over n places."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def add(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def most(self, upto: int) -> tuple[float, int]:
        """Of the places before upto."""
        out = self.best[0]
        while upto > 0:
            if self.best[upto] > out:
                out = self.best[upto]
            upto -= upto & -upto
        return out


def segments(p: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Matches on one diagonal that lie close together, as (place, place in the other, length)."""
    d = q - p
    order = np.lexsort((p, d))
    p, d = p[order], d[order]
    new = np.append(True, (d[1:] != d[:-1]) | (p[1:] - p[:-1] > JOIN_GAP))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    return sorted(zip(p[at].tolist(), (p[at] + d[at]).tolist(), (p[last] - p[at] + k).tolist(), strict=True))


def chains(segs: list[tuple[int, int, int]], cost: float = GAP_COST, overlap: int = 0) -> list[list[tuple[int, int, int]]]:
    """Best collinear chains of segments, each segment in one at most; successive ones may overlap so far (they are then cut)."""
    if len(segs) == 1:
        return [segs]
    ends = sorted({q + n - overlap for _, q, n in segs})
    rank = {e: i for i, e in enumerate(ends)}
    tree, score, back = Fenwick(len(ends)), [0.0] * len(segs), [-1] * len(segs)
    done = sorted(range(len(segs)), key=lambda i: segs[i][0] + segs[i][2])
    ready, starts = 0, np.searchsorted(np.array(ends), [q for _, q, _ in segs], "right").tolist()
    for i, (p, q, n) in enumerate(segs):  # in the order of p
        while ready < len(done) and segs[done[ready]][0] + segs[done[ready]][2] - overlap <= p:
            j = done[ready]
            pj, qj, nj = segs[j]
            tree.add(rank[qj + nj - overlap], (score[j] + cost * (pj + qj + 2 * nj), j))
            ready += 1
        value, j = tree.most(starts[i])
        gain = value - cost * (p + q)
        score[i] = n + max(0.0, gain)
        back[i] = j if gain > 0 else -1
    used, out = [False] * len(segs), []
    for i in sorted(range(len(segs)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(segs[i])
            i = back[i]
        if chain:
            chain.reverse()
            for k, (p, q, _) in enumerate(chain[1:]):
                at, other, n = chain[k]
                chain[k] = (at, other, min(n, p - at, q - other))
            out.append(chain)
    return out


def _chained(k: int, window: int, min_words: int):
    """From matches in the order of (b, a, p): the promising chains of each pair, packed; and as pair (b, b)
    the stretches of b in which runs of min_words words can repeat (their number first), and the places
    of its shared seeds, twice each and one more where w holds."""
    least = LEAST * min_words // 100

    def of_pair(p: np.ndarray, q: np.ndarray) -> bytes | None:
        if p[-1] - p[0] + k < least:
            return None
        out: list[int] = []
        for chain in chains(segments(p, q, k)):
            if chain[-1][0] + chain[-1][2] - chain[0][0] >= least:
                out.append(len(chain))
                for s in chain:
                    out += s
        return np.array(out, np.int32).tobytes() if out else None

    def stretches(places: list[np.ndarray]) -> bytes | None:
        all_at = np.unique(np.concatenate(places))
        at = np.unique(all_at >> 1)
        first = np.flatnonzero(np.append(True, np.diff(at) > window))
        last = np.append(first[1:], len(at)) - 1
        wide = at[last] - at[first] >= min_words - k - 2 * (window - 1)  # a run's first seed and its last are so far apart
        spans = np.stack([np.maximum(at[first] - window + 1, 0), at[last] + k + window - 1], axis=1)[wide]
        marks = 2 * at + np.isin(at, all_at[all_at & 1 == 1] >> 1)
        near = any(len(i) for i, _ in _places(marks, least - k))
        if not len(spans) and not near:
            return None
        return np.concatenate([[len(spans)], spans.ravel(), marks if near else []]).astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []  # of the pair that is still open: no more than the seeds of one document
        places: list[np.ndarray] = []  # of all seeds of the text b that is still open
        key = None

        def close() -> tuple | None:
            got = of_pair(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts and key[0] != key[1] else None
            return (*key, got) if got else None

        def leave() -> tuple | None:
            got = stretches(places) if places else None
            return (key[1], key[1], got) if got else None

        for batch in batches:
            if not batch.num_rows:
                continue
            b, a, p, q, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            heads = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]))).tolist()
            out = []
            for s, e in zip(heads, [*heads[1:], len(b)], strict=True):
                if key != (a[s], b[s]):
                    out.append(close())
                    if key and key[1] != b[s]:
                        out.append(leave())
                        places = []
                    parts, key = [], (a[s], b[s])
                parts.append((p[s:e].astype(np.int64), q[s:e].astype(np.int64)))
                places.append(2 * parts[-1][0] + w[s:e])
            out = [x for x in out if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["a", "b", "payload"])
        for last in (close(), leave()):
            if last:
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["a", "b", "payload"])

    return run


def _common(x: list, y: list) -> int:
    """Length of the longest common subsequence, with a bit for each word of x."""
    places: dict = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | (1 << i)
    row = (1 << len(x)) - 1
    full = row
    for w in y:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def _extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How far two sequences go on alike from their start (mismatches cost two), and the matches in it."""
    at = got = 0
    while True:
        n = min(len(x) - at, len(y) - at, 256)
        if n <= 0:
            return at, got
        equal = x[at : at + n] == y[at : at + n]
        score = np.cumsum(np.where(equal, 1, -2))
        best = int(score.argmax())
        if score[best] <= 0:
            return at, got
        at, got = at + best + 1, got + int(equal[: best + 1].sum())
        if best + 1 < n:
            return at, got


def _best_runs(equal: np.ndarray, identity: float) -> list[tuple[int, int]]:
    """All maximal stretches whose matches outweigh their mismatches at this rate."""
    lost = -identity / (1 - identity) if identity < 1 else -float(len(equal) + 1)
    edges = np.flatnonzero(np.diff(equal.astype(np.int8))) + 1
    stack: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    total = 0.0
    for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(equal)], strict=True):
        if not equal[s]:
            total += lost * (e - s)
            continue
        before, total = total, total + (e - s)
        new = (s, e, before, total)
        while True:
            j = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][2] < new[2]), -1)
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
        stack.append(new)
    return [(s, e) for s, e, _, _ in stack]


def _columns(x: np.ndarray, y: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether words are equal along a chain, and their places in both; what is common in a gap stands at its end."""
    equal, ps, qs = [], [], []
    for i, (p, q, n) in enumerate(spans):
        if i:
            before, other, size = spans[i - 1]
            before, other = before + size, other + size
            wide = max(p - before, q - other)
            own = np.zeros(wide, bool)
            own[wide - _common(x[before:p].tolist(), y[other:q].tolist()) :] = True
            at = np.arange(-wide, 0)
            equal.append(own)
            ps.append(np.maximum(p + at, before))
            qs.append(np.maximum(q + at, other))
        equal.append(x[p : p + n] == y[q : q + n])
        ps.append(np.arange(p, p + n))
        qs.append(np.arange(q, q + n))
    return np.concatenate(equal), np.concatenate(ps), np.concatenate(qs)


def align(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int, int]], min_words: int, identity: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Passages (start, end, start and end in y, matched words) along a chain."""
    parts: list[list[tuple[int, int, int]]] = [[chain[0]]]
    for s in chain[1:]:
        p, q, n = parts[-1][-1]
        far = s[0] - p - n > BREAK_GAP or s[1] - q - n > BREAK_GAP
        if far:
            parts.append([s])
        else:
            parts[-1].append(s)
    for part in parts:
        matched = 0
        for k, (p, q, n) in enumerate(part):
            matched += int((x[p : p + n] == y[q : q + n]).sum())
            if k:
                pp, qq, nn = part[k - 1]
                matched += _common(x[pp + nn : p].tolist(), y[qq + nn : q].tolist())
        p0, q0, (p1, q1, n1) = part[0][0], part[0][1], part[-1]
        p1, q1 = p1 + n1, q1 + n1
        ahead, more = _extend(x[p1:], y[q1:])
        behind, less = _extend(x[:p0][::-1], y[:q0][::-1])
        p0, q0, p1, q1, matched = p0 - behind, q0 - behind, p1 + ahead, q1 + ahead, matched + more + less
        if p1 - p0 >= min_words and matched >= identity * max(p1 - p0, q1 - q0):
            yield p0, p1, q0, q1, matched
        else:  # what stretches of it do
            equal, ps, qs = _columns(x, y, [(p0, q0, behind), *part, (p1 - ahead, q1 - ahead, ahead)])
            for s, e in _best_runs(equal, identity):
                n, matched = max(ps[e - 1] - ps[s], qs[e - 1] - qs[s]) + 1, int(equal[s:e].sum())
                if ps[e - 1] - ps[s] + 1 >= min_words and matched >= identity * n:
                    yield int(ps[s]), int(ps[e - 1]) + 1, int(qs[s]), int(qs[e - 1]) + 1, matched


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling."""
    power, size, out, done, rest = words, 1, None, 0, n
    count = len(words) - n + 1
    while rest:
        if rest & 1:
            out = power[:count] if out is None else textkit.mix(out * _FACTOR + power[done : done + count])
            done += size
        rest >>= 1
        if rest:
            power, size = textkit.mix(power[:-size] * _FACTOR + power[size:]), 2 * size
    return out


def _places(marks: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of marked places least to REACH words apart, of which one is wide, by j - i."""
    at, wide = marks >> 1, marks & 1 == 1
    for d in range(1, len(at)):
        gap = at[d:] - at[:-d]
        if gap.min() >= REACH:
            break
        i = np.flatnonzero((gap >= least) & (gap < REACH) & (wide[d:] | wide[:-d]))
        yield i, i + d


class Left:
    """What of a text's stretches and shared seeds (see `_chained`) passages (p0, p1) don't cover whole."""

    def __init__(self, within: bytes, covered: list | None, min_words: int, k: int):
        numbers = np.frombuffer(within, np.int32).astype(np.int64)
        n = 1 + 2 * numbers[0]
        self.spans, self.marks, self.size, self.k = numbers[1:n].reshape(-1, 2), numbers[n:], min_words, k
        whole = [[-1, -1]]
        for s, e in sorted((x["p0"], x["p1"]) for x in covered or ()):
            if s > whole[-1][1]:
                whole.append([s, e])
            whole[-1][1] = max(whole[-1][1], e)
        self.starts, self.ends = np.array(whole).T

    def bare(self, p: np.ndarray, e: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.starts, p, "right") - 1] < e

    def runs(self) -> np.ndarray:
        """Places of runs."""
        at = np.concatenate([np.empty(0, np.int64), *(np.arange(s, e - self.size + 1) for s, e in self.spans.tolist())])
        return at[self.bare(at, at + self.size)]

    def pairs(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of seeds."""
        at = self.marks >> 1
        for i, j in _places(self.marks, least):
            keep = self.bare(at[i], at[j] + self.k)
            yield i[keep], j[keep]


def _some_left(min_words: int, k: int):
    """The rows (id, b, stretches, covered) with something left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in textkit.slices(whole)):
            left = (Left(w, c, min_words, k) for w, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            yield batch.filter(pa.array([len(x.runs()) > 0 or any(len(i) for i, _ in x.pairs(LEAST * min_words // 100 - k)) for x in left], pa.bool_()))

    return run


def _left(min_words: int, k: int, clashing: frozenset[int]):
    """From (text, node, stretches and places, covered), what isn't covered whole: kind 0 with (g, g2, c, p), hashes and
    places of runs in stretches; kind 1 with (g, p, g2), the hash and the places of two shared seeds."""
    least = LEAST * min_words // 100 - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in textkit.slices(whole)):
            for text, node, within, covered in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = sparkkit.word_ids(text, lower=True)
                if len(own) < min_words or textkit.node_of(own, clashing) != node:  # another text of that id
                    continue
                left, rows = Left(within, covered, min_words, k), []
                at = left.runs()
                at = at[at <= len(own) - min_words]
                if len(at):
                    rows.append((0, *(textkit.signed(run_hashes(w, min_words)[at]) for w in (own, textkit.mix(own ^ _FACTOR))), at))
                shared = left.marks >> 1
                h = textkit.shingle_hashes(own, k)[shared]
                order = np.argsort(h, kind="stable")
                before = np.full(len(h), -1)  # the place of the same seed before
                again = np.flatnonzero(h[order][1:] == h[order][:-1])
                before[order[again + 1]] = order[again]
                pairs = [np.empty((2, 0), np.int64)]
                for i, j in left.pairs(least):  # of equal seeds j the nearest only
                    nearer = (before[j] > i) & (shared[before[j]] - shared[i] >= least)
                    pairs.append(np.stack([i[~nearer], j[~nearer]]))
                i, j = np.concatenate(pairs, axis=1)
                if len(i):
                    g = textkit.mix(h[i] * _FACTOR + h[j])
                    order = np.lexsort((shared[i], g))
                    g, i, j = g[order], i[order], j[order]
                    new = np.append(True, g[1:] != g[:-1])
                    nth = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
                    rows.append((1, textkit.signed(textkit.mix(g + nth.astype(np.uint64))), shared[j], shared[i]))
                for kind, g, g2, p in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), kind, np.int32)), pa.array(g), pa.array(g2), pa.array(np.full(len(p), node, np.int64)), pa.array(p.astype(np.int32))], names=["kind", "g", "g2", "c", "p"])

    return run


def _what_is_left(docs: DataFrame, within: DataFrame, found: DataFrame, min_words: int, k: int, clashing: frozenset[int]) -> DataFrame:
    """(kind, g, g2, c, p): see `_left`; within: (id, b, stretches)."""
    covered = found.groupBy("b").agg(F.collect_set(F.struct("p0", "p1")).alias("covered"))
    within = within.join(covered, "b", "left").select("id", "b", "stretches", "covered")
    within = sparkkit.cut(sparkkit.mapped(within, _some_left(min_words, k), within.schema))
    texts = sparkkit.reduced(docs, within).join(within, "id").select("text", "b", "stretches", "covered")
    return sparkkit.stored(sparkkit.mapped(texts, _left(min_words, k, clashing), "kind int, g long, g2 long, c long, p int"))


def _missed(runs: DataFrame, min_words: int) -> DataFrame:
    """(a, b, p0, p1, q0, q1, matched): runs (g, g2, c, p) of b that are in a too.

    The first text of a run comes from a combined minimum, and a run that very many
    texts hold meets it in a join that adaptive execution splits.
    """
    first = runs.groupBy("g", "g2").agg(F.min(F.struct("c", "p")).alias("first"), F.max("c").alias("last")).where("first.c <> last").drop("last")
    again = runs.join(first, ["g", "g2"]).where("c <> first.c").selectExpr("c as b", "first.c as a", "p", "first.p as q")
    along = Window.partitionBy("b", "a").orderBy("p")  # no more than the words of b
    again = again.withColumn("new", F.coalesce((F.col("p") > F.lag("p").over(along) + 1).cast("int"), F.lit(1)))
    again = again.withColumn("nth", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [f(x).alias(y) if f is F.min else (f(x) + min_words).alias(y) for f, x, y in ((F.min, "p", "p0"), (F.max, "p", "p1"), (F.min, "q", "q0"), (F.max, "q", "q1"))]
    return again.groupBy("a", "b", "nth").agg(*ends).selectExpr("a", "b", "p0", "p1", "q0", "q1", "p1 - p0 as matched")


def _surroundings(k: int, clashing: frozenset[int]):
    """From (text, node, places (g, p, e)): (g, c, p, e, words), the words around each place, the n-th of equal ones told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in textkit.slices(whole)):
            for text, node, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sparkkit.word_ids(text, lower=True)
                if textkit.node_of(own, clashing) != node:  # another text of that id
                    continue
                for some in (places[at : at + 1024] for at in range(0, len(places), 1024)):
                    around = []
                    for x in some:
                        w = np.sort(own[max(x["p"] - AROUND, 0) : x["e"] + k + AROUND])
                        nth = np.arange(len(w)) - np.searchsorted(w, w, "left")
                        around.append(textkit.mix(w + nth.astype(np.uint64)).astype(np.uint32).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x["g"] for x in some], pa.int64()), pa.array([node] * len(some), pa.int64()), *(pa.array([x[c] for x in some], pa.int32()) for c in "pe"), pa.array(around, pa.binary())], names=["g", "c", "p", "e", "words"])

    return run


def _alike(least: int):
    """From places (g, c, p, e, words) in the order of (g, c): (a, b, p, q) of both seeds of all pairs with
    at least that many words in common around them; a product of places and words, tile by tile."""

    def of_group(c: np.ndarray, p: np.ndarray, e: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = [len(w) // 4 for w in words]
        flat = np.frombuffer(b"".join(words), np.uint32)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(words)), sizes)
        keep = times[column] > 1  # words of one place only are common to none
        names, column = np.unique(column[keep], return_inverse=True)
        row = row[keep]
        bounds = np.searchsorted(row, np.arange(0, len(words) + TILE, TILE))

        def tile(t: int) -> np.ndarray:
            out = np.zeros((min(TILE, len(words) - t * TILE), len(names)), np.float32)
            out[row[bounds[t] : bounds[t + 1]] - t * TILE, column[bounds[t] : bounds[t + 1]]] = 1
            return out

        for t in range(-(-len(words) // TILE)):
            mine = tile(t)
            for u in range(t + 1):
                y, x = np.nonzero(mine @ (mine if u == t else tile(u)).T >= least)
                y, x = y + t * TILE, x + u * TILE
                y, x = y[c[y] > c[x]], x[c[y] > c[x]]
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (np.tile(c[x], 2), np.tile(c[y], 2), np.append(p[y], e[y]), np.append(p[x], e[x]))], names=["a", "b", "p", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # of the pair of seeds that is still open
        for batch in batches:
            if not batch.num_rows:
                continue
            g, c, p, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            words = batch.column(4).to_pylist()
            heads = np.flatnonzero(np.append(True, g[1:] != g[:-1])).tolist()
            for s, t in zip(heads, [*heads[1:], len(g)], strict=True):
                if held and held[0][0] != g[s]:
                    yield from of_group(*(np.concatenate([x[i] for x in held]) for i in (1, 2, 3)), [w for x in held for w in x[4]])
                    held = []
                held.append([g[s], c[s:t], p[s:t], e[s:t], words[s:t]])
        if held:
            yield from of_group(*(np.concatenate([x[i] for x in held]) for i in (1, 2, 3)), [w for x in held for w in x[4]])

    return run


def _untried(docs: DataFrame, places: DataFrame, found: DataFrame, first: DataFrame, least: int, k: int, clashing: frozenset[int]) -> DataFrame:
    """(a, b, met): all pairs of texts that meet at two places (g, c, p, e) which found doesn't cover, with their equal seeds."""
    covered = found.groupBy(F.col("b").alias("c")).agg(F.collect_set(F.struct("p0", "p1")).alias("covered"))
    places = places.join(covered, "c", "left").where(f"covered is null or not exists(covered, x -> x.p0 <= p and x.p1 >= e + {k})").drop("covered")
    met = places.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("g")
    places = sparkkit.cut(places.join(met, "g").groupBy("c").agg(F.collect_list(F.struct("g", "p", "e")).alias("places")).join(first.withColumnRenamed("node", "c"), "c").select(F.col("rep").alias("id"), "c", "places"))
    texts = sparkkit.reduced(docs, places).join(places, "id").select("text", "c", "places")
    around = sparkkit.mapped(texts, _surroundings(k, clashing), "g long, c long, p int, e int, words binary").dropDuplicates(["g", "c"])
    pairs = sparkkit.mapped(around.repartition("g").sortWithinPartitions("g", "c"), _alike(least), "a long, b long, p int, q int")
    return pairs.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("p", "q"))).alias("met"))


def _meeting(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal k-mers of two word sequences, the n-th with the n-th."""
    hx, hy = textkit.shingle_hashes(x, k), textkit.shingle_hashes(y, k)
    ox, oy = np.argsort(hx, kind="stable"), np.argsort(hy, kind="stable")
    sx, sy = hx[ox], hy[oy]
    nth = np.arange(len(sx)) - np.searchsorted(sx, sx, "left")
    low, high = np.searchsorted(sy, sx, "left"), np.searchsorted(sy, sx, "right")
    has = high > low
    return ox[has], oy[np.minimum(low + nth, high - 1)[has]]


def refined(x: np.ndarray, y: np.ndarray, found: list[list[tuple[int, int, int]]], k: int, min_words: int, identity: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Passages (start, end, start and end in y, matched words) around chains of seeds.

    Seeds tell where two texts meet; there all k-mers are chained anew and aligned.  What is
    looked at grows as long as a chain comes near its border.
    """
    done: list[tuple[int, int, int, int]] = []
    for chain in sorted(found, key=lambda c: (c[0][0] - c[-1][0] - c[-1][2], c)):
        p0, q0, p1, q1 = *chain[0][:2], chain[-1][0] + chain[-1][2], chain[-1][1] + chain[-1][2]
        if any(a <= p0 and p1 <= b and c <= q0 and q1 <= d for a, b, c, d in done):
            continue
        margin = AROUND
        while True:
            s, e, t, f = max(p0 - margin, 0), min(p1 + margin, len(x)), max(q0 - margin, 0), min(q1 + margin, len(y))
            p, q = _meeting(x[s:e], y[t:f], k)
            dense = [[(a + s, b + t, n) for a, b, n in c] for c in chains(segments(p, q, k), overlap=k - 1)] if len(p) else [chain]
            ours = [c for c in dense if c[0][0] < p1 and c[-1][0] + c[-1][2] > p0]
            edge = margin // 2
            before = any((s and c[0][0] < s + edge) or (t and c[0][1] < t + edge) for c in ours)
            after = any((e < len(x) and c[-1][0] + c[-1][2] > e - edge) or (f < len(y) and c[-1][1] + c[-1][2] > f - edge) for c in ours)
            if not before and not after:
                break
            margin *= 2
        got = [r for c in dense for r in align(x, y, c, min_words, identity)]
        done += [r[:4] for r in got]
        yield from got


def _found(docs: DataFrame, id_col: str, text_col: str, min_words: int, identity: float, k: int, window: int, hot: int) -> tuple[DataFrame, frozenset[int]]:
    """(id, node, p0, p1, matched, source, q0, q1): passages of the texts (nodes) of documents; and the clashing keys."""
    docs = docs.where(f"`{id_col}` is not null").select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    described = sparkkit.cut(sparkkit.mapped(docs, _describe, "id long, n int, c long, d long").where(f"n >= {min_words}"))
    known, clashing = sparkkit.one_key_each(described)
    first = sparkkit.cut(known.groupBy("node").agg(F.min("id").alias("rep")))

    rows = sparkkit.stored(sparkkit.mapped(docs, _seed_rows(k, window, min_words, clashing), "h long, c long, p binary"))
    rows = _dealt(rows, hot).select("h", "s", "c", "p").repartition("h", "s").sortWithinPartitions("h", "s", "c")
    met = sparkkit.mapped(rows, _matches, "b long, a long, p int, q int, w boolean")
    met = met.repartition("b").sortWithinPartitions("b", "a", "p", "q")
    pairs = sparkkit.mapped(met, _chained(k, window, min_words), "a long, b long, payload binary")
    ends = {x: first.select(F.col("node").alias(x), F.col("rep").alias(f"r{x}")) for x in ("a", "b")}
    pairs = sparkkit.cut(pairs.join(ends["a"], "a").join(ends["b"], "b"))
    within = pairs.where("a = b").selectExpr("rb as id", "b", "payload as stretches")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with their equal seeds as the promising chains of these."""
        for batch in (part for whole in batches for part in textkit.slices(whole)):
            rows = []
            for *ends, met in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                found = chains(segments(*(np.array([x[c] for x in met], np.int64) for c in "pq"), k))
                flat = [n for c in found if c[-1][0] + c[-1][2] - c[0][0] >= LEAST * min_words // 100 for n in (len(c), *(y for x in c for y in x))]
                if flat:
                    rows.append((*ends, np.array(flat, np.int32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["a", "b", "ra", "rb", "payload"])

    def judge(y, x, payload):
        numbers, at, met = np.frombuffer(payload, np.int32).tolist(), 0, []
        while at < len(numbers):
            n = numbers[at]
            flat = numbers[at + 1 : at + 1 + 3 * n]
            met.append(list(zip(flat[::3], flat[1::3], flat[2::3], strict=True)))
            at += 1 + 3 * n
        out, end = [], -1  # none that lies within another of this pair
        for r in sorted(set(refined(x, y, met, k, min_words, identity)), key=lambda r: (r[0], -r[1], -r[4], r)):
            if r[1] > end:
                end = r[1]
                out.append(r)
        return out

    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())] + [(c, pa.int32()) for c in ("p0", "p1", "q0", "q1", "matched")])

    def aligned(pairs: DataFrame) -> DataFrame:
        return sparkkit.cut(sparkkit.with_pairs(docs, pairs, judge, lambda t: sparkkit.word_ids(t, lower=True), clashing, "a long, b long, p0 int, p1 int, q0 int, q1 int, matched int", arrow))

    found = aligned(pairs.where("a <> b"))
    left = _what_is_left(docs, within, found, min_words, k, clashing)
    exact = sparkkit.cut(_missed(left.where("kind = 0"), min_words))
    untried = _untried(docs, left.where("kind = 1").selectExpr("g", "c", "p", "cast(g2 as int) as e"), exact, first, math.ceil(identity * min_words), k, clashing)
    untried = untried.join(ends["a"], "a").join(ends["b"], "b").select("a", "b", "ra", "rb", "met")
    rest = aligned(sparkkit.cut(sparkkit.mapped(untried, packed, "a long, b long, ra long, rb long, payload binary")))
    rest = rest.join(found.select("a", "b", "p0", "p1"), ["a", "b", "p0", "p1"], "left_anti")
    found = found.unionByName(exact).unionByName(rest)
    found = found.join(ends["a"], "a").join(ends["b"], "b").select(F.col("rb").alias("id"), F.col("b").alias("node"), "p0", "p1", "matched", F.col("ra").alias("source"), "q0", "q1")
    whole = known.join(first, "node").where("id <> rep").dropDuplicates(["id", "node"])
    return found.union(whole.selectExpr("id", "node", "0", "n", "n", "rep", "0", "n")), clashing


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, identity: float = 0.8, k: int = K, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(id_col, start_word, end_word, n_words, matched_words, source_id, source_start, source_end).

    Words start_word to end_word (excluded) of a document repeat those of source_id.
    """
    found, _ = _found(docs, id_col, text_col, min_words, identity, k, window, hot)
    return found.selectExpr(f"id as `{id_col}`", "p0 as start_word", "p1 as end_word", "p1 - p0 as n_words", "matched as matched_words", "source as source_id", "q0 as source_start", "q1 as source_end")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans; what stands around them stays."""
    b = textkit.one_block(text)
    out, at = [], 0
    for s, e in sorted(spans):
        start = int(b.starts[s])
        if start > at:
            out.append(b.buf[at:start].tobytes())
        at = max(at, int(b.starts[e]) if e < len(b.starts) else len(b.buf))
    out.append(b.buf[at:].tobytes())
    return b"".join(out).decode("utf-8", "replace")


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """docs without the passages that repeat another document, which keeps them; texts left wordless go.

    count_col, where docs has it, becomes the new text's number of characters.
    """
    found, clashing = _found(docs, id_col, text_col, min_words, identity, K, WINDOW, HOT)
    spans = found.groupBy("id").agg(F.collect_set(F.struct("node", "p0", "p1")).alias("spans"))
    names = docs.columns
    at, count_at = names.index(text_col), names.index(count_col) if count_col in names else None
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    joined = inner.join(spans.select(F.col("id").alias("s_id"), "spans"), F.col(f"c{names.index(id_col)}") == F.col("s_id"), "left").drop("s_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in textkit.slices(whole, 1024)):
            spans, cols = batch.column(len(names)).to_pylist(), list(batch.columns[: len(names)])
            if any(spans):
                texts = cols[at].to_pylist()
                counts = cols[count_at].to_pylist() if count_at is not None else None
                keep = [True] * len(texts)
                for i, own in enumerate(spans):
                    if own and texts[i] is not None:
                        node = textkit.node_of(sparkkit.word_ids(texts[i], lower=True), clashing)
                        own = [(s["p0"], s["p1"]) for s in own if s["node"] == node]
                    if own and texts[i] is not None:
                        texts[i] = without_words(texts[i], own)
                        keep[i] = bool(texts[i].strip(" \t\n\v\f\r"))
                        if counts is not None:
                            counts[i] = len(texts[i])
                cols[at] = pa.array(texts, cols[at].type)
                if counts is not None:
                    cols[count_at] = pa.array(counts, cols[count_at].type)
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))]).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))])

    return sparkkit.mapped(joined, run, inner.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
