"""Quality rules with thresholds that follow each language and source.

Word, symbol, line and repetition counts are taken from every whole text.  Counts
of bucketed values are a quantile sketch: buckets keep the top eight bits of a value
(at most 1/128 off), so sketches merge by adding counts.  One sketch of each ratio is
gathered for each (language, source) and merged over the sources of a language, and
over everything.

Ratios of symbols, repeated lines and repeated words use what a count surely exceeds
(the count less twice its root), so that short texts are not judged by a single
occurrence.  A group's quantiles are averaged with its language's, which are averaged
with everything's, as if those had `weight` documents in the group.  The bound comes
from the highest of the LEVELS up to which the tail grows without a break: each
level's quantile is at most `grow` times the one before plus `step` thousandths.  It is
`grow` times that quantile plus `step`, the first value that would be a break.  Junk
that makes up to 20 % of a group, apart from the tail of its prose, so lies beyond.

Lengths of words are bounded by the group's upper quantile plus `spread` times its
distance from the median (the group's or everything's, whichever is larger), and as
far under the lower one; groups of fewer than `least_docs` take the bounds of their
language, or everything's.

Rules: a null text has no words and fails the base rule; null languages or sources
are groups of their own; repeated rows are judged one by one but make one
entry of a sketch, so copies don't set the bounds; an empty table gives no rows; other input columns are kept by
`filter_documents` and ignored by `quality_report`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

#: ratio in thousandths: numerator, denominator, whether it counts occurrences (else it is bounded from below too)
RATIOS = {
    "sym": ("n_symbols", "n_words", True),
    "dup": ("n_dup_lines", "n_lines", True),
    "rep": ("n_repeat_words", "n_words", True),
    "len": ("word_chars", "n_words", False),
}
#: Quantiles in thousandths: those that bounds of occurrences climb, and the lower, middle and upper one of lengths.
LEVELS, LENGTHS = (800, 850, 900, 950, 970, 980, 990, 995), (200, 500, 800)
QUANTILES = sorted({*LEVELS, *LENGTHS})
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offs[1:]] - total[offs[:-1]]


def text_counts(column: pa.Array) -> np.ndarray:
    """The COUNTS of each text of a string column, a row for each."""
    out = [np.empty((0, len(COUNTS)), np.int64)]
    for b in textkit.blocks(column):
        rows = np.zeros((len(b), len(COUNTS)), np.int64)
        rows[:, 0] = np.diff(b.bounds)
        rows[:, 1] = _per_text(~textkit.SPACE[b.buf] & ((b.buf & 0xC0) != 0x80), b.offs)
        rows[:, 2] = _per_text(_SYMBOLS[b.buf], b.offs)
        words = b.word_hashes()
        # lines that hold a word: from the line break before it to the next one
        breaks = np.flatnonzero(b.buf == 10)
        starts = np.unique(np.concatenate([breaks + 1, b.offs[:-1]]))
        starts = starts[starts < len(b.buf)]
        next_break = np.append(breaks, len(b.buf))[np.searchsorted(breaks, starts)]
        ends = np.minimum(next_break, b.offs[np.searchsorted(b.offs, starts, "right")])
        filled = np.searchsorted(b.starts, ends) > np.searchsorted(b.starts, starts)
        starts, ends = starts[filled], ends[filled]
        lines = b.span_hashes(starts, ends)
        line_at = np.searchsorted(starts, b.offs)
        for i in range(len(b)):
            own = lines[line_at[i] : line_at[i + 1]]
            rows[i, 5] = len(own)
            if len(own) > 1:
                rows[i, 3] = len(own) - len(np.unique(own))
            w = words[b.bounds[i] : b.bounds[i + 1]]
            if len(w) > 3:
                triples = textkit.shingle_hashes(w, 3)
                order = np.argsort(triples)
                equal = triples[order[1:]] == triples[order[:-1]]
                if equal.any():
                    again = np.zeros(len(w), bool)
                    at = np.concatenate([order[1:][equal], order[:-1][equal]])
                    for k in range(3):
                        again[at + k] = True
                    rows[i, 4] = int(again.sum())
        out.append(rows)
    return np.concatenate(out)


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "", drop_text: bool = False) -> DataFrame:
    """docs with the COUNTS of its text as further columns, named with the prefix."""
    names = [prefix + c for c in COUNTS]
    keep = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]
    if set(names) & {f.name for f in keep}:
        raise ValueError("the prefix makes names that docs already has")
    schema = docs.select(*[f.name for f in keep]).schema
    for name in names:
        schema = schema.add(name, "long")

    at, kept = docs.columns.index(text_col), [docs.columns.index(f.name) for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_counts(batch.column(at))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(rows[:, j]) for j in range(len(COUNTS))], names=[batch.schema.names[i] for i in kept] + names)

    return sparkkit.mapped(docs, run, schema)


def _ratio(name: str, prefix: str = "") -> str:
    over, under, occurrences = (f"{prefix}{x}" if isinstance(x, str) else x for x in RATIOS[name])
    if occurrences:
        over = f"greatest(0, {over} - cast(ceil(2 * sqrt({over})) as long))"
    return f"if({under} > 0, 1000 * {over} div {under}, 0)"


def base_failed(prefix: str = "") -> str:
    return f"({prefix}n_words < 50 or 100 * {prefix}n_repeat_words > 50 * {prefix}n_words)"


def thresholds(counts: DataFrame, least_docs: int = 50, spread: int = 8, weight: int = 20, grow: int = 2, step: int = 50) -> DataFrame:
    """(g_lang, g_source, and lo_* and hi_* of each ratio), a row for each group of counts.

    counts has g_lang, g_source and the COUNTS.  Only documents that pass the base rule
    count, and those of a group with the same counts (copies) once.
    """
    values = [F.struct(F.lit(r).alias("ratio"), F.expr(_ratio(r)).cast("long").alias("v")) for r in RATIOS]
    once = counts.where(f"not {base_failed()}").select("g_lang", "g_source", *COUNTS).distinct()
    each = once.select("g_lang", "g_source", F.explode(F.array(*values)).alias("x")).select("g_lang", "g_source", "x.ratio", "x.v")
    bucket = F.expr("v - v % cast(pow(2, greatest(length(bin(v)) - 8, 0)) as long)")
    sketch = sparkkit.cut(each.groupBy("g_lang", "g_source", "ratio", bucket.alias("v")).agg(F.count("*").alias("n")))

    def quantiles(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "ratio", "v").agg(F.sum("n").alias("n"))
        by = "partition by " + ", ".join([*keys, "ratio"])
        merged = merged.withColumn("upto", F.expr(f"sum(n) over ({by} order by v)")).withColumn("total", F.expr(f"sum(n) over ({by})"))
        q = [F.min(F.expr(f"if(1000 * upto >= {p} * total, v, null)")).alias(f"q{p}") for p in QUANTILES]
        return merged.groupBy(*keys, "ratio").agg(*q, F.max("total").alias("total"))

    picked = counts.select("g_lang", "g_source").distinct().withColumn("ratio", F.explode(F.array(*map(F.lit, RATIOS))))
    for k, keys in enumerate((["g_lang", "g_source"], ["g_lang"], [])):
        part = quantiles(keys).select(*keys, "ratio", F.struct(*[f"q{p}" for p in QUANTILES], "total").alias(f"s{k}"))
        picked = picked.join(part if keys else F.broadcast(part), [*keys, "ratio"], "left")

    def shrunk(p: int) -> str:
        out = f"s2.q{p}"
        for s in ("s1", "s0"):
            out = f"coalesce(({s}.total * {s}.q{p} + {weight} * {out}) div ({s}.total + {weight}), {out})"
        return out

    low, mid, high = (f"q{p}" for p in LENGTHS)
    picked = picked.withColumn("own", F.expr(f"coalesce(if(s0.total >= {least_docs}, s0, null), if(s1.total >= {least_docs}, s1, null), s2)"))
    reached = f"aggregate(array({', '.join(map(shrunk, LEVELS[1:]))}), {shrunk(LEVELS[0])}, (a, v) -> if(v <= {grow} * a + {step}, v, a))"
    bounds = {
        True: (f"{grow} * {reached} + {step}", "0L"),
        False: (f"own.{high} + {spread} * greatest(own.{high} - own.{mid}, s2.{high} - s2.{mid})", f"own.{low} - {spread} * greatest(own.{mid} - own.{low}, s2.{mid} - s2.{low})"),
    }
    cols = [F.max(F.expr(f"if(ratio = '{r}', {bound}, null)")).alias(f"{side}_{r}") for r, (*_, kind) in RATIOS.items() for side, bound in zip(("hi", "lo"), bounds[kind], strict=True)]
    return picked.groupBy("g_lang", "g_source").agg(*cols)


def verdict(prefix: str = "") -> str:
    bounds = [f"({_ratio(r, prefix)} <= coalesce(hi_{r}, 9223372036854775807) and {_ratio(r, prefix)} >= coalesce(lo_{r}, -1))" for r in RATIOS]
    return f"(not {base_failed(prefix)} and {' and '.join(bounds)})"


def _group(lang_col: str, source_col: str) -> list:
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(name) for c, name in ((lang_col, "g_lang"), (source_col, "g_source"))]


#: A table of thresholds with no more rows than this goes to all executors; a larger one is shuffled.
BROADCAST_GROUPS = 20_000


def _joined(docs: DataFrame, limits: DataFrame) -> DataFrame:
    limits = sparkkit.cut(limits)
    small = limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return docs.join(F.broadcast(limits) if small else limits, ["g_lang", "g_source"], "left")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: id_col, the counts, base_failed and kept."""
    docs = docs.select(id_col, *_group(lang_col, source_col), F.col(text_col).cast("string").alias("_text"))
    counts = sparkkit.cut(with_counts(docs, "_text", drop_text=True))
    out = _joined(counts, thresholds(counts))
    return out.select(id_col, *COUNTS, F.expr(base_failed()).alias("base_failed"), F.expr(verdict()).alias("kept"))


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    slim = docs.select(*_group(lang_col, source_col), F.col(text_col).cast("string").alias("_text"))
    limits = thresholds(sparkkit.cut(with_counts(slim, "_text", drop_text=True)))
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *_group(lang_col, source_col))
    counted = with_counts(inner, f"c{docs.columns.index(text_col)}", prefix="q_")
    kept = _joined(counted, limits).where(verdict("q_"))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
