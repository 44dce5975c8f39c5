"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are 1- to 3-grams of the lower-cased code points, hashed to 2**15 places,
with logarithmic counts, inverse document frequencies and unit length.  Training
is follow-the-regularised-leader (proximal) with L1 and L2 penalties, on
about `per_lang` labelled documents of every label (those whose hash of the id lies
under a bound that follows from the label's count; fewer of each, but `LEAST_LANG`,
where labels are so many that they pass `SAMPLE`), a fifth of which only set the temperature by which
scores are divided.  Predictions read every whole text and nothing else.

Rules: a null text, or one without a letter, is `und` with score 0; with no
labelled rows every row is `und`; null labels and null ids don't train; repeated
rows are predicted one by one; very long texts are counted in pieces, whole; an empty
table gives no rows; other columns, of whatever names, are ignored or kept.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

PLACES = 1 << 15
ORDERS = (1, 2, 3)
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 22
#: Documents to train on, unless LEAST_LANG of each label are more.
SAMPLE, LEAST_LANG = 25_600, 50
#: A table of labels with no more rows than this goes to all executors.
BROADCAST_LANGS = 100_000
#: Values of the hash of an id by which documents are picked.
HASHES = 1 << 40


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's n-grams, and their counts."""
    total = np.zeros(PLACES, np.int64)
    for at in range(0, len(text), _PIECE):  # pieces overlap by what a last n-gram needs
        lead = min(at, max(ORDERS) - 1)
        cps = np.frombuffer(text[at - lead : at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if at:
            lead = min(lead, len(cps))
        h = np.zeros(len(cps), np.uint32)
        for n in ORDERS:
            if len(cps) < n:
                break
            h = (h[: len(cps) - n + 1] * np.uint32(0x01000193)) ^ (cps[n - 1 :] * np.uint32(0x9E3779B1))
            own = h[max(0, lead - n + 1) :]
            total += np.bincount(((own * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64), minlength=PLACES)
    places = np.flatnonzero(total)
    return places.astype(np.int32), total[places]


def _vector(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[places]
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> dict | None:
    """A model from (places, counts, label) rows."""
    samples = [s for s in samples if len(s[0])]
    if not samples:
        return None
    langs = sorted({s[2] for s in samples})
    df = np.zeros(PLACES)
    for places, _, _ in samples:
        df[places] += 1
    idf = np.log((1 + len(samples)) / (1 + df)) + 1
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = order[: len(samples) // 5]
    rows = [(p, _vector(p, c, idf), langs.index(y)) for p, c, y in samples]
    z, n = np.zeros((PLACES + 1, len(langs))), np.zeros((PLACES + 1, len(langs)))

    def weights(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    fit = order[len(samples) // 5 :]
    for _ in range(epochs):
        for i in rng.permutation(fit):
            places, v, y = rows[i]
            at = np.append(places, PLACES)  # the last place is the bias
            x = np.append(v, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(slice(None)).astype(np.float32)
    scores = np.array([v @ w[p] + w[PLACES] for p, v, _ in (rows[i] for i in held)]).reshape(len(held), len(langs))
    truth = np.array([rows[i][2] for i in held], int)

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean())

    heats = np.geomspace(0.05, 20, 121)
    heat = float(heats[int(np.argmin([loss(t) for t in heats]))]) if len(held) and len(langs) > 1 else 1.0
    return {"langs": langs, "idf": idf.astype(np.float32), "w": w, "heat": heat}


def predict_text(model: dict | None, text: str | None) -> tuple[str, float]:
    if model is None or not text or not _LETTER.search(text):
        return "und", 0.0
    places, counts = gram_counts(text)
    p = _softmax((_vector(places, counts, model["idf"]) @ model["w"][places] + model["w"][PLACES]) / model["heat"])
    k = int(p.argmax())
    return model["langs"][k], float(min(1.0, p[k]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400) -> dict | None:
    """A model from the rows of docs with a label, but for those whose crc32(id as text) mod 4 is 2."""
    rows = docs.where(f"`{lang_col}` is not null and crc32(cast(`{id_col}` as string)) % 4 <> 2").select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # by the ids' hashes: for each label the bound under which about per_lang of its rows lie
    sizes = sparkkit.cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    langs = sizes.count()
    per_lang = min(per_lang, max(LEAST_LANG, SAMPLE // max(1, langs)))
    bounds = sizes.select("lang", F.expr(f"cast(least({HASHES}, ceil({per_lang} * {HASHES} / n)) as long)").alias("bound"))  # a row for each label
    sample = rows.join(F.broadcast(bounds) if langs <= BROADCAST_LANGS else bounds, "lang").where(F.pmod(F.xxhash64("id"), F.lit(HASHES)) < F.col("bound"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [gram_counts(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=["id", "lang", "places", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            for row in batch.to_pylist():
                samples.append((row["id"], np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int64), row["lang"]))
        samples.sort(key=lambda s: (s[0], s[3], s[1].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([s[1:] for s in samples]))], pa.binary())], names=["model"])

    kind = dict(docs.dtypes)
    got = sparkkit.mapped(sample.select("id", "lang", "text"), features, f"id {kind[id_col]}, lang string, places binary, counts binary")
    model = sparkkit.mapped(got.repartition(1), learn, "model binary").collect()
    return pickle.loads(model[0][0]) if model else None


def with_language(docs: DataFrame, model: dict | None, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if not (drop_text and i == at)]
    schema = docs.select(*[docs.columns[i] for i in kept]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in textkit.slices(whole)):
            got = [predict_text(held.value, t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*(batch.schema.names[i] for i in kept), "lang_pred", "score"])

    return sparkkit.mapped(docs, run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for each row of docs."""
    model = fit(docs, id_col, text_col, lang_col)
    out = with_language(docs.select(id_col, F.col(text_col).cast("string").alias("_text")), model, "_text", drop_text=True)
    return out.select(id_col, F.expr(f"coalesce(crc32(cast(`{id_col}` as string)) % 4 = 2, false)").alias("held_out"), "lang_pred", "score")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of docs whose text is in some learned language with at least this score."""
    model = fit(docs, id_col, text_col, lang_col)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = with_language(inner, model, f"c{docs.columns.index(text_col)}").where(f"lang_pred <> 'und' and score >= {least}")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
