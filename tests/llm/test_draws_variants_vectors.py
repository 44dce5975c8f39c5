"""Importance resampling, spelling variants and near embeddings, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import embedding_join, importance, sparkkit, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_resample(docs, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(words) - m + 1)]

    raw, aim = Counter(), Counter()
    for _, text in docs:
        raw.update(features(text)[1])
    for text in target:
        aim.update(features(text)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(found), weight, score, None, words])
    able = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (3, 37), (2, 100), (1, 0)])
def test_resampling_equals_brute_force(spark, n, percent, monkeypatch):
    rng = random.Random(n)
    words = [f"w{k}" for k in range(60)] + ["ÉTÉ", "Ab9", "日本"]
    docs = [(i * 10**15 - 2**62, " ".join(rng.choices(words, k=rng.choice([0, 5, 19, 20, 21, 60]))) + rng.choice(["", "-x_y", "\x00"])) for i in range(300)]
    docs += [(7, None), (8, ""), (9, "a" * 3_000_000 + " b" * 30), (None, "w1 " * 40), (10, "W1, w2. " * 200_000)]
    target = [" ".join(rng.choices(words[:10], k=30)) for _ in range(20)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    out = importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), n=n, percent=percent)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_resample(docs, target, n, percent=percent)


def test_resampling_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    same = spark.createDataFrame([(3, "one two " * 20)] * 40, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.resample(same, none).collect() if r["rank"])
    assert ranks == [1, 2, 3, 4]  # repeated rows are drawn each by itself


def test_radix_selection_is_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice([-(2**63), 2**63 - 1, 0, 5, -5, rng.getrandbits(62)]), rng.choice([1, 2, 2**40]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "a long, b long, i long")
    for k in (0, 1, 250, 499, 500):
        found = frame.where(importance.not_after_kth(frame, ["~a", "b", "i"], k))
        assert sorted(map(tuple, found.collect())) == sorted(sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k])
    placed = sparkkit.ranked(frame, ["~a", "b", "i"], "place").orderBy("place").collect()
    assert [(r["a"], r["b"], r["i"]) for r in placed] == sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    assert [r["place"] for r in placed] == list(range(1, 501))


def brute_variants(docs, every=97, least=5, times=3, ratio=2):
    counts = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    letters = sorted({c for w in words for c in w})
    form, rows = {}, []
    for w, n in words.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + j :] for j in (0, 1) for i in range(len(w) + 1) for c in letters}
        near = [x for x in edits if x in words and x != w]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
        rows.append((w, n, len(near)))
    out = []
    for w, n, near in rows:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near, words.get(form[w])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [4_000, 30])
def test_variants_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST", most)  # with few words a group, hot groups are dealt again
    rng = random.Random(3)
    stock = ["".join(rng.choices("abé", k=rng.randint(4, 9))) for _ in range(400)] + ["commonstart" + "".join(rng.choices("xyz", k=4)) for _ in range(200)]
    text = lambda k: " ".join(rng.choice(stock) for _ in range(k)) + ". É-ß_7 " + "Q" * rng.randint(0, 90)
    docs = [(i, text(60)) for i in range(200)] + [(1, None), (2, ""), (None, text(30)), (3, text(400_000)), (3, "×÷ Ünder Ünder Ünder ünder")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    out = spelling.variants(frame)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_variants(docs)


def test_variants_of_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_vectors(rows, least=0.95):
    able = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in able:
        for j in able:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links[i]), low, vec_id == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_join, "BLOCK", 64)  # several levels of intervals
    monkeypatch.setattr(embedding_join, "FAN", 4)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=12)
    vectors = [*rng.normal(size=(250, 12)), *(centre + 0.02 * rng.normal(size=(500, 12))), *(rng.normal(size=12) * 0.3 * k + centre for k in range(20))]
    vectors += [centre * 2] * 30 + [*(rng.normal(size=(1, 5)) + 0.1 * rng.normal(size=(20, 5)))]
    walk = rng.normal(size=12)
    for _ in range(60):  # a chain whose ends are far apart
        walk = walk + 0.25 * rng.normal(size=12)
        vectors.append(walk)
    rows = [(int(i) * 7, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    rows = [(int(a), list(map(float, v))) for a, v in rows]
    rows += [rows[0], (1, None), (2, []), (3, [0.0] * 12), (4, [1.0, None]), (5, [float("nan")] * 12), (6, [float("inf")] + [1.0] * 11), (8, [1e-30] * 12), (9, [1e30] * 12)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("n_links", F.lit("x")).withColumn("label", F.lit(1))
    out = embedding_join.near_duplicates(frame)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_vectors(rows)


def test_embeddings_without_rows_or_ids(spark):
    assert embedding_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embedding_join.near_duplicates(rows).collect()), key=repr) == sorted([(None, 1, 5, False), (5, 1, 5, True), (None, 0, None, True)], key=repr)
    with pytest.raises(ValueError, match="between"):
        embedding_join.near_duplicates(rows, least=1)
