"""Repeated passages against exhaustive versions: all runs of 50 words, and all pairs of texts aligned on all k-mers."""

import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import sparkkit, substring_dedup, textkit

SIZE = 50


def fillers(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def held_apart(rng):
    """Passages whose seeds also lie, a few at a time, in many other texts; runs of one word; long texts."""
    texts = []
    for _ in range(12):
        passage = fillers(rng, rng.randrange(50, 75))
        for at in range(0, len(passage) - 8, 4):  # pieces of it, each in texts of their own
            texts += [fillers(rng, 30) + passage[at : at + rng.randrange(8, 20)] + fillers(rng, 30) for _ in range(3)]
        texts += [fillers(rng, rng.randrange(0, 60)) + passage + fillers(rng, rng.randrange(0, 60)) for _ in range(rng.randrange(2, 5))]
    texts += [fillers(rng, 20) + ["of"] * rng.randrange(20, 200) + ["the"] * rng.randrange(20, 200) + fillers(rng, 20) for _ in range(40)]
    texts += [fillers(rng, 30_000) + passage + fillers(rng, 30_000) + passage, passage, passage, [], passage[:49]]
    return texts


def changed(rng):
    """Passages in several texts each, with words replaced, left out and put in at random places."""
    texts = []
    for _ in range(14):
        passage = fillers(rng, rng.randrange(80, 160))
        for _ in range(rng.randrange(2, 7)):
            own = []
            for w in passage:
                x = rng.random()
                own += fillers(rng, 1) if x < 0.04 else [] if x < 0.055 else [w, *fillers(rng, 1)] if x < 0.07 else [w]
            texts.append(fillers(rng, rng.randrange(5, 60)) + own + fillers(rng, rng.randrange(5, 60)))
    return texts


def mixed(rng):
    """Texts put together from common sentences and from each other's halves."""
    common = [fillers(rng, rng.randrange(6, 12)) for _ in range(30)]
    texts = [sum((rng.choice(common) if rng.random() < 0.3 else fillers(rng, 8) for _ in range(14)), []) for _ in range(30)]
    for _ in range(30):
        a, b = rng.sample(texts[:30], 2)
        own = a[: len(a) // 2] + b[len(b) // 2 :]
        texts.append([w if rng.random() > 0.06 else fillers(rng, 1)[0] for w in own])
    return texts


def found(spark, texts, **options):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    covered = {i: np.zeros(len(t), bool) for i, t in enumerate(texts)}
    for r in substring_dedup.passages(docs, **options).collect():
        assert 0 <= r["start_word"] < r["end_word"] <= len(texts[r["doc_id"]]) and r["end_word"] <= r["start_word"] + r["n_words"]
        assert 0 <= r["source_start"] < r["source_end"] <= len(texts[r["source_id"]]) and r["source_id"] != r["doc_id"]
        covered[r["doc_id"]][r["start_word"] : r["end_word"]] = True
    return covered


@pytest.mark.parametrize("hot", [3, substring_dedup.HOT])
@pytest.mark.parametrize("pattern", [held_apart, changed, mixed])
def test_no_run_stays_in_two_texts(spark, pattern, hot):
    texts = pattern(random.Random(11))
    covered = found(spark, texts, hot=hot)
    holders = defaultdict(set)
    repeated = 0
    for i, t in enumerate(texts):
        for p in range(len(t) - SIZE + 1):
            holders[tuple(t[p : p + SIZE])].add(i)
    for held in holders.values():
        repeated += len(held) > 1
    for i, t in enumerate(texts):  # what a passage covers whole is gone
        for p in range(len(t) - SIZE + 1):
            if covered[i][p : p + SIZE].all():
                holders[tuple(t[p : p + SIZE])].discard(i)
    assert all(len(held) < 2 for held in holders.values())
    assert repeated or pattern is not held_apart
    alone = [i for i, t in enumerate(texts) if covered[i].any() and not set(t) & {w for j, o in enumerate(texts) if j != i for w in o}]
    assert alone == []


@pytest.mark.parametrize("pattern", [held_apart, changed, mixed])
def test_recall_against_all_pairs_aligned(spark, pattern):
    rng = random.Random(23)
    texts = pattern(rng)
    if pattern is held_apart:  # all pairs of so many would take minutes
        texts = [t for t in texts if len(t) < 1000][-120:]
    k = substring_dedup.K
    words = [sparkkit.word_ids(" ".join(t), lower=True) for t in texts]
    nodes = [textkit.node_of(w) for w in words]
    kmers = []
    for w in words:
        at = defaultdict(list)
        for p, h in enumerate(textkit.shingle_hashes(w, k).tolist() if len(w) >= k else ()):
            at[h].append(p)
        kmers.append(at)
    due = {i: np.zeros(len(t), bool) for i, t in enumerate(texts)}
    for b in range(len(texts)):
        for a in range(len(texts)):
            if nodes[a] >= nodes[b] or len(texts[b]) < SIZE:
                continue
            met = [(p, q) for h, ps in kmers[b].items() if h in kmers[a] for n, p in enumerate(ps) for q in [kmers[a][h][min(n, len(kmers[a][h]) - 1)]]]
            if met:
                p, q = (np.array(x, np.int64) for x in zip(*sorted(met), strict=True))
                for chain in substring_dedup.chains(substring_dedup.segments(p, q, k)):
                    for s, e, *_ in substring_dedup.align(words[b], words[a], chain, SIZE, 0.8):
                        due[b][s:e] = True
    covered = found(spark, texts)
    asked = sum(int(d.sum()) for d in due.values())
    got = sum(int((due[i] & covered[i]).sum()) for i in due)
    print(pattern.__name__, asked, got / asked)
    assert asked > 1000 and got >= 0.9 * asked


def test_changed_passages_with_other_partners(spark):
    """Pairs of texts that share a changed passage whose seeds all lie, apart from each other, in texts before and between them."""
    rng = random.Random(5)
    texts, pairs = [], []
    for _ in range(12):
        passage = fillers(rng, 76)
        copy = [fillers(rng, 1)[0] if i % 19 == 18 else w for i, w in enumerate(passage)]
        pairs.append((len(texts), len(texts) + 1))
        texts += [fillers(rng, 30) + own + fillers(rng, 30) for own in (passage, copy)]
        for at in range(0, 76, 19):  # each stretch without a change, in texts of its own
            texts += [fillers(rng, 30) + passage[at : at + 18] + fillers(rng, 30) for _ in range(30)]
    covered = found(spark, texts)
    assert all(covered[a][30:105].sum() + covered[b][30:105].sum() >= 70 for a, b in pairs)
    assert not any(c.any() for i, c in covered.items() if i not in {x for p in pairs for x in p})
