"""The corpus pipeline: each stage on odd input, and what a whole run keeps."""

import random

import pytest
from pyspark.sql import Row

import corpus_pipeline
from graphloom.llm import ngram_jaccard, packing, quality_rules, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = SCHEMA + ", n_words long, lang_pred string, score double, media binary, spans string, q_n_words long, node long, id long, c0 string, payload string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [prose(rng, 150) for _ in range(60)]
    near = texts[0].split()
    near[75] = "changed"
    passage = prose(rng, 70)
    texts += [texts[0], " ".join(near), None, "", " \n ", "few words here", "### $$$ " * 80, "again and " * 100, "x" * 3000]
    texts += [f"{prose(rng, 80)} {passage} {prose(rng, 80)}" for _ in range(3)] + [prose(rng, 4000)]
    return [(i, t, "en" if i % 2 else "fr", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s1", 0), (None, texts[6], None, None, None)]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_each_stage_takes_odd_rows(spark, rows, stage):
    name, fn = stage
    docs = spark.createDataFrame([(*r, 7, "x", 0.5, b"", "y", 8, 9, 10, "z", "p") for r in rows], ODD).repartition(3)
    out = fn(spark, docs, "")
    got = out.collect()
    if name == "best-fit packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    else:
        assert out.columns == docs.columns
        known = {(r[0], r[1]) for r in rows}
        if name != "substring dedup":
            assert {(r["doc_id"], r["text"]) for r in got} <= known
        assert all((r["n_words"], r["lang_pred"], r["spans"], r["c0"]) == (7, "x", "y", "z") for r in got)
    assert fn(spark, spark.createDataFrame([], ODD), "").count() == 0


def test_run_keeps_clean_documents_and_drops_the_rest(spark, rows, tmp_path):
    spark.createDataFrame([Row(**dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True))) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert set(range(1, 60)) <= ids  # prose of its own
    assert len(ids & {0, 60, 61}) == 1 and not ids & {62, 63, 64, 65, 66, 67}
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_one_id_with_several_texts(spark):
    rng = random.Random(2)
    a, c = prose(rng, 160), prose(rng, 160)
    docs = spark.createDataFrame([(1, a), (1, c), (2, a + " more"), (2, a + " more"), (3, prose(rng, 160))], "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == {(1, 156, 1), (2, 157, 1), (3, 156, 3)}
    found = substring_dedup.passages(docs).collect()
    assert len(found) == 1 and {found[0]["doc_id"], found[0]["source_id"]} == {1, 2} and found[0]["n_words"] == 160
    cut = substring_dedup.cut_passages(docs).collect()
    assert (1, c) in {tuple(r) for r in cut}


def test_words_that_differ_only_in_a_pattern_are_told_apart(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    got = quality_rules.quality_report(spark.createDataFrame([(1, f"{word}\n{other}\n{word[:16]}\n{other[:16]}", "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert got["n_dup_lines"] == 0 and got["n_lines"] == 4
    rest = " tail" * 3
    links = ngram_jaccard.jaccard_components(spark.createDataFrame([(1, word + rest), (2, other + rest)], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in links} == {1, 2}


def test_thresholds_differ_by_group_and_decide(spark):
    rng = random.Random(6)
    plain = [(i, prose(rng, 200), "en", "prose") for i in range(120)]
    signs = [(200 + i, prose(rng, 200).replace(" ", " $ ", 30 + i % 20), "en", "prices") for i in range(120)]
    odd = [(400, prose(rng, 200).replace(" ", " $ ", 40), "en", "prose")]
    docs = spark.createDataFrame(plain + signs + odd, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(docs).collect()}
    assert all(kept[i] for i in kept if i < 400) and not kept[400]


def test_passages_against_brute_force(spark):
    """Of texts that share an exact run of 60 words, or one with a change in every tenth word, nearly all are found."""
    rng = random.Random(12)
    shared = [prose(rng, 60) for _ in range(12)]

    def fuzzy(text):
        return " ".join("q" + w if i % 10 == 9 else w for i, w in enumerate(text.split()))

    rows, exact, near = [], [], []
    for i in range(240):
        run = shared[i % 12]
        if i >= 36:
            (near if i % 4 == 0 else exact).append(i)
        rows.append((i, f"{prose(rng, 40)} {fuzzy(run) if i % 4 == 0 else run} {prose(rng, 40)}"))
    clean = [(1000 + i, prose(rng, 140)) for i in range(60)]
    words = {i: t.split() for i, t in rows + clean}
    found = substring_dedup.passages(spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(5)).collect()
    flagged = {r["doc_id"] for r in found} | {r["source_id"] for r in found}
    assert not {i for i, _ in clean} & flagged
    for r in found:
        x, y = words[r["doc_id"]][r["start_word"] : r["end_word"]], words[r["source_id"]][r["source_start"] : r["source_end"]]
        assert len(set(x) & set(y)) >= 0.7 * len(set(x)) and len(x) == r["n_words"] >= 50
    assert sum(i in flagged for i in exact) >= 0.97 * len(exact) and sum(i in flagged for i in near) >= 0.9 * len(near)


def test_packing_at_the_borders_of_its_encoder(spark):
    from tokenizers import Tokenizer

    whole, path = Tokenizer.from_file(packing.default_tokenizer()), packing.default_tokenizer()
    rng = random.Random(1)
    for text in (" " * 1_100_000, " \n" * 600_000, "a" * 300_000, "<|endoftext|> b", prose(rng, 200_000), "é日😀" * 1000):
        assert packing.token_ids(text, path).tolist() == whole.encode(text, add_special_tokens=False).ids
