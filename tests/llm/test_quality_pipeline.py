"""The quality classifier by held-out accuracy; the pipeline's stages against plain Python."""

import random

import pytest

import corpus_pipeline
from lodestone.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng, rows, labels = random.Random(4), [], []
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(12, 60))]
        good = i % 5 > 0
        text = " ".join(w).capitalize() + "." if good else " ".join(x + rng.choice(["$$$", "###", "%%%"]) for x in w)
        rows.append((i, text, rng.choice(["en", "fr"]), f"src{i % 7}", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(900, None, None, None, None), (901, "", "en", "x", 0), (None, rows[1][1], "en", "x", 5), rows[1], (902, "a " * 60_000, "en", "x", 120_000)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    known = spark.createDataFrame(labels[:250] + [(None, 1, 0), (5000, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, known).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r["doc_id"] is not None and 250 <= r["doc_id"] < 400]
    assert sum(r["keep"] == (r["doc_id"] % 5 > 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r[k] <= 1 for r in got for k in ("p_text", "p_meta", "p_quality"))
    assert quality.classify(docs.limit(0), known).collect() == []
    assert {r["keep"] for r in quality.classify(docs, known.limit(0)).collect()} == {True}
    assert {r["keep"] for r in quality.classify(docs, known.where("quality = 1")).collect()} == {True}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    item = " ".join(f"q{k}" for k in range(20))
    rows += [(1000, rows[1][1] + " extra", "en", "s", 9), (1001, rows[1][1].upper(), "en", "s", 9), (1002, item.title(), "en", "s", 9), (1003, rows[2][1] + " token: abcdefgh", "en", "s", 9), (1004, None, "en", "s", 0), (1005, "so it was said and done token: abcdefgh by all of us here.", "en", "s", 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    from test_ngram_join import brute
    from test_text_operators import plain_secrets

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    names = {r["doc_id"] for r in kept.collect()}
    assert len([i for i in names if i < 400 and i % 5]) >= 310 and len([i for i in names if i < 400 and i % 5 == 0]) <= 4
    single = corpus_pipeline.near_duplicates(spark, docs, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c, _ in brute(rows)})
    clean = corpus_pipeline.decontaminate(spark, docs, folder)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()} == {1002}
    safe = corpus_pipeline.secrets(spark, docs, folder)
    assert safe.columns == docs.columns and safe.count() == docs.count()
    changed = {r["doc_id"] for r in safe.collect()} & {i for i, t in rows if plain_secrets(t or "")}
    assert {r["doc_id"] for r in safe.collect() if "[SECRET]" in (r["text"] or "")} == changed == {1003, 1005}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} <= names - {1001, 1002} and len(out) >= 0.95 * (len(names) - 3)


def test_near_duplicates_judges_rows(spark, folder):
    """Unlike texts of one id both stay; copies go, whatever ids they have; clashing columns do not matter."""
    w = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(w), " ".join(w[30:] + w[:30][::-1]), " ".join(w[::2])
    rows = [(1, a), (1, b), (5, a + " more"), (None, b), (None, c), (None, c), (7, None), (7, None), (8, " "), (1, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash", 0.5, True) for i, t in rows], SCHEMA + ", row_key string, component_key double, keep boolean")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (1, b), (None, c), (7, None), (7, None), (8, " ")], key=repr)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == corpus_pipeline.COLUMNS


def test_empty_documents(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
        assert none.collect() == []


def judged(spark, rows, labels, rounds):
    """(bad documents kept, good documents rejected, log loss) on documents that the labels do not name."""
    import math

    docs = spark.createDataFrame([(*r, "clash", 0.5, True) for r in rows], SCHEMA + ", label string, p_text double, keep boolean")
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rounds=rounds).collect()
    assert len(got) == len(rows)
    named = {i for i, _, _ in labels}
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] not in named]
    bad, good = [r for r in held if r["doc_id"] % 5 == 0], [r for r in held if r["doc_id"] % 5]
    chance = [min(1 - 1e-6, max(1e-6, r["p_quality"] if r["doc_id"] % 5 else 1 - r["p_quality"])) for r in held]
    return sum(r["keep"] for r in bad), sum(not r["keep"] for r in good), -sum(map(math.log, chance)) / len(chance)


@pytest.mark.parametrize("odd", [[], [1001], [1003], [1001, 1003, 1005]])
def test_one_odd_document_decides_nothing(spark, odd):
    """Co-training settles, whatever single documents the pool holds, and is no worse than the labels alone."""
    rows, labels = corpus()
    extra = {1001: rows[1][1].upper(), 1003: rows[2][1] + " token: abcdefgh", 1005: "$$$ ### " * 30}
    rows = rows + [(i, extra[i], "en", "s", 9) for i in odd] + [(1003, "another text of that id, quite plain.", "en", "s", 9)] * bool(odd)
    bad, rejected, loss = judged(spark, rows, labels[:200], quality.ROUNDS)
    assert bad <= 2 and rejected <= 4
    if not odd:
        alone = judged(spark, rows, labels[:200], 0)
        assert bad <= alone[0] + 1 and rejected <= alone[1] + 1 and loss <= alone[2] + 0.02


def test_descent_halves_steps_that_raise_the_loss():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 6))
    y = (x[:, 0] + 0.3 * rng.standard_normal(300) > 0).astype(float)
    model = quality.Logistic().fit(x, 1 - y)  # starts at the opposite
    way, losses = quality.Descent(model), []
    for _ in range(60):
        if way.done:
            break
        way.take(way.now.slopes(x, y))
        losses.append(way.loss)
    assert way.done and all(a >= b - 1e-9 for a, b in zip(losses, losses[1:]))
    assert np.allclose(way.best.w, quality.Logistic().fit(x, y, steps=40).w, atol=0.02)  # what many plain steps on these labels come to
