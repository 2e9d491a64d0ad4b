import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import quality, toxicity


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_additive_model_learns_main_effects_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    logit = 4 * (x[:, 0] > 0.6) - 2 + 6 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-logit))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    assert auc(model.score(x[3000:]), y[3000:]) > auc(logit[3000:], y[3000:]) - 0.03


def test_additive_model_of_one_label_or_none():
    x = np.zeros((5, 2))
    assert np.allclose(quality.fit(x, np.ones(5)).score(x), 5.5 / 6)
    assert np.allclose(quality.fit(np.zeros((0, 2)), np.zeros(0)).score(x), 0.5)


def test_corrected_risk_separates_with_hidden_positives():
    rng = np.random.default_rng(1)
    bad = rng.integers(0, 1 << toxicity.HASH_BITS, 6)
    good = rng.integers(0, 1 << toxicity.HASH_BITS, 500)
    text = lambda toxic: np.unique(np.concatenate([rng.choice(good, 40), rng.choice(bad, 2) if toxic else []]).astype(np.uint32))
    positive, hidden, clean = [text(True) for _ in range(200)], [text(True) for _ in range(80)], [text(False) for _ in range(720)]
    model = toxicity.Classifiers(positive, hidden + clean, 0.1)
    assert set(model.slots) <= set(bad.tolist()) | set(good.tolist()) and set(bad.tolist()) <= set(model.slots.tolist())
    w = model.weights[[list(model.slots).index(b) for b in set(bad.tolist())]]
    assert (w > 0).all()


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [(None, "w1 w2", "x"), (5001, None, "x"), (5002, "", "y"), (5003, "w1", "y"), (5003, "w1", "y")], [(None, 1, 1), (5002, None, None), (7777, 1, 0)]
    for k in range(900):
        ws = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        toxic, junk = k % 5 == 0, k % 7 == 0
        if toxic:
            ws[3:5] = [rng.choice(["foul", "vile", "nasty"]) for _ in range(2)]
        docs.append((k, " ".join(w + "###" for w in ws) if junk else " ".join(ws), "x"))
        labels.append((k, int(not junk), int(toxic)))
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs, labels


@pytest.mark.parametrize(("query", "label", "parts", "rest"), [(quality.op1_quality, 1, 5, 0), (toxicity.op9_toxicity, 2, 4, 2)])
def test_held_out_rows_are_predicted_and_no_row_is_lost(spark, tables, query, label, parts, rest):
    path, docs, labels = tables
    rows = query(spark, path).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = {r[0]: r[label] for r in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) for r in rows if r.doc_id is not None)
    right = [r.predicted == known[r.doc_id] for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean(right) > 0.97


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.score_quality(some, labels).first().score == 0.5
    assert toxicity.score_toxicity(some, toxicity.train(some, labels)).first().toxic_score < 0.3
