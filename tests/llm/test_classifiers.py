import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkwarden.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Good texts and junk; toxic where an insult meets a group, and harmless where either stands alone."""
    rng = random.Random(4)
    words = ["river", "stone", "light", "paper", "glass", "song", "cold", "night", "wolf", "amber", "field", "cloud"]
    rows, labels = [], []
    for k in range(1200):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        text += ["vermin"] * insult + ["neighbours"] * group
        rng.shuffle(text)
        junk = rng.random() < 0.3
        line = " ".join(text)
        rows.append((k, " ".join(w.upper() + "!!" for w in text[:6] * 4) if junk else line.capitalize() + "."))
        labels.append((k, int(not junk), int(insult and group)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), {k: (q, t) for k, q, t in labels}, rows


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    p = label.sum()
    return (order[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.mark.parametrize(("op", "which", "modulus", "rest"), [(quality.quality_scores, 0, 4, 2), (toxicity.toxicity_scores, 1, 3, 1)])
def test_held_out_accuracy(corpus, op, which, modulus, rest):
    docs, labels, truth, _ = corpus
    clean = docs.where("doc_id % 1 = 0") if which == 0 else docs
    got = op(clean, labels).collect()
    assert len(got) == 1200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
    held = [r for r in got if r.held_out]
    label = np.array([truth[r.doc_id][which] for r in held])
    assert auc(np.array([r.score for r in held]), label) > (0.99 if which == 0 else 0.9)
    assert {str(r) for r in got} == {str(r) for r in op(clean.repartition(5), labels).collect()}


def test_labels_of_held_out_rows_are_not_learnt(spark, corpus):
    docs, labels, _, _ = corpus
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) toxic")
    for op in (quality.quality_scores, toxicity.toxicity_scores):
        assert {str(r) for r in op(docs, labels).collect()} == {str(r) for r in op(docs, flipped).collect()}


def test_pairs_tell_what_sums_cannot(corpus):
    """The factors learn that insult and group together count for more than their sum."""
    _, _, truth, rows = corpus
    part = [(t, truth[k][1]) for k, t in rows if truth[k][0]]
    cells, bounds = [], [0]
    for c, b in toxicity._cells(pa.array([t for t, _ in part])):
        cells.append(c)
        bounds += (b[1:] + bounds[-1]).tolist()
    cells, bounds, y = np.concatenate(cells), np.array(bounds), np.array([float(v) for _, v in part])
    loss = {}
    for rank in (0, toxicity.RANK):
        p = np.clip(toxicity.fit(cells, bounds, y, rank=rank, epochs=60).predict(pa.array([t for t, _ in part])), 1e-6, 1 - 1e-6)
        loss[rank] = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert loss[toxicity.RANK] < 0.7 * loss[0]


def test_flat_trees_are_walked_as_single_ones():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x, y)

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.stat[node]] <= model.cut[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.predict(x), [walk(r) for r in x]) and ((model.predict(x) > 0.5) == y).mean() > 0.97


def test_statistics_do_not_depend_on_the_batch(rows):
    texts = [r[1] for r in rows]
    whole = quality.statistics(pa.array(texts, pa.string()))
    assert np.isfinite(whole).all()
    for k in range(0, len(texts), 7):
        assert np.allclose(whole[k], quality.statistics(pa.array([texts[k]], pa.string()))[0])
    words = (texts[3] or "").split()
    s = dict(zip(quality.STATS, whole[3], strict=True))
    assert np.isclose(np.expm1(s["log_words"]), len(words)) and np.isclose(s["distinct_words"], len(set(words)) / len(words))


def test_edges(spark, docs, rows, empty):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1), (3, 0, 1), (3, 1, 0)], LABELS)
    for op in (quality.quality_scores, toxicity.toxicity_scores):
        for labels in (none, odd):
            assert op(docs, labels).count() == len(rows) and op(empty, labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    kept = quality.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == 0


def _cells_of(texts):
    cells, bounds = [], [0]
    for c, b in toxicity._cells(pa.array(texts)):
        cells.append(c)
        bounds += (b[1:] + bounds[-1]).tolist()
    return np.concatenate(cells), np.array(bounds)


def test_terms_that_tell_only_together_are_learnt():
    """Toxic are texts with both or neither of two words: no word tells anything on its own."""
    rng = random.Random(6)
    texts, y = [], []
    for _ in range(4500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        t = [f"w{rng.randrange(60)}" for _ in range(30)] + ["alpha"] * a + ["gamma"] * b
        rng.shuffle(t)
        texts.append(" ".join(t))
        y.append(float(a == b))
    model = toxicity.fit(*_cells_of(texts[:3000]), np.array(y[:3000]))
    assert ((model.predict(pa.array(texts[3000:])) > 0.5) == np.array(y[3000:])).mean() > 0.95
    noise = toxicity.weights(*_cells_of(texts[:3000]), np.array([float(rng.random() < 0.5) for _ in range(3000)]))
    assert (noise > 0).sum() <= 2


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    size = 1 << toxicity.BITS
    m = toxicity.Machine(rng.random(size).astype(np.float32), rng.standard_normal(size).astype(np.float32), rng.standard_normal((size, 4)).astype(np.float32), 0.3)
    cells = [rng.choice(size, k, replace=False) for k in (0, 1, 2, 9, 40)]
    got, _ = m.margin(np.concatenate(cells).astype(np.int32), np.cumsum([0, *map(len, cells)]), m.vector(np.concatenate(cells).astype(np.int32)))
    for row, value in zip(cells, got, strict=True):
        x, v = m.weight[row].astype(float), m.factors[row].astype(float)
        want = 0.3 + sum(m.linear[c] * w for c, w in zip(row, x, strict=True)) + sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(row)) for j in range(i))
        assert np.isclose(value, want, rtol=1e-4, atol=1e-4)


def test_fitted_trees_lower_the_loss_at_every_tree():
    """Boosting by definition: each further tree of the fitted model brings the training loss down."""
    rng = np.random.default_rng(5)
    x = rng.random((800, len(quality.STATS)))
    y = (x[:, 1] + 0.3 * rng.standard_normal(800) > 0.5).astype(float)
    model = quality.fit(x, y)
    margin, losses = np.full(len(y), model.base), []
    for root in model.roots:
        node = np.full(len(y), root)
        for _ in range(quality.DEPTH + 1):
            node = np.where(model.left[node] == node, node, np.where(x[np.arange(len(y)), model.stat[node]] <= model.cut[node], model.left[node], model.right[node]))
        margin = margin + model.value[node]
        p = np.clip(1 / (1 + np.exp(-margin)), 1e-9, 1 - 1e-9)
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert np.allclose(1 / (1 + np.exp(-margin)), model.predict(x)) and (np.diff(losses) <= 1e-9).all() and losses[-1] < 0.6 * losses[0]


@pytest.mark.parametrize(("module", "op"), [(quality, quality.quality_scores), (toxicity, toxicity.toxicity_scores)])
def test_scores_do_not_depend_on_dealing_past_the_bound(spark, corpus, monkeypatch, module, op):
    """More labelled ids than may be learnt from, each with six rows of unlike texts."""
    monkeypatch.setattr(module, "TRAIN_ROWS", 300)
    _, labels, truth, rows = corpus
    labels = labels.selectExpr("doc_id", "if(xxhash64(doc_id) % 4 = 0, 1 - quality, quality) quality", "if(xxhash64(doc_id) % 4 = 0, 1 - toxic, toxic) toxic")  # so that scores differ
    rng = random.Random(9)
    many = [(k, " ".join(rng.sample(t.split(), len(t.split()) - j))) for k, t in rows for j in range(6)]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(3).persist()
    seen = [{str(r) for r in op(docs.repartition(n, *by), labels).collect()} for n, by in ((3, []), (7, []), (5, ["text"]))]
    assert seen[0] == seen[1] == seen[2] and len({r.score for r in op(docs, labels).collect()}) > 3, {r.score for r in op(docs, labels).collect()}


def test_cells_of_the_training_rows_are_bounded(spark, corpus, monkeypatch):
    docs, labels, _, rows = corpus
    held = []
    plain = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda cell, bounds, y: held.append((len(cell), len(y))) or plain(cell, bounds, y))
    whole = toxicity.train(docs, labels)
    for most in (3000, 1, held[0][0], held[0][0] - 1):
        monkeypatch.setattr(toxicity, "TRAIN_CELLS", most)
        models = [toxicity.train(docs.repartition(n), labels) for n in (2, 5)]
        assert held[-1] == held[-2] and held[-1][0] <= most and np.array_equal(models[0].linear, models[1].linear)
        assert (held[-1] == held[0]) == (most >= held[0][0])
        assert most > 1 or held[-1][1] == 0
    assert np.isfinite(whole.linear).all()
