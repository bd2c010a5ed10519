import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import quality
from wordloom.llm.queries import held_out, op9_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op9_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert ((s >= 0.7) == y).mean() > 0.98 and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.99


def test_held_out_labels_dont_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    wrong = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x.filter(~held_out())) for x in (labels, wrong))
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


def fitted(texts, y, base=0.5):
    counts = [quality.terms(t) for t in texts]
    return quality.fit([(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in counts], np.array(y), base)


SUBJECTS = ["The teacher", "My neighbour", "A young farmer", "The old captain", "Her sister", "The committee"]
VERBS = ["opened", "described", "repaired", "visited", "painted", "remembered", "followed"]
OBJECTS = ["the wooden bridge", "a quiet garden", "the broken clock", "an early train", "the village school", "a letter from home"]
ENDS = ["before the rain began", "with great care", "on the following morning", "without any help", "because winter was near"]
SPAM = ["buy", "cheap", "pills", "online", "casino", "winner", "click", "free", "bonus", "deal", "now", "credit"]


def sentence(rng, kind):
    pick = lambda xs: xs[rng.integers(len(xs))]
    if kind == "prose":
        return f"{pick(SUBJECTS)} {pick(VERBS)} {pick(OBJECTS)} {pick(ENDS)}."
    word = (lambda: pick(SPAM)) if kind == "spam" else (lambda: "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(2, 9))))
    return " ".join(word() for _ in range(rng.integers(8, 12))).capitalize() + "."


def texts_of(rng, kind, n):
    return [" ".join(sentence(rng, kind) for _ in range(rng.integers(4, 8))) for _ in range(n)]


def test_words_not_shapes():
    """Gibberish and spam with the case, word lengths and marks of clean prose are told from it."""
    rng = np.random.default_rng(1)
    model = fitted(texts_of(rng, "prose", 60) + texts_of(rng, "spam", 30) + texts_of(rng, "noise", 30), [1] * 60 + [0] * 60)
    good, spam, noise = (model.score(texts_of(rng, kind, 40)) for kind in ("prose", "spam", "noise"))
    assert good.min() > 0.8 and spam.max() < 0.3 and noise.max() < 0.4
    cosine = lambda a, b: float((model.embed([a]) @ model.embed([b]).T)[0, 0]) / quality.GRID ** 2
    prose = texts_of(rng, "prose", 2)
    assert cosine(*prose) > 0.1 + max(cosine(prose[0], texts_of(rng, kind, 1)[0]) for kind in ("spam", "noise"))


def test_scores_against_brute_force():
    """The whole method, with another decomposition and plain loops."""
    rng = np.random.default_rng(0)
    texts = texts_of(rng, "prose", 30) + texts_of(rng, "spam", 30)
    y = [1] * 30 + [0] * 30
    tests = [*texts[:3], *texts[-3:], *texts_of(rng, "prose", 5), *texts_of(rng, "noise", 5), "some other words", ""]
    model = fitted(texts, y)
    x = np.zeros((len(texts) + len(tests), quality.TERMS))
    counts = [quality.terms(t) for t in texts + tests]
    idf = [math.log(61 / (1 + sum(c[j] > 0 for c in counts[:60]))) + 1 if any(c[j] > 0 for c in counts[:60]) else 0.0 for j in range(quality.TERMS)]
    for i, c in enumerate(counts):
        at = 0
        for size, length in zip(quality.FAMILIES, quality.LENGTHS):
            own = {j: math.log(1 + c[j]) * idf[j] for j in range(at, at + size) if c[j]}
            norm = math.sqrt(sum(v * v for v in own.values()))
            for j, v in own.items():
                x[i, j] = v * length / norm if norm else 0.0
            at += size
    axes = np.linalg.svd(x[:60], full_matrices=False)[2]  # 60 rows have no more axes than the model keeps
    v = x @ axes.T
    want = []
    for row in v[60:]:
        cos = [float(row @ u / (np.linalg.norm(row) * np.linalg.norm(u))) if np.linalg.norm(row) > 1e-9 else 0.0 for u in v[:60]]
        best = sorted(range(60), key=lambda i: (-cos[i], i))[:quality.NEIGHBOURS]
        vote = [max(0.0, min(1.0, cos[i])) ** quality.SHARPNESS for i in best]
        want.append((sum(w * y[i] for w, i in zip(vote, best)) + quality.PRIOR * 0.5) / (sum(vote) + quality.PRIOR))
    assert model.score(tests) == pytest.approx(want, abs=2e-5)
    assert model.score([""])[0] == 0.5


def test_equal_texts_are_equal_in_any_batch():
    rng = np.random.default_rng(3)
    texts = texts_of(rng, "prose", 150) + texts_of(rng, "spam", 150)
    model = fitted(texts, [1] * 150 + [0] * 150)
    tests = texts_of(rng, "prose", 40) + texts_of(rng, "noise", 40)
    whole = model.score(tests)
    assert (np.concatenate([model.score([t]) for t in tests]) == whole).all()
    assert (model.score(tests[::-1])[::-1] == whole).all() and (model.score(tests * 5) == np.tile(whole, 5)).all()


def test_ties_go_to_the_first_rows():
    model = fitted(["alpha beta gamma"] * 60 + ["delta epsilon"] * 5, [1] * 25 + [0] * 40)
    assert model.score(["alpha beta gamma"])[0] > 0.9  # the first 25 of 60 equal neighbours vote


def test_terms_see_the_whole_text(monkeypatch):
    text = "Plain words here. " * 3000
    whole = quality.terms(text)
    assert (quality.terms(text + "!!! XX") != whole).any()
    monkeypatch.setattr(quality, "BLOCK_CHARS", 1000)
    assert np.abs(quality.terms(text) - whole).sum() < 0.02 * whole.sum()


def test_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(0, 1), (5, 0), (None, 1), (9, None), (8, 7), (100, 1), (101, 0), (99999, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    model = quality.train(awkward, labels)
    rows = quality.score(awkward, model).collect()
    assert quality.train(awkward.union(awkward), labels.union(labels)).labels.tolist() == model.labels.tolist()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {round(r["score"], 9) for r in rows if r["doc_id"] in (2, 3, 12)} == {round(3 / 5, 9)}
    for none in (quality.train(awkward, labels.limit(0)), quality.train(empty, labels.limit(0))):
        assert {r["score"] for r in quality.score(awkward, none).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0 and len(quality.train(empty, labels).labels) == 0
