import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import langid
from wordloom.llm.queries import held_out, op2_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98


def test_labels_of_held_out_rows_dont_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang")))
    a, b = (langid.train(d.filter(~held_out())) for d in (docs, wrong))
    assert a.languages == b.languages and (a.likelihood == b.likelihood).all()


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    vocabulary = {"aa": ["kolo", "mira", "tavo", "sune", "pelka"], "bb": ["zwick", "brun", "glatt", "forsch", "knurr"], "cc": ["éaux", "ouvre", "çais", "tiéra", "quoi"]}
    texts = {k: " ".join(rng.choice(v, 4000)) for k, v in vocabulary.items()}
    return langid.Model.of({k: langid.trigram_counts(t) for k, t in texts.items()}), {k: (lambda v=v: " ".join(rng.choice(v, 100))) for k, v in vocabulary.items()}


def test_mixture(model):
    model, make = model
    lang, score, shares = langid.infer(model, f"{make['aa']()} {make['aa']()} {make['aa']()} {make['bb']()}")
    assert lang == "aa" and set(shares) == {"aa", "bb"} and score == pytest.approx(0.75, abs=0.08)
    assert langid.infer(model, make["cc"]())[2] == {"cc": 1.0}


def test_expectation_maximisation_finds_the_maximum():
    rng = np.random.default_rng(1)
    like, counts = rng.uniform(0.01, 1, (2, 50)), rng.integers(1, 9, 50).astype(float)
    share, score = langid.expectation_maximisation(like, counts, np.array([0.5, 0.5]))
    grid = [counts @ np.log(np.array([x, 1 - x]) @ like) for x in np.linspace(0, 1, 2001)]
    assert score == pytest.approx(max(grid), abs=0.05) and share.sum() == pytest.approx(1)


def test_the_set_against_all_subsets():
    """The stepwise search's penalised likelihood against the best of all subsets, for texts of one to four of six close languages."""
    rng = np.random.default_rng(7)
    syllables = ["ka", "lo", "mi", "ra", "tu", "ven", "sol", "per", "gin", "dor", "ish", "eth"]
    words = {f"l{k}": ["".join(rng.choice(syllables, rng.integers(2, 4), p=rng.dirichlet(np.full(12, 0.7)))) for _ in range(40)] for k in range(6)}
    model = langid.Model.of({k: langid.trigram_counts(" ".join(rng.choice(v, 3000))) for k, v in words.items()})
    several = 0
    for _ in range(60):
        own = rng.choice(6, rng.integers(1, 5), replace=False)
        text = " ".join(w for k in own for w in rng.choice(words[f"l{k}"], rng.integers(5, 60)))
        counts = langid.trigram_counts(text)
        seen = np.flatnonzero(counts)
        weight, like = counts[seen].astype(float), model.likelihood[:, seen].astype(float)
        penalty = langid.PENALTY * np.log(weight.sum() + 1)

        def value(members):
            members = list(members)
            share = np.full(len(members), 1 / len(members))
            for _ in range(3000):  # plain rounds, without the bound
                share = share * (like[members] @ (weight / (share @ like[members]))) / weight.sum()
            return weight @ np.log(share @ like[members]) - penalty * (len(members) - 1), share

        best = max((value(c)[0], c) for n in range(1, 7) for c in itertools.combinations(range(6), n))
        chosen, share = langid.best_set(like, weight)
        got, brute = value(chosen)
        assert got >= best[0] - 0.01 and share == pytest.approx(brute, abs=0.02)
        several += len(best[1]) > 1
    assert several > 10


def test_blocks_count_like_one_piece(monkeypatch):
    text = "the quick brown fox, JUMPED over 13 lazy dogs — été " * 40
    whole = langid.trigram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 1000)
    assert np.abs(langid.trigram_counts(text) - whole).sum() <= 2 * (len(text) // 1000 + 1)


def test_awkward(awkward, empty):
    model = langid.train(awkward)
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4, 6, 12))
    assert all(r["lang_pred"] != "und" for r in rows if r["doc_id"] in (0, 1, 5, 10, 11))
    same = [(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (0, 1)]
    assert same[0] == same[1]
    none = langid.train(empty)
    assert none.languages == [] and {r["lang_pred"] for r in langid.identify(awkward, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
