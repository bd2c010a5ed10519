import random
from collections import Counter

import numpy as np
import pytest

from wordloom.llm import minhash
from wordloom.llm.shingles import shingles, similarity, weighted, word_hashes

SCHEMA = "doc_id long, text string"


def words(rnd, n, kinds=5000):
    return [f"w{rnd.randint(0, kinds)}" for _ in range(n)]


def exact(texts, threshold=0.8):
    """Classes by comparing all pairs of texts, word by word."""
    def bag(t):
        w = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags = {t: bag(t) for t in set(texts)}
    root = {t: t for t in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(bags)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common, union = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if union and common / union >= threshold:
                root[find(a)] = find(b)
    return [find(t) for t in texts]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def edited(rnd, base, n):
    out = list(base)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"x{rnd.randint(0, 10**6)}"
    return out


def corpus(seed):
    rnd, texts = random.Random(seed), []
    for size in (2, 3, 9, 40):
        base = words(rnd, rnd.randint(60, 200))
        texts += [" ".join(edited(rnd, base, rnd.randint(0, 5))) for _ in range(size)]
    texts += [" ".join(words(rnd, rnd.randint(1, 80))) for _ in range(40)]
    shared = words(rnd, 40)
    texts += [" ".join(words(rnd, 30) + shared + words(rnd, 30)) for _ in range(20)]
    texts += [texts[0]] * 5 + [texts[10].upper()] + ["a a a a a a a a", "a a a a a a a a a"]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block", [(0, 512), (2, 7)])
def test_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus(seed)
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    found = [r["class_id"] for r in rows]
    assert same_partition(found, exact(texts))
    assert all(r["class_id"] == min(i for i, c in enumerate(found) if c == r["class_id"]) for r in rows)
    assert all(r["class_rows"] == found.count(r["class_id"]) for r in rows)
    alike = lambda a, b: 1.0 if texts[a] == texts[b] else similarity(weighted(texts[a]), weighted(texts[b]))
    assert all(r["similarity"] == alike(r["doc_id"], r["class_id"]) for r in rows)


def test_large_group_off_its_hub(spark):
    """Hundreds of variants of one text, most of them under the threshold from each other."""
    rnd = random.Random(9)
    base = words(rnd, 120)
    texts = [" ".join(edited(rnd, base, rnd.randint(1, 7))) for _ in range(300)]
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert same_partition([r["class_id"] for r in rows], exact(texts))


def test_signatures_estimate_weighted_similarity():
    rng, errors = np.random.default_rng(0), []
    for _ in range(60):
        n = rng.integers(20, 200)
        a, b = rng.choice([0.0, 0.4, 1.0, 2.5, 9.0], n), rng.choice([0.0, 0.4, 1.0, 2.5, 9.0], n)
        b = np.where(rng.random(n) < 0.7, a, b)
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        sides = [(x[w > 0], w[w > 0]) for w in (a, b)]
        sign = minhash.signatures(np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]),
                                  np.repeat([0, 1], [len(s[0]) for s in sides]), 2)
        errors.append((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_signature_depends_on_the_text_alone():
    texts = ["a b c d e f g", "one two", "###", None, "a b c d e f g"]
    sign, totals = minhash.text_signatures(texts)
    assert totals == [3, 1, 0, 0, 3]
    assert (sign[0] == sign[4]).all() and not sign[2].any() and not sign[3].any()
    assert (minhash.text_signatures(texts[:2])[0][1] == sign[1]).all()


def test_shingles():
    assert len(word_hashes("A-b, c’é 世界!")) == 4 and (word_hashes("Ab") == word_hashes("aB")).all()
    assert [len(shingles(t)) for t in (None, "", "#", "a", "a b c d e", "a b c d e f")] == [0, 0, 0, 1, 1, 2]
    a, b = weighted("a b c d e f"), weighted("a b c d e g")
    assert similarity(a, a) == 1.0 and similarity(a, b) == pytest.approx(1 / 3) and similarity(a, weighted("#")) == 0.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 100)]
    got = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103, 200)} == {100}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward(awkward, empty):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["class_id"])
    assert by[0] == by[1] == [0] and by[2] == [2] and by[12] == [12, 12] and by[9] == [9, 9]
    assert sorted(by[None], key=str) == [0, None, None]  # the copy of 0, and two of their own
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 1 and ids[1] == 0 and ids[None] == 2 and ids[2] == 1 and ids[12] == 2 and ids[9] == 1 and ids[8] == 1 and ids[7] == 2


def test_all_alike(spark):
    rows = spark.createDataFrame([(i, "the same text in each of the rows") for i in range(50)], SCHEMA)
    assert {r["class_id"] for r in minhash.near_duplicates(rows).collect()} == {0}
    assert [r["doc_id"] for r in minhash.drop_near_duplicates(rows).collect()] == [0]
