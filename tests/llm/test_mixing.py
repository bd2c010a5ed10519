import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wordloom.llm import mixing


def water_fill(sizes, weights, total, most):
    """Clamp all that are above, reshare by weight, again and again."""
    done = {}
    while True:
        left = {i for i in range(len(sizes)) if i not in done}
        if not left:
            return [done[i] for i in range(len(sizes))]
        level = (total - sum(done.values())) / sum(weights[i] for i in left)
        over = [i for i in left if level * weights[i] > most * sizes[i]]
        if not over:
            return [done.get(i, level * weights[i]) for i in range(len(sizes))]
        done |= {i: Fraction(most * sizes[i]) for i in over}


@pytest.mark.parametrize("seed", range(6))
def test_water_filling(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 12)
    sizes, weights = [rnd.choice([0, 1, 10, 500, 9000]) for _ in range(n)], [rnd.choice([1, 2, 5]) for _ in range(n)]
    total = Fraction(rnd.choice([3, 7]) * sum(sizes), 2 if seed % 2 else 4)
    rows = spark.createDataFrame([(f"s{i:02d}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "__key string, size long, w int")
    got = {r["__key"]: r["target"] for r in mixing.water_fill(rows, "size", "w", F.lit(float(total)), 2).collect()}
    for i, t in enumerate(water_fill(sizes, weights, total, 2)):
        assert got[f"s{i:02d}"] == pytest.approx(float(t), rel=1e-12, abs=1e-9)


def test_mix(awkward):
    rows = [r.asDict() for r in mixing.mix(awkward).collect()]
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in awkward.select("doc_id").collect())
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], Fraction(3 * sum(sizes.values()), 2), 2)
    for s, t in zip(order, targets):
        assert {r["source_size"] for r in by[s]} == {sizes[s]} and by[s][0]["target"] == pytest.approx(float(t))
        assert abs(sum(r["taken"] for r in by[s]) - float(t)) <= max(r["size"] for r in by[s]) / 2 + 1e-6
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixing.mix(awkward.repartition(7)).collect())


def test_word_counts(spark):
    texts = [None, "", " a  b\n\tc ", "no break", "x\x1cy"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(mixing.word_count(F.col("t"))).collect()] == [0, 0, 3, 1, 1]


def test_repeats(awkward):
    taken = mixing.mix(awkward)
    out = mixing.repeat_rows(awkward, taken)
    assert out.columns == awkward.columns
    want = Counter()
    for r in taken.collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +want


def test_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.repeat_rows(empty, mixing.mix(empty)).count() == 0


def test_sources_without_words(spark):
    rows = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(rows).collect()] == [(0.0, 0)] * 2


def test_repeats_among_equal_keys(spark):
    rows = spark.createDataFrame([(1, f"a b c d {i}", "s", i) for i in range(30)] + [(2, "x y", "t", 0)] * 5, "doc_id long, text string, source string, n int")
    taken = mixing.mix(rows, weights=(1, 3))
    out = mixing.repeat_rows(rows, taken).collect()
    want = Counter()
    for r in taken.collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out) == +want
    times = Counter(r["n"] for r in out if r["doc_id"] == 1)
    assert max(times.values()) - min(times.get(i, 0) for i in range(30)) == 1
