import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.llm import decontam
from wordloom.storage import materialize

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def tokens(text):
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def runs(w):
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) > 4 else [tuple(w)] if w else []


def brute(docs, items):
    """Every window of every text against every item."""
    out = {}
    for d, text in docs:
        hs = runs(tokens(text))
        for i, item in items:
            want = runs(tokens(item))
            if not hs or not want:
                continue
            size = min(len(hs), len(want))
            for s in range(len(hs) - size + 1):
                common = sum((Counter(hs[s:s + size]) & Counter(want)).values())
                sim = common / (size + len(want) - common)
                if sim >= 0.8:
                    out[d, i] = max(out.get((d, i), 0.0), sim)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 400)}"
    items = [[word() for _ in range(rnd.randint(5, 60))] for _ in range(15)] + [["la"] * 20, ["a", "b", "c"], ["x", "y"] * 15]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rnd.randint(0, 150))]
        if i % 3:
            planted = list(rnd.choice(items))
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(planted))
                planted[at:at + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
            at = rnd.randint(0, len(text))
            text[at:at] = planted * rnd.choice([1, 1, 2])
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(text)))
    docs += [(104, "A, b: c!"), (105, "a b c d"), (106, "b c"), (100, " ".join(items[0][:-1])), (101, " ".join(items[1]).upper()), (102, "la " * 300), (103, "x y " * 40)]
    return docs, list(enumerate(" ".join(x) for x in items))


@pytest.mark.parametrize("seed", range(2))
def test_against_every_window(spark, seed):
    docs, items = corpus(seed)
    rows = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["id"], r["item_id"]): r["similarity"] for r in rows} == brute(docs, items) and len(rows) == len({(r["id"], r["item_id"]) for r in rows})
    for r in rows:
        text, item = (runs(tokens(dict(x)[k])) for x, k in ((docs, r["id"]), (items, r["item_id"])))
        size = min(len(text), len(item))
        common = sum((Counter(text[r["start"]:r["start"] + size]) & Counter(item)).values())
        assert common / (size + len(item) - common) == r["similarity"]


def test_simhash_and_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.getrandbits(64) - 2**63 for _ in range(rnd.randint(1, 40))]) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, h array<long>").withColumn("p", decontam.simhash(F.col("h")))
    for i, h, p in df.collect():
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert p % 2**64 == want
    assert sum(decontam.WIDTHS) == 64 and len(decontam.WIDTHS) == decontam.RADIUS + 1
    merged = 0
    for m in decontam.MASKS:
        assert not merged & m % 2**64
        merged |= m % 2**64
    assert merged == 2**64 - 1
    flips = [(0, sum(1 << b for b in rnd.sample(range(64), decontam.RADIUS))) for _ in range(50)]
    pairs = spark.createDataFrame([(a, b - 2**64 if b >> 63 else b) for a, b in flips], "a long, b long")
    assert pairs.filter(F.arrays_overlap(F.transform(decontam.block_values(F.col("a")), lambda v: v.cast("string")),
                                         F.transform(decontam.block_values(F.col("b")), lambda v: v.cast("string")))).count() == 50


def test_common_weight(spark):
    rows = [([1, 1, 2], [1, 2, 2]), ([1, 2], [1, 1, 1]), ([1, 1, 1, 3], [1, 1, 3, 3]), ([1], [2])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    assert [r[0] for r in df.select(decontam.common_weight(F.col("a"), F.col("b"))).collect()] == [
        sum((Counter(a) & Counter(b)).values()) for a, b in rows]


def test_awkward(spark, awkward, empty):
    items = spark.createDataFrame([(1, None), (None, "one two three four five six"), (2, ""), (3, awkward.filter("doc_id = 0").first()["text"]),
                                   (3, "one two three four five six"), (4, "a b")], ITEMS).withColumn("hash", F.lit("x")).withColumn("n", F.lit(1))
    rows = decontam.contaminated(awkward, items).collect()
    assert sorted((str(r["id"]), r["item_id"]) for r in rows) == [("0", 3), ("1", 3), ("None", 3)]
    kept = decontam.drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(awkward, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(awkward, items.limit(0)).count() == awkward.count()


def test_repeated_shingles_are_found_beyond_the_radius(spark):
    """Windows that lack what the item repeats reach the threshold by weight while many bits of the fingerprints differ."""
    rnd = random.Random(11)
    docs, items = [], []
    for i in range(60):
        words = [f"q{i}x{j}" for j in range(40)]
        repeated = words[:5] * rnd.choice([2, 3, 4])
        items.append((i, " ".join(words[5:] + repeated)))
        docs.append((i, " ".join([f"z{rnd.random()}"] * 3 + words[5:] + repeated[:5 * rnd.choice([1, 2])])))
    rows = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    want = brute(docs, items)
    assert {(r["id"], r["item_id"]): r["similarity"] for r in rows} == want and len(want) > 10


def test_items_that_share_passages_bring_few_pairs(spark, monkeypatch):
    """Ten thousand items of one size with a common introduction: a window meets few of them."""
    rnd = random.Random(4)
    head = [f"intro{k}" for k in range(12)]
    items = [(i, " ".join(head + [f"a{i}b{rnd.randint(0, 9)}c{k}" for k in range(28)])) for i in range(10_000)]
    docs = [(i, " ".join([f"f{rnd.random()}" for _ in range(30)] + items[i * 37][1].split()[:-2] + ["and", "more", "words"])) for i in range(100)]
    docs += [(1000 + i, " ".join(head * 4)) for i in range(20)]
    seen = {}
    monkeypatch.setattr(decontam, "materialize", lambda df, name: seen.setdefault(name, materialize(df, name)))
    rows = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {r["id"]: r["item_id"] for r in rows} == {i: i * 37 for i in range(100)}
    assert seen["pairs"].count() < 5 * seen["prints"].count()
    print("pairs", seen["pairs"].count(), "windows", seen["prints"].count())


def test_marks_in_blocks_and_joins_without_broadcast(spark, monkeypatch):
    import wordloom.storage as storage

    monkeypatch.setattr(decontam, "MARKS", 100)
    monkeypatch.setattr(decontam, "join_small", lambda *a, **k: storage.join_small(*a, limit=0))
    docs, items = corpus(7)
    rows = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["id"], r["item_id"]): r["similarity"] for r in rows} == brute(docs, items)
