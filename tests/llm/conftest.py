import random

import pytest

CLASHING = "hash string, id long, node long, size long, score double, shard int, label int, copies int, n int, bucket string, __text string, path string, meta map<string,int>"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in each column, empty, blank and very long texts, repeated rows, ties, and columns whose names clash."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    long = text(40_000)
    same = text(30)
    rows = [(0, same, "en", "a"), (1, same, "en", "b"), (2, None, "en", "a"), (3, "", None, "a"), (4, " \n\t", "en", None), (5, long, "en", "b"),
            (None, text(20), "en", "a"), (None, text(20), None, None), (None, same, "en", "a"), (6, "###", "xx", "c"), (7, text(12), "en", "a"), (7, text(12), "fr", "a"),
            (8, text(9), "en", "z"), (8, text(9), "en", "z"), (9, "one two", "en", "a"), (9, "one two", "en", "a"), (10, "Ünïcödé — ¿qué? 世界", "es", "a"),
            (11, "x" * 100_000, "en", "b"), (12, None, None, None), (12, None, None, None)]
    rows[13] = rows[12]
    rows += [(100 + i, text(rnd.randint(1, 60)), rnd.choice(["en", "fr"]), rnd.choice("abcd")) for i in range(40)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    extra = ("h", 1, 2, 3, 0.5, 4, 5, 6, 7, "b", "t", "p", {"k": 1})
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *extra) for r in rows], schema).cache()


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
