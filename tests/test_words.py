import random

import numpy as np

from wordloom.operators import folds, words
from wordloom.params import CHUNKS


def fill_times(start: list, end: list) -> tuple[list[float], list[float]]:
    """Missing starts take the previous word's end (0 at first), missing ends their start; no end before its start."""
    starts, ends, last = [], [], 0.0
    for s, e in zip(start, end):
        s = last if s is None or s != s else float(s)
        last = s if e is None or e != e else max(float(e), s)
        starts.append(s)
        ends.append(last)
    return starts, ends


def runs_of(starts: list, ends: list, gap: float = folds.RUN_GAP) -> list[int]:
    """Run number of each word: a pause of more than ``gap`` starts a new one."""
    pause = np.asarray(starts[1:], float) - np.asarray(ends[:-1], float)
    return np.concatenate(([0], np.cumsum(pause > gap))).astype(int).tolist() if len(starts) else []


def chunks(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], CHUNKS)


def runs(spark, *rows):
    got = words.with_runs(chunks(spark, *rows)).orderBy("pos").collect()
    return [(r["text"], r["start"], r["end"], r["run"]) for r in got]


def test_long_gap_starts_a_run(spark):
    assert [r[3] for r in runs(spark, ("a", 0.0, 0.5), ("b", 0.6, 1.0), ("c", 5.0, 5.4))] == [0, 0, 1]


def test_exact_gap_does_not(spark):
    assert [r[3] for r in runs(spark, ("a", 0.0, 0.0), ("b", 0.8, 1.0))] == [0, 0]


def test_missing_times(spark):
    assert runs(spark, ("a", 0.0, 0.5), ("b", None, None)) == [("a", 0.0, 0.5, 0), ("b", 0.5, 0.5, 0)]
    assert runs(spark, ("a", None, None)) == [("a", 0.0, 0.0, 0)]
    assert runs(spark, ("a", 2.0, 1.0)) == [("a", 2.0, 2.0, 0)]
    assert runs(spark, ("a", 0.0, 0.5), ("b", None, 0.7), ("c", None, None)) == [("a", 0.0, 0.5, 0), ("b", 0.5, 0.7, 0), ("c", 0.7, 0.7, 0)]


def test_blank_dropped(spark):
    assert [r[0] for r in runs(spark, ("  ", 0.0, 0.1), ("a", 0.2, 0.3))] == ["a"]


def test_windows_agree_with_the_fold(spark):
    rnd, rows, at = random.Random(1), [], 0.0
    for i in range(200):
        at += rnd.choice([0.1, 0.8, 0.9, -0.05])
        rows.append((f"w{i}", at, rnd.choice([None, at + 0.2, at - 0.1])))
    start, end = fill_times([r[1] for r in rows], [r[2] for r in rows])
    got = runs(spark, *rows)
    assert [(r[1], r[2]) for r in got] == list(zip(start, end))
    assert [r[3] for r in got] == runs_of(start, end)


def test_repeats_compare_with_kept_runs():
    assert folds.accepted(list("ABACA"), [False] * 5) == [True, True, False, True, True]
    assert folds.accepted(["A", "B", "C", "A"], [False] * 4) == [True, True, True, True]
    assert folds.accepted(["A", "", "x"], [False, False, True]) == [True, False, False]


def test_degenerate():
    credit = "Редактор субтитров А.Семкин Корректор А.Егорова " * 6
    assert words.is_degenerate(credit) and not words.is_degenerate("да да да") and not words.is_degenerate(None)


def test_collect_drops_credits_and_sorts(spark):
    rows = [("Привет", 0.0, 0.5), ("Thanks", 5.0, 5.2), ("for", 5.2, 5.3), ("watching", 5.3, 5.6)]
    got = words.collect_words(chunks(spark, *rows)).collect()
    assert [r["text"] for r in got] == ["Привет"]
    got = words.collect_words(chunks(spark, ("b", 5.0, 5.1), ("a", 0.0, 0.1))).orderBy("word_index").collect()
    assert [r["text"] for r in got] == ["a", "b"]


def test_empty(spark):
    assert words.collect_words(spark.createDataFrame([], CHUNKS)).count() == 0


def test_collected_words_shuffle_once(spark):
    """Words are put in order inside their job's array; a window after the Python fold would shuffle them all again."""
    rows = chunks(spark, ("b", 5.0, 5.5), ("a", 0.0, 0.5), ("c", 5.0, 5.2))
    made = words.collect_words(rows, stuck=False)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r["word_index"], r["text"]) for r in made.orderBy("word_index").collect()] == [(0, "a"), (1, "c"), (2, "b")]
