import datetime as dt

from pyspark.sql import functions as F

from wordloom.streaming import sessions

START = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drained(spark, tmp_path, df, mode="append"):
    out = str(tmp_path / "out")
    sessions.drain(df, lambda batch, _: batch.write.mode("append").parquet(out), str(tmp_path / "state"), mode)
    return spark.read.parquet(out).collect()


def test_runs_break_after_the_gap(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, at(0)), (1, at(10)), (1, at(20.000001)), (1, at(5000))]
    want = [(at(0), at(10), 2), (at(20.000001), at(20.000001), 1)]
    batch = spark.createDataFrame(rows, "k long, ts timestamp")
    got = sessions.runs(batch, "k", "ts", "10 seconds").orderBy("run_start").collect()
    assert [(r["run_start"], r["run_end"], r["n"]) for r in got][:2] == want and len(got) == 3
    live = sessions.runs(stream(spark, tmp_path, rows, "k long, ts timestamp"), "k", "ts", "10 seconds", "1 second")
    assert sorted((r["run_start"], r["run_end"], r["n"]) for r in drained(spark, tmp_path, live)) == want  # the last run is still open


def test_repeats(spark, tmp_path):
    rows = [(1, i, t) for i, t in enumerate("ABACA")] + [(2, 0, "A")]
    got = drained(spark, tmp_path, sessions.kept_runs(stream(spark, tmp_path, rows, "job_id long, run int, text string")))
    assert sorted((r["job_id"], r["run"]) for r in got) == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 0)]


def test_merged_ranges(spark, tmp_path):
    """Ranges that come in several batches are merged like those of a whole job."""
    import random

    import numpy as np

    from wordloom.operators.folds import Words
    from wordloom.params import Params

    rnd, rows, want, p = random.Random(4), [], [], Params()
    for job in range(12):
        n = rnd.randint(1, 25)
        gaps = np.array([rnd.choice([0.05, 0.5, 2.0]) for _ in range(n)])
        lengths = np.array([rnd.choice([0.2, 0.7, 1.5]) for _ in range(n)])
        start = np.cumsum(gaps + lengths) - lengths
        words = Words(start, start + lengths, np.array([rnd.choice([0.3, 0.6, 0.8]) for _ in range(n)]), p)
        cuts = sorted({n, *(rnd.randint(1, n) for _ in range(8))})
        for a, b in zip([0, *cuts[:-1]], cuts):
            rows.append((job, a, b, float(start[a]), float(words.end[b - 1]), b < n and bool(words.joins(b)), b == n))
        merged = words.merge(cuts)
        want += [(job, a, b) for a, b in zip([0, *merged[:-1]], merged)]
    schema = "job_id long, word_start int, word_end int, start double, end double, weak boolean, last boolean"
    for i in range(4):  # a job's ranges arrive in order, over four batches
        part = [r for r in rows if (r[1] * 4) // 25 == i]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(spark, tmp_path, sessions.merged_ranges(live, p))
    assert sorted((r["job_id"], r["word_start"], r["word_end"]) for r in got) == sorted(want)


def test_poll(spark, tmp_path):
    import time

    seen = []
    query = sessions.poll(stream(spark, tmp_path, [(1,)], "x int"), lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "state"), "200 milliseconds")
    try:
        for _ in range(60):
            if seen:
                break
            time.sleep(0.5)
        assert len(seen) == 1 and query.isActive
    finally:
        query.stop()


def test_first_of_key(spark, tmp_path):
    rows = [("a", START), ("a", START), ("b", START)]
    got = drained(spark, tmp_path, sessions.first_of_key(stream(spark, tmp_path, rows, "key string, ts timestamp"), "key", "ts"))
    assert sorted(r["key"] for r in got) == ["a", "b"]


def test_levels(spark):
    rows = spark.createDataFrame([(1, START + dt.timedelta(milliseconds=i), 3.0) for i in range(20)], "k long, ts timestamp, x double")
    got = sessions.levels(rows, "k", "ts", "x").select(F.min("level"), F.max("level"), F.count("*")).first()
    assert tuple(got) == (3.0, 3.0, 5)


def test_stale_jobs(spark, tmp_path):
    import time

    beats = stream(spark, tmp_path, [("a",)], "id string")
    query = (sessions.stale_jobs(beats, 500).writeStream.format("memory").queryName("stale").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start())
    try:
        for _ in range(60):
            if spark.table("stale").count():
                break
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("stale").collect()] == [("a", 1)]
    finally:
        query.stop()
