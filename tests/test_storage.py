import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wordloom import storage
from wordloom.operators import words


def test_hot_keys_are_dealt(spark, monkeypatch):
    rnd = random.Random(1)
    many = storage.materialize(spark.createDataFrame([(rnd.choice([1, 1, 1, 2, rnd.randint(3, 40), None]), i) for i in range(2000)], "k long, i long"), "many")
    one = storage.materialize(spark.createDataFrame([(k, k * 10) for k in range(30)], "k long, v long"), "one")
    hot = storage.hot_keys(many, "k")
    counts = dict(many.groupBy("k").count().collect())
    assert {r["k"]: r["deals"] for r in hot.collect()} == {k: -(-n // storage.HOT_ROWS) for k, n in counts.items() if n > storage.HOT_ROWS}
    for how in ("inner", "left"):
        want = sorted(map(tuple, many.join(one, "k", how).collect()), key=str)
        dealt = storage.join_dealt(many, one, "k", hot, F.col("i"), how)
        assert sorted(map(tuple, dealt.select("k", "i", "v").collect()), key=str) == want
        monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(storage, "is_small", lambda *a: False)
        assert sorted(map(tuple, storage.join_skewed(many, one, "k", F.col("i"), how).select("k", "i", "v").collect()), key=str) == want
        monkeypatch.undo()
    assert storage.hot_keys(one, "k") is None


def test_hot_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(storage, "HOT_KEYS", 5)
    many = storage.materialize(spark.range(1000).selectExpr("id % 10 AS k"), "many")
    hot = storage.hot_keys(many, "k", least=1)
    assert hot is None or hot.count() <= 5


def test_small_by_rows_and_bytes(spark):
    rows = storage.materialize(spark.range(100).selectExpr("id", "repeat('x', 1000) AS t", "array(id, id) AS a", "map('k', id) AS m", "struct(id, 'y') AS s"), "rows")
    assert storage.is_small(rows) and not storage.is_small(rows, limit=99) and not storage.is_small(rows, size=100_000) and storage.is_small(rows, size=120_000)
    empty = storage.materialize(rows.limit(0), "empty")
    assert storage.is_small(empty, 0, 0)


def test_running_totals(spark, monkeypatch):
    """Against a plain loop, also where one group has most rows and where rows are all alike."""
    monkeypatch.setattr(storage, "ROWS_PER_RANGE", 100)
    rnd = random.Random(3)
    rows = [(rnd.choice("aaaab"), rnd.choice([5, 5, 5, rnd.randint(0, 9)]), rnd.randint(0, 4)) for _ in range(1500)]
    df = storage.materialize(spark.createDataFrame(rows, "g string, o long, v long"), "rows")
    got = storage.running_total(df, ["g"], [F.col("o"), F.col("v")], F.col("v"), "before")
    assert got.columns == ["g", "o", "v", "before"]
    want, total = [], {}
    for g, o, v in sorted(rows):
        want.append((g, o, v, total.get(g, 0)))
        total[g] = total.get(g, 0) + v
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_tables_come_and_go(spark):
    table = storage.materialize(spark.range(3), "t")
    path = table._shared_path
    assert os.path.isdir(path) and table.count() == 3
    storage.release(table)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))

    assert storage.shared_dir(session("spark://host:7077", "/shared/")) == "/shared"
    assert storage.shared_dir(session("local[4]")) == storage.LOCAL_FALLBACK
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session("yarn"))


def test_arrow_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError):
        with storage.arrow_batches(spark, 7):
            assert spark.conf.get(key) == "7"
            raise RuntimeError
    assert spark.conf.get(key) == before


def test_any_columns_can_be_sorted(spark):
    df = spark.sql("SELECT 1 AS a, map('k', 2) AS m, array(map('k', 1)) AS n, struct('x', map('y', 1)) AS s, parse_json('[1]') AS v")
    assert df.orderBy(*storage.sortable(df)).count() == 1


def test_texts_are_dealt_to_small_partitions(spark, tmp_path, monkeypatch):
    """However few bytes are shuffled, adaptive execution doesn't join them."""
    path = str(tmp_path / "documents.parquet")
    spark.range(400).selectExpr("id AS doc_id", "repeat(concat(id, ' '), 50) AS text").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    monkeypatch.setattr(storage, "BYTES_PER_PART", size // 40)
    assert words.from_documents(docs).rdd.getNumPartitions() == -(-size // (size // 40)) >= 40
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a b")]), "doc_id long, text string")
    assert words.from_documents(unknown).count() == 2
