import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from wordloom import oracle, queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    left = queries.QUERIES[name](spark, SF).toArrow()
    left = left.select(sorted(left.column_names))
    con.register("spark_rows", left)
    expected_rows = con.sql(oracle.ORACLE[name])
    assert sorted(expected_rows.columns) == left.column_names
    expected_rows = expected_rows.select(", ".join(f'"{c}"' for c in left.column_names))
    con.sql("CREATE TABLE oracle_rows AS SELECT * FROM expected_rows")
    for a, b in (("spark_rows", "oracle_rows"), ("oracle_rows", "spark_rows")):
        assert con.sql(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b} LIMIT 3").fetchall() == []


def test_matched_signals_are_the_sqls_to_the_bit(spark):
    """SQL holds the two zeros for equal; whoever compares rows as text or bytes doesn't."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = {r["vec_id"]: [float(x).hex() for x in r["samples"]] for r in queries.signal_matched(spark, SF).collect()}
    wanted = {n: [float(x).hex() for x in xs] for n, xs in con.sql(oracle.ORACLE["signal_matched"]).fetchall()}
    assert got == wanted and any("-0x0.0p+0" in xs for xs in wanted.values())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_queries_without_sql_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_segments_tile_the_words(spark):
    words = dict(queries.job_words(spark, SF).groupBy("job_id").count().collect())
    for name in ("sentences", "constrained_segments", "merged_segments", "divided_segments", "word_chunks"):
        ranges = {}
        for r in queries.QUERIES[name](spark, SF).orderBy("job_id", "seg_index").collect():
            assert r["word_start"] == ranges.get(r["job_id"], 0) and r["word_end"] > r["word_start"]
            ranges[r["job_id"]] = r["word_end"]
        assert ranges == words


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_folders(tmp_path):
    """With the optional folders deleted, and only they, the rest imports, registers its queries and passes a core test."""
    repo = tmp_path / "repo"
    shutil.copytree(ROOT, repo, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    env = {**os.environ, "PYTHONPATH": ""}
    for gone in ([], [repo / "corpus_pipeline.py"]):  # with and without the pipeline, which needs the folder
        for file in gone:
            file.unlink(missing_ok=True)
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        found = subprocess.run([sys.executable, "-c", code], cwd=repo, env=env, capture_output=True, text=True, check=True)
        assert found.stdout.split()[-2:] == [str(len(queries.QUERIES)), str(len(oracle.ORACLE))]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_text.py"], cwd=repo, env=env, check=True, capture_output=True)
