import hashlib
import importlib
import os
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

import test_decontam
import test_minhash
import test_mixing
import test_sharding
from wordloom.llm import langid, queries, sql

SF = "/root/testdata/sf0.001"


def compare(spark, query, oracle, sf=SF):
    import pyarrow as pa

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    left = query(spark, sf).toArrow()
    left = left.select(sorted(left.column_names))
    con.register("spark_rows", pa.table(left))
    expected_rows = con.sql(oracle)
    assert sorted(expected_rows.columns) == left.column_names
    expected_rows = expected_rows.select(", ".join(f'"{c}"' for c in left.column_names))
    con.sql("CREATE TABLE oracle_rows AS SELECT * FROM expected_rows")
    for a, b in (("spark_rows", "oracle_rows"), ("oracle_rows", "spark_rows")):
        assert con.sql(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_oracle(spark, name):
    compare(spark, queries.QUERIES[name], sql.ORACLE[name])


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_for_each_operator(n):
    assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1


def test_contract_columns(spark):
    want = {2: "doc_id held_out lang_pred score", 7: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", 9: "doc_id held_out score predicted"}
    kinds = {"held_out": "boolean", "score": "double", "predicted": "int", "n_bytes": "bigint", "payload_bytes": "bigint", "tail_crc32": "bigint", "media_bytes": "bigint"}
    for name, query in queries.QUERIES.items():
        if cols := want.get(int(name[2:].split("_")[0])):
            df = query(spark, SF)
            assert set(cols.split()) <= set(df.columns)
            assert all(k == kinds.get(c, k) for c, k in df.dtypes)
            assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    awkward.write.parquet(f"{path}/documents.parquet")
    leak = awkward.filter("doc_id = 7").orderBy("text").first()["text"]
    spark.createDataFrame([(1, leak), (2, "one two")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, leak


def test_pipeline_against_brute_force(spark, awkward, folder):
    import corpus_pipeline

    path, leak = folder
    docs = [r.asDict() for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = corpus_pipeline.run(spark, path).collect()

    found = corpus_pipeline.language_id(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert found.columns == awkward.columns
    kept = [r.asDict() for r in found.collect()]
    model = langid.train(spark.read.parquet(f"{path}/documents.parquet").filter(~queries.held_out()))
    mains = [max(langid.infer(model, r["text"])[2].values(), default=0.0) for r in docs]
    assert Counter(map(str, kept)) == Counter(str(r) for r, share in zip(docs, mains) if share >= 0.5) and len(kept) > 40

    classes, order = defaultdict(list), sorted(kept, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r, c in zip(order, test_minhash.exact([r["text"] for r in order])):
        classes[c].append(r)
    kept = [own[0] for own in classes.values()]

    kept = [r for r in kept if not test_decontam.brute([(0, r["text"])], [(1, leak), (2, "one two")])]

    by = defaultdict(list)
    for r in kept:
        r["size"] = len(r["text"].split())
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is None, s))
    sizes = [sum(r["size"] for r in by[s]) for s in sources]
    targets = test_mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], Fraction(3 * sum(sizes), 2), 2)
    taken = Counter()
    for s, size, target in zip(sources, sizes, targets):
        whole, before = int(target // size) if size else 0, 0
        rest = target - whole * size
        for r in sorted(by[s], key=lambda r: (hashlib.md5(f"17:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["size"])):
            more = rest > 0 and 2 * before + r["size"] <= 2 * rest
            before += r["size"]
            taken[r["doc_id"], len(r["text"].encode()) + 1] += whole + more
    taken = +taken
    key = lambda i: "~" if i is None else f"={i}"
    want = Counter({(i, n, test_sharding.best(key(i), [1.0] * 8)): c for (i, n), c in taken.items()})
    assert Counter((r["doc_id"], r["size"], r["shard"]) for r in got) == want
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_stages_over_nothing(spark, empty, folder):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, folder[0])
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder[0]).count() == 0


def test_stage_order():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    entry = importlib.import_module("__spark_entry__")
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(sql.ORACLE) <= set(entry.oracle_sql())
