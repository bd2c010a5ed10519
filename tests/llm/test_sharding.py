import hashlib
import math
import zlib
from collections import Counter

import pytest

from wordloom.llm import sharding


def best(key, weights):
    def score(i):
        u = (int(hashlib.md5(f"{key}#{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weights[i], i

    return min(score(i) for i in range(len(weights)) if weights[i] > 0)[1]


def test_against_brute_force(awkward):
    docs = awkward.collect()
    rows = sharding.shard(awkward).collect()
    key = lambda r: "~" if r["doc_id"] is None else f"={r['doc_id']}"
    data = lambda r: (r["text"] or "").encode()
    want = Counter((r["doc_id"], len(data(r)) + 1, zlib.crc32(data(r)), best(key(r), [1.0] * 8), best(key(r), [1.0] * 9)) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want
    for shard in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows) and {r["law"] for r in rows} == {"key"}
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.shard(awkward.repartition(5)).collect()), key=str)


def test_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "cast(null as string) AS text")
    found = Counter(r["shard"] for r in sharding.shard(docs, weights=[1.0, 2.0, 0.0, 1.0]).collect())
    assert found[2] == 0 and found[1] == pytest.approx(10_000, rel=0.05) and found[0] == pytest.approx(5_000, rel=0.06)
    with pytest.raises(ValueError):
        sharding.shard(docs, weights=[0.0])


def test_empty(empty):
    assert sharding.shard(empty).count() == 0
