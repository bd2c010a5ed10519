import hashlib
import random

import pytest

from wordloom.llm import warc
from wordloom.storage import shared_path

PAGES = "page_id long, url string, html string"
BIG = "é" * 60  # 120 bytes
ROWS = [(5, "http://b.com/2", BIG), (3, "http://b.com/1", BIG), (9, "http://www.b.com/1", BIG), (1, "http://a.com/", "short"), (2, "http://a.com/", "short"),
        (4, None, None), (6, "http://c.com/?q=1", ""), (None, "http://n.com/", BIG), (None, "http://n.com/", "x" * 100), (7, "http://e.com/\r\nX: y", "WARC/1.1\r\n\r\n" * 30),
        (8, "http://big.com", "z" * 3_000_000), (10, "http://b.com/1", BIG + "\r\n\r\n"), (11, "", "a\u0000b"), (12, "no scheme", "\U0001f600")]


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        first = min(ids) if ids and len(data) >= 100 else None
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def columns(r):
    return r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3 * warc.CLASS_BYTES)
    got = warc.archive(spark.createDataFrame(ROWS, PAGES).repartition(3)).collect()
    assert sorted(map(columns, got), key=str) == expected(ROWS)
    order = [(r["url_key"], r["captured_at"], r["page_id"] is None, r["page_id"] or 0) for r in got]
    assert order == sorted(order)


def test_archives_hold_whole_records(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(warc.plan_records(spark.createDataFrame(ROWS, PAGES).coalesce(1)), path)
    found, names = {}, set()
    for f in (tmp_path / "warc").glob("part-*"):
        data = f.read_bytes()
        for at, length, headers, block in warc.parse_records(data):
            assert data[at:at + 8] == b"WARC/1.1" and data[at + length:at + length + 4] == b"\r\n\r\n"
            assert headers["warc-record-id"] not in names  # one name for each record
            names.add(headers["warc-record-id"])
            found[headers["warc-record-id"].rsplit(":", 1)[0]] = headers, bytes(block).split(b"\r\n\r\n", 1)[1]
    assert found["<urn:page:8"][1] == b"z" * 3_000_000 and found["<urn:page:5"][1] == b""
    assert found["<urn:page:5"][0]["warc-refers-to"] == found["<urn:page:3"][0]["warc-record-id"] and found["<urn:page:7"][0]["warc-target-uri"] == "http://e.com/%0D%0AX: y"
    assert "warc-target-uri" not in found["<urn:page:4"][0]


def test_damage_is_seen():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [x[3] for x in warc.parse_records(good * 2)] == [b"abc"] * 2 and list(warc.parse_records(b"")) == []
    for bad in (good[:-5], b"x" + good, good.replace(b"3", b"2")):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


@pytest.mark.parametrize("seed", range(30))
def test_loser_tree(seed):
    rnd = random.Random(seed)
    runs = [sorted((rnd.randint(0, 20), rnd.randint(0, 9)) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(rnd.randint(0, 17))]
    merged = list(warc.LoserTree(runs, lambda x: x))
    assert merged == sorted(x for r in runs for x in r)
    first = list(warc.LoserTree([[(x, i) for x, _ in r] for i, r in enumerate(runs)], lambda x: x[0]))  # ties go to the earlier run
    assert first == sorted(first)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "CAPTURES_PER_RANGE", 20)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 17 * warc.CLASS_BYTES)
    rows = [(i, f"http://{'abc'[i % 3]}.com/{i % 7}", f"page {i % 50} " * 20) for i in range(300)]
    got = warc.archive(spark.createDataFrame(rows, PAGES).repartition(5)).collect()
    assert sorted(map(columns, got), key=str) == expected(rows)
    keys = [(r["url_key"], r["captured_at"]) for r in got]
    assert keys == sorted(keys) and len({r["archive"] for r in got}) > 5


def test_offsets_find_the_records(spark, tmp_path):
    got = warc.archive(spark.createDataFrame(ROWS, PAGES), str(tmp_path / "warc")).collect()
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in got:
        with open(tmp_path / "warc" / r["archive"], "rb") as f:
            f.seek(r["offset"])
            raw = f.read(r["length"])
        assert raw.startswith(b"WARC/1.1\r\n") and f"<urn:page:{'' if r['page_id'] is None else r['page_id']}:".encode() in raw
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert raw.endswith(b"\r\n\r\n" + html[r["page_id"]])


def test_large_pages_stand_in_archives_of_bounded_size(spark, tmp_path):
    pages = spark.range(40, numPartitions=2).selectExpr("id AS page_id", "concat('http://h.com/', id) AS url", "concat(repeat(cast(id % 10 AS string), 20000000), id) AS html")
    small = spark.range(40, 200).selectExpr("id AS page_id", "concat('http://h.com/', id) AS url", "concat('page ', id, repeat('x', 200)) AS html")
    got = warc.archive(pages.union(small), str(tmp_path / "warc"))
    assert got.agg({"payload_bytes": "sum", "page_id": "count"}).first().asDict()["count(page_id)"] == 200
    sizes = [f.stat().st_size for f in (tmp_path / "warc").glob("part-*")]
    assert max(sizes) <= warc.ARCHIVE_BYTES * 1.1 and sum(sizes) > 40 * 20_000_000
    assert {r["record_type"] for r in got.select("record_type").distinct().collect()} == {"response"}


def test_hot_digests(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_DIGEST", 5)
    rows = [(i, f"http://a.com/{i}", "same " * 40 if i % 3 else f"pair {i // 6} " * 30) for i in range(60)] + [(None, "http://x/", "same " * 40), (99, "u://", "")]
    assert sorted(map(columns, warc.archive(spark.createDataFrame(rows, PAGES)).collect()), key=str) == expected(rows)


def test_url_keys():
    assert [warc.url_key(u) for u in (None, "", "x", "http://www.B.com", "http://b.com:80/A?Q#f", "http://b.com?x")] == [
        "", "", "x", "com,b)/", "com:80,b)/a?q", "com,b)?x"]


def test_repeats_extra_columns_and_empty(spark):
    rows = [(1, "http://a/", BIG)] * 2 + [(2, "http://a/", BIG)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS payload", "'y' AS record_type", "1 AS first", "2 AS offset")
    assert sorted((r["page_id"], r["record_type"]) for r in warc.archive(df).collect()) == [(1, "response"), (1, "response"), (2, "revisit")]
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
    assert shared_path(spark, "a") != shared_path(spark, "a")
