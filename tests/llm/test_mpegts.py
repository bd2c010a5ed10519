import hashlib
import random
import zlib

import numpy as np
import pytest

from wordloom.llm import mpegts


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 9216, 9217, 300_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = mpegts.pad(data)
    assert payload.startswith(data) and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and payload
    media = mpegts.mux(payload)
    read = mpegts.demux(media)
    units = len(payload) // 576
    assert read["payload"] == payload and read["gaps"] == 0 and len(media) % 188 == 0
    assert read["pts"].tolist() == [3600 * i for i in range(units)]
    assert np.flatnonzero(read["random"]).tolist() == list(range(0, units, 16))


def test_payload_that_looks_like_headers():
    payload = mpegts.pad(b"\x00\x00\x01\xbd\x47" * 1000)
    assert mpegts.demux(mpegts.mux(payload))["payload"] == payload


def packets_of(media):
    return [media[i:i + 188] for i in range(0, len(media), 188)]


def test_lost_packets_end_their_elementary_packet():
    payload = mpegts.pad(random.Random(1).randbytes(576 * 5))
    units = [payload[i:i + 576] for i in range(0, len(payload), 576)]
    packets = packets_of(mpegts.mux(payload))
    for lost in range(2, len(packets)):
        read = mpegts.demux(b"".join(packets[:lost] + packets[lost + 1:]))
        unit, part = divmod(lost - 2, mpegts.PER_UNIT)
        broken = read["complete"].tolist()
        if part == 0:  # without its start the rest can't be placed
            assert read["payload"] == b"".join(units[:unit] + units[unit + 1:]) and broken == [True] * 4
        else:
            before = 182 * part - mpegts.PES_HEADER
            assert read["payload"] == b"".join(units[:unit] + [units[unit][:before]] + units[unit + 1:])
            assert broken == [i != unit for i in range(5)]
        assert read["gaps"] == (2 < lost < len(packets) - 1)  # nothing shows that the first or last was there


def test_duplicate_packets_are_legal():
    payload = mpegts.pad(random.Random(2).randbytes(576 * 4))
    packets = packets_of(mpegts.mux(payload))
    for twice in range(len(packets)):
        read = mpegts.demux(b"".join(packets[:twice + 1] + packets[twice:]))
        assert read["payload"] == payload and read["gaps"] == 0 and read["complete"].all()
        assert read["duplicates"] == (twice >= 2)


def other_stream(rnd, units, *, tables_every=7, adapt=True, unbounded=False):
    """A stream of two programs by plain loops: long map tables over several packets, repeated tables, two stream kinds, packets of any size."""
    out, counters = [], {}

    def packet(pid, start, data, field=b"", payload=True):
        counters[pid] = (counters.get(pid, 15) + payload) % 16
        room = 184 - len(data) if payload else 184
        if room or field:
            need = room - 1
            field = (field or (b"\x00" if need else b"")).ljust(need, b"\xff")
            field = bytes([len(field)]) + field
        kind = (0x20 if field else 0) | (0x10 if payload else 0)
        raw = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, kind | counters[pid]]) + field + (data if payload else b"")
        assert len(raw) == 188
        out.append(raw)

    def section(table, number, body):
        head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc3\x00\x00"
        crc = 0xFFFFFFFF
        for byte in head + body:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return head + body + crc.to_bytes(4, "big")

    def tables():
        pat = section(0, 9, b"\x00\x00\xe0\x10" + b"\x00\x01\xe1\x23" + b"\x00\x02\xe1\x24")
        packet(0, True, b"\x00" + pat + b"\xff" * (183 - len(pat)))
        for number, pid, stream in ((1, 0x123, 0x200), (2, 0x124, 0x201)):
            info = bytes([0x05, 250]) + bytes(250)
            pmt = section(2, number, (0xE000 | stream).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
                          + bytes([0x1B]) + (0xE000 | stream).to_bytes(2, "big") + b"\xf0\x03\x0a\x01x")
            raw = b"\x00" + pmt
            for at in range(0, len(raw), 184):
                packet(pid, at == 0, raw[at:at + 184].ljust(184, b"\xff"))

    tables()
    for i, (pid, pts, data) in enumerate(units):
        if i % tables_every == 0:
            tables()
        stamp = bytes([0x21 | (pts >> 29) & 14, (pts >> 22) & 255, (pts >> 14) & 254 | 1, (pts >> 7) & 255, (pts << 1) & 254 | 1])
        rest = b"\x80\x80\x07" + stamp + b"\xff\xff" + data
        pes = b"\x00\x00\x01\xe0" + (0 if unbounded else len(rest)).to_bytes(2, "big") + rest
        at = 0
        while at < len(pes):
            field = b"\x40" if at == 0 and i % 3 == 0 else b""
            most = 182 if field or adapt else 184
            size = min(len(pes) - at, rnd.randint(1, most) if adapt else most)
            packet(pid, at == 0, pes[at:at + size], field)
            if rnd.random() < 0.2:
                packet(pid, False, b"", b"\x00", payload=False)
            if rnd.random() < 0.2:
                out.append(out[-1])
            if rnd.random() < 0.1:
                packet(0x1FFF, False, bytes(184))
            at += size
    return b"".join(out)


@pytest.mark.parametrize("seed", range(12))
def test_streams_of_another_writer(seed):
    rnd = random.Random(seed)
    units = [(rnd.choice([0x200, 0x201]), rnd.randrange(1 << 33), rnd.randbytes(rnd.choice([1, 40, 170, 576, 3000]))) for _ in range(25)]
    read = mpegts.demux(other_stream(rnd, units, adapt=seed % 2 == 0, unbounded=seed % 3 == 0))
    assert read["streams"] == {0x200: 0x1B, 0x201: 0x1B} and read["gaps"] == 0 and read["complete"].all()
    ordered = [u for pid in (0x200, 0x201) for u in units if u[0] == pid]
    assert read["payload"] == b"".join(u[2] for u in ordered)
    assert read["pts"].tolist() == [u[1] for u in ordered] and read["pid"].tolist() == [u[0] for u in ordered]
    assert read["random"].tolist() == [i % 3 == 0 for pid in (0x200, 0x201) for i, u in enumerate(units) if u[0] == pid]


def test_stated_jumps_of_the_counter_are_legal():
    packets = packets_of(mpegts.mux(mpegts.pad(bytes(range(256)) * 9)))
    at = 2 + mpegts.PER_UNIT  # the start of the second elementary packet
    for i in range(at, len(packets)):
        raw = bytearray(packets[i])
        raw[3] = raw[3] & 0xF0 | (raw[3] + 5) & 15
        if i == at:
            raw[5] |= 0x80
        packets[i] = bytes(raw)
    read = mpegts.demux(b"".join(packets))
    assert read["payload"] == mpegts.pad(bytes(range(256)) * 9) and read["gaps"] == 0 and read["complete"].all()


def test_a_damaged_table_is_replaced_by_its_repetition():
    payload = mpegts.pad(b"some text")
    packets = packets_of(mpegts.mux(payload))
    bad = bytearray(packets[1])
    bad[12] ^= 4
    again = [packets[0][:3] + bytes([packets[0][3] + 1]) + packets[0][4:], packets[1][:3] + bytes([packets[1][3] + 1]) + packets[1][4:]]
    assert mpegts.demux(b"".join([packets[0], bytes(bad), *again, *packets[2:]]))["payload"] == payload


def test_media_are_stored(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    stored = mpegts.store(docs, path=str(tmp_path / "media"))
    files = list((tmp_path / "media").glob("*.parquet"))
    assert files and all(f.startswith("file:") and "/media/" in f for f in stored.inputFiles())
    kept = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(str(tmp_path / "media")).collect()}
    assert kept == {1: mpegts.mux(mpegts.pad(b"one")), 2: mpegts.mux(mpegts.pad(b""))}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["doc_id"]: r["media_sha256"] for r in mpegts.features(stored).collect()}
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in kept.items()}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_tables_and_damage():
    media = bytearray(mpegts.mux(mpegts.pad(b"x")))
    assert mpegts.demux(bytes(media))["streams"] == {256: 6}
    assert mpegts.section_crc(b"123456789") == 0x0376E6E7
    with pytest.raises(ValueError, match="sync"):
        mpegts.demux(b"\x00" + bytes(media[1:]))
    with pytest.raises(ValueError, match="whole"):
        mpegts.demux(bytes(media[:-1]))
    media[10] ^= 1
    with pytest.raises(ValueError, match="table"):
        mpegts.demux(bytes(media))
    with pytest.raises(ValueError):
        mpegts.mux(b"")


def test_awkward(awkward, empty):
    docs, rows = awkward.collect(), mpegts.features(mpegts.store(awkward)).collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), mpegts.pad((r["text"] or "").encode())) for r in docs), key=str)
    got = sorted(rows, key=lambda r: str((r["doc_id"], r["n_bytes"], "")))
    assert sorted((str(i), n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for i, n, p in want) == sorted(
        (str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got)
    same = [r for r in rows if r["doc_id"] in (0, 1)]
    assert same[0]["media_sha256"] == same[1]["media_sha256"] and same[0]["feature"] == same[1]["feature"]
    assert mpegts.features(mpegts.store(empty)).count() == 0
