"""MPEG transport streams: program tables, continuity counters, elementary packets, timestamps.

``mux`` stores a payload as a single-program stream (ISO/IEC 13818-1): a program association
table, a program map table, then one PES packet per ``UNIT`` payload bytes on one elementary
PID, each with a PTS; every ``RANDOM_EVERY``-th one carries the random-access flag. ``demux``
parses transport streams back, its own or others: it finds the program maps through the
association table (sections may span packets and repeat), follows the elementary PIDs that they
list, drops duplicate packets, checks continuity counters, reassembles PES packets and records
PTS and random-access points. A lost packet ends the PES packet that it was part of, which is
reported as incomplete and keeps the bytes before the loss. ``store`` writes the streams to
Parquet files; ``features`` reads them back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.storage import arrow_batches, materialize, shared_path

# Fixed values of the transport stream format.
PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_STREAM, PRIVATE_TYPE, PADDING_STREAM = 0xBD, 0x06, 0xBE
#: Stream ids whose packets have no optional header.
PLAIN_STREAMS = [0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF]
#: Payload is padded with bytes 255 to a positive multiple of this.
UNIT = 576
#: Ticks of the 90 kHz clock between elementary packets.
TICKS = 3600
RANDOM_EVERY = 16
#: Texts of one Arrow batch are worked on in runs of about this many bytes.
OUTPUT_BYTES = 4 << 20
#: Elementary packets that are written at a time.
UNITS = 4096

PES_HEADER = 14
PER_UNIT = -(-(PES_HEADER + UNIT) // 182)  # 182: 184 less the two bytes of an adaptation field


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        table = ((table << np.uint64(1)) ^ np.where(table & np.uint64(1 << 31), np.uint64(0x04C11DB7), np.uint64(0))
                 ) & np.uint64(0xFFFFFFFF)
    return table


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables: most significant bit first, not inverted."""
    crc, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ int(table[(crc >> 24) ^ byte])
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 0xFF]) + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def program_tables() -> bytes:
    """The two packets that open every stream."""
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(0x02, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return b"".join(
        (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, bytes([STUFFING]))
        for pid, section in ((PAT_PID, pat), (PMT_PID, pmt)))


def pad(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of ``UNIT``."""
    return data + bytes([STUFFING]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose length is a positive multiple of ``UNIT``, written in runs of units."""
    units = len(payload) // UNIT
    if units < 1 or len(payload) % UNIT:
        raise ValueError(f"the payload isn't a positive multiple of {UNIT} bytes")
    head, data = program_tables(), np.frombuffer(payload, np.uint8).reshape(units, UNIT)
    media = np.empty(len(head) + units * PER_UNIT * PACKET, np.uint8)
    media[:len(head)] = np.frombuffer(head, np.uint8)
    out = media[len(head):].reshape(units, PER_UNIT, PACKET)
    for at in range(0, units, UNITS):
        _mux_units(data[at:at + UNITS], out[at:at + UNITS], at)
    return media.tobytes()


def _mux_units(data: np.ndarray, out: np.ndarray, first: int) -> None:
    units = len(data)
    pts = np.arange(first, first + units, dtype=np.uint64) * TICKS & np.uint64((1 << 33) - 1)
    pes = np.empty((units, PES_HEADER + UNIT), np.uint8)
    pes[:, :9] = [0, 0, 1, PRIVATE_STREAM, (UNIT + 8) >> 8, (UNIT + 8) & 0xFF, 0x84, 0x80, 5]
    for at, (shift, mask, mark, left) in enumerate(((30, 7, 0x21, 1), (22, 255, 0, 0), (15, 127, 1, 1), (7, 255, 0, 0), (0, 127, 1, 1))):
        pes[:, 9 + at] = ((pts >> np.uint64(shift)) & np.uint64(mask)) << np.uint64(left) | np.uint64(mark)
    pes[:, PES_HEADER:] = data
    out[:] = STUFFING
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
    out[:, 0, 1] |= 0x40
    counter = (first * PER_UNIT + np.arange(units * PER_UNIT)).reshape(units, PER_UNIT) & 15
    out[:, :, 3] = 0x30 | counter
    taken = 0
    for n in range(PER_UNIT):
        size = min(182, PES_HEADER + UNIT - taken)
        out[:, n, 4] = 183 - size
        out[:, n, 5] = 0
        out[:, n, PACKET - size:] = pes[:, taken:taken + size]
        taken += size
    out[-first % RANDOM_EVERY::RANDOM_EVERY, 0, 5] = 0x40


def _sections(packets: np.ndarray, table: int) -> Iterator[bytes]:
    """Whole, undamaged, current sections of a table from the packets of its PID; a section may span packets."""
    held, last = None, -1
    for packet in packets:
        raw = packet.tobytes()
        if raw[1] & 0x80 or not raw[3] & 0x10:
            continue
        if raw[3] & 15 == last and held is not None:
            continue  # a duplicate
        lost, last = last >= 0 and raw[3] & 15 != (last + 1) & 15, raw[3] & 15
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        if lost:
            held = None
        parts = [(held, raw[at:])] if held is not None and not raw[1] & 0x40 else []
        if raw[1] & 0x40 and at < PACKET:
            start = at + 1 + raw[at]
            parts = [(held, raw[at + 1:start])] if held else []
            parts.append((b"", raw[start:]))
        for before, more in parts:
            held = None if before is None else before + more
            while held and held[0] != STUFFING and len(held) >= 3 and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
                section, held = held[:size], held[size:]
                if section[0] == table and size >= 12 and section[5] & 1 and not section_crc(section):
                    yield section
            if held and held[0] == STUFFING:
                held = None


def _table(packets: np.ndarray, pids: np.ndarray, pid: int, table: int, number: int | None) -> list[bytes]:
    """The bodies of all sections of the first whole table on a PID (of a program, if given)."""
    found: dict[int, bytes] = {}
    for section in _sections(packets[pids == pid], table):
        if number is None or int.from_bytes(section[3:5], "big") == number:
            found.setdefault(section[6], section[8:-4])
            if len(found) > section[7]:
                return [found[n] for n in sorted(found)]
    raise ValueError(f"no undamaged table on PID {pid}")


def _streams(packets: np.ndarray, pids: np.ndarray) -> dict[int, int]:
    """Elementary PIDs and their stream types, by the association and map tables of the stream."""
    streams: dict[int, int] = {}
    for pat in _table(packets, pids, PAT_PID, 0x00, None):
        for at in range(0, len(pat) - 3, 4):
            number = int.from_bytes(pat[at:at + 2], "big")
            if not number:
                continue
            for pmt in _table(packets, pids, int.from_bytes(pat[at + 2:at + 4], "big") & 0x1FFF, 0x02, number):
                at_stream = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
                while at_stream + 5 <= len(pmt):
                    streams[int.from_bytes(pmt[at_stream + 1:at_stream + 3], "big") & 0x1FFF] = pmt[at_stream]
                    at_stream += 5 + (int.from_bytes(pmt[at_stream + 3:at_stream + 5], "big") & 0x0FFF)
    return streams


def _packets_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Packets with a payload, where it begins, whether one was lost before each, and how many duplicates were dropped."""
    own = own[((own[:, 3] & 0x10) > 0) & ((own[:, 1] & 0x80) == 0)]
    adapted = (own[:, 3] & 0x20) > 0
    begin = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
    own, begin = own[begin < PACKET], begin[begin < PACKET]
    counter = (own[:, 3] & 15).astype(np.int32)
    # A packet may be sent twice: same counter and payload; only its adaptation field may differ.
    again = np.flatnonzero(counter[1:] == counter[:-1]) + 1
    inside = (np.arange(PACKET) < 4) | (np.arange(PACKET) >= begin[again, None])
    again = again[((own[again] == own[again - 1]) | ~inside).all(1)]
    kept = np.ones(len(own), bool)
    kept[again] = False
    own, begin, counter = own[kept], begin[kept], counter[kept]
    told = ((own[:, 3] & 0x20) > 0) & (own[:, 4] > 0) & ((own[:, 5] & 0x80) > 0)  # the stream itself states a jump of the counter
    lost = np.zeros(len(own), bool)
    lost[1:] = ((counter[1:] - counter[:-1]) % 16 != 1) & ~told[1:]
    return own, begin, lost, len(again)


def demux(media: bytes) -> dict:
    """``payload``; per elementary packet ``pid``, ``pts`` (-1: none), ``random`` and ``complete``; ``gaps``,
    ``duplicates`` and ``streams``.

    An elementary packet is incomplete if a transport packet of it was lost, if it is shorter than it
    states, or if it has no valid header. Of an incomplete one, the payload has the bytes before the loss.
    """
    if not media or len(media) % PACKET:
        raise ValueError("the stream isn't whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet doesn't start with the sync byte")
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    streams, payload, found, gaps, duplicates = _streams(packets, pids), [], [], 0, 0
    for pid in streams:
        own, begin, lost, again = _packets_of(packets[pids == pid])
        gaps, duplicates = gaps + int(lost.sum()), duplicates + again
        starts = np.flatnonzero(own[:, 1] & 0x40)
        if not len(starts):
            continue
        body = own[np.arange(PACKET) >= begin[:, None]]
        cuts = np.concatenate(([0], np.cumsum(PACKET - begin)))
        # A packet ends where the next one starts, or at the first loss after its own start.
        following = np.append(starts[1:], len(own))
        losses = np.append(np.flatnonzero(lost), len(own))
        broken = losses[np.searchsorted(losses, starts, side="right")]
        torn = (broken < following) | ((broken == following) & (following < len(own)))
        at, ends = cuts[starts], cuts[np.minimum(following, broken)]
        head = np.zeros((len(starts), 14), np.int64)
        for i in range(14):
            inside = at + i < ends
            head[inside, i] = body[at[inside] + i]
        size = ends - at
        valid = (size >= 6) & (head[:, 0] == 0) & (head[:, 1] == 0) & (head[:, 2] == 1)
        plain = np.isin(head[:, 3], PLAIN_STREAMS)
        skip = np.where(plain, 6, 9 + head[:, 8])
        stated = head[:, 4] << 8 | head[:, 5]
        complete = valid & (skip <= size) & np.where(stated > 0, 6 + stated <= size, ~torn)
        ends = np.where(valid & (stated > 0), np.minimum(ends, at + 6 + stated), ends)
        timed = valid & ~plain & (head[:, 7] & 0x80 > 0) & (head[:, 8] >= 5) & (size >= 14)
        pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | (head[:, 11] >> 1) << 15 | head[:, 12] << 7 | head[:, 13] >> 1
        first = own[starts]
        random = ((first[:, 3] & 0x20) > 0) & (first[:, 4] > 0) & ((first[:, 5] & 0x40) > 0)
        found.append((np.full(len(starts), pid), np.where(timed, pts, -1), random, complete))
        view, holds = memoryview(body), valid & (head[:, 3] != PADDING_STREAM)
        payload += [view[b:e] for b, e in zip((at + skip)[holds].tolist(), ends[holds].tolist()) if b < e]
    kinds = (np.int64, np.int64, bool, bool)
    pid, pts, random, complete = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, k) for k in kinds)
    return {"payload": b"".join(payload), "pid": pid, "pts": pts, "random": random, "complete": complete,
            "gaps": gaps, "duplicates": duplicates, "streams": streams}


def describe(read: dict) -> str:
    """Program, clock and random-access figures as text."""
    pts, random = read["pts"], read["random"]
    timed = pts[pts >= 0]
    span = f"{timed.min()}-{timed.max()}" if len(timed) else "none"
    kinds = ",".join(f"{pid}:{kind}" for pid, kind in sorted(read["streams"].items()))
    broken = len(pts) - int(read["complete"].sum())
    return f"streams={kinds};pes={len(pts)};gaps={read['gaps']};incomplete={broken};pts={span};random={int(random.sum())}"


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of at most ``OUTPUT_BYTES`` of ``column`` or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > OUTPUT_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if len(sizes) > begin or not sizes:
        yield batch.slice(begin)


def store(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_bytes, media``: each whole text as a transport stream, written to Parquet files and read from them.

    Null texts count as empty. Every row gives one row; empty texts give one elementary packet of
    padding. The files stand under ``path``, or in the shared folder until the session ends.
    Other columns are ignored.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch, "data"):
                data = [x or b"" for x in run.column("data").to_pylist()]
                yield pa.record_batch([run.column("id"), pa.array([len(x) for x in data], pa.int64()),
                                       pa.array([mux(pad(x)) for x in data], pa.binary())],
                                      names=[key, "n_bytes", "media"])

    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    path = path or shared_path(spark, "media")
    ready = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data"))
    schema = f"`{key}` {kind}, n_bytes long, media binary"
    with arrow_batches(spark):
        ready.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def features(stored: DataFrame, *, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Read streams back: ``key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, pts array, random_access array``.

    ``tail_crc32`` is of the last 32 payload bytes; ``random_access`` has the times of the random-access points.
    ``feature`` counts streams, elementary packets, lost and incomplete ones. A stream without sync bytes or
    an undamaged program table stops the job; a null one isn't made by :func:`store`.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch, media):
                rows = []
                for data in run.column(media):
                    data = data.as_py()
                    read = demux(data)
                    payload = read["payload"]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                                 len(data), hashlib.sha256(data).hexdigest(), describe(read),
                                 read["pts"], read["pts"][read["random"]]))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                         pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = zip(*rows) if rows else ((),) * len(kinds)
                yield pa.record_batch([run.column(key), run.column("n_bytes"),
                                       *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
             "feature", "pts", "random_access"]
    kind = stored.schema[key].dataType.simpleString()
    with arrow_batches(stored.sparkSession):
        return materialize(stored.mapInArrow(
            decode, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
            "media_sha256 string, feature string, pts array<long>, random_access array<long>"), "features")
