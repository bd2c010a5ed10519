"""WARC archives and their index: records written and read back, capture runs merged by a loser tree.

Records are written by Spark's text writer with the record separator as line separator, so
lost executors leave no half-written archives, and stand uncompressed, so that the index's
offset and length find each. Records are read back by Content-Length. Each archive yields a
locally sorted run of captures: rows of the run table in order, with their place. Runs are cut
at common key bounds; each range merges its slices of all runs, which arrive whole and in run
order, with a k-way loser tree: range after range, the result is the capture history in global
order of URL key and time.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.storage import HOT_KEYS, arrow_batches, join_small, materialize, shared_path

#: Payloads shorter than this are never deduplicated.
LEAST_REVISIT = 100
#: Digests of more rows than this, or than a 20,000th of the repeated rows, are joined by broadcast.
HOT_DIGEST = 1_000
#: An archive holds about this many bytes of payload at most, or one record.
ARCHIVE_BYTES = 64 << 20
#: Records of up to this size share archives; larger ones have archives of their own class, by powers of four.
CLASS_BYTES, CLASS_FACTOR = 64 << 10, 4
CAPTURES_PER_RANGE = 200_000
#: Captures that a run gives to the sample from which the key ranges are cut, for each range.
SAMPLED = 20
END = "\r\n"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"

INDEX = ("url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long, archive string, place long, offset long, length long")


def plan_records(pages: DataFrame, *, key: str = "page_id") -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_url`` of each row.

    Of equal payloads of at least 100 bytes, rows with the smallest key are responses and the
    others revisit it; shorter ones are all responses. A null html is an empty payload. A row
    whose key is null revisits a group's response, or is a response if all keys of its group
    are null. Rows that repeat the smallest key are all responses.

    Only digests that occur twice are joined. A digest that many rows share is broadcast (their
    number is bounded), the others too if they are few; else the rows are shuffled by digest once.
    """
    hashed = pages.select(F.col(key).cast("long").alias("page_id"), "url",
                          F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    hashed = (hashed.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
              .withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256)))
    repeated = materialize(hashed.filter(F.col("payload_bytes") >= LEAST_REVISIT)
                           .groupBy(F.unhex("payload_digest").alias("digest")).agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))).alias("first"),
                                F.count(F.lit(1)).alias("n"))
                           .filter("n > 1"), "repeated")
    least = max(HOT_DIGEST, (repeated.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot, rest = repeated.filter(F.col("n") > least).drop("n"), repeated.filter(F.col("n") <= least).drop("n")
    # Payloads that aren't deduplicated, and hot ones, get keys of their own in the second join: they match nothing and spread evenly.
    hashed = hashed.withColumn("digest", F.unhex("payload_digest"))
    known = hashed.join(F.broadcast(hot.withColumnRenamed("first", "hot_first")), "digest", "left")  # 20,000 digests at most
    alone = (F.col("payload_bytes") < LEAST_REVISIT) | F.col("hot_first").isNotNull()
    known = known.withColumn("digest", F.when(alone, F.concat(F.lit("-").cast("binary"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))).otherwise(F.col("digest")))
    found = join_small(known, rest, ["digest"], "left").withColumn("first", F.coalesce("first", "hot_first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return (found.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("first.page_id"))).withColumn("refers_url", F.when(revisit, F.col("first.url")))
            .drop("first", "hot_first", "digest"))


def _record(captured_at: Column) -> Column:
    """A record as text, without the separator that follows it."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    def name(page: Column, url: Column) -> Column:
        """Page, and a hash of what else tells its records apart: only rows alike in all three share a name."""
        rest = F.substring(F.sha2(F.concat_ws("\n", F.coalesce(url, F.lit("")), F.col("payload_digest")).cast("binary"), 256), 1, 16)
        return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), rest, F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                     F.col("payload_bytes").cast("string"), F.lit(END + END),
                     F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name(F.col("page_id"), F.col("url"))),
        line("WARC-Date", captured_at), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, name(F.col("refers_to"), F.col("refers_url")))),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)


def write_archives(records: DataFrame, path: str, *, captured_at: Column | None = None) -> None:
    """Write records to archives of 64 MB at most, or of one record; captures are dated from the page id by default.

    Records are written by size class, each with the number of records that fills an archive, so
    that no archive outgrows the bound whatever the pages' sizes.
    """
    if captured_at is None:
        seconds = F.coalesce(F.pmod(F.col("page_id"), F.lit(86_400 * 365)), F.lit(0)) + 1_704_067_200
        captured_at = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stored = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    most = records.agg(F.max("payload_bytes")).first()[0] or 0  # without the join of the repeated digests
    low, high, mode = -1, CLASS_BYTES, "errorifexists"
    while low < most or low < 0:
        (records.filter((stored > low) & (stored <= high)).select(_record(captured_at).alias("value")).write.mode(mode)
         .option("lineSep", END + END).option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // high)).text(path))
        low, high, mode = high, high * CLASS_FACTOR, "append"


def url_key(url: str | None) -> str:
    """Reversed host labels, ``)``, path and query: captures of one site sort together."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (rest[cut:].lower() or "/")


def parse_records(data: bytes | memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, headers and block of each record of an uncompressed archive; blocks aren't copied."""
    view, at = memoryview(data), 0
    whole = view.obj if isinstance(view.obj, bytes) and len(view.obj) == len(view) else None
    while at < len(view):
        stop, size = -1, 1 << 12
        while stop < 0 and size <= 2 * max(len(view) - at, 1 << 12):
            head = bytes(view[at:at + size]) if whole is None else whole[at:at + size]
            stop, size = head.find(b"\r\n\r\n"), size * 8
        if not head.startswith(b"WARC/") or stop < 0:
            raise ValueError(f"no record at byte {at}")
        lines = head[:stop].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        begin = at + stop + 4
        end = begin + int(headers["content-length"])
        if end > len(view) or view[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, end - at, headers, view[begin:end]
        at = end + 4


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix(f"<{ID_PREFIX}").split(":")[0]
    return int(digits) if digits else None


def _capture(archive: str, at: int, length: int, headers: dict[str, str], block: memoryview) -> list:
    """One row of the index, its place in the run still to be given; the payload of a response is verified."""
    cut = bytes(block[:4096]).find(b"\r\n\r\n")
    head, payload = bytes(block[:cut]), block[cut + 4:]
    stated = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if (len(payload), found) != (stated, digest):
            raise ValueError(f"{archive}: payload at byte {at} differs from its header")
    return [url_key(headers.get("warc-target-uri")), headers["warc-date"], _page(headers["warc-record-id"]),
            stated, digest, kind, _page(headers.get("warc-refers-to")), archive, 0, at, length]


def _order(row: list | tuple) -> tuple:
    """Captures in global order: URL key, time, page, then archive and offset."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[7], row[9]


_ARROW = {"string": pa.string(), "long": pa.int64()}
_FIELDS = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in INDEX.split(", "))])


def _batch(rows: list, number: int | None = None) -> pa.RecordBatch:
    """Rows of the index as a batch, with the range's number before them if given."""
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ((),) * len(_FIELDS), _FIELDS)]
    if number is None:
        return pa.record_batch(columns, schema=_FIELDS)
    return pa.record_batch([pa.array([number] * len(rows), pa.int32()), *columns], names=["range", *_FIELDS.names])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive under ``path``: its run, sorted, each capture with its place. Payloads are verified."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                archive = name.as_py().rsplit("/", 1)[-1]
                run = sorted((_capture(archive, *x) for x in parse_records(memoryview(content.as_buffer()))), key=_order)
                for place, row in enumerate(run):
                    row[8] = place
                for at in range(0, len(run), 10_000):
                    yield _batch(run[at:at + 10_000])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(parse, INDEX)


class LoserTree:
    """K-way merge of sorted iterators: each inner node keeps the loser of its match, the root the winner.

    The next item takes log2(k) comparisons on the path of the last winner.
    """

    def __init__(self, runs: list[Iterator], key) -> None:
        self.runs, self.key, self.k = [iter(x) for x in runs], key, len(runs)
        self.heads: list[tuple | None] = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int) -> tuple | None:
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _play(self, i: int) -> None:
        """Carry contestant i from its leaf to the root."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to arrive waits
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head[2]
            i = self.winner
            self.heads[i] = self._next(i)
            self._play(i)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order, with ``range``: ranges in order, each merged from its slices of the runs.

    ``runs`` must be materialised. The bounds between ranges come from a sample of every run, spread
    evenly over it, so a range holds about 200,000 captures, whatever the number of runs; equal
    keys can cross ranges because times and page ids are part of the order. A range's slices are
    brought in run order, each still sorted, and enter the loser tree as they are.
    """
    ranges = max(-(-runs.count() // CAPTURES_PER_RANGE), 1)
    bounds: list[tuple] = []
    if ranges > 1:
        step = F.greatest(F.lit(1), F.floor(F.lit(CAPTURES_PER_RANGE / SAMPLED))).cast("long")
        some = runs.filter(F.pmod(F.col("place") + F.xxhash64("archive"), step) == 0).select(*_FIELDS.names).collect()
        some = sorted((tuple(r) for r in some), key=_order)  # about SAMPLED for each range
        bounds = [_order(some[i * len(some) // ranges]) for i in range(1, ranges)] if some else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            places = pa.array([bisect.bisect_right(bounds, _order(r)) for r in rows], pa.int32())
            yield pa.record_batch([places, *batch.columns], names=["range", *batch.schema.names])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[tuple]]]]:
        """Each range with its runs' slices; rows come by range, archive and place."""
        held, last = [], (None, None)
        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and at != last[0]:
                    yield last[0], held
                    held = []
                if not held or row[7] != last[1]:
                    held.append([])
                held[-1].append(tuple(row))
                last = at, row[7]
        if held:
            yield last[0], held

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in slices(batches):
            chunk: list[tuple] = []
            for row in LoserTree([iter(x) for x in own], _order):
                chunk.append(row)
                if len(chunk) == 10_000:
                    yield _batch(chunk, number)
                    chunk = []
            yield _batch(chunk, number)

    dealt = runs.mapInArrow(cut, f"range int, {INDEX}")
    return (dealt.repartitionByRange(ranges, "range").sortWithinPartitions("range", "archive", "place")
            .mapInArrow(merge, f"range int, {INDEX}"))


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their index: one row per page, in capture order.

    The result is sorted by its partitions and has each capture's ``range``. An empty table writes no records and
    gives an empty index. Extra columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(plan_records(pages), path)
    with arrow_batches(spark):  # an archive is a batch of its own
        captures = materialize(read_runs(spark, path), "captures")
    return merge_runs(captures)
