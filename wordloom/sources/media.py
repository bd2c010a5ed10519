"""Sources that need the network, a model or a codec are pluggable functions; these are their contracts.

``Probe`` gives a url's metadata, ``Fetcher`` its files, ``Decoder`` a file's sound, ``Recogniser`` its
timed chunks, ``Encoder`` a compressed file. All run inside ``mapInPandas``, so a real connector (a download tool, a
codec, a model) needs no change here.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Probe = Callable[[str], dict]
Recogniser = Callable[[str], list[dict]]
#: A url to the names and contents of what was downloaded.
Fetcher = Callable[[str], dict[str, bytes]]
#: A file's bytes and the rate wanted to mono float samples.
Decoder = Callable[[bytes, int], np.ndarray]
#: A job's chunks of samples, in order, and their rate to a file's bytes.
Encoder = Callable[[Iterator[np.ndarray], int], bytes]
# How a download's file is named, and what beside it isn't the media.
DOWNLOAD, NOT_MEDIA = "source.", (".wav", ".json")
LONGEST_SECONDS = 5400.0


def probe(urls: DataFrame, source: Probe) -> DataFrame:
    """``job_id, url, title, duration, error`` of each url; a failure is a row with its message."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for job, url in frame.itertuples(index=False):
                try:
                    meta = source(url)
                    rows.append((job, url, meta.get("title"), float(meta["duration"]) if meta.get("duration") is not None else None, None))
                except Exception as e:  # the error is the row's result
                    rows.append((job, url, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["job_id", "url", "title", "duration", "error"])

    return urls.select("job_id", "url").mapInPandas(run, "job_id long, url string, title string, duration double, error string")


def admitted(probed: DataFrame, longest: float = LONGEST_SECONDS) -> DataFrame:
    """Probed urls without error that aren't too long: rejected before anything is fetched."""
    return probed.filter(F.col("error").isNull() & (F.coalesce("duration", F.lit(0.0)) <= longest))


def fetch(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """``job_id, name, content, error`` of each downloaded file; a failure is a row with its message and no file."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for job, url in frame.itertuples(index=False):
                try:
                    rows = [(job, name, content, None) for name, content in fetcher(url).items()]
                except Exception as e:  # the error is the row's result
                    rows = [(job, None, None, str(e) or type(e).__name__)]
                yield pd.DataFrame(rows, columns=["job_id", "name", "content", "error"])

    return urls.select("job_id", "url").mapInPandas(run, "job_id long, name string, content binary, error string")


def first_media(files: DataFrame) -> DataFrame:
    """``job_id, name, content``: of each job's downloads, the first by name that is its media."""
    own = F.col("name").startswith(DOWNLOAD)
    for ending in NOT_MEDIA:
        own = own & ~F.col("name").endswith(ending)
    return (files.filter(own).groupBy("job_id").agg(F.min_by(F.struct("name", "content"), "name").alias("m"))
            .select("job_id", "m.name", "m.content"))


def decoded(files: DataFrame, decoder: Decoder, rate: int, chunk: int) -> DataFrame:
    """``job_id, chunk_no, samples`` of each file (``job_id, content``), ``chunk`` samples each but the last."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for job, content in zip(frame["job_id"], frame["content"]):
                x = np.asarray(decoder(content, rate), np.float32)
                for n in range(max(1, -(-len(x) // chunk))):
                    yield pd.DataFrame({"job_id": [job], "chunk_no": [n], "samples": [x[n * chunk:(n + 1) * chunk]]})

    return files.select("job_id", "content").mapInPandas(run, "job_id long, chunk_no int, samples array<float>")


def encoded(signals: DataFrame, encoder: Encoder, rate: int) -> DataFrame:
    """``job_id, content`` from ``job_id, chunk_no, samples``: the encoder takes a job's chunks one after another."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((job, samples) for frame in frames for job, samples in zip(frame["job_id"], frame["samples"]))
        for job, own in itertools.groupby(rows, key=lambda r: r[0]):
            yield pd.DataFrame({"job_id": [job], "content": [encoder((np.asarray(x, np.float32) for _, x in own), rate)]})

    ordered = signals.select("job_id", "chunk_no", "samples").repartition("job_id").sortWithinPartitions("job_id", "chunk_no")
    return ordered.mapInPandas(run, "job_id long, content binary")


def recognise(sources: DataFrame, recogniser: Recogniser) -> DataFrame:
    """Timed chunks of each source; one without any is an error, as nothing could follow."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for job, url in frame.itertuples(index=False):
                found = recogniser(url)
                if not found:
                    raise ValueError(f"no speech in {url}")
                yield pd.DataFrame([(job, i, c.get("text"), *(c.get("timestamp") or (None, None))) for i, c in enumerate(found)],
                                   columns=["job_id", "pos", "text", "start", "end"])

    return sources.select("job_id", "url").mapInPandas(run, "job_id long, pos int, text string, start double, end double")
