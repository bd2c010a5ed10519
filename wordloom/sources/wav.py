"""WAV files in and out, as rows: 16-bit PCM through the standard library."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The greatest 16-bit sample stands for 1.
FULL_SCALE = 32767
HEADER = 44


def decode(data: bytes, rate: int | None = None) -> tuple[int, np.ndarray]:
    """Sample rate and mono float samples; several channels are averaged. Another rate than ``rate`` is an error."""
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("only 16-bit samples are read")
        if rate is not None and f.getframerate() != rate:
            raise ValueError(f"sample rate {f.getframerate()} instead of {rate}")
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32) / np.float32(FULL_SCALE)
        return f.getframerate(), x.reshape(-1, f.getnchannels()).mean(1, dtype=np.float32)


def encode(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1.0, 1.0) * FULL_SCALE).round().astype("<i2").tobytes())
    return out.getvalue()


def read_chunks(spark: SparkSession, path: str, chunk: int, rate: int | None = None) -> DataFrame:
    """``path, rate, chunk_no, samples`` of every WAV file: chunks of ``chunk`` samples, so long files stay in small rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                own, x = decode(content, rate)
                for n in range(max(1, -(-len(x) // chunk))):
                    yield pd.DataFrame({"path": [name], "rate": [own], "chunk_no": [n], "samples": [x[n * chunk:(n + 1) * chunk]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, rate int, chunk_no int, samples array<float>")


def seconds_of(data: bytes) -> float:
    """How long a WAV file lasts, from its header."""
    with wave.open(io.BytesIO(data)) as f:
        return f.getnframes() / f.getframerate()


def probed(spark: SparkSession, path: str) -> DataFrame:
    """``path, seconds`` of WAV files, from their headers: no sample is decoded."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "seconds": [seconds_of(x) for x in frame["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, seconds double")


def durations(chunks: DataFrame) -> DataFrame:
    """``path, seconds`` of files read in chunks."""
    return chunks.groupBy("path", "rate").agg((F.sum(F.size("samples")) / F.col("rate")).alias("seconds")).drop("rate")


def encode_rows(signals: DataFrame, rate: int) -> DataFrame:
    """``job_id, chunk_no, content`` from ``job_id, chunk_no, samples``: a job's contents, one after another, are its WAV file.

    The first has the header, which states the whole length; no row holds more than a chunk.
    """
    length = F.sum(F.size("samples")).over(Window.partitionBy("job_id"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for n, total, samples in zip(frame["chunk_no"], frame["total"], frame["samples"]):
                data = encode(np.asarray(samples, np.float32), rate)
                rows.append(header(int(total), rate) + data[HEADER:] if n == 0 else data[HEADER:])
            yield pd.DataFrame({"job_id": frame["job_id"], "chunk_no": frame["chunk_no"], "content": rows})

    return (signals.select("job_id", "chunk_no", "samples", length.alias("total"))
            .mapInPandas(run, "job_id long, chunk_no int, content binary"))


def header(samples: int, rate: int) -> bytes:
    """The head of a mono 16-bit WAV file of so many samples."""
    size = 2 * samples
    return (b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
            + b"data" + struct.pack("<I", size))
