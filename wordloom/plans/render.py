"""Rendering: clips become the samples of each job, chunk by chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import signal
from wordloom.functions.text import tempo_chain
from wordloom.plans.cuts import pieces, sample_spans, span_levels, totals
from wordloom.plans.edits import sample_places

#: A pluggable change of speed without change of pitch: samples, rate and speed to samples.
Stretch = Callable[[np.ndarray, int, float], np.ndarray]
#: Speeds this near to 1 leave the samples alone.
SAME_SPEED = 1e-3
#: Seconds of the windows that the default stretch adds up, and how far it looks for the best fit.
GRAIN, SEEK = 0.04, 0.01


def overlap_add(x: np.ndarray, rate: int, speed: float) -> np.ndarray:
    """The default stretch: windows taken at one pace and laid out at another, each moved to where it continues the last best.

    Speeds outside a half to two are done in several steps.
    """
    for factor in tempo_chain(speed):
        x = _overlap_add(np.asarray(x, np.float32), rate, factor)
    return x


def _overlap_add(x: np.ndarray, rate: int, speed: float) -> np.ndarray:
    grain, seek, want = max(8, int(rate * GRAIN) // 2 * 2), int(rate * SEEK), int(round(len(x) / speed))
    if abs(speed - 1.0) < SAME_SPEED or len(x) < 2 * grain:
        at = np.minimum(np.arange(want) * speed, len(x) - 1) if len(x) else np.zeros(0)
        return x if abs(speed - 1.0) < SAME_SPEED else np.interp(at, np.arange(len(x)), x).astype(np.float32) if len(x) else x
    hop, window = grain // 2, np.hanning(grain + 1)[:grain]
    padded = np.concatenate([np.zeros(seek), x, np.zeros(grain + 2 * seek)])
    out, weight = np.zeros(want + 2 * grain), np.full(want + 2 * grain, 1e-9)
    last = None
    for place in range(0, want, hop):
        ideal = int(place * speed) + seek
        if last is not None:
            follows = padded[last + hop:last + hop + grain]
            near = np.lib.stride_tricks.sliding_window_view(padded[max(0, ideal - seek):ideal + seek + grain], grain)
            if len(follows) == grain and len(near):
                ideal = max(0, ideal - seek) + int((near @ follows).argmax())
        part = padded[ideal:ideal + grain]
        out[place:place + len(part)] += part * window[:len(part)]
        weight[place:place + len(part)] += window[:len(part)]
        last = ideal
    return (out / np.maximum(weight, 1e-3))[:want].astype(np.float32)


def stretched(voices: DataFrame, rate: int, speed: float, stretch: Stretch = overlap_add) -> DataFrame:
    """``path, voice`` at another speed; as they are at speed 1."""
    if abs(speed - 1.0) < SAME_SPEED:
        return voices

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(voice=[None if x is None else stretch(np.asarray(x, np.float32), rate, speed) for x in frame["voice"]])

    return voices.mapInPandas(run, voices.schema)


def source_loudness(audio: DataFrame, rate: int, chunk: int) -> DataFrame:
    """``job_id, loudness`` of each job's whole sound, from the levels of its chunks."""
    size, hop = (signal.frame_size(rate, ms) for ms in signal.COARSE)
    whole = totals(audio).select("job_id", F.lit(0).alias("span"), F.lit(0.0).alias("low"), (F.col("total") / rate + 1).alias("high"))
    levels = span_levels(whole, audio, rate, chunk, size, hop).withColumn("level", F.col("level").cast("double"))
    loud = F.when(F.col("level") > signal.as_float(signal.SILENCE).cast("double"), F.col("level"))
    share = F.lit(signal.LOUDNESS_SHARE)
    return levels.groupBy("job_id").agg(F.coalesce(F.percentile(loud, share), F.percentile("level", share)).alias("loudness"))


def measured_voices(voices: DataFrame, rate: int) -> DataFrame:
    """``path, voice, own``: voices and how loud they are. A column ``rate`` must agree with ``rate``."""
    if "rate" in voices.columns:
        wrong = F.raise_error(F.concat(F.col("path"), F.lit(": sample rate "), F.col("rate").cast("string"), F.lit(f" instead of {rate}")))
        voices = voices.withColumn("path", F.when(F.col("rate") == rate, F.col("path")).otherwise(wrong.cast("string")))
    return voices.select("path", "voice", signal.loudness_of(F.col("voice"), rate).alias("own"))


def clip_samples(clip_rows: DataFrame, audio: DataFrame, voices: DataFrame, rate: int, chunk: int, *, match_loudness: bool = True,
                 speed: float = 1.0, stretch: Stretch = overlap_add) -> DataFrame:
    """``job_id, clip_index, first_sample, samples``: the pieces of each clip that sound, where they begin in the job.

    ``voices`` has ``path, voice`` and maybe ``rate``. Translations are matched to the loudness of the job's whole
    source, then brought to ``speed`` and cut to their clip's rounded length; every clip is faded. A source
    clip comes in as many pieces as it touches chunks; silence, and what a voice lacks, has none.
    """
    placed = sample_places(clip_rows, rate)
    ramps = {c: F.floor(F.col(c) * rate).cast("long").alias(f"{c}_n") for c in ("fade_in", "fade_out")}
    clips = placed.select("job_id", "clip_index", "kind", "path", "first_sample", "n_samples", "src_start", "src_end", *ramps.values())
    source = sample_spans(clips.filter("kind = 'source'").withColumnsRenamed({"src_start": "low", "src_end": "high"}), audio, rate)
    source = source.withColumn("b", F.least(F.col("a") + F.col("n_samples"), F.col("total")))
    begin = F.col("chunk_no").cast("long") * chunk
    skip = F.greatest(F.lit(0), F.col("a") - begin)
    heard = pieces(source, audio, chunk).select(
        "job_id", "clip_index", "first_sample", "n_samples", "fade_in_n", "fade_out_n", (begin + skip - F.col("a")).alias("inside"),
        F.slice("samples", (skip + 1).cast("int"), F.greatest(F.lit(0), F.least(F.lit(chunk), F.col("b") - begin) - skip).cast("int")).alias("x"))
    spoken = clips.filter("kind = 'tts'").join(measured_voices(voices, rate), "path")
    if match_loudness:
        spoken = spoken.join(source_loudness(audio, rate, chunk), "job_id", "left")
        spoken = spoken.withColumn("voice", signal.matched(F.col("voice"), F.col("own"), F.coalesce("loudness", F.lit(0.0))))
    spoken = stretched(spoken, rate, speed, stretch).select(
        "job_id", "clip_index", "first_sample", "n_samples", "fade_in_n", "fade_out_n", F.lit(0).cast("long").alias("inside"),
        F.slice("voice", 1, F.col("n_samples").cast("int")).alias("x"))
    shaped = F.transform("x", lambda x, i: signal.as_float(x * signal.ramp(F.col("inside") + i, F.col("n_samples"), F.col("fade_in_n"), F.col("fade_out_n"))))
    return heard.unionByName(spoken).select("job_id", "clip_index", (F.col("first_sample") + F.col("inside")).alias("first_sample"), shaped.alias("samples"))


def signals(sounding: DataFrame, clip_rows: DataFrame, rate: int, chunk: int) -> DataFrame:
    """``job_id, chunk_no, samples``: each job's sound in chunks, from the pieces of :func:`clip_samples` and zeros between them."""
    ends = sample_places(clip_rows, rate).groupBy("job_id").agg(F.sum("n_samples").alias("total")).filter("total > 0")
    every = ends.select("job_id", "total", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / chunk).cast("int") - 1)).alias("chunk_no"))
    some = sounding.filter(F.size("samples") > 0)
    last = F.col("first_sample") + F.size("samples") - 1
    some = some.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("first_sample") / chunk).cast("int"), F.floor(last / chunk).cast("int"))))
    begin = F.col("chunk_no").cast("long") * chunk
    skip = F.greatest(F.lit(0), begin - F.col("first_sample"))
    part = F.slice("samples", (skip + 1).cast("int"), F.least(F.lit(chunk), begin + chunk - F.col("first_sample") - skip).cast("int"))
    parts = (some.select("job_id", "chunk_no", F.struct((F.col("first_sample") + skip - begin).cast("int").alias("at"), part.alias("x")).alias("p"))
             .groupBy("job_id", "chunk_no").agg(F.array_sort(F.collect_list("p")).alias("parts")))
    zeros = lambda n: F.array_repeat(signal.as_float(0.0), F.greatest(F.lit(0), n).cast("int"))
    laid = F.aggregate("parts", F.array().cast("array<float>"), lambda s, p: F.concat(s, zeros(p["at"] - F.size(s)), p["x"]))
    size = F.least(F.lit(chunk), F.col("total") - begin)
    return (every.join(parts, ["job_id", "chunk_no"], "left")
            .select("job_id", "chunk_no", F.when(F.col("parts").isNull(), zeros(size)).otherwise(F.concat(laid, zeros(size - F.size(laid)))).alias("samples")))
