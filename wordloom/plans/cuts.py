"""Where each segment's sound starts and ends: trims in silence, quiet seams elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import signal
from wordloom.operators.words import by_job
from wordloom.params import Params

#: A gap this much longer than both pads is trimmed.
SEAM_MARGIN = 0.10
#: How far a seam may reach into a neighbouring word: this share of it, and these seconds at most.
MOST_INTRUSION, MOST_INTRUSION_SECONDS = 0.5, 0.08


def intrusion(seconds):
    return F.least(F.lit(MOST_INTRUSION_SECONDS), seconds * MOST_INTRUSION)


def boundaries(segments: DataFrame, p: Params) -> DataFrame:
    """Segments with ``next_start``, ``gap``, the seam's ``low``, ``high`` and ``centre``, and ``regime``.

    regime: ``trim`` (enough silence), ``seam`` (search it), ``edge`` (overlap: cut there), ``last``.
    """
    w = by_job("seg_index")
    out = segments.withColumns({"next_start": F.lead("start").over(w), "next_seconds": F.lead("first_seconds").over(w)})
    out = out.withColumns({
        "gap": F.col("next_start") - F.col("end"),
        "low": F.col("end") - intrusion(F.col("last_seconds")),
        "high": F.col("next_start") + intrusion(F.col("next_seconds")),
        "centre": (F.col("end") + F.col("next_start")) / 2.0})
    regime = (F.when(F.col("next_start").isNull(), "last").when(F.col("gap") >= p.tail_pad + p.head_pad + SEAM_MARGIN, "trim")
              .when(F.col("high") <= F.col("low"), "edge").otherwise("seam"))
    return out.withColumn("regime", regime)


def totals(audio: DataFrame) -> DataFrame:
    """``job_id, total``: how many samples each job has."""
    return audio.groupBy("job_id").agg(F.sum(F.size("samples")).alias("total"))


def sample_spans(spans: DataFrame, audio: DataFrame, rate: int) -> DataFrame:
    """Spans with ``low`` and ``high`` inside the sound, and their first sample ``a`` and the one after the last, ``b``."""
    known = spans.join(totals(audio), "job_id")
    known = known.withColumns({"low": F.greatest(F.lit(0.0), "low"), "high": F.least(F.col("total") / rate, F.col("high"))})
    return known.withColumns({"a": (F.col("low") * rate).cast("long"), "b": (F.col("high") * rate).cast("long")})


def pieces(spans: DataFrame, audio: DataFrame, chunk: int) -> DataFrame:
    """A row for each chunk that a span's samples ``a`` up to ``b`` touch, with the chunk's ``samples``.

    A span names the chunks it touches, so the range join is an equi-join on the chunk's number.
    """
    touched = spans.filter("b > a").withColumn("chunk_no", F.explode(F.sequence(
        F.floor(F.col("a") / chunk).cast("int"), F.floor((F.col("b") - 1) / chunk).cast("int"))))
    return touched.join(audio, ["job_id", "chunk_no"])


def span_levels(spans: DataFrame, audio: DataFrame, rate: int, chunk: int, frame: int, hop: int) -> DataFrame:
    """``job_id, span, level``: a row for each frame of each span (``job_id, span, low, high``), frames counted from its first sample.

    Each chunk gives the frames that begin in it, seeing its successor's head; so spans of any length
    are never brought together. A span shorter than a frame is one frame. ``chunk`` holds a frame at least.
    """
    if chunk < frame:
        raise ValueError("a chunk must hold a frame")
    after = F.lead("samples").over(by_job("chunk_no"))
    longer = audio.withColumn("samples", F.concat("samples", F.coalesce(F.slice(after, 1, frame), F.array().cast("array<float>"))))
    found = pieces(sample_spans(spans, audio, rate), longer, chunk)
    begin, size = F.col("chunk_no").cast("long") * chunk, F.col("b") - F.col("a")
    first = F.greatest(F.lit(0), F.ceil((begin - F.col("a")) / hop)).cast("long")
    last = F.when(size < frame, F.lit(0)).otherwise(F.floor((F.col("b") - frame - F.col("a")) / hop)).cast("long")
    last = F.least(last, F.floor((begin + chunk - 1 - F.col("a")) / hop).cast("long"))
    numbers = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    at = lambda k: (F.col("a") + k * hop - begin + 1).cast("int")
    levels = F.transform(numbers, lambda k: signal.level(F.slice("samples", at(k), F.least(size, F.lit(frame)).cast("int"))))
    return found.select("job_id", "span", F.explode(levels).alias("level"))


def quiet_seams(bounds: DataFrame, audio: DataFrame, rate: int, chunk: int) -> DataFrame:
    """``job_id, seg_index, cut, level`` of each seam, searched in the sound around it.

    Seams are short: they span two words' edges and a gap that is too small to trim.
    """
    wanted = bounds.filter("regime = 'seam'").select("job_id", "seg_index", "low", "high", "centre")
    wanted = sample_spans(wanted, audio, rate)
    begin = F.col("chunk_no").cast("long") * chunk
    piece = F.slice("samples", F.greatest(F.lit(1), F.col("a") - begin + 1).cast("int"), F.least(F.lit(chunk), F.col("b") - F.greatest("a", begin)).cast("int"))
    heard = (pieces(wanted, audio, chunk).groupBy("job_id", "seg_index")
             .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", piece.alias("x")))), lambda c: c["x"])).alias("samples")))
    found = wanted.join(heard, ["job_id", "seg_index"], "left").withColumn("q", F.when(
        F.col("samples").isNotNull(), signal.quietest(F.col("samples"), rate, F.col("centre") - F.col("low"))))
    nowhere = F.when(F.col("high") <= F.col("low"), F.greatest(F.lit(0.0), F.least("low", "high"))).otherwise(F.col("low"))
    return found.select("job_id", "seg_index", F.coalesce(F.col("q.at") + F.col("low"), nowhere).alias("cut"),
                        F.coalesce("q.level", F.lit(float("inf"))).alias("level"))


def cuts(segments: DataFrame, p: Params, durations: DataFrame | None = None, seams: DataFrame | None = None, silence: float = signal.SILENCE) -> DataFrame:
    """Segments with ``src_in, src_out, hard_in, hard_out``.

    ``durations`` has ``job_id, media_end``; without it the segments carry ``media_end``. ``seams`` comes from :func:`quiet_seams`; without
    sound the seam is cut at its centre, softly. Neighbours share a seam's cut; a segment is
    never inverted.
    """
    bounds = boundaries(segments, p)
    if durations is not None:
        bounds = bounds.join(durations, "job_id")
    if seams is None:
        bounds = bounds.withColumns({"cut": F.greatest(F.lit(0.0), "centre"), "level": F.lit(0.0)})
    else:
        bounds = bounds.join(seams, ["job_id", "seg_index"], "left")
    edge = F.greatest(F.lit(0.0), "end")
    left = (F.when(F.col("regime") == "last", F.least("media_end", F.col("end") + p.tail_pad))
            .when(F.col("regime") == "trim", F.col("end") + p.tail_pad).when(F.col("regime") == "edge", edge).otherwise(F.col("cut")))
    right = (F.when(F.col("regime") == "trim", F.col("next_start") - p.head_pad).when(F.col("regime") == "edge", edge)
             .when(F.col("regime") == "seam", F.col("cut")))
    hard = (F.col("regime") == "edge") | (F.col("regime") == "seam") & (F.col("level") > F.lit(silence).cast("float").cast("double"))
    w = by_job("seg_index")
    out = bounds.withColumns({"src_out": left, "next_in": right, "hard_out": hard})
    out = out.withColumns({
        "src_in": F.coalesce(F.lag("next_in").over(w), F.greatest(F.lit(0.0), F.col("start") - p.head_pad)),
        "hard_in": F.coalesce(F.lag("hard_out").over(w), F.lit(False))})
    return (out.withColumn("src_out", F.greatest("src_out", "src_in"))
            .drop("next_in", "next_start", "next_seconds", "gap", "low", "high", "centre", "regime", "cut", "level"))


def previous_out(selected: DataFrame) -> DataFrame:
    """``prev_out``: the end of the segment before among those selected, null for the first."""
    return selected.withColumn("prev_out", F.lag("src_out").over(Window.partitionBy("job_id").orderBy("seg_index")))
