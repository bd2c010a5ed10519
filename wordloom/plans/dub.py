"""From timed chunks to a validated edit list, over any number of jobs at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import signal
from wordloom.functions.text import RARE_PUNCTUATION
from wordloom.operators import batches, boundaries, cache, segments, words
from wordloom.params import Params
from wordloom.plans import cuts, edits
from wordloom.storage import materialize

Engine = Callable[[str, str, str], float]


@dataclass
class Audio:
    """Sound as ``job_id, chunk_no, samples`` with ``chunk`` samples each but the last."""

    chunks: DataFrame
    rate: int
    chunk: int

    def media_ends(self) -> DataFrame:
        return self.chunks.groupBy("job_id").agg((F.sum(F.size("samples")) / self.rate).alias("media_end"))

    def content(self, spans: DataFrame) -> DataFrame:
        """``job_id, span, loud`` of spans (``job_id, span, low, high``): whether a tenth of a span's frames or more is to be heard.

        A span without samples isn't loud.
        """
        size, hop = (signal.frame_size(self.rate, ms) for ms in signal.COARSE)
        levels = cuts.span_levels(spans, self.chunks, self.rate, self.chunk, size, hop)
        loud = F.percentile(F.col("level").cast("double"), F.lit(signal.CONTENT_SHARE)) > signal.SILENCE
        return (spans.select("job_id", "span").join(levels.groupBy("job_id", "span").agg(loud.alias("loud")), ["job_id", "span"], "left")
                .withColumn("loud", F.coalesce("loud", F.lit(False))))


def run_segments(chunks: DataFrame, p: Params, lang: str = "en", separator: str = " ", *, detector: boundaries.Detector | None = None,
                 arbiter: batches.Completer | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments of timed chunks, and warnings.

    A detector gives textual probabilities; an arbiter judges ambiguous boundaries of sentences (chunks of
    a number of words have none).
    """
    spoken = words.collect_words(chunks)
    jobs = chunks.select("job_id").distinct() if lang in RARE_PUNCTUATION and detector is None else chunks.select("job_id").limit(0)
    warnings = jobs.select("job_id", F.lit("segment").alias("stage"), F.lit("No boundary model; sentences are split mainly on pauses.").alias("message"),
                           F.lit(None).cast("int").alias("seg_index"))
    if detector is not None:
        spoken, failed = boundaries.detected(materialize(spoken, "words"), detector, separator)
        warnings = warnings.unionByName(failed)
    scored = boundaries.score_boundaries(spoken, p, lang=F.lit(lang), probability=None if detector is None else "probability")
    if p.segmentation_mode == "sentence":
        scored = boundaries.arbitrate(scored, arbiter, p, F.lit(lang), separator)
    return segments.segment(scored, p, separator), warnings


def dub(chunks: DataFrame, audio: Audio, p: Params, completer: batches.Completer, engine: Engine, *, lang: str = "en",
        known_clips: DataFrame | None = None, detector: boundaries.Detector | None = None) -> dict[str, DataFrame]:
    """``segments``, ``clips``, ``stats``, ``problems``, ``warnings`` and new ``cache`` rows.

    The completer translates and, where the knob says so, arbitrates. Stages that call a model are
    written to the shared folder, so nothing asks it twice.
    """
    spark = chunks.sparkSession
    cut, unsure = run_segments(chunks, p, lang, detector=detector, arbiter=completer)
    told, failures = batches.translate(materialize(cut, "segments"), completer, p.target_lang)
    told = materialize(told, "translated")
    known = known_clips if known_clips is not None else spark.createDataFrame([], "text_sha string, path string, duration double")
    spoken, made = cache.voiced(told, known, engine, p.target_lang, p.voice)
    spoken = materialize(spoken, "voiced")
    rows = plan(spoken, audio, p)
    part_rows = rows.pop("parts")
    return rows | {"stats": edits.plan_stats(part_rows), "problems": edits.violations(rows["clips"]),
                   "warnings": unsure.unionByName(failures), "cache": made}


def plan(spoken: DataFrame, audio: Audio, p: Params, selected: DataFrame | None = None) -> dict[str, DataFrame]:
    """``segments`` with their cuts, ``parts`` and ``clips`` of segments that have their voices; of those ``selected`` only."""
    seams = cuts.quiet_seams(cuts.boundaries(spoken, p), audio.chunks, audio.rate, audio.chunk)
    trimmed = materialize(cuts.cuts(spoken, p, audio.media_ends(), seams), "cuts")
    bridges, outros = _spans(trimmed, p)
    with_sound = (trimmed.join(audio.content(bridges).select("job_id", F.col("span").alias("seg_index"), F.col("loud").alias("loud_before")), ["job_id", "seg_index"], "left")
                  .join(audio.content(outros).select("job_id", F.col("span").alias("seg_index"), F.col("loud").alias("loud_after")), ["job_id", "seg_index"], "left"))
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    part_rows = edits.parts(with_sound, p, keep_bridge=said("loud_before"), keep_outro=said("loud_after"), selected=selected)
    return {"segments": trimmed, "parts": part_rows, "clips": edits.in_order(part_rows)}


def _spans(trimmed: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """The long gaps before segments, and what is left after the last ones."""
    before = cuts.previous_out(trimmed)
    start: Column = F.coalesce("prev_out", F.lit(0.0))
    bridges = before.filter(F.col("src_in") - start > p.max_source_gap).select(
        "job_id", F.col("seg_index").alias("span"), start.alias("low"), F.col("src_in").alias("high"))
    last = trimmed.groupBy("job_id").agg(F.max_by(F.struct("seg_index", "src_out", "media_end"), "seg_index").alias("l")).select("job_id", "l.*")
    outros = last.filter(F.col("media_end") - F.col("src_out") > edits.LEAST_OUTRO).select(
        "job_id", F.col("seg_index").alias("span"), F.col("src_out").alias("low"), F.col("media_end").alias("high"))
    return bridges, outros
