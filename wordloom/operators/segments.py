"""Segments: half-open word ranges that tile each job's words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import strip
from wordloom.operators.folds import segment_ranges
from wordloom.operators.words import by_job
from wordloom.params import Params

BOUNDARY = ["source", "score", "sat_prob", "pause_after", "has_terminal_punct"]


def _splits(score: Column, end: Column, after: Column, p: Params) -> Column:
    return (score >= p.sat_threshold) | after.isNull() | (after - end >= p.never_merge_across_gap)


def with_splits(candidates: DataFrame, p: Params) -> DataFrame:
    """Candidates with ``is_split``: over the threshold, before a long pause, or at the end."""
    after = F.lead("start").over(by_job("word_index"))
    return candidates.withColumn("is_split", _splits(F.col("score"), F.col("end"), after, p))


def _closing() -> Column:
    return F.struct(*[F.col(c) for c in BOUNDARY], (F.col("source") == "llm").alias("llm_reviewed"))


def _assembled(rows: DataFrame, p: Params, separator: str) -> DataFrame:
    """Segments from ``job_id, seg_index`` and ``w``, the ordered array of their words.

    A blank segment, or one with both few words and little time, is ``skip``; it keeps its
    sound and isn't translated. Ids derive from job and place, so reruns agree.
    """
    first, last = F.get("w", F.lit(0)), F.element_at("w", -1)
    rows = rows.select(
        "job_id", "seg_index", first["word_index"].alias("word_start"), (last["word_index"] + 1).alias("word_end"),
        strip(F.array_join("w.text", separator)).alias("text"), first["start"].alias("start"), last["end"].alias("end"),
        (first["end"] - first["start"]).alias("first_seconds"), (last["end"] - last["start"]).alias("last_seconds"),
        last["boundary"].alias("boundary"))
    count, seconds = F.col("word_end") - F.col("word_start"), F.col("end") - F.col("start")
    unusable = (F.col("text") == "") | (count < p.min_words) & (seconds < p.min_duration)
    name = F.substring(F.sha2(F.concat_ws("/", "job_id", "seg_index").cast("binary"), 256), 1, 8)
    return rows.withColumns({"id": name, "kind": F.when(unusable, "skip").otherwise("speech")})


def _jobs(candidates: DataFrame) -> DataFrame:
    """``job_id`` and ``words``, the ordered array of its words."""
    word = F.struct("word_index", "text", "start", "end", _closing().alias("boundary"))
    return candidates.groupBy("job_id").agg(F.array_sort(F.collect_list(word), lambda x, y: x["word_index"] - y["word_index"]).alias("words"))


def _cut(jobs: DataFrame, ends: Column, p: Params, separator: str) -> DataFrame:
    """Segments of :func:`_jobs` that end after so many words: the words are cut in place."""
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    parts = F.transform("ends", lambda e, i: F.struct(i.alias("seg_index"), F.slice("words", begin(i) + 1, e - begin(i)).alias("w")))
    return _assembled(jobs.withColumn("ends", ends).select("job_id", F.inline(parts)), p, separator)


def sentences(candidates: DataFrame, p: Params, separator: str = " ") -> DataFrame:
    """Segments by scores and pauses alone, where :func:`with_splits` has splits.

    Words are grouped once, by job: segments are too many and too small to be groups of their own.
    """
    def close(w: Column, i: Column) -> Column:
        return F.when(_splits(w["boundary"]["score"], w["end"], F.get("words", i + 1)["start"], p), i + 1)

    return _cut(_jobs(candidates), F.filter(F.transform("words", close), lambda e: e.isNotNull()), p, separator)


def segment(candidates: DataFrame, p: Params, separator: str = " ") -> DataFrame:
    """Segments under all constraints: short ranges merged, long ones divided.

    What a range absorbs depends on what it has absorbed already, so ranges are folded over a
    job's words: times and scores go in as arrays, range ends come out, and the words are cut
    by them in place. Nothing joins and rows shuffle once, by job.
    """
    def fold(start: pd.Series, end: pd.Series, score: pd.Series) -> pd.Series:
        return pd.Series([[b for _, b in segment_ranges(*(np.asarray(x, float) for x in job), p)] for job in zip(start, end, score)], dtype=object)

    ends = F.pandas_udf(fold, "array<int>")(F.col("words.start"), F.col("words.end"), F.col("words.boundary.score"))
    return _cut(_jobs(candidates), ends, p, separator)


def translatable(segments: DataFrame) -> DataFrame:
    return segments.filter((F.col("kind") == "speech") & (strip(F.col("text")) != ""))


def summary(segments: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """``job_id, segments, speech, warnings`` per job."""
    counted = segments.groupBy("job_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("kind") == "speech").alias("speech"))
    if warnings is None:
        return counted.withColumn("warnings", F.lit(0).cast("long"))
    told = warnings.groupBy("job_id").agg(F.count(F.lit(1)).alias("warnings"))
    return counted.join(told, "job_id", "left").fillna(0, ["warnings"])


def in_excerpt(index: int, context: int = 1) -> Column:
    """Whether a segment is speech and around its job's ``index``-th speech, which is clamped to what the job has."""
    speech = F.col("kind") == "speech"
    rank = F.count_if(speech).over(by_job("seg_index").rowsBetween(Window.unboundedPreceding, 0)) - 1
    n = F.count_if(speech).over(Window.partitionBy("job_id"))
    at = F.greatest(F.lit(0), F.least(F.lit(index), n - 1))
    return speech & (F.abs(rank - at) <= context)


def excerpt(segments: DataFrame, index: int, context: int = 1) -> DataFrame:
    """Speech segments around the ``index``-th, as :func:`in_excerpt` has them."""
    return segments.withColumn("__in", in_excerpt(index, context)).filter("__in").drop("__in")
