"""The edit list: contiguous clips of source sound, silence and translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import lyric_line
from wordloom.operators.words import by_job
from wordloom.params import Params
from wordloom.plans.cuts import previous_out

#: What is left after the last segment is kept if longer than this.
LEAST_OUTRO = 0.05
#: Place of a segment's own sound among its clips.
SOUND = 1
TOLERANCE, SPAN_TOLERANCE = 1e-6, 1e-3


def _clip(order: int, kind: str, duration: Column, **values: Column) -> Column:
    none = {"src_start": "double", "src_end": "double", "path": "string", "segment_id": "string",
            "fade_in": "double", "fade_out": "double", "label": "string"}
    plain = {"fade_in": F.lit(0.0), "fade_out": F.lit(0.0)}
    return F.struct(F.lit(order).alias("part"), F.lit(kind).alias("kind"), duration.cast("double").alias("duration"),
                    *[values.get(k, plain.get(k, F.lit(None))).cast(t).alias(k) for k, t in none.items()])


def parts(cut_segments: DataFrame, p: Params, *, keep_bridge: Column | None = None, keep_outro: Column | None = None,
          selected: DataFrame | Column | None = None, bridge_from_zero: bool = False) -> DataFrame:
    """What each segment puts into the list: ``job_id, seg_index, media_end, hard, part`` and a clip's fields.

    Each segment gives up to five clips: a bridge over a long gap before it, its own sound, and
    silence, translation, silence if it has one; after the last comes an outro. Some may have
    no length.

    ``keep_bridge`` and ``keep_outro`` say whether the sound there has content (true without
    them). ``selected`` (a table of ``job_id, id``, or a column that says so of each segment and
    needs no join) restricts the list and drops the outro; the first selected segment's bridge then
    starts at the end of the segment before it, or at zero with ``bridge_from_zero``.
    """
    whole = previous_out(cut_segments.withColumn("__last", F.lead("seg_index").over(by_job("seg_index")).isNull()))
    if isinstance(selected, Column):
        rows = whole.withColumn("__in", selected).filter("__in")
    else:
        rows = whole if selected is None else whole.join(selected.select("job_id", "id"), ["job_id", "id"], "left_semi")
    if selected is not None and bridge_from_zero:
        rows = previous_out(rows.drop("prev_out"))
    spoken = (F.col("kind") == "speech") & F.col("tts_path").isNotNull() & (F.coalesce("translation", F.lit("")) != "")
    soft, hard = F.lit(p.splice_fade), F.lit(p.hard_splice_fade)
    start = F.coalesce("prev_out", F.lit(0.0))
    gap = F.col("src_in") - start
    bridge = (gap > p.max_source_gap) & (F.coalesce(keep_bridge, F.lit(True)) if keep_bridge is not None else F.lit(True))
    rest = F.col("media_end") - F.col("src_out")
    outro = F.col("__last") & (rest > LEAST_OUTRO) & F.lit(selected is None) & (keep_outro if keep_outro is not None else F.lit(True))
    made = F.array(
        F.when(bridge, _clip(0, "source", gap, src_start=start, src_end=F.col("src_in"),
                             fade_in=F.when(F.col("prev_out").isNull(), 0.0).otherwise(soft), fade_out=soft)),
        _clip(SOUND, "source", F.col("src_out") - F.col("src_in"), src_start=F.col("src_in"), src_end=F.col("src_out"), segment_id=F.col("id"),
              fade_in=F.when(F.col("hard_in"), hard).otherwise(soft), fade_out=F.when(F.col("hard_out"), hard).otherwise(soft)),
        F.when(spoken, _clip(2, "silence", F.lit(p.pre_gap))),
        F.when(spoken, _clip(3, "tts", F.col("tts_duration") / F.greatest(F.lit(p.tts_speed), F.lit(0.01)), path=F.col("tts_path"),
                             segment_id=F.col("id"), label=F.col("translation"), fade_in=soft, fade_out=soft)),
        F.when(spoken, _clip(4, "silence", F.lit(p.post_gap))),
        F.when(outro, _clip(5, "source", rest, src_start=F.col("src_out"), src_end=F.col("media_end"), fade_in=soft)))
    return rows.select("job_id", "seg_index", "media_end", F.col("hard_out").alias("hard"), F.inline(F.filter(made, lambda c: c.isNotNull())))


def in_order(part_rows: DataFrame) -> DataFrame:
    """Clips with ``clip_index`` and ``out_start``, the running sum of the durations before; those without length are left out."""
    w = Window.partitionBy("job_id").orderBy("seg_index", "part")
    before = F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return (part_rows.filter("duration > 0").withColumns({"clip_index": F.row_number().over(w) - 1, "out_start": before})
            .select("job_id", "clip_index", "kind", "out_start", "duration", "src_start", "src_end", "path", "segment_id",
                    "fade_in", "fade_out", "label"))


def clips(cut_segments: DataFrame, p: Params, **options) -> DataFrame:
    """The edit list of each job; options as for :func:`parts`."""
    return in_order(parts(cut_segments, p, **options))


def plan_stats(part_rows: DataFrame) -> DataFrame:
    """Per job, from :func:`parts`: durations, translated and skipped segments, hard splices, expansion (0 without a source)."""
    own = F.col("part") == SOUND
    out = part_rows.groupBy("job_id").agg(
        F.max("media_end").alias("source_duration"), F.sum(F.greatest("duration", F.lit(0.0))).alias("output_duration"),
        F.count_if(F.col("kind") == "tts").alias("translated_segments"), F.count_if(own).alias("n"),
        F.count_if(own & F.col("hard")).alias("hard_splices"))
    ratio = F.when(F.col("source_duration") > 0, F.col("output_duration") / F.col("source_duration")).otherwise(0.0)
    return out.select("job_id", "source_duration", "output_duration", "translated_segments",
                      (F.col("n") - F.col("translated_segments")).alias("skipped_segments"), "hard_splices", ratio.alias("expansion_ratio"))


def violations(clip_rows: DataFrame) -> DataFrame:
    """``job_id, clip_index, problem``: the first clip of each job that breaks the list's rules."""
    w = by_job("clip_index")
    expected = F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    span = F.col("src_end") - F.col("src_start")
    source, tts = F.col("kind") == "source", F.col("kind") == "tts"
    problem = (F.when(F.col("duration") < 0, "negative duration")
               .when(F.abs(F.col("out_start") - expected) > TOLERANCE, "not contiguous")
               .when(source & (F.col("src_start").isNull() | F.col("src_end").isNull()), "no source range")
               .when(source & (span < 0), "inverted source range")
               .when(source & (F.abs(span - F.col("duration")) > SPAN_TOLERANCE), "duration differs from source range")
               .when(tts & (F.coalesce("path", F.lit("")) == ""), "no path")
               .when(tts & ~F.coalesce(F.lag("kind").over(w).isin("source", "silence"), F.lit(False)), "not anchored"))
    return (clip_rows.withColumn("problem", problem).filter("problem is not null")
            .groupBy("job_id").agg(F.min(F.struct("clip_index", "problem")).alias("first"))
            .select("job_id", "first.clip_index", "first.problem"))


def freeze_times(clip_rows: DataFrame) -> DataFrame:
    """Clips with ``freeze_at``: the end of the last source clip before, 0 without one, null for source clips."""
    own = F.when(F.col("kind") == "source", F.col("src_end"))
    last = F.last(own, ignorenulls=True).over(by_job("clip_index").rowsBetween(Window.unboundedPreceding, -1))
    return clip_rows.withColumn("freeze_at", F.when(F.col("kind") != "source", F.coalesce(last, F.lit(0.0))))


def sample_places(clip_rows: DataFrame, rate: int) -> DataFrame:
    """Clips with ``n_samples``, rounded half to even, and ``first_sample``, the sum of those before."""
    n = F.bround(F.col("duration") * rate).cast("long")
    before = F.sum("n_samples").over(by_job("clip_index").rowsBetween(Window.unboundedPreceding, -1))
    return clip_rows.withColumn("n_samples", n).withColumn("first_sample", F.coalesce(before, F.lit(0)))


def lyrics(clip_rows: DataFrame) -> DataFrame:
    """``job_id, clip_index, line`` of each translation, timed."""
    return (clip_rows.filter((F.col("kind") == "tts") & (F.coalesce("label", F.lit("")) != ""))
            .select("job_id", "clip_index", lyric_line(F.col("out_start"), F.col("label")).alias("line")))


def write_lyrics(clip_rows: DataFrame, path: str, titles: DataFrame | None = None) -> None:
    """One text file of lyrics per job under ``path``, the title first."""
    rows = lyrics(clip_rows)
    if titles is not None:
        rows = rows.unionByName(titles.filter(F.coalesce("title", F.lit("")) != "").select(
            "job_id", F.lit(-1).alias("clip_index"), F.concat(F.lit("[ti:"), "title", F.lit("]")).alias("line")))
    (rows.repartition("job_id").sortWithinPartitions("job_id", "clip_index").select(F.col("line").alias("value"), "job_id")
     .write.partitionBy("job_id").mode("overwrite").text(path))
