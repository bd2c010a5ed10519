"""Clips by content key: what is synthesised already, what isn't, what nobody needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import clip_key

# The voice of each language that can be synthesised.
VOICES = {
    "en": "af_heart", "es": "ef_dora", "fr": "ff_siwis", "it": "if_sara",
    "pt": "pf_dora", "ja": "jf_alpha", "zh": "zf_xiaobei", "hi": "hf_alpha",
}


def resolved_voice(lang: Column, voice: Column) -> Column:
    """The voice asked for where its language has it, else the language's own; an error for other languages."""
    table = F.create_map(*[F.lit(x) for pair in VOICES.items() for x in pair])
    own = F.try_element_at(table, lang)
    return F.when(own.isNull(), F.raise_error(F.concat(F.lit("no voice for "), F.coalesce(lang, F.lit("null"))))).otherwise(
        F.when(voice == own, voice).otherwise(own))


def with_keys(segments: DataFrame, lang: str, voice: str) -> DataFrame:
    """Segments to be spoken, with ``voice``, ``lang`` and ``text_sha``."""
    spoken = segments.filter((F.col("kind") == "speech") & (F.coalesce("translation", F.lit("")) != ""))
    return (spoken.withColumns({"lang": F.lit(lang), "voice": resolved_voice(F.lit(lang), F.lit(voice))})
            .withColumn("text_sha", clip_key(F.col("translation"), F.col("voice"), F.col("lang"))))


def hits(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Keyed segments with the cached ``path`` and ``duration``, null where missing."""
    return keyed.join(cache.select("text_sha", "path", "duration"), "text_sha", "left")


def misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Each text to synthesise once: ``text_sha, translation, voice, lang``."""
    return (keyed.join(cache, "text_sha", "left_anti").groupBy("text_sha")
            .agg(F.min("translation").alias("translation"), F.min("voice").alias("voice"), F.min("lang").alias("lang")))


def synthesise(missing: DataFrame, engine: Callable[[str, str, str], float]) -> DataFrame:
    """Cache rows ``text_sha, path, duration`` from an engine that returns seconds; ``error`` where it raised."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, voice, lang in frame[["text_sha", "translation", "voice", "lang"]].itertuples(index=False):
                try:
                    rows.append((key, f"tts/{key}.wav", float(engine(text, voice, lang)), None))
                except Exception as e:  # one text must not stop the others
                    rows.append((key, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["text_sha", "path", "duration", "error"])

    return missing.mapInPandas(run, "text_sha string, path string, duration double, error string")


def voiced(segments: DataFrame, cache: DataFrame, engine: Callable[[str, str, str], float], lang: str, voice: str) -> tuple[DataFrame, DataFrame]:
    """Segments with ``tts_path`` and ``tts_duration``, and the new cache rows. A failure leaves both null."""
    keyed = with_keys(segments, lang, voice)
    made = synthesise(misses(keyed, cache), engine)
    known = cache.select("text_sha", "path", "duration").unionByName(made.filter("error is null").select("text_sha", "path", "duration"))
    clips = hits(keyed, known).select("job_id", "seg_index", "text_sha", F.col("path").alias("tts_path"), F.col("duration").alias("tts_duration"))
    return segments.join(clips, ["job_id", "seg_index"], "left"), made


def unused(cache: DataFrame, segments: DataFrame) -> DataFrame:
    """Cache rows that no segment refers to."""
    return cache.join(segments.filter("tts_path is not null").select(F.col("tts_path").alias("path")).distinct(), "path", "left_anti")
