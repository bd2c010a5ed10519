"""Scores of sentence ends: text, punctuation and pause fused as a noisy-or, and the arbiter's say."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import ends_sentence, language_name, punctuation_weight, reply_object
from wordloom.operators.batches import Completer, complete
from wordloom.operators.words import by_job
from wordloom.params import Params
from wordloom.storage import arrow_batches, materialize

#: A pluggable boundary model: a job's joined text to a probability for each of its characters; it may raise.
Detector = Callable[[str], list[float]]
#: What an arbiter is told before every batch. Fixed value: the shape of its reply.
ARBITER = (
    "You are shown the numbered words of a transcript whose punctuation can't be trusted, and the numbers of some of them.\n"
    "Tell after which of those a sentence really ends: where a thought is complete, not where a speaker pauses. Change no word and judge no other place.\n"
    'Answer with one JSON object and nothing else: {"boundaries": [<numbers after which a sentence ends>]}')
# Fixed value: an arbiter classifies, so nothing is left to chance.
ARBITER_TEMPERATURE = 0.0


def score_boundaries(words: DataFrame, p: Params, *, lang: Column | None = None, probability: str | None = None) -> DataFrame:
    """Words with ``score, sat_prob, pause_after, has_terminal_punct, source`` of the boundary after each.

    ``probability`` names a column of textual boundary probabilities, null where a detector
    failed. Without one punctuation and pause alone count. A negative pause lowers the score.
    A job's last word scores 1. The order of operations is fixed, so doubles agree everywhere.
    """
    # Each of these stands in a projection of its own, so that it is evaluated once.
    rows = words.withColumn("has_terminal_punct", ends_sentence(F.col("text")))
    rows = rows.withColumn("__after", F.lead("start").over(by_job("word_index")))
    mark, last = F.col("has_terminal_punct"), F.col("__after").isNull()
    pause = F.coalesce(F.col("__after") - F.col("end"), F.lit(float("inf")))
    share = F.least(F.lit(1.0), pause / F.lit(p.pause_saturation)) if p.pause_saturation else F.lit(0.0)
    text = F.coalesce(F.col(probability), F.lit(0.0)) if probability else F.lit(0.0)
    weight = punctuation_weight(lang if lang is not None else F.lit("en"))
    fused = 1.0 - (1.0 - text) * (1.0 - F.when(mark, weight).otherwise(0.0)) * (1.0 - F.lit(p.pause_weight) * share)
    source = F.when(last, "eof").when(mark & (F.col(probability).isNull() if probability else F.lit(True)), "punctuation").otherwise("fused")
    return rows.withColumns({
        "score": F.when(last, 1.0).otherwise(F.least(F.lit(1.0), fused)),
        "sat_prob": F.col(probability) if probability else F.lit(None).cast("double"),
        "pause_after": F.when(last, 0.0).otherwise(pause), "source": source}).drop("__after")


def probabilities_at_words(words: DataFrame, char_probs: DataFrame, separator: str = " ") -> DataFrame:
    """Words with ``probability``: that of each word's last character in the job's joined text.

    ``char_probs`` has ``job_id, probs`` (an array, one per character); places past its end take its last.
    """
    run = by_job("word_index").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.length("text") + len(separator)).over(run) - len(separator)
    at = F.greatest(F.lit(1), F.least("last", F.size("probs"))).cast("int")
    return (words.withColumn("last", last).join(char_probs, "job_id", "left")
            .withColumn("probability", F.try_element_at("probs", at)).drop("last", "probs"))


def _at_words(probs: list[float], texts: list[str], separator: str) -> list[float | None]:
    """As :func:`probabilities_at_words`, for one job."""
    last = itertools.accumulate(len(x) + len(separator) for x in texts)
    return [probs[max(0, min(n - len(separator), len(probs)) - 1)] if probs else None for n in last]


def detected(words: DataFrame, detector: Detector, separator: str = " ") -> tuple[DataFrame, DataFrame]:
    """Words with ``probability``, and warnings of the jobs where the detector failed: there it is null.

    Of what the detector says of a job's characters, only what its words need is kept.
    """
    said = words.filter("text is not null").groupBy("job_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda w: w["text"]).alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for job, texts in frame[["job_id", "texts"]].itertuples(index=False):
                try:
                    rows.append((job, _at_words([float(x) for x in detector(separator.join(texts))], texts, separator), None))
                except Exception as e:  # the job's boundaries then rest on marks and pauses
                    rows.append((job, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["job_id", "at_words", "error"])

    with arrow_batches(words.sparkSession):
        found = materialize(said.mapInPandas(run, "job_id long, at_words array<double>, error string"), "detected")
    warnings = found.filter("error is not null").select("job_id", F.lit("segment").alias("stage"), F.concat(F.lit("No boundary model: "), "error").alias("message"),
                                                        F.lit(None).cast("int").alias("seg_index"))
    place = F.count("text").over(by_job("word_index").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    out = words.withColumn("__place", F.greatest(F.lit(1), place)).join(found.select("job_id", "at_words"), "job_id", "left")
    return out.withColumn("probability", F.try_element_at("at_words", F.col("__place"))).drop("__place", "at_words"), warnings


def ambiguous(candidates: DataFrame, p: Params) -> DataFrame:
    """Boundaries in the gray zone, that of a job's end aside."""
    return candidates.filter((F.col("score") >= p.gray_low) & (F.col("score") < p.gray_high) & (F.col("source") != "eof"))


def arbiter_batches(candidates: DataFrame, p: Params, size: int = 25, before: int = 20, after: int = 20) -> DataFrame:
    """``job_id, batch, asked, low, high``: ambiguous places in order, with the token window that each batch shows."""
    rank = F.row_number().over(by_job("word_index")) - 1
    return (ambiguous(candidates, p).withColumn("batch", F.floor(rank / size).cast("int"))
            .groupBy("job_id", "batch")
            .agg(F.array_sort(F.collect_list("word_index")).alias("asked"),
                 F.greatest(F.lit(0), F.min("word_index") - before).alias("low"),
                 (F.max("word_index") + after + 1).alias("high")))


def arbiter_prompts(batches: DataFrame, words: DataFrame, separator: str = " ") -> DataFrame:
    """Batches with ``tokens``: ``[index]text`` of the window's words.

    A job's words meet its batches as one array, so nothing but jobs is joined and no word is repeated on the way.
    """
    spoken = words.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("word_index", "text"))).alias("spoken"))
    place = F.col("spoken.word_index")
    first, last = F.array_min(place), F.array_max(place)
    dense = (last - first + 1 == F.size(place)) & (F.size(F.array_distinct(place)) == F.size(place))
    spoken = spoken.withColumns({"__first": first, "__end": last + 1, "__dense": dense})
    low, high = F.greatest("low", "__first"), F.least("high", "__end")
    # Where no place is missing or repeated, the window is a slice; elsewhere it is looked for.
    shown = F.when(F.col("__dense"), F.slice("spoken", (low - F.col("__first") + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int"))).otherwise(
        F.filter("spoken", lambda w: (w["word_index"] >= F.col("low")) & (w["word_index"] < F.col("high"))))
    token = lambda w: F.concat(F.lit("["), w["word_index"], F.lit("]"), w["text"])
    return (batches.join(spoken, "job_id").withColumn("tokens", F.array_join(F.transform(shown, token), separator))
            .select("job_id", "batch", "asked", "tokens"))


def arbiter_requests(prompts: DataFrame, lang: Column) -> DataFrame:
    """Batches of :func:`arbiter_prompts` with ``prompt``, the user's part of what an arbiter is asked."""
    asked = F.concat(F.lit("["), F.array_join(F.transform("asked", lambda x: x.cast("string")), ", "), F.lit("]"))
    # The parts of the user prompt.
    return prompts.withColumn("prompt", F.concat(
        F.lit("Transcript tokens (language: "), language_name(lang), F.lit("):\n"), F.col("tokens"),
        F.lit("\n\nDoes a sentence end at each of these token indices? "), asked, F.lit("\nReturn the subset where a sentence genuinely ends.")))


def read_boundaries(reply: Column) -> Column:
    """The places that an arbiter's reply names: none if it has no list of them, null if it can't be read."""
    def places(answer: Column) -> Column:
        named = F.try_variant_get(answer, "$.boundaries", "variant")
        return F.when(answer.isNotNull() & named.isNull(), F.array().cast("array<int>")).otherwise(F.try_variant_get(answer, "$.boundaries", "array<int>"))

    return places(reply_object(reply))


def arbitrate(candidates: DataFrame, completer: Completer | None, p: Params, lang: Column | None = None, separator: str = " ") -> DataFrame:
    """Candidates after an arbiter has judged the ambiguous ones, in batches; as they are without one or where the knob is off.

    A batch that fails is confirmed whole. The replies are written to the shared folder, so nothing is asked twice.
    """
    if completer is None or not p.llm_arbitration:
        return candidates
    batches = arbiter_requests(arbiter_prompts(arbiter_batches(candidates, p), candidates, separator), lang if lang is not None else F.lit("en"))
    with arrow_batches(candidates.sparkSession):
        replies = materialize(complete(batches.select("job_id", "batch", "asked", "prompt"), completer, ARBITER, ARBITER_TEMPERATURE).drop("prompt"), "arbitrated")
    return apply_arbitration(candidates, confirmed_places(replies.withColumn("boundaries", read_boundaries(F.col("reply")))), p)


def confirmed_places(replies: DataFrame) -> DataFrame:
    """``job_id, word_index`` that the arbiter confirmed. ``replies`` has ``asked`` and ``boundaries``.

    A null reply (a failure) confirms all that was asked; an empty one confirms nothing; places
    that weren't asked are ignored.
    """
    return replies.select("job_id", F.explode(F.array_intersect(F.coalesce("boundaries", "asked"), F.col("asked"))).alias("word_index"))


def apply_arbitration(candidates: DataFrame, confirmed: DataFrame, p: Params) -> DataFrame:
    """Candidates whose ambiguous scores are moved over or under the threshold, with source ``llm``.

    A job's confirmed places come as one array, which only its ambiguous words look into, so words aren't shuffled.
    """
    gray = (F.col("score") >= p.gray_low) & (F.col("score") < p.gray_high) & (F.col("source") != "eof")
    said = confirmed.groupBy("job_id").agg(F.collect_set(F.col("word_index").cast("long")).alias("confirmed"))
    moved = (F.when(F.coalesce(F.array_contains("confirmed", F.col("word_index").cast("long")), F.lit(False)), F.greatest("score", F.lit(p.sat_threshold + 0.1)))
             .otherwise(F.least("score", F.lit(p.sat_threshold - 0.1))))
    return (candidates.join(said, "job_id", "left").withColumn("gray", gray)
            .withColumns({"score": F.when(F.col("gray"), moved).otherwise(F.col("score")),
                          "source": F.when(F.col("gray"), "llm").otherwise(F.col("source"))})
            .drop("confirmed", "gray"))
