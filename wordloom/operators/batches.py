"""Batched inference: prompts with context, replies checked, failures retried singly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import LANGUAGES, language_name, reply_object, strip
from wordloom.operators.segments import translatable
from wordloom.operators.words import by_job

#: A pluggable model: system prompt, user prompt and temperature to reply; it may raise.
Completer = Callable[[str, str, float], str]
BATCH, CONTEXT = 10, 2
#: What a translator is told before every batch. Fixed value: the shape of its reply.
TRANSLATOR = (
    "Render each numbered sentence of a talk in {target}, the way it would be spoken there, for people who learn the language.\n"
    "Stay close to the length of the original, as the result is read aloud in a pause. Fragments stay fragments; add no remarks.\n"
    'Answer with one JSON object and nothing else, with one entry for every sentence under its own number: {{"translations": [{{"id": <int>, "text": "<translation>"}}]}}')
# Fixed value: how freely a translator words its sentences.
TRANSLATOR_TEMPERATURE = 0.2
# The parts of a user prompt, and the warnings.
CONTEXT_HEAD = "Preceding context (do not translate):\n"
RETRIED, KEPT = " failed; retried one at a time.", "Translation failed; kept source text."


def with_batches(items: DataFrame, size: int = BATCH, context: int = CONTEXT, order: str = "seg_index") -> DataFrame:
    """Items with ``batch``, ``place`` in it from 0, and ``context``: the texts just before the batch."""
    w = by_job(order)
    ranked = items.withColumn("rank", F.row_number().over(w) - 1)
    before = F.collect_list("text").over(w.rowsBetween(-context, -1)) if context else F.array().cast("array<string>")
    ranked = ranked.withColumns({"batch": F.floor(F.col("rank") / size).cast("int"), "place": (F.col("rank") % size).cast("int"), "near": before})
    start = Window.partitionBy("job_id", "batch").orderBy("rank")
    return ranked.withColumn("context", F.first("near").over(start)).drop("near", "rank")


def prompt(texts: Column, context: Column, target: Column) -> Column:
    """The user prompt for an array of texts."""
    head = F.when(F.size(context) > 0, F.concat(
        F.lit(CONTEXT_HEAD), F.array_join(F.transform(context, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")
    lines = F.transform(texts, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x))
    return F.concat(head, F.lit("Translate these "), F.size(texts), F.lit(" sentences into "), language_name(target), F.lit(":\n"), F.array_join(lines, "\n"))


def prompts(batched: DataFrame, target: str) -> DataFrame:
    """``job_id, batch, n, prompt``."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return (batched.groupBy("job_id", "batch").agg(texts.alias("texts"), F.min_by("context", "place").alias("context"))
            .select("job_id", "batch", F.size("texts").alias("n"), prompt(F.col("texts"), F.col("context"), F.lit(target)).alias("prompt")))


def complete(requests: DataFrame, completer: Completer, system: str, temperature: float) -> DataFrame:
    """Requests with ``reply``, null where the model failed."""
    def one(text: str) -> str | None:
        try:
            return completer(system, text, temperature)
        except Exception:  # a failed batch is a row without reply, which is retried
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=[one(x) for x in frame["prompt"]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{kinds}, reply string")


def entries(reply: Column) -> Column:
    """A reply's translations as an array of (id, text); null where it can't be read."""
    return F.try_variant_get(reply_object(reply), "$.translations", "array<struct<id:int,text:string>>")


def checked(replies: DataFrame) -> DataFrame:
    """``job_id, batch, place, translation`` of whole replies: as many different ids as asked, 0 to n-1.

    Of entries that share an id, the last holds; entries without id or text don't count.
    """
    rows = (replies.select("job_id", "batch", "n", F.posexplode(entries(F.col("reply"))).alias("at", "e"))
            .filter("e.id is not null and e.text is not null")
            .groupBy("job_id", "batch", "n", F.col("e.id").alias("place"))
            .agg(strip(F.max_by("e.text", "at")).alias("translation")))
    w = Window.partitionBy("job_id", "batch")
    whole = (F.count(F.lit(1)).over(w) == F.col("n")) & (F.min("place").over(w) == 0) & (F.max("place").over(w) == F.col("n") - 1)
    return rows.withColumn("whole", whole).filter("whole").select("job_id", "batch", "place", "translation")


def translate(segments: DataFrame, completer: Completer, target: str, size: int = BATCH, context: int = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """Segments with ``translation`` and ``translation_failed``, and the warnings.

    Batches that fail or come back incomplete are asked again one by one without context, only
    they; a sentence that fails again keeps its source text and is flagged.
    """
    told = (TRANSLATOR.format(target=LANGUAGES.get(target, target)), TRANSLATOR_TEMPERATURE)
    batched = with_batches(translatable(segments), size, context)
    good = checked(complete(prompts(batched, target), completer, *told))
    first = batched.join(good, ["job_id", "batch", "place"], "left")
    failed = first.filter("translation is null")
    single = failed.select("job_id", "seg_index", "batch", F.lit(1).alias("n"),
                           prompt(F.array("text"), F.array().cast("array<string>"), F.lit(target)).alias("prompt"))
    again = complete(single, completer, *told).select(
        "job_id", "seg_index", "batch", strip(F.try_element_at(entries(F.col("reply")), F.lit(1))["text"]).alias("retried"))
    both = (first.select("job_id", "seg_index", "translation").join(again, ["job_id", "seg_index"], "left")
            .select("job_id", "seg_index", F.nullif(F.coalesce("translation", "retried"), F.lit("")).alias("said"), F.lit(True).alias("asked")))
    out = (segments.join(both, ["job_id", "seg_index"], "left")
           .withColumn("translation", F.when(F.col("asked"), F.coalesce("said", "text")))
           .withColumn("translation_failed", F.coalesce("asked", F.lit(False)) & F.col("said").isNull()).drop("said", "asked"))
    retried = again.select("job_id", "batch").distinct().select(
        "job_id", F.lit("translate").alias("stage"), F.concat(F.lit("Batch "), "batch", F.lit(RETRIED)).alias("message"), F.lit(None).cast("int").alias("seg_index"))
    kept = out.filter("translation_failed").select(
        "job_id", F.lit("translate").alias("stage"), F.lit(KEPT).alias("message"), "seg_index")
    return out, retried.unionByName(kept)
