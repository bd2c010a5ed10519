"""Words of jobs: from chunks with timestamps to cleaned, ordered words."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import invented, nonblank, strip
from wordloom.operators.folds import RUN_GAP, accepted
from wordloom.storage import dealt_fine

#: A run of at least so many bytes that compresses by more than this factor is a stuck decoder's.
DEGENERATE_BYTES, DEGENERATE_RATIO = 40, 2.4


def is_degenerate(text: str | None) -> bool:
    """Text that compresses far better than language does."""
    raw = (text or "").encode()
    return len(raw) >= DEGENERATE_BYTES and len(raw) / len(zlib.compress(raw)) > DEGENERATE_RATIO


def degenerate(text: Column) -> Column:
    """:func:`is_degenerate` as a pandas UDF: Spark has no zlib function."""
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(is_degenerate).astype(bool)

    return F.pandas_udf(each, "boolean")(text)


def by_job(*order: str) -> Window:
    return Window.partitionBy("job_id").orderBy(*order)


def drop_blank(chunks: DataFrame) -> DataFrame:
    """Chunks whose text has more than white space, stripped."""
    return chunks.withColumn("text", nonblank(F.col("text"))).filter("text is not null")


def with_runs(chunks: DataFrame, gap: float = RUN_GAP) -> DataFrame:
    """``job_id, pos, text, start, end, run``: missing times filled, a run for each stretch without a long pause.

    A missing start is the previous word's end (0 at first), a missing end the start, and no
    end precedes its start. So from each word with a start up to the next, ends are the running
    maximum of what ends are known: a window over those stretches, not a fold.
    """
    clean = drop_blank(chunks)
    w = by_job("pos")
    anchored = clean.withColumn("stretch", F.count("start").over(w))
    known = F.when(F.col("start").isNull(), F.col("end")).otherwise(F.greatest("end", "start"))
    upto = Window.partitionBy("job_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max(known).over(upto)
    filled = anchored.withColumn("reach", F.when(F.col("stretch") == 0, F.greatest(reached, F.lit(0.0))).otherwise(reached))
    before = F.lag("reach").over(w)
    filled = filled.withColumns({"before": before, "start": F.coalesce("start", before, F.lit(0.0))}).withColumn("end", F.coalesce("reach", "start"))
    breaks = F.coalesce((F.col("start") - F.col("before") > gap).cast("int"), F.lit(0))
    return filled.withColumn("run", F.sum(breaks).over(w).cast("int")).select("job_id", "pos", "text", "start", "end", "run")


def _run_words(words: DataFrame) -> DataFrame:
    """``job_id, run, text, words``: each run's words in order, and their texts joined by spaces."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end")))
    return words.groupBy("job_id", "run").agg(ordered.alias("words")).withColumn("text", strip(F.array_join("words.text", " ")))


def run_texts(words: DataFrame) -> DataFrame:
    """``job_id, run, text, n_words, start, end`` of each run."""
    return _run_words(words).select("job_id", "run", "text", F.size("words").cast("long").alias("n_words"), F.array_min("words.start").alias("start"),
                                    F.array_max("words.end").alias("end"))


def _rejected(text: Column, stuck: bool) -> Column:
    return invented(text) | degenerate(text) if stuck else invented(text)


def _with_kept(runs: DataFrame, stuck: bool, *carry: str) -> DataFrame:
    """``job_id`` and the array ``runs`` of (run, text, bad, *carry, kept) in order.

    A repeat is compared with the last two runs that were kept, so flags are folded over a
    job's runs: one array in, one out.
    """
    def each(texts: pd.Series, bads: pd.Series) -> pd.Series:
        return pd.Series([accepted(list(t), list(b)) for t, b in zip(texts, bads)], dtype=object)

    marked = runs.withColumn("bad", _rejected(F.col("text"), stuck))
    jobs = marked.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("run", "text", "bad", *carry))).alias("runs"))
    kept = F.pandas_udf(each, "array<boolean>")(F.col("runs.text"), F.col("runs.bad"))
    return jobs.withColumn("flags", kept).select("job_id", F.zip_with("runs", "flags", lambda r, k: r.withField("kept", k)).alias("runs"))


def judged_runs(runs: DataFrame, stuck: bool = True) -> DataFrame:
    """``job_id, run, text, kept``: invented, degenerate and just repeated texts are not kept; without ``stuck``, degenerate ones may be."""
    return _with_kept(runs, stuck).select("job_id", F.inline("runs")).select("job_id", "run", "text", "kept")


def collect_words(chunks: DataFrame, stuck: bool = True) -> DataFrame:
    """``job_id, word_index, text, start, end`` of the kept runs (as :func:`judged_runs` keeps them), stably ordered by start and end.

    Rows shuffle once, by job; runs and words travel as arrays inside it, and are put in order there, as Spark
    takes rows that come from Python for unpartitioned. A job is one recording, whose words one task holds.
    """
    kept = _with_kept(_run_words(with_runs(chunks)), stuck, "words").select("job_id", F.filter("runs", lambda r: r["kept"]).alias("runs"))
    said = F.flatten(F.transform("runs", lambda r: r["words"]))
    ordered = F.array_sort(F.transform(said, lambda w: F.struct(w["start"], w["end"], w["pos"], w["text"])))
    return kept.select("job_id", F.posexplode(ordered).alias("word_index", "w")).select("job_id", "word_index", "w.text", "w.start", "w.end")


def from_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words with made-up times for each text: ``job_id, word_index, text, start, end, start_ms, end_ms``.

    A row without a key is no job. Of rows that share a key, the least text is the job's.

    Durations and gaps are integers of milliseconds computed from key, place and length; rare
    gaps are long or negative. Times divide once, so any engine gets the same doubles. Texts
    are dealt by job before they are split: what follows needs its rows by job, and whole texts
    shuffle smaller than their words. A text's words take some twenty times its bytes, so partitions are small.
    """
    known = dealt_fine(docs.filter(F.col(key).isNotNull()).select(key, "text"), docs, key)
    jobs = known.groupBy(key).agg(F.min("text").alias("text"))
    split = jobs.select(F.col(key).alias("job_id"), F.posexplode(F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "")).alias("word_index", "text"))
    h = (F.col("job_id") * 7919 + F.col("word_index") * 104729) % 1000
    gap = F.when(h < 5, 2500).when(h < 20, 900).when(h < 30, -40).otherwise(20 + h % 200)
    timed = split.withColumns({"dur": 80 + 40 * F.length("text"), "gap": gap})
    before = Window.partitionBy("job_id").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0))
    return (timed.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("dur"))
            .select("job_id", "word_index", "text", (F.col("start_ms") / 1000.0).alias("start"),
                    (F.col("end_ms") / 1000.0).alias("end"), "start_ms", "end_ms"))

