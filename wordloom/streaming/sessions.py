"""Structured Streaming forms of the batch operators.

Late data, which the batch operators don't know, follows the watermark: rows older than it are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.operators.folds import REPEAT_WINDOW
from wordloom.params import Params


def runs(events: DataFrame, key: str, at: str, gap: str, watermark: str = "1 hour", seconds: str | None = None) -> DataFrame:
    """``key, run_start, run_end, n``: events closer than the gap are one run.

    An event at exactly the gap joins, as in the batch operator. ``seconds`` names a column of
    durations that lengthen each event. Works on batches too.
    """
    if events.isStreaming:
        events = events.withWatermark(at, watermark)
    length = F.lit(gap) if seconds is None else F.concat(F.col(seconds), F.lit(f" seconds {gap}"))
    window = F.session_window(at, length)
    return (events.groupBy(F.col(key), window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
            .select(key, F.col("w.start").alias("run_start"), F.col("last").alias("run_end"), "n"))


def levels(samples: DataFrame, key: str, at: str, value: str, frame: str = "10 milliseconds", hop: str = "5 milliseconds", watermark: str = "1 second") -> DataFrame:
    """Levels of overlapping windows, on a grid that starts at the epoch."""
    if samples.isStreaming:
        samples = samples.withWatermark(at, watermark)
    return (samples.groupBy(F.col(key), F.window(at, frame, hop).alias("w"))
            .agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("level")).select(key, F.col("w.start").alias("at"), "level"))


def first_of_key(events: DataFrame, key: str, at: str, watermark: str = "1 hour") -> DataFrame:
    """One event per content key within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def kept_runs(stream: DataFrame) -> DataFrame:
    """The repeat filter on a stream of ``job_id long, run int, text string``: state holds the last runs kept."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        for frame in frames:
            rows = []
            for run, text in frame.sort_values("run")[["run", "text"]].itertuples(index=False):
                if text and text not in recent:
                    recent = [*recent, text][-REPEAT_WINDOW:]
                    rows.append((key[0], run, text))
            yield pd.DataFrame(rows, columns=["job_id", "run", "text"])
        state.update((recent,))

    return stream.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, run int, text string", "recent array<string>", "append", GroupStateTimeout.NoTimeout)


def merged_ranges(stream: DataFrame, p: Params) -> DataFrame:
    """The merging of short ranges on a stream: ``job_id, word_start, word_end, start, end`` of the ranges as they are settled.

    The stream has ``job_id long, word_start int, word_end int, start double, end double, weak boolean, last boolean``: a job's
    ranges in order, whether the boundary after each may go (unsettled, with a short pause), and which is its last.
    State holds the range that still grows and the one before it, which a short last range joins.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_word, open_time, *held = state.get if state.exists else (None, None, None, None, None, None, None)
        before = tuple(held) if held[0] is not None else None
        rows = pd.concat([f for f in frames]).sort_values("word_start")
        out = []
        for word_start, word_end, start, end, weak, last in rows[["word_start", "word_end", "start", "end", "weak", "last"]].itertuples(index=False):
            first, since = (word_start, start) if open_word is None else (open_word, open_time)
            short = word_end - first < p.min_words or end - since < p.min_duration
            if short and weak and not last:
                open_word, open_time = int(first), float(since)
                continue
            open_word = open_time = None
            if before is not None and last and short and before[4]:
                first, since = before[0], before[2]
            elif before is not None:
                out.append((key[0], *before[:4]))
            before = (int(first), int(word_end), float(since), float(end), bool(weak))
            if last:
                out.append((key[0], *before[:4]))
                before = None
        state.update((open_word, open_time, *(before or (None,) * 5)))
        yield pd.DataFrame(out, columns=["job_id", "word_start", "word_end", "start", "end"])

    return stream.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, word_start int, word_end int, start double, end double",
        "open_word int, open_time double, word_start int, word_end int, start double, end double, weak boolean", "append", GroupStateTimeout.NoTimeout)


def stale_jobs(heartbeats: DataFrame, after_ms: int) -> DataFrame:
    """Jobs without a heartbeat for so long, by the clock: ``id string, beats long``."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            beats = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], beats)], columns=["id", "beats"])
            return
        seen = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((seen,))
        state.setTimeoutDuration(after_ms)

    return heartbeats.groupBy("id").applyInPandasWithState(
        step, "id string, beats long", "beats long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def poll(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", mode: str = "append") -> StreamingQuery:
    """Give what comes to ``sink`` batch by batch, as often as said, until the query is stopped: a worker."""
    return (stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).start())


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Give what is there to ``sink`` batch by batch and stop: a scheduled batch or a test."""
    query = (stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
