"""Registered queries of the ordered-sequence operators, over the driver's tables.

The tables hold no recordings, so jobs are made from them: documents give timed words,
conversations give batches and cache keys, orders a job queue, events runs per user,
embeddings short signals, parts changes of parameters.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import signal, text
from wordloom.operators import batches, boundaries, cache, queue, segments, words
from wordloom.params import KNOBS, Params
from wordloom.plans import cuts, dub, edits, render, stages
from wordloom.streaming import sessions

P = Params()
#: The queue queries' present: seconds since 1970.
NOW = 1_000_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def job_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.from_documents(table(spark, sf_dir, "documents"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.score_boundaries(job_words(spark, sf_dir), P)


def _flat(segs: DataFrame) -> DataFrame:
    return segs.select("job_id", "seg_index", "word_start", "word_end", "text", "start", "end", "kind",
                       F.col("boundary.score").alias("score"), F.col("boundary.source").alias("source"))


def sentences(spark, sf_dir):
    return _flat(segments.sentences(candidates(spark, sf_dir), P))


def constrained_segments(spark, sf_dir):
    return _flat(segments.segment(candidates(spark, sf_dir), P))


def merged_segments(spark, sf_dir):
    """Short ranges merged, long ones left."""
    return _flat(segments.segment(candidates(spark, sf_dir), Params(max_words=1 << 30, max_duration=1e12)))


def divided_segments(spark, sf_dir):
    """Long ranges divided, short ones left."""
    return _flat(segments.segment(candidates(spark, sf_dir), Params(min_words=1, min_duration=0.0)))


def word_chunks(spark, sf_dir):
    return _flat(segments.segment(candidates(spark, sf_dir), Params(segmentation_mode="words")))


def boundary_scores(spark, sf_dir):
    return candidates(spark, sf_dir).select("job_id", "word_index", "score", "pause_after", "has_terminal_punct", "source")


def ambiguous_boundaries(spark, sf_dir):
    return boundaries.ambiguous(candidates(spark, sf_dir), P).select("job_id", "word_index", "score")


def arbiter_windows(spark, sf_dir):
    return boundaries.arbiter_batches(candidates(spark, sf_dir), P).select(
        "job_id", "batch", F.size("asked").alias("asked"), F.array_min("asked").alias("first"), "low", "high")


def arbitrated_scores(spark, sf_dir):
    """Scores after an arbiter that confirms every other ambiguous place."""
    found = candidates(spark, sf_dir)
    confirmed = boundaries.ambiguous(found, P).filter("word_index % 2 = 0").select("job_id", "word_index")
    return boundaries.apply_arbitration(found, confirmed, P).select("job_id", "word_index", "score", "source")


def _scripted_arbiter(system: str, prompt: str, temperature: float) -> str:
    """Confirms every other place; fails where it is asked of more than twenty, and answers nothing about just one."""
    asked = json.loads(prompt.split("indices? ")[1].split("\n")[0])
    if system != boundaries.ARBITER or temperature != 0.0 or len(asked) > 20:
        raise OSError("no answer")
    return "So:\n" + json.dumps({"boundaries": [x for x in asked if x % 2 == 0] + [asked[0] + 1] if len(asked) > 1 else []})


def arbitration(spark, sf_dir):
    """Boundaries after a scripted arbiter was asked about the ambiguous ones."""
    found = boundaries.arbitrate(candidates(spark, sf_dir), _scripted_arbiter, P)
    return found.select("job_id", "word_index", "score", "source")


def _as_chunks(timed: DataFrame) -> DataFrame:
    return timed.withColumnRenamed("word_index", "pos").select("job_id", "pos", "text", "start", "end")


def detected_probabilities(spark, sf_dir):
    """Probabilities that a scripted detector gives to characters, at the words that end there."""
    found, _ = boundaries.detected(job_words(spark, sf_dir), lambda said: [(i * 7 % 100) / 100 for i in range(len(said))])
    return found.select("job_id", "word_index", "probability")


def _untimed(spark, sf_dir) -> DataFrame:
    """Chunks of which some have no start, no end, or neither."""
    j, i = F.col("job_id"), F.col("pos")
    return _as_chunks(job_words(spark, sf_dir)).withColumns({"start": F.when((j * 31 + i * 17) % 23 != 0, F.col("start")), "end": F.when((j * 13 + i * 7) % 11 != 0, F.col("end"))})


def speech_runs(spark, sf_dir):
    return words.run_texts(words.with_runs(_untimed(spark, sf_dir)))


def collected_words(spark, sf_dir):
    return words.collect_words(_untimed(spark, sf_dir), stuck=False)


def _lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (docs.select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("run", "text"))
            .withColumn("text", text.strip(F.col("text"))))


def kept_lines(spark, sf_dir):
    return words.judged_runs(_lines(spark, sf_dir), stuck=False)


def invented_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("job_id").agg(F.count_if(text.invented(F.col("text"))).alias("invented"), F.count(F.lit(1)).alias("n"))


def degenerate_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("job_id").agg(F.count_if(words.degenerate(F.col("text"))).alias("degenerate"))


def job_summary(spark, sf_dir):
    return segments.summary(segments.sentences(candidates(spark, sf_dir), P))


def preview_excerpt(spark, sf_dir):
    return segments.excerpt(segments.sentences(candidates(spark, sf_dir), P), 5).select("job_id", "seg_index")


def word_marks(spark, sf_dir):
    """Scalar functions over the different words of all documents."""
    seen = job_words(spark, sf_dir).select("text").distinct()
    return seen.select("text", text.ends_sentence(F.col("text")).alias("ends"), text.safe_name(F.col("text")).alias("safe"),
                       text.readable(F.col("text"), F.lit("Error"), 8).alias("short"))


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"), F.col("turn").cast("int").alias("seg_index"), "text", F.lit("speech").alias("kind"))


def translation_prompts(spark, sf_dir):
    return batches.prompts(batches.with_batches(_turns(spark, sf_dir), 3, 2), "en")


def _replies(spark, sf_dir) -> DataFrame:
    """Made-up replies: every third job's miss an entry, every third's are fenced."""
    batched = batches.with_batches(_turns(spark, sf_dir), 3, 2)
    body = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))),
                                          lambda x: F.struct(x["place"].alias("id"), F.concat(F.lit("EN:"), x["text"]).alias("text"))).alias("translations")))
    made = batched.groupBy("job_id", "batch").agg(F.count(F.lit(1)).cast("int").alias("n"), body.alias("whole"), F.max("place").alias("last"))
    short = F.regexp_replace("whole", r'\{"id":' + "0", '{"no":0')
    reply = (F.when(F.col("job_id") % 3 == 0, short).when(F.col("job_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "whole", F.lit("\n```")))
             .otherwise(F.col("whole")))
    return made.select("job_id", "batch", "n", reply.alias("reply"))


def checked_replies(spark, sf_dir):
    return batches.checked(_replies(spark, sf_dir))


def _scripted_translator(system: str, prompt: str, temperature: float) -> str:
    """Marks each sentence; fails on batches of two, and on single sentences of odd length."""
    found = re.split(r"(?m)^(\d+)\. ", "\n" + prompt.rsplit("into English:\n", 1)[1])[1:]
    texts = {int(n): t.removesuffix("\n") for n, t in zip(found[::2], found[1::2])}
    if len(texts) == 2 or len(texts) == 1 and len(texts[0]) % 2:
        raise OSError("no answer")
    return json.dumps({"translations": [{"id": n, "text": f"EN:{t}"} for n, t in texts.items()]})


def translated_turns(spark, sf_dir):
    """Turns translated in batches, alone where a batch failed, left as they are where that failed too."""
    out, _ = batches.translate(_turns(spark, sf_dir), _scripted_translator, "en", 3, 2)
    return out.select("job_id", "seg_index", "translation", "translation_failed")


def voiced_turns(spark, sf_dir):
    """Turns with their clips: those known, and those made by an engine that refuses short texts."""
    def engine(said: str, voice: str, lang: str) -> float:
        if len(said) < 40:
            raise OSError("too short")
        return len(said) / 16

    turns = _turns(spark, sf_dir).withColumn("translation", F.col("text"))
    out, _ = cache.voiced(turns, _cached(_keyed(spark, sf_dir)), engine, "en", "af_heart")
    return out.select("job_id", "seg_index", "tts_path", "tts_duration")


def _keyed(spark, sf_dir) -> DataFrame:
    return cache.with_keys(_turns(spark, sf_dir).withColumn("translation", F.col("text")), "en", "af_heart")


def clip_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("job_id", "seg_index", "text_sha")


def _cached(keyed: DataFrame) -> DataFrame:
    return keyed.filter("job_id % 2 = 0").select("text_sha").distinct().select(
        "text_sha", F.concat(F.lit("tts/"), "text_sha", F.lit(".wav")).alias("path"), F.lit(1.0).alias("duration"))


def cache_misses(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return cache.misses(keyed, _cached(keyed)).select("text_sha", "voice", "lang")


def cache_unused(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    known = _cached(keyed)
    live = keyed.filter("job_id % 4 = 0").select(F.concat(F.lit("tts/"), "text_sha", F.lit(".wav")).alias("tts_path"))
    return cache.unused(known, live).select("path")


def _jobs(spark, sf_dir) -> DataFrame:
    """Orders as jobs: O queued, P running, F ended."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("n"),
                                                   F.col("o_orderstatus").alias("s"), F.unix_timestamp("o_orderdate").cast("double").alias("t"))
    at = lambda seq, rows, kind, later, **v: queue.event(rows, kind, F.col("t") + later, F.lit(seq), **v)
    begun = orders.filter("s <> 'O'")
    log = at(1, orders, "created", 0, url=F.concat(F.lit("u/"), "id"), params=F.lit("{}"))
    log = log.unionByName(at(2, begun, "claimed", 10)).unionByName(
        at(3, begun, "heartbeat", F.col("n") % 1000, stage=F.lit("asr"), progress=(F.col("n") % 13) / 10))
    status = F.when(F.col("n") % 3 == 0, "failed").otherwise("done")
    log = log.unionByName(at(4, orders.filter("s = 'F'"), "finished", 2000, status=status, warnings=(F.col("n") % 4).cast("int"),
                             error=F.when(F.col("n") % 3 == 0, "broken")))
    again = orders.filter("s = 'F' and n % 7 = 0")
    return queue.current(log.unionByName(at(5, again, "requeued", 3000)))


def queue_stats(spark, sf_dir):
    return queue.stats(_jobs(spark, sf_dir))


def queue_public(spark, sf_dir):
    return queue.public(_jobs(spark, sf_dir), NOW).select("id", "status", "stage", "progress", "error", "warnings", "elapsed", "is_terminal")


def queue_recent(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return queue.recent(_jobs(spark, sf_dir), 25).select("id", "status", "created_at")


def queue_next(spark, sf_dir):
    return queue.claim_next(_jobs(spark, sf_dir)).select("id", "created_at")


def queue_stale(spark, sf_dir):
    return queue.stale(_jobs(spark, sf_dir), NOW).select("id")


def queue_expired(spark, sf_dir):
    return queue.expired(_jobs(spark, sf_dir), NOW, 1000.0).select("id")


def queue_cancellations(spark, sf_dir):
    return queue.cancellations(_jobs(spark, sf_dir))


def invalidated_stages(spark, sf_dir):
    """Each part changes the knobs whose number divides its key by turns."""
    n = F.col("p_partkey")
    old = F.struct(*[F.lit(0).alias(k) for k in KNOBS])
    new = F.struct(*[F.when(n % (i + 7) == 0, 1).otherwise(0).alias(k) for i, k in enumerate(KNOBS)])
    pairs = table(spark, sf_dir, "part").select("p_partkey", old.alias("old"), new.alias("new"))
    return pairs.select("p_partkey", stages.invalidated(pairs).alias("stage"))


def _cut(spark, sf_dir) -> DataFrame:
    segs = segments.sentences(candidates(spark, sf_dir), P)
    made = cuts.cuts(segs.withColumn("media_end", F.max("end").over(Window.partitionBy("job_id")) + 3.0), P)
    return made.withColumns({
        "translation": F.when((F.col("kind") == "speech") & (F.col("seg_index") % 5 != 4), F.concat(F.lit("T:"), "text")),
        "tts_duration": F.length("text") * 0.0625, "tts_path": F.concat(F.lit("tts/"), "job_id", F.lit("-"), "seg_index", F.lit(".wav"))})


def _rounded(c: str) -> Column:
    return F.round(c, 6).alias(c)


def segment_cuts(spark, sf_dir):
    return _cut(spark, sf_dir).select("job_id", "seg_index", _rounded("src_in"), _rounded("src_out"), "hard_in", "hard_out")


def edit_list(spark, sf_dir):
    return edits.clips(_cut(spark, sf_dir), P).select(
        "job_id", "clip_index", "kind", _rounded("out_start"), _rounded("duration"), _rounded("src_start"), _rounded("src_end"),
        "path", "fade_in", "fade_out")


def plan_stats(spark, sf_dir):
    return edits.plan_stats(edits.parts(_cut(spark, sf_dir), P)).select(
        "job_id", _rounded("source_duration"), _rounded("output_duration"), "translated_segments", "skipped_segments", "hard_splices")


def plan_violations(spark, sf_dir):
    """The first fault of lists damaged on purpose: another kind of fault for each remainder of the job by 8, none for 7."""
    rows = edits.clips(_cut(spark, sf_dir), P)
    first = F.min(F.when(F.col("kind") == "tts", F.col("clip_index"))).over(Window.partitionBy("job_id"))
    rows = rows.withColumns({"kind_of": F.pmod("job_id", F.lit(8)), "first_voice": first})

    def damaged(column: str, kind: int, at: Column | int, value: Column) -> dict[str, Column]:
        return {column: F.when((F.col("kind_of") == kind) & (F.col("clip_index") == at), value).otherwise(F.col(column))}

    for change in (damaged("out_start", 0, 1, F.col("out_start") + 0.5), damaged("duration", 1, 1, F.lit(-1.0)), damaged("src_start", 2, 0, F.lit(None)),
                   damaged("src_end", 3, 0, F.col("src_start") - 1), damaged("src_end", 4, 0, F.col("src_end") + 0.5),
                   damaged("path", 5, F.col("first_voice"), F.lit(None)), damaged("path", 6, 0, F.lit("x")) | damaged("kind", 6, 0, F.lit("tts"))):
        rows = rows.withColumns(change)
    return edits.violations(rows)


def excerpt_list(spark, sf_dir):
    """The edit list of the segments around each job's fourth."""
    return edits.clips(_cut(spark, sf_dir), P, selected=segments.in_excerpt(3)).select("job_id", "clip_index", "kind", _rounded("out_start"), _rounded("duration"), _rounded("src_start"), "fade_in")


def freeze_times(spark, sf_dir):
    return edits.freeze_times(edits.clips(_cut(spark, sf_dir), P)).select("job_id", "clip_index", _rounded("freeze_at"))


def sample_places(spark, sf_dir):
    """Of durations rounded to microseconds, so that the last digit of a sum can't turn a half."""
    rows = edits.clips(_cut(spark, sf_dir), P).withColumn("duration", F.round("duration", 6))
    return edits.sample_places(rows, 24_000).select("job_id", "clip_index", "n_samples", "first_sample")


def lyric_lines(spark, sf_dir):
    rows = edits.clips(_cut(spark, sf_dir), P).withColumn("out_start", F.round("out_start", 4))
    return edits.lyrics(rows)


def _signals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"))


def signal_levels(spark, sf_dir):
    rows = _signals(spark, sf_dir).select("vec_id", F.posexplode(signal.frames(F.col("samples"), 8, 4)).alias("frame", "level"))
    return rows.select("vec_id", "frame", F.round(F.col("level").cast("double"), 5).alias("level"))


def signal_peaks(spark, sf_dir):
    return _signals(spark, sf_dir).select("vec_id", signal.peak(F.col("samples")).alias("peak"),
                                          F.size(signal.fit(F.col("samples"), F.lit(80))).alias("fitted"))


def signal_percentiles(spark, sf_dir):
    """Loudness of each signal: the upper quartile of its levels above silence, or of all where all are silent."""
    quieted = F.when(F.col("vec_id") % 7 == 0, F.transform("samples", lambda x: (x * 0.001).cast("float"))).otherwise(F.col("samples"))
    rows = _signals(spark, sf_dir).withColumn("samples", quieted)
    return rows.select("vec_id", F.round(signal.loudness(signal.frames(F.col("samples"), 8, 4)), 5).alias("level"))


def signal_quietest(spark, sf_dir):
    """The quietest frame of each signal, nearest to its middle."""
    x = F.col("samples")
    rows = _signals(spark, sf_dir).withColumn("q", signal.quietest(x, RATE, F.size(x) / (2.0 * RATE)))
    return rows.select("vec_id", F.round("q.at", 6).alias("at"), F.round("q.level", 5).alias("level"))


def signal_matched(spark, sf_dir):
    """Signals brought to one loudness and faded."""
    x = F.col("samples")
    even = _signals(spark, sf_dir).withColumn("samples", signal.matched(x, signal.loudness_of(x, RATE), F.lit(0.1)))
    return even.select("vec_id", F.transform(signal.fade(x, F.lit(4), F.lit(3)), lambda v: signal.rounded(v.cast("double"), 4)).alias("samples"))


#: Embeddings as sound: 64 samples a chunk, 16 chunks a job, so many samples a second.
RATE, CHUNK, CHUNKS_OF_JOB = 200, 64, 16


def _sound(spark, sf_dir) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.floor(n / CHUNKS_OF_JOB).alias("job_id"), (n % CHUNKS_OF_JOB).cast("int").alias("chunk_no"),
                                                     F.col("embedding").alias("samples"))


def _sound_spans(audio: DataFrame, n: int, step: float, length: float) -> DataFrame:
    """``n`` spans of each job, a ``step`` apart, each longer than the one before."""
    k = F.col("span")
    return (audio.select("job_id").distinct().withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .select("job_id", "span", (k * step - 0.05).alias("low"), (k * step - 0.05 + (k % 4 + 1) * length).alias("high")))


def seam_cuts(spark, sf_dir):
    """Quiet places near the middles of spans of the sound, across its chunks."""
    audio = _sound(spark, sf_dir)
    bounds = _sound_spans(audio, 10, 0.55, 0.1).select("job_id", F.col("span").alias("seg_index"), "low", "high", ((F.col("low") + F.col("high")) / 2).alias("centre"),
                                                       F.lit("seam").alias("regime"))
    found = cuts.quiet_seams(bounds, audio, RATE, CHUNK)
    return found.select("job_id", "seg_index", F.round("cut", 6).alias("cut"), F.round("level", 5).alias("level"))


def heard_bridges(spark, sf_dir):
    """Whether spans of the sound, every second job's turned down, carry content."""
    audio = _sound(spark, sf_dir).withColumn("samples", F.when(F.col("job_id") % 2 == 0, F.transform("samples", lambda x: (x * 0.02).cast("float"))).otherwise(F.col("samples")))
    return dub.Audio(audio, RATE, CHUNK).content(_sound_spans(audio, 8, 0.5, 0.45))


def _sound_clips(audio: DataFrame) -> DataFrame:
    """Per job: source sound, silence, a voice, silence, source sound."""
    made = [("source", 0.0, 1.503, 0.1, 1.603, None, 0.01, 0.025), ("silence", 1.503, 0.25, None, None, None, 0.0, 0.0), ("tts", 1.753, 0.4, None, None, "v", 0.02, 0.02),
            ("silence", 2.153, 0.35, None, None, None, 0.0, 0.0), ("source", 2.503, 1.2, 2.0, 3.2, None, 0.01, 0.0)]
    rows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for c, t, v in zip(
        ("clip_index", "kind", "out_start", "duration", "src_start", "src_end", "path", "fade_in", "fade_out"),
        ("int", "string", "double", "double", "double", "double", "string", "double", "double"), (i, *m))]) for i, m in enumerate(made)])
    return audio.select("job_id").distinct().select("job_id", F.inline(rows))


def rendered_levels(spark, sf_dir):
    """Samples of each rendered chunk of sound, with one embedding as every job's voice."""
    audio = _sound(spark, sf_dir)
    voices = table(spark, sf_dir, "embeddings").filter("vec_id = 3").select(F.lit("v").alias("path"), F.col("embedding").alias("voice"))
    clips = _sound_clips(audio)
    out = render.signals(render.clip_samples(clips, audio, voices, RATE, CHUNK, match_loudness=False), clips, RATE, CHUNK)
    return out.select("job_id", "chunk_no", F.size("samples").alias("n"), F.round(signal.level(F.col("samples")).cast("double"), 4).alias("level"))


def event_runs(spark, sf_dir):
    return sessions.runs(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


def event_keys(spark, sf_dir):
    return sessions.first_of_key(table(spark, sf_dir, "events").select("user_id", "event_type").withColumn(
        "key", F.concat_ws("/", "user_id", "event_type")), "key", "ts").select("key")


QUERIES = {f.__name__: f for f in (
    sentences, constrained_segments, merged_segments, divided_segments, word_chunks, boundary_scores, ambiguous_boundaries, arbiter_windows, arbitrated_scores, arbitration, detected_probabilities,
    speech_runs, collected_words, kept_lines, invented_lines, degenerate_lines, job_summary, preview_excerpt, word_marks,
    translation_prompts, checked_replies, translated_turns, voiced_turns, clip_keys, cache_misses, cache_unused, queue_stats, queue_public, queue_recent,
    queue_next, queue_stale, queue_expired, queue_cancellations, invalidated_stages, segment_cuts, edit_list, plan_stats,
    plan_violations, excerpt_list, freeze_times, sample_places, lyric_lines, signal_levels, signal_peaks, signal_percentiles,
    signal_quietest, signal_matched, seam_cuts, heard_bridges, rendered_levels, event_runs, event_keys)}
