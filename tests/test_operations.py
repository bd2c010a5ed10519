import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import batches, cache, queue
from wordloom.params import JOB_EVENTS
from wordloom.sources import media


def turns(spark, texts, kinds=None):
    return spark.createDataFrame([(1, i, t, (kinds or {}).get(i, "speech")) for i, t in enumerate(texts)], "job_id long, seg_index int, text string, kind string")


def english(system, prompt, temperature):
    assert "in English" in system and '{"translations"' in system and temperature == 0.2
    lines = prompt.split(":\n")[-1].split("\n")
    return "```json\n" + json.dumps({"translations": [{"id": i, "text": "EN:" + x.split(". ", 1)[1]} for i, x in enumerate(lines)]}) + "\n```"


def translated(spark, texts, completer, **how):
    out, warnings = batches.translate(turns(spark, texts, how.pop("kinds", None)), completer, "en", **how)
    return [r["translation"] for r in out.orderBy("seg_index").collect()], warnings.count()


def test_batches_and_context(spark):
    got = batches.prompts(batches.with_batches(turns(spark, [f"w{i}" for i in range(6)]), 3, 2), "es").orderBy("batch").collect()
    assert len(got) == 2 and "w1" in got[1]["prompt"] and "w0" not in got[1]["prompt"] and got[1]["prompt"].endswith("0. w3\n1. w4\n2. w5")
    assert "into Spanish" in got[0]["prompt"] and "context" not in got[0]["prompt"]
    assert batches.prompts(batches.with_batches(turns(spark, [f"w{i}" for i in range(10)]), 4), "en").count() == 3


def test_whole_batch(spark):
    assert translated(spark, ["a", "b", "c"], english, size=2) == (["EN:a", "EN:b", "EN:c"], 0)


def test_skipped_segments_stay_out(spark):
    assert translated(spark, ["a", "b"], english, kinds={0: "skip"}) == ([None, "EN:b"], 0)


def test_failed_batch_is_asked_singly(spark):
    def flaky(system, prompt, temperature):
        if "these 1 sentences" not in prompt:
            raise OSError("down")
        return english(system, prompt, temperature)

    assert translated(spark, ["a", "b", "c"], flaky, size=3) == (["EN:a", "EN:b", "EN:c"], 1)


def test_short_reply_is_asked_singly(spark):
    def short(*asked):
        found = json.loads(english(*asked)[8:-4])["translations"]
        return json.dumps({"translations": found[:-1] if len(found) > 1 else found})

    assert translated(spark, ["a", "b"], short, size=2) == (["EN:a", "EN:b"], 1)


def test_always_failing_keeps_source(spark):
    def broken(system, prompt, temperature):
        raise OSError("down")

    assert translated(spark, ["a", "b"], broken, size=2) == (["a", "b"], 3)


def test_ids_must_be_complete(spark):
    rows = [(1, 0, 2, '{"translations":[{"id":0,"text":"a"},{"id":2,"text":"b"}]}'), (2, 0, 2, '{"translations":[{"id":1,"text":"a"},{"id":0,"text":" b "}]}'),
            (3, 0, 1, '{"translations":[{"id":0,"text":"x"},{"id":0,"text":"y"}]}'), (4, 0, 1, "no"), (5, 0, 1, None)]
    got = batches.checked(spark.createDataFrame(rows, "job_id long, batch int, n int, reply string")).collect()
    assert sorted((r["job_id"], r["place"], r["translation"]) for r in got) == [(2, 0, "b"), (2, 1, "a"), (3, 0, "y")]


def voiced_turns(spark, texts):
    return turns(spark, texts).withColumn("translation", F.col("text"))


def test_cache(spark):
    segs = voiced_turns(spark, ["a", "b", "a"])
    known = cache.with_keys(segs.filter("text = 'b'"), "en", "af_heart").select("text_sha", F.lit("tts/b.wav").alias("path"), F.lit(2.0).alias("duration"))
    out, made = cache.voiced(segs, known, lambda t, v, lang: len(t) * 1.5, "en", "other")
    got = out.orderBy("seg_index").collect()
    assert [r["tts_duration"] for r in got] == [1.5, 2.0, 1.5] and made.count() == 1
    assert cache.unused(known, out).isEmpty() and cache.unused(known, out.filter("text = 'a'")).count() == 1


def test_failed_synthesis_leaves_no_clip(spark):
    def engine(text, voice, lang):
        raise OSError("gone")

    none = spark.createDataFrame([], "text_sha string, path string, duration double")
    out, made = cache.voiced(voiced_turns(spark, ["a"]), none, engine, "en", "af_heart")
    assert out.first()["tts_path"] is None and made.first()["error"] == "gone"


def test_keys_differ(spark):
    keys = {cache.with_keys(voiced_turns(spark, [t]), lang, "x").first()["text_sha"] for t, lang in (("a", "en"), ("b", "en"), ("a", "es"))}
    assert len(keys) == 3
    with pytest.raises(Exception, match="no voice for ru"):
        cache.with_keys(voiced_turns(spark, ["a"]), "ru", "x").collect()


def log(spark, *events):
    fields = [x.split()[0] for x in JOB_EVENTS.split(", ")]
    rows = [tuple({"seq": i, "id": e[0], "kind": e[1], "at": float(e[2]), **(e[3] if len(e) > 3 else {})}.get(f) for f in fields) for i, e in enumerate(events)]
    return queue.current(spark.createDataFrame(rows, JOB_EVENTS))


def test_queue(spark):
    jobs = log(spark, ("a", "created", 1, {"url": "u"}), ("b", "created", 2, {"url": "v"}))
    assert queue.claim_next(jobs).first()["id"] == "a"
    jobs = log(spark, ("a", "created", 1), ("a", "claimed", 2))
    assert queue.claim_next(jobs).isEmpty()
    job = log(spark, ("a", "created", 1), ("a", "claimed", 2), ("a", "heartbeat", 3, {"stage": "asr", "progress": 3.7})).first()
    assert (job["progress"], job["stage"], job["heartbeat_at"]) == (1.0, "asr", 3.0)


def test_requeue_clears(spark):
    job = log(spark, ("a", "created", 1), ("a", "claimed", 2), ("a", "cancel", 3), ("a", "finished", 4, {"status": "failed", "error": "x"}), ("a", "requeued", 5)).first()
    assert job["status"] == "queued" and not job["cancel_requested"]
    assert all(job[c] is None for c in ("started_at", "finished_at", "heartbeat_at", "error", "stage"))


def test_cancel_reap_purge_stats(spark):
    day = 86_400.0
    jobs = log(spark, ("q", "created", 99 * day), ("r", "created", 1 * day), ("r", "claimed", 99 * day), ("d", "created", 60 * day), ("d", "finished", 61 * day, {"status": "done"}),
               ("n", "created", 100 * day), ("n", "finished", 100 * day, {"status": "done"}), ("p", "created", 1), ("p", "purged", 2))
    assert {r["id"]: (r["kind"], r["accepted"]) for r in queue.cancellations(jobs).collect()} == {
        "q": ("finished", True), "r": ("cancel", True), "d": (None, False), "n": (None, False)}
    assert [r["id"] for r in queue.stale(jobs, 99 * day + 1, 0.0).collect()] == ["r"] and queue.stale(jobs, 99 * day + 1, 300.0).isEmpty()
    assert [r["id"] for r in queue.expired(jobs, 100 * day, 7.0).collect()] == ["d"]
    assert {r["status"]: r["n"] for r in queue.stats(jobs).collect()} == {"queued": 1, "running": 1, "done": 2}
    assert [r["id"] for r in queue.recent(jobs, 2).collect()] == ["n", "q"]
    assert {r["id"]: r["elapsed"] for r in queue.public(jobs, 99 * day + 2.25).collect()} == {"q": 0.0, "r": 2.2, "d": 0.0, "n": 0.0}


def test_sources(spark):
    urls = spark.createDataFrame([(1, "ok"), (2, "long"), (3, "gone")], "job_id long, url string")

    def site(url):
        if url == "gone":
            raise OSError("404")
        return {"title": url, "duration": 5400 if url == "ok" else 5400.5}

    assert [r["url"] for r in media.admitted(media.probe(urls, site)).collect()] == ["ok"]
    got = media.recognise(urls.filter("job_id = 1"), lambda u: [{"text": "a", "timestamp": (0.0, None)}, {"text": "b"}]).collect()
    assert [(r["pos"], r["text"], r["start"], r["end"]) for r in got] == [(0, "a", 0.0, None), (1, "b", None, None)]
    with pytest.raises(Exception, match="no speech"):
        media.recognise(urls, lambda u: []).collect()


def test_fetched_files(spark):
    urls = spark.createDataFrame([(1, "ok"), (2, "gone")], "job_id long, url string")

    def site(url):
        if url == "gone":
            raise OSError("404")
        return {"source.wav": b"w", "source.info.json": b"{}", "source.webm": b"m", "source.mkv": b"k", "cover.jpg": b"c"}

    files = media.fetch(urls, site)
    assert [tuple(r) for r in media.first_media(files).collect()] == [(1, "source.mkv", bytearray(b"k"))]
    assert [(r["job_id"], r["error"]) for r in files.filter("error is not null").collect()] == [(2, "404")]


def test_codecs(spark):
    files = spark.createDataFrame([(1, bytearray(range(10))), (2, bytearray(b""))], "job_id long, content binary")
    chunks = media.decoded(files, lambda data, rate: np.frombuffer(bytes(data), np.uint8) / rate, 4, 4)
    assert [(r["job_id"], r["chunk_no"], list(r["samples"])) for r in chunks.orderBy("job_id", "chunk_no").collect()] == [
        (1, 0, [0.0, 0.25, 0.5, 0.75]), (1, 1, [1.0, 1.25, 1.5, 1.75]), (1, 2, [2.0, 2.25]), (2, 0, [])]
    back = media.encoded(chunks, lambda parts, rate: (np.concatenate(list(parts)) * rate).astype(np.uint8).tobytes(), 4)
    assert {r["job_id"]: bytes(r["content"]) for r in back.collect()} == {1: bytes(range(10)), 2: b""}
