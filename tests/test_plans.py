import numpy as np
import pytest
import sound
from pyspark.sql import functions as F

from wordloom import queries
from wordloom.operators import segments
from wordloom.params import Params
from wordloom.plans import cuts, dub, edits, render, stages
from wordloom.sources import wav

RATE, CHUNK = 24_000, 8_192
SEGMENT = ("job_id long, seg_index int, id string, start double, end double, first_seconds double, last_seconds double, "
           "kind string, translation string, tts_path string, tts_duration double")
SIMPLE = [[(1.0, 1.4), (1.5, 2.0)], [(3.0, 3.4), (3.5, 4.0)], [(5.0, 5.6)]]
TIGHT = [[(1.0, 1.4), (1.42, 2.0)], [(2.02, 2.4), (2.42, 3.0)]]


def make(spark, groups, kinds=None, voiced=True):
    rows = []
    for i, g in enumerate(groups):
        rows.append((1, i, f"seg{i:03d}", g[0][0], g[-1][1], g[0][1] - g[0][0], g[-1][1] - g[-1][0], (kinds or {}).get(i, "speech"),
                     f"translation {i}" if voiced else None, f"tts/{i:04d}.wav" if voiced else None, 1.0 if voiced else None))
    return spark.createDataFrame(rows, SEGMENT)


def tone(groups, extra=(), tail=1.0):
    words = [w for g in groups for w in g]
    end = max(b for _, b in [*words, *[(a, b) for a, b, _ in extra]]) + tail
    t = np.arange(int(end * RATE)) / RATE
    x = np.zeros(len(t), np.float32)
    for a, b, hz in [*[(a, b, 180.0) for a, b in words], *extra]:
        at = (t >= a) & (t < b)
        x[at] = 0.4 * np.sin(2 * np.pi * hz * t[at])
    return x


def chunks(spark, x):
    return spark.createDataFrame([(1, n, x[n * CHUNK:(n + 1) * CHUNK].tolist()) for n in range(-(-len(x) // CHUNK))],
                                 "job_id long, chunk_no int, samples array<float>")


def cut(spark, groups, p=Params(), x=None, **how):
    segs = make(spark, groups, **how)
    x = tone(groups) if x is None else x
    media = spark.createDataFrame([(1, len(x) / RATE)], "job_id long, media_end double")
    seams = cuts.quiet_seams(cuts.boundaries(segs, p), chunks(spark, x), RATE, CHUNK)
    return cuts.cuts(segs, p, media, seams)


def test_trims_in_silence(spark):
    got = cut(spark, SIMPLE).orderBy("seg_index").collect()
    assert got[0]["src_out"] == pytest.approx(2.15) and got[1]["src_in"] == pytest.approx(2.90)
    assert not any(r["hard_in"] or r["hard_out"] for r in got)


def test_shared_quiet_seam(spark):
    got = cut(spark, TIGHT).orderBy("seg_index").collect()
    assert got[0]["src_out"] == got[1]["src_in"] and 1.99 <= got[0]["src_out"] <= 2.03


def test_seam_is_what_the_whole_signal_gives(spark):
    rng = np.random.default_rng(0)
    x = tone(TIGHT) + rng.normal(0, 0.01, len(tone(TIGHT))).astype(np.float32)
    bounds = cuts.boundaries(make(spark, TIGHT), Params())
    low, high, centre = bounds.filter("regime = 'seam'").select("low", "high", "centre").first()
    row = cuts.quiet_seams(bounds, chunks(spark, x), RATE, CHUNK).first()
    at, level = sound.quiet_spot(x[int(low * RATE):int(high * RATE)], RATE, centre - low)
    assert (row["cut"], row["level"]) == (pytest.approx(at + low, abs=1e-9), level)


def test_abutting_words_are_a_hard_splice(spark):
    groups = [[(1.0, 1.5)], [(1.5, 2.0)]]
    rows = edits.clips(cut(spark, groups), Params()).filter("kind = 'source'").orderBy("clip_index").collect()
    assert rows[0]["fade_out"] == 0.025 and rows[1]["fade_in"] == 0.025


def test_edit_list(spark):
    made = cut(spark, SIMPLE, kinds={0: "music"})
    rows = edits.clips(made, Params())
    assert edits.violations(rows).isEmpty()
    got = rows.orderBy("clip_index").collect()
    assert [r["kind"] for r in got] == ["source", *["source", "silence", "tts", "silence"] * 2, "source"]
    assert got[-1]["src_end"] == pytest.approx(len(tone(SIMPLE)) / RATE)
    stats = edits.plan_stats(edits.parts(made, Params())).first()
    assert (stats["translated_segments"], stats["skipped_segments"]) == (2, 1)
    freeze = {r["clip_index"]: r["freeze_at"] for r in edits.freeze_times(rows).collect()}
    assert freeze[0] is None and freeze[2] == freeze[3] == got[1]["src_end"]


def test_bridge_and_dead_air(spark):
    groups = [[(1.0, 1.5)], [(12.0, 12.5)]]
    made = cut(spark, groups)
    x = tone(groups, [(2.0, 11.5, 440.0)])
    span = spark.createDataFrame([(1, 0, 1.65, 11.9)], "job_id long, span int, low double, high double")
    loud, quiet = (dub.Audio(chunks(spark, s), RATE, CHUNK).content(span).first()["loud"] for s in (x, tone(groups)))
    assert loud and not quiet
    for keep, n in ((loud, 3), (quiet, 2)):
        rows = edits.clips(made, Params(), keep_bridge=F.lit(keep), keep_outro=F.lit(False))
        assert rows.filter("kind = 'source'").count() == n


def test_preview_of_a_late_segment(spark):
    made = cut(spark, [[(1.0, 1.5)], [(12.0, 12.5)], [(14.0, 14.5)]], voiced=False)
    third = made.filter("seg_index = 2").select("job_id", "id")
    first = lambda zero: edits.clips(made, Params(), selected=third, bridge_from_zero=zero).orderBy("clip_index").first()
    assert first(False)["src_start"] == pytest.approx(13.9) and first(True)["src_start"] == 0.0


def test_list_of_an_excerpt_without_a_join(spark):
    """Segments are chosen where they are: the list isn't computed twice, and equal ids of a job choose nothing else."""
    made = cut(spark, [[(float(i), i + 0.6)] for i in range(1, 12, 2)], kinds={1: "skip"})
    listed = lambda rows, chosen: sorted(map(tuple, edits.clips(rows, Params(), selected=chosen).drop("segment_id").collect()), key=str)
    for index, places in ((0, [0, 2]), (2, [2, 3, 4]), (9, [4, 5])):
        chosen = made.filter(F.col("seg_index").isin(places)).select("job_id", "id")
        assert listed(made, segments.in_excerpt(index)) == listed(made, chosen)
        assert listed(made.withColumn("id", F.lit("same")), segments.in_excerpt(index)) == listed(made, chosen)
        assert [r["seg_index"] for r in segments.excerpt(made, index).orderBy("seg_index").collect()] == places
    assert "Join" not in queries.excerpt_list(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_zero_gaps_emit_no_silence(spark):
    rows = edits.clips(cut(spark, SIMPLE), Params(pre_gap=0.0))
    assert rows.filter("kind = 'silence'").count() == 3 and edits.violations(rows).isEmpty()


@pytest.mark.parametrize("change,problem", [
    (("out_start", "out_start + 0.5"), "not contiguous"), (("path", "cast(null as string)"), "no path"),
    (("src_end", "src_start - 1"), "inverted source range"), (("src_start", "cast(null as double)"), "no source range"),
    (("duration", "-1.0D"), "negative duration")])
def test_violations(spark, change, problem):
    rows = edits.clips(cut(spark, SIMPLE), Params())
    kind = "tts" if problem == "no path" else "source"
    bad = rows.withColumn(change[0], F.when((F.col("kind") == kind) & (F.col("clip_index") >= 1), F.expr(change[1])).otherwise(F.col(change[0])))
    assert edits.violations(bad).first()["problem"] == problem


def test_sample_places_round_half_to_even(spark):
    rows = spark.createDataFrame([(1, 0, 2.5), (1, 1, 3.5)], "job_id long, clip_index int, duration double")
    assert [(r["n_samples"], r["first_sample"]) for r in edits.sample_places(rows, 1).orderBy("clip_index").collect()] == [(2, 0), (4, 2)]


def rendered(spark, rows, x, voices, **how):
    sounding = render.clip_samples(rows, chunks(spark, x), voices, RATE, CHUNK, **how)
    out = render.signals(sounding, rows, RATE, CHUNK)
    got = out.orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in got] == list(range(len(got))) and all(len(r["samples"]) == CHUNK for r in got[:-1])
    return out, np.concatenate([np.asarray(r["samples"], np.float32) for r in got])


def voice_tones(spark, n, seconds=1.0, level=0.2):
    t = np.arange(int(RATE * seconds)) / RATE
    return spark.createDataFrame([(f"tts/{i:04d}.wav", (level * np.sin(2 * np.pi * 880 * t)).tolist(), RATE) for i in range(n)], "path string, voice array<float>, rate int")


def pitch(part):
    return np.abs(np.fft.rfft(part)).argmax() * RATE / len(part)


def test_render(spark, tmp_path):
    groups = [[(1.0, 1.4), (1.5, 2.0)], [(4.0, 4.5)]]
    x = tone(groups)
    rows = edits.clips(cut(spark, groups, x=x), Params(), keep_outro=F.lit(False), keep_bridge=F.lit(False))
    out, y = rendered(spark, rows, x, voice_tones(spark, 2))
    places = {r["clip_index"]: r for r in edits.sample_places(rows, RATE).collect()}
    assert len(y) == sum(r["n_samples"] for r in places.values())
    for i, r in places.items():
        part = y[r["first_sample"]:r["first_sample"] + r["n_samples"]]
        if r["kind"] == "silence":
            assert not part.any()
        else:
            assert abs(pitch(part) - (880 if r["kind"] == "tts" else 180)) < 10
        if r["kind"] == "source":
            a = int(r["src_start"] * RATE)
            assert part == pytest.approx(sound.ramped(x[a:a + len(part)], RATE, r["fade_in"], r["fade_out"]), abs=1e-6)
        if r["kind"] == "tts":
            assert sound.loudness(part, RATE) == pytest.approx(sound.loudness(x, RATE), rel=0.02)
    data = b"".join(bytes(r["content"]) for r in wav.encode_rows(out, RATE).orderBy("chunk_no").collect())
    (tmp_path / "a.wav").write_bytes(data)
    back = wav.read_chunks(spark, str(tmp_path), CHUNK, RATE)
    assert back.agg(F.sum(F.size("samples"))).first()[0] == len(y)
    assert wav.durations(back).first()["seconds"] == wav.probed(spark, str(tmp_path)).first()["seconds"] == pytest.approx(len(y) / RATE)
    assert wav.decode(data)[1] == pytest.approx(np.clip(y, -1, 1), abs=1e-4)


@pytest.mark.parametrize("speed", [0.5, 2.0])
def test_voices_are_stretched_to_the_plan(spark, speed):
    """The plan divides a voice's length by the speed; the whole voice is to be heard in it, at its own pitch."""
    groups = [[(1.0, 1.5)], [(4.0, 4.5)]]
    x, p = tone(groups), Params(tts_speed=speed)
    rows = edits.clips(cut(spark, groups, p, x=x), p, keep_outro=F.lit(False), keep_bridge=F.lit(False))
    _, y = rendered(spark, rows, x, voice_tones(spark, 2), speed=speed, match_loudness=False)
    for r in edits.sample_places(rows.filter("kind = 'tts'").unionByName(rows.filter("kind <> 'tts'")), RATE).filter("kind = 'tts'").collect():
        part = y[r["first_sample"]:r["first_sample"] + r["n_samples"]]
        assert len(part) == int(RATE / speed) and abs(pitch(part) - 880) < 15
        last = part[-len(part) // 5:-RATE // 20]
        assert np.abs(last).max() > 0.1  # heard up to its end, neither cut nor padded


def test_voices_of_another_rate_are_refused(spark):
    groups = [[(1.0, 1.5)]]
    rows = edits.clips(cut(spark, groups), Params())
    with pytest.raises(Exception, match="sample rate 8000"):
        rendered(spark, rows, tone(groups), voice_tones(spark, 1).withColumn("rate", F.lit(8000)))


def test_a_pluggable_stretch(spark):
    groups = [[(1.0, 1.5)]]
    p = Params(tts_speed=2.0)
    rows = edits.clips(cut(spark, groups, p), p)
    _, y = rendered(spark, rows, tone(groups), voice_tones(spark, 1), speed=2.0, match_loudness=False, stretch=lambda x, rate, speed: np.full(int(len(x) / speed), 0.25, np.float32))
    r = edits.sample_places(rows, RATE).filter("kind = 'tts'").first()
    part = y[r["first_sample"]:r["first_sample"] + r["n_samples"]]
    assert part[len(part) // 2] == 0.25


def test_wav_rate_and_channels():
    with pytest.raises(ValueError):
        wav.decode(wav.encode(np.zeros(10, np.float32), 8000), 16000)
    rate, x = wav.decode(wav.encode(np.array([0.5, -0.5], np.float32), 8000))
    assert rate == 8000 and x == pytest.approx([0.5, -0.5], abs=1e-4)


def test_lyrics(spark, tmp_path):
    rows = edits.clips(cut(spark, SIMPLE), Params())
    titles = spark.createDataFrame([(1, "Title")], "job_id long, title string")
    edits.write_lyrics(rows, str(tmp_path / "lrc"), titles)
    lines = [x for f in (tmp_path / "lrc").rglob("part-*") for x in f.read_text().splitlines()]
    assert lines[0] == "[ti:Title]" and len(lines) == 4 and lines[1].endswith("]translation 0")


def test_invalidation(spark):
    p = Params()
    for change, stage in (({"pre_gap": 1.0}, None), ({"min_words": 3}, "segment"), ({"target_lang": "es"}, "translate"), ({"voice": "x"}, "tts"),
                          ({"voice": "x", "min_words": 3, "target_lang": "es"}, "segment"), ({"gray_low": 0.1}, "segment")):
        assert stages.invalidated_from(p, p.overlay(**change)) == stage
    assert p.overlay(voice=None) == p
    with pytest.raises(ValueError):
        Params(min_words=0)
    rows = spark.createDataFrame([(["fetch", "asr", "segment", "tts"], "segment"), (["fetch", "asr"], None)], "done array<string>, stale string")
    assert [r[0] for r in rows.select(stages.stages_left(F.col("done"), F.col("stale"))).collect()] == [["fetch", "asr"], ["fetch", "asr"]]


def test_stage_tables(spark, tmp_path):
    schema = "job_id long, x int"
    assert stages.load_stage(spark, str(tmp_path), "plan", schema).isEmpty()
    for rows in ([(1, 1), (2, 2)], [(2, 3)]):
        stages.save_stage(spark.createDataFrame(rows, schema), str(tmp_path), "plan")
    assert sorted(map(tuple, stages.load_stage(spark, str(tmp_path), "plan", schema).select("job_id", "x").collect())) == [(1, 1), (2, 3)]
