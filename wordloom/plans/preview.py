"""Previews: a few segments around one, planned and rendered with other pacing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from wordloom.operators import segments
from wordloom.params import Params
from wordloom.plans import render
from wordloom.plans.dub import Audio, plan

#: Knobs that a preview may change: they only pace a plan.
PACING = ("tts_speed", "pre_gap", "post_gap", "head_pad", "tail_pad", "max_source_gap")
#: Segments that a job's page shows.
SHOWN = 200


class SourceCache:
    """The sound of the job asked for last, kept in memory until another is asked for."""

    def __init__(self) -> None:
        self.job_id: int | None = None
        self.audio: Audio | None = None

    def get(self, job_id: int, load: Callable[[int], Audio]) -> Audio:
        if self.audio is None or self.job_id != job_id:
            self.invalidate()
            found = load(job_id)
            self.job_id, self.audio = job_id, replace(found, chunks=found.chunks.persist())
        return self.audio

    def invalidate(self, job_id: int | None = None) -> None:
        """Forget what is kept; with a job, only if it is that job's."""
        if self.audio is not None and job_id in (None, self.job_id):
            self.audio.chunks.unpersist()
            self.job_id = self.audio = None


def excerpt(spoken: DataFrame, audio: Audio, voices: DataFrame, p: Params, index: int = 0, *, stretch: render.Stretch = render.overlap_add,
            **pacing: float | None) -> DataFrame:
    """``job_id, chunk_no, samples`` of the segments around the ``index``-th speech segment of each job.

    ``pacing`` changes knobs of :data:`PACING`; None leaves one as it is. Another knob, or no speech at all, is a ValueError.
    """
    if unknown := set(pacing) - set(PACING):
        raise ValueError(f"a preview can't change {', '.join(sorted(unknown))}")
    own = p.overlay(**pacing)
    around = segments.excerpt(spoken, index)
    if around.isEmpty():
        raise ValueError("no speech to preview")
    clips = plan(spoken, audio, own, around.select("job_id", "id"))["clips"]
    sounding = render.clip_samples(clips, audio.chunks, voices, audio.rate, audio.chunk, match_loudness=own.match_loudness, speed=own.tts_speed, stretch=stretch)
    return render.signals(sounding, clips, audio.rate, audio.chunk)


def shown(segs: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first segments of a job, for its page: the limit is the feature."""
    return segs.orderBy("seg_index").limit(n)
