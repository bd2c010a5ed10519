"""Parameters, stages and relation schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Every knob of a job. Those named in ``STAGE_OF`` invalidate a stage; the others only re-plan."""

    target_lang: str = "en"
    segmentation_mode: str = "sentence"
    max_words_per_chunk: int = 12
    min_words: int = 2
    min_duration: float = 1.2
    max_duration: float = 15.0
    max_words: int = 40
    never_merge_across_gap: float = 2.0
    sat_threshold: float = 0.5
    pause_weight: float = 0.35
    pause_saturation: float = 0.5
    llm_arbitration: bool = True
    gray_low: float = 0.35
    gray_high: float = 0.65
    voice: str = "af_heart"
    tts_speed: float = 1.0
    pre_gap: float = 0.25
    post_gap: float = 0.35
    head_pad: float = 0.10
    tail_pad: float = 0.15
    splice_fade: float = 0.010
    hard_splice_fade: float = 0.025
    keep_source_gaps: bool = True
    max_source_gap: float = 1.5
    match_loudness: bool = True

    def __post_init__(self) -> None:
        if self.min_words < 1:
            raise ValueError("min_words must be at least 1")
        if self.segmentation_mode not in ("sentence", "words"):
            raise ValueError(f"unknown segmentation mode {self.segmentation_mode!r}")

    def overlay(self, **changes) -> Params:
        """These parameters with the changes that aren't None."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


#: Names of all knobs, as columns of a parameter table.
KNOBS = [f.name for f in fields(Params)]

# Stages in order, and the stage that a changed knob invalidates. The gray zone is
# listed too: it decides which boundaries the arbiter sees.
STAGES = ["fetch", "asr", "segment", "translate", "tts", "render"]
STAGE_OF = {
    **dict.fromkeys(
        ["segmentation_mode", "max_words_per_chunk", "min_words", "min_duration", "max_duration", "max_words",
         "never_merge_across_gap", "sat_threshold", "pause_weight", "pause_saturation", "llm_arbitration",
         "gray_low", "gray_high"], "segment"),
    "target_lang": "translate",
    "voice": "tts",
}

CHUNKS = "job_id long, pos int, text string, start double, end double"
WORDS = "job_id long, word_index int, text string, start double, end double, score double"
CLIPS = ("job_id long, clip_index int, kind string, out_start double, duration double, src_start double, "
         "src_end double, path string, segment_id string, fade_in double, fade_out double, label string")
JOB_EVENTS = ("seq long, id string, kind string, at double, url string, params string, language string, "
              "stage string, progress double, title string, status string, error string, warnings int")
