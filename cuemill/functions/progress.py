"""Column functions on states, progress, messages and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import _col, trim
from cuemill.functions.timecode import half_up
from cuemill.schema import FRAME_RATES, LANGUAGES, STEPS, VIDEO_ENDINGS

#: Defaults of settings that are not set, and the most frames that an outro may overlap.
DEFAULTS = {"transcription_language": "sk", "fps": 23.976, "outro_overlap_frames": 4, "outro_enabled": True}
MOST_OVERLAP = 30
#: How far durations may differ when a video is sent again.
DURATION_TOLERANCE_MS = 500


def clamped(percent: Column | str) -> Column:
    """(B25)"""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), _col(percent)))


def rescaled(stage: Column | str, p: Column | str, done: Column | str, total: Column | str) -> Column:
    """A stage's own progress (a share, percent or count) on the scale of its job."""
    p, share = _col(p), _col(done) / _col(total)
    return (
        F.when(_col(stage) == "asr", 10 + half_up(p * 0.8))
        .when(_col(stage) == "bundle", 5 + half_up(p * 15))
        .when(_col(stage) == "render", 25 + half_up(p * 70))
        .when(_col(stage) == "correct", half_up(share * 80))
        .when(_col(stage) == "translate", 90 + half_up(share * 8))
    )


def bar_percents(output: Column | str) -> Column:
    """The percentages of a progress bar's complete lines, in order; a line that no end closes yet does not count."""
    lines = F.split(_col(output), r"[\r\n]")
    full = F.slice(lines, F.lit(1), F.size(lines) - 1)
    seen = F.transform(full, lambda x: F.nullif(F.regexp_extract(x, r"([0-9]+)%\|", 1), F.lit("")).cast("int"))
    return F.filter(seen, lambda x: x.isNotNull())


def age_label(then: Column | str, now: Column | str) -> Column:
    """``just now``, minutes, hours, else the day (B28); both are timestamps."""
    ms = F.unix_millis(_col(now)) - F.unix_millis(_col(then))
    whole = lambda n: F.call_function("div", ms, F.lit(n))
    return (
        F.when(ms < 60_000, "just now")
        .when(ms < 3_600_000, F.format_string("%dm ago", whole(60_000)))
        .when(ms < 86_400_000, F.format_string("%dh ago", whole(3_600_000)))
        .otherwise(F.date_format(_col(then), "yyyy-MM-dd"))
    )


def is_retryable(message: Column | str) -> Column:
    """(B35)"""
    m = _col(message)
    return m.contains("503") | m.contains("429") | m.contains("UNAVAILABLE") | m.contains("RESOURCE_EXHAUSTED")


def is_row_mismatch(message: Column | str) -> Column:
    """(B35)"""
    return _col(message).contains("row mismatch")


def failure_kind(message: Column | str) -> Column:
    """``overloaded``, ``row_count`` or ``other``."""
    m = _col(message)
    return F.when(m.contains("503") | m.contains("UNAVAILABLE"), "overloaded").when(m.contains("Chunk validation"), "row_count").otherwise("other")


def step_status(step: Column | str, active: Column | str) -> Column:
    """``done``, ``active`` or ``pending``, by the places in the list of steps (B36); unknown names stand before all."""
    place = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, STEPS)), _col(c)), F.lit(0))
    return F.when(place(step) < place(active), "done").when(place(step) == place(active), "active").otherwise("pending")


def active_step(state: Column | str, sub_view: Column | str) -> Column:
    """(B36)"""
    return F.when(_col(state) == "READY", F.when(_col(sub_view) == "clips", "CLIPS").otherwise("REVIEW")).otherwise(_col(state))


def with_default(name: str, value: Column | str) -> Column:
    """(B37)"""
    return F.coalesce(_col(value), F.lit(DEFAULTS[name]))


def valid_language(new: Column | str, current: Column | str) -> Column:
    """The new language if it is known, else the current one."""
    return F.when(_col(new).isin(LANGUAGES), _col(new)).otherwise(_col(current))


def valid_fps(new: Column | str, current: Column | str) -> Column:
    """(B38)"""
    return F.when(_col(new).isin(FRAME_RATES), _col(new)).otherwise(_col(current))


def valid_overlap(new: Column | str, current: Column | str) -> Column:
    """Rounded and from 0 to 30, else the current one."""
    whole = half_up(_col(new))
    return F.when(whole.between(0, MOST_OVERLAP), whole).otherwise(_col(current))


def is_same_length(old: Column | str, new: Column | str) -> Column:
    """Whether a video that is sent again may be the same: durations that are known differ little."""
    return F.coalesce(F.abs(_col(old) - _col(new)) <= DURATION_TOLERANCE_MS, F.lit(True))


def is_video(name: Column | str) -> Column:
    """By the ending, in lower case."""
    return F.lower(F.element_at(F.split(_col(name), r"\."), -1)).isin(VIDEO_ENDINGS)


def is_rendered_file(name: Column | str) -> Column:
    """(C08)"""
    return _col(name).startswith("output_") & _col(name).endswith(".mp4")


def rendered_key(name: Column | str) -> Column:
    """The key in a rendered file's name."""
    return F.regexp_extract(_col(name), r"^output_(.*)\.mp4$", 1)


def nonblank(value: Column | str) -> Column:
    """Null instead of a blank text."""
    return F.when(trim(value) != "", _col(value))
