"""Column functions on clips: ranges, frames, layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import _col
from cuemill.functions.timecode import half_up

#: What is added to a clip's end if its trim is not set; the frame of the composition.
TRAILING_MS, WIDTH, HEIGHT = 900, 1080, 1920


def clip_range(start: Column | str = "start_ms", end: Column | str = "end_ms", trim_start: Column | str = "trim_start_delta", trim_end: Column | str = "trim_end_delta") -> tuple[Column, Column]:
    """The effective (start, end) of a clip; an end trim of zero differs from none."""
    return _col(start) + F.coalesce(_col(trim_start), F.lit(0)), _col(end) + F.coalesce(_col(trim_end), F.lit(TRAILING_MS))


def render_key(start: Column, end: Column) -> Column:
    """``start-end`` of an effective range."""
    return F.concat_ws("-", start, end)


def start_frame(start_ms: Column, fps: Column) -> Column:
    return half_up(start_ms / 1000 * fps)


def snapped_ms(start_ms: Column, fps: Column) -> Column:
    """The time of the frame at which a clip starts."""
    return start_frame(start_ms, fps) / fps * 1000


def frames(start_ms: Column, end_ms: Column, fps: Column) -> Column:
    """Frames from the snapped start to the end, one at least."""
    return F.greatest(F.lit(1), F.ceil((end_ms - snapped_ms(start_ms, fps)) / 1000 * fps)).cast("long")


def total_frames(clip_frames: Column, outro_frames: Column, overlap: Column) -> Column:
    """Frames of a clip with its outro, which covers the clip's last ``overlap`` frames; no outro, no overlap."""
    return clip_frames + F.when(outro_frames > 0, outro_frames - overlap).otherwise(0)


def clip_frames_of(total: Column, outro_frames: Column, overlap: Column) -> Column:
    """The inverse of :func:`total_frames`."""
    return total - F.when(outro_frames > 0, outro_frames - overlap).otherwise(0)


def outro_start(clip_frames: Column, outro_frames: Column, overlap: Column) -> Column:
    """(B20)"""
    return clip_frames - F.when(outro_frames > 0, overlap).otherwise(0)


def aspect_ratio(width: Column, height: Column) -> Column:
    """Null unless both sides are above zero."""
    return F.when((width > 0) & (height > 0), width / height)


def is_portrait(ratio: Column) -> Column:
    return F.coalesce(ratio < 1, F.lit(False))


def width_percent(ratio: Column) -> Column:
    """How wide a landscape picture is drawn, in hundredths of the frame's width; 16:9 if not known."""
    return F.lit(float(HEIGHT)) * F.coalesce(ratio, F.lit(16 / 9)) / WIDTH * 100


def fade(frame: Column, clip_frames: Column, fps: Column) -> Column:
    """Volume at a frame: 1, then down to 0 over the last second of the clip."""
    length = half_up(fps)
    begin = clip_frames - length
    return F.when(frame >= begin, F.greatest(F.lit(0.0), 1 - (frame - begin) / length)).otherwise(F.lit(1.0))


def nearest_weight(weights: Column | str, wanted: Column | str) -> Column:
    """The font weight nearest to the wanted one, the earliest of equals."""
    wanted = _col(wanted)
    rows = F.transform(_col(weights), lambda w, i: F.struct(F.abs(w - wanted).alias("d"), i.alias("i"), w.alias("w")))
    return F.array_min(rows)["w"]


def preview_frames(last_end: Column, fps: Column, missing_ms: Column) -> Column:
    """Frames of a preview to one second after the last caption, or of ``missing_ms`` if there is none."""
    ms = F.coalesce(last_end + 1000, missing_ms, F.lit(0))
    return F.greatest(F.lit(1), F.ceil(ms / 1000 * fps)).cast("long")


def whole_seconds(start: Column, end: Column) -> Column:
    """A clip's length for its badge."""
    return half_up((end - start) / 1000)


def tenth_seconds(start: Column, end: Column) -> Column:
    """A clip's length to a tenth of a second, from whole milliseconds."""
    tenths = F.call_function("div", end - start + 50, F.lit(100))
    return F.format_string("%d.%d", F.call_function("div", tenths, F.lit(10)), tenths % 10)
