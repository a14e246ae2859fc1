"""Schemas of the tables and nested records, and the small fixed tables.

Order is part of the data: each relation carries ``pos``, the place of its row.
Times are whole milliseconds from the start of the medium.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType, TimestampType

TEXT, INT, LONG, REAL, FLAG = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()


def record(**fields: DataType) -> StructType:
    """A schema from names and types, in order."""
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


WORD = dict(word=TEXT, start_ms=LONG, end_ms=LONG)
CAPTION = dict(text=TEXT, start_ms=LONG, end_ms=LONG, timestamp_ms=LONG, confidence=REAL)
BLOCK = dict(text=TEXT, start_ms=LONG, end_ms=LONG)
STYLES = record(font_size=INT, highlight_color=TEXT, text_color=TEXT, text_transform=TEXT, caption_position=INT, font_weight=INT, font_family=TEXT)

WORDS = record(project_id=TEXT, pos=INT, **WORD)
CAPTIONS = record(project_id=TEXT, pos=INT, **CAPTION)
BLOCKS = record(project_id=TEXT, block_no=INT, **BLOCK)
CLIPS = record(
    project_id=TEXT,
    pos=INT,
    title=TEXT,
    start_ms=LONG,
    end_ms=LONG,
    hook_text=TEXT,
    caption_edits=MapType(INT, TEXT),
    caption_offset=LONG,
    trim_start_delta=LONG,
    trim_end_delta=LONG,
    speaker_offset_x=REAL,
)
RENDERS = record(project_id=TEXT, render_key=TEXT, status=TEXT, progress=REAL, message=TEXT, output_url=TEXT)
PAGES = record(project_id=TEXT, page_no=INT, text=TEXT, start_ms=LONG, duration_ms=LONG, tokens=ArrayType(record(text=TEXT, from_ms=LONG, to_ms=LONG)))
PROGRESS = record(session_id=TEXT, ts=TimestampType(), state=TEXT, progress=REAL, message=TEXT)
REGISTRY = record(project_id=TEXT, project_path=TEXT, video_name=TEXT, state=TEXT, updated_at=TEXT, thumbnail=TEXT, missing=FLAG)
SETTINGS = record(
    transcription_language=TEXT,
    correction_prompt=TEXT,
    viral_clips_prompt=TEXT,
    viral_clips_manual_prompt=TEXT,
    fps=REAL,
    outro_overlap_frames=REAL,
    outro_enabled=FLAG,
    caption_styles=STYLES,
)
#: What a speech recogniser writes, in seconds.
ASR = record(segments=ArrayType(record(start=REAL, end=REAL, text=TEXT, words=ArrayType(record(word=TEXT, start=REAL, end=REAL, score=REAL)))))
#: The document that a project archive holds.
PROJECT = record(
    version=INT,
    projectId=TEXT,
    state=TEXT,
    createdAt=TEXT,
    updatedAt=TEXT,
    videoPath=TEXT,
    videoName=TEXT,
    videoDurationMs=LONG,
    videoWidth=INT,
    videoHeight=INT,
    transcript=record(text=TEXT, words=ArrayType(record(word=TEXT, startMs=LONG, endMs=LONG))),
    captions=ArrayType(record(text=TEXT, startMs=LONG, endMs=LONG, timestampMs=LONG, confidence=REAL)),
    viralClips=ArrayType(record(title=TEXT, startMs=LONG, endMs=LONG, hookText=TEXT)),
)

# Words before which a subtitle line may break, and words that it may not put first, by language.
BREAK_BEFORE = {
    "sk": (
        "ale alebo že keď aby pretože lebo ak ani no však teda takže preto hoci kde keďže ktorý ktorá ktoré ktorí ktorým ktorých čo kto "
        "na do od pre pri po za bez cez nad pod medzi"
    ).split(),
    "cs": (
        "ale nebo že když aby protože pokud jenže ani no však tedy takže proto ačkoli kde jelikož který která které kteří kterým kterých co kdo "
        "na do od pro při po za bez přes nad pod mezi"
    ).split(),
    "en": (
        "but or and that when because since if although though while so yet nor which who whom whose where what how "
        "in on at to for with from by about into through during before after between under over"
    ).split(),
}
NO_BREAK_BEFORE = {"sk": "a i v k s z u o".split(), "cs": "a i v k s z u o".split(), "en": ["a", "I"]}

# The states that each state may pass to.
TRANSITIONS = {
    "IDLE": ["UPLOADING"],
    "UPLOADING": ["TRANSCRIBING"],
    "TRANSCRIBING": ["ALIGNING"],
    "ALIGNING": ["READY"],
    "READY": ["ALIGNING"],
    "RENDERING": ["EXPORTED", "READY"],
    "EXPORTED": ["READY"],
}

# The state in which each operation is allowed.
GUARDS = {
    "upload": "IDLE",
    "transcribe": "UPLOADING",
    "run_model": "ALIGNING",
    "render": "READY",
    "regenerate": "READY",
}

# The weights of each font.
FONTS = {
    "Montserrat": [400, 500, 600, 700, 800, 900],
    "Inter": [400, 500, 600, 700, 800, 900],
    "Oswald": [400, 500, 600, 700],
    "Bebas Neue": [400],
    "Poppins": [400, 500, 600, 700, 800, 900],
    "Bangers": [400],
    "Space Mono": [400, 700],
    "Space Grotesk": [400, 500, 600, 700],
}

# Frame rates that settings accept, languages, and the endings of video files.
FRAME_RATES = [23.976, 24.0, 25.0, 29.97, 30.0, 50.0, 59.94, 60.0]
LANGUAGES = ["sk", "cs", "en"]
VIDEO_ENDINGS = ["mp4", "mov", "mkv", "avi", "webm"]
STEPS = ["UPLOADING", "TRANSCRIBING", "ALIGNING", "REVIEW", "CLIPS"]


def transitions(spark: SparkSession) -> DataFrame:
    """(state, new_state): the allowed transitions, 8 rows."""
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "state STRING, new_state STRING")


def guards(spark: SparkSession) -> DataFrame:
    """(op, needed_state): 5 rows."""
    return spark.createDataFrame(list(GUARDS.items()), "op STRING, needed_state STRING")


def fonts(spark: SparkSession) -> DataFrame:
    """(name, weights): 8 rows."""
    return spark.createDataFrame(list(FONTS.items()), "name STRING, weights ARRAY<INT>")
