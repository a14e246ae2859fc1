"""Project archives: ZIP files that hold ``project.json``."""

from __future__ import annotations

import io
import posixpath
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from cuemill.schema import PROJECT
from cuemill.sources.zips import read_pieces, write_pieces

ENTRY = "project.json"


@F.pandas_udf(BinaryType())
def zipped(json: pd.Series) -> pd.Series:
    """An archive with the JSON as its only entry; the same bytes for the same JSON."""

    def one(text: str | None) -> bytes | None:
        if text is None:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(ENTRY), text, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return json.map(one)


@F.pandas_udf(StringType())
def unzipped(content: pd.Series) -> pd.Series:
    """The JSON of an archive; null if it is no ZIP file or lacks the entry."""

    def one(data: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return z.read(ENTRY).decode()
        except (TypeError, KeyError, zipfile.BadZipFile, UnicodeDecodeError):
            return None

    return content.map(one)


@F.pandas_udf(StringType())
def resolved(path: pd.Series, folder: pd.Series) -> pd.Series:
    """A path that may be relative to a folder; absolute ones stay."""
    return pd.Series([None if p is None else posixpath.normpath(posixpath.join(f or "", p)) for p, f in zip(path, folder, strict=True)])


@F.pandas_udf(StringType())
def relative(path: pd.Series, folder: pd.Series) -> pd.Series:
    """A path as seen from a folder."""
    return pd.Series([None if p is None else posixpath.relpath(p, f or "/") for p, f in zip(path, folder, strict=True)])


def parse_archives(files: DataFrame) -> DataFrame:
    """(path, project, error) of files (path, content).

    ``project`` is the document with its video's path resolved against the
    archive's folder; ``error`` says that an archive can't be read.
    """
    return _parsed(files.select("path", unzipped("content").alias("_json")))


def _parsed(texts: DataFrame) -> DataFrame:
    folder = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/[^/]*$", "")
    rows = texts.withColumn("_folder", folder).withColumn("project", F.from_json("_json", PROJECT))
    video = F.when(F.col("project.videoPath").isNotNull(), resolved("project.videoPath", "_folder"))
    error = F.when(F.col("_json").isNull(), F.concat(F.lit(f"no {ENTRY} in "), F.col("path")))
    return rows.select("path", F.col("project").withField("videoPath", video).alias("project"), error.alias("error"))


def read_archives(spark: SparkSession, path: str, suffix: str = ".lusk") -> DataFrame:
    """Archives below a folder (A01); errors stay as rows, so that a bad file doesn't end the job.

    Only the document's entry is unpacked, in pieces; other entries are not kept.
    """
    pieces = read_pieces(spark, path, suffix).withColumn("_own", F.when(F.col("entry") == ENTRY, F.struct("piece", "content")))
    whole = pieces.groupBy("path").agg(F.sort_array(F.collect_list("_own")).alias("_own"))
    # pieces may end inside a character, so bytes are joined first
    text = F.unhex(F.array_join(F.transform("_own", lambda p: F.hex(p["content"])), "")).cast("string")
    return _parsed(whole.select(F.concat(F.lit(path.rstrip("/") + "/"), "path").alias("path"), F.when(F.size("_own") > 0, F.try_validate_utf8(text)).alias("_json")))


def _stored(projects: DataFrame, project: Column | str, path: str) -> DataFrame:
    """(path, json): documents with the video's path made relative to the archive."""
    doc = F.col(project) if isinstance(project, str) else project
    rows = projects.select(path, doc.alias("_p")).withColumn("_folder", F.regexp_replace(path, "/[^/]*$", ""))
    video = F.when(F.col("_p.videoPath").isNotNull(), relative("_p.videoPath", "_folder"))
    return rows.select(F.col(path).alias("path"), F.to_json(F.col("_p").withField("videoPath", video)).alias("json"))


def archive_files(projects: DataFrame, project: Column | str = "project", path: str = "path") -> DataFrame:
    """(path, content) of documents, with the video's path made relative to the archive."""
    return _stored(projects, project, path).select("path", zipped("json").alias("content"))


def write_archives(projects: DataFrame, folder: str, project: Column | str = "project", path: str = "path") -> None:
    """Writes documents as archives, each at its path below a folder that all executors see: all or, if a task fails, none."""
    rows = _stored(projects, project, path)
    write_pieces(rows.select("path", F.lit(0).alias("entry_no"), F.lit(ENTRY).alias("entry"), F.lit(0).alias("piece"), F.col("json").cast("binary").alias("content")), folder)
