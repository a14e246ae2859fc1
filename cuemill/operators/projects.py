"""Registries, rendered files and folders: lookups between lists of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.progress import is_rendered_file, nonblank, rendered_key
from cuemill.functions.text import safe_name


def download_names(files: DataFrame, clips: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, file, filename): a name from the clip's title for each rendered file, its key if no clip has it.

    ``files``: (key, file); ``clips``: (key, pos, render_key, title).  Of clips
    with one key the last counts.
    """
    last = clips.groupBy(key, "render_key").agg(F.max_by("title", "pos").alias("title"))
    rows = files.where(is_rendered_file("file")).withColumn("render_key", rendered_key("file")).join(last, [key, "render_key"], "left")
    return rows.select(key, "file", F.concat(F.coalesce(safe_name("title", "render_key"), "render_key"), F.lit(".mp4")).alias("filename"))


def orphaned(folders: DataFrame, registry: DataFrame, key: str = "project_id") -> DataFrame:
    """Folders of projects that the registry lacks."""
    return folders.join(registry.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def synced_renders(renders: DataFrame, files: DataFrame, active: DataFrame, key: str = "project_id") -> DataFrame:
    """Render states that still hold (D04): exported ones whose file (key, file) is there, and ones under way
    if the project has an active render; others stay as they are."""
    have = files.select(key, rendered_key("file").alias("render_key")).distinct()
    gone = renders.where("status = 'exported'").join(have, [key, "render_key"], "left_anti").select(key, "render_key")
    stuck = renders.where("status = 'rendering'").join(active.select(key).distinct(), key, "left_anti").select(key, "render_key")
    return renders.join(gone.unionByName(stuck).distinct(), [key, "render_key"], "left_anti")


def checked_registry(registry: DataFrame, archives: DataFrame) -> DataFrame:
    """Registry entries with ``missing`` set anew; where the file is there and the entry lacks a name or a picture,
    name, state and time come from the archive if it has them (D14, A03).

    ``archives``: (project_path, video_name, state, updated_at) of the files that exist.
    """
    found = archives.select("project_path", *[F.col(c).alias(f"_{c}") for c in ("video_name", "state", "updated_at")], F.lit(True).alias("_there"))
    rows = registry.join(found, "project_path", "left")
    mend = F.col("_there") & (nonblank("video_name").isNull() | nonblank("thumbnail").isNull())
    better = {c: F.when(mend, F.coalesce(nonblank(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in ("video_name", "state", "updated_at")}
    return rows.withColumns(better | {"missing": F.col("_there").isNull()}).select(*registry.columns)


def removed(registry: DataFrame, ids: DataFrame, key: str = "project_id") -> DataFrame:
    """The registry without the given projects (D13): entries are added by path but removed by id."""
    return registry.join(ids.select(key).distinct(), key, "left_anti")


def opened(projects: DataFrame, videos: DataFrame) -> DataFrame:
    """Projects as they are when opened (A01): (project_id, state, progress, missing_video).

    Without its video a project is IDLE; one that was being transcribed begins
    again; one that waits for corrections shows them at once.
    """
    there = videos.select(F.col("video_path")).distinct().withColumn("_there", F.lit(True))
    rows = projects.join(there, "video_path", "left")
    state = F.when(F.col("_there").isNull(), "IDLE").when(F.col("state") == "TRANSCRIBING", "UPLOADING").otherwise(F.col("state"))
    return rows.select("project_id", state.alias("state"), F.when(state == "ALIGNING", 100.0).otherwise(0.0).alias("progress"), F.col("_there").isNull().alias("missing_video"))
