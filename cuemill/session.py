"""A session with the settings that the library expects."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Bytes of input files for a partition of texts that become rows: sorted words take some thirty times the bytes of compressed text.
DEALT_BYTES = 2 << 20
#: Folders that :func:`work_dir` named, by the session that asked.
_WORK: list[tuple[SparkSession, str]] = []


def session(app: str = "cuemill", master: str | None = None, **conf: str) -> SparkSession:
    """A Spark session in UTC with adaptive execution; ``master`` and ``conf`` go to the builder.

    Names in ``conf`` are written with underscores for dots:
    ``session(spark_sql_shuffle_partitions="64")``.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of the warehouse where that is unset.

    On a cluster a warehouse in a local folder is refused: executors would each write to their own disk.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        return given
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = not re.match(r"\w+:", warehouse) or warehouse.startswith("file:")
    if local and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is a local folder")
    return warehouse + "/_cuemill"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, for streams' output and logs; :func:`clear_work` deletes what was written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WORK.append((spark, path))
    return path


def clear_work() -> None:
    """Delete all folders of :func:`work_dir`; results that were not read to their end are gone then."""
    while _WORK:
        spark, path = _WORK.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(rows: DataFrame) -> int:
    """Bytes of the files that ``rows`` are read from, which are listed and not read; 0 for rows of no files."""
    spark, size = rows.sparkSession, 0
    for name in rows.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return size


def shards_of(rows: DataFrame) -> int:
    """Folders for files that are made of ``rows``, in number like the partitions of :func:`dealt`."""
    return max(1, -(-input_bytes(rows) // DEALT_BYTES))


def dealt(rows: DataFrame, *by: Column | str) -> DataFrame:
    """``rows`` dealt by ``by`` over partitions that grow in number with the input's bytes.

    For rows that become many (texts that are cut into words): adaptive execution
    goes by the bytes of the texts when it joins partitions, and the words that
    they become would then be sorted on disk.  Of a small input it may.
    """
    parts = -(-input_bytes(rows) // DEALT_BYTES)
    if parts <= rows.sparkSession.sparkContext.defaultParallelism:
        return rows.repartition(*by)
    return rows.repartition(parts, *by)
