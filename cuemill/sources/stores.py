"""Registries, settings, file lists and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cuemill.functions.progress import DEFAULTS
from cuemill.schema import REGISTRY, SETTINGS


def parse_registry(text: Column | str) -> Column:
    """The entries of a registry's JSON text; an empty array if it can't be read or is no array."""
    text = F.col(text) if isinstance(text, str) else text
    entries = F.from_json(text, ArrayType(REGISTRY))
    return F.when(text.rlike(r"^\s*\["), F.coalesce(F.filter(entries, lambda e: e.isNotNull()), F.array().cast(ArrayType(REGISTRY)))).otherwise(F.array().cast(ArrayType(REGISTRY)))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries with ``entry_no``, their place; most recent first."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(parse_registry("value")).alias("entry_no", "e")).select("entry_no", "e.*")


def registry_text(entries: DataFrame, order: str = "rank") -> DataFrame:
    """(value): one row with the JSON text of a registry, which has 20 entries at most."""
    rows = F.sort_array(F.collect_list(F.struct(order, F.struct(*REGISTRY.fieldNames()).alias("e"))))
    return entries.agg(F.to_json(F.transform(rows, lambda x: x["e"])).alias("value"))


def write_registry(entries: DataFrame, path: str, order: str = "rank") -> None:
    registry_text(entries, order).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Settings as written, sparse (A04): a row for each file, or for each of its lines."""
    return spark.read.schema(SETTINGS).json(path, multiLine=not lines)


def effective_settings(settings: DataFrame) -> DataFrame:
    """Settings with defaults where they are not set."""
    return settings.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()})


def merged_styles(styles: Column, defaults: dict) -> Column:
    """Caption styles over default ones, field by field."""
    return F.struct(*[F.coalesce(styles[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, folder, file, bytes) of the files below a folder, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return with_names(rows).select("path", "folder", "file", F.col("length").alias("bytes"))


def with_names(rows: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``folder``, the name of the folder that holds a path, and ``file``, its last part."""
    parts = F.split(path, "/")
    return rows.withColumn("folder", F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))).withColumn("file", F.element_at(parts, -1))
