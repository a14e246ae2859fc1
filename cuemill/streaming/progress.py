"""Structured Streaming forms of the operators on progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.sources.events import event_text

WATERMARK = "10 minutes"
#: Files in a batch, and batches after which the deltas of a saved table are merged.
MAX_FILES, MERGE_EVERY = "64", 16


def read_progress(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of the ``events`` files at a path (which may be a pattern), as progress events."""
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    raw = spark.readStream.schema(schema).options(**{"maxFilesPerTrigger": MAX_FILES} | options).parquet(path)
    # watermarks need a timestamp with a zone
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def snapshots(events: DataFrame, key: str = "session_id") -> DataFrame:
    """The newest event of each session; written in update mode it gives a snapshot for every change."""
    rest = F.struct(*[c for c in events.columns if c != key])
    return events.groupBy(key).agg(F.max_by(rest, F.struct("ts", "event_id")).alias("_e")).select(key, "_e.*")


def saves(events: DataFrame, quiet: str = "2 seconds", watermark: str = WATERMARK, key: str = "session_id") -> DataFrame:
    """One row after each burst of changes (I04): (key, saved_at, n_events, last_event).

    A session window closes when nothing came for ``quiet``; in append mode the
    save is sent once the watermark passes it.
    """
    win = F.session_window("ts", quiet)
    out = events.withWatermark("ts", watermark).groupBy(key, win).agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    return out.select(key, F.col("session_window.end").alias("saved_at"), "n_events", "last_event")


def first_requests(requests: DataFrame, within: str = WATERMARK) -> DataFrame:
    """Render requests without repeats of the same clip while the watermark holds the first."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(["session_id", "render_key"])


def to_events(rows: DataFrame, row: Column, *keep: str) -> DataFrame:
    """(session_id, keep, value): the text that subscribers get."""
    return rows.select("session_id", *keep, event_text(row).alias("value"))


def heard(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """The events of each subscriber's session after it connected, of a stream or a table.

    ``subscribers``: a table (subscriber, session_id, connected_at).
    """
    return events.join(subscribers, "session_id").where("ts > connected_at").drop("connected_at")


def on_connect(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """What each subscriber gets at once: the newest event of its session by then, of a table; none if there is none."""
    rest = F.struct(*[c for c in events.columns if c != "session_id"])
    before = events.join(subscribers, "session_id").where("ts <= connected_at")
    return before.groupBy("session_id", "subscriber").agg(F.max_by(rest, F.struct("ts", "event_id")).alias("_e")).select("session_id", "_e.*", "subscriber")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, as Parquet.

    With modes other than append each batch is a folder of its own.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def serial_saves(stream: DataFrame, path: str, checkpoint: str, key: str = "session_id", merge_every: int = MERGE_EVERY):
    """Keeps the newest row of each session in a table that :func:`saved` reads.

    A batch writes its own newest rows as a delta, and every so many batches the
    deltas are merged into a base, so that a batch costs what it changes.
    Batches of a query come one after another, so saves of a session are in
    order; a batch that runs twice writes the same.
    """

    def save(batch: DataFrame, n: int) -> None:
        snapshots(batch, key).write.mode("overwrite").parquet(f"{path}/delta={n}")
        if n % merge_every == merge_every - 1:
            saved(batch.sparkSession, path, key, upto=n).write.mode("overwrite").parquet(f"{path}/base={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def saved(spark: SparkSession, path: str, key: str = "session_id", upto: int | None = None) -> DataFrame:
    """The table of :func:`serial_saves`: its last base with the deltas after it; ``upto`` leaves out later batches."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(f.getPath().getName()).split("=") for f in fs.listStatus(top) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    known = {kind: sorted(int(n) for k, n in done if k == kind and (upto is None or int(n) <= upto)) for kind in ("base", "delta")}
    base = known["base"][-1:]
    paths = [f"{path}/base={n}" for n in base] + [f"{path}/delta={n}" for n in known["delta"] if not base or n > base[0]]
    return snapshots(spark.read.parquet(*paths), key)
