"""Sessions by idle gap over a stream, equal to the batch operator on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_sessions(events: DataFrame, user: str, ts: str, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Session windows that close after ``minutes`` without an event; rows later than ``late`` are dropped.

    Two events exactly ``minutes`` apart share a session, as in the batch operator.
    """
    held = events.withWatermark(ts, late)
    w = F.session_window(ts, f"{minutes} minutes")
    return held.groupBy(user, w.alias("w")).agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events")).select(user, "began", "ended", "events")


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what there is and ends; the checkpoint lets a lost run go on where it stopped."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def sessions_of_folder(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, minutes: int = 60, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of the files of a folder, read as a stream, with those still open at the end."""
    events = spark.readStream.schema(schema).parquet(folder)
    run_once(stream_sessions(events, user, ts, minutes), out, checkpoint)
    return spark.read.parquet(out)


def new_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A journal of JSON lines as a stream: each new file's lines, broken ones left out."""
    raw = spark.readStream.text(folder)
    parsed = raw.select(F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._broken IS NULL").select("r.*").drop("_broken")


def append_new(batch: DataFrame, state_path: str, key: str) -> DataFrame:
    """Rows of a batch whose key the state table does not hold yet; for ``foreachBatch``, which then appends them."""
    spark = batch.sparkSession
    try:
        seen = spark.read.parquet(state_path).select(key).distinct()
    except Exception as e:  # noqa: BLE001 - the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return batch.dropDuplicates([key])
    return batch.dropDuplicates([key]).join(seen, key, "left_anti")
