"""Streaming counterparts of the append-only ledgers: events arrive, totals follow.

``windowed`` is a watermarked aggregation whose state is bounded by the lateness
allowed; ``totals`` runs a stream of files to its end and returns the table it
leaves, which equals the batch aggregation of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n, total) per window; works on a stream and on a table alike."""
    w = events.withWatermark(ts, late) if events.isStreaming else events
    g = w.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def totals(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, ts: str, key: str, value: str, width: str = "1 hour") -> DataFrame:
    """Drains the files below a folder through a stream into a table."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = windowed(stream, ts, key, value, width).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    # of several updates of a window the last batch holds the final one
    rows = spark.read.parquet(out)
    last = rows.groupBy("start", key).agg(F.max(F.struct("batch", "n", "total")).alias("m"))
    return last.select("start", key, F.col("m.n").alias("n"), F.col("m.total").alias("total"))
