"""Streams: an append-only session log, visited-URL dedup and a body cache with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def visited_once(requests: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """requests(ts, url) without URLs whose canonical form came within the horizon before; state older than that is dropped."""
    rows = requests.withColumn("norm_url", F.coalesce(urls.normalize(F.col("url")), F.col("url")))
    return rows.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["norm_url"])


def requests_per_host(requests: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests per host and event-time window."""
    rows = requests.withWatermark("ts", late).groupBy(F.window("ts", window), urls.host(F.col("url")).alias("host"))
    return rows.count().select(F.col("window.start").alias("start"), "host", F.col("count").alias("n"))


def append_log(rows: DataFrame, path: str, checkpoint: str):
    """An append-only JSON log of a stream; started with all that is there."""
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_bodies(bodies: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """bodies(ts, url, body) with the cache key of each URL: the first body of a key within the TTL, by event time; older state is dropped."""
    rows = bodies.withColumn("key", urls.cache_key(F.col("url")))
    return rows.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"]).select("key", F.col("ts").alias("stored_at"), "url", "body")


def store_bodies(rows: DataFrame, path: str, checkpoint: str):
    """A cache table fed by a stream, a micro-batch at a time: each batch is one folder, written anew if the batch runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("part", F.substring("key", 1, 2)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_bodies(spark, path: str) -> DataFrame:
    """The cache table: the newest body of each key."""
    newest = F.max_by(F.struct("stored_at", "url", "body"), F.col("stored_at")).alias("b")
    return spark.read.parquet(path).groupBy("key").agg(newest).select("key", "b.*")
