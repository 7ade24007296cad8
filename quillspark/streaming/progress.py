"""Progress over a stream of job events: windowed counts, and rate limits by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, name: str = "events.parquet") -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(path)


def windowed(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and seconds by window and type; rows that come later than `late` are left out by the watermark in a running stream."""
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("jobs"), F.sum("value").alias("seconds")).select(F.col("w.start").alias("start"), "event_type", "jobs", F.round("seconds", 3).alias("seconds"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is there to a Parquet table and stops; a restart goes on after the last commit."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def take(tokens: float, last: float, now: float, rate: float, burst: float) -> tuple[bool, float]:
    """A token bucket's verdict and what is left."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def limited(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """(user_id, event_id, allowed): a token bucket for each user over a stream of events."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            ok, tokens = take(tokens, last or now, now, rate, burst)
            last = now
            allowed.append(ok)
        state.update((tokens, last))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
