"""Structured Streaming forms of the state operators: dedup, last writer wins, telemetry buckets, windows.

A stream of mutations is any streaming DataFrame with the columns of the batch operators; results equal the batch ones on
the same rows. Event-time windows and watermarks are an addition: the state model itself orders by sequence and clock.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import interested, latency_bucket


def replay(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Journal files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def admitted(stream: DataFrame, interest: Sequence[str] = (), event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Interest first, then each (origin, sequence) once; bounded by a watermark if an event time is named."""
    kept = interested(stream, interest, bool(interest))
    if event_time:
        return kept.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["origin", "sequence"])
    return kept.dropDuplicates(["origin", "sequence"])


def newest(stream: DataFrame) -> DataFrame:
    """Last writer wins by path: use with outputMode("update")."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        best = state.get if state.exists else None
        for f in frames:
            for r in f[["hlc", "origin", "sequence", "value"]].itertuples(index=False):
                row = (int(r.hlc), int(r.origin), int(r.sequence), float(r.value))
                if best is None or row[:3] > tuple(best[:3]):
                    best = row
        state.update(best)
        yield pd.DataFrame([(key[0], *best)], columns=["path", "hlc", "origin", "sequence", "value"])

    out = "path string, hlc long, origin long, sequence long, value double"
    return stream.groupBy("path").applyInPandasWithState(step, out, "hlc long, origin long, sequence long, value double", "update", GroupStateTimeout.NoTimeout)


def ewma(stream: DataFrame, key: str, t: str, value: str, half_life: float) -> DataFrame:
    """Running decayed average of each key, rows of a batch in order of time."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        last = state.get if state.exists else None
        for f in frames:
            for r in f.sort_values([t, value])[[t, value]].itertuples(index=False):
                now, x = float(r[0]), float(r[1])
                if last is None or now <= last[0]:
                    last = (max(now, last[0]) if last else now, x)
                else:
                    last = (now, last[1] + (1 - 0.5 ** ((now - last[0]) / half_life)) * (x - last[1]))
        state.update(last)
        yield pd.DataFrame([(k[0], last[1])], columns=[key, "ewma"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ewma double", "t double, v double", "update", GroupStateTimeout.NoTimeout)


def latency_histogram(stream: DataFrame, node: str, ns: str) -> DataFrame:
    """Counts by power-of-two bucket, for outputMode("update") or ("complete")."""
    return stream.groupBy(node, latency_bucket(ns).alias("bucket")).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, ts: str, size: str, by: Sequence[str], slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in event-time windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, ts: str, gap: str, by: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def latest_frames(stream: DataFrame) -> DataFrame:
    """Latest frame of each media stream: (stream, seq, data)."""
    return stream.groupBy("stream").agg(F.max_by("data", "seq").alias("data"), F.max("seq").alias("seq"))


def run_to_table(stream: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there, into an in-memory table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name)
    q = (q.option("checkpointLocation", checkpoint) if checkpoint else q).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upsert(stream: DataFrame, apply, checkpoint: str):
    """Start a stream whose batches are merged by ``apply(batch, epoch)``."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
