"""Frames of a flight with the telemetry reported before them: as a batch join, and as a stateful stream.

Both take rows (flight, ts, kind, value, ...), kind being image, altitude or gsd. The batch form reads the past of each flight
in windows of a fixed length, with the last values of all windows before carried along, so a flight of any length isn't one
group. The stream keeps two values, a counter and a blind slice for each flight.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from transect.functions import flight as fl
from transect.session import prepare

MODES = ("adaptive", "adaptive_range", "fixed")


def latest_before(rows: DataFrame, kinds: tuple[str, ...] = ("altitude", "gsd"), block: str = "day") -> DataFrame:
    """The image rows, each with topic_<kind>: the value reported last before it in its flight, or null.

    At equal times telemetry counts as reported before the image. Within a block of time a window runs over the rows; the
    last value of each earlier block is found over one row for each flight and block.
    """
    rows = rows.withColumn("_block", F.date_trunc(block, "ts"))
    rank = F.when(F.col("kind") == "image", 1).otherwise(0)
    past = Window.partitionBy("flight", "_block").orderBy("ts", rank, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    value = {k: F.when(F.col("kind") == k, F.col("value")) for k in kinds}
    inner = rows.select("*", *[F.last(value[k], True).over(past).alias(f"_{k}") for k in kinds]).filter("kind = 'image'")
    ends = rows.groupBy("flight", "_block").agg(*[F.max_by("value", F.when(F.col("kind") == k, F.struct("ts", "event_id"))).alias(f"_end_{k}") for k in kinds])
    before = Window.partitionBy("flight").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("flight").alias("_f"), F.col("_block").alias("_b"), *[F.last(f"_end_{k}", True).over(before).alias(f"_was_{k}") for k in kinds])
    joined = inner.join(carried, F.col("flight").eqNullSafe(F.col("_f")) & (F.col("_block") == F.col("_b")), "left")
    out = joined.select("*", *[F.coalesce(f"_{k}", f"_was_{k}").alias(f"topic_{k}") for k in kinds])
    return out.drop("_block", "_f", "_b", *[x for k in kinds for x in (f"_{k}", f"_was_{k}")])


def decisions(frames: DataFrame, mode: str = "adaptive", fixed_slice: int = 1024, param_gsd: float | None = None, param_altitude: float | None = None, pitch_um: float = 4.39, focal_mm: float = 35.0, width: Column | None = None, height: Column | None = None, blind: Column | None = None) -> DataFrame:
    """frames (topic_gsd, topic_altitude) with used_gsd, used_altitude, mode, slice and tiles.

    An unknown mode counts as adaptive. Fixed mode ignores geometry. Frames without geometry take ``blind``, the slice that a
    blind sweep found for the flight before, as mode blind_cached.
    """
    if mode not in MODES:
        warnings.warn(f"unknown mode {mode}: adaptive is used", stacklevel=2)
        mode = "adaptive"
    width, height = F.lit(8192) if width is None else width, F.lit(5460) if height is None else height
    lit = lambda v: F.lit(v).cast("double")
    distance, altitude = fl.live_resolution(lit(param_gsd), F.col("topic_gsd"), lit(param_altitude), F.col("topic_altitude"))
    out = frames.withColumn("used_gsd", distance).withColumn("used_altitude", altitude)
    if mode == "fixed":
        size = F.greatest(F.lit(fl.MIN_SLICE), F.least(F.lit(fixed_slice), F.greatest(width, height)))
        return out.withColumn("mode", F.lit("fixed")).withColumn("slice", size.cast("int")).withColumn("tiles", fl.tile_count(width, height, F.col("slice")))
    extra = {"max_len_m": F.lit(18.0), "max_fill": F.lit(0.8)} if mode == "adaptive_range" else {}
    decided = fl.slice_decision(width, height, given_gsd=F.col("used_gsd"), altitude_m=F.col("used_altitude"), pitch_um=lit(pitch_um), focal_mm=lit(focal_mm), **extra)
    out = out.withColumn("_d", decided)
    cached = (F.col("_d.mode") == "blind_sweep") & blind.isNotNull() if blind is not None else F.lit(False)
    out = out.withColumn("mode", F.when(cached, "blind_cached").otherwise(F.col("_d.mode")))
    out = out.withColumn("slice", F.when(cached, blind.cast("int") if blind is not None else F.lit(None).cast("int")).otherwise(F.col("_d.slice_size"))).drop("_d")
    return out.withColumn("tiles", fl.tile_count(width, height, F.col("slice")))


def blind_slices(frames: DataFrame, swept: str = "swept") -> DataFrame:
    """frames (topic_gsd, topic_altitude, ``swept``: the slice that a blind sweep of the frame picks) with blind_slice: of their
    flight's first frame without geometry, which the sweep is for; null where a flight has none. Summed before the shuffle."""
    unknown = F.nullif("topic_gsd", F.lit(0.0)).isNull() & F.nullif("topic_altitude", F.lit(0.0)).isNull() & F.col(swept).isNotNull()
    first = frames.filter(unknown).groupBy(F.col("flight").alias("_f")).agg(F.min_by(swept, F.struct("ts", "event_id")).alias("blind_slice"))
    return frames.join(first, F.col("flight").eqNullSafe(F.col("_f")), "left").drop("_f")


class FlightState(StatefulProcessor):
    """What a stream keeps of a flight: the latest altitude and GSD with their times, the number of its frames, and its blind slice.

    A timer of event time, moved on by each batch that has rows of the flight, clears it.
    """

    _kinds = ("altitude", "gsd")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.values = {k: handle.getValueState(k, "value double, at long") for k in self._kinds}
        self.frames, self.blind = handle.getValueState("frames", "n long"), handle.getValueState("blind", "slice int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows), ignore_index=True)
        image = found["kind"] == "image"
        found, image = (x.reset_index(drop=True) for x in _in_order(found, image))
        at = found["ts"].astype("datetime64[ns]").astype("int64")
        topics = {}
        for kind, state in self.values.items():
            value, since = tuple(state.get()) if state.exists() else (np.nan, -1)
            told = (found["kind"] == kind) & found["value"].notna() & (at >= since)
            topics[kind] = found["value"].astype(float).where(told).ffill().fillna(value)
            if told.any():
                last = told[told].index[-1]
                state.update((float(found["value"][last]), int(at[last])))
        n = self.frames.get()[0] if self.frames.exists() else 0
        numbers = n + image.cumsum()
        if image.any():
            self.frames.update((int(numbers.iloc[-1]),))
        unknown = image & found["swept"].notna() & ~topics["altitude"].fillna(0).astype(bool) & ~topics["gsd"].fillna(0).astype(bool)
        blind = pd.Series(pd.NA, found.index, "Int32")
        if self.blind.exists():
            blind[:] = self.blind.get()[0]
        elif unknown.any():
            first = unknown[unknown].index[0]
            blind[first:] = int(found["swept"][first])
            self.blind.update((int(found["swept"][first]),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(at.max()) // 1_000_000, int(timerValues.getCurrentWatermarkInMs())) + self.idle_ms)
        out = pd.DataFrame({"flight": [key[0]] * len(found), "ts": found["ts"], "event_id": found["event_id"], "topic_altitude": topics["altitude"], "topic_gsd": topics["gsd"], "n_frame": numbers, "blind_slice": blind})
        yield out[image]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in (*self.values.values(), self.frames, self.blind):
            state.clear()
        yield from ()


def _in_order(found: pd.DataFrame, image: pd.Series) -> tuple[pd.DataFrame, pd.Series]:
    """By time; telemetry before images at equal times."""
    order = np.lexsort((found["event_id"], image, found["ts"]))
    return found.iloc[order], image.iloc[order]


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enriched_stream(rows: DataFrame, watermark: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """A stream of rows (flight, ts timestamp, kind, value, event_id, and swept if there is one) as its image rows with
    topic_altitude, topic_gsd, n_frame and blind_slice.

    State is that of ``FlightState``, in RocksDB (the session's provider is set to it): the blind slice is the one that a sweep picked
    for the flight's first frame without geometry. Rows of a batch are taken in event-time order (telemetry before images at equal
    times); of values older than those in state, the newer stays, so a late value counts for no frame of a batch before. Telemetry
    without a value is none. Null flights are one flight. The state of a flight goes when the watermark has passed its last row by
    ``idle``; one that comes back begins anew.
    """
    spark = rows.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    if "swept" not in rows.columns:
        rows = rows.withColumn("swept", F.lit(None).cast("int"))
    kind = dict(rows.dtypes)["flight"]
    needed = rows.select("flight", "ts", "kind", "value", "event_id", "swept").withWatermark("ts", watermark)
    made = f"flight {kind}, ts timestamp, event_id long, topic_altitude double, topic_gsd double, n_frame long, blind_slice int"
    return needed.groupBy("flight").transformWithStateInPandas(FlightState(int(pd.Timedelta(idle).total_seconds() * 1000)), made, "Append", "EventTime")


def with_flight_log(frames: DataFrame, log: DataFrame, name: str = "frame") -> DataFrame:
    """frames (a stream or a table) with the altitude that the flight's log has for their file name; log: file name, altitude_m."""
    return frames.join(log.select(F.col(log.columns[0]).alias("_name"), F.col("altitude_m").alias("logged_altitude")), F.col(name) == F.col("_name"), "left").drop("_name")


def tumbling_counts(rows: DataFrame, length: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Rows by window and kind, late ones within the watermark included."""
    return rows.withWatermark("ts", watermark).groupBy(F.window("ts", length), "kind").count().select(F.col("window.start").alias("start"), "kind", F.col("count").alias("n"))


def publish(stream: DataFrame, sink: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> None:
    """Publishes what the stream's source has by now, each row once: batch k is the folder batch=k of the sink, written anew whenever the
    batch is run, so one that is repeated after a failure, even of ``then`` (called with a batch when it is written), changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if then:
            then(batch.sparkSession.read.parquet(f"{sink}/batch={number}"), number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Writes what the stream's source has by now, appended to a parquet folder; ``maxFilesPerTrigger`` of the source bounds a batch."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
