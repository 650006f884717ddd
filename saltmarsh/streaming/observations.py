"""Continuous ingest: payload or reading streams merged into a table, live state, windows, metrics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructField, StructType, TimestampType

from saltmarsh.operators import observations as O
from saltmarsh.operators import series as R
from saltmarsh.session import delete
from saltmarsh.sources import readers
from saltmarsh.streaming.snapshots import Versions

STORED = [
    "obs_id string", "latitude double", "longitude double", "timestamp long", "port_id string", *[f"{m} double" for m in O.MEASURES],
    "is_forecast boolean", "is_historical_cache boolean", "sources array<string>", "created_at long", "updated_at long", "obs_date date",
]


def versions(spark: SparkSession, path: str) -> Versions:
    """The merged table's versions, by day."""
    return Versions(spark, path, "obs_date", ", ".join(STORED))


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The merged table as of a version, the newest by default; an empty one if nothing has been written."""
    return versions(spark, path).rows(version)


def merge_into(path: str, batch: DataFrame, now_ms: int, writer: tuple[str, int] | None = None) -> DataFrame:
    """Merges a batch of validated rows (obs_id, source, ingest_seq) into the table at path, by day.

    Days without new rows are not touched. The days' new content becomes part of the table in one
    step, as a new version: readers see the table before or after it, a failure leaves the one
    before, and of writers at one time the later one merges again into what the earlier one made.
    Merging the same batch again changes no value; with writer (a name and a batch's number) it isn't
    merged again. Rows however late correct earlier ones; a forecast once replaced stays an analysis.
    """
    spark = batch.sparkSession
    new = batch.withColumn("obs_date", F.to_date(F.timestamp_millis("timestamp"))).withColumn("sources", F.lit(None).cast("array<string>")).withColumn("created_at", F.lit(now_ms)).withColumn("updated_at", F.lit(now_ms))
    days = [r[0] for r in new.select("obs_date").distinct().collect()]  # a day a row: the partitions to be rewritten
    names = [c.split()[0] for c in STORED]

    def merged(old: DataFrame) -> DataFrame:
        old = old.withColumn("source", F.lit(None).cast("string")).withColumn("ingest_seq", F.lit(-1).cast("long"))
        rows = O.merge_observations(old.select(*names, "source", "ingest_seq").unionByName(new.select(*names, "source", "ingest_seq")))
        rows = rows.withColumn("obs_date", F.to_date(F.timestamp_millis("timestamp"))).select(*names)
        return rows.repartition("obs_date", F.pmod(F.xxhash64("obs_id"), F.lit(32)))

    table = versions(spark, path)
    if not days:
        return table.rows()
    return table.rows(table.commit(merged, days, writer), days)


def _record(batch_id: int, valid: DataFrame, rejected: DataFrame, path: str | None) -> None:
    """One row of metrics a batch: rows, places (places_about is counted to within some 1 %), rejects; a retried
    batch replaces its row."""
    if path:
        facts = valid.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.struct("latitude", "longitude"), 0.01).alias("places_about"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
        facts.crossJoin(rejected.agg(F.count("*").alias("rejected"))).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")  # one row each


def merge_stream(readings: DataFrame, path: str, checkpoint: str, now_ms: Callable[[], int], metrics: str | None = None, quarantine: str | None = None, **trigger) -> StreamingQuery:
    """readings: a stream of observation columns with source and ingest_seq -> the merged table at path.

    trigger: availableNow=True (the default) or processingTime="15 minutes". Rejected rows go to
    quarantine. Late rows are never dropped: the merge holds its state in the table.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            good, bad = O.validate(kept)
            if quarantine:
                bad.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
            _record(batch_id, good, bad, metrics)
            merge_into(path, good, now_ms(), (checkpoint, batch_id))
        finally:
            kept.unpersist()

    return readings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def payload_stream(payloads: DataFrame, path: str, checkpoint: str, now_ms: Callable[[], int], hits: str | None = None, metrics: str | None = None, **trigger) -> StreamingQuery:
    """payloads: a stream of payload_id, value (see readers.marine_hours), ingest_seq. Parsed,
    validated and merged; hits keeps which locations had data, for observations.mark_probes."""

    def each(batch: DataFrame, batch_id: int) -> None:
        now = now_ms()
        hours = readers.marine_hours(batch, now).persist()  # parsed once for all that follows
        try:
            if hits:
                readers.had_data(hours).write.mode("overwrite").parquet(f"{hits}/batch_id={batch_id}")
            sequence = batch.select("payload_id", "ingest_seq")
            rows = hours.filter("usable").join(sequence, "payload_id").drop("usable", "payload_id", "location")
            for m in O.MEASURES:
                if m not in rows.columns:
                    rows = rows.withColumn(m, F.lit(None).cast("double"))
            good, bad = O.validate(rows)
            _record(batch_id, good, bad, metrics)
            merge_into(path, good, now, (checkpoint, batch_id))
        finally:
            hours.unpersist()

    return payloads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class LiveCell(StatefulProcessor):
    """A cell's last values, until it has been silent for so long that the watermark is past it."""

    def __init__(self, key: list[str], columns: list[str], time: str, silent_ms: int, state: StructType):
        self.key, self.columns, self.time, self.silent_ms, self.schema = key, columns, time, silent_ms, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("cell", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # A call of the state goes to the JVM and back, a frame's methods take longer than its few rows: neither
        # is used more often than needed.
        begun = self.state.get()
        held = begun or (None,) * (2 * len(self.columns) + 1)
        latest, known = held[0], {c: (held[2 * i + 1], held[2 * i + 2]) for i, c in enumerate(self.columns)}
        for frame in rows:
            times = frame[self.time].to_numpy()
            latest = max(t for t in (latest, pd.Timestamp(times.max())) if t is not None and t == t)
            for c in self.columns:
                values = frame[c].to_numpy()
                some = ~pd.isna(values)
                if some.any():
                    # Of values at one time the greatest, as in analytics.latest_per_cell.
                    top = times[some].max()
                    value = values[some & (times == top)].max()
                    here = (pd.Timestamp(top), value.item() if hasattr(value, "item") else value)
                    known[c] = max((known[c], here), key=lambda k: (k[0] is not None, *(k if k[0] is not None else ())))
        if begun:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(latest.timestamp() * 1000) + self.silent_ms)
        self.state.update((latest, *(v for c in self.columns for v in known[c])))
        yield pd.DataFrame([(*key, *(known[c][1] for c in self.columns), latest)], columns=[*self.key, *self.columns, "latest"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_cells(readings: DataFrame, key: list[str], columns: list[str], time: str = "time", late: str = "1 hour", silent: timedelta = timedelta(hours=12)) -> DataFrame:
    """The last value of every column per cell, as a stream for update mode: a row for each cell that a
    batch has readings of. The state is a row for each cell that isn't silent: one without a reading
    for `silent` before the watermark is dropped and begins anew if it comes back. Rows later than the
    watermark are dropped. Sets the session's state store to RocksDB, which timers need.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    types = {f.name: f.dataType for f in readings.schema}
    at = StructField("latest", TimestampType())
    state = StructType([at, *[f for c in columns for f in (StructField(f"{c}_at", TimestampType()), StructField(c, types[c]))]])
    out = StructType([*[StructField(k, types[k]) for k in key], *[StructField(c, types[c]) for c in columns], at])
    rows = readings.select(*key, F.col(time).cast("timestamp").alias(time), *columns).filter(F.col(time).isNotNull()).withWatermark(time, late)
    return rows.groupBy(*key).transformWithStateInPandas(LiveCell(key, columns, time, int(silent.total_seconds() * 1000), state), out, "Update", "EventTime")


def resample_stream(readings: DataFrame, interval: str = "1d", keys: list[str] | None = None, time: str = "time", late: str = "2 days") -> DataFrame:
    """Windows with the batch operator's aggregates; the watermark bounds the state to open windows."""
    step, hours = R.INTERVALS.get(interval, R.INTERVALS["1d"])
    out = readings.withWatermark(time, late).groupBy(*(keys or []), F.window(time, step).alias("_w")).agg(*R.window_aggregates())
    energy = F.coalesce(F.col("wave_power_kw_m") * hours, F.lit(0.0)).alias("energy_kwh_m")
    return out.select(*(keys or []), F.col("_w.start").alias("window_start"), *[c for c in out.columns if c not in (*(keys or []), "_w")], energy)


def write_updates(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Update mode: every batch's changed rows are kept under their batch; newest() reads the last."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return changes.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, path: str, keys: list[str], last: int) -> None:
    """Puts the newest versions among the batches up to `last` in its place and removes the ones before it,
    while no stream writes batches up to `last`; newest() reads the same before and after."""
    rows = spark.read.parquet(path).filter(F.col("batch_id") <= last)
    names = [r[0] for r in rows.select("batch_id").distinct().collect()]  # one a batch
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    beside = f"{path.rstrip('/')}_{uuid.uuid4().hex}"
    rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*").write.parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").parquet(f"{path}/batch_id={last}")
    for n in names:
        if n != last:
            delete(spark, f"{path}/batch_id={n}")
    delete(spark, beside)


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every key among the batches that write_updates kept."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")
