"""Resampling, gap filling, rolling statistics, warm spells, downsampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.operators.ordered import Blocks, above_trailing_quantile, in_order, positions, with_halo
from saltmarsh.schema import BEARINGS
from saltmarsh.session import settled

INTERVALS = {"1h": ("1 hour", 1.0), "6h": ("6 hours", 6.0), "1d": ("1 day", 24.0), "1w": ("7 days", 168.0)}
#: Columns with a mean per window, and those with a peak.
MEANS = ["wave_height_m", "wave_period_s", "current_velocity_kmh", "sst_celsius", "sea_level_anomaly_m", "wave_power_kw_m"]
PEAKS = ["wave_height_m", "wave_power_kw_m"]


def window_aggregates() -> list[Column]:
    """What a window of observations is reduced to, in batches and in streams."""
    return [
        F.count("*").alias("observation_count"), *[F.avg(c).alias(c) for c in MEANS], *[F.max(c).alias(f"{c}_max") for c in PEAKS],
        *[S.circular_mean(F.col(c)).alias(c) for c in BEARINGS],
    ]


def resample(obs: DataFrame, interval: str = "1d", start: Column | None = None, end: Column | None = None, keys: list[str] | None = None, time: str = "time", fill: str = "none") -> DataFrame:
    """A row per interval from floor(start) to ceil(end) inclusive: count, means, peaks, mean wave
    bearing, energy. keys (e.g. the cell) give a calendar each; without keys all rows share one.

    fill: none, zero, ffill or linear, for the means and peaks; bearings are never filled; counts
    and energy of empty windows are 0. Rows are reduced per window before the one shuffle.
    """
    keys = keys or []
    step, hours = INTERVALS.get(interval, INTERVALS["1d"])
    at = F.window(time, step)["start"]
    found = obs.groupBy(*keys, at.alias("window_start")).agg(*window_aggregates())
    floor = lambda c: F.window(c, step)["start"]
    spans = obs.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    spans = spans.withColumn("_lo", F.coalesce(start, F.col("_lo")) if start is not None else F.col("_lo")).withColumn("_hi", F.coalesce(end, F.col("_hi")) if end is not None else F.col("_hi"))
    spans = spans.withColumn("_lo", floor(F.col("_lo"))).withColumn("_top", F.col("_hi"))
    spans = spans.withColumn("_hi_floor", floor(F.col("_top")))
    last = F.when(F.col("_hi_floor") < F.col("_top"), F.col("_hi_floor") + F.expr(f"INTERVAL {step}")).otherwise(F.col("_hi_floor"))
    grid = calendar_rows(spans.withColumn("_last", last), keys, "_lo", "_last", step, "window_start")
    out = grid.join(found, [*keys, "window_start"], "left")
    out = out.withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
    out = out.withColumn("energy_kwh_m", F.coalesce(S.window_energy(F.col("wave_power_kw_m"), hours), F.lit(0.0)))
    columns = [*MEANS, *[f"{c}_max" for c in PEAKS]]
    if how_to_fill(fill) in ("ffill", "linear"):
        return _filled(Blocks(settled(out, "resampled"), keys), columns, fill).drop("_at", "_block")
    return fill_gaps(out.drop("_at", "_block"), columns, fill, keys, "window_start")


#: Windows of a calendar that one task makes at a time.
CALENDAR_BLOCK = 4096


def calendar_rows(spans: DataFrame, keys: list[str], first: str, last: str, step: str, name: str) -> DataFrame:
    """keys, name: a row for every step from first to last; `_at`, its number, and `_block`. A long series is
    made block by block, on all tasks."""
    count, unit = step.split()
    of = lambda n: F.expr(f"INTERVAL {int(count) * n} {unit}")
    blocks = spans.select(*keys, F.col(last).alias("_last"), F.posexplode(F.sequence(first, last, of(CALENDAR_BLOCK))).alias("_block", "_start")).repartition(*keys, "_block")
    rows = blocks.select(*keys, "_block", F.posexplode(F.sequence("_start", F.least("_last", F.col("_start") + of(CALENDAR_BLOCK - 1)), of(1))).alias("_i", name))
    return rows.select(*keys, name, "_block", (F.col("_block").cast("long") * CALENDAR_BLOCK + F.col("_i")).alias("_at"))


def how_to_fill(how: str) -> str:
    return "linear" if how == "interpolate" else how


def _filled(blocks: Blocks, columns: list[str], how: str, at: str = "_at") -> DataFrame:
    """at: the rows' positions."""
    if how_to_fill(how) == "ffill":
        return blocks.with_columns({c: blocks.last_known(c, F.col(c)) for c in columns})
    ends, made = {}, {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("i"), F.col(c).alias("v")))
        ends |= {f"_before_{c}": blocks.last_known(c, known), f"_after_{c}": blocks.next_known(c, known)}
        p, n = F.col(f"_before_{c}"), F.col(f"_after_{c}")
        between = p["v"] + (n["v"] - p["v"]) * F.try_divide(F.col(at) - p["i"], n["i"] - p["i"])
        made[c] = F.coalesce(c, between, p["v"], n["v"])
    return blocks.with_columns(ends).withColumns(made).drop(*ends)


def fill_gaps(rows: DataFrame, columns: list[str], how: str, keys: list[str], order: str) -> DataFrame:
    """zero, ffill, or linear by position with the edges taking the nearest value. A series of any length
    is filled block by block (see ordered.Blocks), also without keys."""
    if how == "zero":
        return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    if how_to_fill(how) not in ("ffill", "linear"):
        return rows
    held = positions(in_order(rows, keys, [order]), keys)
    return _filled(Blocks(held, keys), columns, how, "_j").drop("_at", "_block", "_j")


def running_totals(rows: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """Adds cumulative_ columns, summed block by block (see ordered.Blocks)."""
    rows = settled(rows, "to_be_summed")  # else the splitters' sample would work them out once more
    blocks = Blocks(in_order(rows, keys, [order]), keys)
    return blocks.with_columns({f"cumulative_{c}": blocks.running_sum(c, F.col(c)) for c in columns}).drop("_at", "_block")


def daily_means(obs: DataFrame, columns: list[str], keys: list[str], time: str = "time") -> DataFrame:
    return obs.groupBy(*keys, F.date_trunc("DAY", time).alias("day")).agg(*[F.avg(c).alias(c) for c in columns])


def rolling_zscore(value: str, keys: list[str], order: str, window: int = 30, min_periods: int = 5) -> Column:
    """Against the rows before; null if there are too few or they hardly vary."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    sd = F.stddev_pop(value).over(before)
    return F.when((F.count(value).over(before) >= min_periods) & (sd > 1e-9), (F.col(value) - F.avg(value).over(before)) / sd)


def derived_features(rows: DataFrame, columns: list[str], keys: list[str], order: str, window: int = 30, least: int = 8) -> DataFrame:
    """Z-scores (null for series with under `least` values) and log energy."""
    whole = Window.partitionBy(*keys)
    made = {f"{c}_zscore": F.when(F.count(c).over(whole) >= least, rolling_zscore(c, keys, order, window)) for c in columns}
    if "energy_kwh_m" in rows.columns:
        made["log_energy"] = S.log_energy(F.col("energy_kwh_m"))
    return rows.withColumns(made)


def warm_spells(rows: DataFrame, value: str, keys: list[str], order: str, window: int = 90, share: float = 0.9, min_duration: int = 5, calendar: bool = False) -> DataFrame:
    """Adds warm_spell: over the trailing quantile for min_duration rows or more in a row.

    calendar: first to daily means with a row for every day between a series' first and last, so
    that the window and the duration count days and a day without a value ends a spell; `order` is
    then a time and the result has the keys, `day`, the value and warm_spell. Rows of one time are in a
    fixed, but any order. Series of any length are worked on in chunks, on all tasks; null and
    non-finite values end a spell and count in no quantile.
    """
    if calendar:
        days = daily_means(rows, [value], keys, order)
        spans = days.groupBy(*keys).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
        grid = calendar_rows(spans, keys, "_lo", "_hi", "1 day", "day").drop("_at", "_block")
        rows, order = grid.join(days, [*keys, "day"], "left"), "day"
    names = rows.columns
    held = positions(in_order(rows.withColumn("_v", S.clean(F.col(value))), keys, [order]), keys, counted=True)
    hot = above_trailing_quantile(with_halo(held, window), "_v", window, share, max(10, 2 * min_duration), "_hot")
    hot = Blocks(settled(hot.drop("_chunk", "_halo"), "hot_rows"), keys)
    hot = hot.with_columns({"_island": F.col("_j") - hot.running_sum("hot", F.col("_hot").cast("int"))})
    # Of hot rows in a row each has one more before it and one more place: the difference tells the spell.
    run = F.count("*").over(Window.partitionBy("_series", "_hot", "_island"))
    return hot.withColumn("warm_spell", F.col("_hot") & (run >= min_duration)).select(*names, "warm_spell")


def chart_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a finite value in each of the plotted columns."""
    return rows.withColumns({c: S.clean(F.col(c)) for c in columns}).dropna(subset=columns)


def _hull(points: list[tuple[int, float, float]]) -> list[tuple[int, float, float]]:
    """The corners of the convex hull of (j, x, y) sorted by x, then y; in that order."""
    corners: dict[int, tuple[int, float, float]] = {}
    for side in (1, -1):
        chain: list[tuple[int, float, float]] = []
        for p in points:
            while len(chain) > 1 and side * ((chain[-1][1] - chain[-2][1]) * (p[2] - chain[-2][2]) - (chain[-1][2] - chain[-2][2]) * (p[1] - chain[-2][1])) >= 0:
                chain.pop()
            chain.append(p)
        corners.update((p[0], p) for p in chain)
    return [corners[j] for j in sorted(corners)]


def _bucket_corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_series, _b, _j, _x, _y: of each batch's rows of a bucket the corners of their hull."""
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        series, bucket, *rest = (c[order] for c in columns)
        edges = np.flatnonzero((np.diff(series, prepend=series[:1] - 1) != 0) | (np.diff(bucket, prepend=bucket[:1] - 1) != 0)).tolist()
        rows = list(zip(*(c.tolist() for c in rest)))
        found = [(series[a], bucket[a], *p) for a, b in zip(edges, [*edges[1:], len(rows)]) for p in _hull(rows[a:b])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), batch.schema)], schema=batch.schema)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_series, _b, _j, _x, _y, _mx, _my, sorted by the first three -> _series, _j: of each bucket the corner of the
    largest triangle with the one chosen before and the mean of the bucket after. What is carried from row to
    row: the corner chosen last and the corners of the bucket at hand."""
    now, last, held, ahead = (None, None), None, [], None
    out: list[tuple[int, int]] = []

    def choose() -> None:
        nonlocal last
        corners = _hull(held)
        if ahead[0] is None or last is None:
            last = corners[0]  # the series' first and last buckets have one row
        else:
            (_, ax, ay), (mx, my) = last, ahead
            last = max(corners, key=lambda p: abs((ax - mx) * (p[2] - ay) - (ax - p[1]) * (my - ay)))
        out.append((now[0], last[0]))

    for batch in batches:
        for series, bucket, j, x, y, mx, my in zip(*(c.to_pylist() for c in batch.columns)):
            if (series, bucket) != now:
                if held:
                    choose()
                if series != now[0]:
                    last = None
                now, held, ahead = (series, bucket), [], (mx, my)
            held.append((j, x, y))
            if len(held) > 1000:
                held = _hull(held)
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], ["_series", "_j"])
        out.clear()
    if held:
        choose()
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], ["_series", "_j"])


def lttb(rows: DataFrame, keys: list[str], x: str, y: str, points: int) -> DataFrame:
    """Largest-triangle downsampling: at most `points` rows per series, first and last among them.

    Rows are numbered by series in blocks, wherever they lie. A triangle over a bucket's rows is largest
    at a corner of their convex hull, whatever was chosen before; so tasks reduce their parts of
    a bucket to such corners, and only these pass, in order, through the choice that depends on the
    one before. Rows with a null or non-finite x or y are dropped; ties in x go by y, then by the other
    columns; of triangles that are equal (but for rounding) the first row's counts.
    """
    clean = rows.withColumn("_y", S.clean(F.col(y))).withColumn("_x", S.clean(F.col(x).cast("double"))).filter("_y is not null and _x is not null")
    others = [c for c in rows.columns if c not in (x, y, *keys)]
    clean = positions(in_order(clean, keys, ["_x", "_y", *others]), keys, counted=True)
    if points < 3:
        return clean.select(*rows.columns)
    size = (F.col("_n") - 2) / F.lit(float(points - 2))
    inner = (F.col("_j") > 0) & (F.col("_j") < F.col("_n") - 1)
    bucket = F.when(F.col("_j") == 0, -1).when(inner, F.ceil(F.col("_j") / size) - 1).otherwise(points - 2)
    many = clean.filter(F.col("_n") > points).select("_series", bucket.cast("long").alias("_b"), "_j", "_x", "_y")
    means = many.groupBy("_series", "_b").agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    ahead = means.withColumn("_b", F.col("_b") - 1).filter("_b >= 0")
    corners = many.mapInArrow(_bucket_corners, "_series long, _b long, _j long, _x double, _y double")
    passed = corners.join(ahead, ["_series", "_b"], "left").repartition("_series").sortWithinPartitions("_series", "_b", "_j")
    chosen = passed.select("_series", "_b", "_j", "_x", "_y", "_mx", "_my").mapInArrow(_chosen, "_series long, _j long")
    few = clean.filter(F.col("_n") <= points).select(*rows.columns)
    return few.unionByName(clean.filter(F.col("_n") > points).join(chosen, ["_series", "_j"], "left_semi").select(*rows.columns))
