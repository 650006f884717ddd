"""Correlation, histograms, quantiles, exceedance, latest state, key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.operators.series import daily_means, rolling_zscore


def correlation_matrix(rows: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """left_column, right_column, correlation, n: pairwise complete, in one pass over rows."""
    aggs, pairs = [], []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            aggs.append(F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.count(F.when(both, 1)).alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("correlation")).alias(f"_{len(pairs)}"))
            pairs.append(f"_{len(pairs)}")
    long = rows.agg(*aggs).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return long.withColumn("correlation", F.when(F.col("n") >= least, F.col("correlation")))


def histogram(rows: DataFrame, value: str, bins: int = 44) -> DataFrame:
    """bin (1..bins), lower, upper, n, density: equal widths from least to largest, the last closed."""
    edges = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total")
    at = F.least(F.width_bucket(F.col(value), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    counts = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # edges is one row
    grid = edges.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    out = grid.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"), (F.col("lo") + F.col("bin") * width).alias("upper"), "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def quantiles(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """median and p99 per key, exact by interpolation. See quantile_sketches for very large groups."""
    return rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.99).alias("p99"))


#: Size of a quantile sketch: ranks are off by less than 0.2 % of the rows; a sketch of fewer rows is exact.
SKETCH = 2048


def quantile_sketches(rows: DataFrame, value: str, keys: list[str], time: str = "time", size: int = SKETCH) -> DataFrame:
    """keys, day, n, sketch: what merged_quantiles needs of a day, to be kept. Null and NaN values aren't counted."""
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(*keys, F.date_trunc("DAY", time).alias("day")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_quantiles(sketches: DataFrame, shares: dict[str, float], keys: list[str], size: int = SKETCH) -> DataFrame:
    """keys, n and a column for each name of shares: its quantile over all days and further keys of the
    sketches, which are merged in any order and on any tasks."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("_s"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(c) for c, p in shares.items()])


def exceedance_days(rows: DataFrame, level: Column, threshold: float, keys: list[str], time: str = "time") -> DataFrame:
    days = rows.withColumn("_level", level).filter("_level is not null").groupBy(*keys, F.date_trunc("DAY", time).alias("day")).agg(F.max("_level").alias("top"))
    over = F.col("top") >= threshold
    return days.groupBy(*keys).agg(F.count_if(over).alias("days_over"), F.count("*").alias("days"), (F.avg(over.cast("double")) * 100).alias("percent_over"))


def latest_per_cell(obs: DataFrame, key: list[str], columns: list[str], time: str, since: Column | None = None) -> DataFrame:
    """The last non-null value of every column for itself."""
    rows = obs if since is None else obs.filter(F.col(time) >= since)
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(time), F.col(c)))).alias(c) for c in columns], F.max(time).alias("latest"))


def pulse(latest: DataFrame, power: str, cell: str) -> DataFrame:
    """Peak power, its cell (the first by name), cells that report, newest time."""
    return latest.agg(F.max(power).alias("peak_power"), F.min_by(cell, F.struct(-F.col(power), F.col(cell))).alias("peak_cell"), F.count(power).alias("cells"), F.max("latest").alias("newest"))


def sst_anomalies(obs: DataFrame, key: str, time: str = "time", least_rows: int = 24, least_days: int = 10, threshold: float = 2.0) -> DataFrame:
    """Per cell the last z-score of daily means; then the largest and how many are over."""
    days = daily_means(obs, ["sst_celsius"], [key], time)
    n = obs.filter("sst_celsius is not null").groupBy(key).agg(F.count("*").alias("n"))
    z = days.filter("sst_celsius is not null").withColumn("z", rolling_zscore("sst_celsius", [key], "day", 30, 8))
    last = z.groupBy(key).agg(F.max_by("z", F.when(F.col("z").isNotNull(), F.col("day"))).alias("z"), F.count("*").alias("days")).join(n, key)
    last = last.filter((F.col("n") >= least_rows) & (F.col("days") >= least_days))
    return last.agg(F.max("z").alias("max_z"), F.count_if(F.col("z") > threshold).alias("cells_over"), F.count("z").alias("cells"))


def key_figures(rows: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.avg("sst_celsius").alias("mean_sst"), F.min("sst_celsius").alias("min_sst"), F.max("sst_celsius").alias("max_sst"),
        (F.avg("sea_level_anomaly_m") * 100).alias("mean_level_cm"), (F.max("sea_level_anomaly_m") * 100).alias("max_level_cm"), F.max("wave_power_kw_m").alias("max_power"), F.max("wave_height_m").alias("max_height"),
    )


def store_statistics(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count("*").alias("total"), F.count_if(~F.col("is_forecast")).alias("analyses"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count_distinct("port_id").alias("ports"))


def latest_analysis(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.filter(~F.col("is_forecast")).groupBy(*keys).agg(F.max("timestamp").alias("latest"))


def severe(rows: DataFrame, limit: int = 40, height: float = 5.0, tie: str = "port_id") -> DataFrame:
    """The highest waves of at least `height`: a top-k report."""
    return rows.filter(F.col("wave_height_m") >= height).orderBy(F.desc("wave_height_m"), tie).limit(limit)


def strongest(rows: DataFrame, speed: str, fraction: float, keys: list[str], tie: list[str]) -> DataFrame:
    """Per snapshot the fastest max(1, floor(n * fraction)) rows; fraction 0: none."""
    ranked = rows.filter(F.col(speed).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(speed), *tie))
    n = F.count("*").over(Window.partitionBy(*keys))
    keep = F.greatest(F.lit(1), F.floor(n * fraction)) if fraction > 0 else F.lit(0)
    return ranked.withColumn("rank", rank).withColumn("_keep", keep).filter("rank <= _keep").drop("_keep")
