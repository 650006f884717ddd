"""The library's operators as queries over the given tables, with SQL for the same results.

The tables hold no ocean data, so `obs` reads `events` as observations by plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.operators import analytics as A
from saltmarsh.operators import observations as O
from saltmarsh.operators import places as P
from saltmarsh.operators import search as Q
from saltmarsh.operators import series as R

OBS = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
obs AS (SELECT event_id, user_id AS cell, CAST((user_id * 37) % 160 - 80 AS DOUBLE) + 0.5 AS latitude, CAST((user_id * 73) % 360 - 180 AS DOUBLE) + 0.5 AS longitude,
 ts AS time, event_type AS source, value / 50 AS wave_height_m, k / 5.0::DOUBLE AS wave_period_s, ((k * 7) % 360)::DOUBLE AS wave_direction_deg,
 CASE WHEN k % 7 <> 0 THEN 10 + value / 20 END AS sst_celsius, k % 10 = 9 AS is_forecast, value / 100 - 0.5 AS sea_level_anomaly_m, (value / 4)::DOUBLE AS current_velocity_kmh FROM e),
p AS (SELECT *, CASE WHEN wave_height_m >= 0 AND wave_period_s > 0 THEN 1025.0::DOUBLE * 9.81::DOUBLE * 9.81::DOUBLE / (64 * pi()) * wave_height_m * wave_height_m * wave_period_s / 1000 END AS wave_power_kw_m FROM obs)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id")
    rows = (read(spark, sf_dir, "events") if events is None else events).select(
        "event_id", u.alias("cell"), (((u * 37) % 160 - 80).cast("double") + 0.5).alias("latitude"), (((u * 73) % 360 - 180).cast("double") + 0.5).alias("longitude"),
        F.col("ts").alias("time"), F.col("event_type").alias("source"), (F.col("value") / 50).alias("wave_height_m"), (k / 5.0).alias("wave_period_s"), S.bearing((k * 7).cast("double")).alias("wave_direction_deg"),
        F.when(k % 7 != 0, 10 + F.col("value") / 20).alias("sst_celsius"), (k % 10 == 9).alias("is_forecast"), (F.col("value") / 100 - 0.5).alias("sea_level_anomaly_m"), (F.col("value") / 4).alias("current_velocity_kmh"),
        F.lit(None).cast("double").alias("geostrophic_u_ms"), F.lit(None).cast("double").alias("geostrophic_v_ms"), F.lit(None).cast("double").alias("current_direction_deg"),
    )
    return rows.withColumn("wave_power_kw_m", S.wave_power(F.col("wave_height_m"), F.col("wave_period_s"))).withColumn("timestamp", F.unix_millis(F.col("time").cast("timestamp")))


def r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


def sq(*names: str, places: int = 4) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


def r6(*names: str):
    """Means of raw readings are compared at six places: at four they have ties."""
    return [F.round(n, 6).alias(n) for n in names]


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query(OBS + f"SELECT event_id, {sq('wave_power_kw_m')}, CASE WHEN wave_height_m < 0.1 THEN 'Calm' WHEN wave_height_m < 0.5 THEN 'Smooth' WHEN wave_height_m < 1.25 THEN 'Slight' WHEN wave_height_m < 2.5 THEN 'Moderate' WHEN wave_height_m < 4 THEN 'Rough' WHEN wave_height_m < 6 THEN 'Very rough' WHEN wave_height_m < 9 THEN 'High' WHEN wave_height_m < 14 THEN 'Very high' ELSE 'Phenomenal' END AS sea_state, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][(floor(wave_direction_deg / 22.5 + 0.5)::INT % 16) + 1] AS compass, round(sea_level_anomaly_m + 0.2 * coalesce(wave_height_m, 0), 4) AS level FROM p WHERE NOT is_forecast")
def wave_readings(spark, d):
    o = obs(spark, d).filter(~F.col("is_forecast"))
    return o.select("event_id", *r4("wave_power_kw_m"), S.sea_state(F.col("wave_height_m")).alias("sea_state"), S.compass(F.col("wave_direction_deg")).alias("compass"), F.round(S.still_water_level(F.col("sea_level_anomaly_m"), F.col("wave_height_m")), 4).alias("level"))


@query(OBS + "SELECT event_id, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, sha1(printf('%.4f', latitude) || '|' || printf('%.4f', longitude) || '|' || CAST(epoch_us(time) // 1000 AS VARCHAR)) AS obs_id FROM obs")
def validated_observations(spark, d):
    good, _ = O.validate(obs(spark, d).drop("wave_power_kw_m"))
    return good.select("event_id", *r4("latitude", "longitude"), "obs_id")


@query(OBS + "SELECT event_id, cell FROM obs WHERE latitude BETWEEN -20 AND 40 AND longitude BETWEEN -60 AND 90 AND epoch_us(time) // 1000 >= 1704500000000 AND NOT is_forecast AND sst_celsius IS NOT NULL")
def observations_in_box(spark, d):
    f = O.ObservationFilter(start_ms=1_704_500_000_000, bbox=(40, -20, 90, -60), require_columns=("sst_celsius", "unknown"))
    return f.apply(obs(spark, d)).select("event_id", "cell")


HAV = "2 * 6371.0088 * asin(sqrt(least(1, power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2))))"


@query(OBS + f"SELECT event_id, round({HAV.format(a='latitude', b='10.0', c='longitude', d='179.0')}, 3) AS distance_km FROM obs WHERE {HAV.format(a='latitude', b='10.0', c='longitude', d='179.0')} <= 6000 AND NOT is_forecast")
def observations_in_radius(spark, d):
    return O.ObservationFilter(centre=(10.0, 179.0), radius_km=6000).apply(obs(spark, d)).select("event_id", F.round("distance_km", 3).alias("distance_km"))


@query(OBS + """, b AS (SELECT cell, date_trunc('day', min(time)) AS lo, max(time) AS hi FROM p GROUP BY cell),
grid AS (SELECT cell, unnest(generate_series(lo, CASE WHEN date_trunc('day', hi) < hi THEN date_trunc('day', hi) + INTERVAL 1 DAY ELSE hi END, INTERVAL 1 DAY)) AS window_start FROM b),
g AS (SELECT cell, date_trunc('day', time) AS window_start, count(*) AS n, avg(sst_celsius) AS sst, max(wave_height_m) AS hm, avg(wave_power_kw_m) AS pw FROM p GROUP BY ALL)
SELECT cell, window_start, coalesce(n, 0) AS observation_count, round(sst, 6) AS sst_celsius, round(hm, 4) AS wave_height_m_max, round(coalesce(pw * 24, 0), 3) AS energy_kwh_m FROM grid LEFT JOIN g USING (cell, window_start)""")
def daily_resample(spark, d):
    out = R.resample(obs(spark, d), "1d", keys=["cell"])
    return out.select("cell", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "observation_count", *r6("sst_celsius"), *r4("wave_height_m_max"), F.round("energy_kwh_m", 3).alias("energy_kwh_m"))


SIX = "INTERVAL 6 HOUR"


@query(OBS + f""", w AS (SELECT cell, time_bucket({SIX}, time) AS window_start, count(*) AS n, avg(sst_celsius) AS sst, max(wave_height_m) AS hm, avg(wave_power_kw_m) AS pw FROM p GROUP BY ALL),
b AS (SELECT cell, time_bucket({SIX}, min(time)) AS lo, max(time) AS hi FROM p GROUP BY cell),
g AS (SELECT cell, unnest(generate_series(lo, CASE WHEN time_bucket({SIX}, hi) < hi THEN time_bucket({SIX}, hi) + {SIX} ELSE hi END, {SIX})) AS window_start FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY window_start) AS i FROM g LEFT JOIN w USING (cell, window_start)),
k AS (SELECT *, last_value(CASE WHEN sst IS NOT NULL THEN struct_pack(i := i, v := sst) END IGNORE NULLS) OVER past AS sp, first_value(CASE WHEN sst IS NOT NULL THEN struct_pack(i := i, v := sst) END IGNORE NULLS) OVER future AS sn,
 last_value(CASE WHEN hm IS NOT NULL THEN struct_pack(i := i, v := hm) END IGNORE NULLS) OVER past AS hp, first_value(CASE WHEN hm IS NOT NULL THEN struct_pack(i := i, v := hm) END IGNORE NULLS) OVER future AS hn FROM r
 WINDOW past AS (PARTITION BY cell ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), future AS (PARTITION BY cell ORDER BY window_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT cell, window_start, round(coalesce(sst, sp.v + (sn.v - sp.v) * (i - sp.i) / (sn.i - sp.i), sp.v, sn.v), 9) AS sst_celsius, round(coalesce(hm, hp.v + (hn.v - hp.v) * (i - hp.i) / (hn.i - hp.i), hp.v, hn.v), 9) AS wave_height_m_max,
 round(sum(coalesce(pw * 6, 0)) OVER past, 3) AS cumulative_energy_kwh_m, CAST(sum(coalesce(n, 0)) OVER past AS BIGINT) AS cumulative_observation_count FROM k WINDOW past AS (PARTITION BY cell ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def six_hourly_linear(spark, d):
    out = R.resample(obs(spark, d), "6h", keys=["cell"], fill="linear")
    out = out.select("cell", "window_start", "sst_celsius", "wave_height_m_max", "observation_count", "energy_kwh_m")
    out = R.running_totals(out, ["observation_count", "energy_kwh_m"], ["cell"], "window_start")
    return out.select("cell", F.col("window_start").cast("timestamp_ntz").alias("window_start"), *[F.round(c, 9).alias(c) for c in ("sst_celsius", "wave_height_m_max")], F.round("cumulative_energy_kwh_m", 3).alias("cumulative_energy_kwh_m"), "cumulative_observation_count")


@query(OBS + """SELECT source, date_trunc('day', time) AS window_start, count(*) AS observation_count,
 round(fmod(degrees(atan2(avg(sin(radians(wave_direction_deg))), avg(cos(radians(wave_direction_deg))))) + 360, 360), 6) AS wave_direction_deg FROM p GROUP BY ALL""")
def daily_bearings(spark, d):
    """Mean bearings per source and day, groups of many readings."""
    out = R.resample(obs(spark, d), "1d", keys=["source"]).filter("observation_count > 0")
    return out.select("source", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "observation_count", *r6("wave_direction_deg"))


DAYS = OBS + ", d AS (SELECT cell, date_trunc('day', time) AS day, avg(sst_celsius) AS sst_celsius, avg(wave_height_m) AS wave_height_m FROM p GROUP BY ALL) "


@query(DAYS + f"SELECT cell, day, {sq('sst_celsius', 'wave_height_m', places=6)} FROM d")
def daily_alignment(spark, d):
    return R.daily_means(obs(spark, d), ["sst_celsius", "wave_height_m"], ["cell"]).select("cell", F.col("day").cast("timestamp_ntz").alias("day"), *r6("sst_celsius", "wave_height_m"))


@query(DAYS + "SELECT cell, day, round(CASE WHEN count(wave_height_m) OVER w >= 5 AND stddev_pop(wave_height_m) OVER w > 1e-9 THEN (wave_height_m - avg(wave_height_m) OVER w) / stddev_pop(wave_height_m) OVER w END, 4) AS z FROM d WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def rolling_zscores(spark, d):
    days = R.daily_means(obs(spark, d), ["wave_height_m"], ["cell"])
    return days.select("cell", F.col("day").cast("timestamp_ntz").alias("day"), F.round(R.rolling_zscore("wave_height_m", ["cell"], "day"), 4).alias("z"))


@query(DAYS + """, q AS (SELECT *, count(wave_height_m) OVER w >= 10 AND wave_height_m > quantile_cont(wave_height_m, 0.5) OVER w AS hot, row_number() OVER (PARTITION BY cell ORDER BY day) AS rn FROM d WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, rn - sum(CASE WHEN hot THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY day) AS island FROM q)
SELECT cell, day, coalesce(hot, false) AND count(*) OVER (PARTITION BY cell, coalesce(hot, false), island) >= 2 AS warm_spell FROM i""")
def warm_spell_days(spark, d):
    days = R.daily_means(obs(spark, d), ["wave_height_m"], ["cell"])
    return R.warm_spells(days, "wave_height_m", ["cell"], "day", 20, 0.5, 2).select("cell", F.col("day").cast("timestamp_ntz").alias("day"), "warm_spell")


@query(DAYS + "SELECT 'sst_celsius' AS left_column, 'sst_celsius' AS right_column, count(sst_celsius) AS n, round(corr(sst_celsius, sst_celsius), 4) AS correlation FROM d UNION ALL SELECT 'sst_celsius', 'wave_height_m', count(sst_celsius), round(corr(sst_celsius, wave_height_m), 4) FROM d UNION ALL SELECT 'wave_height_m', 'wave_height_m', count(wave_height_m), round(corr(wave_height_m, wave_height_m), 4) FROM d")
def correlations(spark, d):
    days = R.daily_means(obs(spark, d), ["sst_celsius", "wave_height_m"], ["cell"])
    return A.correlation_matrix(days, ["sst_celsius", "wave_height_m"]).withColumn("correlation", F.round("correlation", 4))


@query(OBS + "SELECT cell, round(arg_max(sst_celsius, struct_pack(t := time, v := sst_celsius)) FILTER (WHERE sst_celsius IS NOT NULL), 4) AS sst_celsius, round(arg_max(wave_height_m, struct_pack(t := time, v := wave_height_m)), 4) AS wave_height_m, max(time) AS latest FROM p GROUP BY cell")
def latest_by_cell(spark, d):
    return A.latest_per_cell(obs(spark, d), ["cell"], ["sst_celsius", "wave_height_m"], "time").select("cell", *r4("sst_celsius", "wave_height_m"), "latest")


@query(OBS + ", x AS (SELECT min(wave_height_m) AS lo, max(wave_height_m) AS hi FROM p), c AS (SELECT least(floor((wave_height_m - lo) / ((hi - lo) / 44))::BIGINT + 1, 44) AS bin, count(*) AS n FROM p, x GROUP BY 1) SELECT g.bin, round(lo + (g.bin - 1) * (hi - lo) / 44, 4) AS lower, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 45)) AS bin) g CROSS JOIN x LEFT JOIN c ON g.bin = c.bin")
def height_histogram(spark, d):
    return A.histogram(obs(spark, d), "wave_height_m").select("bin", *r4("lower"), "n")


@query(OBS + "SELECT source, round(quantile_cont(wave_height_m, 0.5), 4) AS median, round(quantile_cont(wave_height_m, 0.99), 4) AS p99 FROM p GROUP BY source")
def height_quantiles(spark, d):
    return A.quantiles(obs(spark, d), "wave_height_m", ["source"]).select("source", *r4("median", "p99"))


@query(OBS + ", t AS (SELECT cell, date_trunc('day', time) AS day, max(sea_level_anomaly_m + 0.2 * coalesce(wave_height_m, 0)) AS top FROM p GROUP BY ALL) SELECT cell, count(*) FILTER (WHERE top >= 0.6) AS days_over, count(*) AS days, round(avg(CASE WHEN top >= 0.6 THEN 1.0 ELSE 0.0 END) * 100, 4) AS percent_over FROM t GROUP BY cell")
def exceedance(spark, d):
    level = S.still_water_level(F.col("sea_level_anomaly_m"), F.col("wave_height_m"))
    return A.exceedance_days(obs(spark, d), level, 0.6, ["cell"]).withColumn("percent_over", F.round("percent_over", 4))


@query(OBS + "SELECT cell, count(*) AS n, min(time) AS first_time, max(time) AS last_time, round(avg(sst_celsius), 6) AS mean_sst, round(max(wave_power_kw_m), 4) AS max_power, round(avg(sea_level_anomaly_m) * 100, 3) AS mean_level_cm FROM p GROUP BY cell")
def key_figures(spark, d):
    return A.key_figures(obs(spark, d), ["cell"]).select("cell", "n", "first_time", "last_time", *r6("mean_sst"), *r4("max_power"), F.round("mean_level_cm", 3).alias("mean_level_cm"))


@query(OBS + """, s AS (SELECT cell AS obs_id, event_id AS q, CASE source WHEN (SELECT min(source) FROM obs) THEN 'erddap_sst' WHEN (SELECT max(source) FROM obs) THEN 'erddap_sla' ELSE 'open_meteo' END AS source, wave_height_m AS h, sst_celsius AS sst, sea_level_anomaly_m AS sla, is_forecast FROM obs),
f AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY q) = 1 AS first FROM s)
SELECT obs_id, round(arg_max(h, q) FILTER (WHERE h IS NOT NULL AND (first OR source = 'open_meteo')), 4) AS wave_height_m,
 round(coalesce(arg_max(sst, q) FILTER (WHERE sst IS NOT NULL AND (first OR source = 'open_meteo')), arg_min(sst, q) FILTER (WHERE sst IS NOT NULL AND source = 'erddap_sst')), 4) AS sst_celsius,
 round(arg_max(sla, q) FILTER (WHERE sla IS NOT NULL AND (first OR source = 'erddap_sla')), 4) AS sea_level_anomaly_m, bool_and(is_forecast) AS is_forecast FROM f GROUP BY obs_id""")
def merged_observations(spark, d):
    o = obs(spark, d)
    ends = F.broadcast(o.agg(F.min("source").alias("_lo"), F.max("source").alias("_hi")))  # one row
    o = o.crossJoin(ends).withColumn("source", F.when(F.col("source") == F.col("_lo"), "erddap_sst").when(F.col("source") == F.col("_hi"), "erddap_sla").otherwise("open_meteo"))
    o = o.withColumn("obs_id", F.col("cell")).withColumn("ingest_seq", F.col("event_id")).withColumn("port_id", F.lit(None).cast("string")).withColumn("is_historical_cache", F.lit(False))
    return O.merge_observations(o).select("obs_id", *r4("wave_height_m", "sst_celsius", "sea_level_anomaly_m"), "is_forecast")


XY = "CAST(({k} * {a}) % 1600 AS DOUBLE) / 10 - 80 AS {p}lat, CAST(({k} * {b}) % 3600 AS DOUBLE) / 10 - 180 AS {p}lon"


def placed(df, key, a, b):
    k = F.col(key)
    return df.withColumn("latitude", ((k * a) % 1600).cast("double") / 10 - 80).withColumn("longitude", ((k * b) % 3600).cast("double") / 10 - 180)


BEARING = "round(fmod(degrees(atan2(sin(radians(plon - lon)) * cos(radians(plat)), cos(radians(lat)) * sin(radians(plat)) - sin(radians(lat)) * cos(radians(plat)) * cos(radians(plon - lon)))) + 360, 360), 4) AS bearing_deg"


@query(f"""WITH s AS (SELECT s_suppkey, {XY.format(k='s_suppkey', a=617, b=1543, p='')} FROM supplier), c AS (SELECT c_custkey, {XY.format(k='c_custkey', a=389, b=1117, p='p')} FROM customer),
j AS (SELECT s_suppkey, c_custkey AS place, lat, lon, plat, plon, {HAV.format(a='lat', b='plat', c='lon', d='plon')} AS km, CASE WHEN greatest(abs(lat - plat), abs(lon - plon)) <= 2 THEN 1 WHEN greatest(abs(lat - plat), abs(lon - plon)) <= 5 THEN 2 WHEN greatest(abs(lat - plat), abs(lon - plon)) <= 15 THEN 3 ELSE 4 END AS pad FROM s, c WHERE abs(lat - plat) <= 45 AND abs(lon - plon) <= 45),
m AS (SELECT *, min(pad) OVER (PARTITION BY s_suppkey) AS best FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, place) AS rank FROM m WHERE pad = best)
SELECT s_suppkey, place, rank, round(km, 3) AS distance_km, {BEARING} FROM r WHERE rank <= 3""")
def nearest_three(spark, d):
    s = placed(read(spark, d, "supplier"), "s_suppkey", 617, 1543)
    c = placed(read(spark, d, "customer"), "c_custkey", 389, 1117)
    return P.nearest_places(s, c, "s_suppkey", "c_custkey", 3).select("s_suppkey", "place", "rank", F.round("distance_km", 3).alias("distance_km"), *r4("bearing_deg"))


@query(f"""WITH s AS (SELECT s_suppkey, {XY.format(k='s_suppkey', a=617, b=1543, p='')} FROM supplier), c AS (SELECT CAST(c_acctbal AS BIGINT) AS pop, {XY.format(k='c_custkey', a=389, b=1117, p='p')} FROM customer)
SELECT s_suppkey, max(pop) AS city_population FROM s LEFT JOIN c ON pop > 0 AND abs(floor(lat) - floor(plat)) <= 1 AND abs(floor(lon) - floor(plon)) <= 1 AND {HAV.format(a='lat', b='plat', c='lon', d='plon')} <= 35 GROUP BY s_suppkey""")
def port_city_population(spark, d):
    s = placed(read(spark, d, "supplier"), "s_suppkey", 617, 1543).select("s_suppkey", "latitude", "longitude")
    c = placed(read(spark, d, "customer"), "c_custkey", 389, 1117).withColumn("population", F.bround("c_acctbal").cast("long"))
    return P.attach_city_population(s, c, "s_suppkey").select("s_suppkey", "city_population")


@query("SELECT o_orderkey, unnest(generate_series(a, b, INTERVAL 7 DAY))::DATE AS chunk_start, least(unnest(generate_series(a, b, INTERVAL 7 DAY))::DATE + 6, b) AS chunk_end FROM (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + CAST(o_orderkey % 30 AS INTEGER) AS b FROM orders)")
def fetch_chunks(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a")).withColumn("b", F.date_add("a", (F.col("o_orderkey") % 30).cast("int")))
    return P.date_chunks(o, "a", "b", 7).select("o_orderkey", "chunk_start", "chunk_end")


@query(OBS + ", v AS (SELECT * FROM p WHERE wave_height_m >= 1 ORDER BY wave_height_m DESC, event_id LIMIT 40) SELECT event_id, round(wave_height_m, 4) AS wave_height_m FROM v")
def highest_waves(spark, d):
    return A.severe(obs(spark, d), 40, 1.0, "event_id").select("event_id", *r4("wave_height_m"))


@query(OBS + ", v AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY current_velocity_kmh DESC, event_id) AS rank, count(*) OVER (PARTITION BY cell) AS n FROM p) SELECT cell, event_id, rank FROM v WHERE rank <= greatest(1, floor(n * 0.25))")
def strongest_currents(spark, d):
    return A.strongest(obs(spark, d), "current_velocity_kmh", 0.25, ["cell"], ["event_id"]).select("cell", "event_id", "rank")


@query(OBS.replace("WITH e", "WITH RECURSIVE e") + """, s AS (SELECT cell, event_id, wave_height_m, epoch_ms(time)::DOUBLE AS x, wave_height_m AS y, row_number() OVER (PARTITION BY cell ORDER BY time, wave_height_m, event_id) - 1 AS j, count(*) OVER (PARTITION BY cell) AS n FROM p WHERE isfinite(wave_height_m)),
b AS MATERIALIZED (SELECT *, CASE WHEN j = 0 THEN -1 WHEN j < n - 1 THEN ceil(j / ((n - 2) / 18::DOUBLE)) - 1 ELSE 18 END AS b FROM s WHERE n > 20), m AS MATERIALIZED (SELECT cell, b, avg(x) AS mx, avg(y) AS my FROM b GROUP BY ALL),
r AS (SELECT cell, b, struct_pack(j := j, x := x, y := y) AS a FROM b WHERE j = 0 UNION ALL SELECT cell, b, a FROM (SELECT q.cell, q.b, arg_max(struct_pack(j := q.j, x := q.x, y := q.y), struct_pack(area := abs((r.a.x - coalesce(mx, 0)) * (q.y - r.a.y) - (r.a.x - q.x) * (coalesce(my, 0) - r.a.y)), j := -q.j)) AS a
 FROM r JOIN b q ON q.cell = r.cell AND q.b = r.b + 1 LEFT JOIN m ON m.cell = q.cell AND m.b = q.b + 1 GROUP BY q.cell, q.b))
SELECT cell, event_id, round(wave_height_m, 4) AS wave_height_m FROM s WHERE n <= 20 UNION ALL SELECT b.cell, b.event_id, round(b.wave_height_m, 4) FROM b JOIN r ON r.cell = b.cell AND r.a.j = b.j""")
def downsampled_heights(spark, d):
    return R.lttb(obs(spark, d).select("cell", "event_id", "time", "wave_height_m").withColumn("x", F.unix_millis(F.col("time").cast("timestamp"))), ["cell"], "x", "wave_height_m", 20).select("cell", "event_id", *r4("wave_height_m"))


@query("""WITH t AS (SELECT p_partkey AS place, p_name AS name, p_size::BIGINT AS population, trim(lower(p_name)) AS folded, list_distinct(list_filter(string_split_regex(trim(lower(p_name)), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) AS tokens FROM part),
q AS (SELECT query, trim(lower(query)) AS folded, list_filter(string_split_regex(trim(lower(query)), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')[1:6] AS words FROM (SELECT DISTINCT substr(p_name, 1, 6) AS query FROM part)),
h AS (SELECT query, place, name, population, CASE WHEN t.folded = q.folded THEN 0 WHEN starts_with(t.folded, q.folded) THEN 1 WHEN contains(t.folded, ' ' || q.folded) THEN 2 WHEN contains(t.folded, q.folded) THEN 3 ELSE 4 END AS tier
 FROM q, t WHERE len(words) > 0 AND list_has_all(tokens, words[1:len(words) - 1]) AND len(list_filter(tokens, lambda w: starts_with(w, words[len(words)]))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, population DESC NULLS LAST, length(name), place) AS rank FROM h) SELECT query, rank, place, name, tier, population FROM r WHERE rank <= 12""")
def part_search(spark, d):
    parts = read(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("population"), F.lit("city").alias("source"))
    asked = parts.select(F.substring("p_name", 1, 6).alias("query"))
    return Q.search_places(asked, parts, "p_partkey", "p_name", ["p_name"])
