"""Queries of single functions and listings, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.operators import observations as O
from saltmarsh.operators import places as P
from saltmarsh.operators import planning as L
from saltmarsh.operators import series as R
from saltmarsh.plans.more_queries import CUSTOMERS, MS, SUPPLIERS, customers, folder, streamed, suppliers
from saltmarsh.plans.queries import OBS, obs, query, r4, read
from saltmarsh.schema import DICTIONARY, PROVIDERS, RAW_COLUMNS
from saltmarsh.sources import exports, readers
from saltmarsh.streaming import observations as X


@query(OBS + """, b AS (SELECT cell, date_trunc('day', min(time)) AS lo, max(time) AS hi FROM p GROUP BY cell),
grid AS (SELECT cell, unnest(generate_series(lo, CASE WHEN date_trunc('day', hi) < hi THEN date_trunc('day', hi) + INTERVAL 1 DAY ELSE hi END, INTERVAL 1 DAY)) AS window_start FROM b),
g AS (SELECT cell, date_trunc('day', time) AS window_start, avg(sst_celsius) AS sst, max(wave_height_m) AS hm FROM p GROUP BY ALL),
j AS (SELECT * FROM grid LEFT JOIN g USING (cell, window_start))
SELECT cell, window_start, round(coalesce(sst, 0), 6) AS zero_sst, round(coalesce(hm, 0), 6) AS zero_peak, round(last_value(sst IGNORE NULLS) OVER w, 6) AS held_sst, round(last_value(hm IGNORE NULLS) OVER w, 6) AS held_peak FROM j WINDOW w AS (PARTITION BY cell ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def filled_windows(spark, d):
    """Empty windows filled with zero, and with what was there before."""
    zero, held = (R.resample(obs(spark, d), "1d", keys=["cell"], fill=how) for how in ("zero", "ffill"))
    pick = lambda df, name: df.select("cell", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.round("sst_celsius", 6).alias(f"{name}_sst"), F.round("wave_height_m_max", 6).alias(f"{name}_peak"))
    return pick(zero, "zero").join(pick(held, "held"), ["cell", "window_start"])


@query(OBS + f"SELECT event_id, {MS} AS timestamp FROM obs WHERE source = (SELECT max(source) FROM obs) ORDER BY epoch_us(time) // 1000 DESC, event_id DESC LIMIT 75")
def newest_of_a_port(spark, d):
    """The newest 75 readings of one port, forecasts included: a listing of that length."""
    o = obs(spark, d).withColumn("port_id", F.col("source")).withColumn("obs_id", F.col("event_id"))
    port = o.agg(F.max("source")).first()[0]
    rows = O.ObservationFilter(port_id=port, include_forecast=True, order="desc", limit=75).apply(o)
    return rows.select("event_id", F.unix_millis(F.date_trunc("SECOND", F.col("time").cast("timestamp"))).alias("timestamp"))


@query(OBS + "SELECT event_id, true AS truncated FROM obs ORDER BY epoch_us(time) // 1000, event_id LIMIT 60")
def earliest_readings(spark, d):
    """The earliest 60, and whether there are more."""
    return L.earliest(obs(spark, d).withColumn("obs_id", F.col("event_id")), 60).select("event_id", "truncated")


@query(f"""WITH {CUSTOMERS}, o AS (SELECT DISTINCT floor(plat + 90) * 360 + floor(plon + 180) AS cell_id FROM c), b AS (SELECT -77.5::DOUBLE + 5 * i AS lat FROM range(33) t(i) WHERE -77.5 + 5 * i <= 80), n AS (SELECT lat, CAST(greatest(1, round_even(360.0 * cos(radians(lat)) / 5, 0)) AS INTEGER) AS n FROM b),
p AS (SELECT lat, round_even(-180.0::DOUBLE + (i + 0.5::DOUBLE) * 360.0::DOUBLE / n, 4) AS lon FROM (SELECT *, unnest(range(n)) AS i FROM n))
SELECT lat AS latitude, lon AS longitude FROM p WHERE CAST(floor(lat + 90) * 360 + floor(lon + 180) AS INTEGER) IN (SELECT CAST(cell_id AS INTEGER) FROM o)""")
def sampled_ocean(spark, d):
    """Points of equal area in cells that the mask calls ocean."""
    ocean = customers(spark, d).select(S.mask_cell(F.col("latitude"), F.col("longitude")).alias("cell_id")).distinct()
    points = P.equal_area_points(spark, 5.0).withColumn("cell_id", S.mask_cell(F.col("latitude"), F.col("longitude")))
    return points.join(ocean, "cell_id", "left_semi").select("latitude", "longitude")


@query(f"WITH {CUSTOMERS}, o AS (SELECT DISTINCT floor(plat + 90) * 360 + floor(plon + 180) AS cell_id FROM c) SELECT (SELECT count(*) FROM o) AS cells, false AS is_empty, (SELECT count(*) FROM c) AS points, (SELECT min(plat) FROM c) AS min_latitude, (SELECT max(plat) FROM c) AS max_latitude")
def grid_figures(spark, d):
    c = customers(spark, d)
    mask = c.select(S.mask_cell(F.col("latitude"), F.col("longitude")).alias("cell_id")).distinct()
    return readers.ocean_cell_count(mask).crossJoin(L.grid_summary(c))  # one row each


@query(f"WITH {CUSTOMERS}, {SUPPLIERS} SELECT 'd' || c_custkey % 3 AS dataset, plat AS min_lat, 10 AS fetched_at FROM c UNION ALL SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'open_meteo' ELSE 'd1' END, lat, 99 FROM s WHERE s_suppkey % 4 = 0 OR s_suppkey % 2 = 1")
def recorded_fetches(spark, d):
    """Gridded fetches that brought rows and all marine ones join the ledger."""
    row = lambda df, dataset, n, *more: df.select(dataset.alias("dataset"), *[F.col(c).alias(f"{e}_{a}") for a, c in (("lat", "latitude"), ("lon", "longitude")) for e in ("min", "max")], F.lit(0).cast("long").alias("start_timestamp"), F.lit(1).cast("long").alias("end_timestamp"), n.cast("long").alias("row_count"), *more)
    ledger = row(customers(spark, d), F.concat(F.lit("d"), (F.col("c_custkey") % 3).cast("string")), F.lit(5), F.lit(10).cast("long").alias("fetched_at"))
    k = F.col("s_suppkey")
    fetched = row(suppliers(spark, d), F.when(k % 4 == 0, "open_meteo").otherwise("d1"), k % 2)
    return L.record_fetches(ledger, fetched, 99).select("dataset", "min_lat", "fetched_at")


@query("""WITH p AS (SELECT o_orderkey % 200 AS port_id, CASE WHEN o_orderkey % 7 = 0 THEN 'cached' WHEN o_orderkey % 7 = 1 THEN 'out_of_range' ELSE 'fetch' END AS status, o_orderdate::DATE AS a FROM orders),
g AS (SELECT l_orderkey % 200 AS port_id, sum(CASE WHEN l_linenumber > 3 THEN l_linenumber ELSE 0 END) AS n, bool_or(l_orderkey % 50 = 3 AND l_linenumber = 7) AS failed FROM lineitem WHERE l_orderkey % 200 < 120 GROUP BY ALL),
s AS (SELECT port_id, max(status) AS planned, bool_or(status = 'fetch') AS f, min(CASE WHEN status = 'fetch' THEN a END) AS from_date, max(CASE WHEN status = 'fetch' THEN a + 6 END) AS to_date FROM p GROUP BY port_id)
SELECT s.port_id, CASE WHEN NOT f THEN planned WHEN coalesce(failed, false) THEN 'error' WHEN coalesce(n, 0) = 0 THEN 'masked' ELSE 'fetched' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS rows, from_date, to_date FROM s LEFT JOIN g USING (port_id)""")
def backfill_reports(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    status = F.when(k % 7 == 0, "cached").when(k % 7 == 1, "out_of_range").otherwise("fetch")
    plan = read(spark, d, "orders").select((k % 200).alias("port_id"), F.lit("sst").alias("dataset"), status.alias("status"), F.when(status == "fetch", day).alias("chunk_start"), F.when(status == "fetch", F.date_add(day, 6)).alias("chunk_end"))
    m = F.col("l_linenumber")
    fetched = read(spark, d, "lineitem").filter("l_orderkey % 200 < 120").select((F.col("l_orderkey") % 200).alias("port_id"), F.lit("sst").alias("dataset"), F.when(m > 3, m).otherwise(0).alias("row_count"), ((F.col("l_orderkey") % 50 == 3) & (m == 7)).alias("failed"))
    return L.backfill_report(plan, fetched).select("port_id", "status", "rows", "from_date", "to_date")


@query("""WITH s AS (SELECT c_name AS name, 'old' AS notes, c_custkey AS created_at, c_custkey % 5 AS last_rows FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_name AS name, 'new' AS notes, c_custkey + 7 AS created_at FROM customer WHERE c_custkey % 3 = 0), j AS (SELECT coalesce(s.name, n.name) AS name, coalesce(n.notes, s.notes) AS notes, coalesce(s.created_at, n.created_at) AS created_at, last_rows FROM s FULL JOIN n ON s.name = n.name)
SELECT j.name, notes, created_at, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE last_rows END AS last_rows FROM j JOIN customer ON c_name = j.name WHERE c_custkey % 11 <> 0""")
def saved_specifications(spark, d):
    """Saved, saved again under known names, some deleted, some run."""
    c, k = read(spark, d, "customer"), F.col("c_custkey").cast("long")
    saved = c.filter(k % 2 == 0).select(F.col("c_name").alias("name"), F.lit("{}").alias("spec_json"), F.lit("old").alias("notes"), k.alias("created_at"), F.lit(1).cast("long").alias("last_run_at"), (k % 5).alias("last_rows"))
    new = c.filter(k % 3 == 0).select(F.col("c_name").alias("name"), F.lit("{}").alias("spec_json"), F.lit("new").alias("notes"), (k + 7).alias("created_at"))
    kept = exports.delete_specs(exports.save_specs(saved, new), c.filter(k % 11 == 0).select(F.col("c_name").alias("name")))
    runs = c.filter(k % 4 == 0).select(F.col("c_name").alias("name"), F.lit(5).cast("long").alias("last_run_at"), k.alias("last_rows"))
    return exports.mark_runs(kept, runs).select("name", "notes", "created_at", "last_rows")


@query(OBS + "SELECT event_id AS payload_id, location, location = 0 AND event_id % 3 > 0 AS had_data FROM obs, (VALUES (0), (1)) t(location)")
def payload_hits(spark, d):
    """Which locations of a payload gave a reading: the first of most, the second of none."""
    hourly = lambda v: F.struct(F.array(F.lit("2024-01-01T00:00")).alias("time"), F.array(v).alias("wave_height"))
    place = lambda v: F.struct(F.col("latitude"), F.col("longitude"), hourly(v).alias("hourly"))
    value = F.to_json(F.array(place(F.when(F.col("event_id") % 3 > 0, F.col("wave_height_m"))), place(F.lit(None).cast("double"))), {"ignoreNullFields": "false"})
    hours = readers.marine_hours(obs(spark, d).select(F.col("event_id").alias("payload_id"), value.alias("value")), 0)
    return readers.had_data(hours)


@query("SELECT CAST(c_custkey AS VARCHAR) AS file, to_timestamp(c_custkey * 1000) AT TIME ZONE 'UTC' AS low, to_timestamp(c_custkey * 2000) AT TIME ZONE 'UTC' AS high FROM customer WHERE c_custkey % 4 > 0")
def dataset_spans(spark, d):
    """Bounds of a time axis from the lines of a dataset's description; a fourth of them are unreadable."""
    k = F.col("c_custkey")
    line = F.concat(F.lit('attribute,time,actual_range,double,"'), F.when(k % 4 == 0, "none, none").otherwise(F.concat_ws(", ", (k * 1000).cast("string"), (k * 2000).cast("string"))), F.lit('"'))
    lines = read(spark, d, "customer").select(k.cast("string").alias("file"), F.explode(F.array(F.lit("Row Type,Variable Name,Attribute Name,Data Type,Value"), line, F.lit("attribute,depth,actual_range,double,\"0, 1\""))).alias("value"))
    return readers.dataset_coverage(lines).select("file", F.col("low").cast("timestamp_ntz").alias("low"), F.col("high").cast("timestamp_ntz").alias("high"))


@query("SELECT 'K' || c_custkey AS country_code, c_name AS country_name FROM customer WHERE c_custkey % 3 > 0")
def country_lines(spark, d):
    """Names by code from tab-separated lines, comments and short lines among them."""
    k = F.col("c_custkey")
    line = F.concat_ws("\t", F.concat(F.lit("k"), k.cast("string")), F.lit("x"), F.lit("x"), F.lit("x"), F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    lines = read(spark, d, "customer").select(F.when(k % 6 == 0, F.concat(F.lit("#"), line)).when(k % 3 == 0, F.lit("short\tline")).otherwise(line).alias("value"))
    return readers.country_names(lines)


@query(OBS + f"SELECT strftime(date_trunc('second', time), '%Y-%m-%d %H:%M:%S') AS at, latitude, round(wave_height_m, 4) AS wave_height_m, is_forecast FROM p")
def written_parquet(spark, d):
    """The raw export as a file, read again."""
    path = folder(spark, "export")
    exports.write_parquet(exports.raw_projection(obs(spark, d)), path)
    return spark.read.parquet(path).select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("at"), "latitude", *r4("wave_height_m"), "is_forecast")


@query("SELECT o_orderkey, greatest(o_orderdate::DATE, DATE '2021-12-01') AS first_day, o_orderdate::DATE >= DATE '2021-12-01' AS waves, o_orderdate::DATE >= DATE '2022-01-01' AS currents, o_orderdate::DATE >= DATE '2022-12-01' AS temperature FROM orders")
def archive_starts(spark, d):
    day = F.col("o_orderdate").cast("date")
    has = L.available_from(day)
    return read(spark, d, "orders").select("o_orderkey", L.clamp_start(day).alias("first_day"), has["wave_height"].alias("waves"), has["ocean_current_velocity"].alias("currents"), has["sea_surface_temperature"].alias("temperature"))


@query(OBS + """SELECT event_id, CASE WHEN wave_height_m < 0.1 THEN 'Calm' WHEN wave_height_m < 0.5 THEN 'Smooth' WHEN wave_height_m < 1.25 THEN 'Slight' WHEN wave_height_m < 2.5 THEN 'Moderate' WHEN wave_height_m < 4 THEN 'Rough' WHEN wave_height_m < 6 THEN 'Very rough' WHEN wave_height_m < 9 THEN 'High' WHEN wave_height_m < 14 THEN 'Very high' ELSE 'Phenomenal' END AS sea_state,
 printf('%.1f s', wave_period_s) AS wave_period, '–' AS current_toward, coalesce(printf('%.2f', sst_celsius) || ' °C', '–') AS sea_temperature, strftime(time, '%Y-%m-%d %H:%M UTC') AS observed, (event_id % 60) || 's ago' AS age FROM p""")
def reading_details(spark, d):
    rows = obs(spark, d).withColumn("age_s", F.col("event_id") % 60)
    return rows.select("event_id", *S.detail_row()).select("event_id", "sea_state", "wave_period", "current_toward", "sea_temperature", "observed", "age")


@query(OBS + "SELECT event_id FROM p WHERE sst_celsius IS NOT NULL AND wave_height_m IS NOT NULL AND NOT isnan(wave_height_m)")
def charted_readings(spark, d):
    return R.chart_rows(obs(spark, d), ["sst_celsius", "wave_height_m"]).select("event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def one_customer(spark, d):
    return P.by_key(read(spark, d, "customer"), "c_custkey", 7).select("c_custkey", "c_name")


@query(OBS + "SELECT count(*) AS rows, min(epoch_us(date_trunc('day', time)) // 1000)::BIGINT AS first_ts, max(epoch_us(date_trunc('day', time)) // 1000)::BIGINT AS last_ts, 0::BIGINT AS rejected FROM obs")
def streamed_metrics(spark, d):
    """What the merging stream says of its batches."""
    rows = streamed(spark, d).withColumn("timestamp", F.unix_millis(F.date_trunc("DAY", "time"))).withColumn("source", F.lit("open_meteo")).withColumn("port_id", F.lit(None).cast("string")).withColumn("is_historical_cache", F.lit(False)).withColumn("ingest_seq", F.col("event_id"))
    out = folder(spark, "metrics")
    X.merge_stream(rows, f"{out}/table", f"{out}/log", lambda: 0, f"{out}/metrics").awaitTermination()
    return spark.read.parquet(f"{out}/metrics").agg(F.sum("rows").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("rejected").alias("rejected"))


@query(OBS + "SELECT latitude, longitude, epoch_us(date_trunc('hour', time))::BIGINT // 1000 AS timestamp, round(max(wave_height_m), 4) AS wave_height_m FROM obs GROUP BY ALL")
def streamed_payloads(spark, d):
    """Payloads of one hour each, parsed, merged and kept; of versions of one hour the highest comes last."""
    hour = F.date_format(F.date_trunc("HOUR", "time"), "yyyy-MM-dd'T'HH:mm")
    value = F.to_json(F.struct("latitude", "longitude", F.struct(F.array(hour).alias("time"), F.array("wave_height_m").alias("wave_height")).alias("hourly")))
    payloads = streamed(spark, d).select(F.col("event_id").alias("payload_id"), value.alias("value"), (F.col("wave_height_m") * 1e9).cast("long").alias("ingest_seq"))
    out = folder(spark, "payloads")
    X.payload_stream(payloads, f"{out}/table", f"{out}/log", lambda: 4_000_000_000_000).awaitTermination()
    return X.stored(spark, f"{out}/table").select("latitude", "longitude", "timestamp", *r4("wave_height_m"))


@query(OBS + "SELECT event_id FROM obs ORDER BY md5('7|' || event_id), event_id LIMIT 400")
def sampled_readings(spark, d):
    """A sample of 400 that is the same on every run."""
    return L.repeatable_sample(obs(spark, d), "event_id", 400, 7).select("event_id")


@query(OBS + "SELECT CAST(event_id AS VARCHAR) AS event_id, printf('%.3f', latitude) AS latitude, substr(strftime(time, '%Y-%m-%d %H:%M:%S') || ' and so on', 1, 26) AS said, printf('%.3f', wave_height_m) AS wave_height_m, CAST(is_forecast AS VARCHAR) AS is_forecast FROM obs ORDER BY obs.event_id LIMIT 25")
def previewed_rows(spark, d):
    rows = obs(spark, d).withColumn("said", F.concat(F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit(" and so on"))).select("event_id", "latitude", "said", "wave_height_m", "is_forecast")
    return L.preview(rows.orderBy("event_id"))


@query(f"WITH {CUSTOMERS}, p AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'wpi' ELSE 'geonames' END AS source, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 50 END AS population FROM c) SELECT CAST(c_custkey AS VARCHAR) AS port_id, row_number() OVER (ORDER BY source <> 'wpi', population DESC NULLS LAST, c_name, CAST(c_custkey AS VARCHAR)) AS position FROM p")
def gazetteer_positions(spark, d):
    k = F.col("c_custkey")
    places = customers(spark, d).select(k.cast("string").alias("port_id"), F.col("c_name").alias("port_name"), F.when(k % 3 == 0, "wpi").otherwise("geonames").alias("source"), F.when(k % 7 > 0, k % 50).alias("population"))
    return L.gazetteer_positions(places).select("port_id", "position")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 3 ELSE c_custkey END AS last_used FROM customer ORDER BY last_used DESC, name LIMIT 40")
def newest_specifications(spark, d):
    """The forty run or saved last."""
    k = F.col("c_custkey").cast("long")
    saved = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("{}").alias("spec_json"), F.lit("").alias("notes"), k.alias("created_at"), F.when(k % 4 == 0, k * 3).alias("last_run_at"), F.lit(None).cast("long").alias("last_rows"))
    return exports.list_specs(saved).limit(40).select("name", F.coalesce("last_run_at", "created_at").alias("last_used"))


@query("SELECT o_orderkey, regexp_replace(substr(o_orderpriority || '/' || o_orderstatus || ' ' || repeat('x', o_orderkey % 60), 1, 48), '[^\\w-]', '_', 'g') || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '.csv' AS file FROM orders")
def export_file_names(spark, d):
    prefix = F.concat("o_orderpriority", F.lit("/"), "o_orderstatus", F.lit(" "), F.repeat(F.lit("x"), (F.col("o_orderkey") % 60).cast("int")))
    return read(spark, d, "orders").select("o_orderkey", exports.file_names(prefix, "csv", F.col("o_orderdate")).alias("file"))


def _values(rows: list) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


RAW_ENTRIES = [(c, *DICTIONARY[c]) for c in RAW_COLUMNS]


@query(f"SELECT *, (SELECT count(*) FROM events) AS rows FROM (VALUES {_values(RAW_ENTRIES)}) t(\"column\", unit, nature, provider, description)")
def export_dictionary(spark, d):
    """The whole data dictionary of an export's manifest."""
    made = exports.manifest(exports.raw_projection(obs(spark, d)), {"mode": "raw"})
    entries = F.from_json(F.get_json_object("manifest", "$.data_dictionary"), "array<struct<" + ", ".join(f"{c}: string" for c in exports.ENTRY) + ">>")
    return made.select(F.get_json_object("manifest", "$.result.rows").cast("long").alias("rows"), F.explode(entries).alias("e")).select("e.*", "rows")


@query(f"SELECT *, (SELECT count(*) FROM events) AS rows FROM (VALUES {_values([(p, *v) for p, v in PROVIDERS.items()])}) t(provider, role, nature, licence, url, coverage)")
def export_providers(spark, d):
    """All providers of an export's manifest, as they are given there."""
    made = exports.manifest(exports.raw_projection(obs(spark, d)), {"mode": "raw"})
    givers = F.from_json(F.get_json_object("manifest", "$.providers"), "array<struct<" + ", ".join(f"{c}: string" for c in exports.GIVER) + ">>")
    return made.select(F.get_json_object("manifest", "$.result.rows").cast("long").alias("rows"), F.explode(givers).alias("g")).select("g.*", "rows")
