"""Queries of sources, exports, streams and planning, over the given tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.operators import observations as O
from saltmarsh.operators import places as P
from saltmarsh.operators import planning as L
from saltmarsh.operators import search as Q
from saltmarsh.operators import series as R
from saltmarsh.operators import analytics as A
from saltmarsh.plans.queries import DAYS, HAV, OBS, XY, obs, placed, query, r4, r6, read, sq
from saltmarsh.session import own_folder as folder
from saltmarsh.sources import clustered as C
from saltmarsh.sources import exports, readers
from saltmarsh.streaming import observations as X

MS = "CAST(epoch_us(date_trunc('second', time)) // 1000 AS BIGINT)"
SUPPLIERS = f"s AS (SELECT *, {XY.format(k='s_suppkey', a=617, b=1543, p='')} FROM supplier)"
CUSTOMERS = f"c AS (SELECT *, {XY.format(k='c_custkey', a=389, b=1117, p='p')} FROM customer)"


def suppliers(spark, d):
    return placed(read(spark, d, "supplier"), "s_suppkey", 617, 1543)


def customers(spark, d):
    return placed(read(spark, d, "customer"), "c_custkey", 389, 1117)


@query(OBS + f"SELECT event_id AS payload_id, latitude, longitude, {MS} AS timestamp, {MS} > 1704500000000 AS is_forecast, {sq('wave_height_m', 'wave_period_s', 'sst_celsius')} FROM obs")
def marine_payloads(spark, d):
    """Events as payloads: a lone object, or an array whose second location is land; the second hour has no values."""
    at = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")
    hourly = F.struct(F.array(at, F.lit("2024-01-01T00:00")).alias("time"), F.array("wave_height_m").alias("wave_height"), F.array("wave_period_s").alias("wave_period"), F.array("sst_celsius", F.lit(None)).alias("sea_surface_temperature"))
    here = F.to_json(F.struct("latitude", "longitude", hourly.alias("hourly")))
    land = '{"latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00"], "wave_height": [null]}}'
    text = F.when(F.col("event_id") % 2 == 0, here).otherwise(F.concat(F.lit("["), here, F.lit(f", {land}]")))
    hours = readers.marine_hours(obs(spark, d).select(F.col("event_id").alias("payload_id"), text.alias("value")), 1_704_500_000_000)
    return hours.filter("usable").select("payload_id", "latitude", "longitude", "timestamp", "is_forecast", *r4("wave_height_m", "wave_period_s", "sst_celsius"))


def gridded_lines(spark, d):
    rows = obs(spark, d)
    line = F.concat_ws(",", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("0.0"), F.col("latitude").cast("string"), F.pmod(F.col("longitude"), F.lit(360.0)).cast("string"), F.coalesce(F.col("sst_celsius").cast("string"), F.lit("NaN")))
    heads = rows.select("source").distinct().select(F.col("source").alias("file"), F.explode(F.array(F.lit("time,zlev,latitude,longitude,sst"), F.lit("UTC,m,degrees_north,degrees_east,degree_C"), F.lit("short,row"))).alias("value"))
    return heads.unionByName(rows.select(F.col("source").alias("file"), line.alias("value")))


@query(OBS + f"SELECT {MS} AS timestamp, latitude, longitude, round(sst_celsius, 4) AS sst_celsius FROM obs WHERE sst_celsius IS NOT NULL")
def gridded_readings(spark, d):
    return readers.gridded_observations(gridded_lines(spark, d), "sst").select("timestamp", "latitude", "longitude", *r4("sst_celsius"))


@query(OBS + "SELECT DISTINCT CAST(floor(latitude + 90) * 360 + floor(longitude + 180) AS INTEGER) AS cell_id FROM obs WHERE sst_celsius IS NOT NULL")
def ocean_cells(spark, d):
    return readers.ocean_mask(gridded_lines(spark, d))


def dms_text(v, pos, neg):
    size = F.abs(v)
    whole = F.floor(size)
    return F.concat(whole.cast("string"), F.lit("°"), F.round((size - whole) * 60).cast("int").cast("string"), F.lit("'00\""), F.when(v < 0, F.lit(neg)).otherwise(F.lit(pos)))


@query(f"WITH {CUSTOMERS} SELECT 'wpi:' || c_custkey AS port_id, c_name AS port_name, round(plat, 4) AS latitude, round(plon, 4) AS longitude FROM c WHERE c_custkey % 10 <> 0")
def port_index_rows(spark, d):
    c = customers(spark, d)
    bad = F.col("c_custkey") % 10 == 0
    rows = c.select(F.col("c_custkey").cast("string").alias("portNumber"), F.col("c_name").alias("portName"), F.lit("xx").alias("countryCode"), F.lit("").alias("countryName"), F.when(bad, F.lit("north")).otherwise(dms_text(F.col("latitude"), "N", "S")).alias("latitude"), dms_text(F.col("longitude"), "E", "W").alias("longitude"), F.lit("north sea").alias("regionName"), F.lit("L").alias("harborSize"), F.lit("CB").alias("harborType"))
    return readers.port_index(rows).select("port_id", "port_name", *r4("latitude", "longitude"))


@query(f"""WITH {SUPPLIERS}, {CUSTOMERS}, o AS (SELECT DISTINCT floor(lat + 90) AS y, floor(lon + 180) AS x FROM s)
SELECT 'geonames:' || c_custkey AS port_id, c_name AS port_name, CAST(c_custkey * 10 AS BIGINT) AS population FROM c WHERE EXISTS (SELECT 1 FROM o WHERE abs(o.y - floor(plat + 90)) <= 1 AND least(abs(o.x - floor(plon + 180)), 360 - abs(o.x - floor(plon + 180))) <= ceil(60 / (111.0 * greatest(0.15, cos(radians(plat))))))""")
def coastal_cities(spark, d):
    ocean = suppliers(spark, d).select(S.mask_cell(F.col("latitude"), F.col("longitude")).alias("cell_id")).distinct()
    key, none = F.col("c_custkey"), F.lit("")
    fields = [none] * 19
    fields[0], fields[1], fields[4], fields[5], fields[8], fields[14] = key.cast("string"), F.col("c_name"), F.col("latitude").cast("string"), F.col("longitude").cast("string"), F.lit("xx"), (key * 10).cast("string")
    lines = customers(spark, d).select(F.concat_ws("\t", *fields).alias("value"))
    return readers.city_rows(lines, ocean).select("port_id", "port_name", "population")


@query(f"""WITH {CUSTOMERS}, t AS (SELECT 'geonames:' || c_custkey AS place, 'Porté ' || translate(c_name, 'aeo', 'áëô') AS name, c_custkey % 90 * 10::BIGINT AS population, 'port ' || lower(c_name) || ' sankt ' || chr(97 + (c_custkey % 26)::INT) || c_custkey % 7 || ' baie' AS words, c_custkey FROM c),
q AS (SELECT DISTINCT 'Sànkt ' || chr(65 + (n % 26)::INT) || n % 7 AS query, 'sankt ' || chr(97 + (n % 26)::INT) || n % 7 AS folded FROM (SELECT s_suppkey AS n FROM s) UNION ALL VALUES ('b', 'b'), ('BAÏE', 'baie'), ('porte c', 'porte c')),
h AS (SELECT query, place, name, population, CASE WHEN starts_with(strip_accents(lower(name)), folded) THEN 1 WHEN contains(strip_accents(lower(name)), ' ' || folded) THEN 2 WHEN contains(strip_accents(lower(name)), folded) THEN 3 ELSE 4 END AS tier
 FROM q, t WHERE CASE WHEN folded IN ('b', 'baie', 'porte c') THEN true ELSE regexp_extract(words, 'sankt (.*) baie', 1) = substr(folded, 7) END),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, population DESC, length(name), place) AS rank FROM h) SELECT query, rank, place, name, tier, population FROM r WHERE rank <= 12""".replace("WITH c AS", f"WITH {SUPPLIERS}, c AS"))
def cities_by_other_names(spark, d):
    """Cities with accents in their names, found by their alternate names and without the accents."""
    key, none = F.col("c_custkey"), F.lit("")
    fields = [none] * 19
    other = F.concat(F.lit("Sänkt "), F.chr(65 + key % 26), (key % 7).cast("string"), F.lit(",Baïe"))
    fields[0], fields[1], fields[3], fields[4], fields[5], fields[8], fields[14] = key.cast("string"), F.concat(F.lit("Porté "), F.translate("c_name", "aeo", "áëô")), other, F.col("latitude").cast("string"), F.col("longitude").cast("string"), F.lit("xx"), (key % 90 * 10).cast("string")
    cities = readers.city_rows(customers(spark, d).select(F.concat_ws("\t", *fields).alias("value")))
    n = F.col("s_suppkey")
    asked = suppliers(spark, d).select(F.concat(F.lit("Sànkt "), F.chr(65 + n % 26), (n % 7).cast("string")).alias("query"))
    asked = asked.unionByName(spark.createDataFrame([("b",), ("BAÏE",), ("porte c",)], "query string"))
    return Q.search_places(asked, cities, "port_id", "port_name", ["port_name", "alt_names"])


@query(OBS + "SELECT event_id, cell FROM obs WHERE latitude BETWEEN -10 AND 30 AND longitude BETWEEN -60 AND 20 AND epoch_us(time) // 1000 BETWEEN 1704500000000 AND 1706000000000 AND NOT is_forecast")
def clustered_box(spark, d):
    """A box and a span of days out of observations stored by day and along a curve."""
    path = folder(spark, "clustered")
    C.write_clustered(obs(spark, d), path)
    return C.read_clustered(spark, path, O.ObservationFilter(start_ms=1_704_500_000_000, end_ms=1_706_000_000_000, bbox=(-10, 30, -60, 20))).select("event_id", "cell")


@query(OBS + "SELECT source, count(*) AS n, true AS median_within, true AS p99_within FROM p WHERE wave_height_m IS NOT NULL GROUP BY source")
def sketched_quantiles(spark, d):
    """Quantiles from sketches of days and cells, merged by source: whether their ranks are within 0.2 % of what was asked for."""
    o = obs(spark, d)
    shares = {"median": 0.5, "p99": 0.99}
    found = A.merged_quantiles(A.quantile_sketches(o, "wave_height_m", ["source", "cell"]), shares, ["source"])
    rows = o.filter("wave_height_m is not null").join(found, "source").groupBy("source", "n")
    below = {c: (F.count_if(F.col("wave_height_m") < F.col(c)), F.count_if(F.col("wave_height_m") <= F.col(c))) for c in shares}
    return rows.agg(*[((lo / F.count("*") <= p + 0.002) & (hi / F.count("*") >= p - 0.002)).alias(f"{c}_within") for (c, p), (lo, hi) in zip(shares.items(), below.values())])


CELL = "CAST(least(greatest(floor({y} + 90), 0), 179) * 360 + least(greatest(floor({x} + 180 - 360 * floor(({x} + 180) / 360)), 0), 359) AS INTEGER)"
WRAPPED = "({x} + 180 - 360 * floor(({x} + 180) / 360)) - 180"


@query(f"""WITH {SUPPLIERS}, {CUSTOMERS}, o AS (SELECT DISTINCT {CELL.format(y='lat', x='lon')} AS cell_id FROM s), m AS (SELECT dy, dx FROM range(-4, 5) a(dy), range(-4, 5) b(dx)),
t AS (SELECT c_custkey, greatest(abs(dy), abs(dx)) AS ring, sqrt(dy * dy + power(dx * cos(radians(plat)), 2)) AS far, dy, dx, plat + dy AS y, CASE WHEN dy = 0 AND dx = 0 THEN plon ELSE {WRAPPED.format(x='(plon + dx)')} END AS x FROM c, m),
h AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ring, far, dy, dx) AS n FROM t WHERE (abs(y) <= 90 OR ring = 0) AND {CELL.format(y='y', x='x')} IN (SELECT cell_id FROM o))
SELECT c.c_custkey, round(y, 4) AS ocean_latitude, round(x, 4) AS ocean_longitude, CAST(ring AS INTEGER) AS ring FROM c LEFT JOIN h ON h.c_custkey = c.c_custkey AND n = 1""")
def nearest_ocean_cells(spark, d):
    ocean = suppliers(spark, d).select(S.mask_cell(F.col("latitude"), F.col("longitude")).alias("cell_id"))
    return L.nearest_ocean(customers(spark, d), ocean, "c_custkey").select("c_custkey", *r4("ocean_latitude", "ocean_longitude"), "ring")


@query(f"""WITH {SUPPLIERS}, {CUSTOMERS}, j AS (SELECT s_suppkey, plat, plon, {HAV.format(a='lat', b='plat', c='lon', d='plon')} AS km FROM s, c WHERE c_acctbal > 0 AND abs(lat - plat) <= 5 AND abs(lon - plon) <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, plat, plon) AS n FROM j)
SELECT s.s_suppkey, round(plat, 4) AS cell_latitude, round(plon, 4) AS cell_longitude, round(km, 3) AS distance_km FROM s LEFT JOIN r ON r.s_suppkey = s.s_suppkey AND n = 1""")
def resolved_cells(spark, d):
    gridded = customers(spark, d).withColumn("v", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return L.resolve_cells(suppliers(spark, d), gridded, "s_suppkey", "v", 5.0).select("s_suppkey", *r4("cell_latitude", "cell_longitude"), F.round("distance_km", 3).alias("distance_km"))


DIRECTIONS = "(VALUES (1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1), (5, 1, 1), (6, 1, -1), (7, -1, 1), (8, -1, -1)) d(k, dy, dx)"


@query(f"""WITH {SUPPLIERS}, {CUSTOMERS}, o AS (SELECT DISTINCT floor(plat) AS y, floor(plon) AS x FROM c),
m AS (SELECT 0 AS ordinal, 0.0::DOUBLE AS dy, 0.0::DOUBLE AS dx UNION ALL SELECT 8 * i + k, step * dy, step * dx FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5), (2, 1.0)) st(i, step), {DIRECTIONS}),
t AS (SELECT s_suppkey, ordinal, greatest(-90.0, least(90.0, lat + dy)) AS y, CASE WHEN ordinal = 0 THEN lon ELSE {WRAPPED.format(x='(lon + dx)')} END AS x FROM s, m),
h AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY ordinal) AS n FROM t WHERE EXISTS (SELECT 1 FROM o WHERE o.y = floor(t.y) AND o.x = floor(t.x)))
SELECT s.s_suppkey, round(y, 4) AS marine_latitude, round(x, 4) AS marine_longitude FROM s LEFT JOIN h ON h.s_suppkey = s.s_suppkey AND n = 1""")
def marine_cell_search(spark, d):
    return L.marine_cells(suppliers(spark, d), customers(spark, d), "s_suppkey", cell=1.0).select("s_suppkey", *r4("marine_latitude", "marine_longitude"))


@query(f"""WITH RECURSIVE {CUSTOMERS}, o AS MATERIALIZED (SELECT DISTINCT CAST(floor(plat + 90) * 360 + floor(plon + 180) AS INTEGER) AS cell_id FROM c),
s AS (SELECT 0 AS step, 1.0::DOUBLE AS low, 40.0::DOUBLE AS high, NULL::DOUBLE AS best, false AS done UNION ALL
 SELECT step + 1, CASE WHEN n > 40 OR n = 0 THEN CASE WHEN n > 40 THEN sp ELSE low END ELSE low END, CASE WHEN n > 40 THEN high ELSE sp END, CASE WHEN n > 0 THEN sp ELSE best END, n > 0 AND abs(n - 40) <= 3
 FROM (SELECT t.step, t.low, t.high, t.best, t.sp, count(o.cell_id) AS n FROM (SELECT *, (low + high) / 2 AS sp FROM s WHERE NOT done AND step < 24) t
  LEFT JOIN (SELECT i, j FROM range(161) a(i), range(361) b(j)) g ON g.i < floor(160 / t.sp + 1) AND -80 + t.sp / 2 + g.i * t.sp <= 80 AND g.j < greatest(1, round_even(360.0 * cos(radians(-80 + t.sp / 2 + g.i * t.sp)) / t.sp, 0))
  LEFT JOIN o ON o.cell_id = CAST(floor(round_even(-80 + t.sp / 2 + g.i * t.sp, 4) + 90) * 360 + floor(round_even(-180.0::DOUBLE + (g.j + 0.5::DOUBLE) * 360.0::DOUBLE / greatest(1, round_even(360.0 * cos(radians(-80 + t.sp / 2 + g.i * t.sp)) / t.sp, 0)), 4) + 180) AS INTEGER)
  GROUP BY t.step, t.low, t.high, t.best, t.sp)),
f AS (SELECT best AS sp FROM s ORDER BY step DESC LIMIT 1), b AS (SELECT sp, -80 + sp / 2 + i * sp AS y FROM f, range(161) a(i) WHERE i < floor(160 / sp + 1) AND -80 + sp / 2 + i * sp <= 80),
n AS (SELECT *, CAST(greatest(1, round_even(360.0 * cos(radians(y)) / sp, 0)) AS INTEGER) AS n FROM b), p AS (SELECT round_even(y, 4) AS latitude, round_even(-180.0::DOUBLE + (j + 0.5::DOUBLE) * 360.0::DOUBLE / n, 4) AS longitude FROM (SELECT *, unnest(range(n)) AS j FROM n))
SELECT printf('%.4f', latitude) || '|' || printf('%.4f', longitude) AS grid_id, latitude, longitude FROM p WHERE CAST(floor(latitude + 90) * 360 + floor(longitude + 180) AS INTEGER) IN (SELECT cell_id FROM o)""")
def ocean_sample_grid(spark, d):
    ocean = customers(spark, d).select(S.mask_cell(F.col("latitude"), F.col("longitude")).alias("cell_id")).distinct()
    return L.grid_rows(L.macro_grid(spark, ocean, 40)).select("grid_id", "latitude", "longitude")


@query(f"""WITH {SUPPLIERS}, {CUSTOMERS}, r AS (SELECT s_suppkey AS port_id, s_suppkey % 3 AS dataset, lat, lon, greatest(DATE '2023-01-01' + CAST(s_suppkey % 50 AS INTEGER), DATE '2023-01-10') AS a, least(DATE '2023-01-01' + CAST(s_suppkey % 90 AS INTEGER), DATE '2023-03-20') AS b FROM s),
h AS (SELECT *, EXISTS (SELECT 1 FROM c WHERE c_custkey % 3 = dataset AND plat - 9 <= lat - 0.25 AND plat + 9 >= lat + 0.25 AND plon - 9 <= lon - 0.25 AND plon + 9 >= lon + 0.25) AS held FROM r),
f AS (SELECT port_id, unnest(generate_series(a, b, INTERVAL 30 DAY))::DATE AS chunk_start, b FROM h WHERE a <= b AND NOT held)
SELECT port_id, 'fetch' AS status, chunk_start, least(chunk_start + 29, b) AS chunk_end FROM f
UNION ALL SELECT port_id, CASE WHEN a > b THEN 'out_of_range' ELSE 'cached' END, NULL, NULL FROM h WHERE a > b OR held""")
def backfill_plan(spark, d):
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), (F.col("s_suppkey") % n).cast("int"))
    asked = suppliers(spark, d).withColumns(L.point_box(F.col("latitude"), F.col("longitude")))
    asked = asked.select(F.col("s_suppkey").alias("port_id"), (F.col("s_suppkey") % 3).cast("string").alias("dataset"), "min_lat", "max_lat", "min_lon", "max_lon", day(50).alias("start_date"), day(90).alias("end_date"))
    cover = asked.select("dataset").distinct().select("dataset", F.lit("2023-01-10").cast("date").alias("low_date"), F.lit("2023-03-20").cast("date").alias("high_date"))
    box = {f"{e}_{a}": F.col(c) + s * 9 for e, s in (("min", -1), ("max", 1)) for a, c in (("lat", "latitude"), ("lon", "longitude"))}
    ledger = customers(spark, d).withColumns(box).select((F.col("c_custkey") % 3).cast("string").alias("dataset"), *box, F.lit(0).cast("long").alias("start_timestamp"), F.lit(O.LAST_MS).alias("end_timestamp"))
    return P.backfill_plan(asked, cover, ledger, 30).select("port_id", "status", "chunk_start", "chunk_end")


SPEC = {"start": "2024-01-03", "end": "2024-01-12", "scope_mode": "bbox", "min_lat": -40, "max_lat": 60, "mode": "aggregated", "interval": "1d", "fill": "none", "derived_features": True}


@query(OBS + f""", k AS (SELECT date_trunc('day', time) AS w, count(*) AS n, avg(sst_celsius) AS sst, avg(wave_power_kw_m) AS pw FROM p WHERE NOT is_forecast AND latitude BETWEEN -40 AND 60 AND time >= '2024-01-03' AND time < '2024-01-13' GROUP BY ALL),
g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-13', INTERVAL 1 DAY)) AS w)
SELECT g.w AS window_start, coalesce(n, 0) AS observation_count, CAST(sum(coalesce(n, 0)) OVER (ORDER BY g.w) AS BIGINT) AS cumulative_observations, round(sst, 6) AS sst_celsius, round(CASE WHEN count(sst) OVER () >= 8 AND count(sst) OVER b >= 5 AND stddev_pop(sst) OVER b > 1e-9 THEN (sst - avg(sst) OVER b) / stddev_pop(sst) OVER b END, 4) AS sst_celsius_z, round(coalesce(pw * 24, 0), 3) AS wave_energy_kwh_m, round(ln(1 + coalesce(pw * 24, 0)), 4) AS log1p_wave_energy_kwh_m FROM g LEFT JOIN k ON g.w = k.w WINDOW b AS (ORDER BY g.w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def export_by_spec(spark, d):
    out = exports.run_spec(obs(spark, d), SPEC)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "observation_count", "cumulative_observations", *r6("sst_celsius"), *r4("sst_celsius_z", "log1p_wave_energy_kwh_m"), F.round("wave_energy_kwh_m", 3).alias("wave_energy_kwh_m"))


@query(OBS + f"SELECT strftime(date_trunc('second', time), '%Y-%m-%dT%H:%M:%SZ') AS time, latitude, longitude, {sq('wave_height_m', 'wave_power_kw_m')}, is_forecast FROM p")
def raw_export(spark, d):
    rows = exports.raw_projection(obs(spark, d).drop("source"))
    return exports.csv_rows(rows).select("time", "latitude", "longitude", *r4("wave_height_m", "wave_power_kw_m"), "is_forecast")


@query(OBS + """SELECT count(*) AS n, 16 AS n_columns, strftime(min(time), '%Y-%m-%d') AS first_day, strftime(max(time), '%Y-%m-%d') AS last_day, 'analysis' AS sst_nature, 'CC BY 4.0' AS licence, 5 AS n_providers FROM obs""")
def export_manifest(spark, d):
    made = exports.manifest(exports.raw_projection(obs(spark, d)), SPEC)
    entry = "array<struct<column:string,nature:string>>"
    got = lambda path: F.get_json_object("manifest", path)
    sst = F.filter(F.from_json(got("$.data_dictionary"), entry), lambda e: e["column"] == "sst_celsius")[0]["nature"]
    givers = F.from_json(got("$.providers"), "array<struct<provider:string,licence:string>>")
    licence = F.filter(givers, lambda p: p["provider"] == "Open-Meteo Marine")[0]["licence"]
    return made.select(got("$.result.rows").cast("long").alias("n"), F.json_array_length(got("$.data_dictionary")).alias("n_columns"), F.substring(got("$.result.time_covered.first"), 1, 10).alias("first_day"), F.substring(got("$.result.time_covered.last"), 1, 10).alias("last_day"), sst.alias("sst_nature"), licence.alias("licence"), F.size(givers).alias("n_providers"))


@query(f"WITH {CUSTOMERS}, {SUPPLIERS}, g AS (SELECT c_custkey % 500 AS k, 0 AS kind, CAST(c_acctbal AS BIGINT) AS pop FROM c UNION ALL SELECT s_suppkey % 500 + 400, 1, CAST(s_acctbal AS BIGINT) FROM s), f AS (SELECT k, min(kind) AS kind, arg_max(pop, struct_pack(a := -kind, b := pop)) AS pop FROM g GROUP BY k) SELECT count(*) AS entries, count(*) FILTER (WHERE kind = 0) AS ports, count(*) FILTER (WHERE kind = 1) AS cities, count(*) FILTER (WHERE kind = 0 AND pop > 0) AS enriched, (SELECT n_name FROM nation WHERE n_nationkey = 6) AS country FROM f")
def gazetteer_figures(spark, d):
    row = lambda df, key, shift, name, pop, src: df.select((F.col(key) % 500 + shift).cast("string").alias("port_id"), F.col(name).alias("port_name"), F.lit("FR").alias("country_code"), F.lit("").alias("country_name"), F.round(pop).cast("long").alias("population"), F.lit(src).alias("source"))
    ports = row(customers(spark, d), "c_custkey", 0, "c_name", "c_acctbal", "wpi")
    cities = row(suppliers(spark, d), "s_suppkey", 400, "s_name", "s_acctbal", "geonames")
    names = read(spark, d, "nation").filter("n_nationkey = 6").select(F.lit("FR").alias("country_code"), F.col("n_name").alias("country_name"))
    built = P.build_gazetteer(ports, cities, names)
    return L.gazetteer_counts(built).crossJoin(built.agg(F.when(F.count_distinct("country_name") == 1, F.min("country_name")).alias("country")))  # one row each


@query(OBS + "SELECT event_id, printf('%.2f°', abs(latitude)) || CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END || ' ' || printf('%.2f°', abs(longitude)) || CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS place, strftime(time, '%Y-%m-%d %H:%M UTC') AS at, CASE WHEN current_velocity_kmh < 2 THEN '0–2 km/h' WHEN current_velocity_kmh < 5 THEN '2–5 km/h' WHEN current_velocity_kmh < 10 THEN '5–10 km/h' ELSE 'over 10 km/h' END AS band FROM obs")
def reading_labels(spark, d):
    o = obs(spark, d)
    return o.select("event_id", S.latlon_text(F.col("latitude"), F.col("longitude")).alias("place"), S.utc_text(F.col("time")).alias("at"), S.current_band(F.col("current_velocity_kmh")).alias("band"))


@query(f"WITH {CUSTOMERS}, {SUPPLIERS} SELECT CAST(c_custkey AS VARCHAR) AS grid_id, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal > 0 END AS is_valid, CASE WHEN s_acctbal > 0 THEN 0 WHEN s_suppkey IS NOT NULL THEN 1 ELSE 0 END AS fail_count FROM c LEFT JOIN s ON s_suppkey = c_custkey WHERE s_suppkey IS NULL OR s_acctbal > 0")
def probed_cells(spark, d):
    points = L.grid_rows(customers(spark, d)).drop("grid_id").withColumn("grid_id", F.lit(""))
    grid = customers(spark, d).select(F.col("c_custkey").cast("string").alias("grid_id"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) if c != "is_ocean" else F.lit(True).alias(c) for c in points.columns if c != "grid_id"])
    probes = suppliers(spark, d).select(F.col("s_suppkey").cast("string").alias("grid_id"), (F.col("s_acctbal") > 0).alias("had_data"))
    return O.usable_cells(O.mark_probes(grid, probes, 1)).select("grid_id", "is_valid", F.coalesce("fail_count", F.lit(0)).alias("fail_count"))


@query(OBS + "SELECT cell, CAST(min(time) AS DATE) AS first_day, CAST(max(time) AS DATE) AS last_day, count(*) AS n FROM obs GROUP BY cell")
def scope_summaries(spark, d):
    return L.scope_summary(obs(spark, d), ["cell"])


#: The files may come in any order of time, so no row is too late and no cell silent.
ALWAYS = timedelta(days=36_500)


def streamed(spark, d):
    """events as a stream of observations."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/events*.parquet")
    return obs(spark, d, events).withColumn("time", F.col("time").cast("timestamp"))


@query(DAYS + ", n AS (SELECT cell, date_trunc('day', time) AS day, count(*) AS n FROM p GROUP BY ALL) SELECT d.cell, d.day AS window_start, n AS observation_count, round(d.sst_celsius, 6) AS sst_celsius, round(d.wave_height_m, 6) AS wave_height_m FROM d JOIN n ON n.cell = d.cell AND n.day = d.day")
def streamed_resample(spark, d):
    out = folder(spark, "resampled")
    # The files may come in any order of time: no row of the table is too late.
    X.write_updates(X.resample_stream(streamed(spark, d), "1d", ["cell"], late="36500 days"), f"{out}/rows", f"{out}/log").awaitTermination()
    return X.newest(spark, f"{out}/rows", ["cell", "window_start"]).select("cell", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "observation_count", *[F.round(c, 6).alias(c) for c in ("sst_celsius", "wave_height_m")])


@query(OBS + "SELECT cell, round(arg_max(sst_celsius, struct_pack(t := time, v := sst_celsius)) FILTER (WHERE sst_celsius IS NOT NULL), 4) AS sst_celsius, round(arg_max(wave_height_m, struct_pack(t := time, v := wave_height_m)), 4) AS wave_height_m FROM p GROUP BY cell")
def streamed_latest(spark, d):
    out = folder(spark, "latest")
    X.write_updates(X.live_cells(streamed(spark, d), ["cell"], ["sst_celsius", "wave_height_m"], late="36500 days", silent=ALWAYS), f"{out}/rows", f"{out}/log").awaitTermination()
    return X.newest(spark, f"{out}/rows", ["cell"]).select("cell", *r4("sst_celsius", "wave_height_m"))


@query(OBS + ", h AS (SELECT latitude, longitude, date_trunc('day', time) AS t, event_id, wave_height_m, sst_celsius, is_forecast FROM obs) SELECT round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, CAST(epoch_us(t) // 1000 AS BIGINT) AS timestamp, round(arg_max(wave_height_m, event_id), 4) AS wave_height_m, round(arg_max(sst_celsius, event_id) FILTER (WHERE sst_celsius IS NOT NULL), 4) AS sst_celsius, bool_and(is_forecast) AS is_forecast FROM h GROUP BY latitude, longitude, t")
def streamed_merge(spark, d):
    """Events of a day at a cell are versions of one reading, merged in the order of their ids."""
    rows = streamed(spark, d).withColumn("timestamp", F.unix_millis(F.date_trunc("DAY", "time"))).withColumn("source", F.lit("open_meteo")).withColumn("port_id", F.lit(None).cast("string")).withColumn("is_historical_cache", F.lit(False)).withColumn("ingest_seq", F.col("event_id"))
    out = folder(spark, "merged")
    X.merge_stream(rows, f"{out}/table", f"{out}/log", lambda: 0, f"{out}/metrics").awaitTermination()
    return X.stored(spark, f"{out}/table").select(*r4("latitude", "longitude"), "timestamp", *r4("wave_height_m", "sst_celsius"), "is_forecast")


@query(f"""WITH {SUPPLIERS}, {CUSTOMERS}, r AS (SELECT s_suppkey, c_custkey AS place, {HAV.format(a='lat', b='plat', c='lon', d='plon')} AS km FROM s, c),
n AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, place) AS rank FROM r)
SELECT s_suppkey, place, rank, round(km, 3) AS distance_km FROM n WHERE rank <= 3""")
def exact_nearest_three(spark, d):
    found = P.exact_nearest_places(suppliers(spark, d), customers(spark, d), "s_suppkey", "c_custkey", 3)
    return found.select("s_suppkey", "place", "rank", F.round("distance_km", 3).alias("distance_km"))


SEAM = "least(abs(lon - plon), 360 - abs(lon - plon))"


@query(f"""WITH {SUPPLIERS}, {CUSTOMERS}, j AS (SELECT s_suppkey, c_custkey AS place, {HAV.format(a='lat', b='plat', c='lon', d='plon')} AS km, greatest(abs(lat - plat), {SEAM}) AS apart FROM s, c),
m AS (SELECT *, min(CASE WHEN apart <= 2 THEN 1 WHEN apart <= 5 THEN 2 WHEN apart <= 15 THEN 3 ELSE 4 END) OVER (PARTITION BY s_suppkey) AS best FROM j WHERE apart <= 45),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, place) AS rank FROM m WHERE apart <= [2, 5, 15, 45][best])
SELECT s_suppkey, place, round(km, 3) AS distance_km FROM r WHERE rank = 1""")
def nearest_across_seam(spark, d):
    found = P.nearest_places(suppliers(spark, d), customers(spark, d), "s_suppkey", "c_custkey", wrap=True)
    return found.select("s_suppkey", "place", F.round("distance_km", 3).alias("distance_km"))


@query(f"""WITH {SUPPLIERS}, c AS (SELECT CAST(c_acctbal AS BIGINT) AS pop, {XY.format(k='c_custkey', a=389, b=1117, p='p')} FROM customer)
SELECT s_suppkey, max(pop) AS city_population FROM s LEFT JOIN c ON pop > 0 AND abs(floor(lat) - floor(plat)) <= 1 AND least(abs(floor(lon) - floor(plon)), 360 - abs(floor(lon) - floor(plon))) <= 1 AND {HAV.format(a='lat', b='plat', c='lon', d='plon')} <= 100 GROUP BY s_suppkey""")
def port_population_across_seam(spark, d):
    cities = customers(spark, d).withColumn("population", F.bround("c_acctbal").cast("long"))
    return P.attach_city_population(suppliers(spark, d), cities, "s_suppkey", 100.0, wrap=True).select("s_suppkey", "city_population")


@query(DAYS + """, b AS (SELECT cell, min(day) AS lo, max(day) AS hi FROM d GROUP BY cell), g AS (SELECT cell, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM b),
c AS (SELECT g.cell, g.day, wave_height_m FROM g LEFT JOIN d ON d.cell = g.cell AND d.day = g.day),
q AS (SELECT *, coalesce(count(wave_height_m) OVER w >= 10 AND wave_height_m > quantile_cont(wave_height_m, 0.5) OVER w, false) AS hot, row_number() OVER (PARTITION BY cell ORDER BY day) AS rn FROM c WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, rn - sum(CASE WHEN hot THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY day) AS island FROM q)
SELECT cell, day, hot AND count(*) OVER (PARTITION BY cell, hot, island) >= 2 AS warm_spell FROM i""")
def calendar_warm_spells(spark, d):
    out = R.warm_spells(obs(spark, d), "wave_height_m", ["cell"], "time", 30, 0.5, 2, calendar=True)
    return out.select("cell", F.col("day").cast("timestamp_ntz").alias("day"), "warm_spell")


@query(f"""WITH {SUPPLIERS}, {CUSTOMERS}, n AS (SELECT s_suppkey + 5 AS k, s_name, lat, lon, CASE WHEN s_acctbal > 0 THEN lat + 0.5 END AS cell, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS elevation FROM s)
SELECT CAST(coalesce(n.k, c.c_custkey) AS VARCHAR) AS port_id, coalesce(s_name, c_name) AS port_name, round(coalesce(plat, lat), 4) AS latitude, round(coalesce(cell, plat), 4) AS marine_latitude, round(coalesce(elevation, c_acctbal), 4) AS elevation_m, CAST(CASE WHEN c_custkey IS NULL THEN 2 ELSE 1 END AS BIGINT) AS added_at FROM c FULL JOIN n ON n.k = c.c_custkey""")
def tracked_ports(spark, d):
    """Customers as the ports tracked so far, suppliers as ports added to them."""
    def port(df, key, name, added, cell, elevation):
        null = lambda t: F.lit(None).cast(t)
        return df.select(key.cast("string").alias("port_id"), F.col(name).alias("port_name"), F.lit("xx").alias("country_code"), null("string").alias("country_name"), "latitude", "longitude", cell.alias("marine_latitude"), cell.alias("marine_longitude"), elevation.alias("elevation_m"), F.lit(added).cast("long").alias("added_at"), null("long").alias("last_polled_at"), null("long").alias("backfilled_to"))

    old = port(customers(spark, d), F.col("c_custkey"), "c_name", 1, F.col("latitude"), F.col("c_acctbal"))
    new = port(suppliers(spark, d), F.col("s_suppkey") + 5, "s_name", 2, F.when(F.col("s_acctbal") > 0, F.col("latitude") + 0.5), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")))
    return O.upsert_tracked_ports(old, new).select("port_id", "port_name", *r4("latitude", "marine_latitude", "elevation_m"), "added_at")


@query(OBS + """SELECT event_id, round(latitude, 3) || ',' || round(longitude, 3) AS place, CASE WHEN sst_celsius IS NULL THEN latitude ELSE sst_celsius END AS either, epoch_us(time) // 1000 > 1704500000000 AS ahead,
 ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][(floor(wave_direction_deg / 22.5 + 0.5)::INT % 16) + 1] || ' ' || wave_direction_deg::INT || '°' AS heading,
 CASE WHEN age < 0 THEN 'in ' || floor(-age / 60)::BIGINT || 'm' WHEN age < 60 THEN age || 's ago' WHEN age < 3600 THEN floor(age / 60)::BIGINT || 'm ago' WHEN age < 86400 THEN floor(age / 3600)::BIGINT || 'h ago' ELSE floor(age / 86400)::BIGINT || 'd ago' END AS age,
 coalesce(printf('%.2f', sst_celsius) || ' °C', '–') AS shown, round(latitude + (1.6 + 6 * current_velocity_kmh / 150) * cos(radians(wave_direction_deg)), 9) AS arrow_lat,
 round(longitude + (1.6 + 6 * current_velocity_kmh / 150) * sin(radians(wave_direction_deg)) / greatest(0.25, cos(radians(latitude))), 9) AS arrow_lon,
 coalesce(wave_height_m > 1 AND sst_celsius > 12, false) AS both_high, longitude - 360 * floor(longitude / 360) AS lon_0360, event_id % 2 = 1 AS moved, CAST(time AS DATE) - 45 AS mask_day,
 CASE WHEN size < 1000 THEN size || ' B' WHEN size < 1000000 THEN printf('%.1f kB', size / 1e3) WHEN size < 1e9 THEN printf('%.1f MB', size / 1e6) ELSE printf('%.1f GB', size / 1e9) END AS bytes
 FROM (SELECT *, (event_id * 7919) % 400000 - 1000 AS age, event_id * event_id * 31 AS size FROM obs)""")
def reading_functions(spark, d):
    o = obs(spark, d)
    col, lat, lon, odd = F.col, F.col("latitude"), F.col("longitude"), F.col("event_id") % 2
    to_lat, to_lon = S.flow_arrow(lat, lon, col("wave_direction_deg"), col("current_velocity_kmh"), F.lit(150.0))
    return o.select(
        "event_id", S.cell_key(lat, lon).alias("place"), S.marine_coordinate(col("sst_celsius"), lat).alias("either"), S.forecast_flag(col("timestamp"), 1_704_500_000_000).alias("ahead"), S.bearing_text(col("wave_direction_deg")).alias("heading"),
        S.age_text((col("event_id") * 7919) % 400_000 - 1000).alias("age"), S.number_text(col("sst_celsius"), 2, "°C").alias("shown"), F.round(to_lat, 9).alias("arrow_lat"), F.round(to_lon, 9).alias("arrow_lon"),
        S.joint_anomaly(col("wave_height_m") - 1 + 2, col("sst_celsius") - 12 + 2).alias("both_high"), S.encode_longitude(lon, "0360").alias("lon_0360"), S.moved_cell(lat, lon, lat + odd * 0.02, lon).alias("moved"),
        S.mask_date(F.to_date("time")).alias("mask_day"), S.bytes_text(col("event_id") * col("event_id") * 31).alias("bytes"),
    )


@query(f"WITH {CUSTOMERS} SELECT c_custkey, c_name || ', ' || n_name || CASE WHEN c_custkey % 2 = 0 THEN ', North Sea' ELSE '' END AS label FROM c JOIN nation ON n_nationkey = c_nationkey")
def place_labels(spark, d):
    rows = customers(spark, d).join(F.broadcast(read(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    label = S.place_label(F.col("c_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("n_name")).otherwise(F.lit(" ")), F.col("n_name"), F.lit("North Sea"), F.when(F.col("c_custkey") % 2 == 0, "wpi").otherwise("geonames"))
    return rows.select("c_custkey", label.alias("label"))


@query(OBS + ", l AS (SELECT cell, arg_max(wave_power_kw_m, struct_pack(t := time, v := wave_power_kw_m)) FILTER (WHERE wave_power_kw_m IS NOT NULL) AS pw, max(time) AS latest FROM p GROUP BY cell) SELECT round(max(pw), 4) AS peak_power, (SELECT cell FROM l WHERE pw IS NOT NULL ORDER BY pw DESC, cell LIMIT 1) AS peak_cell, count(pw) AS cells, max(latest) AS newest FROM l")
def pulse_figures(spark, d):
    latest = A.latest_per_cell(obs(spark, d), ["cell"], ["wave_power_kw_m"], "time")
    return A.pulse(latest, "wave_power_kw_m", "cell").select(*r4("peak_power"), "peak_cell", "cells", "newest")


@query(DAYS + """, n AS (SELECT cell, count(sst_celsius) AS n FROM p GROUP BY cell), z AS (SELECT cell, day, CASE WHEN count(sst_celsius) OVER w >= 8 AND stddev_pop(sst_celsius) OVER w > 1e-9 THEN (sst_celsius - avg(sst_celsius) OVER w) / stddev_pop(sst_celsius) OVER w END AS z FROM d WHERE sst_celsius IS NOT NULL WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
l AS (SELECT cell, arg_max(z, day) FILTER (WHERE z IS NOT NULL) AS z, count(*) AS days FROM z GROUP BY cell) SELECT round(max(z), 4) AS max_z, count(*) FILTER (WHERE z > 0.5) AS cells_over, count(z) AS cells FROM l JOIN n USING (cell) WHERE n >= 24 AND days >= 10""")
def sst_anomaly_figures(spark, d):
    return A.sst_anomalies(obs(spark, d), "cell", threshold=0.5).select(*r4("max_z"), "cells_over", "cells")


@query(OBS + "SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_forecast) AS analyses, CAST(epoch_us(min(time)) // 1000 AS BIGINT) AS first_ts, CAST(epoch_us(max(time)) // 1000 AS BIGINT) AS last_ts, count(DISTINCT source) AS ports FROM obs")
def store_figures(spark, d):
    return A.store_statistics(obs(spark, d).withColumn("port_id", F.col("source")))


@query(OBS + "SELECT source, CAST(epoch_us(max(time)) // 1000 AS BIGINT) AS latest FROM obs WHERE NOT is_forecast GROUP BY source")
def latest_analyses(spark, d):
    return A.latest_analysis(obs(spark, d), ["source"])


@query(OBS + ", h AS (SELECT event_id, cell, source FROM obs), f AS (SELECT cell, source, min(event_id) AS first FROM h GROUP BY ALL) SELECT cell, string_agg(source, ',' ORDER BY first) AS sources FROM f GROUP BY cell")
def contributing_sources(spark, d):
    """The sources of each cell's merged reading, in order of arrival."""
    o = obs(spark, d).withColumn("obs_id", F.col("cell")).withColumn("ingest_seq", F.col("event_id")).withColumn("port_id", F.lit(None).cast("string")).withColumn("is_historical_cache", F.lit(False))
    return O.merge_observations(o).select(F.col("obs_id").alias("cell"), F.array_join("sources", ",").alias("sources"))


@query(OBS + "SELECT event_id FROM obs WHERE NOT is_forecast AND epoch_us(time) // 1000 BETWEEN 1704067200000 + 86400000 * 10 - 86400000 * 7 AND 1704067200000 + 86400000 * 10 AND source = (SELECT min(source) FROM obs)")
def readings_looked_back(spark, d):
    """Seven days of one port's analyses."""
    o = obs(spark, d)
    port = o.agg(F.min("source")).first()[0]
    return O.look_back(o.withColumn("port_id", F.col("source")), 1_704_067_200_000 + 86_400_000 * 10, 7, port).select("event_id")


@query(f"WITH {CUSTOMERS} SELECT c_custkey % 40 AS k, min(c_custkey) FILTER (WHERE c_acctbal > 5000) AS hit, min(c_custkey) AS any_key FROM c GROUP BY ALL HAVING max(c_acctbal) > 5000")
def pooled_candidates(spark, d):
    """Candidates from two searches, each once, the first search's row first."""
    c = customers(spark, d).withColumn("k", F.col("c_custkey") % 40)
    rich = c.filter("c_acctbal > 5000").groupBy("k").agg(F.min("c_custkey").alias("hit"))
    every = c.groupBy("k").agg(F.min("c_custkey").alias("any_key"))
    pool = Q.search_pool(rich, every.select("k", F.lit(None).cast("long").alias("hit")), ["k"])
    return pool.filter("hit is not null").join(every, "k").select("k", "hit", "any_key")
