"""Operators without SQL, against brute force and written-out cases."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.operators import observations as O
from saltmarsh.operators import places as P
from saltmarsh.operators import search as Q
from saltmarsh.operators import planning as L
from saltmarsh.operators import series as R
from saltmarsh.schema import MEASURES, SAVED
from saltmarsh.sources import exports, readers
from saltmarsh.streaming import observations as X


def mask_cell(lat, lon):
    return min(179, max(0, math.floor(lat + 90))) * 360 + min(359, max(0, math.floor((lon + 180) % 360)))


def test_nearest_ocean(spark):
    ocean = {mask_cell(0.5, 0.5), mask_cell(10.5, -179.5), mask_cell(60.5, 20.5)}
    points = {"in": (0.5, 0.5), "two": (2.5, 1.5), "seam": (10.5, 178.5), "none": (-50.5, 50.5), "pole": (89.9, 0.0), "north": (60.2, 23.7)}
    got = {r[0]: r for r in L.nearest_ocean(spark.createDataFrame([(k, *v) for k, v in points.items()], "k string, latitude double, longitude double"), spark.createDataFrame([(c,) for c in ocean], "cell_id int"), "k").collect()}
    for k, (lat, lon) in points.items():
        rings = sorted((max(abs(y), abs(x)), math.hypot(y, x * math.cos(math.radians(lat))), y, x) for y in range(-4, 5) for x in range(-4, 5) if abs(lat + y) <= 90 and mask_cell(lat + y, lon + x) in ocean)
        want = rings[0] if rings else None
        assert (got[k].ring is None) == (want is None)
        if want:
            assert got[k].ring == want[0]
            assert got[k].ocean_latitude == pytest.approx(lat + want[2])
            assert got[k].ocean_longitude == pytest.approx((lon + want[3] + 180) % 360 - 180)


def test_marine_cells_take_the_first_candidate(spark):
    points = spark.createDataFrame([("a", 10.1, 20.1), ("b", 0.1, 179.9), ("c", -40.0, 0.0)], "k string, latitude double, longitude double")
    assert L.candidate_cells(points, "k").count() == 75
    assert L.candidate_cells(points, "k", 0.5).count() == 51
    data = spark.createDataFrame([(10.4, 20.1), (10.1, 20.4), (0.1, -179.9)], "latitude double, longitude double")
    got = {r[0]: r[1:] for r in L.marine_cells(points, data, "k").collect()}
    assert got["a"] == pytest.approx((10.35, 20.1))  # north comes before east
    assert got["b"] == pytest.approx((0.1, -179.85))
    assert got["c"] == (None, None)


def test_macro_grid_hits_the_target(spark):
    ocean = spark.range(64800).filter("id % 3 <> 0").select(F.col("id").cast("int").alias("cell_id"))
    n = L.macro_grid(spark, ocean, 250).count()
    assert abs(n - 250) <= 6
    empty = ocean.limit(0)
    assert abs(L.macro_grid(spark, empty, 100).count() - 100) <= 3


def test_coverage_floor_and_report(spark):
    assert L.archive_floor() == "2021-12-01" and L.archive_floor(["sea_surface_temperature"]) == "2022-12-01" and L.archive_floor([]) == "2022-01-01"
    row = spark.sql("select date'2022-01-01' as d").select(L.available_from(F.col("d")).alias("m"), L.clamp_start(F.lit("2020-01-01").cast("date")).alias("s")).first()
    assert row.m["wave_height"] and not row.m["sea_surface_temperature"] and row.s == dt.date(2021, 12, 1)
    lines = spark.createDataFrame([("f", "attribute,time,actual_range,double,\"0.0, 86400.0\""), ("f", "attribute,sst,actual_range,double,\"1, 2\""), ("g", "attribute,time,actual_range,double,junk")], "file string, value string")
    assert [tuple(r) for r in readers.dataset_coverage(lines).select(F.unix_seconds("low"), F.unix_seconds("high")).collect()] == [(0, 86400)]
    plan = spark.createDataFrame([("p", "a", "fetch", dt.date(2024, 1, 1), dt.date(2024, 1, 9)), ("p", "a", "fetch", dt.date(2024, 1, 10), dt.date(2024, 1, 12)), ("p", "b", "cached", None, None), ("p", "c", "fetch", dt.date(2024, 1, 1), dt.date(2024, 1, 2)), ("p", "d", "out_of_range", None, None), ("p", "e", "fetch", dt.date(2024, 1, 1), dt.date(2024, 1, 2))], "port_id string, dataset string, status string, chunk_start date, chunk_end date")
    done = spark.createDataFrame([("p", "a", 5, False), ("p", "a", 2, False), ("p", "c", 0, False), ("p", "e", 0, True)], "port_id string, dataset string, row_count long, failed boolean")
    got = {r.dataset: (r.status, r.rows) for r in L.backfill_report(plan, done).collect()}
    assert got == {"a": ("fetched", 7), "b": ("cached", 0), "c": ("masked", 0), "d": ("out_of_range", 0), "e": ("error", 0)}


def test_readers_leave_out_what_they_cannot_read(spark):
    lines = spark.createDataFrame([("e", "Error {"), ("e", "    code=404;"), ("s", "time,latitude,longitude,sla,ugos,vgos"), ("s", "UTC,degrees_north,degrees_east,m,m/s,m/s"), ("s", "2024-01-01T00:00:00Z,10.0,350.0,0.1,NaN,0.3"), ("s", "2024-01-01T00:00:00Z,10.0,350.0,NaN,NaN,NaN"), ("s", "2024-01-01T00:00:00Z,10.0")], "file string, value string")
    rows = readers.gridded_observations(lines, "sla", "wpi:1").collect()
    assert [(r.latitude, r.longitude, r.sea_level_anomaly_m, r.geostrophic_u_ms, r.geostrophic_v_ms, r.source, r.is_historical_cache) for r in rows] == [(10.0, -10.0, 0.1, None, 0.3, "erddap_sla", True)]
    assert [r.file for r in readers.error_documents(lines).collect()] == ["e"]
    payloads = spark.createDataFrame([(1, '[{"latitude": 1, "longitude": 2, "hourly": {"time": ["2024-01-01T00:00", "junk", "2024-01-01T02:00"], "wave_height": [1.5, 2.0]}}, {"latitude": 5, "longitude": 6, "hourly": {"time": ["2024-01-01T00:00"], "wave_height": [null]}}, {"latitude": 5}]'), (2, "not json"), (3, None), (4, "{}")], "payload_id int, value string")
    hours = readers.marine_hours(payloads, 0)
    got = readers.marine_observations(hours).collect()
    assert [(r.latitude, r.wave_height_m, r.wave_period_s, r.is_forecast) for r in got] == [(1.0, 1.5, None, True)]
    assert {(r.payload_id, r.location): r.had_data for r in readers.had_data(hours).collect()}[(1, 0)] is True
    assert sum(r.had_data for r in readers.had_data(hours).collect()) == 1
    names = readers.country_names(spark.createDataFrame([("# c",), ("fr\tFRA\t250\tFR\tFrance",), ("",), ("x\ty",)], "value string")).collect()
    assert [tuple(r) for r in names] == [("FR", "France")]
    city = "1\tNice\tNice\tNizza\t43.7\t7.27\tP\tPPL\tfr\t\t\t\t\t\t342000\t\t\t\t"
    places = readers.city_rows(spark.createDataFrame([(city,), (city.replace("43.7", "x"),), ("short",), (city.replace("Nice\tNice", "\tNice"),)], "value string")).collect()
    assert [(r.port_id, r.alt_names, r.country_code, r.population) for r in places] == [("geonames:1", "Nizza", "FR", 342000)]
    assert spark.range(1).select(readers.title(F.lit("south-west o'brien SEA"))).first()[0] == "South-West O'Brien Sea"


def test_dms(spark):
    cases = {"33°52'00\"S": -33.866667, "12 30 0 N": 12.5, "7.5W": -7.5, "-12.25": -12.25, "north": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.dms(F.col("t")).alias("v")).collect()
    for r in got:
        assert (r.v is None) == (cases[r.t] is None), r
        assert r.v is None or r.v == pytest.approx(cases[r.t], abs=1e-5)


def test_exports_round_trip(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 5)
    obs = spark.createDataFrame([Row(timestamp=int(dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone.utc).timestamp() * 1000), latitude=1.0, longitude=2.0, port_id="p", wave_height_m=2.0, wave_period_s=8.0, is_forecast=False, sources=["a", "b"])])
    raw = exports.raw_projection(obs)
    assert raw.columns == exports.RAW_COLUMNS and raw.first().sources == "a,b" and raw.first().wave_power_kw_m == pytest.approx(15.7, abs=0.01)
    exports.export(raw, {"mode": "raw"}, f"file://{tmp_path}/x", "csv")
    back = spark.read.csv(f"file://{tmp_path}/x/data", header=True).first()
    assert back.time == "2024-01-01T05:00:00Z"
    made = json.loads(spark.read.text(f"file://{tmp_path}/x/manifest.json").first()[0])
    assert made["result"]["rows"] == 1 and made["query"] == {"mode": "raw"} and len(made["providers"]) == 5  # with the two gazetteers that port_id is from
    exports.write_parquet(raw, f"file://{tmp_path}/y")
    assert spark.read.parquet(f"file://{tmp_path}/y").first().time == t
    assert exports.file_name("a b/c", "csv", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)) == "a_b_c_20240101T000000Z.csv"
    empty = exports.run_spec(obs.limit(0), {"start": "2024-01-01", "end": "2024-01-02", "derived_features": True})
    full = exports.run_spec(obs, {"start": "2024-01-01", "end": "2024-01-02", "derived_features": True})
    assert empty.columns == full.columns and empty.count() == full.count() == 3
    assert exports.run_spec(obs, {"start": "2024-01-01", "end": "2024-01-02", "mode": "raw"}).columns == exports.RAW_COLUMNS


def test_saved_specs(spark):
    saved = spark.createDataFrame([("a", "{}", "", 1, None, None), ("b", "{}", "", 2, 9, 4)], SAVED)
    new = spark.createDataFrame([("a", "{1}", "n", 7), ("c", "{2}", "", 8)], "name string, spec_json string, notes string, created_at long")
    after = exports.save_specs(saved, new)
    assert {r.name: (r.spec_json, r.created_at) for r in after.collect()} == {"a": ("{1}", 1), "b": ("{}", 2), "c": ("{2}", 8)}
    runs = spark.createDataFrame([("a", 20, 3)], "name string, last_run_at long, last_rows long")
    assert [r.name for r in exports.list_specs(exports.mark_runs(after, runs)).collect()] == ["a", "b", "c"]
    assert exports.delete_specs(after, after.filter("name = 'a'")).count() == 2


def reading(seq, source, lat=0.0, ts=0, forecast=False, **values):
    return (lat, 0.0, ts, None, source, forecast, False, *[values.get(m) for m in MEASURES], seq)


READING = "latitude double, longitude double, timestamp long, port_id string, source string, is_forecast boolean, is_historical_cache boolean, " + ", ".join(f"{m} double" for m in MEASURES) + ", ingest_seq long"


def test_merge_across_batches_equals_one_merge(spark, tmp_path):
    rows = [
        reading(1, "erddap_sst", sst_celsius=20.0, forecast=True), reading(2, "open_meteo", sst_celsius=21.0, wave_height_m=1.0, forecast=True), reading(3, "erddap_sst", sst_celsius=25.0),
        reading(4, "erddap_sla", sea_level_anomaly_m=0.1, wave_height_m=9.0), reading(5, "open_meteo", wave_height_m=2.0, lat=1.0, ts=86_400_000), reading(6, "open_meteo", wave_height_m=3.0, lat=1.0, ts=86_400_000),
    ]
    columns = ["obs_id", *MEASURES, "is_forecast", "sources"]
    good, _ = O.validate(spark.createDataFrame(rows, READING))
    want = {r.obs_id: r for r in O.merge_observations(good).select(*columns).collect()}
    path = f"file://{tmp_path}/t"
    for part in (rows[:2], rows[2:5], rows[2:5], rows[5:], []):  # one batch twice, one empty
        X.merge_into(path, O.validate(spark.createDataFrame(part, READING))[0], 5)
    got = {r.obs_id: r for r in X.stored(spark, path).select(*columns).collect()}
    assert got == want
    sst = [r for r in got.values() if r.sst_celsius is not None]
    assert [(r.sst_celsius, r.wave_height_m, r.sea_level_anomaly_m, r.is_forecast, r.sources) for r in sst] == [(21.0, 1.0, 0.1, False, ["erddap_sst", "open_meteo", "erddap_sla"])]


def test_payload_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, h in enumerate((1.0, 2.0)):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"payload_id": i, "ingest_seq": i, "value": json.dumps({"latitude": 1, "longitude": 2, "hourly": {"time": ["2024-01-01T00:00"], "wave_height": [h]}})}))
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema("payload_id int, ingest_seq long, value string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        X.payload_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/log", lambda: 0, f"file://{tmp_path}/hits", f"file://{tmp_path}/metrics").awaitTermination()
    rows = X.stored(spark, f"file://{tmp_path}/t").collect()
    assert len(rows) == 1 and rows[0].wave_height_m in (1.0, 2.0) and rows[0].sources == ["open_meteo"]
    assert spark.read.parquet(f"file://{tmp_path}/metrics").agg(F.sum("rows")).first()[0] == 2
    assert spark.read.parquet(f"file://{tmp_path}/hits").filter("had_data").count() == 2


def test_fill_and_downsampling(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "i int, v double")
    get = lambda how: [r.v for r in R.fill_gaps(rows, ["v"], how, [], "i").orderBy("i").collect()]
    assert get("linear") == [1.0, 1.0, 2.0, 3.0, 3.0] and get("ffill") == [None, 1.0, 1.0, 3.0, 3.0] and get("zero") == [0.0, 1.0, 0.0, 3.0, 0.0]
    wave = spark.range(1000).select(F.lit("a").alias("k"), "id", F.when(F.col("id") == 500, 99.0).otherwise(F.sin(F.col("id") / 100)).alias("y"))
    kept = [r.id for r in R.lttb(wave, ["k"], "id", "y", 50).collect()]
    assert len(kept) == 50 and {0, 500, 999} <= set(kept)


def test_listings(spark):
    rows = spark.createDataFrame([(i, f"o{i}", i / 3) for i in range(10)], "timestamp long, obs_id string, v double")
    assert {r.truncated for r in L.earliest(rows, 4).collect()} == {True} and {r.truncated for r in L.earliest(rows, 11).collect()} == {False}
    assert sorted(r.obs_id for r in L.repeatable_sample(rows, "obs_id", 3).collect()) == sorted(r.obs_id for r in L.repeatable_sample(rows.repartition(3), "obs_id", 3).collect())
    assert L.preview(rows.orderBy("timestamp"), 2).collect()[1].v == "0.333"
    grid = L.grid_summary(spark.createDataFrame([(1.0, 2.0)], "latitude double, longitude double")).first()
    assert tuple(grid) == (1, 1.0, 1.0)


def test_exact_nearest_over_pole_and_seam(spark):
    points = {"seam": (0.2, 179.9), "pole": (89.9, 10.0), "far": (-60.0, 40.0), "on": (10.0, 10.0), "tie": (0.0, 0.0)}
    places = [(1, 0.2, -179.9), (2, 0.2, 178.0), (3, 89.8, -170.0), (4, 88.0, 10.0), (5, 10.0, 10.0), (6, 10.0, 10.1), (7, 0.0, 1.0), (8, 0.0, -1.0), (9, 12.0, 170.0)]
    km = lambda a, b: 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))
    asked = spark.createDataFrame([(n, *v) for n, v in points.items()] + [("null", None, 1.0)], "k string, latitude double, longitude double")
    held = spark.createDataFrame(places + [(10, None, None)], "p int, latitude double, longitude double")
    for k in (1, 3, 20):
        got = {(r.k, r.rank): r.place for r in P.exact_nearest_places(asked, held, "k", "p", k).collect()}
        want = {}
        for n, at in points.items():
            for i, p in enumerate(sorted(places, key=lambda p: (round(km(at, p[1:]), 9), p[0]))[:k]):
                want[n, i + 1] = p[0]
        assert got == want
    wrapped = {r.k: r.place for r in P.nearest_places(asked, held, "k", "p", wrap=True).collect()}
    assert wrapped["seam"] == 1 and {r.k: r.place for r in P.nearest_places(asked, held, "k", "p").collect()}["seam"] == 2
    cities = held.withColumn("population", F.col("p").cast("long") * 100)
    assert {r.k: r.city_population for r in P.attach_city_population(asked, cities, "k", wrap=True).collect()}["seam"] == 100
    assert {r.k: r.city_population for r in P.attach_city_population(asked, cities, "k").collect()}["seam"] is None


def test_calendar_spells_end_at_missing_days(spark):
    start = dt.datetime(2024, 1, 1, 6)
    warm = {20, 21, 22, 23, 24, 30, 31, 32, 34, 35}  # day 33 is missing
    rows = [("a", start + dt.timedelta(days=i, hours=h), 30.0 + i if i in warm else 20.0 - i * 0.001) for i in range(40) if i != 33 for h in (0, 6)]
    df = spark.createDataFrame(rows, "cell string, time timestamp, sst double")
    out = R.warm_spells(df, "sst", ["cell"], "time", 90, 0.9, 5, calendar=True).orderBy("day").collect()
    assert len(out) == 40
    assert [i for i, r in enumerate(out) if r.warm_spell] == [20, 21, 22, 23, 24]
    by_row = R.warm_spells(R.daily_means(df, ["sst"], ["cell"]), "sst", ["cell"], "day").filter("warm_spell").collect()
    assert {(r.day - start).days + 1 for r in by_row} == warm


def test_tracked_ports_keep_what_they_know(spark):
    cols = "port_id string, port_name string, country_code string, country_name string, latitude double, longitude double, marine_latitude double, marine_longitude double, elevation_m double, added_at long, last_polled_at long, backfilled_to long"
    old = spark.createDataFrame([("a", "Old", "fr", None, 1.0, 2.0, 1.5, 2.5, None, 10, 20, None), ("b", "Kept", "de", "Germany", 3.0, 4.0, None, None, 7.0, 11, None, None)], cols)
    new = spark.createDataFrame([("a", "New", "fr", "France", 9.0, 9.0, None, None, 3.0, 99, None, 5), ("c", "Added", "es", None, 5.0, 6.0, None, None, None, 12, None, None)], cols)
    got = {r.port_id: tuple(r)[1:] for r in O.upsert_tracked_ports(old, new).collect()}
    assert got == {"a": ("New", "fr", "France", 1.0, 2.0, 1.5, 2.5, 3.0, 10, 20, 5), "b": ("Kept", "de", "Germany", 3.0, 4.0, None, None, 7.0, 11, None, None), "c": ("Added", "es", None, 5.0, 6.0, None, None, None, 12, None, None)}
    assert O.upsert_tracked_ports(old.limit(0), new).count() == 2 and O.upsert_tracked_ports(old, new.limit(0)).count() == 2


def slow_lttb(rows, points):
    """(x, y) rows sorted by x -> the chosen ones, bucket by bucket."""
    n = len(rows)
    if n <= points:
        return rows
    size = (n - 2) / (points - 2)
    edges = [int(math.floor(size * i)) + 1 for i in range(points - 1)]
    kept = [rows[0]]
    for i in range(points - 2):
        here = rows[edges[i] : edges[i + 1]]
        ahead = rows[edges[i + 1] : edges[i + 2]] if i + 2 < len(edges) else [rows[-1]]
        mx, my = (sum(p[k] for p in ahead) / len(ahead) for k in (0, 1))
        ax, ay = kept[-1]
        kept.append(max(here, key=lambda p: abs((ax - mx) * (p[1] - ay) - (ax - p[0]) * (my - ay))))
    return [*kept, rows[-1]]


@pytest.mark.parametrize("points", [3, 10, 27])
def test_downsampling_equals_brute_force(spark, points):
    series = {k: [(float(i), math.sin(i * k) * 5 + (i * 7919 % 13)) for i in range(n)] for k, n in ((1, 100), (2, 57), (3, 8))}
    rows = [(k, i, x, y) for k, s in series.items() for i, (x, y) in enumerate(s)] + [(1, 500, 500.0, float("nan")), (1, 501, 501.0, None)]
    got = R.lttb(spark.createDataFrame(rows, "k int, id int, x double, y double").repartition(3), ["k"], "x", "y", points).collect()
    for k, s in series.items():
        assert sorted((r.x, r.y) for r in got if r.k == k) == slow_lttb(s, points)


def test_folding_of_scripts(spark):
    names = ["Ålesund", "Córdoba ", "Πάτρα", "Й йод", "ﬁn", "ＡＢＣ", None, "Straße"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", S.fold_exactly(F.col("n")).alias("f"), S.fold(F.col("n")).alias("q")).collect()
    assert [r.f for r in sorted(got)] == ["alesund", "cordoba", "πατρα", "и иод", "fin", "abc", None, "strasse"]
    assert sorted(got)[0].q == "alesund"


def test_detail_row_and_chart_rows(spark):
    full = spark.createDataFrame([(10.0, -20.0, 1.5, 8.0, 90.0, 12.345, 3.0, None, 15.0, 0.123, dt.datetime(2024, 1, 2, 3, 4), 90)], "latitude double, longitude double, wave_height_m double, wave_period_s double, wave_direction_deg double, wave_power_kw_m double, current_velocity_kmh double, current_direction_deg double, sst_celsius double, sea_level_anomaly_m double, time timestamp, age_s int")
    r = full.select(*S.detail_row()).first().asDict()
    assert r["position"] == "10.00°N 20.00°W" and r["sea_state"] == "Moderate" and r["wave_from"] == "E 90°" and r["current_toward"] == "–"
    assert r["sea_level"] == "12.3 cm" and r["wave_height"] == "1.50 m" and r["age"] == "1m ago" and r["observed"] == "2024-01-02 03:04 UTC"
    rows = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (float("nan"), 2.0), (2.0, None)], "a double, b double")
    assert [tuple(r) for r in R.chart_rows(rows, ["a", "b"]).collect()] == [(1.0, 1.0)]


def test_a_repeated_header_column_spoils_no_file(spark):
    lines = [("bad", "time,latitude,longitude,sst,sst"), ("bad", "2024-01-01T00:00:00Z,1.0,2.0,3.0,9.0"), ("good", "time,latitude,longitude,sst"), ("good", "2024-01-01T00:00:00Z,1.0,2.0,4.0")]
    got = readers.gridded_observations(spark.createDataFrame(lines, "file string, value string"), "sst").collect()
    assert sorted(r.sst_celsius for r in got) == [3.0, 4.0]
    count = readers.ocean_cell_count(readers.ocean_mask(spark.createDataFrame(lines, "file string, value string"))).first()
    assert (count.cells, count.is_empty) == (1, False)


def test_pools_lookups_and_ordered_places(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, port_id string, n int")
    more = spark.createDataFrame([("q", "b", 9), ("r", "b", 9)], "query string, port_id string, n int")
    assert sorted(map(tuple, Q.search_pool(hits, more, ["query", "port_id"]).collect())) == [("q", "a", 1), ("q", "b", 2), ("r", "b", 9)]
    assert [r.n for r in P.by_key(hits, "port_id", "b").collect()] == [2]
    places = spark.createDataFrame([("c1", "Z", "geonames", 9), ("p1", "B", "wpi", None), ("p2", "A", "wpi", 5)], "port_id string, port_name string, source string, population long")
    assert [r.port_id for r in L.gazetteer_order(places).collect()] == ["p2", "p1", "c1"]


def test_compacted_updates_read_the_same(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    for n, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("c", 3)])):
        spark.createDataFrame(rows, "k string, v int").write.parquet(f"{path}/batch_id={n}")
    read = lambda: sorted(tuple(r) for r in X.newest(spark, path, ["k"]).collect())
    before = read()
    X.compact(spark, path, ["k"], 1)
    assert read() == before == [("a", 2), ("b", 1), ("c", 3)]
    assert sorted(p.name for p in (tmp_path / "u").iterdir()) == ["batch_id=1", "batch_id=2"]


def test_dictionary_says_what_columns_are(spark):
    names = ["window_start", "observation_count", "wave_energy_kwh_m", "wave_height_m_max", "distance_km", "sst_celsius", "sst_celsius_z", "log1p_wave_energy_kwh_m", "other"]
    got = {r.column: r for r in exports.dictionary_for(spark.createDataFrame([(n,) for n in names], "column string")).collect()}
    assert got.keys() == set(names) and got["window_start"].nature == "metadata" and got["sst_celsius"].nature == "analysis" and got["distance_km"].unit == "km"
    assert got["sst_celsius_z"].nature == got["other"].nature == "derived" and "temperature" in got["sst_celsius_z"].description
    assert [n for n, r in got.items() if r.description == "derived column"] == ["other"]
    givers = {r.provider: r for r in exports.providers_for(spark.createDataFrame([("sst_celsius",)], "column string")).collect()}
    assert givers.keys() == {"Open-Meteo Marine", "NOAA OISST v2.1"} and givers["Open-Meteo Marine"].licence == "CC BY 4.0"


def test_a_key_with_very_many_versions(spark):
    """A third of all rows are versions of one reading; what is sent of them is a row a source and task."""
    n = F.col("id")
    rows = spark.range(0, 300_000, 1, 12).select(
        F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), n)).alias("obs_id"), n.alias("ingest_seq"), F.element_at(F.array(*map(F.lit, ("erddap_sst", "open_meteo", "erddap_sla"))), ((n / 3).cast("int") % 3 + 1)).alias("source"),
        F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(0).cast("long").alias("timestamp"), F.lit(None).cast("string").alias("port_id"), (n % 2 == 0).alias("is_forecast"), F.lit(False).alias("is_historical_cache"), *[F.when(n % 5 != 0, n.cast("double")).alias(m) for m in MEASURES],
    )
    merged = O.merge_observations(rows)
    assert merged.count() == 200_001
    hot = merged.filter("obs_id = 'hot'").first()
    assert hot.sources == ["erddap_sst", "open_meteo", "erddap_sla"] and (hot.created_seq, hot.updated_seq, hot.is_forecast) == (0, 299_997, False)
    # Waves are open_meteo's: its last version with a value.
    assert hot.wave_height_m == max(i for i in range(0, 300_000, 3) if i // 3 % 3 == 1 and i % 5)
    assert "Window" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_caveats_say_what_was_done():
    raw = exports.caveats({"mode": "raw"}, exports.RAW_COLUMNS)
    assert not any("Windows" in c or "_z" in c or "cap" in c for c in raw) and any("wave_height_m" in c and "model" in c for c in raw) and any("1981" in c for c in raw)
    made = exports.caveats({"interval": "6h", "fill": "ffill"}, ["window_start", "sst_celsius", "sst_celsius_z"], True)
    assert any("6h" in c and "last value before" in c for c in made) and any("_z" in c for c in made) and any("row cap" in c for c in made)
    assert any("are empty" in c for c in exports.caveats({}, ["window_start"])) and not any("altimetry" in c for c in made)


def test_readme_of_a_manifest(spark):
    rows = exports.raw_projection(spark.createDataFrame([Row(timestamp=0, latitude=1.0, longitude=2.0, wave_height_m=2.0)]))
    made = json.loads(exports.manifest(rows, {"mode": "raw"}, truncated=True, made_at="2024-05-06").first()[0])
    text = exports.readme_text(made)
    assert "1 rows" in text and "mode: raw" in text and "cut at the row cap" in text and "2024-05-06" in text
    assert all(c in text for c in exports.RAW_COLUMNS) and all(p in text for p in ("Open-Meteo Marine", "GeoNames")) and all(c in text for c in made["caveats"])


def test_file_names_of_columns_and_of_text(spark):
    now = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc)
    for prefix in ("Nord/See 2024", "a_b-c", "é x" * 30, ""):
        row = spark.createDataFrame([(prefix,)], "p string").select(exports.file_names(F.col("p"), "csv", F.timestamp_seconds(F.lit(int(now.timestamp())))))
        assert row.first()[0] == exports.file_name(prefix, "csv", now)


def test_cells_of_ten_days(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "k int, latitude double, longitude double")
    rows = spark.createDataFrame([(0.1, 0.0, 1.0, dt.date(2024, 1, 1)), (0.2, 0.0, 1.0, dt.date(2024, 1, 2)), (0.3, 0.0, 1.0, dt.date(2024, 1, 11)), (0.05, 0.0, 1.0, dt.date(2024, 1, 12)), (0.01, 0.0, None, dt.date(2024, 1, 5))], "latitude double, longitude double, v double, day date")
    cell = lambda *a: L.resolve_cells(points, rows, "k", "v", 0.75, *a).first().cell_latitude
    assert cell() == 0.05 and cell("day", "2024-01-11") == 0.2 and cell("day", "2024-01-10") == 0.1 and cell("day", "2024-01-30") is None
