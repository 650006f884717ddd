"""Readers: marine JSON payloads, gridded CSV, port index, cities, countries, dataset coverage.

Each takes a DataFrame of text lines or documents (`spark.read.text`), so that files, streams and
tables are read alike; `*_files` are the same from a path. Rows that can't be read are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.operators import observations as O
from saltmarsh.operators import places as P
from saltmarsh.schema import MEASURES

#: Names in the payload and in the gridded files, and ours.
MARINE_FIELDS = {"wave_height": "wave_height_m", "wave_period": "wave_period_s", "wave_direction": "wave_direction_deg", "ocean_current_velocity": "current_velocity_kmh", "ocean_current_direction": "current_direction_deg", "sea_surface_temperature": "sst_celsius"}
GRIDDED_FIELDS = {"sst": "sst_celsius", "sla": "sea_level_anomaly_m", "ugos": "geostrophic_u_ms", "vgos": "geostrophic_v_ms"}
GRIDDED_SOURCE = {"sst": "erddap_sst", "sla": "erddap_sla"}

_HOURLY = "struct<" + ", ".join(f"{c}: array<string>" for c in ["time", *MARINE_FIELDS]) + ">"
PAYLOAD = f"array<struct<latitude: double, longitude: double, hourly: {_HOURLY}>>"


def marine_hours(payloads: DataFrame, as_of_ms: int, historical: bool = False) -> DataFrame:
    """payloads: payload_id, value (a JSON object or an array of them), and if wanted `requested`,
    an array<struct<latitude, longitude, port_id>> in the order of the locations.

    One row per location and hour, and one of nulls for a location without hours: payload_id,
    location, the observation's columns, usable (parsed, with a value, and valid). Arrays shorter
    than the times give nulls; the cell centre that came back counts, not the one asked for.
    """
    if "requested" not in payloads.columns:
        payloads = payloads.withColumn("requested", F.lit(None).cast("array<struct<latitude: double, longitude: double, port_id: string>>"))
    each = payloads.select("payload_id", "requested", F.posexplode(F.from_json("value", PAYLOAD)).alias("location", "l")).filter("l is not null")
    asked = F.get("requested", F.col("location"))
    names = ["time", *MARINE_FIELDS]
    hours = each.select(
        "payload_id", "location", F.coalesce("l.latitude", asked["latitude"]).alias("latitude"), F.coalesce("l.longitude", asked["longitude"]).alias("longitude"), asked["port_id"].alias("port_id"),
        F.explode_outer(F.arrays_zip(*[F.coalesce(F.col(f"l.hourly.{n}"), F.array().cast("array<string>")).alias(n) for n in names])).alias("h"),
    )
    rows = hours.select(
        "payload_id", "location", "latitude", "longitude", F.unix_millis(S.iso_time(F.col("h")[names[0]])).alias("timestamp"), "port_id", F.lit("open_meteo").alias("source"),
        *[S.clean(F.col("h")[n]).alias(MARINE_FIELDS[n]) for n in names[1:]],
    ).withColumn("is_forecast", S.forecast_flag(F.col("timestamp"), as_of_ms)).withColumn("is_historical_cache", F.lit(historical))
    checked = O.check_observations(rows)
    return checked.withColumn("usable", F.col("reject_reason").isNull()).drop("reject_reason")


def marine_observations(hours: DataFrame) -> DataFrame:
    return hours.filter("usable").drop("usable", "payload_id", "location")


def had_data(hours: DataFrame) -> DataFrame:
    """payload_id, location, had_data: whether a location gave any observation (land gives none)."""
    return hours.groupBy("payload_id", "location").agg(F.bool_or("usable").alias("had_data"))


#: Headers, a row a file, that are sent to all tasks at most.
HEADERS = 10_000


def gridded_rows(lines: DataFrame) -> DataFrame:
    """lines: file, value -> file, cells (map of column name to text), one row per data line.

    Every file has its own header; the units line and lines of another length go, and a file
    without a header (an error document) gives nothing. Of columns of one name the first counts.
    """
    parts = lines.select("file", F.split(F.trim("value"), ",").alias("_v"))
    is_header = F.array_contains("_v", "time") & F.array_contains("_v", "latitude") & F.array_contains("_v", "longitude")
    headers = parts.filter(is_header).groupBy("file").agg(F.first("_v").alias("_h"))
    # A file's lines stay where they are read, however many a file has, unless there are very many files.
    few = headers.select("file").limit(HEADERS + 1).count() <= HEADERS
    rows = parts.filter(~is_header).join(F.broadcast(headers) if few else headers, "file").filter("size(_v) = size(_h)")
    rows = rows.select("file", F.map_from_entries(F.filter(F.arrays_zip(F.col("_h").alias("k"), F.col("_v").alias("v")), lambda p, i: F.array_position("_h", p["k"]) == i + 1)).alias("cells"))
    return rows.filter(S.iso_time(F.col("cells")["time"]).isNotNull())


def error_documents(lines: DataFrame) -> DataFrame:
    """Files that hold an error message in place of data."""
    return lines.filter(F.ltrim("value").startswith("Error {")).select("file").distinct()


def gridded_observations(lines: DataFrame, kind: str, port_id: str | None = None) -> DataFrame:
    """kind: sst or sla. Rows without a value go; longitudes of either convention are wrapped."""
    cell = lambda n: S.clean(F.get(F.array(F.col("cells")[n]), F.lit(0)))
    found = {ours: cell(theirs) for theirs, ours in GRIDDED_FIELDS.items()}
    rows = gridded_rows(lines).select(
        cell("latitude").alias("latitude"), cell("longitude").alias("longitude"), F.unix_millis(S.iso_time(F.col("cells")["time"])).alias("timestamp"), F.lit(port_id).cast("string").alias("port_id"), F.lit(GRIDDED_SOURCE.get(kind, "erddap_sst")).alias("source"),
        F.lit(False).alias("is_forecast"), F.lit(True).alias("is_historical_cache"), *[found.get(m, F.lit(None).cast("double")).alias(m) for m in MEASURES],
    )
    return O.check_observations(rows).filter("reject_reason is null").drop("reject_reason")


def gridded_files(spark: SparkSession, path: str, kind: str, port_id: str | None = None) -> DataFrame:
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    return gridded_observations(lines, kind, port_id)


def ocean_mask(lines: DataFrame, variable: str = "sst") -> DataFrame:
    """cell_id of every 1-degree cell with a value: at most 64,800 rows, small enough to broadcast."""
    cells = gridded_rows(lines).select(*[S.clean(F.col("cells")[n]).alias(n) for n in ("latitude", "longitude", variable)])
    return cells.dropna().select(S.mask_cell(F.col("latitude"), F.col("longitude")).alias("cell_id")).distinct()


def dataset_coverage(lines: DataFrame) -> DataFrame:
    """lines: file, value of dataset info CSV -> file, low, high: the bounds of the time axis."""
    row = F.from_csv("value", "row_type string, variable string, attribute string, kind string, value string")
    rows = lines.select("file", row.alias("r")).filter("r.row_type = 'attribute' and r.variable = 'time' and r.attribute = 'actual_range'")
    ends = F.split("r.value", ",")
    second = lambda i: F.timestamp_seconds(F.trim(F.get(ends, F.lit(i))).try_cast("double"))
    return rows.select("file", second(0).alias("low"), second(1).alias("high")).dropna()


def title(text: Column) -> Column:
    """Every run of letters capitalised, also after hyphens and apostrophes."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), F.initcap), "")


def port_index(rows: DataFrame) -> DataFrame:
    """rows: the port index CSV with its header, all strings -> places; those without a name or
    readable coordinates go. A port without a number is known by its name."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    out = rows.select(
        F.concat(F.lit("wpi:"), F.coalesce(F.nullif(t("portNumber"), F.lit("")), t("portName"))).alias("port_id"), t("portName").alias("port_name"), F.upper(t("countryCode")).alias("country_code"), t("countryName").alias("country_name"),
        S.dms(F.col("latitude")).alias("latitude"), S.wrap_longitude(S.dms(F.col("longitude"))).alias("longitude"), title(t("regionName")).alias("water_body"), t("harborSize").alias("harbor_size"), t("harborType").alias("harbor_type"), F.lit("wpi").alias("source"), F.lit(0).cast("long").alias("population"),
    )
    return out.filter("port_name <> '' and abs(latitude) <= 90 and longitude is not null")


def port_index_files(spark: SparkSession, path: str) -> DataFrame:
    return port_index(spark.read.csv(path, header=True, multiLine=False))


def city_rows(lines: DataFrame, ocean: DataFrame | None = None, coastal_km: float = 60.0, alt_names: int = 600) -> DataFrame:
    """lines: value with 15 or more fields between tabs -> places. With a mask that isn't empty
    only those near the sea; an empty mask keeps all."""
    # As an element of an array, so that the line is split once and not again for every filter below.
    rows = lines.select(F.explode(F.array(F.split("value", "\t"))).alias("_f")).filter("size(_f) >= 15")
    at = lambda i: F.trim(F.get("_f", F.lit(i)))
    people = F.coalesce(F.nullif(at(14), F.lit("")), F.lit("0")).try_cast("long")
    out = rows.select(
        F.concat(F.lit("geonames:"), F.get("_f", F.lit(0))).alias("port_id"), at(1).alias("port_name"), F.substring(F.get("_f", F.lit(3)), 1, alt_names).alias("alt_names"), F.upper(at(8)).alias("country_code"), F.lit("").alias("country_name"),
        S.clean(at(4)).alias("latitude"), S.wrap_longitude(S.clean(at(5))).alias("longitude"), F.lit("geonames").alias("source"), people.alias("population"),
    ).filter("port_name <> '' and abs(latitude) <= 90 and longitude is not null and population is not null")
    if ocean is None or ocean.isEmpty():
        return out
    return P.coastal(out, ocean, "port_id", coastal_km)


def country_names(lines: DataFrame) -> DataFrame:
    """country_code, country_name from tab-separated lines; # starts a comment; the last one stands."""
    rows = lines.withColumn("_n", F.monotonically_increasing_id()).filter(~F.col("value").startswith("#")).select("_n", F.split("value", "\t").alias("_f")).filter("size(_f) > 4")
    code = F.upper(F.trim(F.get("_f", F.lit(0))))
    rows = rows.select("_n", code.alias("country_code"), F.trim(F.get("_f", F.lit(4))).alias("country_name")).filter("country_code <> ''")
    return rows.groupBy("country_code").agg(F.max_by("country_name", "_n").alias("country_name"))


def ocean_cell_count(mask: DataFrame) -> DataFrame:
    """One row: how many cells the mask has, and whether it has none."""
    return mask.agg(F.count("*").alias("cells"), (F.count("*") == 0).alias("is_empty"))
