"""Column expressions: normalising, physics, labels, text."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Density of sea water, gravity, mean Earth radius.
RHO, G, EARTH_KM = 1025.0, 9.81, 6371.0088
WAVE_FLUX = RHO * G**2 / (64 * math.pi)


def clean(value: Column) -> Column:
    """Unparseable, NaN and infinite values become null."""
    v = value.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def encode_longitude(lon: Column, convention: str = "pm180") -> Column:
    return F.pmod(lon, F.lit(360.0)) if convention == "0360" else wrap_longitude(lon)


def bearing(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def observation_id(lat: Column, lon: Column, timestamp: Column) -> Column:
    """Digest of the rounded place and the time; the source is no part of identity."""
    place = lambda v: F.format_string("%.4f", F.round(v, 4) + 0.0)
    return F.sha1(F.concat_ws("|", place(lat), place(lon), timestamp.cast("string")).cast("binary"))


def marine_coordinate(marine: Column, harbour: Column) -> Column:
    return F.coalesce(marine, harbour)


def forecast_flag(timestamp: Column, as_of_ms: int) -> Column:
    return timestamp > F.lit(as_of_ms)


def cell_key(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", F.round(lat, 3).cast("string"), F.round(lon, 3).cast("string"))


def mask_cell(lat: Column, lon: Column) -> Column:
    """1-degree cell number, 0 to 64799, row by row from the south pole."""
    row = F.least(F.greatest(F.floor(lat + 90.0), F.lit(0)), F.lit(179))
    col = F.least(F.greatest(F.floor(F.pmod(lon + 180.0, F.lit(360.0))), F.lit(0)), F.lit(359))
    return (row * 360 + col).cast("int")


def wave_power(height: Column, period: Column, ratio: float = 1.0) -> Column:
    """kW per metre of crest; null for missing or impossible input."""
    return F.when((height >= 0) & (period > 0), F.lit(WAVE_FLUX * ratio) * height * height * period / 1000.0)


def still_water_level(anomaly: Column, height: Column, surge: float = 0.0, setup: float = 0.2) -> Column:
    return anomaly + F.lit(setup) * F.coalesce(height, F.lit(0.0)) + F.lit(surge)


def log_energy(energy: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(energy, F.lit(0.0)), F.lit(0.0)))


def window_energy(mean_power: Column, hours: float) -> Column:
    return mean_power * F.lit(float(hours))


def iso_time(value: Column) -> Column:
    """Naive ISO text is UTC, a trailing Z is allowed, junk is null."""
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", ""))


def day_bounds_ms(day: Column) -> tuple[Column, Column]:
    """First and last millisecond-second of a UTC day (23:59:59)."""
    start = F.unix_millis(day.cast("timestamp"))
    return start, start + 86_399_000


DEGREES = r"^([0-9]+(?:\.[0-9]+)?)\s*[°D ]?\s*(?:([0-9]+(?:\.[0-9]+)?)\s*['′M ]?\s*)?(?:([0-9]+(?:\.[0-9]+)?)\s*[\"″S]?\s*)?([NSEW])$"
#: Parts degrees, minutes, seconds and hemisphere; no text that matches has it.
MARK = "\u0001"


def dms(text: Column) -> Column:
    """Degrees, minutes and seconds with a hemisphere, or signed decimals; junk is null."""
    # Functions of one value, so that the text is matched once, not once for every use of a part.
    cut = F.transform(F.array(F.upper(F.trim(text))), lambda t: F.struct(t.alias("t"), F.when(~F.contains(t, F.lit(MARK)), F.split(F.regexp_replace(t, DEGREES, f"{MARK}$1{MARK}$2{MARK}$3{MARK}$4"), MARK)).alias("p")))

    def number(r: Column) -> Column:
        num = lambda i: F.coalesce(F.get(r["p"], F.lit(i)).try_cast("double"), F.lit(0.0))
        size = num(1) + num(2) / 60.0 + num(3) / 3600.0
        signed = F.when(F.substring(F.get(r["p"], F.lit(4)), 1, 1).isin("S", "W"), -size).otherwise(size)
        return F.when(F.size(r["p"]) == 5, signed).otherwise(clean(r["t"]))

    return F.get(F.transform(cut, number), F.lit(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlon, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    y, x = F.sin(dlon) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


#: The 16 compass points, the Douglas sea states and the current bands.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
SEA_STATES = ((0.1, "Calm"), (0.5, "Smooth"), (1.25, "Slight"), (2.5, "Moderate"), (4.0, "Rough"), (6.0, "Very rough"), (9.0, "High"), (14.0, "Very high"), (999.0, "Phenomenal"))
CURRENT_BANDS = ((2.0, "0–2 km/h"), (5.0, "2–5 km/h"), (10.0, "5–10 km/h"), (1e9, "over 10 km/h"))


def compass(deg: Column) -> Column:
    at = F.pmod(F.floor(F.pmod(deg, F.lit(360.0)) / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS)), at + 1)


def bearing_text(deg: Column) -> Column:
    return F.concat(compass(deg), F.lit(" "), F.pmod(F.round(deg), F.lit(360.0)).cast("int").cast("string"), F.lit("°"))


def sea_state(height: Column) -> Column:
    """Null and NaN are Unknown; ceilings are exclusive."""
    out = F.lit(SEA_STATES[-1][1])
    for ceiling, name in reversed(SEA_STATES):
        out = F.when(height < ceiling, F.lit(name)).otherwise(out)
    return F.when(height.isNull() | F.isnan(height), F.lit("Unknown")).otherwise(out)


def current_band(speed: Column) -> Column:
    out = F.lit(None).cast("string")
    for ceiling, name in reversed(CURRENT_BANDS):
        out = F.when((speed >= 0) & (speed < ceiling), F.lit(name)).otherwise(out)
    return out


def flow_arrow(lat: Column, lon: Column, deg: Column, speed: Column, peak: Column) -> tuple[Column, Column]:
    """The end of an arrow from a cell, longer for faster currents."""
    length = 1.6 + 6.0 * F.try_divide(speed, peak)
    return lat + length * F.cos(F.radians(deg)), lon + length * F.sin(F.radians(deg)) / F.greatest(F.lit(0.25), F.cos(F.radians(lat)))


def joint_anomaly(a: Column, b: Column, threshold: float = 2.0) -> Column:
    return F.coalesce((a > threshold) & (b > threshold), F.lit(False))


def circular_mean(deg: Column) -> Column:
    """Aggregate: the mean bearing in [0, 360)."""
    mean = F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(deg))), F.avg(F.cos(F.radians(deg))))) + 360.0, F.lit(360.0))
    return F.when(mean >= 360.0 - 1e-9, 0.0).otherwise(mean)


def moved_cell(lat: Column, lon: Column, marine_lat: Column, marine_lon: Column, limit: float = 0.01) -> Column:
    return F.coalesce((F.abs(marine_lat - lat) > limit) | (F.abs(marine_lon - lon) > limit), F.lit(False))


def mask_date(as_of: Column, lag_days: int = 45) -> Column:
    return F.date_sub(as_of, lag_days)


def fold(text: Column) -> Column:
    """Accents off, lower case, trimmed, by built-in functions: accented Latin letters by table, marks of
    other scripts removed. fold_exactly also takes composed letters of other scripts apart."""
    plain = F.translate(F.lower(text), ACCENTED, BASE)
    return F.trim(F.regexp_replace(plain, r"\p{M}", ""))


def fold_exactly(text: Column) -> Column:
    """Compatibility decomposition of all scripts, marks off, case folded, trimmed; for building an index,
    once: it runs in Python, in Arrow batches."""
    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        import unicodedata

        strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold().strip()
        return values.map(strip, na_action="ignore")

    return folded(text)


def _latin_letters() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode tables."""
    import unicodedata

    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(code).lower()
        base = unicodedata.normalize("NFKD", low)[0]
        if len(low) == 1 and low != base:
            pairs.append((low, base.casefold()[0]))
    unique = dict(pairs)
    return "".join(unique), "".join(unique.values())


ACCENTED, BASE = _latin_letters()


def latlon_text(lat: Column, lon: Column) -> Column:
    half = lambda v, pos, neg: F.concat(F.format_string("%.2f°", F.abs(v)), F.when(v >= 0, F.lit(pos)).otherwise(F.lit(neg)))
    return F.concat(half(lat, "N", "S"), F.lit(" "), half(lon, "E", "W"))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")


def age_text(age_s: Column) -> Column:
    """s, m, h or d ago; in N minutes for times ahead; never for null."""
    count = lambda v, unit: F.concat(F.floor(v).cast("string"), F.lit(unit))
    return (
        F.when(age_s.isNull(), F.lit("never"))
        .when(age_s < 0, F.concat(F.lit("in "), count(-age_s / 60, "m")))
        .when(age_s < 60, count(age_s, "s ago"))
        .when(age_s < 3600, count(age_s / 60, "m ago"))
        .when(age_s < 86400, count(age_s / 3600, "h ago"))
        .otherwise(count(age_s / 86400, "d ago"))
    )


def number_text(value: Column, places: int = 2, unit: str = "", missing: str = "–") -> Column:
    return F.coalesce(F.concat(F.format_number(value, places), F.lit(f" {unit}" if unit else "")), F.lit(missing))


def bytes_text(size: Column) -> Column:
    out = F.format_string("%.1f GB", size / 1e9)
    for limit, text in ((1e9, F.format_string("%.1f MB", size / 1e6)), (1e6, F.format_string("%.1f kB", size / 1e3)), (1e3, F.concat(size.cast("long").cast("string"), F.lit(" B")))):
        out = F.when(size < limit, text).otherwise(out)
    return out


def place_label(name: Column, country: Column, code: Column, water: Column, source: Column) -> Column:
    """Name, country (else its code), and the water body of ports."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(", ", some(name), F.coalesce(some(country), some(code)), F.when(source == "wpi", some(water)))


def detail_row() -> list[Column]:
    """What is told of one cell: columns of texts from latitude, longitude, the measurements and `time`,
    `age_s`; missing values are dashes."""
    level = F.col("sea_level_anomaly_m") * 100
    return [
        latlon_text(F.col("latitude"), F.col("longitude")).alias("position"), sea_state(F.col("wave_height_m")).alias("sea_state"),
        number_text(F.col("wave_height_m"), 2, "m").alias("wave_height"), number_text(F.col("wave_period_s"), 1, "s").alias("wave_period"),
        F.coalesce(bearing_text(F.col("wave_direction_deg")), F.lit("–")).alias("wave_from"), number_text(F.col("wave_power_kw_m"), 1, "kW/m").alias("wave_power"),
        number_text(F.col("current_velocity_kmh"), 2, "km/h").alias("current_speed"), F.coalesce(bearing_text(F.col("current_direction_deg")), F.lit("–")).alias("current_toward"),
        number_text(F.col("sst_celsius"), 2, "°C").alias("sea_temperature"), number_text(level, 1, "cm").alias("sea_level"),
        utc_text(F.col("time")).alias("observed"), age_text(F.col("age_s")).alias("age"),
    ]
