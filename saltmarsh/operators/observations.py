"""Validation, filters, and the source-aware merge of observations."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.schema import BEARINGS, FILL_ONLY, MEASURES, OWNED

LAST_MS = 4_102_444_800_000


def check_observations(raw: DataFrame) -> DataFrame:
    """raw rows normalised, + reject_reason (null for good ones); missing columns are added as null."""
    for c in ("latitude", "longitude", *MEASURES):
        raw = raw.withColumn(c, S.clean(F.col(c)) if c in raw.columns else F.lit(None).cast("double"))
    for c in BEARINGS:
        raw = raw.withColumn(c, S.bearing(F.col(c)))
    rows = raw.withColumn("longitude", S.wrap_longitude(F.col("longitude"))).withColumn("timestamp", F.col("timestamp").try_cast("long"))
    reason = (
        F.when(F.col("latitude").isNull() | (F.abs("latitude") > 90), "latitude")
        .when(F.col("longitude").isNull(), "longitude")
        .when(F.col("timestamp").isNull() | ~F.col("timestamp").between(0, LAST_MS), "timestamp")
        .when(F.coalesce(*MEASURES).isNull(), "no measurement")
    )
    return rows.withColumn("reject_reason", reason)


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows with obs_id, quarantined rows with reject_reason)."""
    rows = check_observations(raw)
    good = rows.filter("reject_reason is null").drop("reject_reason")
    return good.withColumn("obs_id", S.observation_id(F.col("latitude"), F.col("longitude"), F.col("timestamp"))), rows.filter("reject_reason is not null")


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float, wrap: bool = False) -> Column:
    """Inclusive. Edges are put in order, or with wrap a box from west to east over the antimeridian."""
    south, north = min(south, north), max(south, north)
    if wrap and west > east:
        return lat.between(south, north) & ((lon >= west) | (lon <= east))
    return lat.between(south, north) & lon.between(min(west, east), max(west, east))


def radius_box(centre: tuple[float, float], radius_km: float) -> tuple[float, float, list[tuple[float, float]]]:
    """South, north and the spans from west to east (none: all around) that hold everything in the radius."""
    clat, clon = centre
    dlat = radius_km / 111.32
    cos = math.cos(math.radians(min(89.999, abs(clat) + dlat)))
    dlon = dlat / max(cos, 1e-6)
    spans = []
    if dlon < 180 and abs(clat) + dlat < 90:
        west, east = ((v + 180) % 360 - 180 for v in (clon - dlon, clon + dlon))
        spans = [(west, east)] if west <= east else [(west, math.inf), (-math.inf, east)]
    return max(-90.0, clat - dlat), min(90.0, clat + dlat), spans


def in_radius(lat: Column, lon: Column, centre: tuple[float, float], radius_km: float) -> Column:
    """A box of literals, which reaches the Parquet statistics, and the exact distance."""
    south, north, spans = radius_box(centre, radius_km)
    box = lat.between(south, north)
    if spans:
        sides = [reduce(lambda a, b: a & b, [c for c, there in ((lon >= w, w > -math.inf), (lon <= e, e < math.inf)) if there]) for w, e in spans]
        box &= reduce(lambda a, b: a | b, sides)
    return box & (S.haversine_km(lat, lon, F.lit(centre[0]), F.lit(centre[1])) <= radius_km)


@dataclass
class ObservationFilter:
    """All fields that are set are ANDed; forecasts are left out unless asked for."""

    start_ms: int | None = None
    end_ms: int | None = None
    port_id: str | None = None
    bbox: tuple[float, float, float, float] | None = None  # south, north, west, east
    centre: tuple[float, float] | None = None
    radius_km: float | None = None
    include_forecast: bool = False
    require_columns: tuple[str, ...] = ()
    order: str | None = None
    limit: int | None = None
    wrap: bool = False

    def condition(self, columns: list[str]) -> Column:
        lat, lon, ts = F.col("latitude"), F.col("longitude"), F.col("timestamp")
        parts = [F.lit(True)]
        if self.start_ms is not None:
            parts.append(ts >= self.start_ms)
        if self.end_ms is not None:
            parts.append(ts <= self.end_ms)
        if self.port_id is not None:
            parts.append(F.col("port_id") == self.port_id)
        if not self.include_forecast:
            parts.append(~F.col("is_forecast"))
        if self.bbox:
            parts.append(in_box(lat, lon, *self.bbox, wrap=self.wrap))
        if self.centre and self.radius_km:
            parts.append(in_radius(lat, lon, self.centre, self.radius_km))
        parts += [F.col(c).isNotNull() for c in self.require_columns if c in columns]
        return reduce(lambda a, b: a & b, parts)

    def boxes(self) -> list[tuple[float, float, list[tuple[float, float]]]]:
        """South, north and spans from west to east (none: all around) of which rows must be in all."""
        out = []
        if self.bbox:
            south, north, west, east = self.bbox
            seam = self.wrap and west > east
            out.append((min(south, north), max(south, north), [(west, math.inf), (-math.inf, east)] if seam else [(min(west, east), max(west, east))]))
        if self.centre and self.radius_km:
            out.append(radius_box(self.centre, self.radius_km))
        return out

    def apply(self, obs: DataFrame) -> DataFrame:
        out = obs.filter(self.condition(obs.columns))
        if self.centre and self.radius_km:
            out = out.withColumn("distance_km", S.haversine_km(F.col("latitude"), F.col("longitude"), *map(F.lit, self.centre)))
        if self.order:
            out = out.orderBy(*[F.col(c).desc() if self.order == "desc" else F.col(c) for c in ("timestamp", *["obs_id"] * ("obs_id" in obs.columns))])
        return out if self.limit is None else out.limit(self.limit)


def look_back(obs: DataFrame, now_ms: int, days: int = 0, port_id: str | None = None, cap: int | None = None) -> DataFrame:
    """Analyses up to now of the last `days` days (0: all there are) at a port or everywhere; cap: the
    earliest so many rows of them, if it is set."""
    start = now_ms - days * 86_400_000 if days else None
    return ObservationFilter(start_ms=start, end_ms=now_ms, port_id=port_id, order="asc" if cap else None, limit=cap).apply(obs)


def _owns(column: str) -> Column:
    """Whether the row's source may overwrite the column."""
    limited = [s for s in OWNED if column not in OWNED[s] or column in FILL_ONLY.get(s, [])]
    return ~F.coalesce(F.col("source").isin(limited), F.lit(False)) if limited else F.lit(True)


def merge_observations(batches: DataFrame, key: str = "obs_id", order: str = "ingest_seq") -> DataFrame:
    """All versions of each reading -> one row per key, as if they had been upserted in order.

    batches: observation columns, key, order (unique within a key) and source. The first row of a
    key sets every column. After it the last value of an owner stands; a column that a source may
    only fill takes its first value if no other is there. A forecast becomes an analysis for good,
    history is remembered, sources are listed as they came. Rows merged before may take part as the
    first of their key: their array `sources` stands for `source`, and created_at and updated_at, if
    present, become the earliest and the latest. Versions are aggregated before they are sent: by key and
    source, then by key.
    """
    seq = F.col(order)
    tags = F.coalesce("sources", F.array("source")) if "sources" in batches.columns else F.array("source")
    # Versions are reduced by key and source where they lie, so that a key with any number of them sends a
    # row a source and task; what is kept of a column is a value and the version that it is from.
    made, done = [], []

    def kept(c: str, when: Column, last: bool) -> Column:
        """The value of the last (or first) version for which `when` holds."""
        name, by = f"_{len(made)}", F.when(when, seq)
        made.extend([(F.max_by if last else F.min_by)(c, by).alias(name), (F.max if last else F.min)(by).alias(f"{name}q")])
        return (F.max_by if last else F.min_by)(name, f"{name}q")

    every = F.lit(True)
    for c in MEASURES:
        has = F.col(c).isNotNull()
        # The owner's last value; else the first version's, whoever it is from; else what may fill.
        values = [kept(c, has & _owns(c), True), kept(c, every, False)]
        fills = [s for s in FILL_ONLY if c in FILL_ONLY[s]]
        if fills:
            values.append(kept(c, has & F.col("source").isin(fills), False))
        done.append(F.coalesce(*values).alias(c))
    fixed = [kept(c, every, False).alias(c) for c in ("latitude", "longitude", "timestamp")]
    port = kept("port_id", F.col("port_id").isNotNull(), True).alias("port_id")
    ages = [(c, f) for f, c in ((F.min, "created_at"), (F.max, "updated_at")) if c in batches.columns]
    flags = [("is_forecast", F.bool_and), ("is_historical_cache", F.bool_or), *ages]
    by_source = batches.withColumn("_tags", tags).groupBy(key, "_tags").agg(*made, *[f(c).alias(c) for c, f in flags], F.min(order).alias("_low"), F.max(order).alias("_high"))
    listed = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("_low").alias("q"), F.col("_tags").alias("s")))), lambda x: x["s"]))).alias("sources")
    return by_source.groupBy(key).agg(*fixed, port, *done, *[f(c).alias(c) for c, f in flags[:2]], listed, *[f(c).alias(c) for c, f in ages], F.min("_low").alias("created_seq"), F.max("_high").alias("updated_seq"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], overwrite: list[str], keep_if_null: list[str], keep: list[str]) -> DataFrame:
    """New rows over old ones: `overwrite` takes the new value, `keep_if_null` coalesce(new, old),
    `keep` the old one where the key was known."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    known = o.join(n, on, "full")
    there, fresh = reduce(lambda a, b: a | b, [F.col(f"o.{k}").isNotNull() for k in key]), reduce(lambda a, b: a | b, [F.col(f"n.{k}").isNotNull() for k in key])
    pick = {k: F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")) for k in [*key, *keep_if_null]}
    pick |= {c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in overwrite}
    pick |= {c: F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in keep}
    return known.select(*[pick[c].alias(c) for c in old.columns if c in pick])


def upsert_tracked_ports(old: DataFrame, new: DataFrame) -> DataFrame:
    """The name is overwritten, a marine cell or elevation once found is kept unless found anew."""
    return upsert(old, new, ["port_id"], ["port_name"], ["country_code", "country_name", "marine_latitude", "marine_longitude", "elevation_m", "last_polled_at", "backfilled_to"], ["latitude", "longitude", "added_at"])


def mark_probes(grid: DataFrame, probes: DataFrame, now_ms: int) -> DataFrame:
    """probes: grid_id, had_data. A hit clears the failures, a miss adds one; others stay."""
    g = grid.join(probes.select("grid_id", "had_data"), "grid_id", "left")
    hit, seen = F.col("had_data"), F.col("had_data").isNotNull()
    return g.select(
        *[c for c in grid.columns if c not in ("is_valid", "fail_count", "last_checked", "last_success")],
        F.when(seen, hit).otherwise(F.col("is_valid")).alias("is_valid"),
        F.when(hit, 0).when(seen, F.coalesce("fail_count", F.lit(0)) + 1).otherwise(F.col("fail_count")).alias("fail_count"),
        F.when(seen, F.lit(now_ms)).otherwise(F.col("last_checked")).alias("last_checked"),
        F.when(hit, F.lit(now_ms)).otherwise(F.col("last_success")).alias("last_success"),
    )


def usable_cells(grid: DataFrame) -> DataFrame:
    return grid.filter("is_ocean and (is_valid is null or is_valid)")
