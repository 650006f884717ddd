"""Cells near points, sample grids, ledger upkeep, reports, and ordered or cut listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions import scalar as S
from saltmarsh.operators import places as P
from saltmarsh.operators.ordered import in_order, positions

#: The first day with data of each marine variable, and the day for unknown ones.
ARCHIVE_FLOORS = {"wave_height": "2021-12-01", "wave_period": "2021-12-01", "wave_direction": "2021-12-01", "ocean_current_velocity": "2022-01-01", "ocean_current_direction": "2022-01-01", "sea_surface_temperature": "2022-12-01"}
NO_FLOOR = "2022-01-01"
#: Steps in degrees, and directions (north, east) in the order in which cells are tried.
CELL_STEPS = (0.25, 0.5, 1.0)
DIRECTIONS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))


def archive_floor(variables: list[str] | None = None) -> str:
    known = [ARCHIVE_FLOORS[v] for v in (ARCHIVE_FLOORS if variables is None else variables) if v in ARCHIVE_FLOORS]
    return min(known, default=NO_FLOOR)


def clamp_start(start: Column, variables: list[str] | None = None) -> Column:
    return F.greatest(start, F.lit(archive_floor(variables)).cast("date"))


def available_from(start: Column) -> Column:
    """Map of variable -> whether it has data from that day on."""
    return F.create_map(*[x for v, day in ARCHIVE_FLOORS.items() for x in (F.lit(v), start >= F.lit(day).cast("date"))])


def point_box(lat: Column, lon: Column, pad: float = 0.25) -> dict[str, Column]:
    return {"min_lat": F.greatest(F.lit(-90.0), lat - pad), "max_lat": F.least(F.lit(90.0), lat + pad), "min_lon": lon - pad, "max_lon": lon + pad}


#: Cells of the mask, of which a word of it tells CELLS_A_WORD.
MASK_CELLS, CELLS_A_WORD = 64_800, 64


def mask_words(ocean: DataFrame) -> DataFrame:
    """One row, `_mask`: a bit for every cell of the mask, in 1,013 numbers. ocean: cell_id."""
    word = lambda c: F.floor(c / CELLS_A_WORD)
    held = ocean.select("cell_id").distinct().groupBy(word(F.col("cell_id")).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("cell_id", F.lit(CELLS_A_WORD)).cast("int"))).alias("_bits"))
    words = ocean.sparkSession.range(-(-MASK_CELLS // CELLS_A_WORD)).withColumnRenamed("id", "_word").join(held, "_word", "left")
    listed = F.array_sort(F.collect_list(F.struct("_word", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits"))))
    return words.agg(listed.alias("_l")).select(F.col("_l._bits").alias("_mask"))


def nearest_ocean(points: DataFrame, ocean: DataFrame, key: str, rings: int = 4) -> DataFrame:
    """key, ocean_latitude, ocean_longitude, ring: the point itself if it lies in the ocean, else the
    nearest offset of whole degrees in the first ring with any; null if no ring has one.

    Every point is looked at by itself, ring by ring, in the bits of the mask (8 KB, sent to all tasks):
    points are only dealt to the tasks, and no task holds what it tries. Rows are points, each its own; one
    without a key has no cell.
    """
    lat, lon, mask = F.col("latitude"), F.col("longitude"), F.col("_mask")

    def first(ring: int) -> Column:
        around = [(dy, dx) for dy in range(-ring, ring + 1) for dx in range(-ring, ring + 1) if max(abs(dy), abs(dx)) == ring]
        moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in around])

        def place(m: Column) -> Column:
            x = S.wrap_longitude(lon + m["dx"]) if ring else lon
            return F.struct(F.hypot(m["dy"].cast("double"), m["dx"] * F.cos(F.radians(lat))).alias("far"), m["dy"].alias("dy"), m["dx"].alias("dx"), (lat + m["dy"]).alias("lat"), x.alias("lon"), F.lit(ring).alias("ring"))

        def in_ocean(c: Column) -> Column:
            cell = S.mask_cell(c["lat"], c["lon"])
            bit = F.getbit(F.get(mask, F.floor(cell / CELLS_A_WORD).cast("int")), F.pmod(cell, F.lit(CELLS_A_WORD)).cast("int")) == 1
            return (F.abs(c["lat"]) <= 90) & bit if ring else bit

        return F.array_min(F.filter(F.transform(moves, place), in_ocean))

    # A ring is worked out only if those before it have no cell.
    best = F.when(F.col(key).isNotNull(), F.coalesce(*map(first, range(rings + 1))))
    found = points.select(key, "latitude", "longitude").repartition(key).crossJoin(F.broadcast(mask_words(ocean))).select(key, best.alias("b"))
    return found.select(key, F.col("b.lat").alias("ocean_latitude"), F.col("b.lon").alias("ocean_longitude"), F.col("b.ring").alias("ring"))


def resolve_cells(points: DataFrame, gridded: DataFrame, key: str, value: str, half_span: float = 0.75, day: str | None = None, last_day: str | None = None, days: int = 10) -> DataFrame:
    """key, cell_latitude, cell_longitude (4 places), distance_km: the nearest gridded row with a value
    in the box around the point, null without one. Joined on squares as wide as the box's half; the
    box stops at the seam of longitudes. day (a date column) and last_day: only rows of the `days` days
    that end with it."""
    if day is not None and last_day is not None:
        end = F.lit(last_day).cast("date")
        gridded = gridded.filter(F.col(day).between(F.date_sub(end, days - 1), end))
    square = lambda c: F.floor(c / half_span)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    asked = points.select(key, "latitude", "longitude").withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near))
    asked = asked.withColumn("_y", square(F.col("latitude")) + F.col("_dy")).withColumn("_x", square(F.col("longitude")) + F.col("_dx"))
    cells = gridded.filter(F.col(value).isNotNull()).select(F.round("latitude", 4).alias("_lat"), F.round("longitude", 4).alias("_lon")).distinct()  # days of a cell are one
    cells = cells.withColumn("_y", square(F.col("_lat"))).withColumn("_x", square(F.col("_lon")))
    hit = asked.join(cells, ["_y", "_x"]).filter((F.abs(F.col("_lat") - F.col("latitude")) <= half_span) & (F.abs(F.col("_lon") - F.col("longitude")) <= half_span))
    km = S.haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    best = hit.groupBy(key).agg(F.min(F.struct(km.alias("km"), "_lat", "_lon")).alias("b"))
    return points.select(key).join(best, key, "left").select(key, F.col("b._lat").alias("cell_latitude"), F.col("b._lon").alias("cell_longitude"), F.col("b.km").alias("distance_km"))


def candidate_cells(points: DataFrame, key: str, radius: float = 1.0) -> DataFrame:
    """key, ordinal, latitude, longitude: the point, then eight directions at each step up to the radius."""
    moves = [(0.0, 0.0), *[(s * y, s * x) for s in CELL_STEPS if s <= radius for y, x in DIRECTIONS]]
    listed = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in moves])
    each = points.select(key, F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.posexplode(listed).alias("ordinal", "m"))
    lat = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("_lat") + F.col("m.dy")))
    own = F.col("ordinal") == 0
    return each.select(key, "ordinal", lat.alias("latitude"), F.when(own, F.col("_lon")).otherwise(S.wrap_longitude(F.col("_lon") + F.col("m.dx"))).alias("longitude"))


def marine_cells(points: DataFrame, with_data: DataFrame, key: str, radius: float = 1.0, cell: float = 0.25) -> DataFrame:
    """key, marine_latitude, marine_longitude: the first candidate whose model cell (squares of `cell`
    degrees) is among `with_data` (latitude, longitude of readings)."""
    square = lambda c: F.floor(c / cell)
    held = with_data.select(square(F.col("latitude")).alias("_y"), square(F.col("longitude")).alias("_x")).distinct()
    tried = candidate_cells(points, key, radius).withColumn("_y", square(F.col("latitude"))).withColumn("_x", square(F.col("longitude")))
    best = tried.join(held, ["_y", "_x"], "left_semi").groupBy(key).agg(F.min(F.struct("ordinal", "latitude", "longitude")).alias("b"))
    return points.select(key).join(best, key, "left").select(key, F.col("b.latitude").alias("marine_latitude"), F.col("b.longitude").alias("marine_longitude"))


def macro_grid(spark: SparkSession, ocean: DataFrame, target: int = 250, max_latitude: float = 80.0, steps: int = 24) -> DataFrame:
    """Equal-area points in the ocean, about `target` of them: the spacing is halved in on by counts;
    only the counts reach the driver. An empty mask counts as ocean everywhere."""
    anywhere = ocean.isEmpty()

    def points(spacing: float) -> DataFrame:
        all_points = P.equal_area_points(spark, spacing, max_latitude)
        if anywhere:
            return all_points
        return all_points.withColumn("cell_id", S.mask_cell(F.col("latitude"), F.col("longitude"))).join(ocean.select("cell_id"), "cell_id", "left_semi").drop("cell_id")

    low, high, best = 1.0, 40.0, None
    for _ in range(steps):
        spacing = (low + high) / 2
        n = points(spacing).count()
        best = spacing if n else best
        low, high = (spacing, high) if n > target else (low, spacing) if n else (low, spacing)
        if n and abs(n - target) <= max(3, target // 40):
            break
    if best is None:
        return spark.createDataFrame([], "latitude double, longitude double")
    return points(best)


def grid_rows(points: DataFrame) -> DataFrame:
    """Sample points as rows of the grid table, none probed yet."""
    place = F.concat_ws("|", F.format_string("%.4f", "latitude"), F.format_string("%.4f", "longitude"))
    null = F.lit(None)
    return points.select(place.alias("grid_id"), "latitude", "longitude", F.lit(True).alias("is_ocean"), null.cast("boolean").alias("is_valid"), F.lit(0).alias("fail_count"), null.cast("long").alias("last_checked"), null.cast("long").alias("last_success"))


def record_fetches(ledger: DataFrame, fetched: DataFrame, now_ms: int, always: tuple[str, ...] = ("open_meteo",)) -> DataFrame:
    """Finished fetches join the ledger: gridded ones only if they brought rows, marine ones always."""
    kept = fetched.filter((F.col("row_count") > 0) | F.col("dataset").isin(*always)).withColumn("fetched_at", F.lit(now_ms).cast("long"))
    return ledger.unionByName(kept.select(ledger.columns))


def backfill_report(plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """plan: see places.backfill_plan; fetched: port_id, dataset, row_count, failed.
    -> per port and dataset: status (error over fetched over cached or out_of_range; masked if a
    fetch brought nothing), rows, first and last day asked for."""
    got = fetched.groupBy("port_id", "dataset").agg(F.sum("row_count").alias("rows"), F.bool_or("failed").alias("failed"))
    asked = plan.groupBy("port_id", "dataset").agg(F.max("status").alias("planned"), F.bool_or(F.col("status") == "fetch").alias("_fetch"), F.min("chunk_start").alias("from_date"), F.max("chunk_end").alias("to_date"))
    rows = F.coalesce("rows", F.lit(0)).cast("long")
    status = F.when(~F.col("_fetch"), F.col("planned")).when(F.coalesce("failed", F.lit(False)), "error").when(rows == 0, "masked").otherwise("fetched")
    return asked.join(got, ["port_id", "dataset"], "left").select("port_id", "dataset", status.alias("status"), rows.alias("rows"), "from_date", "to_date")


def gazetteer_counts(places: DataFrame, cities_read: DataFrame | None = None) -> DataFrame:
    """entries, ports, cities, enriched ports, and of the cities read those left out as inland."""
    port = F.col("source") == "wpi"
    out = places.agg(F.count("*").alias("entries"), F.count_if(port).alias("ports"), F.count_if(~port).alias("cities"), F.count_if(port & (F.col("population") > 0)).alias("enriched"))
    if cities_read is None:
        return out
    return out.crossJoin(cities_read.agg(F.count("*").alias("_read"))).withColumn("inland", F.col("_read") - F.col("cities")).drop("_read")  # one row each


def grid_summary(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("points"), F.min("latitude").alias("min_latitude"), F.max("latitude").alias("max_latitude"))


def scope_summary(obs: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    return obs.groupBy(*keys).agg(F.count("*").alias("n"), F.to_date(F.min(time)).alias("first_day"), F.to_date(F.max(time)).alias("last_day"))


def _gazetteer() -> list[Column]:
    return [F.col("source") != "wpi", F.desc_nulls_last("population"), F.col("port_name"), F.col("port_id")]


def gazetteer_order(places: DataFrame) -> DataFrame:
    """Ports first, then by population and name."""
    return places.orderBy(*_gazetteer())


def gazetteer_positions(places: DataFrame) -> DataFrame:
    """The places with `position`, their number in that order from 1, found on all tasks."""
    return positions(in_order(places, [], _gazetteer()), []).withColumn("position", F.col("_j") + 1).drop("_at", "_block", "_j")


def earliest(obs: DataFrame, cap: int, tie: str = "obs_id") -> DataFrame:
    """The feature of a row cap: the earliest `cap` rows with truncated, whether the cap was reached."""
    kept = obs.orderBy("timestamp", tie).limit(cap)
    return kept.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) >= cap)


def repeatable_sample(rows: DataFrame, key: str, n: int = 4000, seed: int = 0) -> DataFrame:
    """The n rows with the smallest digests of seed and key: the same ones on every run and layout."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def preview(rows: DataFrame, n: int = 25, places: int = 3, width: int = 26) -> DataFrame:
    """The first n rows as text: floats to 3 places, other values cut to 26 characters."""
    floats = {f.name for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return rows.limit(n).select(*[(F.format_string(f"%.{places}f", c) if c in floats else F.substring(F.col(c).cast("string"), 1, width)).alias(c) for c in rows.columns])
