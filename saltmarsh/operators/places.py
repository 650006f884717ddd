"""Spatial joins, sample grids, backfill plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.operators.space import AXES, PlaceTree, gap, morton, on_sphere, span, sum_of_squares
from saltmarsh.session import settled


def across_seam(places: DataFrame, longitude: str, margin: float) -> DataFrame:
    """Adds copies, 360 degrees on, of the places within `margin` degrees of the antimeridian."""
    at = F.col(longitude)
    copies = F.filter(F.array(at, at - 360, at + 360), lambda x: (x >= -180 - margin) & (x <= 180 + margin))
    return places.withColumn(longitude, F.explode(copies))


def _asked(points: DataFrame, point_id: str) -> DataFrame:
    """A row and a number for every point that has a position, whatever its identifier."""
    rows = points.select(point_id, F.col("latitude").cast("double").alias("_lat"), F.col("longitude").cast("double").alias("_lon"))
    rows = rows.select("*", *on_sphere(F.col("_lat"), F.col("_lon"))).filter("_x <= 1 and _z <= 1")
    return settled(rows.withColumn("_row", F.monotonically_increasing_id()), "points")


def place_tree(places: DataFrame, place_id: str, k: int, seam: float | None = None) -> PlaceTree:
    """The tree of the places that have a position. Of places in one spot the k with the smallest
    place_id are enough. seam: also copies, 360 degrees on, of those within so many degrees of the
    antimeridian."""
    held = places.select(F.col(place_id).alias("place"), F.col("latitude").cast("double").alias("_plat"), F.col("longitude").cast("double").alias("_plon"))
    held = held.withColumn("_n", F.row_number().over(Window.partitionBy("_plat", "_plon").orderBy("place"))).filter(F.col("_n") <= k).drop("_n")
    held = held.select("*", *[c.alias(f"_p{a}") for c, a in zip(on_sphere(F.col("_plat"), F.col("_plon")), AXES)]).filter("_px <= 1 and _pz <= 1")
    if seam is not None:
        held = across_seam(held, "_plon", seam)
    # Copies have leaves of their own: with the originals' their boxes would go around the globe.
    order = [F.abs("_plon") > 180, morton([F.col(f"_p{a}") for a in AXES])]
    return PlaceTree(held, order, ["_plat", "_plon", *[f"_p{a}" for a in AXES]])


def _ranked(hit: DataFrame, point_id: str, k: int) -> DataFrame:
    """The k nearest of the places that points have met."""
    hit = hit.withColumn("distance_km", S.haversine_km(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon")))
    hit = hit.withColumn("rank", F.row_number().over(Window.partitionBy("_row").orderBy("distance_km", "place"))).filter(F.col("rank") <= k)
    return hit.select(point_id, "place", "rank", "distance_km", S.initial_bearing(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon")).alias("bearing_deg"))


def nearest_places(points: DataFrame, places: DataFrame, point_id: str, place_id: str, k: int = 1, pads: tuple[float, ...] = (2.0, 5.0, 15.0, 45.0), wrap: bool = False) -> DataFrame:
    """The k nearest places in the first box (of +-pad degrees) that holds any; wrap: boxes go on
    beyond 180 degrees. See exact_nearest_places for the k nearest of all.

    Two descents of the tree of places: one for the distance in degrees of the nearest place, which
    tells the box, one for the k nearest places in it. Rows are points, each its own: points with
    one identifier or a null one have their places each. Points without a position, or without a
    place in the last box, have none. Ties: the smaller place_id.
    """
    asked, tree = _asked(points, point_id), place_tree(places, place_id, k, pads[-1] if wrap else None)
    degrees = (("_plat", "_lat"), ("_plon", "_lon"))
    met = tree.reached(asked.select("_row", "_lat", "_lon"), F.greatest(*[gap(*d) for d in degrees]), F.greatest(*[span(*d) for d in degrees]), 1)
    apart = F.greatest(F.abs(F.col("_plat") - F.col("_lat")), F.abs(F.col("_plon") - F.col("_lon")))
    first = met.groupBy("_row").agg(F.min(apart).alias("_apart"))
    box = first.select("_row", F.array_min(F.filter(F.array(*map(F.lit, pads)), lambda p: p >= F.col("_apart"))).alias("_pad")).filter("_pad is not null")
    boxed = settled(asked.join(box, "_row"), "boxed_points")  # points are counted before they go down
    meets, inside = ((F.greatest(*[f(*d) for d in degrees]) <= F.col("_pad")) for f in (gap, span))
    hit = tree.reached(boxed, F.when(meets, sum_of_squares(gap)), F.when(inside, sum_of_squares(span)), k)
    return _ranked(hit.filter(apart <= F.col("_pad")), point_id, k)


def exact_nearest_places(points: DataFrame, places: DataFrame, point_id: str, place_id: str, k: int = 1) -> DataFrame:
    """The k nearest places of every point, over poles and antimeridian.

    One descent of the tree of places on the unit sphere, by chords. Rows are points, each its own, as
    in nearest_places; points without a position have no places. Ties: the smaller place_id.
    """
    tree = place_tree(places, place_id, k)
    return _ranked(tree.reached(_asked(points, point_id), sum_of_squares(gap), sum_of_squares(span), k), point_id, k)


def attach_city_population(ports: DataFrame, cities: DataFrame, port_id: str, radius_km: float = 35.0, wrap: bool = False) -> DataFrame:
    """The largest population within the radius, among the nine 1-degree cells around (wrap: beyond
    180 degrees as well); ports without any keep null."""
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = ports.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)).withColumn("_cy", F.floor("latitude") + F.col("_dy")).withColumn("_cx", F.floor("longitude") + F.col("_dx"))
    c = cities.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("population").alias("_pop"))
    c = (across_seam(c, "_lon", 2.0) if wrap else c).withColumn("_cy", F.floor("_lat")).withColumn("_cx", F.floor("_lon"))
    found = p.join(c, ["_cy", "_cx"]).filter((F.col("_pop") > 0) & (S.haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")) <= radius_km))
    return ports.join(found.groupBy(port_id).agg(F.max("_pop").alias("city_population")), port_id, "left")


def coastal(points: DataFrame, ocean: DataFrame, key: str, km: float = 60.0) -> DataFrame:
    """Points in or near an ocean cell. ocean: cell_id."""
    rings = max(1, math.ceil(km / 111.0))
    wide = F.ceil(km / (111.0 * F.greatest(F.lit(0.15), F.cos(F.radians("latitude"))))).cast("int")
    cells = points.select(key, "latitude", "longitude", F.explode(F.sequence(F.lit(-rings), F.lit(rings))).alias("_dy"), wide.alias("_w"))
    cells = cells.filter(F.col("latitude") + F.col("_dy") <= 90).filter(F.col("latitude") + F.col("_dy") >= -90)
    cells = cells.select(key, "latitude", "longitude", "_dy", F.explode(F.sequence(-F.col("_w"), F.col("_w"))).alias("_dx"))
    cells = cells.select(key, S.mask_cell(F.col("latitude") + F.col("_dy"), F.col("longitude") + F.col("_dx")).alias("cell_id"))
    hit = cells.join(ocean.select("cell_id"), "cell_id", "left_semi").select(key).distinct()
    return points.join(hit, key, "left_semi")


def covered(requests: DataFrame, ledger: DataFrame, how: str = "left_semi") -> DataFrame:
    """Requests (dataset, box, start_ts, end_ts) that one ledger row contains; left_anti: the others.

    A ledger row is held once per 10-degree tile of its box (648 at most); a request meets only the
    rows of the tile that its south-west corner lies in.
    """
    tile = lambda c: F.floor(F.col(c) / 10)
    r = requests.withColumn("_ty", tile("min_lat")).withColumn("_tx", tile("min_lon")).alias("r")
    g = ledger.withColumn("_ty", F.explode(F.sequence(tile("min_lat"), tile("max_lat")))).withColumn("_tx", F.explode(F.sequence(tile("min_lon"), tile("max_lon")))).alias("g")
    inside = (F.col("r.dataset") == F.col("g.dataset")) & (F.col("r._ty") == F.col("g._ty")) & (F.col("r._tx") == F.col("g._tx")) & (F.col("g.min_lat") <= F.col("r.min_lat")) & (F.col("g.max_lat") >= F.col("r.max_lat")) & (F.col("g.min_lon") <= F.col("r.min_lon")) & (F.col("g.max_lon") >= F.col("r.max_lon")) & (F.col("g.start_timestamp") <= F.col("r.start_ts")) & (F.col("g.end_timestamp") >= F.col("r.end_ts"))
    return r.join(g, inside, how).drop("_ty", "_tx")


def date_chunks(ranges: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """A row per window of `days` days, inclusive and without overlap."""
    rows = ranges.filter(F.col(start) <= F.col(end)).withColumn("chunk_start", F.explode(F.sequence(start, end, F.expr(f"INTERVAL {int(days)} DAYS"))))
    return rows.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(end)))


def backfill_plan(requests: DataFrame, coverage: DataFrame, ledger: DataFrame, days: int = 90) -> DataFrame:
    """requests: port_id, dataset, box, start_date, end_date; coverage: dataset, low_date, high_date
    -> status out_of_range / cached / fetch, and for what is to be fetched a row per chunk."""
    rows = requests.join(coverage, "dataset", "left")
    rows = rows.withColumn("start_date", F.greatest("start_date", "low_date")).withColumn("end_date", F.least("end_date", "high_date"))
    start, _ = S.day_bounds_ms(F.col("start_date"))
    _, end = S.day_bounds_ms(F.col("end_date"))
    rows = rows.withColumn("start_ts", start).withColumn("end_ts", end)
    live = rows.filter("start_date <= end_date")
    gone = rows.filter("start_date > end_date").withColumn("status", F.lit("out_of_range"))
    held = covered(live, ledger).withColumn("status", F.lit("cached"))
    todo = date_chunks(covered(live, ledger, "left_anti"), "start_date", "end_date", days).withColumn("status", F.lit("fetch"))
    columns = ["port_id", "dataset", "status", "chunk_start", "chunk_end"]
    null = F.lit(None).cast("date")
    return todo.select(columns).unionByName(gone.unionByName(held).withColumn("chunk_start", null).withColumn("chunk_end", null).select(columns))


def equal_area_points(spark: SparkSession, spacing: float, max_latitude: float = 80.0) -> DataFrame:
    """Sample points with equal area each, by bands of latitude."""
    bands = spark.range(int(2 * max_latitude / spacing + 1)).select((F.lit(-max_latitude + spacing / 2) + F.col("id") * spacing).alias("lat")).filter(F.col("lat") <= max_latitude)
    count = F.greatest(F.lit(1), F.bround(F.lit(360.0) * F.cos(F.radians("lat")) / spacing)).cast("int")
    rows = bands.withColumn("_n", count).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select(F.bround("lat", 4).alias("latitude"), F.bround(-180.0 + (F.col("_i") + 0.5) * 360.0 / F.col("_n"), 4).alias("longitude"))


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of one place, port or saved specification; a literal that reaches the scan."""
    return rows.filter(F.col(key) == F.lit(value))


def build_gazetteer(ports: DataFrame, cities: DataFrame, countries: DataFrame) -> DataFrame:
    """Ports first, then cities, the first of each port_id; empty country names looked up."""
    rows = ports.withColumn("_kind", F.lit(0)).unionByName(cities.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("port_id").orderBy("_kind", F.desc_nulls_last("population"), "port_name"))
    rows = rows.withColumn("_n", first).filter("_n = 1").drop("_n", "_kind")
    known = countries.select("country_code", F.col("country_name").alias("_country"))
    return rows.join(known, "country_code", "left").withColumn("country_name", F.coalesce(F.nullif("country_name", F.lit("")), "_country")).drop("_country")
