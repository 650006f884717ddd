"""What a box or a radius reads of the stored layout, and that it finds the same as a filter over all rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import analytics as A
from saltmarsh.operators.observations import ObservationFilter
from saltmarsh.operators.space import hilbert
from saltmarsh.sources import clustered as C

DAY = 86_400_000
FILTERS = {
    "small box": ObservationFilter(bbox=(10, 12, 20, 23)), "day and box": ObservationFilter(start_ms=DAY, end_ms=2 * DAY - 1, bbox=(-40, -30, -100, -80)), "radius": ObservationFilter(centre=(50.0, 8.0), radius_km=300),
    "seam radius": ObservationFilter(centre=(0.0, 179.5), radius_km=400), "pole": ObservationFilter(centre=(89.0, 0.0), radius_km=500), "seam box": ObservationFilter(bbox=(-10, 10, 175, -175), wrap=True),
    "all": ObservationFilter(include_forecast=True), "none": ObservationFilter(start_ms=99 * DAY),
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    n = 30_000
    lat, lon = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    lat[: n // 3], lon[: n // 3] = rng.normal(50, 0.5, n // 3), rng.normal(8, 0.5, n // 3)  # a third in one place
    rows = [(i, float(a), float(o), int(rng.integers(0, 3 * DAY)), bool(i % 9 == 0)) for i, (a, o) in enumerate(zip(lat, lon))]
    rows += [(n, None, None, 5, False), (n + 1, 1.0, 2.0, None, False), (n + 2, float("nan"), 2.0, 7, False)]
    obs = spark.createDataFrame(rows, "id int, latitude double, longitude double, timestamp long, is_forecast boolean").repartition(4)
    path = tmp_path_factory.mktemp("clustered") / "t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    C.write_clustered(obs, f"file://{path}", rows_per_file=500, tasks=12)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return obs, path


@pytest.mark.parametrize("name", list(FILTERS))
def test_same_rows_as_a_filter_over_all(spark, table, name):
    obs, path = table
    where = FILTERS[name]
    want, got = ({r.id for r in where.apply(df).collect()} for df in (obs, C.read_clustered(spark, f"file://{path}", where)))
    assert got == want and (bool(want) == (name != "none"))


def test_few_files_are_read(spark, table):
    _, path = table
    files = spark.read.parquet(f"file://{path}/files")
    total = files.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    assert total[1] == 30_003 and total[2] <= 500 and total[0] == len(list(path.glob("rows/*/*.parquet")))
    read = {name: C.files_for(spark, f"file://{path}", where).count() for name, where in FILTERS.items()}
    assert read["small box"] <= total[0] / 8 and read["day and box"] <= total[0] / 12 and read["seam box"] <= total[0] / 3 and read["none"] == 0 and read["all"] == total[0]
    # Within what is read, the statistics of row groups tell boxes apart as well.
    meet = 0
    for file in path.glob("rows/*/*.parquet"):
        meta = pq.read_metadata(file)
        for g in range(meta.num_row_groups):
            s = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            lat, lon = s["latitude"], s["longitude"]
            meet += bool(lat.has_min_max and lat.min <= 12 and lat.max >= 10 and lon.min <= 23 and lon.max >= 20)
    assert meet <= read["small box"]


def test_sketches_of_parts_are_as_good_as_one(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.lognormal(size=60_000), np.full(20_000, 1.5), rng.normal(50, 1, 20_000)])
    rng.shuffle(v)
    rows = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)] + [(0, None), (1, float("nan"))], "k int, v double").withColumn("time", F.timestamp_seconds(F.rand(1) * 86_400 * 40))
    shares = {f"q{int(p * 1000)}": p for p in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999)}
    days = A.quantile_sketches(rows, "v", ["k"])
    assert days.count() == 80 and days.agg(F.sum("n")).first()[0] == len(v)
    for keys, part in ((["k"], [v[0::2], v[1::2]]), ([], [v])):
        for r in A.merged_quantiles(days, shares, keys).collect():
            held = np.sort(part[r.k if keys else 0])
            for name, p in shares.items():
                low, high = np.searchsorted(held, r[name], "left") / len(held), np.searchsorted(held, r[name], "right") / len(held)
                assert low - 0.002 <= p <= high + 0.002
    few = A.merged_quantiles(A.quantile_sketches(rows.limit(1500), "v", ["k"]), {"median": 0.5}, []).first()
    exact = sorted(r.v for r in rows.limit(1500).collect() if r.v == r.v)
    assert few.median == exact[(few.n + 1) // 2 - 1]


def test_the_curve_meets_every_cell_once_and_goes_on_to_a_neighbour(spark):
    n = 16
    at = lambda c: (c + 0.5) / n * 2 - 1
    cells = spark.range(n * n).select(at(F.col("id") % n).alias("x"), at(F.floor(F.col("id") / n)).alias("y"))
    found = sorted((r.d, r.x, r.y) for r in cells.select("x", "y", hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect())
    assert [d for d, _, _ in found] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 2 / n for a, b in zip(found, found[1:]))
    edges = spark.createDataFrame([(None, 0.0), (0.0, None), (1.0, 1.0), (float("nan"), 0.0)], "x double, y double")
    assert [r.d is None for r in edges.select(hilbert(F.col("x"), F.col("y")).alias("d")).collect()] == [True, True, False, False]
