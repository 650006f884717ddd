"""Nearest places by the packed tree, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import places as P
from saltmarsh.operators import space
from saltmarsh.session import settled, shared_folder, sweep


def km(a, b):
    lat1, lon1, lat2, lon2 = (np.radians(x) for x in (a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1]))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, h)))


def world():
    """Places: spread, a very dense region, both poles, the seam, one spot many times. Points: likewise, and in empty regions."""
    rng = np.random.default_rng(11)
    spread = np.column_stack([rng.uniform(-60, 60, 300), rng.uniform(-180, 180, 300)])
    dense = np.column_stack([rng.normal(50, 1e-3, 900), rng.normal(8, 1e-3, 900)])
    ends = np.column_stack([rng.choice([-1, 1], 80) * rng.uniform(85, 90, 80), rng.uniform(-180, 180, 80)])
    seam = np.column_stack([rng.uniform(-5, 5, 80), (179 + rng.uniform(0, 2, 80) + 180) % 360 - 180])
    spot = np.tile([[12.5, -40.25]], (200, 1))
    places = np.concatenate([spread, dense, ends, seam, spot])
    points = np.concatenate([places[::17], np.column_stack([rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)]), dense[:40] + 1e-4, [[90, 0], [-90, 7], [0, 180], [0, -180], [-75, 20]]])
    return points, places


def frames(spark, points, places):
    at = "latitude double, longitude double"
    # Identifiers are null or shared: a third of the points have none, another third one and the same.
    ids = [None if i % 3 == 0 else -1 if i % 3 == 1 else i for i in range(len(points))]
    asked = spark.createDataFrame([(ids[i], i, *map(float, p)) for i, p in enumerate(points)] + [(None, 9999, None, 1.0), (5, 9998, float("nan"), 2.0)], f"id int, n int, {at}").repartition(5)
    held = spark.createDataFrame([(j, *map(float, p)) for j, p in enumerate(places)] + [(10**6, None, None), (10**6, 3.0, float("nan"))], f"p int, {at}").repartition(3)
    return asked, held


@pytest.mark.parametrize("k", [1, 4])
def test_exact_nearest_equals_brute_force(spark, k):
    points, places = world()
    asked, held = frames(spark, points, places)
    got = {}
    for r in P.exact_nearest_places(asked, held, "n", "p", k).collect():
        got.setdefault(r.n, {})[r.rank] = (r.place, r.distance_km)
    d = km(points, places)
    assert set(got) == set(range(len(points)))
    for i in range(len(points)):
        want = np.lexsort((np.arange(len(places)), np.round(d[i], 9)))[:k]
        assert sorted(got[i]) == list(range(1, k + 1))
        assert np.allclose([got[i][r + 1][1] for r in range(k)], d[i][want], atol=1e-7)
        clear = np.diff(np.sort(d[i])[: k + 1]).min() > 1e-6  # no ties but for rounding
        if clear:
            assert [got[i][r + 1][0] for r in range(k)] == want.tolist()
    # Of places in one spot the smallest identifiers come first.
    on_spot = P.exact_nearest_places(spark.createDataFrame([(1, 12.5, -40.25)], "n int, latitude double, longitude double"), held, "n", "p", 3)
    assert [r.place for r in on_spot.orderBy("rank").collect()] == list(range(len(places) - 200, len(places) - 197))


def test_points_with_null_or_shared_identifiers_have_places_of_their_own(spark):
    points, places = world()
    asked, held = frames(spark, points, places)
    for found in (P.exact_nearest_places(asked, held, "id", "p", 2), P.nearest_places(asked, held, "id", "p", 2, pads=(360.0,))):
        rows = found.groupBy("id").count().collect()
        n = {r.id: r["count"] for r in rows}
        assert n[None] == 2 * len(range(0, len(points), 3)) and n[-1] == 2 * len(range(1, len(points), 3))
        assert n[2] == 2


@pytest.mark.parametrize("wrap", [False, True])
def test_nearest_in_boxes_equals_brute_force(spark, wrap):
    points, places = world()
    asked, held = frames(spark, points, places)
    got = {(r.n, r.rank): (r.place, r.distance_km) for r in P.nearest_places(asked, held, "n", "p", 3, wrap=wrap).collect()}
    d = km(points, places)
    across = np.abs(points[:, None, 1] - places[None, :, 1])
    apart = np.maximum(np.abs(points[:, None, 0] - places[None, :, 0]), np.minimum(across, 360 - across) if wrap else across)
    want = 0
    for i in range(len(points)):
        pad = next((p for p in (2.0, 5.0, 15.0, 45.0) if apart[i].min() <= p), None)
        if pad is None:
            continue
        near = np.sort(d[i][apart[i] <= pad])[:3]
        want += len(near)
        assert np.allclose([got[i, r + 1][1] for r in range(len(near))], near, atol=1e-7)
    assert len(got) == want


def test_leaves_are_bounded_and_points_meet_few_places(spark):
    points, places = world()
    asked, held = frames(spark, points, places)
    tree = P.place_tree(held, "p", 2)
    sizes = tree.rows.groupBy("_node").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 1 << space.STEP and sizes[1] == len(places) - 200 + 2
    assert all(level.groupBy("_parent").count().agg(F.max("count")).first()[0] <= 1 << space.STEP for level in tree.levels)
    assert tree.levels[-1].agg(F.sum("_n")).first()[0] == tree.levels[0].agg(F.sum("_n")).first()[0] == sizes[1]
    met = tree.reached(P._asked(asked, "n"), space.sum_of_squares(space.gap), space.sum_of_squares(space.span), 2)
    assert met.count() <= 8 * (1 << space.STEP) * len(points)  # of some 1160 places each


def test_empty_tables(spark):
    points, places = world()
    asked, held = frames(spark, points[:3], places[:3])
    for f in (P.exact_nearest_places, P.nearest_places):
        assert f(asked.limit(0), held, "n", "p").collect() == [] and f(asked, held.limit(0), "n", "p").collect() == []


def test_swept_tables_are_gone(spark):
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    settled(spark.range(3), "some")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(at)
    sweep(spark)
    assert not files.exists(at)
    assert settled(spark.range(3), "some").count() == 3  # the folder comes again
