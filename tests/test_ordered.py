"""Series that lie over many blocks: fills, totals, positions, calendars and downsampling."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import slow_lttb

from saltmarsh.operators import ordered
from saltmarsh.operators import series as R


@pytest.fixture(autouse=True)
def small_blocks(spark):
    """Small partitions stay as they are, so that series have several blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def long_series(n=3000, seed=1):
    """One series of n rows, two short ones, one with a null key, one with nothing known; long gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for key, size, known in (("a", n, 0.02), ("b", 7, 0.5), (None, 5, 0.6), ("none", 4, 0.0), ("one", 1, 1.0)):
        rows += [(key, i * 3, float(np.round(rng.normal(), 3)) if rng.random() < known else None) for i in range(size)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i int, v double").repartition(6)


@pytest.mark.parametrize("how", ["ffill", "linear", "interpolate", "zero", "none"])
def test_fills_over_blocks(spark, how):
    rows = long_series()
    got = {(r.k, r.i): r.v for r in R.fill_gaps(frame(spark, rows), ["v"], how, ["k"], "i").collect()}
    held = pd.DataFrame(rows, columns=["k", "i", "v"]).astype({"v": float})
    for _, s in held.groupby("k", dropna=False):
        v = s.v.reset_index(drop=True)
        want = {"ffill": v.ffill, "zero": lambda: v.fillna(0), "none": lambda: v}.get(how, lambda: v.interpolate(limit_direction="both"))()
        have = [got[None if k is None or k != k else k, i] for k, i in zip(s.k, s.i)]
        assert np.allclose(np.array(have, dtype=float), want.to_numpy(dtype=float), equal_nan=True)
    assert len(got) == len(rows)


def test_totals_and_positions_over_blocks(spark):
    rows = long_series(seed=2)
    for keys in (["k"], []):
        some = rows if keys else [r for r in rows if r[0] == "a"]
        got = {(r.k, r.i): r.cumulative_v for r in R.running_totals(frame(spark, some), ["v"], keys, "i").collect()}
        for key in {r[0] for r in some}:
            total = None
            for k, i, v in some:
                if k == key:
                    total = v if total is None else total + (v or 0) if v is not None else total
                    assert got[k, i] == pytest.approx(total) if total is not None else got[k, i] is None
    held = ordered.positions(ordered.in_order(frame(spark, rows), ["k"], ["i"]), ["k"], counted=True)
    assert held.filter("k = 'a'").select("_block").distinct().count() > 1
    assert all(r._j == r.i // 3 for r in held.collect())
    assert {(r.k, r._n) for r in held.collect()} == {("a", 3000), ("b", 7), (None, 5), ("none", 4), ("one", 1)}
    assert held.select("_series").distinct().count() == 5
    assert R.running_totals(frame(spark, rows).limit(0), ["v"], ["k"], "i").collect() == []


def test_calendar_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "CALENDAR_BLOCK", 10)
    start = dt.datetime(2024, 1, 1)
    obs = [("a", start + dt.timedelta(hours=h), float(h)) for h in (0, 1, 30, 95, 96 * 5)] + [("b", start, 7.0)]
    df = spark.createDataFrame(obs, "cell string, time timestamp, sst_celsius double")
    for c in [*R.MEANS, *R.BEARINGS]:
        df = df.withColumn(c, F.col("sst_celsius")) if c not in df.columns else df
    out = R.resample(df, "6h", keys=["cell"], fill="linear").orderBy("cell", "window_start").collect()
    a = [r for r in out if r.cell == "a"]
    assert len(a) == 81 and len(out) == 82
    assert [r.window_start for r in a] == [start + dt.timedelta(hours=6 * i) for i in range(81)]
    known = {0: 0.5, 5: 30.0, 15: 95.0, 80: 480.0}
    assert np.allclose([r.sst_celsius for r in a], np.interp(range(81), list(known), list(known.values())))
    assert set(out[0].asDict()) & {"_at", "_block"} == set()


@pytest.mark.parametrize("points", [3, 50, 400])
def test_downsampling_of_a_series_over_blocks(spark, points):
    rng = np.random.default_rng(4)
    y = np.round(np.cumsum(rng.normal(size=20_000)), 3)
    y[5000:5600] = 3.25  # flat, and a straight line
    y[9000:9500] = np.arange(500)
    rows = [(float(i), float(v)) for i, v in enumerate(y)]
    got = R.lttb(spark.createDataFrame(rows, "x double, y double").repartition(5), [], "x", "y", points)
    assert sorted(map(tuple, got.collect())) == slow_lttb(rows, points)


def test_hull_keeps_every_corner():
    rng = np.random.default_rng(6)
    for _ in range(50):
        p = sorted((float(x), float(y)) for x, y in rng.integers(0, 12, (60, 2)))
        p = [(j, *q) for j, q in enumerate(p)]
        hull = R._hull(p)
        for a, b in rng.normal(size=(40, 2)):
            assert max(a * q[1] + b * q[2] for q in hull) == pytest.approx(max(a * q[1] + b * q[2] for q in p))
        assert len(R._hull([(i, float(i), 0.5) for i in range(1000)])) == 2


@pytest.mark.parametrize("window, chunk", [(20, 64), (90, 10), (1, 7)])
def test_spells_over_chunks_equal_brute_force(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    rng = np.random.default_rng(window)
    series = {"a": 900, "b": 30, None: 200, "short": 3}
    rows = [(k, i, None if rng.random() < 0.1 else float(np.round(rng.normal() + (2 if i // 7 % 5 == 0 else 0), 1))) for k, n in series.items() for i in range(n)]
    rows[50] = ("a", 50, float("nan"))
    got = {(r.k, r.i): r.warm_spell for r in R.warm_spells(frame(spark, rows), "v", ["k"], "i", window, 0.7, 3).collect()}
    for key in series:
        v = [x if x is not None and x == x else None for k, _, x in rows if k == key]
        hot = []
        for i, x in enumerate(v):
            before = [y for y in v[max(0, i - window) : i] if y is not None]
            hot.append(x is not None and len(before) >= 10 and x > np.quantile(before, 0.7) + 1e-12)
        for i in range(len(v)):
            a, b = i, i
            while hot[i] and a > 0 and hot[a - 1]:
                a -= 1
            while hot[i] and b + 1 < len(v) and hot[b + 1]:
                b += 1
            assert got[key, i] == (hot[i] and b - a + 1 >= 3)
    assert any(got.values()) == (window > 1) and len(got) == len(rows)
