"""Versions of the merged table under crashes and concurrent writers; live cells that fall silent; late rows."""

import datetime as dt
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from test_operators import READING, reading

from saltmarsh.operators import observations as O
from saltmarsh.streaming import observations as X
from saltmarsh.streaming.snapshots import Conflict, Versions

DAY = 86_400_000


def batch(spark, *rows):
    return O.validate(spark.createDataFrame(list(rows), READING))[0]


def heights(df):
    return sorted((r.timestamp // DAY, r.wave_height_m) for r in df.collect())


def counter(spark, path):
    return Versions(spark, path, "day", "n long, day int")


def plus(k):
    """Adds k to the day's only number."""
    return lambda rows: rows.unionByName(rows.sparkSession.createDataFrame([(k, 1)], "n long, day int")).groupBy("day").agg(F.sum("n").alias("n")).select("n", "day")


def test_readers_keep_their_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert X.stored(spark, path).count() == 0
    X.merge_into(path, batch(spark, reading(1, "open_meteo", wave_height_m=1.0), reading(2, "open_meteo", ts=DAY, wave_height_m=5.0)), 1)
    before = X.stored(spark, path)
    X.merge_into(path, batch(spark, reading(3, "open_meteo", wave_height_m=2.0)), 2)
    assert heights(before) == [(0, 1.0), (1, 5.0)] and heights(X.stored(spark, path)) == [(0, 2.0), (1, 5.0)]
    assert heights(X.stored(spark, path, 1)) == heights(before)
    table = X.versions(spark, path)
    # The day that the second batch didn't touch is still in the first one's files.
    one, two = table.manifest(1)["partitions"], table.manifest(2)["partitions"]
    assert one["1970-01-02"] == two["1970-01-02"] and one["1970-01-01"] != two["1970-01-01"]


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    X.merge_into(path, batch(spark, reading(1, "open_meteo", wave_height_m=1.0)), 1)
    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", lambda *_: 1 / 0)  # after the files have been written
        with pytest.raises(ZeroDivisionError):
            X.merge_into(path, batch(spark, reading(2, "open_meteo", wave_height_m=2.0), reading(3, "open_meteo", ts=DAY, wave_height_m=3.0)), 2)
    assert heights(X.stored(spark, path)) == [(0, 1.0)] and X.versions(spark, path).numbers() == [1]
    X.merge_into(path, batch(spark, reading(2, "open_meteo", wave_height_m=2.0)), 2)
    assert heights(X.stored(spark, path)) == [(0, 2.0)]


def test_the_later_writer_merges_again(spark, tmp_path):
    table, calls = counter(spark, f"file://{tmp_path}/t"), []

    def beaten(day):
        def change(rows):
            calls.append(day)
            if len(calls) == 1:  # while the first writer is at work another one commits
                other = plus(100) if day == 1 else lambda _: spark.createDataFrame([(7, 2)], "n long, day int")
                table.commit(other, [day])
            return plus(1)(rows)

        return change

    table.commit(beaten(1), [1])
    assert [r.n for r in table.rows().collect()] == [101] and len(calls) == 2 and table.numbers() == [1, 2]
    calls.clear()
    table.commit(beaten(2), [1])  # the other one's partition isn't ours: the change isn't made again
    assert sorted(tuple(r) for r in table.rows().collect()) == [(7, 2), (102, 1)] and len(calls) == 1
    assert sorted(tuple(r) for r in table.rows(only=[1]).collect()) == [(102, 1)]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: counter(spark, f"file://{tmp_path}/t").commit(plus(k), [1], tries=30), (1, 10, 100)))
    table = counter(spark, f"file://{tmp_path}/t")
    assert [r.n for r in table.rows().collect()] == [111] and table.numbers() == [1, 2, 3]
    table._publish = lambda manifest: False
    with pytest.raises(Conflict):
        table.commit(plus(5), [1], tries=2)
    assert [r.n for r in table.rows().collect()] == [111]


def test_a_batch_is_committed_once_and_partitions_can_end(spark, tmp_path):
    table = counter(spark, f"file://{tmp_path}/t")
    assert [table.commit(plus(4), [1], ("stream", n)) for n in (0, 0, 1, 0)] == [1, 1, 2, 2]
    assert [r.n for r in table.rows().collect()] == [8]
    table.commit(lambda rows: rows.limit(0), [1])
    assert table.rows().collect() == [] and table.manifest()["partitions"] == {} and table.rows(2).count() == 1


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    table = counter(spark, f"file://{tmp_path}/t")
    for k in range(4):
        table.commit(plus(1), [1])
    (tmp_path / "t/data/v=orphan/day=1").mkdir(parents=True)
    assert table.vacuum(keep=1, older_than_s=3600) == []  # a writer may still be at work on it
    assert len(table.vacuum(keep=2, older_than_s=-5)) == 5  # two commits, their manifests, what the dead writer left
    assert [r.n for r in table.rows().collect()] == [4] and [r.n for r in table.rows(3).collect()] == [3] and table.numbers() == [3, 4]


def stream(spark, folder, files):
    """A file a batch, in order."""
    folder.mkdir()
    for i, rows in enumerate(files):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stamp = 1_700_000_000 + i
        os.utime(folder / f"{i}.json", (stamp, stamp))
    return spark.readStream.schema("cell string, time timestamp, sst double, height double").option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def at(hours, cell, **values):
    return {"cell": cell, "time": (dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)).isoformat(), **values}


def test_silent_cells_are_dropped(spark, tmp_path):
    files = [[at(0, f"c{i}", sst=float(i), height=1.0) for i in range(20)] + [at(0, "live", sst=1.0, height=2.0)]]
    files += [[at(5 * k, "live", sst=float(k)), at(5 * k, "live", sst=float(k) - 0.5)] for k in range(1, 7)]
    files += [[at(31, "c3", sst=33.0), at(2, "live", sst=99.0)], [at(32, "live", sst=50.0)]]
    readings = stream(spark, tmp_path / "in", files)
    log, rows = f"file://{tmp_path}/log", f"file://{tmp_path}/rows"
    query = X.write_updates(X.live_cells(readings, ["cell"], ["sst", "height"]), rows, log)
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in states) >= 21 and states[-1]["numRowsTotal"] <= 2 * 2  # a state and a timer for each of two cells
    got = {r.cell: (r.sst, r.height) for r in X.newest(spark, rows, ["cell"]).collect()}
    assert got["live"] == (50.0, 2.0)  # never silent: the height of the first batch is still known, the late row was not
    assert got["c3"] == (33.0, None)  # began anew
    assert got["c4"] == (4.0, 1.0)  # as last written


def test_late_rows_are_dropped_when_their_window_is_closed(spark, tmp_path):
    readings = stream(spark, tmp_path / "in", [[at(1, "a", sst=1.0)], [at(30, "a", sst=2.0)], [at(24 * 5, "a", sst=3.0)], [at(24 * 5 + 1, "a", sst=5.0)], [at(2, "a", sst=100.0), at(24 * 5 + 2, "a", sst=7.0)]])
    for c in [*X.R.MEANS, *X.R.BEARINGS]:
        readings = readings.withColumn(c, F.col("sst"))
    query = X.write_updates(X.resample_stream(readings, "1d", ["cell"]), f"file://{tmp_path}/rows", f"file://{tmp_path}/log")
    query.awaitTermination()
    got = {r.window_start.day: (r.observation_count, r.sst_celsius) for r in X.newest(spark, f"file://{tmp_path}/rows", ["cell", "window_start"]).collect()}
    assert got == {1: (1, 1.0), 2: (1, 2.0), 6: (3, 5.0)}  # the row of the first day came when its window was closed
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1
