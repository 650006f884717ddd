"""Cases of the third round's findings, on small tables of their own."""

import duckdb
from pyspark.sql import functions as F

from saltmarsh.operators import planning as L
from saltmarsh.plans import more_queries, small_queries  # noqa: F401
from saltmarsh.plans.queries import QUERIES, SQL


def both(spark, folder, name, customers, suppliers):
    """The query's rows and its SQL's over customers and suppliers (key, balance)."""
    for table, column, rows in (("customer", "c_custkey", customers), ("supplier", "s_suppkey", suppliers)):
        short = table[0]
        spark.createDataFrame(rows, f"{column} long, {short}_acctbal double").selectExpr("*", f"concat('N', {column}) AS {short}_name").coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    duck = duckdb.connect()
    for table in ("customer", "supplier"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    rel = duck.sql(SQL[name])
    order = [rel.columns.index(c) for c in df.columns]
    return sorted(tuple(r) for r in df.collect()), sorted(tuple(r[i] for i in order) for r in rel.fetchall())


def test_halves_of_a_population_go_to_the_even_number(spark, tmp_path):
    for name in ("port_city_population", "port_population_across_seam"):
        for i, (balance, population) in enumerate(((6500.5, 6500), (7401.5, 7402), (0.5, None))):
            got, want = both(spark, tmp_path / f"{name}{i}", name, [(0, balance)], [(0, 1.0)])
            assert got == want == [(0, population)]


def test_cells_of_all_days_are_resolved(spark, tmp_path):
    got, want = both(spark, tmp_path, "resolved_cells", [(0, 5.0)], [(0, 1.0)])
    assert got == want == [(0, -80.0, -180.0, 0.0)]


def test_cells_tried_for_a_point_are_not_rows(spark):
    """No task sorts or holds a row for each of the 81 cells around a point."""
    points = spark.range(2000).select("id", (F.col("id") % 170 - 85.0).alias("latitude"), (F.col("id") * 7 % 360 - 180.0).alias("longitude"))
    found = L.nearest_ocean(points, spark.createDataFrame([(c,) for c in range(0, 64_800, 1013)], "cell_id int"), "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "min(struct" not in plan
    assert found.count() == 2000


def test_points_go_down_the_tree_in_tasks_of_bounded_size(spark, monkeypatch):
    """However few bytes the points have: a point meets many nodes, all in one task."""
    from saltmarsh.operators import places as P
    from saltmarsh.operators import space

    monkeypatch.setattr(space, "POINTS", 50, raising=False)
    reached, seen = space.PlaceTree.reached, []

    def watched(self, points, lower, upper, k):
        out = reached(self, points, lower, upper, k)
        seen.append((points.count(), max(r["count"] for r in out.select("_row").distinct().groupBy(F.spark_partition_id()).count().collect()), "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()))
        return out

    monkeypatch.setattr(space.PlaceTree, "reached", watched)
    spots = spark.range(3000).select("id", (F.col("id") * 617 % 1600 / 10 - 80).alias("latitude"), (F.col("id") * 1543 % 3600 / 10 - 180).alias("longitude"))
    assert P.nearest_places(spots.filter("id < 1000"), spots, "id", "id", 3).count() > 1000
    assert P.exact_nearest_places(spots.filter("id < 1000"), spots, "id", "id", 3).count() == 3000
    assert len(seen) == 3 and all(named for *_, named in seen)


def test_degrees_are_matched_once(spark):
    """The text of a coordinate goes through its pattern once, and gives what part by part it gave."""
    from saltmarsh.functions import scalar as S

    texts = ["12°30'36\"N", "12°30'36\"s", " 7 W", "7.5°15'E", "10 20 30 S", "-12.25", "12.25", "north", "", None, "1\u00012N", "\u00012\u00013", "95°N", "12N\n", "0°0'0\"S", "1e3", "nan", "9°N9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.dms(F.col("t")).alias("d"))
    want = [12.51, -12.51, -7.0, 7.75, -(10 + 20 / 60 + 30 / 3600), -12.25, 12.25, None, None, None, None, None, 95.0, 12.0, -0.0, 1000.0, None, None]
    got = [r["d"] for r in df.collect()]
    assert [None if g is None else round(g, 9) for g in got] == [None if w is None else round(w, 9) for w in want]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp") <= 1


def test_a_new_cell_asks_for_no_timers():
    """Calls of the state go to the JVM: a cell that begins makes one to read, one to write, one for its timer."""
    import pandas as pd

    from saltmarsh.streaming.observations import LiveCell

    called = []

    class Told:
        def __getattr__(self, name):
            return lambda *a: called.append(name) or {"exists": False, "get": None, "getValueState": self}.get(name, [])

    cell = LiveCell(["cell"], ["a", "b"], "time", 1000, None)
    cell.init(Told())
    called.clear()
    t = [pd.Timestamp(f"2024-01-01 0{h}:00") for h in (1, 2, 2, 3)]
    frames = [pd.DataFrame({"time": t, "a": [9.0, 2.0, 5.0, float("nan")], "b": [float("nan")] * 4})]
    out = pd.concat(cell.handleInputRows((7,), iter(frames), None)).values.tolist()
    assert out[0][:2] == [7, 5.0] and out[0][2] is None and out[0][3] == t[3]
    assert sorted(called) == ["get", "registerTimer", "update"]


def test_a_line_of_cities_is_split_once(spark):
    from saltmarsh.sources import readers

    line = "\t".join(["1", "Porté", "", "Sänkt", "1.5", "2.5", "", "", "xx", "", "", "", "", "", "10", "", "", "", ""])
    rows = readers.city_rows(spark.createDataFrame([(line,), ("a\tb",), (None,), ("",)], "value string"))
    assert [(r["port_id"], r["alt_names"], r["latitude"], r["population"]) for r in rows.collect()] == [("geonames:1", "Sänkt", 1.5, 10)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 1
