"""A tree of places, packed along a space-filling curve, and the descent of many points through it.

Places are sorted by their Morton code and cut into leaves of LEAF rows, LEAF nodes of a level into a
node of the next: leaves are as large everywhere, however dense or empty the region. A node has the
number of its places and the box around them. All points descend at once, level by level, each with
the nodes that may still hold one of its k nearest places: a node is left out if even its nearest
corner is farther than the distance within which other nodes hold k places; in the end the k-th
distance found in its nearest leaves leaves out the others. So a point meets the places of a few
leaves, none meets all places, and a level is one join on the node's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.session import settled

#: 2 ** STEP rows in a leaf, and nodes in a node; partitions are numbered from this bit of a row's number on.
STEP, PARTITION_BIT = 5, 33
AXES = ("x", "y", "z")
#: Points that go down the tree in one task: each meets some hundred nodes or places at a time, which are sorted.
POINTS = 2048


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """_x, _y, _z of a place on the unit sphere."""
    lat, lon = F.radians(lat), F.radians(lon)
    return [(F.cos(lat) * F.cos(lon)).alias("_x"), (F.cos(lat) * F.sin(lon)).alias("_y"), F.sin(lat).alias("_z")]


def morton(columns: list[Column], low: float = -1.0, high: float = 1.0) -> Column:
    """The bits of up to three numbers between low and high in turns, 21 of each."""

    def spread(c: Column) -> Column:
        c = F.least(F.greatest(F.floor((c - low) / (high - low) * (1 << 21)), F.lit(0)), F.lit((1 << 21) - 1)).cast("long")
        for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            # A step is a function of one value, so that the expression doesn't double with every step.
            c = F.transform(F.array(c), lambda x: x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask)))[0]  # noqa: B023
        return c

    code = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        code = code.bitwiseOR(F.shiftleft(spread(c), i))
    return code


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Where the Hilbert curve over the square from -1 to 1 meets (x, y); null if either is. Unlike the Morton
    code's, its stretches are in one piece, so that boxes around them hardly overlap."""
    whole = lambda c: F.least(F.greatest(F.floor((c + 1) / 2 * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")

    def step(now: Column, bit: Column) -> Column:
        right, up = now["x"].bitwiseAND(bit) > 0, now["y"].bitwiseAND(bit) > 0
        quarter = F.when(up, F.when(right, 2).otherwise(1)).otherwise(F.when(right, 3).otherwise(0))
        # The lower quarters are mirrored; of the numbers only the bits below still count.
        turned = lambda a, b: F.when(up, now[a]).when(right, F.bitwise_not(now[b])).otherwise(now[b])
        return F.struct(turned("x", "y").alias("x"), turned("y", "x").alias("y"), (now["d"] * 4 + quarter).alias("d"))

    powers = F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(bits))])
    start = F.struct(whole(x).alias("x"), whole(y).alias("y"), F.lit(0).cast("long").alias("d"))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(powers, start, step, lambda now: now["d"]))


class PlaceTree:
    """rows: the places with `_node`, the number of their leaf. levels, the top one first: _node, _parent, _n
    and _lo_c, _hi_c for every column c of the boxes."""

    def __init__(self, places: DataFrame, order: list[Column], boxes: list[str]):
        by = {f"_by{i}": c for i, c in enumerate(order)}
        ordered = places.withColumns(by).repartitionByRange(*by).sortWithinPartitions(*by).drop(*by).withColumn("_at", F.monotonically_increasing_id())
        rows = settled(ordered, "places_in_order")
        inner = (1 << PARTITION_BIT) - 1
        top = rows.agg(F.coalesce(F.max(F.col("_at").bitwiseAND(F.lit(inner))), F.lit(0)), F.coalesce(F.max(F.shiftright("_at", PARTITION_BIT)), F.lit(0))).first()
        shifts = [*range(STEP, top[0].bit_length(), STEP), *range(PARTITION_BIT, PARTITION_BIT + max(1, top[1].bit_length()), STEP)]
        self.rows = rows.withColumn("_node", F.shiftright("_at", shifts[0])).drop("_at")
        self.boxes, self.levels = boxes, []
        below = rows.select("_at", F.lit(1).cast("long").alias("_n"), *[F.col(c).alias(f"_{s}_{c}") for c in boxes for s in ("lo", "hi")])
        for i, shift in enumerate(shifts):
            node = F.shiftright("_at", shift)
            level = below.groupBy(node.alias("_node")).agg(F.sum("_n").alias("_n"), *[F.min(f"_lo_{c}").alias(f"_lo_{c}") for c in boxes], *[F.max(f"_hi_{c}").alias(f"_hi_{c}") for c in boxes])
            parent = F.shiftright("_node", shifts[i + 1] - shift) if i + 1 < len(shifts) else F.lit(0).cast("long")
            level = level.withColumn("_parent", parent)
            level = level if i else settled(level, "tree_leaves")  # the upper levels are made of these few rows where they are used
            self.levels.insert(0, level)
            # The nodes take the place of their rows in the next level.
            below = level.withColumn("_at", F.shiftleft("_node", shift)).drop("_node", "_parent")

    def reached(self, points: DataFrame, lower: Column, upper: Column, k: int) -> DataFrame:
        """points: _row, ... (written: they are counted first) -> the points' columns with the columns of every place that may be among the k
        nearest. lower, upper: the least and the greatest distance to anything in the box; null for a
        box that holds nothing wanted, and for one that may hold things that aren't."""
        # Dealt by a number of tasks of our own: what points meet grows within a task, after the shuffle whose
        # bytes would else tell how many tasks there are.
        tasks = max(1, -(-points.count() // POINTS))
        points = points.repartition(tasks, "_row")
        mine = points.columns
        mine_only = Window.partitionBy("_row")
        held = lambda by: F.sum("_n").over(mine_only.orderBy(F.asc_nulls_last(by)).rowsBetween(Window.unboundedPreceding, 0))
        more = lambda c: c * (1 + 1e-9) + 1e-12  # noqa: E731  for rounding
        now = points.withColumn("_node", F.lit(0).cast("long")).withColumn("_reach", F.lit(float("inf")))
        for level in self.levels:
            now = now.withColumnRenamed("_node", "_parent").join(level, "_parent")
            now = now.select(*mine, "_node", "_reach", "_n", lower.alias("_lower"), upper.alias("_upper")).filter("_lower <= _reach")
            now = now.withColumn("_held", held("_upper"))
            reach = F.min(F.when(F.col("_held") >= k, F.col("_upper"))).over(mine_only)
            now = now.withColumn("_reach", F.least("_reach", more(reach))).filter("_lower <= _reach")
            now = now.select(*mine, "_node", "_reach", "_n", "_lower") if level is self.levels[-1] else now.select(*mine, "_node", "_reach")
        # The k-th distance in the nearest leaves leaves out most of the others.
        now = settled(now, "leaves_reached").repartition(tasks, "_row")
        first = now.withColumn("_held", held("_lower")).filter(F.col("_held") - F.col("_n") < k).join(self.rows, "_node")
        first = first.withColumns({f"_{side}_{c}": F.col(c) for c in self.boxes for side in ("lo", "hi")}).select("_row", upper.alias("_kth")).filter("_kth is not null")
        kth = first.withColumn("_n", F.row_number().over(mine_only.orderBy("_kth"))).filter(F.col("_n") == k).select("_row", "_kth")
        now = now.join(kth, "_row", "left").filter(F.col("_lower") <= F.least("_reach", more(F.col("_kth"))))
        return now.select(*mine, "_node").join(self.rows, "_node").drop("_node")


def gap(axis: str, at: str) -> Column:
    """How far the number `at` is from the box along an axis."""
    return F.greatest(F.col(f"_lo_{axis}") - F.col(at), F.col(at) - F.col(f"_hi_{axis}"), F.lit(0.0))


def span(axis: str, at: str) -> Column:
    """How far the farther side of the box is."""
    return F.greatest(F.col(at) - F.col(f"_lo_{axis}"), F.col(f"_hi_{axis}") - F.col(at))


def sum_of_squares(f: Callable[[str, str], Column]) -> Column:
    """Of the chord from a point on the sphere (_x, _y, _z) to a box of _px, _py, _pz."""
    return sum((f(f"_p{a}", f"_{a}") * f(f"_p{a}", f"_{a}") for a in AXES), F.lit(0.0))
