"""Series of any length over many tasks: ordered blocks, and what one block hands to the next.

in_order() sorts a table by its keys and order into range partitions and writes it; a series is then
a run of blocks (a partition's part of the series), each small enough for a task. What depends on
the rows before (a sum, a position, the last known value) is found within the block first; the
blocks' own results, a row a block, are then passed on from block to block, and each block's rows
take what came to theirs.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from saltmarsh.session import settled

#: A row's place in the order is its partition, shifted by so many bits, and its place in it.
PART_BIT = 33


def in_order(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rows with `_at`, a number that grows in each series with its order, and `_block`. Equal rows are in
    a fixed order once written."""
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    out = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return settled(out, "in_order").withColumn("_block", F.shiftright("_at", PART_BIT))


class Blocks:
    """Rows in blocks, and columns made from block to block. Names that begin with _ are the class's."""

    def __init__(self, rows: DataFrame, keys: list[str]):
        """rows: with _at, _block."""
        self.rows, self.keys = rows, keys
        self.inner = Window.partitionBy(*keys, "_block").orderBy("_at")
        self.back = Window.partitionBy(*keys, "_block").orderBy(F.desc("_at"))
        self.made: dict[str, tuple[Column, Column]] = {}
        self.sums: list[Column] = []
        self.across: dict[str, Column] = {}

    def _blocks_before(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def _blocks_after(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)

    def running_sum(self, name: str, value: Column) -> Column:
        """The sum of value up to the row; null where there is none yet."""
        self.sums.append(F.sum(value).alias(f"_s_{name}"))
        self.across[f"_s_{name}"] = F.sum(f"_s_{name}").over(self._blocks_before())
        mine = F.sum(value).over(self.inner.rowsBetween(Window.unboundedPreceding, 0))
        carried = F.col(f"_s_{name}")
        return F.when(carried.isNull(), mine).otherwise(carried + F.coalesce(mine, F.lit(0)))

    def last_known(self, name: str, value: Column) -> Column:
        """The last value that isn't null up to the row."""
        self.sums.append(F.max_by(value, F.when(value.isNotNull(), F.col("_at"))).alias(f"_l_{name}"))
        self.across[f"_l_{name}"] = F.last(f"_l_{name}", ignorenulls=True).over(self._blocks_before())
        return F.coalesce(F.last(value, ignorenulls=True).over(self.inner.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_l_{name}"))

    def next_known(self, name: str, value: Column) -> Column:
        """The first value that isn't null from the row on."""
        self.sums.append(F.min_by(value, F.when(value.isNotNull(), F.col("_at"))).alias(f"_n_{name}"))
        self.across[f"_n_{name}"] = F.last(f"_n_{name}", ignorenulls=True).over(self._blocks_after())
        return F.coalesce(F.last(value, ignorenulls=True).over(self.back.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_n_{name}"))

    def with_columns(self, made: dict[str, Column]) -> DataFrame:
        """The rows with columns of the expressions that running_sum, last_known and next_known gave."""
        each = self.rows.groupBy(*self.keys, "_block").agg(*self.sums)
        carried = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col("_block").alias("_b"), *[c.alias(n) for n, c in self.across.items()])
        same = F.col("_block") == F.col("_b")
        for i, k in enumerate(self.keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = self.rows.join(carried, same, "left").withColumns(made)
        return out.drop("_b", *[f"_k{i}" for i in range(len(self.keys))], *self.across)


def positions(rows: DataFrame, keys: list[str], counted: bool = False) -> DataFrame:
    """rows: as in_order() gives them -> with `_j`, the row's number in its series from 0, and, if counted, `_n`,
    the series' length, and `_series`, a number of its own."""
    each = rows.groupBy(*keys, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), *([F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"), F.min("_first").over(Window.partitionBy(*keys)).alias("_series")] if counted else []))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(each, same).withColumn("_j", F.col("_at") - F.col("_first") + F.col("_start"))
    return out.drop("_b", "_first", "_start", *[f"_k{i}" for i in range(len(keys))])


#: Rows of a chunk, if the window isn't longer.
CHUNK = 4096


def with_halo(rows: DataFrame, window: int, chunk: int | None = None) -> DataFrame:
    """rows: as positions(counted=True) gives them -> with `_chunk` and `_halo`: each series cut into chunks of
    rows, each of which also has the `window` rows before it, marked as halo."""
    size = max(chunk or CHUNK, window, 1)
    mine = F.floor(F.col("_j") / size)
    ahead = F.col("_j") % size >= size - window
    places = F.when(ahead, F.array(F.struct(mine.alias("c"), F.lit(False).alias("h")), F.struct((mine + 1).alias("c"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(mine.alias("c"), F.lit(False).alias("h"))))
    out = rows.withColumn("_p", F.explode(places)).withColumn("_chunk", F.col("_p.c")).withColumn("_halo", F.col("_p.h")).drop("_p")
    return out.repartition("_series", "_chunk").sortWithinPartitions("_series", "_chunk", "_j")


def above_trailing_quantile(rows: DataFrame, value: str, window: int, share: float, least: int, name: str) -> DataFrame:
    """rows: as with_halo() gives them -> without the halo, with `name`: whether value is above the quantile of
    the `window` rows before it, of which `least` or more have a value. The values in the window are kept in
    order from row to row: one goes in and one out."""
    schema = StructType([*rows.schema, StructField(name, BooleanType())])

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = (None, None)
        recent: deque = deque()
        held: list[float] = []
        for batch in batches:
            out = []
            for series, chunk, v in zip(*(batch.column(c).to_pylist() for c in ("_series", "_chunk", value))):
                if (series, chunk) != now:
                    now = (series, chunk)
                    recent.clear()
                    held.clear()
                above = False
                if v is not None and len(held) >= least:
                    at = (len(held) - 1) * share
                    low = math.floor(at)
                    high = min(low + 1, len(held) - 1)
                    edge = held[low] if at == low else (low + 1 - at) * held[low] + (at - low) * held[high]
                    above = v > edge
                out.append(above)
                recent.append(v)
                if v is not None:
                    insort(held, v)
                if len(recent) > window and (gone := recent.popleft()) is not None:
                    del held[bisect_left(held, gone)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, name]).filter(pc.invert(batch.column("_halo")))

    return rows.mapInArrow(slide, schema)
