"""What the operators of this subpackage share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/saltmarsh"


#: The tables staged inside the collecting() at hand, of this thread.
_collecting: ContextVar[list[DataFrame] | None] = ContextVar("collecting", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and return the written table: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def staged(df: DataFrame, label: str) -> DataFrame:
    """As written(); collecting() hears of it."""
    out = written(df, label)
    held = _collecting.get()
    if held is not None:
        held.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no plan reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def collecting() -> Iterator[list[DataFrame]]:
    """The tables staged inside, for discard() when the results have been used."""
    tables: list[DataFrame] = []
    before = _collecting.set(tables)
    try:
        yield tables
    finally:
        _collecting.reset(before)


def reads(df: DataFrame, tables: list[DataFrame]) -> bool:
    """Whether any of the staged tables is still to be read for df."""
    names = {t.written_to.rsplit("/", 1)[-1] for t in tables}
    return any(part in names for file in df.inputFiles() for part in file.split("/"))


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written once with a number for each row, and the name of its column. Rows are told apart by
    it, whatever their identifiers."""
    row = fresh(df, "_row")
    return staged(df.withColumn(row, F.monotonically_increasing_id()), label), row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def blocks_for(rows: int, rows_per_block: int | None = None) -> int:
    """Blocks to number rows in. By default about the square root of the rows, so that neither a
    block's rows nor the list of blocks grows as fast as the table."""
    return max(1, -(-rows // (rows_per_block or max(500, math.isqrt(rows)))))


def running_start(df: DataFrame, group: list[str], order: list[str], value: str, blocks: int, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows that come before in the group.

    The order within a group is by hash block of `order`, then by `order`. A group is summed per
    block first, so no task holds a whole group, however hot; the offsets are one row per group
    and block.
    """
    df = df.withColumn("_block", block_of(F.struct(*order), blocks))
    inner = Window.partitionBy(*group, "_block").orderBy(*order)
    df = df.withColumn("_inner", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    totals = df.groupBy(*group, "_block").agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_b"), (F.sum("_total").over(across) - F.col("_total")).alias("_offset"))
    same = F.col("_block") == F.col("_b")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = df.join(totals, same, "left")
    return joined.withColumn(out, F.col("_inner") + F.col("_offset")).drop("_block", "_inner", "_offset", "_b", *[f"_g{i}" for i in range(len(group))])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
