"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised bytes, each partition is sorted by Spark's external
sort, and neighbours are compared in full. The sort key is the first 64 bytes, then the text's
SHA-256 (so that the splitters the driver samples stay short, however long the texts), then the id
and the row's number (so that a group of copies of any size spreads over as many partitions as it
needs, whatever its ids). A run of equal
texts that touches the first or last row of a partition may go on in the next one; such edge runs,
two per partition at most, are matched by full text afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import ascii_lower, numbered, staged, table, text_of

RUNS = "doc_id long, row long, sha string, run string, run_size long, run_id long, run_row long, edge_text binary, edge boolean"


def _marked(rows: DataFrame, keep: str) -> DataFrame:
    """rows: doc_id, row (a number of its own for each row), norm (binary) -> doc_id, row, keep_id,
    group_size, kept, text_sha256."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    sign = -1 if keep == "max" else 1

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by text; each run of equal texts is written when it ends.

        Only the identifiers of the open run are held.
        """
        task = TaskContext.get().partitionId()
        members: list[tuple] = []
        text, sha, number = None, None, -1
        done: list[tuple] = []

        def close(edge: bool) -> None:
            if not members:
                return
            best = min(members, key=lambda m: (m[0] is None, sign * (m[0] or 0), m[1]))
            done.append((list(members), sha, f"{task}.{number}", *best, text if edge else None))
            members.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                n = [len(r[0]) for r in done]
                spread = pa.array(np.repeat(np.arange(len(done)), n))
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                edges: list = [None] * int(sum(n))
                for r, at in zip(done, first):
                    edges[int(at)] = r[5]
                col = lambda k, t: pa.array([r[k] for r in done], t).take(spread)
                each = lambda k: pa.array([m[k] for r in done for m in r[0]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [each(0), each(1), col(1, pa.string()), col(2, pa.string()), pa.array(np.repeat(n, n), pa.int64()), col(3, pa.int64()), col(4, pa.int64()), pa.array(edges, pa.binary()), pa.array([r[5] is not None for r in done], pa.bool_()).take(spread)],
                    ["doc_id", "row", "sha", "run", "run_size", "run_id", "run_row", "edge_text", "edge"],
                )
                done.clear()

        for batch in batches:
            for doc_id, row, now, digest in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if now != text:
                    close(edge=number == 0)
                    text, sha, number = now, digest, number + 1
                members.append((doc_id, row))
            yield from flush()
        close(edge=True)
        yield from flush()

    rows = rows.withColumn("sha", F.sha2("norm", 256)).withColumn("head", F.substring("norm", 1, 64))
    ordered = rows.repartitionByRange("head", "sha", "doc_id", "row").sortWithinPartitions("head", "sha", "doc_id", "row")
    runs = staged(ordered.select("doc_id", "row", "norm", "sha").mapInArrow(neighbours, RUNS), "exact_runs")
    edge = runs.filter("edge and edge_text is not null").select("run", "run_size", "run_id", "run_row", "edge_text")
    best = F.min(F.struct(F.col("run_id").isNull(), sign * F.col("run_id"), "run_row", "run_id"))
    whole = edge.groupBy("edge_text").agg(F.sum("run_size").alias("group_size"), best.alias("_best"))
    whole = edge.select("run", "edge_text").join(whole, "edge_text").select("run", "group_size", F.col("_best.run_id").alias("keep_id"), F.col("_best.run_row").alias("keep_row"))
    inner = runs.filter("not edge").select("doc_id", "row", "sha", F.col("run_size").alias("group_size"), F.col("run_id").alias("keep_id"), F.col("run_row").alias("keep_row"))
    outer = runs.filter("edge").join(whole, "run").select("doc_id", "row", "sha", "group_size", "keep_id", "keep_row")
    return inner.unionByName(outer).select("doc_id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def _normalised(docs: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), ascii_lower(text_of(text_col)).cast("binary").alias("norm"))


def mark_exact_duplicates(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. keep: "min" or "max", the identifier
    that stays. Exactly one row of a group is marked kept, also if several carry the identifier
    that stays. A null text counts as empty, so all null and empty texts are one group; texts may be
    of any length. Null identifiers are chosen only if a group has no other. An empty table gives
    an empty result. Other columns, of whatever names, are ignored.
    """
    return _marked(_normalised(docs, F.monotonically_increasing_id(), id_col, text_col), keep).drop("row")


def drop_exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each text, all columns as they are; rows are told apart by
    a number of their own, so that repeated rows leave one and rows that share an identifier but not
    the text all stay. Otherwise as in mark_exact_duplicates."""
    rows, row = numbered(docs, "exact_rows")
    gone = _marked(_normalised(rows, F.col(row), id_col, text_col), keep).filter("not kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)


def op7_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


SQL7 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
 row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256 FROM d
"""
