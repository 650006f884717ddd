"""Shard assignment by a hierarchical weighted hash tree.

A document descends region, rack and shard levels. On each level every child draws
ln(u) / weight, u being a keyed hash of the document and the child, and the largest draw wins
(weighted rendezvous hashing, as in the straw buckets of CRUSH). A child's draw depends on that
child alone, so a change of one weight moves documents only into or out of its subtree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import blocks_for, running_start, staged, table, text_of

#: Shards in a rack, racks in a region.
RACK, REGION = 2, 2

Tree = dict[str, dict[str, dict[int, float]]]


def uniform_tree(shards: int, base: int | None = None, rack: int = RACK, region: int = REGION) -> Tree:
    """A tree of `base` equal shards (all, if None); each further one opens a region of its own.

    With a region of its own a new shard takes rows only into itself and moves none between the
    others, which a new shard inside an old rack could not promise.
    """
    base = shards if base is None else min(base, shards)
    tree: Tree = {}
    for s in range(base):
        tree.setdefault(f"region{s // (rack * region)}", {}).setdefault(f"rack{s // rack}", {})[s] = 1.0
    for s in range(base, shards):
        tree[f"added{s}"] = {f"rack_added{s}": {s: 1.0}}
    return tree


def _draw(key: Column, name: str, weight: float, seed: int) -> Column:
    """ln(u)/w with u in (0, 1) from 52 hash bits."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name), F.lit(seed)), 12).cast("double")
    return F.ln((bits + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _winner(key: Column, weights: dict[str, float], seed: int, value) -> Column:
    draws = [F.struct(_draw(key, name, w, seed).alias("d"), F.lit(name).alias("n"), value(name).alias("v")) for name, w in sorted(weights.items()) if w > 0]
    if not draws:
        raise ValueError("a subtree has no weight")
    return draws[0]["v"] if len(draws) == 1 else F.greatest(*draws)["v"]


def shard_column(key: Column, tree: Tree, seed: int = 0) -> Column:
    """The shard of a key. Weights of inner nodes are the sums of their shards' weights."""
    racks = {a: {b: sum(c.values()) for b, c in r.items()} for a, r in tree.items()}
    regions = {a: sum(r.values()) for a, r in racks.items()}

    def in_rack(a: str, b: str) -> Column:
        return _winner(key, {f"shard{s}": w for s, w in tree[a][b].items()}, seed, lambda n: F.lit(int(n[5:])))

    def in_region(a: str) -> Column:
        live = [b for b in racks[a] if racks[a][b] > 0]
        name = _winner(key, racks[a], seed, F.lit)
        out = in_rack(a, live[-1])
        for b in live[:-1]:
            out = F.when(name == b, in_rack(a, b)).otherwise(out)
        return out

    live = [a for a in regions if regions[a] > 0]
    name = _winner(key, regions, seed, F.lit)
    out = in_region(live[-1])
    for a in live[:-1]:
        out = F.when(name == a, in_region(a)).otherwise(out)
    return out


def assign_shards(docs: DataFrame, tree: Tree, key: str = "doc_id", seed: int = 0, column: str = "shard") -> DataFrame:
    """docs with the shard of each row; no shuffle. A null key is a key like any other.

    Texts may be null or empty, repeated keys share a shard, an empty table stays empty. A column
    of the name `column` is replaced.
    """
    return docs.withColumn(column, shard_column(F.col(key), tree, seed).cast("int"))


def write_shards(docs: DataFrame, path: str, tree: Tree, key: str = "doc_id", seed: int = 0, mode: str = "errorifexists") -> None:
    """Writes the documents below path/shard=N. Rows go to files from where they are, without a shuffle."""
    assign_shards(docs, tree, key, seed).write.mode(mode).partitionBy("shard").parquet(path)


def shard_slots(rows: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """Adds slot: the number of a row within its shard, gapless from 0. rows: doc_id, shard and small columns."""
    rows = staged(rows.withColumn("_one", F.lit(1).cast("long")), "shard_rows")
    blocks = blocks_for(rows.count(), rows_per_block)
    return running_start(rows, ["shard"], ["doc_id", "text_crc32"], "_one", blocks, "slot").drop("_one")


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = assign_shards(table(spark, sf_dir, "documents"), uniform_tree(8))
    docs = assign_shards(docs, uniform_tree(9, base=8), column="grown_shard")
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard")
    return shard_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
