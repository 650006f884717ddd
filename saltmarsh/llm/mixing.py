"""Mixing sources to target weights with fixed-length blocks.

Each source is one long sequence of words, cut into blocks of fixed length. The blocks that a source
is to give are dealt to the output shards by a multinomial draw, so that the counts add up to the
targets and those of a shard are, given their sum, multinomial with the targets' shares. The slots
drawn of a source are numbered on from shard to shard, slot k taking the block at place k of a keyed
pseudorandom permutation of the source's block numbers (pass by pass when a source is repeated), and
blocks are joined by number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import SPACE, blocks_for, n_words, running_start, staged, table, text_of

BLOCK_WORDS = 512
#: A word and the white space before it.
SPACE_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
SHARD_BLOCKS = 4096


def in_order(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with each row's number in the order of all rows, from 0. Range partitions are numbered where
    they are; only their sizes are summed in one place."""
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "in_order")
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ranged = ranged.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part")
    return ranged.withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_id")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size -> + weight, target; one row per source.

    Sources by code point, null last, take the weights in turn and share `share` times all words.
    A target stops at cap times its source's size and the excess is shared again by weight, until
    none is above: each round is one sum over the sources.
    """
    rows = in_order(sizes, [F.col("source").isNull(), F.col("source")], "_place")
    place = F.pmod(F.col("_place"), F.lit(len(weights))) + 1
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int"))).withColumn("_cap", cap * F.col("source_size"))
    rows = staged(rows.select("source", "source_size", "weight", "_cap"), "mix_weights")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        now = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("_cap"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if now.n == n_full or not now.rest:
            break
        n_full, level = now.n, (total - (now.held or 0.0)) / now.rest
    return rows.select("source", "source_size", "weight", F.when(full, F.col("_cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def permuted(index: Column, n: Column, seed: Column, inverse: bool = False) -> Column:
    """A keyed permutation of 0..n-1 in which a place is found without a table.

    Four rounds of add-a-hash-and-reflect over the two digits of the index in base b = ceil(sqrt(n))
    form a permutation of b*b places; places at n or above walk on through it until they fall below.
    """
    b = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def rounds(x: Column) -> Column:
        hi, lo = F.floor(x / b).cast("long"), F.pmod(x, b)
        order = range(4)
        if not inverse:
            for r in order:
                hi, lo = lo, F.pmod(hi + F.pmod(F.xxhash64(seed, F.lit(r), lo), b), b)
        else:
            for r in reversed(order):
                hi, lo = F.pmod(lo - F.pmod(F.xxhash64(seed, F.lit(r), hi), b), b), hi
        return hi * b + lo

    # b*b < n + 2*sqrt(n) + 1, so under 49 places of a small n are at n or above and a walk ends after as
    # many steps. Of a larger n they are at most a share of 0.02, and a walk of w steps that all miss has
    # at most that to the power w. The walk is written as a fold over its steps.
    longest = F.when(n < 550, b * b - n).otherwise(F.lit(14).cast("long"))
    steps = F.when(longest > 0, F.sequence(F.lit(1).cast("long"), longest)).otherwise(F.array().cast("array<bigint>"))
    step = F.aggregate(steps, rounds(index), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(step)


def slots_of(size: Column, target: Column, block_words: int) -> Column:
    """How many blocks a source gives: those of whole passes, and of the last as many as the words up to the
    target may lie in."""
    target = F.floor(target).cast("long")
    per_pass = F.ceil(size / F.lit(block_words)).cast("long")
    whole, rest = F.floor(target / size).cast("long"), F.pmod(target, size)
    part = F.ceil(rest / F.lit(block_words)).cast("long") + F.when((rest > 0) & (per_pass * block_words != size), 1).otherwise(0)
    return F.when(size > 0, whole * per_pass + F.least(per_pass, part)).otherwise(F.lit(0).cast("long"))


def dealt_slots(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, slots -> source, shard, slot_start, slots: what each output shard draws of each source.

    A source's slots are drawn for some sqrt(shards) ranges of shards first and for the shards of each
    range then, from generators of their own: a task never draws for all shards.
    """
    ranges = math.isqrt(max(shards - 1, 0)) + 1
    edges = [shards * i // ranges for i in range(ranges + 1)]

    def generator(source: str | None, part: int) -> np.random.Generator:
        return np.random.default_rng([seed, xxhash.xxh64_intdigest(b"\0null" if source is None else source.encode()), part])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, slots in zip(*(c.to_pylist() for c in batch.columns)):
                n = generator(source, 0).multinomial(slots, np.diff(edges) / shards)
                yield pa.RecordBatch.from_arrays([pa.array([source] * ranges, pa.string()), pa.array(range(ranges), pa.int32()), pa.array(np.cumsum(n) - n), pa.array(n)], ["source", "part", "slot_start", "slots"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, part, start, slots in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.arange(edges[part], edges[part + 1])
                n = generator(source, part + 1).multinomial(slots, np.full(len(own), 1 / len(own)))
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(start + np.cumsum(n) - n), pa.array(n)], ["source", "shard", "slot_start", "slots"])

    parts = sources.select("source", "slots").mapInArrow(first, "source string, part int, slot_start long, slots long").filter("slots > 0")
    return parts.repartition("source", "part").mapInArrow(second, "source string, shard int, slot_start long, slots long").filter("slots > 0")


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 7, rows_per_block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc_id, source, size (+ anything) -> (rows, placed, spans).

    rows: docs as staged, with a row number `row`. placed: row, doc_id, source, size with
    source_size, target and `word_start`, the place of the first word in the source's sequence.
    spans: one row per document part that the mix takes: row, doc_id, source, shard, slot, n_pass
    (how often the source was gone through before), block, doc_start, length (words), at (where in the
    block). A document is taken at most ceil(target / size) times, so never above the cap. Null sources are
    one source, empty documents are placed and never taken, rows with one doc_id are told apart,
    an empty table gives two empty tables. The same input gives the same mix.
    """
    whole_rows = staged(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.col("size").cast("long")), "mix_rows")
    rows = whole_rows.select("row", "doc_id", "source", "size")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = staged(source_targets(per.select("source", "source_size")), "mix_targets")
    total = rows.count()
    placed = running_start(rows, ["source"], ["doc_id", "size"], "size", blocks_for(total, rows_per_block), "word_start")
    placed = placed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = staged(placed, "mix_placed")
    dealt = staged(targets.select("source", slots_of(F.col("source_size"), F.col("target"), block_words).alias("slots")), "mix_slots")
    shards = -(-(dealt.agg(F.sum("slots")).first()[0] or 0) // shard_blocks)
    drawn = dealt_slots(dealt, max(1, shards), seed)

    size, target = F.col("source_size"), F.floor("target").cast("long")
    blocks = F.ceil(size / F.lit(block_words)).cast("long")
    whole, rest = F.floor(target / size).cast("long"), F.pmod(target, size)
    tail = size - (blocks - 1) * block_words
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null")))
    first, last = F.floor(F.col("word_start") / block_words), F.floor((F.col("word_start") + F.col("size") - 1) / block_words)
    parts = placed.filter("size > 0 and target >= 1").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("word_start"), F.col("block") * block_words)
    end = F.least(F.col("word_start") + F.col("size"), (F.col("block") + 1) * block_words)
    parts = parts.select("row", "doc_id", "source", "source_size", "target", "block", (begin - F.col("word_start")).alias("doc_start"), (end - begin).alias("part"), (begin - F.col("block") * block_words).alias("at"))

    # Each block once: its place in every pass. Whole passes take it whole; in the last pass only
    # the words up to the target are taken, counted along the permutation.
    def place(n_pass: Column) -> Column:
        return permuted(F.col("block"), blocks, F.xxhash64(key, n_pass), inverse=True)

    tail_at = F.when(F.col("block") == blocks - 1, F.col("place")).otherwise(permuted(blocks - 1, blocks, F.xxhash64(key, F.col("n_pass")), inverse=True))
    each = parts.select("source", "source_size", "target", "block").distinct().repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    each = each.withColumn("n_pass", F.explode(F.sequence(F.lit(0).cast("long"), whole))).withColumn("place", place(F.col("n_pass")))
    length = F.when(F.col("block") == blocks - 1, tail).otherwise(F.lit(block_words))
    before = F.col("place") * block_words - F.when(tail_at < F.col("place"), block_words - tail).otherwise(0)
    limit = F.when(F.col("n_pass") < whole, length).otherwise(F.greatest(F.lit(0), F.least(length, rest - before)))
    each = each.withColumn("limit", limit).filter("limit > 0").withColumn("k", F.col("n_pass") * blocks + F.col("place"))
    slots = drawn.withColumn("k", F.explode(F.sequence(F.col("slot_start"), F.col("slot_start") + F.col("slots") - 1))).select(F.col("source").alias("_source"), "shard", F.col("k").alias("_k"))
    # Both sides grow with the mix, though what they are exploded from looks small: never sent whole.
    taken = each.join(slots.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("k") == F.col("_k"))).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "shard", F.col("k").alias("slot"), "n_pass", "limit")
    spans = parts.join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    spans = spans.withColumn("length", F.least(F.col("part"), F.col("limit") - F.col("at"))).filter("length > 0")
    return whole_rows, placed, spans.select("row", "doc_id", "source", "shard", "slot", "n_pass", "block", "doc_start", "length", "at")


def documents_with_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(text_of()).alias("size"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents, in its order: a row for each part of a document in each slot, the slots of a
    shard in a keyed random order, shard by shard.

    All columns of docs are carried; a document taken as a whole keeps its text, of another the part's
    words and the white space between them stay. n_chars, if there, is counted anew. Documents without
    words are never taken; texts may be of any length: a text is cut into all its parts at once.
    """
    carried = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    rows, _, spans = mix_sources(docs.select("doc_id", "source", n_words(text_of()).alias("size"), "text", carried.alias("_doc")), **settings)
    turn = F.xxhash64(F.lit(settings.get("seed", 7)), F.coalesce(F.col("source"), F.lit("\0null")), "slot")
    part = F.struct("shard", turn.alias("turn"), F.col("at"), F.col("doc_start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))
    parts = spans.select("row", part.alias("_p")).groupBy("row").agg(F.collect_list("_p").alias("_parts"))
    words = F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0))
    joined = rows.join(parts, "row").withColumn("_words", words).withColumn("_p", F.explode("_parts")).drop("_parts")
    piece = F.regexp_replace(F.concat_ws("", F.slice("_words", F.col("_p.start") + 1, F.col("_p.length"))), f"^{SPACE}", "")
    joined = joined.select("_doc", "_p", F.when(F.col("_p.length") == F.col("size"), F.col("text")).otherwise(piece).alias("text"))
    order = ["_p.shard", "_p.turn", "_p.at"]
    joined = joined.repartitionByRange(*order).sortWithinPartitions(*order)
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return joined.select(*[made[c].alias(c) if c in made else F.col("_doc")[c].alias(c) for c in docs.columns])


def op10_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed, spans = mix_sources(documents_with_sizes(table(spark, sf_dir, "documents")))
    taken = spans.groupBy("row").agg(F.sum("length").alias("taken"))
    out = placed.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
