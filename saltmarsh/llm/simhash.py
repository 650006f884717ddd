"""Near duplicates by SimHash with a hierarchical index in Gray order.

Distinct fingerprints only are compared. Two fingerprints within h bits agree on all but h of any
h + s blocks, so they meet in a bucket (a choice of s blocks and their value). In a bucket the
fingerprints are sorted by Gray rank: neighbours share long bit patterns, which are factored into
upper nodes (the bits that all members share, as pattern and mask). Pairs of nodes are descended
together; a pair whose shared bits already differ in more than h places is dropped with all its
members. A bucket gives a spanning forest of its links, never all pairs, and the forests are joined
into components by alternating star contraction.

Two kinds of links: fingerprints of shingles within a few bits (near_duplicate_components), and
texts whose sets of five-word shingles are alike (similar_components). Candidates for the latter are
texts whose fingerprints, the same ones, are within as few bits. Those alone would not do: at a
similarity of 0.8 five-word fingerprints differ in some 10 of 64 bits. So codes of several
min-hashes of the shingle set, of which such texts share one or more whatever part of them differs,
give the candidates further apart, with the same index (at no bits). A 512-bit sketch of the shingle
set leaves out the unlike ones in the bucket. That gives trees of texts that may be alike; within
each tree every link is decided by the exact similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import discard, numbered, staged, table, text_of

SEED, SHINGLE, MAX_BITS = 42, 3, 3
CHUNK = 1_000_000


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        grams = map(b" ".join, zip(*(words[at + i : to + i] for i in range(shingle))))
        codes = np.array([h(g, SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits in a long). Lower-cases A-Z; words are split at the six ASCII spaces."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py().lower().split(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


#: Bands of min-hashes and min-hashes in each: at a similarity of 0.8 two texts share a band but for
#: 1 in 2800 pairs. Rounds and bins of the shingle sketch, and how far its estimate may be
#: below the similarity for a pair to be looked at (nearly 4 standard errors at a similarity of 0.8).
BANDS, BAND_ROWS, ROUNDS, BINS, SLACK = 20, 5, 16, 32, 0.1
#: Rows of a bucket that one task compares; the rows of fuller buckets are candidates of each other
#: unseen. Rows and shingles of a tree that one task compares; larger trees are compared block by
#: block, this many rows of them (on average) in every block.
BUCKET_ROWS, UNIT_ROWS, UNIT_SHINGLES, PIVOTS = 20_000, 2048, 4_000_000, 64


def remixed(h: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """An independent hash of every h for each round: (rounds, len(h))."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * (rounds[:, None].astype(np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIERS = remixed(np.array([SEED], dtype=np.uint64), np.arange(BANDS * BAND_ROWS))[:, 0] | np.uint64(1)


def shingle_hashes(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles; fewer words than a shingle are one shingle."""
    if len(words) < shingle:
        codes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        codes = [xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in zip(*(words[i:] for i in range(shingle)))]
    return np.unique(np.array(codes, dtype=np.uint64))


def band_codes(h: np.ndarray) -> np.ndarray:
    """BANDS codes of BAND_ROWS min-hashes each of a set of hashes: two sets share a code with
    probability Jaccard ** BAND_ROWS, whichever way they differ."""
    low = np.full(len(MULTIPLIERS), (1 << 64) - 1, dtype=np.uint64)
    step = max(1, CHUNK // len(MULTIPLIERS))
    for at in range(0, len(h), step):
        low = np.minimum(low, (h[None, at : at + step] * MULTIPLIERS[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in low.reshape(BANDS, BAND_ROWS)], dtype=np.uint64)


def shingle_sketch(h: np.ndarray) -> bytes:
    """ROUNDS times BINS bits: in each round the distinct shingles are hashed anew into the bins,
    and a bin's bit is that of its smallest hash, an empty bin having its right neighbour's. Two sets
    agree in a bit with probability (1 + Jaccard) / 2. Several rounds keep the bits of short texts,
    which leave bins empty, independent."""
    edges = np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)
    bits = np.empty((ROUNDS, BINS), dtype=np.uint8)
    step = max(1, CHUNK // len(h))
    for at in range(0, ROUNDS, step):
        for r, x in enumerate(np.sort(remixed(h, np.arange(at, min(ROUNDS, at + step))), axis=1), at):
            bits[r] = x[np.searchsorted(x, edges) % len(x)] & np.uint64(1)
    return np.packbits(bits, bitorder="little").tobytes()


def gray_rank(code: Column) -> Column:
    """The place of a code in the reflected Gray order."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks (signed) of the choices of blocks - max_bits out of `blocks` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def blocks_for_size(n: int, max_bits: int = MAX_BITS, bucket: int = 4096) -> int:
    """Fewest blocks for which n evenly spread fingerprints leave `bucket` or fewer in a bucket."""
    blocks = max_bits + 1
    while blocks < 2 * max_bits + 2 and n >> (64 * (blocks - max_bits) // blocks) > bucket:
        blocks += 1
    return blocks


STEP = 4  # bits that a level of the index adds
LEVELS = 64 // STEP
PAIRS, MANY = 1 << 20, 1 << 14


def crossed(na: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For counts na, nb: the places (k, i, j) with i < na[k], j < nb[k], about PAIRS at a time."""
    total = na * nb
    for part in np.split(np.arange(len(na)), np.flatnonzero(np.diff(np.cumsum(total) // PAIRS, prepend=0))):
        if len(part) == 0:
            continue
        t = total[part]
        at = np.repeat(np.arange(len(part)), t)
        k = np.arange(len(at)) - np.repeat(np.cumsum(t) - t, t)
        width = nb[part][at]
        yield part[at], k // width, k % width


def roots(label: np.ndarray, i: np.ndarray) -> np.ndarray:
    while not np.array_equal(r := label[i], i):
        i = r
    return i


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Puts the components of i[k] and j[k] together under the first of their rows."""
    while True:
        a, b = roots(label, i), roots(label, j)
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


class GrayIndex:
    """The hierarchical index over codes that are sorted by bucket, then by Gray rank."""

    def __init__(self, bucket: np.ndarray, code: np.ndarray, max_bits: int, sketch: np.ndarray | None = None, max_apart: int = 0):
        """sketch: (n, words) of uint64; links must be within max_apart of its bits as well."""
        self.code, self.max_bits, self.sketch, self.max_apart = code, max_bits, sketch, max_apart
        self.label = np.arange(len(code))
        new_bucket = np.ones(len(code), dtype=bool)
        new_bucket[1:] = bucket[1:] != bucket[:-1]
        self.starts, self.all_of, self.none_of, self.first_child = [], [], [], []
        for level in range(LEVELS + 1):
            top = code >> np.uint64(64 - STEP * level) if level else np.zeros_like(code)
            new = new_bucket.copy()
            new[1:] |= top[1:] != top[:-1]
            start = np.flatnonzero(new)
            self.starts.append(start)
            # Upper nodes hold the pattern that their members share: bits set in all, bits set in none.
            self.all_of.append(np.bitwise_and.reduceat(code, start))
            self.none_of.append(~np.bitwise_or.reduceat(code, start))
        for upper, lower in zip(self.starts, self.starts[1:]):
            self.first_child.append(np.append(np.searchsorted(lower, upper), len(lower)))
        self.leaf_size = np.diff(np.append(self.starts[LEVELS], len(code)))

    def root(self, i: np.ndarray) -> np.ndarray:
        return roots(self.label, i)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Unites rows i and j, whose codes are near, where their sketches are near too."""
        keep = self.label[i] != self.label[j]
        i, j = i[keep], j[keep]
        if self.sketch is not None:
            keep = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(axis=1, dtype=np.int64) <= self.max_apart
            i, j = i[keep], j[keep]
        unite(self.label, i, j)

    def link_leaves(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compares the rows of leaves (rows of one code) a with those of b."""
        start, size = self.starts[LEVELS], self.leaf_size
        keep = np.bitwise_count(self.code[start[a]] ^ self.code[start[b]]) <= self.max_bits
        keep &= ~(self.whole[a] & self.whole[b]) | (self.label[start[a]] != self.label[start[b]])
        a, b = a[keep], b[keep]
        if self.sketch is None:  # the rows of a leaf are linked already
            self.link(start[a], start[b])
            return
        many = size[a] * size[b] > MANY
        for x, y in zip(a[many], b[many]):
            # Leaves of many rows are mostly one component: its own pairs are left out.
            i, j = np.arange(start[x], start[x] + size[x]), np.arange(start[y], start[y] + size[y])
            of_i, of_j = self.root(i), self.root(j)
            names, count = np.unique(np.concatenate([of_i, of_j]), return_counts=True)
            most = names[count.argmax()]
            for p, q in ((i[of_i != most], j), (j[of_j != most], i)):
                step = max(1, PAIRS // len(q))
                for at in range(0, len(p), step):
                    part = p[at : at + step]
                    self.link(np.repeat(part, len(q)), np.tile(q, len(part)))
        a, b = a[~many], b[~many]
        for part, i, j in crossed(size[a], size[b]):
            self.link(start[a[part]] + i, start[b[part]] + j)

    def search(self) -> np.ndarray:
        """Labels: the first member of each member's component."""
        leaf = np.repeat(self.starts[LEVELS], self.leaf_size)
        self.link(leaf, np.arange(len(leaf)))
        # Leaves that are in one component.
        self.whole = np.logical_and.reduceat(self.root(np.arange(len(leaf))) == leaf, self.starts[LEVELS])
        n = len(self.starts[0])
        work = [(0, np.arange(n), np.arange(n))]
        while work:
            level, a, b = work.pop()
            if level == LEVELS:
                self.link_leaves(a, b)
                continue
            first = self.first_child[level]
            for part, i, j in crossed(first[a + 1] - first[a], first[b + 1] - first[b]):
                pa_, pb_ = a[part], b[part]
                x, y = first[pa_] + i, first[pb_] + j
                keep = (pa_ != pb_) | (x <= y)
                x, y = x[keep], y[keep]
                all_of, none_of = self.all_of[level + 1], self.none_of[level + 1]
                apart = np.bitwise_count((all_of[x] & none_of[y]) | (none_of[x] & all_of[y]))
                keep = apart <= self.max_bits
                if len(x) and keep.any():
                    work.append((level + 1, x[keep], y[keep]))
        return self.root(np.arange(len(self.code)))


def bucket_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, max_apart: int = 0, bucket_rows: int | None = None) -> DataFrame:
    """fps: fp, rep -> links (a, b), a > b, between reps: a spanning forest per bucket.

    fps may have `kind`, an int (only fingerprints of one kind are compared), and `sketch`, a
    binary of fixed length (only rows within max_apart bits of it are linked). The rows of a bucket
    of more than bucket_rows are not compared but linked to one of them, near or not.
    """
    sketched = "sketch" in fps.columns
    if "kind" not in fps.columns:
        fps = fps.withColumn("kind", F.lit(0))
    masks = block_masks(blocks or max_bits + 1, max_bits)
    rows = fps.withColumn("slot", F.explode(F.sequence(F.col("kind") * len(masks), F.col("kind") * len(masks) + len(masks) - 1))).drop("kind")
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("slot") % len(masks) + 1))
    stars = None
    if bucket_rows is not None:
        hot = staged(rows.groupBy("slot", key.alias("key")).agg(F.count("*").alias("_n"), F.min("rep").alias("hub")).filter(F.col("_n") > bucket_rows).select("slot", "key", "hub"), "hot_buckets")
        if not hot.isEmpty():
            rows = rows.withColumn("key", key)
            stars = rows.join(hot, ["slot", "key"]).filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
            rows = rows.join(hot, ["slot", "key"], "left_anti").drop("key")
    # Key and rank are worked out on either side of the shuffle rather than carried through it.
    # Signed order would put the upper half of the ranks first.
    rows = rows.repartition("slot", key).withColumn("key", key).withColumn("gray", gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63))))
    rows = rows.sortWithinPartitions("slot", "key", "gray").select("slot", "key", "fp", "rep", *["sketch"] * sketched)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            code, rep = np.ascontiguousarray(rows[:, 2]).view(np.uint64), rows[:, 3]
            sketch = np.ascontiguousarray(rows[:, 4:]).view(np.uint64) if sketched else None
            label = GrayIndex(np.cumsum(new), code, max_bits, sketch, max_apart).search()
            low = rep[label]  # the smallest rep of each component
            np.minimum.at(low, label, rep)
            low = low[label]
            out = rep != low
            return pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(low[out])], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]]
            if sketched and len(batch):
                cols.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int64).reshape(len(batch), -1))
            held.append(np.column_stack(cols))
            size += len(held[-1])
            if size >= 100_000:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
                whole = last[-1] + 1 if len(last) else 0  # the last bucket may go on
                if whole:
                    yield solve(rows[:whole])
                held, size = [rows[whole:]], len(rows) - whole
        if size:
            yield solve(np.concatenate(held))

    found = rows.mapInArrow(links, "a long, b long")
    return found if stars is None else found.unionByName(stars)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, root): the smallest node reachable, for every node with a link.

    Alternating large-star and small-star steps on tables in the shared folder; ends when a round
    changes nothing.
    """
    old = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = old.unionByName(old.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = staged(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.filter("a <> b").distinct(), "small_star")
        discard(old, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, old = now, edges
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicate_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id reachable by links).

    Null texts count as empty; texts without words share fingerprint 0, which is linked like any
    other. Texts with fewer words than a shingle are one shingle. Repeated rows and ties fall on one
    fingerprint. Rows with a null id get the component of their fingerprint. An empty table gives an
    empty one. Other columns are ignored.
    """
    fps = staged(with_fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct_fps")
    # A fingerprint stands for itself, so that those of rows without an identifier link others too.
    links = bucket_links(distinct.select("fp", F.col("fp").alias("rep")), max_bits, blocks or blocks_for_size(distinct.count(), max_bits))
    found = distinct.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    found = staged(found, "fp_roots")
    names = found.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(found.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of the sorted sets i[k] and j[k] is `similarity` or more; i is sorted."""
    common = np.empty(len(i), np.int64)
    size = np.array([len(x) for x in sets])
    edge = np.flatnonzero(np.diff(i, prepend=-1))
    for at, to in zip(edge, np.append(edge[1:], len(i))):
        x = sets[i[at]]
        step = max(1, 4 * CHUNK // max(1, int(size[j[at:to]].max())))
        for k in range(at, to, step):
            others = j[k : min(to, k + step)]
            y = np.concatenate([sets[o] for o in others])
            hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            common[k : k + len(others)] = np.add.reduceat(hit, np.cumsum(size[others]) - size[others], dtype=np.int64)
    return common + 1e-9 >= similarity * (size[i] + size[j] - common)


def exact_links(label: np.ndarray, side: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], similarity: float, max_apart: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of different labels (and sides, but for side -1): pairs
    within max_apart bits of the sketch, the nearest first, are compared by their sets unless links
    found before connect them."""
    m, made = len(sets), []
    _, first, at = np.unique(label, return_index=True, return_inverse=True)
    label = first[at.reshape(-1)]
    near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, PAIRS // m)
    for lo in range(0, m, step):
        i, j = np.nonzero(np.arange(m)[None, :] > np.arange(lo, min(m, lo + step))[:, None])
        i += lo
        keep = (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        apart = np.zeros(len(i), np.int16)
        for word in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[i, word] ^ sketch[j, word])
        keep = apart <= max_apart
        near.append((i[keep].astype(np.int32), j[keep].astype(np.int32), apart[keep]))
    i, j, apart = (np.concatenate(x) for x in zip(*near))
    order = np.argsort(apart, kind="stable")
    i, j, at, width = i[order], j[order], 0, m
    while at < len(i):
        a, b = i[at : at + width].astype(np.int64), j[at : at + width].astype(np.int64)
        at, width = at + width, min(2 * width, 16 * m)
        keep = roots(label, a) != roots(label, b)
        order = np.argsort(a[keep], kind="stable")
        a, b = a[keep][order], b[keep][order]
        if len(a):
            yes = alike(sets, a, b, similarity)
            made.append((a[yes], b[yes]))
            unite(label, *made[-1])
    return tuple(np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, np.int64),) * 2


def tree_links(units: DataFrame, similarity: float, shingle: int, max_apart: int) -> DataFrame:
    """units: unit (anything that sorts), rep, label, side, sketch, text (binary) -> links (a, b) between
    reps of a unit, by the exact similarity of their shingle sets."""
    rows = units.repartition("unit").sortWithinPartitions("unit").select("unit", "rep", "label", "side", "sketch", "text")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solve() -> pa.RecordBatch:
            rep = np.array([r[0] for r in held])
            sketch = np.frombuffer(b"".join(r[3] for r in held), np.uint64).reshape(len(held), -1)
            sets = [shingle_hashes(r[4].lower().split(), shingle) for r in held]
            i, j = exact_links(np.array([r[1] for r in held]), np.array([r[2] for r in held]), sketch, sets, similarity, max_apart)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[i], rep[j])), pa.array(np.minimum(rep[i], rep[j]))], ["a", "b"])

        for batch in batches:
            for unit, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if unit != now and held:
                    yield solve()
                    held = []
                now = unit
                held.append(row)
        if held:
            yield solve()

    return rows.mapInArrow(links, "a long, b long")


def candidate_trees(each: DataFrame, max_apart: int, bucket_rows: int = BUCKET_ROWS, prints: DataFrame | None = None) -> DataFrame:
    """each: rep, sketch, kind, fp; prints: rep, sketch, fp -> (rep, tree) for the rows that may be like
    others: texts of one bucket that are within max_apart bits of the sketch, and those of `prints`
    within MAX_BITS of the fingerprint too, are in one tree, and all texts of a bucket that is too
    full for one task to compare."""
    links = bucket_links(each, 0, 1, max_apart, bucket_rows)
    if prints is not None:
        links = bucket_links(prints, MAX_BITS, blocks_for_size(prints.count()), max_apart, bucket_rows).unionByName(links)
    found = components(links)
    return found.select(F.col("node").alias("rep"), F.col("root").alias("tree")).unionByName(found.select(F.col("root").alias("rep"), F.col("root").alias("tree")).distinct())


def _set_marks(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    return band_codes(h), shingle_sketch(h)


def set_marks(rows: DataFrame, shingle: int, marks: Callable[[np.ndarray], tuple[np.ndarray, bytes]], fingerprints: bool = False) -> DataFrame:
    """rows: row, text (binary) -> row, n (distinct shingles), fps (codes of which similar sets share
    one), sketch, same (a digest of the set) and, if asked for, the text's fingerprint."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints = [], []
            for t in batch.column(1):
                words = t.as_py().lower().split()
                sets.append(shingle_hashes(words, shingle))
                if fingerprints:
                    prints.append(fingerprint(words))
            made = [marks(h) for h in sets]
            fps, same = [c.view(np.int64).tolist() for c, _ in made], [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            cols = [batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array([s for _, s in made], pa.binary()), pa.array(same, pa.binary())]
            if fingerprints:
                cols.append(pa.array(np.array(prints, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(cols, ["row", "n", "fps", "sketch", "same", "fingerprint"][: len(cols)])

    return rows.mapInArrow(compute, "row long, n long, fps array<long>, sketch binary, same binary" + ", fingerprint long" * fingerprints)


def _similar_rows(rows: DataFrame, similarity: float, shingle: int, unit_rows: int = UNIT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows: row, text (binary) -> (row, root) for all rows, root being the smallest row reachable."""
    max_apart = int(ROUNDS * BINS * (1 - similarity + SLACK) / 2)
    marks = staged(set_marks(rows, shingle, _set_marks, fingerprints=True), "sketches")
    return confirmed_rows(rows, marks, similarity, shingle, max_apart, unit_rows, bucket_rows).select("row", "root")


def confirmed_rows(rows: DataFrame, marks: DataFrame, similarity: float, shingle: int, max_apart: int, unit_rows: int = UNIT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows: row, text (binary); marks: theirs, as set_marks gives them -> (row, n, root) for all rows,
    root being the smallest row reachable. Pairs whose sketches are within max_apart bits and that
    share a code, or have fingerprints within MAX_BITS where marks has these, are candidates; links are
    decided by the whole sets."""
    distinct = staged(marks.groupBy("same", "fps", "sketch").agg(F.min("row").alias("rep"), F.max("n").alias("n")), "distinct_sketches")
    each = distinct.select("rep", F.posexplode("fps").alias("kind", "fp"))
    # A code that only one set has is in no pair.
    each = each.withColumn("_n", F.count("*").over(Window.partitionBy("kind", "fp"))).filter("_n > 1").drop("_n").join(distinct.select("rep", "sketch"), "rep")
    prints = None
    if "fingerprint" in marks.columns:
        # Texts with one set may have several fingerprints, which count repeats: all of them lead to it.
        prints = marks.select("same", F.col("fingerprint").alias("fp")).distinct().join(distinct.select("same", "rep", "sketch"), "same")
        prints = staged(prints.select("fp", "rep", "sketch"), "set_fingerprints")
    trees = candidate_trees(staged(each, "shared_codes"), max_apart, bucket_rows, prints).join(distinct.select("rep", "n", "sketch"), "rep")
    trees = staged(trees.join(rows.withColumnRenamed("row", "rep"), "rep"), "trees")

    # A unit is what one task compares: a tree, or a block of a large one with the tree's pivots,
    # which mostly connect the blocks.
    size = trees.groupBy("tree").agg(F.count("*").alias("_rows"), F.sum("n").alias("_n"))
    size = staged(size.select("tree", "_rows", F.ceil(F.greatest(F.col("_rows") / unit_rows, F.col("_n") / UNIT_SHINGLES)).cast("int").alias("_blocks")), "tree_sizes")
    block = lambda blocks: F.pmod(F.xxhash64("rep"), blocks).cast("int")
    sized = trees.join(size, "tree")
    pivot = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.col("_rows")) < PIVOTS
    blocks = F.when(pivot & (F.col("_blocks") > 1), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(block(F.col("_blocks"))))
    units = sized.withColumn("_b", F.explode(blocks)).select(F.struct("tree", "_b").alias("unit"), "rep", F.col("rep").alias("label"), F.lit(-1).alias("side"), "sketch", "text")
    found = staged(components(tree_links(units, similarity, shingle, max_apart)), "tree_roots")
    large = staged(size.filter("_blocks > 1").select("tree"), "large_trees")
    if not large.isEmpty():
        # Blocks of a large tree across each other: rows of its main component need not meet again,
        # so they meet only the others, and the others meet themselves.
        known = trees.join(large, "tree").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")
        known = staged(known, "known_labels")
        count = known.groupBy("tree", "label").agg(F.count("*").alias("_n"), F.sum("n").alias("_s"))
        parts = count.groupBy("tree").agg(F.max(F.struct("_n", "_s", "label")).alias("_main"), F.sum("_n").alias("_rows"), F.sum("_s").alias("_all"))
        per = lambda n, s: F.greatest(F.lit(1), F.ceil(F.greatest(2 * n / unit_rows, 2 * s / UNIT_SHINGLES))).cast("int")
        parts = staged(parts.select("tree", F.col("_main.label").alias("_main"), per(F.col("_main._n"), F.col("_main._s")).alias("_mains"), per(F.col("_rows") - F.col("_main._n"), F.col("_all") - F.col("_main._s")).alias("_others")), "tree_parts")
        known = known.join(parts, "tree").withColumn("_is_main", F.col("label") == F.col("_main"))
        mine = F.when(F.col("_is_main"), block(F.col("_mains"))).otherwise(block(F.col("_others")))
        others, mains = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("_others", "_mains"))
        pair = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
        at = F.col("_at")
        to_others = F.transform(others, lambda o: pair("across", at, o, F.lit(0)))
        to_mains = F.transform(mains, lambda g: pair("across", g, at, F.lit(1)))
        among = F.transform(others, lambda o: pair("among", F.least(o, at), F.greatest(o, at), F.when(o == at, -1).otherwise((o < at).cast("int"))))
        meets = F.when(F.col("_is_main"), to_others).otherwise(F.concat(to_mains, among))
        again = known.withColumn("_at", mine).withColumn("_u", F.explode(meets))
        # A block meets itself in one unit, in which no sides are told apart.
        again = again.select(F.struct("tree", "_u.kind", "_u.a", "_u.b").alias("unit"), "rep", "label", F.col("_u.side").alias("side"), "sketch", "text")
        links = tree_links(again, similarity, shingle, max_apart)
        found = components(links.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    roots_ = distinct.join(found, distinct["rep"] == found["node"], "left").select("same", F.coalesce("root", "rep").alias("root"))
    return staged(marks.join(roots_, "same").select("row", "n", "root"), "row_roots")


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: doc_id, component_id (the smallest doc_id reachable by links).

    Texts are linked if the Jaccard similarity of their sets of `shingle`-word shingles is
    `similarity` or more; pairs are looked at that links or likely links lead from one to the other
    (texts whose fingerprints are within MAX_BITS or that share the code of a band of min-hashes, and
    whose sketches put them at `similarity` less SLACK or more). Rows are told apart by a number of their own: rows with a null id, or with
    one id and several texts, link others like any other. Null, empty and short texts, ties and
    empty tables as in near_duplicate_components; texts without words are alike.
    """
    rows, row = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text")), "similar_rows")
    found = _similar_rows(rows.select(F.col(row).alias("row"), "text"), similarity, shingle, **settings)
    found = staged(rows.select("doc_id", F.col(row).alias("row")).join(found, "row"), "similar")
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, **settings) -> DataFrame:
    """The documents that stay, all columns as they are: of each component of similar texts the row
    with the smallest doc_id (null ones last), exactly one. Otherwise as in similar_components."""
    rows, row = numbered(docs, "near_rows")
    found = _similar_rows(rows.select(F.col(row).alias("row"), text_of().cast("binary").alias("text")), similarity, shingle, **settings)
    found = found.join(found.groupBy("root").agg(F.count("*").alias("_n")).filter("_n > 1").select("root"), "root")  # not those alone
    found = staged(found.join(rows.select(F.col(row).alias("row"), F.col("doc_id").alias("_id")), "row"), "similar")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "row")).alias("_first")).select("root", F.col("_first.row").alias("_stays"))
    gone = found.join(first, "root").filter("row <> _stays").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)


def op6_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
