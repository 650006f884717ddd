"""Ranked lexical search the other way round: the items are indexed, the documents stream past.

The items' terms make an inverted index (term -> items), which is broadcast in blocks of a bounded
size. Each document is reduced once, per block, to the counts of those of its terms that the block
knows. A second pass streams these counts through the index: every task keeps one heap of k
documents an item, whatever the number of its documents, and the heaps are merged in two steps, so
that no task meets all tasks' heaps of an item.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import ascii_lower, blocks_for, discard, numbered, running_start, staged, table, text_of

#: A term is a run of ASCII letters and digits and of all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for UTF-8 bytes: A-Z in lower case, a blank for each byte that ends a term.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A block of items holds this many bytes of terms (and 100 more an item) at most, or one item that has more.
BLOCK_BYTES = 16_000_000
#: Numbers that a task adds up at a time; documents in a heap's merge are dealt to so many parts an item.
CELLS, PARTS = 2_000_000, 32


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


class ItemIndex:
    """The inverted index of a block of items: the items that hold term t are items[start[t]:start[t + 1]]."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        """items: number of the item, its distinct terms."""
        self.number = np.array([n for n, _ in items], dtype=np.int64)
        self.term_id = {t.encode(): i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
        pairs = np.array(sorted((self.term_id[t.encode()], i) for i, (_, ts) in enumerate(items) for t in ts), dtype=np.int64).reshape(-1, 2)
        self.items = pairs[:, 1]
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(self.term_id) + 1))


def item_blocks(items: DataFrame, item_row: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """One index after another, of all items that have terms."""
    held = items.select(F.col(item_row).alias("item"), F.array_distinct(F.regexp_extract_all(ascii_lower(text_of(text_col)), F.lit(TERM), 0)).alias("terms")).filter(F.size("terms") > 0)
    cost = F.aggregate("terms", F.lit(100).cast("long"), lambda n, t: n + F.octet_length(t))
    held = running_start(held.withColumn("_all", F.lit(0)).withColumn("_cost", cost), ["_all"], ["item"], "_cost", blocks_for(items.count()), "_start")
    held = staged(held.select("item", "terms", F.floor(F.col("_start") / block_bytes).alias("block")), "items")
    for block in range((held.agg(F.max("block")).first()[0] or 0) + 1):
        rows = held.filter(F.col("block") == block).select("item", "terms").collect()  # bounded by block_bytes
        if rows:
            yield ItemIndex([tuple(r) for r in rows])
    discard(held)


def term_counts(docs: DataFrame, index: ItemIndex) -> DataFrame:
    """docs: doc_id, text (binary) -> doc_id, n (all terms), term and tf (arrays: the index's terms that occur)."""
    shared = docs.sparkSession.sparkContext.broadcast(index.term_id)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, term, tf = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                counts = Counter(words)
                hits = sorted((known[t], counts[t]) for t in counts.keys() & known.keys())
                n.append(len(words))
                term.append([h[0] for h in hits])
                tf.append([h[1] for h in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>")


def term_weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2 * df + 1)))


class Heaps:
    """The k best documents of each item, best by score, then by the smaller identifier."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        #: What a document has to beat: an item's k-th score and that document's identifier.
        self.score, self.doc = np.zeros(items, dtype=np.int64), np.full(items, np.iinfo(np.int64).min)

    def update(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        """scores: documents by items. Documents without an identifier (not known) come after those with one."""
        better = (scores > self.score) | ((scores == self.score) & (docs[:, None] < self.doc))
        for d, i in zip(*map(np.ndarray.tolist, np.nonzero(better))):
            heap, entry = self.heaps[i], (int(scores[d, i]), bool(known[d]), -int(docs[d]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.score[i], self.doc[i] = heap[0][0], -heap[0][2]


def best_of_tasks(counts: DataFrame, index: ItemIndex, weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each item in every task."""
    shared = counts.sparkSession.sparkContext.broadcast((index.number, index.items, index.start, weights))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, items, start, weight = shared.value
        heaps = Heaps(len(number), k)
        step = max(1, CELLS // len(number))
        width = np.diff(start)
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            docs = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            m = np.array([10 + 90 * n * documents // max(1, total) for n in batch.column(1).to_pylist()], dtype=np.int64)
            for at in range(0, len(docs), step):
                to = min(len(docs), at + step)
                lo, hi = int(ends[at] - sizes[at]), int(ends[to - 1])
                scores = np.zeros((to - at) * len(number), dtype=np.int64)
                doc = np.repeat(np.arange(to - at), sizes[at:to])
                part = weight[term[lo:hi]] * (10**9 * tf[lo:hi] // (1000 * tf[lo:hi] + 8 * m[at + doc]))
                wide = width[term[lo:hi]]
                for a in range(0, hi - lo, step):  # so many terms meet step * items postings at most
                    w = wide[a : a + step]
                    each = np.repeat(np.arange(a, a + len(w)), w)
                    first = start[term[lo:hi][a : a + step]]
                    posting = np.arange(len(each)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first, w)
                    np.add.at(scores, doc[each] * len(number) + items[posting], part[each])
                heaps.update(scores.reshape(to - at, -1), docs[at:to], known[at:to])
        rows = [(int(number[i]), -doc if known else None, score) for i, heap in enumerate(heaps.heaps) for score, known, doc in heap]
        item, doc_id, score = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc_id, score)], ["item", "doc_id", "score"])

    return counts.mapInArrow(stream, "item long, doc_id long, score long")


def merged_heaps(heaps: DataFrame, k: int, parts: int = PARTS) -> DataFrame:
    """item, doc_id, score, rank: the k best of all heaps of an item, first within `parts` parts."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = heaps.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*by))).filter(F.col("rank") <= k)
    return some.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= k)


def search_items(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every item the k documents of the highest score above 0: item_id, rank, doc_id, score.

    The score is a sum over the terms that item and document share: the term's weight,
    floor(1000 * ln((2N + 2) / (2df + 1))), times (10^9 tf) div (1000 tf + 8m), m being 10 plus
    (90 n N) div L, for N documents with terms, L terms in all of them and n in this one. Equal scores
    go by ascending doc_id, null ones last. Rows are documents and items, each its own, repeated
    identifiers included: each item's row has its ranking. Null, empty and termless texts match
    nothing and count in neither N nor L; texts may be of any length; empty tables give an empty
    result; other columns, of whatever names, are ignored. Items are searched in blocks (BLOCK_BYTES),
    each of which reads all documents.
    """
    rows, item_row = numbered(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "search_items")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    spark, found, sums = docs.sparkSession, None, None
    for index in item_blocks(rows, item_row, "text", block_bytes):
        counts = staged(term_counts(texts, index), "term_counts")
        if sums is None:
            sums = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0).cast("long"))).first()
        weights = np.zeros(len(index.term_id), dtype=np.int64)
        df = counts.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        for t, w in df.select("t", term_weight(F.col("df"), sums[0])).collect():  # the block's terms
            weights[t] = w
        best = staged(merged_heaps(best_of_tasks(counts, index, weights, *sums, k), k), "best_documents")
        discard(counts)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    return found.join(rows.withColumnRenamed(item_row, "item"), "item").select("item_id", "rank", "doc_id", "score")


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL11 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s WHERE term IN (SELECT term FROM q) GROUP BY term, nn),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN w USING (term) JOIN c USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
