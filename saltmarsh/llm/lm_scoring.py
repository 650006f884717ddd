"""Cross-entropy difference between a target and a background language model.

Both models are word bigram models with the same vocabulary and the same smoothing, fitted to the
target documents and to all documents. A document's score is the mean over its tokens of the
background's minus the target's log probability (the target's loss minus the background's): the
lower, the more it is like the target.

P(w | h) = LAMBDA c(h, w) / c(h) + (1 - LAMBDA) P(w), with P(w) by add-alpha over the vocabulary, and
P(w) alone after a history that the model hasn't seen. The vocabulary is all words and an end mark,
which follows the last word of every text, so that the probabilities after each history sum to 1. No
count is left out, at any size of the corpus.

Counts don't pass through rows of their own: a chunk of documents sends its distinct n-grams as
sorted codes, cut into ranges, and a task adds up all chunks' counts in one range and answers each
chunk. An n-gram that occurs once needs no answer but a bit. The chunk is cut again from the same
scan and meets its answers by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import staged, table, text_of

#: Weight of the bigram's share; what is added to a word's count.
LAMBDA, ALPHA = 0.7, 0.1
#: Bytes of text in a chunk and, on average, behind the n-grams of a range of codes.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Texts are cut into words together up to so many words (or one text).
TOGETHER = 1 << 16
#: Target ids up to so many (8 bytes each) are sent to all tasks; more are joined by a shuffle.
SENT_IDS = 4_000_000
#: Marks that no word can be: before the first and after the last word of a text.
START, END = b"\t", b"\n"
#: Bits of a code: collisions are one in some 30,000 codes for ten billion different n-grams.
BITS = 48


class WordCodes:
    """Words to 64-bit hashes; remembers the words seen of late."""

    def __init__(self, size: int = 200_000):
        self.size, self.seen = size, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.size:
            seen.clear()
        out = list(map(seen.get, words))
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    out[i] = seen[w] = xxhash.xxh64_intdigest(w)
        return np.array(out, dtype=np.uint64)


def bigram_codes(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A code of BITS bits for each word after another."""
    with np.errstate(over="ignore"):
        mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (codes * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(64 - BITS)


def _codes_of_texts(texts: list[bytes], codes_of: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the words of all texts on end, each text that has words ending with END, and how many
    words each has. A-Z count as a-z."""
    found, words, sizes = [np.zeros(0, np.uint64)], [], []
    for text in texts:
        more = text.lower().split()
        sizes.append(len(more))
        if more:
            words += more
            words.append(END)
        if len(words) >= TOGETHER:
            found.append(codes_of(words))
            words = []
    if words:
        found.append(codes_of(words))
    return np.concatenate(found), np.array(sizes, np.int64)


class Ngrams:
    """The n-grams of a chunk: for kind 0 (words) and 1 (bigrams) the sorted codes, how often each occurs
    in the chunk and in its target texts, and the place of each token's n-gram among them."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray, codes_of: WordCodes):
        words, self.sizes = _codes_of_texts(texts, codes_of)
        self.spans = self.sizes + (self.sizes > 0)
        self.first = (np.cumsum(self.spans) - self.spans)[self.sizes > 0]
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.first] = codes_of([START])[0]
        flag = np.repeat(wanted, self.spans)
        self.codes, self.place, self.n, self.t = [], [], [], []
        for codes in (words >> np.uint64(64 - BITS), bigram_codes(words, before)):
            one, at, n = np.unique(codes, return_inverse=True, return_counts=True)
            self.codes.append(one)
            self.place.append(at)
            self.n.append(n.astype(np.int64))
            self.t.append(np.bincount(at, flag, len(one)).astype(np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(number, rows) of a partition's chunks: rows in their order, up to CHUNK_BYTES of the last column."""
    number, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            size += len(row[-1])
            if size >= CHUNK_BYTES:
                yield number, rows
                number, rows, size = number + 1, [], 0
    if rows:
        yield number, rows


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)


SENT = "kind int, part int, chunk long, size long, codes binary, n binary, t binary"
ANSWER = "kind int, part int, chunk long, size long, often binary, n binary, t binary, sum_n long, sum_t long"


def sent_ngrams(rows: DataFrame, ranges: int) -> DataFrame:
    """rows: target, text (binary) -> a row per chunk, kind and range of codes that it has any of."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of = WordCodes()
        edges = np.array([(i << BITS) // ranges for i in range(1, ranges)], np.uint64)
        for number, chunk in _chunks(batches):
            grams = Ngrams([r[1] for r in chunk], np.array([r[0] for r in chunk], bool), codes_of)
            cols: list[list] = [[] for _ in range(7)]
            for kind, (codes, n, t) in enumerate(zip(grams.codes, grams.n, grams.t)):
                cut = np.concatenate([[0], np.searchsorted(codes, edges), [len(codes)]])
                raw = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
                for part in np.flatnonzero(np.diff(cut)):
                    at = slice(cut[part], cut[part + 1])
                    for col, v in zip(cols, (kind, part, number, cut[part + 1] - cut[part], raw[at].tobytes(), _pack(n[at]), _pack(t[at]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3))], [c.split()[0] for c in SENT.split(", ")])

    return rows.select("target", "text").mapInArrow(send, SENT)


def added_up(sent: DataFrame) -> DataFrame:
    """Answers: per chunk, kind and range which of its codes occur more than once in all, and the counts of
    those; per kind and range (chunk -1) the number of codes and the sums of their counts."""
    names = [c.split()[0] for c in ANSWER.split(", ")]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve() -> pa.RecordBatch:
            kind, part = held[0][:2]
            sizes = [r[3] for r in held]
            raw = np.zeros((sum(sizes), 8), np.uint8)
            raw[:, : BITS // 8] = np.frombuffer(b"".join(r[4] for r in held), np.uint8).reshape(-1, BITS // 8)
            _, at = np.unique(raw.view("<u8").reshape(-1), return_inverse=True)
            n, t = (np.bincount(at, np.concatenate([_unpack(r[k], "i8", r[3]) for r in held])).astype(np.int64) for k in (5, 6))
            cols: list[list] = [[kind], [part], [-1], [len(n)], [None], [None], [None], [int(n.sum())], [int(t.sum())]]
            for r, lo, hi in zip(held, np.cumsum([0, *sizes]), np.cumsum(sizes)):
                mine = at[lo:hi]
                often = n[mine] > 1
                for col, v in zip(cols, (kind, part, r[2], r[3], np.packbits(often).tobytes(), _pack(n[mine[often]]), _pack(t[mine[often]]), None, None)):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    yield solve()
                    held = []
                held.append(row)
        if held:
            yield solve()

    return sent.repartition("kind", "part").sortWithinPartitions("kind", "part", "chunk").mapInArrow(add, ANSWER)


def _answered(grams: Ngrams, kind: int, answers: list[dict]) -> np.ndarray:
    """(codes, 2): counts in all documents and in the target of a chunk's n-grams of a kind."""
    mine = sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["part"])
    if sum(a["size"] for a in mine) != len(grams.codes[kind]):
        raise RuntimeError("a chunk was cut otherwise the second time: the documents must be a table that is read the same way twice")
    counts = np.column_stack([np.ones(len(grams.codes[kind]), np.int64), grams.t[kind]])  # what occurs once, occurs here
    at = 0
    for a in mine:
        often = at + np.flatnonzero(np.unpackbits(np.frombuffer(a["often"], np.uint8), count=a["size"]))
        for k, c in enumerate("nt"):
            counts[often, k] = _unpack(a[c], "i8", len(often))
        at += a["size"]
    return counts.astype(float)


def token_losses(word: np.ndarray, history: np.ndarray, pair: np.ndarray, total: np.ndarray, vocab: int) -> np.ndarray:
    """(tokens, 2) from the counts (tokens, 2) of the words, their histories and their bigrams."""
    p = (word + ALPHA) / (total + ALPHA * vocab)
    share = np.divide(pair, history, out=np.zeros_like(p), where=history > 0)
    return -np.log(np.where(history > 0, LAMBDA * share + (1 - LAMBDA) * p, p))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """docs: doc_id, text; target_ids: doc_id of the target's documents -> doc_id, n_tokens,
    target_loss, background_loss, score. One row per row of docs.

    Words are runs between ASCII spaces, A-Z lower-cased. Null, empty and wordless texts have 0
    tokens, null losses and a null score; texts may be of any length. Ties and repeated rows score
    alike. A null doc_id is in no target. Without a target document the target model is uniform. An
    empty table gives an empty one. Other columns, of whatever names, are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    few = ids.count() <= SENT_IDS
    rows = rows.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    # Both passes must cut the same chunks: of a written table, not of rows that may come otherwise again.
    rows = staged(rows, "lm_rows")
    ranges = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // RANGE_BYTES)
    answers = staged(added_up(sent_ngrams(rows, ranges)), "lm_answers")
    whole = {r.kind: r for r in answers.filter("chunk < 0").groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("size", "sum_n", "sum_t")]).collect()}  # two rows
    total = np.array([whole[0].sum_n, whole[0].sum_t], float) if whole else np.zeros(2)
    vocab = whole[0]["size"] if whole else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _chunks(batches):
            ids_, flags, texts = zip(*chunk)
            lengths = np.array([len(t) for t in texts], np.int64)
            cols = [pa.array([number]), pa.array([ids_], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "flags", "lengths", "texts"])

    def score(key: tuple, packed: pa.Table, known: pa.Table) -> pa.Table:
        row, found = packed.to_pylist()[0], known.to_pylist()
        edges = np.cumsum([0, *row["lengths"]])
        blob = pa.decompress(row["texts"], int(edges[-1]), "zstd", asbytes=True) if edges[-1] else b""
        codes_of = WordCodes()
        grams = Ngrams([blob[a:b] for a, b in zip(edges, edges[1:])], np.array(row["flags"], bool), codes_of)
        means = np.full((len(grams.sizes), 2), np.nan)
        if len(grams.first):
            counts = _answered(grams, 0, found)
            word, pair = counts[grams.place[0]], _answered(grams, 1, found)[grams.place[1]]
            history = np.empty_like(word)
            history[1:] = word[:-1]
            ends = grams.first + grams.spans[grams.sizes > 0] - 1
            history[grams.first] = word[ends[0]]  # as many texts begin as end
            losses = token_losses(word, history, pair, total, vocab)
            losses[ends] = 0.0  # of a text's own words only
            means[grams.sizes > 0] = np.add.reduceat(losses, grams.first) / grams.sizes[grams.sizes > 0, None]
        none = np.isnan(means[:, 0])
        values = (means[:, 1], means[:, 0], means[:, 1] - means[:, 0])
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(grams.sizes), *[pa.array(v, pa.float64(), mask=none) for v in values]], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    packed = rows.select("doc_id", "target", "text").mapInArrow(pack, "chunk long, ids array<long>, flags array<boolean>, lengths array<long>, texts binary")
    return packed.groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled as of good quality and not toxic."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)
