"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - t_k): one weight vector for all thresholds t_1 < t_2 < ... . Features
are the distinct words of the whole text and their beginnings, hashed (insults are inflected; their
stems stay). Training reads a bounded sample of the labelled
documents; scoring runs where the documents are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import table, text_of

#: Labelled documents to train on at most, taken by the hash of doc_id; the size of the hash space;
#: the fewest training documents that a feature must occur in.
MAX_TRAIN, BUCKETS, MIN_DOCS = 6_000, 1 << 20, 5
GRADES = 3
TOKEN = re.compile(r"[^\W\d_]{2,}")


STEMS = (4, 5, 6, 7)


class Features:
    """Texts to hash places; remembers the words seen of late."""

    def __init__(self, size: int = 300_000):
        self.size, self.seen = size, {}

    def _of(self, word: str) -> tuple[int, ...]:
        names = [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]
        return tuple(xxhash.xxh32_intdigest(n) & (BUCKETS - 1) for n in names)

    def __call__(self, text: str) -> set[int]:
        if len(self.seen) > self.size:
            self.seen.clear()
        out: set[int] = set()
        for w in set(TOKEN.findall(text.lower())):
            places = self.seen.get(w)
            if places is None:
                places = self.seen[w] = self._of(w)
            out.update(places)
        return out


def severity_grade(quality: str = "quality", toxic: str = "toxic"):
    """0: not toxic, 1: toxic, 2: toxic in a text of low quality as well. Null without a toxic label."""
    return F.when(F.col(toxic) == 1, F.when(F.col(quality) == 0, 2).otherwise(1)).when(F.col(toxic) == 0, 0)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """grade and sparse features of a bounded sample: the labelled documents first by hash of doc_id, and of
    their rows max_train at most, however many have one doc_id. Null labels and doc_ids teach nothing;
    texts may be null, empty or of any length; other columns, of whatever names, are ignored."""
    graded = labels.select("doc_id", severity_grade().alias("grade")).filter("grade is not null and doc_id is not null")
    chosen = graded.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # max_train rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            x = [np.array(sorted(features(t.as_py())), "<i4").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(x, pa.binary())], ["doc_id", "grade", "x"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "grade", "text").mapInArrow(extract, "doc_id long, grade int, x binary")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_train)


def fit(grades: np.ndarray, rows: list[np.ndarray], n_grades: int = GRADES, min_docs: int = MIN_DOCS, l1: float = 3e-4, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS) and thresholds (n_grades - 1), by accelerated proximal gradient steps on
    centred features.

    Features in under min_docs rows keep weight 0, and so do those whose first gradient is under
    the L1 term (they don't move at first); the L1 term leaves few others.
    """
    n = len(rows)
    weights, thresholds = np.zeros(BUCKETS), np.arange(n_grades - 1.0)
    if n == 0:
        return weights, thresholds + 30.0  # nothing to learn from: every grade is 0
    above = (grades[:, None] > np.arange(n_grades - 1)).astype(float)
    share = (above.sum(0) + 0.5) / (n + 1.0)
    t = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    column = np.concatenate(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    first = np.bincount(column, (share - above).sum(1)[row], minlength=BUCKETS) / n
    mean = np.bincount(column, minlength=BUCKETS) / n
    keep = ((mean * n >= min_docs) & (np.abs(first) >= l1))[column]
    ids, column = np.unique(column[keep], return_inverse=True)
    row, mean = row[keep], mean[ids]
    forward = lambda v: np.bincount(row, v[column], minlength=n) - mean @ v
    back = lambda r: (np.bincount(column, r[row], minlength=len(ids)) - mean * r.sum()) / n
    v = np.ones(len(ids))
    for _ in range(15):  # the largest eigenvalue bounds the curvature
        v = back(forward(v / max(np.linalg.norm(v), 1e-12)))
    rate = 1.0 / (1.1 * (n_grades - 1) / 4 * max(np.linalg.norm(v), 1e-3) + 0.25)
    w, z, t_z, a = np.zeros(len(ids)), np.zeros(len(ids)), t, 1.0
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-np.clip(forward(z)[:, None] - t_z, -40, 40))) - above
        step = z - rate * back(gap.sum(1))
        w_new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        t_new = np.maximum.accumulate(t_z + rate * gap.mean(0))
        a_new = (1 + np.sqrt(1 + 4 * a * a)) / 2
        z, t_z = w_new + (a - 1) / a_new * (w_new - w), np.maximum.accumulate(t_new + (a - 1) / a_new * (t_new - t))
        w, t, a = w_new, t_new, a_new
    weights[ids] = w
    return weights, t + mean @ w


def best_cutoff(p: np.ndarray, truth: np.ndarray) -> float:
    """The probability from which calling a document toxic has the best F1; 0.5 if nothing tells."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(truth[order])
    if len(p) == 0 or hits[-1] in (0, len(p)):
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    at = int(np.flatnonzero(f1 == f1.max())[-1])
    below = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float((p[order[at]] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, thresholds and the cutoff for p_toxic. At most max_train sparse rows reach the driver;
    a fifth of them is held out from the fit and sets the cutoff."""
    sample = training_rows(docs, labels, max_train).orderBy("doc_id", "x").toArrow()
    x = [np.frombuffer(b, "<i4").astype(np.int64) for b in sample.column("x").to_pylist()]
    grades = np.array(sample.column("grade").to_pylist(), dtype=np.int64)
    held = np.arange(len(x)) % 5 == 4
    weights, thresholds = fit(grades[~held], [r for r, h in zip(x, held) if not h])
    scores = np.array([weights[r].sum() for r, h in zip(x, held) if h]) - thresholds[0]
    return weights, thresholds, best_cutoff(1 / (1 + np.exp(-np.clip(scores, -40, 40))), grades[held] > 0)


def score(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, at_least: float = 0.5) -> DataFrame:
    """doc_id, toxic, grade, expected_severity, p_toxic: one row per row of docs.

    toxic: p_toxic >= at_least. grade: the largest k with P(grade >= k) >= at_least. Null, empty and
    wordless texts have no features and get the grade of the thresholds alone; whole texts are read, of
    any length; repeated rows score alike; an empty table gives an empty one. Other columns, of
    whatever names, are ignored.
    """
    live = np.flatnonzero(weights)
    table_ = dict(zip(live.tolist(), weights[live].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            s = np.array([sum(table_[i] for i in features(t.as_py()) & table_.keys()) for t in b.column(1)], dtype=float)
            above = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds, -40, 40)))
            cols = [b.column(0), pa.array(above[:, 0] >= at_least), pa.array((above >= at_least).sum(1), pa.int32()), pa.array(above.sum(1)), pa.array(above[:, 0])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "grade", "expected_severity", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, toxic boolean, grade int, expected_severity double, p_toxic double")


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs, table(spark, sf_dir, "labels")))
