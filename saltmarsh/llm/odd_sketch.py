"""Near duplicates by odd sketches of MinHash samples.

Each distinct shingle set gives SAMPLES min-hashes. Bands of them are codes of which similar sets
share one; all of them, each with the number of its sample, are folded into a bitmap in which a bit
is the parity of the samples that fall on it. Equal samples cancel out in the XOR of two bitmaps, so
its population count tells how many samples differ, and most exactly where few do: at the high
similarities that are looked for. Within a band the bitmaps choose the candidates; these are
confirmed on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import SPACE, numbered, staged, table, text_of
# By name: a function that runs in tasks would take the module along with it, whole.
from saltmarsh.llm.simhash import CHUNK, SEED, confirmed_rows, remixed
from saltmarsh.llm.simhash import set_marks as marks_of_sets

#: Samples, the bits they are folded into, and bands and samples in each: at a similarity of 0.8 two
#: sets share no band in 1 pair of 7 million. How far an estimate may be below the similarity for a
#: pair to be confirmed or not: five standard errors at 0.8.
SAMPLES, BITS, BANDS, BAND_ROWS, SLACK = 256, 1024, 40, 5, 0.15
MULTIPLIERS = remixed(np.array([SEED], dtype=np.uint64), np.arange(1000, 1000 + SAMPLES))[:, 0] | np.uint64(1)


def min_hashes(h: np.ndarray) -> np.ndarray:
    """SAMPLES min-hashes of a set of hashes."""
    low = np.full(SAMPLES, (1 << 64) - 1, dtype=np.uint64)
    step = max(1, CHUNK // (4 * SAMPLES))
    for at in range(0, len(h), step):
        low = np.minimum(low, (h[None, at : at + step] * MULTIPLIERS[:, None]).min(axis=1))
    return low


def odd_sketch(samples: np.ndarray) -> bytes:
    """A bit for the parity of the samples that fall on it; a sample falls by its value and number."""
    place = remixed(samples, np.arange(1))[0] ^ MULTIPLIERS
    place = remixed(place, np.arange(1))[0] % np.uint64(BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS) & 1, bitorder="little").tobytes()


def estimated_similarity(apart: int) -> float:
    """Of two sets whose odd sketches differ in `apart` bits."""
    odd = 1 - 2 * apart / BITS
    return 1 + BITS / (4 * SAMPLES) * math.log(odd) if odd > 0 else 0.0


def most_apart(similarity: float) -> int:
    """The most differing bits with an estimate of `similarity` or more."""
    return int(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def set_marks(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    samples = min_hashes(h)
    bands = samples[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in bands], dtype=np.uint64), odd_sketch(samples)


def odd_sketch_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: doc_id, n_shingles (distinct ones), component_id (the smallest doc_id
    reachable by links, its own included).

    Texts are linked if the Jaccard similarity of their sets of `shingle`-word shingles is `similarity`
    or more. A-Z is lower-cased; words are split at the six ASCII spaces; a text with fewer words than a
    shingle has its whole sequence as one; null, empty and wordless texts have none and are linked
    with nothing. Rows are told apart by a number of their own: repeated rows, rows with one id and
    several texts, and rows with a null id link others like any other; a component of null ids only
    has a null component_id. Texts may be of any length. An empty table gives an empty result; other
    columns, of whatever names, are ignored.
    """
    rows, row = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), "odd_rows")
    rows = rows.withColumnRenamed(row, "row")
    worded = F.col("text").rlike(SPACE.replace("[", "[^", 1))
    texts = rows.filter(worded).select("row", F.col("text").cast("binary").alias("text"))
    marks = staged(marks_of_sets(texts, shingle, set_marks), "odd_sketches")
    found = confirmed_rows(texts, marks, similarity, shingle, most_apart(similarity - SLACK), **settings)
    found = staged(rows.select("doc_id", "row").join(found, "row"), "odd_components")
    names = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = rows.filter(~worded).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.join(names, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op13_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = odd_sketch_components(table(spark, sf_dir, "documents"), shingle=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_distinct(w) AS w FROM (SELECT doc_id, CASE WHEN len(t) < 2 THEN t ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END AS w
 FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents))),
g AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS s FROM d),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT doc_id, len(w) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""
