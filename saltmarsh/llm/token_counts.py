"""Token counts as delta-maintained rollups.

Changes to documents are signed count rows (+1 document and its tokens, or -1 and minus its
tokens); a revised count is one of each. A batch is reduced to one row per source, language and
tokenizer version and committed under its identifier; totals are the sums over a snapshot and the
batches committed since. Committing a batch again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import n_words, shared_dir, staged, table, text_of
from saltmarsh.llm.packing import byte_bpe, tokenizer_path

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def bpe_counts(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs without the text, + tokens: how many ids the vocabulary file gives. Null text: 0."""
    path = path or tokenizer_path()
    kept = [c for c in docs.columns if c != text_col]
    out = docs.select(*kept, text_of(text_col).alias(text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        for batch in batches:
            tokens = [len(encode(t.as_py())) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.int64())], [*kept, "tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes[:-1])
    return out.mapInArrow(count, f"{schema}{', ' * bool(schema)}tokens long")


def inserted(counts: DataFrame, tokenizer: str) -> DataFrame:
    """counts: source, lang, tokens -> signed rows."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.col("tokens").cast("long").alias("n_tokens"))


def deleted(counts: DataFrame, tokenizer: str) -> DataFrame:
    return inserted(counts, tokenizer).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revised(old: DataFrame, old_tokenizer: str, new: DataFrame, new_tokenizer: str) -> DataFrame:
    """The old counts go, the new ones come."""
    return deleted(old, old_tokenizer).unionByName(inserted(new, new_tokenizer))


class Rollup:
    """Totals in a folder: batch=<id> folders of committed batches, snapshot=<n> folders with the sums of
    all batches up to one time.

    A batch or snapshot is written beside the others and moved to its final name in one step, which
    fails if the name is taken: of two writers of one batch one commits, and a crash before the move
    leaves nothing that totals() reads. A batch's folder stays as the mark that it was committed, also
    when compact() has emptied it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(conf)
        self.files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), conf)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, kind: str) -> list[str]:
        """What comes after `kind`= in the folders' names."""
        if not self.fs.exists(self._at("")):
            return []
        return [n.split("=", 1)[1] for n in (s.getPath().getName() for s in self.fs.listStatus(self._at(""))) if n.startswith(f"{kind}=")]

    def _move(self, draft: str, name: str) -> bool:
        """False if the name is taken; anything else that goes wrong raises."""
        none = self.spark._sc._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.files.rename(self._at(draft), self._at(name), none)
        except Py4JJavaError as e:
            if not self.fs.exists(self._at(name)):
                raise RuntimeError(f"{draft} could not be moved to {name}") from e
            self.fs.delete(self._at(draft), True)
            return False
        return True

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Adds a batch of signed rows once; False if it was there already."""
        if "/" in batch_id or "=" in batch_id or batch_id[:1] in ("_", "."):
            raise ValueError("a batch id is a plain name")
        if self.fs.exists(self._at(f"batch={batch_id}")):
            return False
        draft = f"_draft-{uuid.uuid4().hex}"
        # Reduced before the shuffle by partial aggregation: a hot source is a few rows a task.
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{self.path}/{draft}")
        return self._move(draft, f"batch={batch_id}")

    def _state(self) -> tuple[int, set[str], set[str]]:
        """Number of the newest snapshot (0: none), the batches in it, those after it."""
        newest = max(map(int, self._names("snapshot")), default=0)
        held = {r.batch for r in self.spark.read.parquet(f"{self.path}/snapshot={newest}/covers").collect()} if newest else set()
        return newest, held, set(self._names("batch")) - held

    def _sums(self, newest: int, since: set[str]) -> DataFrame:
        read = self.spark.read.schema(TOTALS + ", n_batches long")
        rows = self.spark.createDataFrame([], TOTALS + ", n_batches long")
        if since:
            rows = read.parquet(*[f"{self.path}/batch={b}" for b in sorted(since)]).withColumn("n_batches", F.lit(1).cast("long"))
        if newest:
            rows = rows.unionByName(read.parquet(f"{self.path}/snapshot={newest}/sums"))
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_batches")])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_batches; groups that came to nothing stay at 0."""
        newest, _, since = self._state()
        return self._sums(newest, since)

    def compact(self) -> bool:
        """Sums everything committed so far in a new snapshot, so that totals() needs no older file, and
        empties the batches that the snapshot before it held (readers of that one go on). False if
        there was nothing new or another writer was first. The names of the batches, one for each
        commit, pass through the driver."""
        newest, held, since = self._state()
        if not since:
            return False
        draft = f"_draft-{uuid.uuid4().hex}"
        self._sums(newest, since).write.parquet(f"{self.path}/{draft}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(held | since)], "batch string").coalesce(1).write.parquet(f"{self.path}/{draft}/covers")
        if not self._move(draft, f"snapshot={newest + 1}"):
            return False
        for b in held:
            for status in self.fs.listStatus(self._at(f"batch={b}")):
                self.fs.delete(status.getPath(), True)
        if newest > 1:
            self.fs.delete(self._at(f"snapshot={newest - 1}"), True)
        return True


def maintain_token_counts(docs: DataFrame, path: str, tokenizer_file: str | None = None, restore: bool = False) -> DataFrame:
    """Loads docs (doc_id, text, lang, source) by word counts, revises them to BPE counts, deletes
    copies of a text (all but the smallest doc_id), with `restore` inserts them again in a later
    batch, commits the revision a second time, and gives the totals: of the first of each text, or
    with `restore` of all documents.

    Null source and language are groups of their own; null and empty texts count 0 tokens; texts may be of
    any length; the totals count repeated rows as often as they occur, without `restore` one row of
    each text; an empty table gives no totals. Other columns, of whatever names, are ignored.
    """
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select("doc_id", "source", "lang", n_words(text).alias("words"), F.sha2(text.cast("binary"), 256).alias("sha"), "text")
    counts = staged(bpe_counts(rows, tokenizer_file), "token_counts")
    words, bpe = counts.withColumn("tokens", F.col("words")), counts
    rollup = Rollup(spark, path)
    rollup.commit("load", inserted(words, "words"))
    revision = revised(words, "words", bpe, "byte_bpe_50k")
    rollup.commit("revise", revision)
    # A row stays if it is the first of its text; copies are gone by counting, one stays per group.
    first = counts.groupBy("sha").agg(F.min(F.struct("doc_id", "source", "lang", "tokens")).alias("f")).select("f.*")
    gone = deleted(bpe, "byte_bpe_50k").unionByName(inserted(first, "byte_bpe_50k"))
    rollup.commit("drop_copies", gone)
    if restore:
        back = deleted(first, "byte_bpe_50k").unionByName(inserted(bpe, "byte_bpe_50k"))
        rollup.compact()
        rollup.commit("restore_copies", back)
    rollup.commit("revise", revision)
    return rollup.totals()


def op1_delta_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that cover every document; those by word counts come to nothing by the revision."""
    path = f"{shared_dir(spark)}/token_rollup-{uuid.uuid4().hex}"
    return maintain_token_counts(table(spark, sf_dir, "documents"), path, restore=True)
