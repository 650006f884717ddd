"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. What is left of a document after its full
windows is placed where it fits best; when no window fits it, the fullest is filled up with the
document's first ids and emitted. At the end of a partition its open windows are merged, and the
last partial window of each partition is merged with those of others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import staged, table, text_of

WINDOW, OPEN, END_ID, MERGE = 2048, 16, 1, 64
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, rest int"
#: The pre-tokenising pattern of the 50k byte-level vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """A text's ids under the vocabulary file of a byte-level BPE; the ids that `tokenizers` gives for it
    without adding special tokens, several times as fast. Strings of the file's added tokens are
    those tokens wherever a text has them."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = {t["content"]: t["id"] for t in told["added_tokens"]}
    # The vocabulary writes bytes as printable characters: those that are printable as themselves,
    # the others in order from U+0100 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


class OpenWindows:
    """The open windows of one partition: each is a list of pieces and its fill."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.pieces: list[list[tuple]] = []
        self.fill: list[int] = []

    def _emit(self, at: int) -> list[tuple]:
        self.fill.pop(at)
        return self.pieces.pop(at)

    def add(self, doc: int | None, start: int, ids: np.ndarray, tokens: int) -> Iterator[list[tuple]]:
        """Places a run of ids, yields windows that are full."""
        while len(ids) >= self.window:
            yield [(doc, start, ids[: self.window], tokens)]
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            fits = [(self.window - f, i) for i, f in enumerate(self.fill) if self.window - f >= len(ids)]
            if fits:
                at = min(fits)[1]
            elif len(self.fill) < self.limit:
                at = len(self.fill)
                self.pieces.append([])
                self.fill.append(0)
            else:
                at = max(range(len(self.fill)), key=lambda i: (self.fill[i], -i))
            room = self.window - self.fill[at]
            part, ids = ids[:room], ids[room:]
            self.pieces[at].append((doc, start, part, tokens))
            self.fill[at] += len(part)
            start += len(part)
            if self.fill[at] == self.window:
                yield self._emit(at)

    def merge(self) -> Iterator[list[tuple]]:
        """Pours the emptiest windows into the fullest until one at most is partial."""
        while len(self.fill) > 1:
            source = min(range(len(self.fill)), key=self.fill.__getitem__)
            target = max((i for i in range(len(self.fill)) if i != source), key=self.fill.__getitem__)
            room = self.window - self.fill[target]
            doc, start, ids, tokens = self.pieces[source].pop(0)
            part, rest = ids[:room], ids[room:]
            self.pieces[target].append((doc, start, part, tokens))
            self.fill[target] += len(part)
            self.fill[source] -= len(part)
            if len(rest):
                self.pieces[source].insert(0, (doc, start + len(part), rest, tokens))
            for at in sorted({source, target}, reverse=True):
                if self.fill[at] == self.window:
                    yield self._emit(at)
                elif not self.fill[at]:
                    self._emit(at)

    def last(self) -> Iterator[list[tuple]]:
        """What is left, cut into sequences of a power of two, which need no padding."""
        for pieces in self.pieces:
            ids = list(pieces)
            left = sum(len(p[2]) for p in ids)
            while left:
                want = 1 << (left.bit_length() - 1)
                left -= want
                out = []
                while want:
                    doc, start, part, tokens = ids.pop(0)
                    out.append((doc, start, part[:want], tokens))
                    if len(part) > want:
                        ids.insert(0, (doc, start + want, part[want:], tokens))
                    want -= len(out[-1][2])
                yield out
        self.pieces, self.fill = [], []


def _rows(windows: list[tuple[int, int, list[tuple]]]) -> dict[str, list]:
    """Columns of PIECES from (sequence_id, rest, pieces)."""
    cols: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
    for number, rest, pieces in windows:
        offset = 0
        for doc, start, ids, tokens in pieces:
            for name, v in zip(cols, (doc, start, len(ids), ids.astype("<u4").tobytes(), tokens, number, offset, rest)):
                cols[name].append(v)
            offset += len(ids)
    return cols


def pack_documents(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", merge: int = MERGE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A document is its ids and then end_id. Every id is in one piece; sequences are `window` ids
    long, but for the last few of each merge group, whose lengths are powers of two. The partitions
    of docs are packed where they are; one partial window of each is merged with those of
    `merge` - 1 others. Null text counts as empty (end_id alone); a null id stays null; repeated
    rows are packed each by itself; an empty table gives no pieces. Other columns are ignored.
    """
    path = path or tokenizer_path()
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("rest", pa.int32())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode = byte_bpe(path)
        windows, number, done, size = OpenWindows(window, open_windows), task << 32, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), end_id], dtype=np.uint32)
                for pieces in windows.add(doc, 0, ids, len(ids)):
                    done.append((number, -1, pieces))
                    number, size = number + 1, size + 1
                if size >= 500:
                    yield pa.RecordBatch.from_pydict(_rows(done), schema=arrow)
                    done, size = [], 0
        done += [(number + i, -1, p) for i, p in enumerate(windows.merge())]
        # The one partial window goes on, to be merged with those of other partitions.
        done += [(task << 32, task // merge, p) for p in windows.pieces]
        if done:
            yield pa.RecordBatch.from_pydict(_rows(done), schema=arrow)

    def pack_rest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        windows, done = OpenWindows(window, open_windows), []
        rows = rows.sort_values(["sequence_id", "offset"], kind="stable")
        for r in rows.itertuples():
            done += windows.add(None if pd.isna(r.doc_id) else int(r.doc_id), r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens)
        done += [*windows.merge()]
        done += [*windows.last()]
        first = (1 << 62) + (int(key[0]) << 32)
        out = pd.DataFrame(_rows([(first + i, -1, p) for i, p in enumerate(done)]))
        return out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = staged(rows.mapInArrow(pack, PIECES), "pieces")
    rest = pieces.filter("rest >= 0").groupBy("rest").applyInPandas(pack_rest, PIECES)
    out = pieces.filter("rest < 0").unionByName(rest).drop("rest")
    return out


def op2_bounded_space_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
