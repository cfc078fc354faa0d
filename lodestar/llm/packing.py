"""Packing by concatenate and cut.

Pass one tokenises every document once and stores its ids with its start within its partition. The partitions' totals,
one number each, give every partition's place in the whole (a prefix sum); pass two adds it and cuts the stream into
fixed windows. A document that a border cuts has one boundary record for each piece. Only the last window has padding.

White space never lies within a token of this tokenizer, nor does the border of an ASCII letter and ASCII punctuation
(but for the apostrophe), and it ignores case. So a text's ids are those of such pieces, in lower case, one after another;
a worker encodes each distinct piece once while its cache holds it. Words with a bar, which special tokens have, stay as they are, and so do those with a
combining mark behind a capital: the tokenizer composes characters before it lower-cases them, and some pairs compose in lower case alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from lodestar.llm import textvec as tv
from lodestar.llm.common import batch, each, stage, table

#: A task has one core; threads of the tokenizer would only wait for each other.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LENGTH, END_ID = 4096, 2
VOCABULARY = "word_bpe_49k.json"
#: A worker's cache starts anew beyond so many pieces or ids.
CACHE_PIECES, CACHE_IDS = 600_000, 4_000_000
#: Pieces encoded in one string, parted by a special token.
TOGETHER = 200
#: Bytes of text that share one look into the cache.
TEXT = 1 << 19

_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_PUNCTUATION = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in "'|" for b in range(256)])

_TOKENS = "part int, doc_id long, n long, at long, wide boolean, ids binary"


def split(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (A-Z in lower case but in words with a bar or a marked capital), start and end of each piece, and the bounds of the documents in them."""
    w, data = tv.words(c), tv.lower(c.data)
    left, right = data[:-1], data[1:]
    cut = np.flatnonzero(_LETTER[left] & _PUNCTUATION[right] | _PUNCTUATION[left] & _LETTER[right]) + 1
    cut = cut[~np.isin(cut, c.off)]
    # U+0300 to U+036F are two bytes, the first of them CC or CD
    marked = (c.data[:-1] >= 65) & (c.data[:-1] <= 90) & ((c.data[1:] == 0xCC) | (c.data[1:] == 0xCD))
    bars = np.flatnonzero((data == 124) | np.append(marked, np.zeros(min(1, len(data)), bool)))
    if len(bars):
        held = np.unique(np.searchsorted(w.start, bars, "right") - 1)
        inside = tv.ragged(w.start[held], w.end[held] - w.start[held])
        data[inside] = c.data[inside]
        cut = np.setdiff1d(cut, inside)
    start, end = np.sort(np.concatenate((w.start, cut))), np.sort(np.concatenate((w.end, cut)))
    return data, start, end, np.searchsorted(start, c.off)


class Encoder:
    """Ids of pieces, each distinct one encoded once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.reset()

    def reset(self) -> None:
        """Known pieces: their hashes in order, and where and how many the ids of each are."""
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        mark = self.mark_id
        if mark is None or any(b"|" in p for p in pieces):
            each_ = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
            return np.array([x for ids in each_ for x in ids], np.uint32), np.array([len(ids) for ids in each_], np.int64)
        between = self.mark.encode()
        joined = [between.join(pieces[k : k + TOGETHER]).decode("utf-8", "replace") for k in range(0, len(pieces), TOGETHER)]
        flat = np.concatenate([x for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for x in (np.array(e.ids, np.uint32), np.array([mark], np.uint32))])
        ends = np.flatnonzero(flat == mark)
        return flat[flat != mark], np.diff(ends, prepend=-1) - 1

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        barred = np.array([b"|" in p for p in pieces])
        for part in (np.flatnonzero(~barred), np.flatnonzero(barred)):
            if len(part):
                ids, sizes = self._ids([pieces[i] for i in part.tolist()])
                begin, at = len(self.ids) + np.cumsum(sizes) - sizes, np.searchsorted(self.keys, keys[part])
                self.keys, self.begin, self.size = np.insert(self.keys, at, keys[part]), np.insert(self.begin, at, begin), np.insert(self.size, at, sizes)
                self.ids = np.append(self.ids, ids)

    def encode(self, c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's documents, and how many each has."""
        if len(self.keys) > CACHE_PIECES or len(self.ids) > CACHE_IDS:
            self.reset()
        data, start, end, first = split(c)
        h = tv.Rolling(tv.byte_values(data)).of(start, end)
        order = np.argsort(h)
        ordered = h[order]
        new = np.concatenate((np.ones(min(1, len(h)), bool), ordered[1:] != ordered[:-1]))
        u, one = ordered[new], order[new]
        missing = ~np.isin(u, self.keys, assume_unique=True, kind="sort")
        if missing.any():
            raw, at = data.tobytes(), one[missing]
            self._learn(u[missing], [raw[x:y] for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        rows = np.empty(len(h), np.int64)
        rows[order] = np.searchsorted(self.keys, u)[np.cumsum(new) - 1]
        sizes = self.size[rows]
        total = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids[tv.ragged(self.begin[rows], sizes)], np.diff(total[first])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenise(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for c in tv.chunks(b.column("text"), TEXT):
                ids, n = encoder(path).encode(c)
                wide = max(int(ids.max(initial=0)), end_id) >= 1 << 16
                out = np.full(len(ids) + c.n, end_id, np.uint32 if wide else np.uint16)
                ends = np.cumsum(n + 1)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                starts = at + ends - (n + 1)
                offsets = np.concatenate(([0], ends)).astype(np.int64) * out.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), c.n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())
                yield batch(part=np.full(c.n, part, np.int32), doc_id=b.column("doc_id").slice(c.row, c.n), n=n + 1, at=starts, wide=np.full(c.n, wide), ids=raw)
                at += len(out)

    return run


def _cut(length: int, whole: bool) -> Callable:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, at = b["n"].to_numpy(), b["at"].to_numpy()
        pieces = (at + n - 1) // length - at // length + 1
        row = np.repeat(np.arange(len(n)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sequence = at[row] // length + k
        start = np.where(k > 0, sequence * length - at[row], 0)
        end = np.minimum((sequence + 1) * length - at[row], n[row])
        ids, wide = b["ids"], b["wide"].to_pylist()
        held, crc, cut, last = np.zeros(0, np.uint32), [], [], -1
        for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            if r != last:
                held, last = np.frombuffer(ids[r].as_buffer(), np.uint32 if wide[r] else np.uint16).astype("<u4"), r
            crc.append(zlib.crc32(held[s:e]))
            if whole:
                cut.append(held[s:e].view(np.int32))
        more = {"ids": pa.array(cut, pa.list_(pa.int32()))} if whole else {}
        yield batch(doc_id=b["doc_id"].take(pa.array(row)), start=start, length=end - start, ids_crc32=pa.array(crc, pa.int64()), doc_tokens=n[row], sequence_id=sequence, offset=(at[row] + start) % length, **more)

    return each(run)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, whole: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if whole.

    Each row of docs is a document, in the order in which the partitions hold them; a null or empty text is its end
    id alone. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = stage(own.mapInArrow(_tokenise(path, end_id), _TOKENS), "tokens")
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n")).collect())  # one row per partition of the input
    before = [0, *accumulate(n for _, n in totals)]
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "n", (F.col("at") + F.col("base")).alias("at"), "wide", "ids")
    return placed.mapInArrow(_cut(length, whole), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * whole)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: the pieces with their ids."""
    return pack(docs, whole=True)


queries = {"op10_packing": op10_packing}
oracle_sql: dict[str, str] = {}
