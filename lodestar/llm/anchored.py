"""Anchored segments: how exact repeats find each other without comparing every window.

A window of W units (words or bytes) belongs to its anchor, the least hash among its k-grams. Equal windows have equal
anchors. Consecutive windows of one document with the same anchor form a segment, so a document has one segment for
every (W - k) / 2 units or so. Only segments whose anchor occurs again anywhere can hold a repeated window; equal
segments are repeats as a whole, and only what is left of distinct segments under one anchor needs a closer look.

Rows are (row, s, n, m, ah, sh): windows [s, s + n) of the document with that key, m: 2 if the anchor's gram occurs more than once within
the segment (its windows may then repeat each other) and else 1, the anchor's hash and that of the segment's content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm import textvec as tv
from lodestar.llm.common import batch, dealt_anew, each, signed

#: A null doc_id gets a key below all others, from its text.
NULL_IDS = -(2**62)


def document_key() -> Column:
    own = F.lit(NULL_IDS) - F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 2)
    return F.coalesce(F.col("doc_id").cast("long"), own).alias("id")


def real_id(column: str = "id") -> Column:
    return F.when(F.col(column) > NULL_IDS, F.col(column)).alias("doc_id")


def own_texts(docs: DataFrame) -> DataFrame:
    """(id, row, text). row tells rows with one doc_id but other texts apart, equal rows share it; a null text is empty."""
    text = F.col("text").cast("string")
    return docs.select(document_key(), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))


def segments(values: np.ndarray, first: np.ndarray, width: int, gram: int, content: bool = True) -> tuple[np.ndarray, ...]:
    """(document, start, windows, grams, anchor, content) of all segments, content only if asked for; first: bounds of the documents in values.

    Anchors whose hashes collide are merely looked at together, so these hashes are the quick ones.
    """
    grams = tv.quick_grams(values, gram)
    least = tv.sliding_min(grams, width - gram + 1)
    empty = np.zeros(0, np.int64)
    if not len(least):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    size = np.diff(first)
    long = size >= width
    valid = tv.covered(first[:-1][long], first[1:][long] - width + 1, len(least))
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    new[first[:-1][first[:-1] < len(least)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(least))
    start, end = start[valid[start]], end[valid[start]]
    doc = np.searchsorted(first, start, "right") - 1
    reach = end - start + width - gram
    total = np.concatenate(([0], np.cumsum(grams[tv.ragged(start, reach)] == np.repeat(least[start], reach))))
    many = np.diff(total[np.concatenate(([0], np.cumsum(reach)))])
    return doc, start - first[doc], end - start, np.minimum(many, 2), least[start], tv.Rolling(values).of(start, end + width - 1) if content else empty


def scan(texts: DataFrame, unit: Callable[[tv.Chunk], tuple[np.ndarray, np.ndarray]], width: int, gram: int) -> DataFrame:
    """All segments of texts (text and long keys), with these keys; unit gives a chunk's 64-bit values and document bounds."""
    keys = [c for c in texts.columns if c != "text"]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in tv.chunks(b.column("text")):
            doc, s, n, m, ah, sh = segments(*unit(c), width, gram)
            at = pa.array(doc)
            yield batch(**{k: b[k].slice(c.row, c.n).take(at) for k in keys}, s=s, n=n, m=m, ah=signed(ah), sh=signed(sh))

    return texts.mapInArrow(each(run), ", ".join(f"{k} long" for k in (*keys, "s", "n", "m", "ah", "sh")))


def anchors(texts: DataFrame, unit: Callable[[tv.Chunk], tuple[np.ndarray, np.ndarray]], width: int, gram: int) -> DataFrame:
    """(ah, m) of all segments, each chunk's equal anchors added up."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in tv.chunks(b.column("text")):
            _, _, _, m, ah, _ = segments(*unit(c), width, gram, content=False)
            held, of = np.unique(ah, return_inverse=True)
            yield batch(ah=signed(held), m=np.bincount(of, weights=m, minlength=len(held)).astype(np.int64))

    return texts.select("text").mapInArrow(each(run), "ah long, m long")


def shared(texts: DataFrame, unit: Callable[[tv.Chunk], tuple[np.ndarray, np.ndarray]], width: int, gram: int) -> DataFrame:
    """Segments (``scan``) whose anchor occurs again, in another segment or in their own. Texts are read twice, first for the anchors alone."""
    twice = anchors(texts, unit, width, gram).groupBy("ah").agg(F.sum("m").alias("c")).filter("c > 1").select("ah")
    return scan(texts, unit, width, gram).join(dealt_anew(twice, "ah"), "ah")


def per_document(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document (row) with the list of its rows: at most as long as the document."""
    return rows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("list"))


def bounds(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat struct values of a list column and the offset of each row in them (null: empty)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
    return lists.flatten(), np.concatenate(([0], np.cumsum(sizes)))
