"""Substring dedup by seed and extend.

Seeds are winnowed anchors (``anchored``): documents meet where they share one. A shared seed stands for the windows that hold
it on both sides, its segment. Segments that are equal as a whole are one match over all of it. Where the texts around one seed
differ, pairs of occurrences are not extended word by word, as a seed in a third of all documents has too many pairs: the windows around each occurrence are
looked up by their hash, which finds the same matches with a row for each window, and the first occurrence stays. What is removed
is the union of the windows that occurred earlier, as maximal runs; each is a repeat of at least ``WINDOW`` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm import anchored, textvec as tv
from lodestar.llm.common import batch, dealt_anew, each, lists, signed, stage, table

WINDOW, SEED = 20, 8


def _unit(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    w = tv.words(c)
    return tv.word_hashes(c.data, w), w.first


def _extended(window: int) -> Callable:
    """The windows of the listed segments, as (id, row, s, wh)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, at = anchored.bounds(b["list"])
        start, n = flat.field("s").to_numpy(), flat.field("n").to_numpy()
        for c in tv.chunks(b.column("text")):
            h, first = _unit(c)
            lo, hi = at[c.row], at[c.row + c.n]
            doc = np.repeat(np.arange(c.n), np.diff(at[c.row : c.row + c.n + 1]))
            pos = tv.ragged(start[lo:hi] + first[doc], n[lo:hi])
            owner = np.repeat(doc, n[lo:hi])
            fits = pos + window <= first[owner + 1]
            pos, owner = pos[fits], owner[fits]
            wh = tv.Rolling(h).of(pos, pos + window)
            yield batch(id=b["id"].slice(c.row, c.n).take(pa.array(owner)), row=b["row"].slice(c.row, c.n).take(pa.array(owner)), s=pos - first[owner], wh=signed(wh))

    return each(run)


def _cleaned(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    flat, at = anchored.bounds(b["list"])
    start, end = flat.field("s").to_numpy(), flat.field("e").to_numpy()
    for c in tv.chunks(b.column("text")):
        w = tv.words(c)
        lo, hi = at[c.row], at[c.row + c.n]
        doc = np.repeat(np.arange(c.n), np.diff(at[c.row : c.row + c.n + 1]))
        gone = tv.covered(np.minimum(start[lo:hi] + w.first[doc], w.first[doc + 1]), np.minimum(end[lo:hi] + w.first[doc], w.first[doc + 1]), len(w.start))
        edge = np.zeros(len(w.start) + 1, bool)
        edge[w.first] = True
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = np.diff(total[w.first])
        begins = np.flatnonzero(gone & np.concatenate(([True], ~gone[:-1])) | gone & edge[:-1]) if len(gone) else np.zeros(0, np.int64)
        stops = np.flatnonzero(gone & (np.concatenate((~gone[1:], [True])) | edge[1:])) + 1 if len(gone) else begins
        owner = np.searchsorted(w.first, begins, "right") - 1
        raw, kept = c.data.tobytes(), []
        for i in range(c.n):
            if removed[i]:
                live = np.flatnonzero(~gone[w.first[i] : w.first[i + 1]]) + w.first[i]
                kept.append(b" ".join(raw[s:e] for s, e in zip(w.start[live].tolist(), w.end[live].tolist(), strict=True)))
            else:
                kept.append(b" ".join(raw[c.off[i] : c.off[i + 1]].split()))
        spans = pa.StructArray.from_arrays([pa.array(begins - w.first[owner]), pa.array(stops - w.first[owner])], ["s", "e"])
        yield batch(id=b["id"].slice(c.row, c.n), n_words=np.diff(w.first), n_removed=removed, spans=lists(spans, np.bincount(owner, minlength=c.n)), text=pa.array(kept, pa.binary()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_removed, spans, text) for every row of docs (doc_id, text; other columns are ignored).

    spans are the maximal removed runs of words, text the kept words joined by one space (UTF-8). Documents count in
    the order of doc_id; those without one come first, and those with the same one stand together, in the order of their texts'
    hashes. Equal rows are one document, so they don't make each other repeats. A null or empty text has no words.
    """
    texts = anchored.own_texts(docs)
    seeds = stage(anchored.shared(texts, _unit, window, seed), "seeds")
    place = F.struct("id", "row", "s")
    firsts = seeds.groupBy("ah", "sh").agg(F.min(F.struct("id", "row", "s", "n")).alias("first"), F.max("m").alias("m"))
    later = place != F.struct("first.id", "first.row", "first.s")
    ends = lambda n: (F.col("s") + n + window - 1).alias("e")
    whole = seeds.join(dealt_anew(firsts, "ah", "sh"), ["ah", "sh"]).filter(later).select("row", "s", ends(F.col("n")))
    mixed = firsts.groupBy("ah").agg(F.sum("m").alias("c")).filter("c > 1").select("ah")
    open_ = firsts.join(dealt_anew(mixed, "ah"), "ah").select("first.row", "first.s", "first.n")
    found = stage(texts.join(anchored.per_document(open_, "s", "n"), "row").select("id", "row", "text", "list").mapInArrow(_extended(window), "id long, row long, s long, wh long"), "windows")
    earliest = found.groupBy("wh").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").select("wh", "first")
    late = found.join(dealt_anew(earliest, "wh"), "wh").filter(later).select("row", "s", ends(F.lit(1)))
    gone = anchored.per_document(whole.unionByName(late), "s", "e")
    return texts.join(gone, "row", "left").select("id", "text", "list").mapInArrow(each(_cleaned), "id long, n_words long, n_removed long, spans array<struct<s:long,e:long>>, text binary")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents"))
    return r.select(anchored.real_id(), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_runs"))


queries = {"op7_substrings": op7_substrings}
#: Windows are compared as strings.
oracle_sql = {
    "op7_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 19, 0) + 1)) AS i, w FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM g),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM late),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
k AS (SELECT t.doc_id, count(*) FILTER (WHERE gone.j IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY t.j) FILTER (WHERE gone.j IS NULL) AS kept,
      count(*) FILTER (WHERE gone.j IS NOT NULL AND before.j IS NULL) AS n_runs
      FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.j = t.j LEFT JOIN gone before ON before.doc_id = t.doc_id AND before.j = t.j - 1 GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
}
