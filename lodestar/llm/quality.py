"""Quality rules with cross-document line frequency.

Each line is normalised (A-Z lower-cased, words joined by one space) and hashed. The documents that hold a line are
counted per host, equal texts once, so that mere copies don't make their own lines look like boilerplate. A line above
the limit is boilerplate and is removed; a document of which too few words remain is depleted and rejected.

Counts are exact and over all documents. A line that a third of all rows share is one partial count a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm import textvec as tv
from lodestar.llm.common import batch, dealt_anew, each, keyed, lists, real_id, signed, stage, table

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, SYMBOLS = 20, 8, 30, b"#*$%&|<>"
#: A line is boilerplate in at least so many distinct documents of a host, and in at least so large a share of them.
MIN_DOCS, MIN_SHARE = 50, 0.05
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_STATS = "id long, th long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,n:int>>"


def _sums(cells: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(cells, dtype=np.int64)))
    return np.diff(total[bounds])


def _firsts(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, h): index of one row of each, its group for every row, and the groups' sizes."""
    with np.errstate(over="ignore"):
        key = tv.mix(h + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, at, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return at, group, n


def measure(c: tv.Chunk) -> dict[str, np.ndarray]:
    """Per document of a chunk: the base counts, and its distinct normalised lines with the words in them."""
    w = tv.words(c)
    n_words = np.diff(w.first)
    in_word = np.zeros(len(c.data), bool)
    in_word[tv.ragged(w.start, w.end - w.start)] = True
    chars = _sums(in_word & ((c.data & 0xC0) != 0x80), c.off)
    symbols = _sums(_SYMBOL[c.data], c.off)

    starts = tv.distinct(np.concatenate((c.off[:-1][np.diff(c.off) > 0], np.flatnonzero(c.data == 10) + 1)))
    starts = starts[starts < len(c.data)]
    ends = np.append(starts[1:], len(c.data))
    ends = ends - ((ends > starts) & (c.data[np.maximum(ends - 1, 0)] == 10)) if len(ends) else ends
    first = np.searchsorted(w.start, starts)
    last = np.searchsorted(w.start, ends)
    live = last > first
    starts, ends, first, last = starts[live], ends[live], first[live], last[live]
    doc = np.searchsorted(c.off, starts, "right") - 1
    raw = tv.Rolling(tv.byte_values(c.data)).of(starts, ends)
    at, _, _ = _firsts(doc, raw)
    dup = np.bincount(doc, minlength=c.n) - np.bincount(doc[at], minlength=c.n)

    norm = tv.Rolling(tv.word_hashes(tv.lower(c.data), w)).of(first, last)
    at, group, _ = _firsts(doc, norm)
    held = np.bincount(group, weights=last - first, minlength=len(at)).astype(np.int32)
    order = np.argsort(doc[at], kind="stable")

    grams = tv.Rolling(tv.word_hashes(c.data, w)).grams(WINDOW)
    of = w.doc
    whole = np.flatnonzero(of[: len(grams)] == of[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    _, group, n = _firsts(of[whole], grams[whole])
    hit = whole[n[group] > 1] if len(whole) else whole
    repeat = _sums(tv.covered(hit, hit + WINDOW, len(of)), w.first)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "line": norm[at][order], "line_words": held[order], "n_lines": np.bincount(doc[at], minlength=c.n)}


def _stats(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for c in tv.chunks(b.column("text")):
        m = measure(c)
        part = b.slice(c.row, c.n)
        held = pa.StructArray.from_arrays([pa.array(signed(m["line"])), pa.array(m["line_words"])], ["h", "n"])
        yield batch(id=part["id"], th=part["th"], host=part["host"], **{k: m[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, lines=lists(held, m["n_lines"]))


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of docs: the base counts, n_line_words (words in boilerplate lines), boilerplate (their hashes, null: none), base_failed and kept.

    Null text has no words and fails; a null host is a host of its own; columns of other names are ignored.
    """
    rows = keyed(docs.withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit(""))), F.col("_host").alias("host"))
    stats = stage(rows.mapInArrow(each(_stats), _STATS), "lines")
    held = stats.select("host", "th", F.explode("lines").alias("line")).select("host", "th", "line.h").distinct()
    hosts = stats.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    common = held.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).join(hosts, "host").filter(F.col("n") >= min_share * F.col("texts")).select("host", "h")
    lost = (
        stats.select("id", "th", "host", F.explode("lines").alias("line")).select("id", "th", "host", "line.h", "line.n").distinct()
        .join(dealt_anew(common, "h"), ["host", "h"]).groupBy("id", "th", "host").agg(F.sum("n").alias("n_line_words"), F.collect_list("h").alias("boilerplate"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    return (
        stats.drop("lines").join(lost, ["id", "th", "host"], "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)))
        .withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= min_left * F.col("n_words")))
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = judge(table(spark, sf_dir, "documents"))
    return r.select(real_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_line_words").cast("long").alias("n_line_words"))


def without_lines(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Each text without its lines whose normalised hash is in its list gone, their line breaks with them; null where the list is null."""
    held, out = gone.to_pylist(), []
    for c in tv.chunks(text):
        w, raw = tv.words(c), c.data.tobytes()
        h = tv.Rolling(tv.word_hashes(tv.lower(c.data), w))
        for i, hashes in enumerate(held[c.row : c.row + c.n]):
            if hashes is None:
                out.append(None)
                continue
            lines = raw[c.off[i] : c.off[i + 1]].split(b"\n")
            starts = c.off[i] + np.cumsum([0, *(len(x) + 1 for x in lines)])
            at = np.searchsorted(w.start, starts)
            at[-1] = w.first[i + 1]
            bad = (at[1:] > at[:-1]) & np.isin(signed(h.of(at[:-1], at[1:])), np.array(hashes, np.int64))
            out.append(b"\n".join(x for x, b in zip(lines, bad.tolist(), strict=True) if not b).decode())
    return pa.array(out, pa.string())


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str, **limits) -> DataFrame:
    """Pipeline stage: documents that are not rejected, without their boilerplate lines and with n_chars renewed; other columns as they are."""
    good = judge(docs, **limits).filter("kept").groupBy(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("host").alias("_host")).agg(F.first("boilerplate").alias("_gone"))
    own = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_th": F.xxhash64("text"), "_host": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    cut = F.arrow_udf(without_lines, "string")(F.when(F.col("_gone").isNotNull(), F.col("text")), F.col("_gone"))
    kept = own.join(good, ["_id", "_th", "_host"]).withColumn("_cut", cut)
    new = {"text": F.coalesce("_cut", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut").isNotNull(), F.length("_cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(new).select(*docs.columns)


queries = {"op3_quality": op3_quality}
oracle_sql = {
    "op3_quality": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i, w FROM d), h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS h FROM g),
r AS (SELECT doc_id, i FROM h JOIN (SELECT doc_id, h FROM h GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, h)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(x, chr(10))) AS line FROM d),
v AS (SELECT doc_id, host, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM v GROUP BY doc_id),
n AS (SELECT doc_id, host, text, array_to_string(lw, ' ') AS norm, len(lw) AS words FROM v),
hosts AS (SELECT host, count(DISTINCT coalesce('t' || text, 'null')) AS texts FROM d GROUP BY host),
common AS (SELECT host, norm FROM n JOIN hosts USING (host) GROUP BY host, norm, texts HAVING count(DISTINCT text) >= 50 AND count(DISTINCT text) >= 0.05 * texts),
lost AS (SELECT doc_id, sum(words) AS n FROM n JOIN common USING (host, norm) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_line_words
      FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_line_words >= 0.2 * n_words AS kept, CAST(n_line_words AS BIGINT) AS n_line_words
FROM s
"""
}
