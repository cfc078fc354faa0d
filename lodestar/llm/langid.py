"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (two and three bytes; A-Z lower-cased, runs of white space, digits and ASCII
punctuation one space), weighted ``log(1 + count) * idf`` and scaled to length one. Each learned language has a few
centroids, found by spherical k-means; a text goes to the language of the centroid with the largest cosine. A text
farther from it than nearly all training texts of that centroid is marked as rejected.

Document frequencies are counted over all training rows. The centroids alone are fitted on a bounded sample:
``PER_LANGUAGE`` texts of each language in expectation, chosen by a hash of doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm import textvec as tv
from lodestar.llm.common import batch, each, stage, table

DIM, CENTROIDS, ROUNDS = 2048, 4, 12
#: Texts whose counts are held at once, besides the bound of a chunk in bytes.
ROWS = 512
#: Bound of the sample that centroids are fitted on, texts a language in expectation.
PER_LANGUAGE = 1000
#: A text is rejected beyond this quantile of its centroid's training distances, times SLACK.
QUANTILE, SLACK = 0.995, 1.15
UNKNOWN = "und"

_FOLD = tv.lower(np.arange(256, dtype=np.uint8))
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


class Model(NamedTuple):
    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    farthest: np.ndarray


def counts(c: tv.Chunk) -> np.ndarray:
    """Counts of the hashed n-grams of each document, (documents, DIM)."""
    x = _FOLD[c.data].astype(np.uint32)
    n, doc = len(x), np.repeat(np.arange(c.n, dtype=np.int64), np.diff(c.off))
    out = np.zeros(c.n * DIM, np.int64)
    blank = np.zeros(n, bool)
    blank[1:] = (x[1:] == 32) & (x[:-1] == 32)
    for k in (2, 3):
        if n < k:
            continue
        code = x[: n - k + 1].copy()
        for i in range(1, k):
            code = code * np.uint32(257) + x[i : n - k + 1 + i]
        slot = (code * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64)
        inside = (doc[: n - k + 1] == doc[k - 1 :]) & ~blank[1 : n - k + 2] if k > 1 else None
        out += np.bincount((doc[: n - k + 1] * DIM + slot)[inside], minlength=c.n * DIM)
    return out.reshape(c.n, DIM)


def _pieces(texts: pa.Array) -> Iterator[tv.Chunk]:
    """Chunks of at most ROWS texts each: counts are as many as texts, however short these are."""
    for at in range(0, len(texts), ROWS):
        for c in tv.chunks(texts.slice(at, ROWS)):
            yield c._replace(row=at + c.row)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def has_letter(c: tv.Chunk) -> np.ndarray:
    """Whether each document has a letter, by Unicode's categories."""
    total = np.concatenate(([0], np.cumsum(_ASCII_LETTER[c.data])))
    out = np.diff(total[c.off]) > 0
    for i in np.flatnonzero(~out & (np.diff(c.off) > 0)):
        out[i] = any(map(str.isalpha, c.data[c.off[i] : c.off[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of this partition in one row without a language, and the sampled vectors as they are."""
    seen, rows = np.zeros(DIM, np.int64), 0
    for b in batches:
        sampled = np.asarray(b["sampled"].to_pylist(), bool)
        for c in _pieces(b.column("text")):
            n = counts(c)
            seen += (n > 0).sum(0)
            rows += c.n
            for i in np.flatnonzero(sampled[c.row : c.row + c.n]):
                yield batch(lang=b["lang"].slice(c.row + i, 1), rows=pa.array([0]), v=pa.array([np.log1p(n[i]).astype(np.float32).tobytes()]))
    yield batch(lang=pa.array([None], pa.string()), rows=pa.array([rows]), v=pa.array([seen.tobytes()]))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(DIM, np.int64), 0
    for b in batches:
        for n, v in zip(b["rows"].to_pylist(), b["v"].to_pylist(), strict=True):
            seen, rows = seen + np.frombuffer(v, np.int64), rows + n
    yield batch(rows=pa.array([rows]), v=pa.array([seen.tobytes()]))


def _cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; deterministic for the same rows in the same order."""
    centres = [_unit(v.mean(0, keepdims=True))[0]]
    while len(centres) < min(k, len(v)):
        centres.append(v[int(np.argmin((v @ np.array(centres).T).max(1)))])
    c = np.array(centres)
    for _ in range(ROUNDS):
        of = (v @ c.T).argmax(1)
        c = np.array([_unit(v[of == i].sum(0, keepdims=True))[0] if (of == i).any() else c[i] for i in range(len(c))])
    return c


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from (doc_id, text, lang) rows; rows without text or language are left out, none at all give an empty model."""
    rows = train.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return Model([], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros(0))
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    rows = rows.select("text", "lang", (F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).alias("sampled"))
    got = stage(rows.mapInArrow(_gather, "lang string, rows long, v binary"), "grams")
    partial = got.filter("lang is null")
    # one row a partition, added in two steps so that no task reads more than the root of their number
    partial = partial.repartition(max(1, math.isqrt(partial.count()))).mapInArrow(_add, "rows long, v binary")
    total = partial.coalesce(1).mapInArrow(_add, "rows long, v binary").first()
    df, n = np.frombuffer(total["v"], np.int64), total["rows"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    by: dict[str, list[bytes]] = {}
    for r in got.filter("lang is not null").select("lang", "v").toLocalIterator():
        by.setdefault(r["lang"], []).append(bytes(r["v"]))
    langs, of, cents, far = sorted(by), [], [], []
    for i, lang in enumerate(langs):
        v = _unit(np.array([np.frombuffer(x, np.float32) for x in sorted(by[lang])]) * idf)
        c = _cluster(v, CENTROIDS)
        near, nearest = (v @ c.T).max(1), (v @ c.T).argmax(1)
        for k in range(len(c)):
            own = 1 - near[nearest == k]
            of.append(i)
            cents.append(c[k])
            far.append(float(np.quantile(own, QUANTILE)) * SLACK if len(own) else 1.0)
    return Model(langs, np.array(of), np.array(cents, np.float32), idf, np.array(far))


def _predict(m: Model) -> Callable:
    names = np.array([*m.languages, UNKNOWN], object)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in _pieces(b.column("text")):
            lang, score, out = np.full(c.n, len(m.languages)), np.zeros(c.n), np.ones(c.n, bool)
            if len(m.of):
                near = _unit(np.log1p(counts(c)).astype(np.float32) * m.idf) @ m.centroids.T
                best = near.argmax(1)
                ok = has_letter(c)
                lang = np.where(ok, m.of[best], len(m.languages))
                score = np.where(ok, np.clip(near[np.arange(c.n), best], 0, 1), 0.0)
                out = ~ok | (1 - score > m.farthest[best])
            part = b.slice(c.row, c.n)
            yield batch(doc_id=part["doc_id"], held_out=part["held_out"], lang_pred=pa.array(names[lang].tolist(), pa.string()), score=score.astype(np.float64), rejected=out)

    return each(run)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (passed on), lang_pred, score (cosine, 0 to 1) and rejected for every row of docs; only text is looked at."""
    return docs.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")), model)


queries = {"op9_langid": op9_langid}
oracle_sql: dict[str, str] = {}
