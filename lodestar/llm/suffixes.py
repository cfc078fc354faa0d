"""Suffix-array dedup of byte strings.

Only segments (``anchored``) whose anchor occurs again can hold a repeat. Equal segments are repeats as a whole and one
of each goes on. Those are dealt to shards by their anchor, so equal strings meet; a shard holds about ``SHARD`` bytes.
In each shard the suffixes are sorted by Larsson and Sadakane's refinement (groups of equal prefixes are split by the
ranks h further on, h doubling) and Kasai's algorithm gives the common prefixes of neighbours; both run on numpy arrays, Kasai's
on all segments side by side. A string of ``WINDOW`` bytes repeats if it shares them with a neighbour.

An anchor with more text than a shard holds (a passage in a third of all documents, each time in another context) is
cut into several. Their sorted runs of distinct strings are then merged across shards by binary search, dealt by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm import anchored, textvec as tv
from lodestar.llm.common import batch, dealt_anew, each, stage, table

WINDOW, GRAM = 400, 64
#: Bytes of segments in a shard, and strings that one task merges.
SHARD, MERGE = 1 << 20, 400_000
_STEP = 7  # symbols of nine bits in a key
_LANE = 512


def _unit(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    return tv.byte_values(c.data), c.off


def first_keys(symbols: np.ndarray) -> np.ndarray:
    """For each position its first seven symbols (0: the end of a segment, else a byte plus one), most significant first, 0 behind an end."""
    padded = np.concatenate((symbols, np.zeros(_STEP, symbols.dtype))).astype(np.uint64)
    key, open_ = np.zeros(len(symbols), np.uint64), np.ones(len(symbols), np.uint64)
    for j in range(_STEP):
        here = padded[j : j + len(symbols)]
        open_ &= here > 0
        key = (key << np.uint64(9)) | here * open_
    return key


def suffix_array(keys: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's place. left: symbols before the segment's end; each end counts as a symbol of its own, by position."""
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    ordered = keys[sa]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = heads
    h = _STEP
    single = new & np.concatenate((new[1:], [True]))
    slots = np.flatnonzero(~single)
    while len(slots):
        at = sa[slots]
        key = rank[at] * (n + 1) + np.where(left[at] >= h, rank[np.minimum(at + h, n)], at) + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        group = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
        rank[at] = slots[heads]
        slots = slots[~(group & np.concatenate((group[1:], [True])))]
        h *= 2
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    return sa, place


def common_prefixes(keys: np.ndarray, left: np.ndarray, sa: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """Kasai's algorithm: for the positions of all [start, start + size), what each shares with the suffix before it in order, up to limit.

    Each range is a lane, cut to ``_LANE`` positions; going one position on loses at most one symbol, in every lane at once.
    """
    n = len(keys)
    out = np.zeros(n, np.int64)
    pieces = -(-size // _LANE)
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(start, pieces) + k * _LANE
    length = np.minimum(np.repeat(start + size, pieces) - begin, _LANE)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    shared = np.zeros(len(begin), np.int64)
    padded = np.concatenate((keys, np.zeros(limit + _STEP + 1, np.uint64)))
    for step in range(int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -step))
        i = begin[:live] + step
        p = place[i]
        has = p > 0
        j = sa[np.maximum(p - 1, 0)]
        l = np.maximum(shared[:live] - 1, 0)
        l[~has] = 0
        go = np.flatnonzero(has)
        while len(go):
            differ = padded[i[go] + l[go]] ^ padded[j[go] + l[go]]
            same = differ == 0
            l[go[same]] += _STEP
            rest = go[~same]
            if len(rest):
                top = np.frexp(differ[~same].astype(np.float64))[1]  # within one of the highest bit that differs
                top -= (differ[~same] >> (top - 1).astype(np.uint64)) == 0
                l[rest] += (_STEP * 9 - top) // 9
            go = go[same]
            go = go[l[go] < limit]
        l = np.minimum(l, np.minimum(left[i], limit))  # ends of segments don't count
        shared[:live] = l
        out[i] = l
    return out


def repeats(pieces: list[bytes], owned: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For segments of bytes: text, start of each in it, mask of the owned positions whose window occurs again, and suffix order with a group number a window (-1: not owned)."""
    size = np.array([len(p) for p in pieces], np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = raw.astype(np.uint16) + 1
    symbols[start + size] = 0
    left = np.repeat(start + size, size + 1) - np.arange(len(raw))
    keys = first_keys(symbols)
    sa, place = suffix_array(keys, left)
    before = common_prefixes(keys, left, sa, place, start, owned, window)
    mine = np.zeros(len(raw), bool)
    mine[tv.ragged(start, owned)] = True
    in_order = (before[sa] >= window) & mine[sa]  # equal to the one before
    twice = in_order | np.concatenate((in_order[1:], [False]))
    hit = np.zeros(len(raw), bool)
    hit[sa] = twice
    hit &= mine
    group = np.where(mine[sa], np.cumsum(~in_order), -1)
    out = np.full(len(raw), -1, np.int64)
    out[sa] = group
    return raw, start, hit, out


_PIECES = "ah long, row long, s long, n long, alone boolean, bytes binary"
_FOUND = "row long, s long, e long, range int, run binary"
_STRING = np.dtype([("wh", "<u8"), ("row", "<i8"), ("s", "<i8")])


def _cut(window: int) -> Callable:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, at = anchored.bounds(b["list"])
        doc = np.repeat(np.arange(b.num_rows), np.diff(at))
        s, n = flat.field("s").to_numpy(), flat.field("n").to_numpy()
        texts = b["text"].cast(pa.binary())
        for lo in range(0, len(doc), 4096):
            part = slice(lo, lo + 4096)
            held, last, pieces = b"", -1, []
            for d, x, k in zip(doc[part].tolist(), s[part].tolist(), n[part].tolist(), strict=True):
                if d != last:
                    held, last = memoryview(texts[d].as_buffer()), d
                pieces.append(bytes(held[x : x + k + window - 1]))
            f = flat.slice(lo, 4096)
            yield batch(ah=f.field("ah"), row=b["row"].take(pa.array(doc[part])), s=s[part], n=n[part], alone=f.field("alone"), bytes=pa.array(pieces, pa.binary()))

    return each(run)


def _result(ids, s, e, ranges=(), runs=()) -> pa.Table:
    n, m = len(ids), len(ranges)
    none = pa.nulls(m, pa.int64())
    columns = [pa.concat_arrays([pa.array(x, pa.int64()), none]) for x in (ids, s, e)]
    return pa.table([*columns, pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(ranges, pa.int32())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(runs, pa.binary())])], ["row", "s", "e", "range", "run"])


def _shard(window: int, ranges: int) -> Callable:
    """Of one shard: spans [s, e) of segments that stand alone; if it is a part of an anchor, also its distinct strings.

    These are a sorted run for each range of hashes: hash, id and place, the place -1 if the string is a known repeat or
    no document's alone, so that nothing about it is left to decide.
    """

    def run(t: pa.Table) -> pa.Table:
        ids, s, n = (t[k].to_numpy() for k in ("row", "s", "n"))
        alone, part, pieces = np.asarray(t["alone"].to_pylist(), bool), t["part"][0].as_py(), t["bytes"].to_pylist()
        raw, start, hit, group = repeats(pieces, np.clip(np.array([len(x) - window + 1 for x in pieces]), 0, n), window)
        segment = np.repeat(np.arange(len(n)), np.diff(np.append(start, len(raw))))
        begin, end = tv.runs(hit & alone[segment])  # a segment's last bytes own no window, so no run leaves it
        o = segment[begin]
        found = ids[o], s[o] + begin - start[o], s[o] + end - start[o] + window - 1
        if not part:
            return _result(*found)
        pos = np.flatnonzero(group >= 0)
        _, first, size = np.unique(group[pos], return_index=True, return_counts=True)
        at = pos[first]
        o = segment[at]
        strings = np.zeros(len(at), _STRING)
        strings["wh"], strings["row"] = tv.Rolling(tv.byte_values(raw)).of(at, at + window), ids[o]
        strings["s"] = np.where((size == 1) & alone[o], s[o] + at - start[o], -1)
        of = (strings["wh"] >> np.uint64(8)) % np.uint64(ranges)
        order = np.lexsort((strings["wh"], of))
        strings, of = strings[order], of[order]
        cut = np.searchsorted(of, np.arange(ranges + 1))
        held = np.flatnonzero(np.diff(cut))
        return _result(*found, held, [strings[cut[r] : cut[r + 1]].tobytes() for r in held.tolist()])

    return run


def _merge(window: int) -> Callable:
    """Sorted runs of several shards, each run's strings distinct: those with a place that another run holds, too, by binary search."""

    def run(t: pa.Table) -> pa.Table:
        runs = [np.frombuffer(x, _STRING) for x in t["run"].to_pylist()]
        everything = np.sort(np.concatenate([r["wh"] for r in runs]))
        again = [r[(np.searchsorted(everything, r["wh"], "right") - np.searchsorted(everything, r["wh"], "left") > 1) & (r["s"] >= 0)] for r in runs]
        hits = np.concatenate(again)
        hits = hits[np.lexsort((hits["s"], hits["row"]))]
        new = np.concatenate((np.ones(min(1, len(hits)), bool), (hits["row"][1:] != hits["row"][:-1]) | (hits["s"][1:] > hits["s"][:-1] + window)))
        begin = np.flatnonzero(new)  # overlapping strings go out as one span
        end = np.append(begin[1:], len(hits)) - 1 if len(begin) else begin
        return _result(hits["row"][begin], hits["s"][begin], hits["s"][end] + window)

    return run


def _digest(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    flat, at = anchored.bounds(b["list"])
    start, end = flat.field("s").to_numpy(), flat.field("e").to_numpy()
    for c in tv.chunks(b.column("text")):
        lo, hi = at[c.row], at[c.row + c.n]
        doc = np.repeat(np.arange(c.n), np.diff(at[c.row : c.row + c.n + 1]))
        gone = tv.covered(np.minimum(start[lo:hi] + c.off[doc], c.off[doc + 1]), np.minimum(end[lo:hi] + c.off[doc], c.off[doc + 1]), len(c.data))
        kept, removed, spans = [], [], []
        for i in range(c.n):
            own, data = gone[c.off[i] : c.off[i + 1]], c.data[c.off[i] : c.off[i + 1]]
            b0, e0 = tv.runs(own)
            removed.append(int((e0 - b0).sum()))
            spans.append([{"s": x, "e": y} for x, y in zip(b0.tolist(), e0.tolist(), strict=True)])
            kept.append(data[~own].tobytes() if removed[-1] else data.tobytes())
        yield batch(id=b["id"].slice(c.row, c.n), n_bytes=np.diff(c.off), n_removed=pa.array(removed, pa.int64()), spans=pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), kept=pa.array(kept, pa.binary()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, merge: int = MERGE) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) for every row of docs (doc_id, text; other columns are ignored).

    spans are the maximal removed runs of bytes, kept the rest, which may end within a character. A null or empty text
    has no bytes. Rows are told apart by doc_id and text; equal ones count as two documents, so each is the other's copy.
    """
    texts = anchored.own_texts(docs)
    seeds = stage(anchored.shared(texts.select("row", "text"), _unit, window, gram), "segments")
    kinds = seeds.groupBy("ah", "sh").agg(F.min(F.struct("row", "s", "n")).alias("first"), F.count("*").alias("c"), F.max("m").alias("m"))
    whole = seeds.join(dealt_anew(kinds.filter("c > 1").select("ah", "sh"), "ah", "sh"), ["ah", "sh"]).select("row", "s", (F.col("s") + F.col("n") + window - 1).alias("e"))
    anchors = kinds.groupBy("ah").agg(F.sum("m").alias("k"), F.sum(F.col("first.n") + window).alias("bytes")).filter("k > 1")
    open_ = kinds.join(dealt_anew(anchors, "ah"), "ah").select("ah", "first.row", "first.s", "first.n", (F.col("c") == 1).alias("alone"), "bytes")
    open_ = stage(open_, "open")
    total = open_.agg(F.sum(F.col("n") + window)).first()[0] or 0
    parts = F.ceil(F.col("bytes") / shard).cast("long")
    pieces = texts.join(anchored.per_document(open_, "s", "n", "ah", "alone"), "row").select("row", "text", "list").mapInArrow(_cut(window), _PIECES)
    hot = open_.filter(F.col("bytes") > shard).select("ah", parts.alias("parts")).distinct()
    dealt = pieces.join(dealt_anew(hot, "ah"), "ah", "left").select(
        F.when(F.col("parts").isNull(), F.pmod("ah", F.lit(max(1, -(-total // shard))))).otherwise(F.xxhash64("ah", F.pmod(F.xxhash64("row", "s"), "parts"))).alias("shard"),
        F.col("parts").isNotNull().alias("part"), "row", "s", "n", "alone", "bytes",
    )
    spread = open_.filter(F.col("bytes") > shard).agg(F.sum("n")).first()[0] or 0
    found = stage(dealt.groupBy("shard", "part").applyInArrow(_shard(window, -(-spread // merge) or 1), _FOUND), "suffixes")
    across = found.filter("run is not null").groupBy("range").applyInArrow(_merge(window), _FOUND)
    spans = found.filter("run is null").unionByName(across).select("row", "s", "e")
    gone = anchored.per_document(whole.unionByName(spans), "s", "e")
    return texts.join(gone, "row", "left").select("id", "text", "list").mapInArrow(each(_digest), "id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents"))
    return r.select(anchored.real_id(), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


queries = {"op4_suffixes": op4_suffixes}
#: Strings are compared by their MD5, kept bytes joined in hexadecimal.
oracle_sql = {
    "op4_suffixes": r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, b, unnest(range(1, greatest(octet_length(b) - 399, 0) + 1)) AS i FROM b),
h AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM d),
s AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o) GROUP BY doc_id, k),
p AS (SELECT s.doc_id, s, hex(b[lag(e, 1, 1) OVER (PARTITION BY s.doc_id ORDER BY s):s - 1]) AS piece, lead(s) OVER (PARTITION BY s.doc_id ORDER BY s) IS NULL AS last, hex(b[e:octet_length(b)]) AS rest FROM s JOIN b ON b.doc_id = s.doc_id),
k AS (SELECT doc_id, string_agg(CASE WHEN last THEN piece || rest ELSE piece END, '' ORDER BY s) AS kept FROM p GROUP BY doc_id),
n AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT b.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN k.doc_id IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM b LEFT JOIN n ON n.doc_id = b.doc_id LEFT JOIN k ON k.doc_id = b.doc_id
"""
}
