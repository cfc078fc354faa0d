"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's signature has ``COORDINATES`` minima of its five-word shingles. Each document, equal shingle sets once, is posted
under its coordinate-value pairs. Pairs above the threshold agree in at least ``MATCHES`` coordinates (``STAGE_MATCHES`` for the
pipeline's threshold) but for a chance of about 2e-7. Hence two filters that lose none of them: documents with fewer shared values are left out, and each is
posted under its prefix alone, the rarest ``COORDINATES - MATCHES + 1`` of its values; longer lists are skipped.

Links are confirmed on full shingle sets, in two steps. First each document is held against one other alone, the least that shares a
posting list with it: a row a document, which settles most members of a large cluster. Then posting lists are merged:
agreeing coordinates are counted for pairs that the first step has not connected, in blocks of bounded size, and what they
connect leaves the task as a star, a row a document. Within these groups, again only pairs not connected yet are compared. A list or
group is replicated by its unsettled members, not by its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm import anchored, textvec as tv
from lodestar.llm.common import batch, dealt_anew, each, signed, stage, table, whole_groups
from lodestar.llm.components import components

SHINGLE, THRESHOLD = 5, 85
COORDINATES, MATCHES = 40, 21
#: The pipeline's stage links from 0.8 on; fewer matches, so that a pair at its threshold is missed as rarely (2.0e-7).
STAGE_THRESHOLD, STAGE_MATCHES = 80, 18
#: Documents of a posting list, and documents and shingles of a component, in a block.
LIST_BLOCK, SET_BLOCK, SET_SHINGLES = 1024, 400, 200_000

_A = np.random.default_rng(6).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, one after another, and their bounds."""
    w = tv.words(c)
    h = tv.Rolling(tv.word_hashes(tv.lower(c.data), w))
    doc, n = w.doc, np.diff(w.first)
    at = np.flatnonzero(doc[: max(0, len(doc) - SHINGLE + 1)] == doc[SHINGLE - 1 :]) if len(doc) >= SHINGLE else np.zeros(0, np.int64)
    g = h.of(at, at + SHINGLE)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    g = np.concatenate((g, h.of(w.first[few], w.first[few + 1])))
    owner = np.concatenate((doc[at], few))
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    keep = np.concatenate((np.ones(min(1, len(g)), bool), (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])))
    g, owner = g[keep], owner[keep]
    return g, np.searchsorted(owner, np.arange(c.n + 1))


def _sign(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for c in tv.chunks(b.column("text")):
        g, at = shingle_sets(c)
        n = np.diff(at)
        live = np.flatnonzero(n)
        keys, sums = np.zeros((c.n, COORDINATES), np.uint64), np.zeros((2, c.n), np.uint64)
        if len(live):
            with np.errstate(over="ignore"):
                for k, a in enumerate(_A):
                    keys[live, k] = tv.mix(np.minimum.reduceat(g * a, at[live]) + np.uint64(k))
                sums[0, live] = np.add.reduceat(tv.mix(g), at[live])
                sums[1, live] = np.add.reduceat(tv.mix(g ^ _A[0]), at[live])
        yield batch(id=b["id"].slice(c.row, c.n), row=b["row"].slice(c.row, c.n), n=n, x=signed(sums[0]), y=signed(sums[1]), sketch=pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), c.n, [None, pa.py_buffer(keys.astype(np.uint8).tobytes())]).cast(pa.binary()), keys=pa.FixedSizeListArray.from_arrays(pa.array(signed(keys.ravel())), COORDINATES).cast(pa.list_(pa.int64())))


class Forest:
    """Components of small integers, each named by its least."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, i: int, others: np.ndarray) -> None:
        """Connect i with all others."""
        met = self.of[others]
        least = min(int(met.min(initial=self.of[i])), int(self.of[i]))
        for x in {*met[met != least].tolist(), int(self.of[i])} - {least}:
            self.of[self.of == x] = least

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Every member but the least of each component, and the least of its component."""
        member = np.flatnonzero(self.of != np.arange(len(self.of)))
        return member, self.of[member]


def _merge_lists(t: pa.Table, begin: np.ndarray, matches: int) -> Iterator[pa.RecordBatch]:
    """What the pairs of two labels with enough agreeing coordinates connect, as a star around the least id."""
    ids, label, side, crossed = t["id"].to_numpy(), t["label"].to_numpy(), t["side"].to_numpy(), t["crossed"].to_numpy(zero_copy_only=False)
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
    size = np.diff(begin)
    two = begin[:-1][size == 2]  # most lists: one comparison each
    ok = ((sketch[two] == sketch[two + 1]).sum(1) >= matches) & (label[two] != label[two + 1]) & ~(crossed[two] & (side[two] == side[two + 1])) if len(two) else np.zeros(0, bool)
    a, b = [ids[two[ok] + 1]], [ids[two[ok]]]
    for g in np.flatnonzero(size > 2):
        lo, hi = int(begin[g]), int(begin[g + 1])
        forest, own, of = Forest(hi - lo), sketch[lo:hi], label[lo:hi]
        for i in range(hi - lo - 1):
            j = np.flatnonzero((of[i + 1 :] != of[i]) & ((own[i + 1 :] == own[i]).sum(1) >= matches)) + i + 1
            if crossed[lo]:
                j = j[side[lo + j] != side[lo + i]]
            if len(j):
                forest.add(i, j)
        member, root = forest.stars()
        a.append(ids[lo + member])
        b.append(ids[lo + root])
    yield batch(a=np.concatenate(a), b=np.concatenate(b))


def _own_sets(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for c in tv.chunks(b.column("text")):
        g, at = shingle_sets(c)
        raw = g.tobytes()
        yield batch(id=b["id"].slice(c.row, c.n), shingles=pa.array([raw[8 * s : 8 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()))


def _pairs(b: pa.RecordBatch, threshold: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, x, y) with the shingles x of a and y of b those that are linked."""
    ok = []
    for x, y in zip(b["x"], b["y"], strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        few, many = (x, y) if len(x) < len(y) else (y, x)  # both sorted
        at = np.minimum(np.searchsorted(many, few), max(len(many) - 1, 0))
        common = int((many[at] == few).sum()) if len(many) else 0
        ok.append(100 * common >= threshold * (len(x) + len(y) - common))
    yield batch(a=b["a"], b=b["b"]).filter(pa.array(ok, pa.bool_()))


def _confirm(t: pa.Table, begin: np.ndarray, threshold: int) -> Iterator[pa.RecordBatch]:
    """What the exact links of two labels within each group connect, as a star around the least id."""
    ids, label, side, crossed, held = t["id"].to_numpy(), t["label"].to_numpy(), t["side"].to_numpy(), t["crossed"].to_numpy(zero_copy_only=False), t["shingles"].to_pylist()
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        sets = [np.frombuffer(s, np.uint64) for s in held[lo:hi]]
        n = np.array([len(s) for s in sets])
        common = intersections(sets)
        link = 100 * common >= threshold * (n[:, None] + n[None, :] - common)
        link &= label[lo:hi, None] != label[None, lo:hi]
        if crossed[lo]:
            link &= side[lo:hi, None] != side[None, lo:hi]
        forest = Forest(hi - lo)
        for i, row in enumerate(link):
            forest.add(i, np.flatnonzero(row))
        member, root = forest.stars()
        out_a.append(ids[lo + member])
        out_b.append(ids[lo + root])
    yield batch(a=np.concatenate(out_a), b=np.concatenate(out_b))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of all sets with each other."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(first) - 1
    keep = np.bincount(column)[column] > 1
    owner, column = owner[keep], np.cumsum(first & keep)[keep] - 1
    out = np.zeros((n, n), np.float32)
    width = 4096
    for x in range(0, int(column.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(column, [x, x + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - x] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out.astype(np.int64)


def _in_blocks(rows: DataFrame, key: str, most: int, weight: str | None = None, heaviest: int = 1) -> DataFrame:
    """Deal rows (key, id, label, ...) so that any two of a key with different labels meet in a group g.

    A key with one label has nothing to compare and is left out. The most frequent label of a key and its other rows are cut into blocks of
    about ``most`` rows (and ``heaviest`` weight); two blocks of the former never meet, so its rows are replicated by the number of
    the other rows' blocks alone. crossed groups hold two blocks (side), of which only pairs across are new.
    """
    w = F.col(weight) if weight else F.lit(0)
    per = rows.groupBy(key, "label").agg(F.count("*").alias("n"), F.sum(w).alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / most, w / heaviest)).cast("long")
    top = F.max(F.struct("n", "label", "w"))
    keys = per.groupBy(key).agg(top.alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("labels")).filter("labels > 1").withColumn("all", blocks(F.col("n"), F.col("w")))
    keys = keys.select(
        key, F.col("top.label").alias("main"), F.when(F.col("all") > 1, blocks(F.col("top.n"), F.col("top.w"))).otherwise(0).cast("long").alias("of_main"),
        F.when(F.col("all") > 1, blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w"))).otherwise(1).cast("long").alias("of_rest"),
    )
    dealt = rows.join(dealt_anew(keys, key), key)
    settled = (F.col("label") == F.col("main")) & (F.col("of_main") > 0)
    zero = F.lit(0).cast("long")
    side = F.when(settled, F.pmod(F.xxhash64("id"), "of_main")).otherwise(F.col("of_main") + F.pmod(F.xxhash64("id"), "of_rest"))
    dealt = dealt.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.when(settled, F.col("of_main")).otherwise(zero), F.col("of_main") + F.col("of_rest") - 1)))
    lo, hi = F.least("side", "other"), F.greatest("side", "other")
    rest = [c for c in rows.columns if c not in (key, "id", "label")]
    return dealt.select(F.xxhash64(key, lo, hi).alias("g"), "id", "label", "side", (lo != hi).alias("crossed"), *rest)


def _met(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("g").sortWithinPartitions("g", "id")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, matches: int = MATCHES) -> DataFrame:
    """(id, row, n_shingles, component_id, first) for every row of docs (doc_id, text; other columns are ignored).

    Links are exact: 100 * intersection >= threshold * union of the distinct shingles; component_id is the least id that links reach,
    first tells the row that names it (of rows with that id, the one with the least hash; equal rows alike).
    Pairs that agree in fewer than matches coordinates are not compared, so a lower threshold needs fewer matches.
    A text without words has no shingles and no links; one of fewer than five words is one shingle. A null doc_id is
    below all others. Rows with one doc_id but different texts are documents of their own.
    """
    texts = anchored.own_texts(docs)
    signed_ = stage(texts.mapInArrow(each(_sign), "id long, row long, n long, x long, y long, sketch binary, keys array<long>").withColumn("class", F.when(F.col("n") > 0, F.xxhash64("n", "x", "y"))), "signatures")
    classes = stage(signed_.filter("n > 0").groupBy("class").agg(F.min("row").alias("row"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n").alias("n")).withColumnRenamed("class", "id"), "classes")
    postings = classes.select("id", F.explode("keys").alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    held = postings.join(dealt_anew(lists, "key"), "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("held")).filter(F.size("held") >= matches)
    prefix = F.slice("held", 1, F.size("held") - (matches - 1))  # values that no other has come before these
    posted = stage(held.select("id", F.explode(F.transform(prefix, lambda p: p["key"])).alias("key")), "posted")
    sets = stage(texts.join(classes.select(F.col("id").alias("class"), "row").join(posted.select(F.col("id").alias("class")).distinct(), "class"), "row").select(F.col("class").alias("id"), "text").mapInArrow(each(_own_sets), "id long, shingles binary"), "sets")

    # each document and the least one that it shares a list with
    least = posted.groupBy("key").agg(F.min("id").alias("centre"))
    star = posted.join(dealt_anew(least, "key"), "key").groupBy("id").agg(F.min("centre").alias("centre")).filter("id <> centre")
    star = star.join(sets, "id").select(F.col("id").alias("a"), F.col("centre").alias("b"), F.col("shingles").alias("x"))
    star = star.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    sure = stage(star.mapInArrow(each(partial(_pairs, threshold=threshold)), "a long, b long"), "stars")
    labels = stage(components(sure).withColumnRenamed("v", "id").withColumnRenamed("component", "label"), "labels")
    labelled = lambda df: df.join(dealt_anew(labels, "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    # pairs that the stars have not connected
    dealt = _in_blocks(labelled(posted), "key", LIST_BLOCK).join(classes.select("id", "sketch"), "id")
    near = _met(dealt).mapInArrow(whole_groups("g", partial(_merge_lists, matches=matches)), "a long, b long")
    groups = components(near)
    members = groups.unionByName(groups.select(F.col("component").alias("v"), "component").distinct()).withColumnRenamed("v", "id")
    dealt = _in_blocks(labelled(members.join(classes.select("id", "n"), "id")), "component", SET_BLOCK, "n", SET_SHINGLES).drop("n")
    links = _met(dealt.join(sets, "id")).mapInArrow(whole_groups("g", partial(_confirm, threshold=threshold)), "a long, b long")
    linked = components(sure.unionByName(links))

    own = signed_.filter("n > 0").groupBy("class").agg(F.min(F.struct("id", "row")).alias("least"))
    own = own.join(linked.withColumnRenamed("v", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = own.groupBy("component").agg(F.min("least").alias("least"))
    named = own.select("class", "component").join(dealt_anew(names, "component"), "component").select("class", "least")
    out = signed_.select("id", "row", "n", "class").join(dealt_anew(named, "class"), "class", "left")
    return out.select("id", "row", F.col("n").alias("n_shingles"), F.coalesce("least.id", "id").alias("component_id"), F.coalesce(F.col("least.row") == F.col("row"), F.lit(True)).alias("first"))


def op6_nearduplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = near_duplicates(table(spark, sf_dir, "documents"))
    return r.select(anchored.real_id(), "n_shingles", anchored.real_id("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, linked from 0.8 on, the document with the least doc_id (one row of it), with its columns."""
    kept = near_duplicates(docs, STAGE_THRESHOLD, STAGE_MATCHES).filter("first").select("row").distinct()
    whole = docs.select(F.struct("*").alias("document"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"))
    return whole.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("document.*")


queries = {"op6_nearduplicates": op6_nearduplicates}
oracle_sql = {
    "op6_nearduplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
}
