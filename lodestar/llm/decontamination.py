"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Terms are counted over the training texts first. A phrase is looked up by its rarest terms, so the index holds the postings (term, document,
position) of those terms alone; each partition of documents writes its own part of it, and building it moves no token between machines. The
postings of the rarest term are intersected with those of the next rarest at the distance that the phrase has them at; once for all phrases that
have these two so. What is left is compared word by word with the text. Terms that are near each other, at whatever distance up to ``NEAR``, are proximity matches.

Words are those of the contract: A-Z are lower-cased before texts are split, anything else is compared as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestar.llm import anchored
from lodestar.llm.common import dealt_anew, stage, table

WINDOW = 10
#: Words between which two terms count as near.
NEAR = 10
#: A table of terms or phrases is broadcast up to so many bytes, which are counted first; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
#: Fixed value: what stands between words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """Words in order. Splitting is far cheaper than extracting every match; only the ends can be empty."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, size, exact, terms, items): distinct phrases of (item_id, text), each with the items that have it.

    An item of fewer words, but not none, is one phrase. exact: its words, joined by one space.
    """
    w = items.select("item_id", words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    p = w.select("item_id", F.explode(F.transform(at, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("exact"))
    p = p.groupBy("exact").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    t = F.split("exact", " ")
    return p.select(F.xxhash64("exact").alias("phrase"), "exact", "items", t.alias("terms"), F.size(t).alias("size"))


def _small(df: DataFrame, *strings: str) -> DataFrame:
    """df, to be broadcast if its bytes, counted here, are few. Its other columns are numbers."""
    size = df.agg(F.sum(sum((F.octet_length(c) for c in strings), F.lit(16 * len(df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def tokens(texts: DataFrame) -> DataFrame:
    return texts.select("row", F.posexplode(words("text")).alias("pos", "word"))


def rarest(texts: DataFrame, looked_up: DataFrame) -> DataFrame:
    """(phrase, term, off, term2, off2): the two rarest terms of each phrase (one, if it has no other) and where they stand first in it.

    A phrase with a term that occurs nowhere is left out.
    """
    all_terms = looked_up.select("phrase", F.posexplode("terms").alias("off", "word")).groupBy("phrase", "word").agg(F.min("off").alias("off"))
    vocabulary = stage(all_terms.select("word").distinct(), "vocabulary")
    frequency = tokens(texts).join(_small(vocabulary, "word"), "word").groupBy("word").agg(F.count("*").alias("n"))
    known = all_terms.withColumn("key", F.xxhash64("word")).join(dealt_anew(stage(frequency.withColumn("key", F.xxhash64("word")), "frequency").drop("word"), "key"), "key", "left")
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")))  # a phrase has few terms
    r = known.groupBy("phrase").agg(ranked.alias("r")).filter(F.get("r", F.lit(0))["n"] > 0)
    one, two = (F.get("r", F.lit(k)) for k in (0, 1))
    return r.select("phrase", F.xxhash64(one["word"]).alias("term"), one["off"].alias("off"), F.when(two.isNotNull(), F.xxhash64(two["word"])).alias("term2"), two["off"].alias("off2"))


def build_index(texts: DataFrame, lead: DataFrame) -> DataFrame:
    """(row, pos, term) postings of the terms that phrases are looked up by, stored by document partition; positions from 0."""
    wanted = stage(lead.select(F.explode(F.array_compact(F.array("term", "term2"))).alias("term")).distinct(), "terms")
    return stage(tokens(texts).select("row", "pos", F.xxhash64("word").alias("term")).join(_small(wanted), "term").select("row", "pos", "term"), "index")


def meetings(index: DataFrame, lead: DataFrame, near: int = NEAR) -> DataFrame:
    """(row, term, term2, pos, pos2): places where a phrase's two rarest terms are within ``near`` words, in either order.

    The postings of both are dealt to cells of that width in their document; two near ones lie in one cell or in neighbours.
    """
    pairs = stage(lead.filter("term2 is not null").select("term", "term2").distinct(), "pairs")
    cell = F.floor(F.col("pos") / near)
    first = index.join(_small(pairs), "term").select("row", "term", "term2", "pos", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    second = index.join(_small(stage(pairs.select(F.col("term2").alias("term")).distinct(), "seconds")), "term").select("row", F.col("term").alias("term2"), F.col("pos").alias("pos2"), cell.alias("cell"))
    return first.join(second, ["row", "term2", "cell"]).filter(F.abs(F.col("pos") - F.col("pos2")) <= near).select("row", "term", "term2", "pos", "pos2").distinct()


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact matches (row, start, size, items), proximity matches (row, phrase, items, start, last) and the texts (id, row, text).

    Proximity matches are phrases of two terms or more of which both rarest ones are within ``near`` words of each other. Matches may overlap.
    docs has doc_id and text, items item_id and text; other columns are ignored. Null and empty texts have no words, repeated rows count once.
    """
    near = max(near, window - 1)
    texts = anchored.own_texts(docs)
    looked_up = stage(phrases(items, window), "phrases")
    lead = stage(rarest(texts, looked_up), "lead")
    index = build_index(texts, lead)
    met = stage(meetings(index, lead, near), "meetings")
    two, one = _small(lead.filter("term2 is not null")), _small(lead.filter("term2 is null"))
    close = met.join(two, ["term", "term2"])
    found = close.filter(F.col("pos2") - F.col("pos") == F.col("off2") - F.col("off")).unionByName(index.join(one, "term").distinct(), allowMissingColumns=True)
    places = found.select("row", (F.col("pos") - F.col("off")).alias("start"), "phrase").filter("start >= 0")
    said = looked_up.select("phrase", "exact", "size", "items")
    listed = places.join(said, "phrase").groupBy("row").agg(F.collect_set(F.struct("start", "size", "exact", "items")).alias("places"))
    own = texts.join(listed, "row").select("row", words("text").alias("w"), "places")
    hit = F.filter("places", lambda p: F.array_join(F.slice("w", p["start"] + 1, p["size"]), " ") == p["exact"])
    exact = own.select("row", F.inline(F.transform(hit, lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size"), p["items"].alias("items"))))).distinct()
    nearby = close.select("row", "phrase", F.least("pos", "pos2").alias("start"), F.greatest("pos", "pos2").alias("last")).join(said.select("phrase", "items"), "phrase")
    return exact, nearby, texts


def _per_row(rows: DataFrame, **lists: Column) -> DataFrame:
    return rows.groupBy("row").agg(*[v.alias(k) for k, v in lists.items()])


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """(id, row, n_words, matches, near) for every row of docs: matches are (start, size, items) of each exact phrase occurrence, near the items with a proximity match.

    See ``search`` for inputs and odd cases.
    """
    exact, nearby, texts = search(docs, items, window, near)
    met = nearby.select("row", F.explode("items").alias("item")).distinct()
    both = _per_row(exact, matches=F.collect_list(F.struct("start", "size", "items"))).join(_per_row(met, near=F.sort_array(F.collect_list("item"))), "row", "full")
    counted = texts.select("id", "row", F.size(words("text")).cast("long").alias("n_words"))
    empty = F.array().cast("array<struct<start:int,size:int,items:array<string>>>")
    return counted.join(dealt_anew(both, "row"), "row", "left").select("id", "row", "n_words", F.coalesce("matches", empty).alias("matches"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    cells = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["size"] - 1))))
    r = r.select(anchored.real_id(), "n_words", F.size(cells).cast("long").alias("n_hit"), ids.alias("ids"), F.size("near").cast("long").alias("n_near"))
    return r.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an exact benchmark phrase, with their columns."""
    exact, _, _ = search(docs, table(spark, sf_dir, "benchmark"))
    whole = docs.select(F.struct("*").alias("document"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"))
    return whole.join(exact.select("row").distinct(), "row", "left_anti").select("document.*")


queries = {"op5_decontamination": op5_decontamination}
oracle_sql = {
    "op5_decontamination": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM p),
g AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM w, sizes, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS t(i)),
m AS (SELECT doc_id, i, g.size, item_id FROM g JOIN p USING (size, phrase)),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
pw AS (SELECT DISTINCT phrase, unnest(string_split(phrase, ' ')) AS word FROM p),
pf AS (SELECT pw.phrase, pw.word, coalesce(f.n, 0) AS n FROM pw LEFT JOIN (SELECT word, count(*) AS n FROM t GROUP BY word) f ON f.word = pw.word),
pr AS (SELECT phrase, word, row_number() OVER (PARTITION BY phrase ORDER BY n, word) AS k, min(n) OVER (PARTITION BY phrase) AS least FROM pf),
pp AS (SELECT DISTINCT p.item_id, x.word AS w1, y.word AS w2 FROM pr x JOIN pr y ON y.phrase = x.phrase AND y.k = 2 JOIN p ON p.phrase = x.phrase WHERE x.k = 1 AND x.least > 0),
pairs AS (SELECT DISTINCT w1, w2 FROM pp),
near AS (SELECT DISTINCT a.doc_id, w1, w2 FROM pairs JOIN t a ON a.word = w1 JOIN t b ON b.doc_id = a.doc_id AND b.word = w2 AND abs(b.pos - a.pos) <= 10),
c AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN pp USING (w1, w2) GROUP BY doc_id),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + size)) AS t(j) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
}
