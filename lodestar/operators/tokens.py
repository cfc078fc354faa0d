"""Token tables of raw text and what is derived from word order, without a shuffle: pairs and neighbours come from each text's own array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.functions.text import sentences, words

#: Connectives to look for in text without annotations, as this library chose them.
CONNECTIVES = ("as", "by", "for", "from", "in", "of", "that", "to", "when", "with")
#: Closed-class words, and words that open a complement clause.
CLOSED = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
COMPLEMENT = ("for", "that", "to")


def tokens(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, word): R01's rendering of each text's words, positions from 1."""
    return docs.select(*keys, F.posexplode(words("text")).alias("p", "word")).select(*keys, (F.col("p") + 1).alias("pos"), "word")


def sentence_table(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, sent_id, text): sentences in order, from 1."""
    return docs.select(*keys, F.posexplode(sentences("text")).alias("p", "text")).select(*keys, (F.col("p") + 1).alias("sent_id"), "text")


def ngrams(w: str | Column, gap: int) -> Column:
    """Arrays [first, second] of all words ``gap`` places apart."""
    c = F.col(w) if isinstance(w, str) else w
    n = F.size(c) - gap
    return F.when(n > 0, F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(1 + gap), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def skipgrams(rows: DataFrame, w: str | Column, *keys: str, skips: int = 1) -> DataFrame:
    """Pairs of words with at most ``skips`` between, one row each."""
    grams = F.concat(*[ngrams(w, g + 1) for g in range(skips + 1)])
    return rows.select(*keys, F.explode(grams).alias("g")).select(*keys, F.concat_ws(" ", "g.a", "g.b").alias("gram"))


def thresholded(grams: DataFrame, *keys: str, least: int = 4) -> DataFrame:
    """Counts of grams that occur under at least so many different keys (arguments, documents)."""
    once = grams.groupBy(*keys, "gram").agg(F.count("*").alias("k"))
    return once.groupBy("gram").agg(F.count("*").alias("holders"), F.sum("k").alias("n")).filter(F.col("holders") >= least)


def thresholded_rows(rows: DataFrame, w: str | Column, skips: int = 1, least: int = 4) -> DataFrame:
    """X34 where each row is one holder: a gram's first place within its row is marked there, so that the one shuffle is by gram, after partial counts."""
    grams = F.concat(*[ngrams(w, g + 1) for g in range(skips + 1)])
    g = rows.select(F.sort_array(F.transform(grams, lambda x: F.concat_ws(" ", x["a"], x["b"]))).alias("g"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "g"), F.lit(1), F.size("g"))
    marked = g.select(F.explode(F.zip_with("g", before, lambda x, y: F.struct(x.alias("gram"), (~x.eqNullSafe(y)).cast("int").alias("first")))).alias("m"))
    return marked.groupBy("m.gram").agg(F.sum("m.first").alias("holders"), F.count("*").alias("n")).filter(F.col("holders") >= least)


def contains_all(w: str | Column, wanted: Sequence[str]) -> Column:
    """Whether all words occur, however often; decided within the row."""
    have = F.col(w) if isinstance(w, str) else w
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), have)) == 0


def gapped(w: str | Column, first: str, second: str, most: int) -> Column:
    """Positions (from 1) of ``first`` for which ``second`` follows after at most ``most`` other words; nearest one."""
    c = F.col(w) if isinstance(w, str) else w
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda i: F.get(c, i - 1) == first)
    gap = F.transform(at, lambda i: F.struct(i.cast("long").alias("pos"), F.array_position(F.slice(c, i + 1, most + 1), second).alias("gap")))
    return F.filter(gap, lambda g: g["gap"] > 0)


def content_pairs(docs: DataFrame, radius: int, *keys: str, stop: Sequence[str] = CLOSED) -> DataFrame:
    """B02 to B04 on raw text: (keys, a, conn, b) for each connective between two content words, each within ``radius`` words of it.

    The nearest content word on either side counts; the window is read from the text's own array.
    """
    w = docs.select(*keys, words("text").alias("w"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.get("w", i - 1).isin(list(CONNECTIVES)))
    near = lambda a: F.get(F.filter(a, lambda x: ~x.isin(list(stop))), F.lit(0))
    hits = w.select(*keys, "w", at.alias("at")).select(*keys, F.explode(F.transform("at", lambda i: F.struct(
        near(F.reverse(F.slice("w", F.greatest(i - radius, F.lit(1)), F.least(i - 1, F.lit(radius))))).alias("a"), F.get("w", i - 1).alias("conn"), near(F.slice("w", i + 1, radius)).alias("b"),
    ))).alias("p"))
    return hits.filter("p.a is not null and p.b is not null").select(*keys, "p.a", "p.conn", "p.b")
