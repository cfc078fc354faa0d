"""Single relations: keys, names, categories, printable forms and reports, as column functions over instances joined with their sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.operators.analytics import remap
from lodestar.operators.metrics import prf
from lodestar.operators.patterns import SENT

#: Connectives that are counted under another name in agreement (a leading ``be`` is cut off first).
REMAPS = {
    "for too to": "too for to", "for too": "too for", "that now": "now that", "to for": "for to", "give": "given", "citizen-sparked": "spark", "encouraging": "encourage", "have to for to": "for to have to", "thank to": "thanks to",
    "on ground of": "on grounds of", "precipitating": "precipitate", "to need": "need to", "to need to": "need to to", "to take": "take to", "reason be": "reason", "result of": "result",
}
#: The same for counts over a corpus, in lower case.
CORPUS_REMAPS = {
    "for too to": "too for to", "for too": "too for", "that now": "now that", "to for": "for to", "give": "given", "citizen-sparked": "spark", "encouraging": "encourage", "have to for to": "for to have to", "thank to": "thanks to",
    "on grounds of": "on ground of", "precipitating": "precipitate", "to need": "need to", "to need to": "need to to", "to take": "take to", "HELPS": "help", "helps": "help", "on grounds that": "on ground that",
}
#: Names of grammatical categories.
COORDINATING, SUBORDINATING = "Conjunctive (coordinating)", "Conjunctive (subordinating)"


def token(i: Column) -> Column:
    return F.get(F.filter("tokens", lambda t: t["idx"] == i), F.lit(0))


def lemma_string(span: str = "connective") -> Column:
    """T05."""
    return F.array_join(F.transform(F.array_sort(span), lambda i: token(i)["lemma"]), " ")


def causation_key() -> Column:
    """(connective, cause head, effect head)."""
    return F.struct(F.array_sort("connective").alias("connective"), "cause_head", "effect_head")


def arguments() -> Column:
    """Argument arrays by name."""
    return F.create_map(F.lit("cause"), "cause", F.lit("effect"), "effect", F.lit("means"), "means")


def type_name() -> Column:
    """Causal type, UNKNOWN without one; types of an overlapping relation joined by +."""
    return F.when(F.size("overlap_types") > 0, F.array_join("overlap_types", "+")).otherwise(F.coalesce("causal_type", F.lit("UNKNOWN")))


def _verb_and_preposition() -> Column:
    tags = F.transform(F.array_sort("connective"), lambda i: token(i)["pos"])
    return (F.size("connective") == 2) & F.coalesce(F.get(tags, F.lit(0)).startswith("VB") & F.get(tags, F.lit(1)).isin("IN", "TO"), F.lit(False))


def not_contiguous() -> Column:
    """The connective has a gap; a verb with its preposition never counts."""
    return (F.array_max("connective") - F.array_min("connective") + 1 > F.size("connective")) & ~_verb_and_preposition()


def multi_word() -> Column:
    """More than one word, with the same exception."""
    return (F.size("connective") > 1) & ~_verb_and_preposition()


def text_of(span: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.coalesce(F.col(span), F.array().cast("array<int>"))), lambda i: token(i)["text"]), " ")


def printed() -> Column:
    """One line for a relation."""
    return F.format_string("%s(%s, cause=%s, effect=%s)", type_name(), text_of("connective"), text_of("cause"), text_of("effect"))


def highlighted(of: Column | None = None, texts: Column | None = None) -> Column:
    """The sentence with the connective in capitals and arguments marked ``/`` (cause) and ``*`` (effect).

    of: the instance, where it is a struct in its sentence's row; texts: those of ``tokens``, which lie at their indices. Only words from the first marked one to the last are looked at one by one.
    """
    texts = F.transform("tokens", lambda t: t["text"]) if texts is None else texts
    span = lambda c: F.coalesce(F.col(c) if of is None else of[c], F.array().cast("array<int>"))
    marked = F.filter(F.concat(*map(span, ("connective", "cause", "effect"))), lambda i: (i > 0) & (i < F.size(texts)))
    lo, hi = F.coalesce(F.array_min(marked), F.lit(1)), F.coalesce(F.array_max(marked), F.lit(0))
    within = lambda c, i: F.array_contains(span(c), i)
    sign = lambda i: F.when(within("cause", i), "/").when(within("effect", i), "*").otherwise("")
    shown = lambda t, k: F.concat(sign(lo + k), F.when(within("connective", lo + k), F.upper(t)).otherwise(t), sign(lo + k))
    return F.array_join(F.concat(F.slice(texts, F.lit(2), lo - 1), F.transform(F.slice(texts, lo + 1, hi - lo + 1), shown), F.slice(texts, hi + 2, F.size(texts))), " ")


def category() -> Column:
    """Grammatical category of a connective. Needs tokens, edges and connective_head."""
    span = F.array_sort("connective")
    lemmas, head = F.transform(span, lambda i: token(i)["lemma"]), token(F.col("connective_head"))
    first = token(F.get(span, F.lit(0)))
    into = F.get(F.transform(F.filter("edges", lambda e: e["dep"] == F.get(span, F.lit(0))), lambda e: e["label"]), F.lit(0))
    by_tag = lambda t, otherwise: (
        F.when(t == "CC", COORDINATING).when(t.isin("IN", "TO"), "Prepositional").when((t == "MD") | t.startswith("VB"), "Verbal").when(t.startswith("JJ"), "Adjectival")
        .when(t.startswith("RB"), "Adverbial").when(t.startswith("NN"), "Nominal").otherwise(otherwise)
    )
    n = F.size("connective")
    single = F.when((first["pos"] == "IN") & (into == "mark") & (first["lemma"] != "for"), SUBORDINATING).otherwise(by_tag(first["pos"], first["pos"]))
    two = F.array_join(lemmas, " ")
    odd = F.exists(span, lambda i: (i != F.col("connective_head")) & (~token(i)["pos"].isin("IN", "TO") | token(i)["lemma"].isin("as", "for")))
    gap = F.array_max("connective") - F.array_min("connective") + 1 > n
    tag = head["pos"]
    return (
        F.when((n == 1) | (F.get(lemmas, F.lit(1)) == "then"), single).when(two == "because of", "Adverbial").when(two.isin("thank to", "now that"), SUBORDINATING).when(two == "out of", "Prepositional")
        .when(F.array_contains(lemmas, "be") | odd, "Complex").when(tag.isin("IN", "TO") | tag.startswith("RB"), "Complex").when(tag.startswith("NN") & (n > 2), "Complex").when(tag.startswith("JJ") & gap, "Complex").otherwise(by_tag(tag, tag))
    )


def remapped_connective(name: str | Column) -> Column:
    """The name under which agreement counts a connective."""
    return remap(name, REMAPS, "be ")


def corpus_connective(name: str | Column) -> Column:
    """The name under which a corpus count has it."""
    return remap(F.lower(name), CORPUS_REMAPS)


def incoming_labels(instances: DataFrame, sentences: DataFrame | None, both: bool = False) -> DataFrame:
    """Labels into the heads of arguments, counted; instances carry cause_head and effect_head, and without sentences the edges of theirs."""
    r = instances.filter("cause_head is not null and effect_head is not null") if both else instances
    both_heads = F.array_compact(F.array("cause_head", "effect_head"))
    if sentences is None:
        h = r.select(F.explode(F.flatten(F.transform(both_heads, lambda x: F.filter("edges", lambda e: e["dep"] == x)))).alias("e"))
    else:
        h = r.select(*SENT, F.explode(both_heads).alias("h")).join(sentences.select(*SENT, "edges"), list(SENT)).select(F.explode(F.filter("edges", lambda e: e["dep"] == F.col("h"))).alias("e"))
    return h.groupBy(F.col("e.label").alias("label")).agg(F.count("*").alias("n"))


def differences(matches: DataFrame, properties: Sequence[str] = ("causal_type", "degree")) -> DataFrame:
    """What two annotators disagree on, a row for each: gold only, predicted only, and of matched pairs the arguments and properties that differ.

    The properties of overlapping relations are their types alone (``overlap_types``).
    """
    g, p = F.col("gold"), F.col("predicted")
    has = set(matches.schema["gold"].dataType.names)
    both = [F.when(~g[c].eqNullSafe(p[c]), c) for c in ("cause", "effect", *properties) if c in has]
    kinds = F.when(p.isNull(), F.array(F.lit("gold only"))).when(g.isNull(), F.array(F.lit("predicted only"))).otherwise(F.array_compact(F.array(*both)))
    return matches.select(*SENT, F.explode(kinds).alias("difference"), "gold", "predicted")


def csv_rows(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts with their shares, for write.csv."""
    return counts.select(*keys, "tp", "fp", "fn", *prf(*[F.col(c).cast("double") for c in ("tp", "fp", "fn")]), *[c for c in counts.columns if c == "jaccard"])
