"""Surface patterns: regular expressions over ``lemma/TAG`` renderings, learned from instances and searched with a resume rule."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestar.operators.graphs import in_sentences
from lodestar.operators.patterns import SENT, link

GAP = r"([\S]+ )+?"


def rendered(include_tags: bool = True):
    """A sentence's tokens as one string, each with a trailing blank."""
    one = lambda t: F.concat(t["lemma"], F.lit("/"), F.coalesce(t["pos"], F.lit("")), F.lit(" ")) if include_tags else F.concat(t["lemma"], F.lit(" "))
    return F.array_join(F.transform(F.filter("tokens", lambda t: t["idx"] > 0), one), "")


def pattern_of(tokens: Sequence[dict], connective: Sequence[int], cause: Sequence[int], effect: Sequence[int], include_tags: bool = True) -> tuple[str, list[int]]:
    """The regular expression of an instance and the group numbers of its connective tokens.

    Arguments and gaps within the connective are lazy runs of words; words outside both leave no trace. Lemmas are escaped.
    """
    conn, cause, effect = ({int(x) for x in (s if s is not None else ())} for s in (connective, cause, effect))
    parts, groups, group, before = [r"(^| )"], [], 1, None
    for t in tokens:
        i = int(t["idx"])
        if not i:
            continue
        kind = "Connective" if i in conn else "Cause" if i in cause else "Effect" if i in effect else None
        if kind == "Connective":
            group += 1
            groups.append(group)
            parts.append("(" + re.escape(f"{t['lemma']}/{t['pos']}" if include_tags else t["lemma"]) + ") ")
        elif kind != before and (kind is not None or min(conn) < i < max(conn)):
            group += 1
            parts.append(GAP)
        before = kind
    return "".join(parts), groups


def learn(instances: DataFrame, sentences: DataFrame | None, include_tags: bool = True) -> DataFrame:
    """Distinct (pattern, groups, lemmas); instances may lack arguments. Without sentences, instances are in ``rows`` of theirs (``in_sentences``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {}
            for tokens, conn, c, e in zip(b["tokens"], b["connective"], b["cause"], b["effect"], strict=True):
                by = {int(t["idx"]): t["lemma"] for t in tokens}
                pattern, groups = pattern_of(tokens, conn, c, e, include_tags)
                rows.setdefault(pattern, (pattern, groups, sorted({by[int(x)] for x in conn})))
            yield pd.DataFrame(list(rows.values()), columns=["pattern", "groups", "lemmas"])

    if sentences is None:
        r = instances.withColumn("rows", F.filter("rows", lambda r: F.size(r["connective"]) > 0))
    else:
        r = instances.filter("size(connective) > 0").select(*SENT, "connective", "cause", "effect")
    return in_sentences(r, sentences, ["tokens"], run, "pattern string, groups array<int>, lemmas array<string>").dropDuplicates(["pattern"])


def hits(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Repeated search; the next one begins at the end of the second group."""
    at = 0
    while at <= len(text) and (m := pattern.search(text, at)):
        yield m
        if m.end(2) <= at:
            return
        at = m.end(2)


def search(sentences: DataFrame, learned: Sequence[tuple[str, Sequence[int], Sequence[str]]], gold: DataFrame | None = None, include_tags: bool = True) -> DataFrame:
    """Candidates (no arguments yet) of a learned list of (pattern, groups, lemmas), only where all lemmas occur."""
    entries = [(p, re.compile(p), list(g), set(w)) for p, g, w in learned]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, s, tokens in zip(b["doc_id"], b["sent_id"], b["tokens"], strict=True):
                begin, text, have = {}, "", set()
                for t in tokens:
                    if t["idx"]:
                        begin[len(text)] = int(t["idx"])
                        have.add(t["lemma"])
                        text += f"{t['lemma']}/{t['pos'] or ''} " if include_tags else f"{t['lemma']} "
                for name, pattern, groups, words in entries:
                    if words <= have:
                        for m in hits(pattern, text):
                            at = [begin.get(m.start(g)) for g in groups]
                            if all(at):
                                rows.append((d, s, name, sorted(at)))
            yield pd.DataFrame(rows, columns=["doc_id", "sent_id", "pattern_id", "connective"])

    found = sentences.select(*SENT, "tokens").mapInPandas(run, "doc_id string, sent_id int, pattern_id string, connective array<int>")
    c = found.groupBy(*SENT, "connective").agg(F.array_sort(F.collect_set("pattern_id")).alias("patterns"))
    none = F.lit(None).cast("array<int>")
    return link(c.select(*SENT, F.array_join("connective", "-").alias("cand_id"), "patterns", F.lit(False).alias("has_steiner"), "connective", none.alias("cause"), none.alias("effect")), gold)
