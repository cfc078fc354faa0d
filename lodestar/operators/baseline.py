"""Parse-path baseline: content-token pairs near a known connective, decided by the majority of their label paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestar.functions.graph import FAR, of_row

RADIUS = 2
#: Tags of tokens that are no argument heads. By default commas and full stops are not among them.
STOP_TAGS = ("POS", "DT", "CC", "IN", "TO", "MD", ":", "``", "''", "-LRB-", "-RRB-")
STOP_LEMMAS = ("be", "have", "do")
KEY = ("lemmas", "cause_path", "effect_path")


def lexicon(instances: DataFrame, sentences: DataFrame | None) -> DataFrame:
    """Distinct lemma tuples of connectives, in token order. Without sentences, instances carry the tokens of theirs."""
    r = instances if sentences is None else instances.join(sentences.select("doc_id", "sent_id", "tokens"), ["doc_id", "sent_id"])
    lemma = lambda i: F.get(F.filter("tokens", lambda t: t["idx"] == i), F.lit(0))["lemma"]
    return r.filter(F.size("connective") > 0).select(F.transform(F.array_sort("connective"), lemma).alias("lemmas")).distinct()


def _connective(reach: dict[int, dict[int, list[str]]], places: list[list[int]], cause: int, effect: int) -> list[int] | None:
    """For each word its occurrence nearest to either argument; rejected if the other argument is beyond the radius.

    reach: for each occurrence the tokens within the radius and the paths to them.
    """
    chosen = []
    for at in places:
        c, e = _nearest(reach, at, cause), _nearest(reach, at, effect)
        best = e[0] if e[1] < c[1] else c[0]
        if cause not in reach[best] or effect not in reach[best]:
            return None
        chosen.append(best)
    return chosen if chosen == sorted(set(chosen)) else None


def _nearest(reach: dict[int, dict[int, list[str]]], at: Sequence[int], token: int) -> tuple[int, int]:
    """The occurrence closest to a token, the first of equals, and its distance (FAR beyond the radius)."""
    return min(((o, len(reach[o][token]) if token in reach[o] else FAR) for o in at), key=lambda x: x[1])


def pairs(sentences: DataFrame, lemmas: Sequence[Sequence[str]], radius: int = RADIUS, stop_punctuation: bool = False) -> DataFrame:
    """(doc_id, sent_id, cause, effect, connective, lemmas, cause_path, effect_path) for all ordered pairs of content tokens near a connective.

    lemmas: the learned lexicon, one tuple per connective type. The pairs of a sentence come from its own row.
    """
    entries = [list(x) for x in lemmas]
    stop = set(STOP_TAGS) | ({",", "."} if stop_punctuation else set())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, s, tokens, edges in zip(b["doc_id"], b["sent_id"], b["tokens"], b["edges"], strict=True):
                g = of_row(edges)
                where: dict[str, list[int]] = {}
                content = []
                reach: dict[int, dict[int, list[str]]] = {}
                for t in tokens:
                    if t["idx"] and t["idx"] in g.depth:
                        where.setdefault(t["lemma"], []).append(int(t["idx"]))
                        if t["pos"] not in stop and t["lemma"] not in STOP_LEMMAS:
                            content.append(int(t["idx"]))
                for entry in entries:
                    if not all(x in where for x in entry):
                        continue
                    for y in {y for word in entry for y in where[word]} - set(reach):
                        reach[y] = {y: [], **g.within(y, radius)}
                    around = {x for y in where[entry[0]] for x in reach[y]}
                    near = [x for x in content if x in around]
                    for c in near:
                        for e in near:
                            conn = _connective(reach, [where[x] for x in entry], c, e) if c != e else None
                            if conn is None or c in conn or e in conn:
                                continue
                            paths = [reach[_nearest(reach, conn, a)[0]].get(a) for a in (c, e)]
                            rows.append((d, s, c, e, conn, " ".join(entry), *["/".join(p) if p is not None else None for p in paths]))
            yield pd.DataFrame(rows, columns=["doc_id", "sent_id", "cause", "effect", "connective", *KEY])

    # only sentences with all words of an entry go to Python, and of their tokens what is read there
    words = F.transform("tokens", lambda t: t["lemma"])
    holds = F.lit(False)
    for entry in entries:
        holds = holds | (F.size(F.array_except(F.array(*map(F.lit, entry)), words)) == 0)
    light = F.transform("tokens", lambda t: F.struct(t["idx"].alias("idx"), t["lemma"].alias("lemma"), t["pos"].alias("pos")))
    return sentences.filter(holds).select("doc_id", "sent_id", light.alias("tokens"), "edges").mapInPandas(run, "doc_id string, sent_id int, cause int, effect int, connective array<int>, lemmas string, cause_path string, effect_path string")


def train(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Positives and negatives per (connective, paths). gold: (doc_id, sent_id, connective, cause_head, effect_head)."""
    key = ["doc_id", "sent_id", "connective", "cause", "effect"]
    yes = gold.select("doc_id", "sent_id", F.array_sort("connective").alias("connective"), F.col("cause_head").alias("cause"), F.col("effect_head").alias("effect")).distinct().withColumn("gold", F.lit(True))
    return candidates.join(yes, key, "left").groupBy(*KEY).agg(F.count_if("gold").alias("pos"), F.count_if(F.col("gold").isNull()).alias("neg"))


def predict(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates whose key has strictly more positives; unseen keys have none."""
    same = [candidates[k].eqNullSafe(counts[k]) for k in KEY]
    return candidates.join(counts.filter("pos > neg").select(*KEY), same, "left_semi")


def expand(candidates: DataFrame, sentences: DataFrame) -> DataFrame:
    """Arguments grown to their subtrees, without stop tokens, the connective and the other argument."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tokens, edges, conn, c, e in zip(b["tokens"], b["edges"], b["connective"], b["cause"], b["effect"], strict=True):
                g, tag = of_row(edges), {int(t["idx"]): t["pos"] for t in tokens}
                grow = lambda h, o: [x for x in g.closure(int(h), {int(y) for y in conn} | {int(o)}) if x == h or tag.get(x) not in STOP_TAGS]  # noqa: B023, E731
                rows.append((grow(c, e), grow(e, c)))
            out = b.drop(columns=["tokens", "edges"])
            out["cause"], out["effect"] = [r[0] for r in rows], [r[1] for r in rows]
            yield out

    schema = ", ".join(f"`{f.name}` {'array<int>' if f.name in ('cause', 'effect') else f.dataType.simpleString()}" for f in candidates.schema)
    joined = candidates.join(sentences.select("doc_id", "sent_id", "tokens", "edges"), ["doc_id", "sent_id"]).select(*candidates.columns, "tokens", "edges")
    return joined.mapInPandas(run, schema)


def combine(main: DataFrame, baseline: DataFrame) -> DataFrame:
    """The pipeline's instances and those of the baseline that have another (connective, cause head, effect head)."""
    key = ["doc_id", "sent_id", "connective", "cause_head", "effect_head"]
    on = [main[k].eqNullSafe(baseline[k]) for k in key]
    return main.unionByName(baseline.join(main, on, "left_anti"), allowMissingColumns=True)


__all__ = ["FAR", "combine", "expand", "lexicon", "pairs", "predict", "train"]
