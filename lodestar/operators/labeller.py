"""Argument labels for the tokens of a candidate's sentence: an averaged perceptron over label sequences, decoded by Viterbi.

It stands in for a conditional random field, of which no library is at hand. Training mixes parameters: each partition learns on its own, and
weights are averaged between rounds, so no sequence leaves its partition.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestar.functions.graph import of_row
from lodestar.operators.patterns import SENT

LABELS = ("Cause", "Effect", "None")
LONG_PATH = 4


def observe(tokens: Sequence[dict], graph, connective: Sequence[int], patterns: Sequence[str]) -> list[list[str]]:
    """Features of each token but ROOT: lemma, tag, path and distance to the connective, position, pattern."""
    conn, out = [int(x) for x in connective], []
    head = graph.head(conn)
    for t in tokens:
        i = int(t["idx"])
        if not i:
            continue
        near = min(conn, key=lambda c: abs(c - i))
        path = graph.path(head, i) if head is not None else None
        shown = "NO_PATH" if path is None else "LONG-RANGE" if len(path) > LONG_PATH else "/".join(path)
        rel = "in" if i in conn else "before" if i < min(conn) else "after" if i > max(conn) else "between"
        out.append([
            f"lemma={t['lemma']}", f"pos={t['pos']}", f"conn={i in conn}", f"path={shown}", f"dist={abs(near - i)}", f"signed={near - i}", f"parsed={i in graph.depth}",
            f"rel={rel}", f"alnum={str(t['text']).isalnum()}", *[f"pattern={p}" for p in patterns], *[f"pattern+path={p}+{shown}" for p in patterns],
        ])
    return out


def viterbi(features: Sequence[Sequence[str]], w: Mapping[str, float]) -> list[int]:
    """The best label sequence under emission weights ``label|feature`` and transition weights ``label>label``."""
    if not features:
        return []
    emit = [[sum(w.get(f"{y}|{f}", 0.0) for f in fs) for y in LABELS] for fs in features]
    step = [[w.get(f"{a}>{b}", 0.0) for b in LABELS] for a in LABELS]
    score, back = emit[0], []
    for e in emit[1:]:
        best = [max(range(len(LABELS)), key=lambda a: (score[a] + step[a][b], -a)) for b in range(len(LABELS))]
        score = [score[best[b]] + step[best[b]][b] + e[b] for b in range(len(LABELS))]
        back.append(best)
    y = max(range(len(LABELS)), key=lambda a: (score[a], -a))
    out = [y]
    for best in reversed(back):
        y = best[y]
        out.append(y)
    return out[::-1]


def _keys(features: Sequence[Sequence[str]], labels: Sequence[int]) -> Iterator[str]:
    for k, (fs, y) in enumerate(zip(features, labels, strict=True)):
        for f in fs:
            yield f"{LABELS[y]}|{f}"
        if k:
            yield f"{LABELS[labels[k - 1]]}>{LABELS[y]}"


def sequences(candidates: DataFrame, sentences: DataFrame) -> DataFrame:
    """Candidates with the tokens and edges of their sentence."""
    return candidates.join(sentences.select(*SENT, "tokens", "edges"), list(SENT))


def fit(candidates: DataFrame, gold: DataFrame, sentences: DataFrame, rounds: int = 5) -> dict[str, float]:
    """Weights from candidates with a gold instance, labelled Cause, else Effect, else None."""
    g = gold.select(*SENT, F.col("inst_id").alias("gold_inst_id"), F.col("cause").alias("g_cause"), F.col("effect").alias("g_effect"))
    rows = sequences(candidates.filter("gold_inst_id is not null").select(*SENT, "cand_id", "patterns", "connective", "gold_inst_id").join(g, [*SENT, "gold_inst_id"]), sentences).cache()
    weights: dict[str, float] = {}
    for _ in range(rounds):
        start = dict(weights)

        def learn(batches: Iterator[pd.DataFrame], start: dict = start) -> Iterator[pd.DataFrame]:
            w, total, n = defaultdict(float, start), defaultdict(float), 0
            for b in batches:
                for r in b.sort_values(["doc_id", "sent_id", "cand_id"]).itertuples():
                    fs = observe(r.tokens, of_row(r.edges), r.connective, r.patterns)
                    c, e = ({int(x) for x in (s if s is not None else ())} for s in (r.g_cause, r.g_effect))
                    want = [0 if int(t["idx"]) in c else 1 if int(t["idx"]) in e else 2 for t in r.tokens if t["idx"]]
                    got = viterbi(fs, w)
                    if got != want:
                        for k in _keys(fs, want):
                            w[k] += 1
                            total[k] += n
                        for k in _keys(fs, got):
                            w[k] -= 1
                            total[k] -= n
                    n += 1
            if n:
                yield pd.DataFrame([(k, v - total[k] / n, 1.0) for k, v in w.items()], columns=["k", "w", "n"])
                yield pd.DataFrame([("", 0.0, 1.0)], columns=["k", "w", "n"])

        learned = rows.mapInPandas(learn, "k string, w double, n double").groupBy("k").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()  # a model: one row per feature
        shards = next((r["n"] for r in learned if r["k"] == ""), 1.0)
        weights = {r["k"]: r["w"] / shards for r in learned if r["k"] and r["w"]}
    rows.unpersist()
    return weights


def label(candidates: DataFrame, sentences: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Candidates with cause and effect from decoded labels; an argument without tokens is null."""
    model = dict(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cause, effect = [], []
            for tokens, edges, conn, patterns in zip(b["tokens"], b["edges"], b["connective"], b["patterns"], strict=True):
                y = viterbi(observe(tokens, of_row(edges), conn, patterns), model)
                idx = [int(t["idx"]) for t in tokens if t["idx"]]
                for out, k in ((cause, 0), (effect, 1)):
                    out.append([i for i, v in zip(idx, y, strict=True) if v == k] or None)
            yield b.assign(cause=cause, effect=effect).drop(columns=["tokens", "edges"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    return sequences(candidates, sentences).select(*candidates.columns, "tokens", "edges").mapInPandas(run, schema)
