"""Features of relation candidates, as long rows (candidate, feature, value, number): one-hot, set, numeric and counted ones alike.

Extractors are functions of a ``View`` of one candidate in its sentence, held in a registry that callers may extend.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestar.functions.graph import SentenceGraph, graph_of, of_row, tense
from lodestar.operators.graphs import in_sentences
from lodestar.operators.patterns import SENT
from lodestar.operators.tokens import CLOSED
from lodestar.plans.staging import staged

MAX_WORDS, MAX_PATH, LEAST_HOLDERS = 10, 4, 4
ROW = "doc_id string, sent_id int, cand_id string, feature string, value string, number double"


class View:
    """A candidate and its sentence."""

    def __init__(self, row, hypernyms: Mapping[str, Sequence[str]], vectors: Mapping[str, Sequence[float]], ner: Mapping[int, str], graph: SentenceGraph | None = None):
        self.tokens = {int(t["idx"]): t for t in row.tokens}
        self.graph: SentenceGraph = graph or of_row(row.edges)
        self.patterns = list(row.patterns)
        self.args = {k: sorted(int(x) for x in getattr(row, k)) for k in ("connective", "cause", "effect")}
        self.head = {k: self.graph.head(v) for k, v in self.args.items()}
        self.hypernyms, self.vectors, self.ner = hypernyms, vectors, ner

    def tag(self, i: int) -> str:
        return str(self.tokens[i]["pos"])

    def cop_tag(self, i: int) -> str:
        return self.tag(i) + "<COP>" * bool(self.graph.children(i, "cop"))

    def path(self) -> list[str] | None:
        return self.graph.path(self.head["cause"], self.head["effect"])

    def closed(self, i: int) -> list[tuple[str, str]]:
        return sorted((d, self.tokens[d]["lemma"], x) for x, d in self.graph.out.get(i, ()) if self.tokens[d]["lemma"] in CLOSED)

    def vector(self, i: int) -> np.ndarray:
        return np.asarray(self.vectors.get(self.tokens[i]["lower"], self.vectors.get("UNKNOWN", [0.0])), float)


def rel_pos(a: Sequence[int], b: Sequence[int]) -> str:
    return "Before" if max(a) < min(b) else "After" if min(a) > max(b) else "Overlapping"


def words_between(v: View) -> float:
    return float(min(abs(v.head["cause"] - v.head["effect"]) - 1, MAX_WORDS))


def commas_between(v: View) -> float:
    c, e = v.args["cause"], v.args["effect"]
    if any(s[-1] - s[0] + 1 != len(s) for s in (c, e)) or rel_pos(c, e) == "Overlapping":
        return 0.0
    lo, hi = min(c[-1], e[-1]), max(c[0], e[0])
    return float(sum(v.tokens[i]["text"] == "," for i in range(lo + 1, hi)))


def skipgrams(items: Sequence[str], skips: int = 1) -> Counter:
    return Counter(f"{items[i]} {items[j]}" for i, j in combinations(range(len(items)), 2) if j - i <= skips + 1)


def cosine_distance(a: np.ndarray, b: np.ndarray) -> float | None:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return 1 - float(a @ b) / n if n else None


#: X01 to X36. A value is a string, a number, a set, or a mapping of names to numbers; null leaves the feature out.
EXTRACTORS: dict[str, Callable[[View], object]] = {
    "connective": lambda v: set(v.patterns),
    "cn_words": lambda v: " ".join(v.tokens[i]["lower"] for i in v.args["connective"]),
    "cn_lemmas": lambda v: " ".join(str(v.tokens[i]["lemma"]) for i in v.args["connective"]),
    "vector_dist": lambda v: float(np.linalg.norm(v.vector(v.head["cause"]) - v.vector(v.head["effect"]))),
    "vector_cos_dist": lambda v: cosine_distance(v.vector(v.head["cause"]), v.vector(v.head["effect"])),
    "wordsbtw": words_between,
    "deppath": lambda v: None if (p := v.path()) is None else "/".join(p) if len(p) <= MAX_PATH else "LONG-RANGE",
    "deps_on_path": lambda v: set(v.path() or ()),
    "deplen": lambda v: None if (p := v.path()) is None else float(len(p)),
    "cn_incoming_dep": lambda v: (v.graph.parent(v.head["connective"]) or (None,))[0],
    "cn_daughter_deps": lambda v: {x for x, _ in v.graph.out.get(v.head["connective"], ())},
    "verb_children_deps": lambda v: ",".join(sorted({x for _, d in v.graph.out.get(v.head["connective"], ()) for x, _ in v.graph.out.get(d, ())})) if v.tag(v.head["connective"]).startswith("VB") else "Non-verb",
    "cn_parent_pos": lambda v: v.cop_tag(p[1]) if (p := v.graph.parent(v.head["connective"])) and p[1] else None,
    "domination": lambda v: v.graph.domination(v.head["cause"], v.head["effect"]),
    "commas_btw": commas_between,
    "args_rel_pos": lambda v: rel_pos(v.args["cause"], v.args["effect"]),
    "heads_rel_pos": lambda v: rel_pos([v.head["cause"]], [v.head["effect"]]),
}


def _per_argument(name: str, f: Callable[[View, int, list[int]], object]) -> None:
    for a in ("cause", "effect"):
        EXTRACTORS[f"{a}_{name}"] = lambda v, a=a: f(v, v.head[a], v.args[a])


_per_argument("hypernyms", lambda v, h, s: set(v.hypernyms.get(v.tokens[h]["lemma"], ())))
_per_argument("vector", lambda v, h, s: {str(k): x for k, x in enumerate(v.vector(h).tolist())})
_per_argument("pos", lambda v, h, s: v.cop_tag(h))
_per_argument("pos_bigram", lambda v, h, s: f"{v.tag(h - 1) if h > 1 else 'NONE'} {v.tag(h)}")
_per_argument("pos_gen", lambda v, h, s: v.tokens[h]["gen_pos"])
_per_argument("tense", lambda v, h, s: tense(v.graph, v.tokens, h))
_per_argument("daughter_deps", lambda v, h, s: {x for x, _ in v.graph.out.get(h, ())})
_per_argument("all_closed_children", lambda v, h, s: " ".join(w for _, w, _ in v.closed(h)))
_per_argument("closed_children", lambda v, h, s: {w for _, w, _ in v.closed(h)})
_per_argument("all_closed_children_deps", lambda v, h, s: " ".join(f"{w}/{x}" for _, w, x in v.closed(h)))
_per_argument("closed_children_deps", lambda v, h, s: {f"{w}/{x}" for _, w, x in v.closed(h)})
_per_argument("ner", lambda v, h, s: v.ner.get(h))
_per_argument("len", lambda v, h, s: float(len(s)))
_per_argument("neg", lambda v, h, s: float(bool(v.graph.children(h, "neg"))))
_per_argument("neg_child", lambda v, h, s: float(any(v.tokens[d]["gen_pos"] == "NN" and v.graph.children(d, "neg") for d in v.graph.children(h))))
_per_argument("comp", lambda v, h, s: float((v.graph.parent(h) or ("",))[0] == "ccomp"))
_per_argument("comp_start", lambda v, h, s: float(v.tokens[s[0]]["lemma"] in ("that", "for", "to")))
_per_argument("prep_start", lambda v, h, s: v.tokens[s[0]]["lemma"] if v.tag(s[0]) == "IN" else "None")
_per_argument("ner_distances", lambda v, h, s: {t: float(next((k for k, i in enumerate(s) if v.ner.get(i) == t), -1)) for t in ("Person", "Organization", "Location", "O")})
_per_argument("pos_skipgrams", lambda v, h, s: skipgrams([v.tag(i) for i in s]))
_per_argument("lemma_skipgrams", lambda v, h, s: skipgrams([str(v.tokens[i]["lemma"]) for i in s]))
_per_argument("case_children", lambda v, h, s: {str(v.tokens[d]["lemma"]) for d in v.graph.children(h, "case")})

#: Used unless others are named.
DEFAULT = ("cn_lemmas", "connective", "cause_pos", "effect_pos", "wordsbtw", "deppath", "deplen", "cause_tense", "effect_tense", "cn_incoming_dep", "domination", "commas_btw", "cause_len", "effect_len", "args_rel_pos", "cause_prep_start", "effect_prep_start", "cause_neg", "effect_neg", "cn_lemmas:deppath")


def log_bin(x: float) -> int:
    """``round(ln(10 (x + 1)))``, half away from zero."""
    return math.floor(math.log(10 * (x + 1)) + 0.5)


def values(v: View, name: str) -> list[tuple[str, float | None]]:
    """(value, number) pairs of a feature; ``a:b`` is the cross of two, numbers binned."""
    if ":" in name:
        sides = [[(x if n is None else f"{x}{log_bin(n)}") for x, n in values(v, part)] for part in name.split(":")]
        out = [""]
        for side in sides:
            out = [f"{o}:{x}" if o else x for o in out for x in side]
        return [(x, None) for x in out]
    got = EXTRACTORS[name](v)
    if got is None:
        return []
    if isinstance(got, float):
        return [("", got)]
    if isinstance(got, Mapping):
        return [(k, float(n)) for k, n in sorted(got.items())]
    if isinstance(got, (set, frozenset)):
        return [(x, None) for x in sorted(got)]
    return [(str(got), None)]


def extract(candidates: DataFrame, sentences: DataFrame, names: Sequence[str] = DEFAULT, hypernyms: Mapping | None = None, vectors: Mapping | None = None, ner: DataFrame | None = None) -> DataFrame:
    """ROW rows of candidates that have both arguments (F01). ner: (doc_id, sent_id, ner map<int,string>), N01's tags from any tagger. Without sentences, candidates are in ``rows`` of their sentences (``in_sentences``)."""
    if sentences is None:
        rows = candidates.withColumn("rows", F.filter("rows", lambda r: (F.size(r["cause"]) > 0) & (F.size(r["effect"]) > 0)))
    else:
        rows = candidates.filter("size(cause) > 0 and size(effect) > 0").select(*SENT, "cand_id", "patterns", "connective", "cause", "effect")
    carried = ["tokens", "edges"]
    if ner is not None:
        rows = rows.join(ner, list(SENT), "left")
        carried += ["ner"] * (sentences is None)
    names, hypernyms, vectors = list(names), dict(hypernyms or {}), dict(vectors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            graphs = graph_of()
            for r in b.itertuples():
                v = View(r, hypernyms, vectors, dict(tags) if (tags := getattr(r, "ner", None)) is not None else {}, graphs(r.edges))
                out += [(r.doc_id, r.sent_id, r.cand_id, n, x, k) for n in names for x, k in values(v, n)]
            yield pd.DataFrame(out, columns=["doc_id", "sent_id", "cand_id", "feature", "value", "number"])

    got = in_sentences(rows, sentences, carried, run, ROW)
    grams = [n for n in names if n.endswith("lemma_skipgrams")]
    return rare_dropped(staged(got), grams) if grams else got  # read twice


def rare_dropped(rows: DataFrame, names: Sequence[str], least: int = LEAST_HOLDERS) -> DataFrame:
    """Of the named features keep values that at least so many candidates have."""
    few = rows.filter(F.col("feature").isin(list(names))).groupBy("feature", "value").agg(F.count("*").alias("n")).filter(F.col("n") < least).select("feature", "value")
    return rows.join(few, ["feature", "value"], "left_anti").select(*rows.columns)
