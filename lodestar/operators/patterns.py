"""Tree patterns: edge rewriting, induction from annotated instances, and matching as a conjunctive query.

A pattern is two small tables: its nodes (with roles, and lemma and coarse tag where they must match) and its edge tests, in an order in which each one
has an end that is bound already. All patterns are matched together, within the row of a sentence.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestar.functions.graph import SentenceGraph, active, graph_of
from lodestar.operators.filtering import ranked
from lodestar.operators.graphs import in_sentences
from lodestar.schema import general_tag

MAX_STEINERS = 6
#: Labels that stand for each other in patterns; any label also matches ``dep``.
TWINS = {"nsubj": "csubj", "csubj": "nsubj", "nsubjpass": "csubjpass", "csubjpass": "nsubjpass"}
SENT = ("doc_id", "sent_id")
PATTERN = "pattern_id string, nodes array<struct<node:int,roles:array<string>,lemma:string,gen_pos:string>>, steps array<struct<a:int,b:int,labels:array<string>>>, steiners int"


# --- P12


_EDGES = T.ArrayType(T.StructType([T.StructField("head", T.IntegerType()), T.StructField("dep", T.IntegerType()), T.StructField("label", T.StringType())]))


@F.arrow_udf(_EDGES)
def _rewritten(edges: pa.Array, tokens: pa.Array) -> pa.Array:
    one = lambda e, t: None if e is None else [{"head": h, "dep": d, "label": x} for h, d, x in active(e, {k["idx"]: k for k in t})]
    return pa.array([one(e, t) for e, t in zip(edges.to_pylist(), tokens.to_pylist(), strict=True)], edges.type)


def activated(sentences: DataFrame) -> DataFrame:
    """Sentences whose edges are rewritten so that passives and reduced relatives look active.

    Within the row: no shuffle, and only sentences with a passive subject or a clause on a noun go to Python.
    """
    concerned = F.exists("edges", lambda e: e["label"].isin("nsubjpass", "acl"))
    light = F.transform("tokens", lambda t: F.struct(t["idx"].alias("idx"), t["lemma"].alias("lemma"), t["pos"].alias("pos")))
    new = _rewritten(F.when(concerned, F.col("edges")), F.when(concerned, light))
    return sentences.withColumn("edges", F.coalesce(new, "edges", F.array().cast("array<struct<head:int,dep:int,label:string>>")))


# --- P01 to P11


def _pattern(graph: SentenceGraph, tokens: dict, connective: list[int], cause: int, effect: int, max_steiners: int, argument_tags: bool = False) -> tuple | None:
    linked = {x for h in graph.out for x in (h, *(d for _, d in graph.out[h]))} - {0}
    conn = [x for x in connective if x in linked]
    if not conn or cause not in linked or effect not in linked or cause == effect:
        return None
    required = {cause, effect, *conn}
    tree = graph.steiner(required)
    if not tree or len(tree - required) > max_steiners:
        return None
    roles: dict[int, list[str]] = {x: [] for x in tree}
    for k, x in enumerate(sorted(conn)):
        roles[x].append(f"connective_{k}")
    roles[cause].append("cause")
    roles[effect].append("effect")
    for k, x in enumerate(sorted(tree - required)):
        roles[x].append(f"steiner_{k}")
    order = sorted(tree, key=lambda x: roles[x])
    number = {x: i for i, x in enumerate(order)}
    nodes = []
    for x in order:
        fixed = any(r.startswith("connective") for r in roles[x])
        tagged = fixed or (argument_tags and x in (cause, effect))
        nodes.append({"node": number[x], "roles": sorted(roles[x]), "lemma": tokens[x]["lemma"] if fixed else None, "gen_pos": tokens[x]["gen_pos"] if tagged else None})
    steps, bound, todo = [], {sorted(conn)[0]}, [(h, d, label) for h in sorted(tree) for label, d in graph.out.get(h, ()) if d in tree]
    while todo:
        ready = [t for t in todo if t[0] in bound or t[1] in bound]
        if not ready:
            return None
        # tests between bound nodes first, as they only filter
        h, d, label = min(ready, key=lambda t: (not (t[0] in bound and t[1] in bound), number[t[0]], number[t[1]], t[2]))
        todo.remove((h, d, label))
        bound |= {h, d}
        steps.append({"a": number[h], "b": number[d], "labels": sorted({label, *([TWINS[label]] if label in TWINS else []), *(["dep"] if label != "dep" else [])})})
    return nodes, steps, len(tree - required)


def induce(instances: DataFrame, sentences: DataFrame | None, max_steiners: int = MAX_STEINERS, argument_tags: bool = False) -> DataFrame:
    """Distinct patterns (PATTERN) of instances that have a cause and an effect, the first occurrence of each. With ``argument_tags`` tags of arguments must match, too. Without sentences, instances are in ``rows`` of theirs (``in_sentences``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, graphs = {}, graph_of()
            for d, s, i, toks, edges, conn, c, f in zip(b["doc_id"], b["sent_id"], b["inst_id"], b["tokens"], b["edges"], b["connective"], b["cause"], b["effect"], strict=True):
                g = graphs(edges)
                c, f = g.head(c), g.head(f)
                found = None if c is None or f is None else _pattern(g, {int(t["idx"]): t for t in toks}, [int(x) for x in conn], c, f, max_steiners)
                if found:
                    text = json.dumps(found, sort_keys=True)
                    if text not in rows or (d, s, i) < rows[text][:3]:  # the first of each batch is enough
                        rows[text] = (d, s, i, hashlib.sha256(text.encode()).hexdigest()[:16], *found)
            yield pd.DataFrame(list(rows.values()), columns=["doc_id", "sent_id", "inst_id", "pattern_id", "nodes", "steps", "steiners"])

    if sentences is None:
        own = instances.withColumn("rows", F.filter("rows", lambda r: (F.size(r["cause"]) > 0) & (F.size(r["effect"]) > 0)))
    else:
        own = instances.filter("size(cause) > 0 and size(effect) > 0").select(*SENT, "inst_id", "connective", "cause", "effect")
    rows = in_sentences(own, sentences, ["tokens", "edges"], run, f"doc_id string, sent_id int, inst_id string, {PATTERN}")
    return ranked(rows, ["pattern_id"], "doc_id", "sent_id", "inst_id").select("pattern_id", "nodes", "steps", "steiners")


def _extended(tokens: dict, below: dict, above: dict, edges: list, nodes: list, steps: list, at: list) -> list[list]:
    """All bindings of a pattern's nodes that begin with ``at``, a step for each edge test."""
    fits = lambda n, i: i in tokens and (nodes[n]["lemma"] is None or tokens[i]["lemma"] == nodes[n]["lemma"]) and (nodes[n]["gen_pos"] is None or tokens[i]["gen_pos"] == nodes[n]["gen_pos"])
    states = [at]
    for step in steps:
        a, b, labels = step["a"], step["b"], step["labels"]
        after = []
        for x in states:
            h, d = x[a], x[b]
            for head, dep, label in below.get(h, ()) if h is not None else above.get(d, ()) if d is not None else edges:
                if label not in labels or (d is not None and d != dep):
                    continue
                y = list(x)
                y[a], y[b] = head, dep
                bound = [i for i in y if i is not None]
                if len(set(bound)) == len(bound) and fits(a, head) and fits(b, dep):
                    after.append(y)
        states = after
    return states


def match(sentences: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pattern_id, steiners, connective, cause, effect), one match for each root, the lowest indices.

    The patterns are a model and are collected. A sentence that has all lemmas of one is searched from each token that may be its first
    connective word, by lemma and tag, along its own edges: nothing is shuffled.
    """
    learned: dict[tuple, list] = {}
    for p in patterns.select("pattern_id", "nodes", "steps", "steiners").collect():
        nodes = sorted((n.asDict() for n in p["nodes"]), key=lambda n: n["node"])
        named = lambda r: [n["node"] for n in nodes if r in n["roles"]]  # noqa: B023, E731
        conn = [n["node"] for n in nodes if any(r.startswith("connective") for r in n["roles"])]
        for root in named("connective_0")[:1]:
            entry = (p["pattern_id"], p["steiners"], nodes, [x.asDict() for x in p["steps"]], {n["lemma"] for n in nodes} - {None}, root, conn, named("cause")[:1], named("effect")[:1])
            learned.setdefault((nodes[root]["lemma"], nodes[root]["gen_pos"]), []).append(entry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, s, toks, links in zip(b["doc_id"], b["sent_id"], b["tokens"], b["edges"], strict=True):
                starts = [(t["idx"], e) for t in toks for e in learned.get((t["lemma"], t["gen_pos"]), ())]
                if not starts:
                    continue
                tokens, have = {t["idx"]: t for t in toks}, {t["lemma"] for t in toks}
                edges = [(e["head"], e["dep"], e["label"]) for e in (links if links is not None else ())]
                below, above = {}, {}
                for e in edges:
                    below.setdefault(e[0], []).append(e)
                    above.setdefault(e[1], []).append(e)
                for start, (name, steiners, nodes, steps, lemmas, root, conn, cause, effect) in starts:
                    if lemmas <= have:
                        found = [x for x in _extended(tokens, below, above, edges, nodes, steps, [start if n == root else None for n in range(len(nodes))]) if cause and effect and None not in (x[cause[0]], x[effect[0]]) and x[cause[0]] != x[effect[0]]]
                        if found:
                            x = min(found, key=lambda y: [-1 if i is None else i for i in y])
                            rows.append((d, s, name, steiners, sorted(x[n] for n in conn if x[n] is not None), x[cause[0]], x[effect[0]]))
            yield pd.DataFrame(rows, columns=["doc_id", "sent_id", "pattern_id", "steiners", "connective", "cause", "effect"])

    light = F.transform("tokens", lambda t: F.struct(t["idx"].alias("idx"), t["lemma"].alias("lemma"), t["gen_pos"].alias("gen_pos")))
    return sentences.select(*SENT, light.alias("tokens"), "edges").mapInPandas(run, "doc_id string, sent_id int, pattern_id string, steiners int, connective array<int>, cause int, effect int")


_VIEW = T.StructType([T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("lemma", T.StringType()), T.StructField("gen_pos", T.StringType())]))), T.StructField("edges", _EDGES)])
_SPAN = T.ArrayType(T.IntegerType())


@F.arrow_udf(_VIEW)
def _phrases(nodes: pa.Array) -> pa.Array:
    def one(rows):
        word = {n["parent"]: n["label"] for n in rows if n["leaf"] is not None}
        inner = [n for n in rows if n["leaf"] is None]
        tag = lambda n: general_tag(n["label"]) if n["node"] in word else n["label"]
        tokens = [{"idx": n["node"] + 1, "lemma": word.get(n["node"]), "gen_pos": tag(n)} for n in inner]
        return {"tokens": tokens, "edges": [{"head": 0 if n["parent"] is None else n["parent"] + 1, "dep": n["node"] + 1, "label": "root" if n["parent"] is None else "<"} for n in inner]}

    edge = pa.struct([("head", pa.int32()), ("dep", pa.int32()), ("label", pa.string())])
    token = pa.struct([("idx", pa.int32()), ("lemma", pa.string()), ("gen_pos", pa.string())])
    return pa.array([one(n or []) for n in nodes.to_pylist()], pa.struct([("tokens", pa.list_(token)), ("edges", pa.list_(edge))]))


@F.arrow_udf(_SPAN)
def _covering(nodes: pa.Array, span: pa.Array) -> pa.Array:
    """The lowest phrase over all words of a span, as an array of one."""

    def one(rows, words):
        above = {n["node"]: n["parent"] for n in rows}
        common: list[int] | None = None
        for n in rows:
            if n["leaf"] in words and n["leaf"] is not None:
                line, x = [], n["parent"]
                while x is not None:
                    line.append(x)
                    x = above[x]
                common = line if common is None else [x for x in common if x in line]
        return [common[0] + 1] if common else None

    return pa.array([one(n or [], set(w or [])) for n, w in zip(nodes.to_pylist(), span.to_pylist(), strict=True)], pa.list_(pa.int32()))


@F.arrow_udf(_SPAN)
def _words(nodes: pa.Array, phrases: pa.Array) -> pa.Array:
    """The words below some phrases."""

    def one(rows, wanted):
        within, found = set(wanted), []
        for n in rows:  # parents come first
            if n["parent"] is not None and n["parent"] + 1 in within:
                within.add(n["node"] + 1)
                if n["leaf"] is not None:
                    found.append(n["leaf"])
        return sorted(found)

    return pa.array([one(n or [], w or []) for n, w in zip(nodes.to_pylist(), phrases.to_pylist(), strict=True)], pa.list_(pa.int32()))


def phrase_trees(sentences: DataFrame) -> DataFrame:
    """Sentences seen as phrase-structure trees, for ``induce`` and ``match``: phrases are tokens (numbered from 1), edges go down, the lemma of a word's own phrase is the word."""
    return sentences.withColumn("_v", _phrases("nodes")).withColumns({"tokens": F.col("_v.tokens"), "edges": F.col("_v.edges")}).drop("_v")


def on_phrases(instances: DataFrame, sentences: DataFrame) -> DataFrame:
    """Instances over ``phrase_trees``: each connective word is its own phrase, each argument the lowest one that covers it."""
    r = instances.join(sentences.select(*SENT, "nodes"), list(SENT))
    own = lambda w: F.get(F.filter("nodes", lambda n: n["leaf"] == w), F.lit(0))["parent"] + 1
    r = r.withColumn("_w", F.array_sort(F.transform("connective", own))).withColumns({c: _covering("nodes", c) for c in ("cause", "effect")})
    return r.withColumn("connective", F.col("_w")).drop("_w", "nodes").select(*instances.columns)


def on_words(matches: DataFrame, sentences: DataFrame) -> DataFrame:
    """Matches over ``phrase_trees`` as words again; arguments are all words of their phrases."""
    r = matches.join(sentences.select(*SENT, "nodes"), list(SENT))
    return r.withColumns({"connective": _words("nodes", "connective"), "cause": _words("nodes", F.array("cause")), "effect": _words("nodes", F.array("effect"))}).select(*matches.columns)


def candidates(matches: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """One candidate for each (connective, cause, effect) with its patterns, linked to the gold instance of the same connective."""
    c = matches.groupBy(*SENT, "connective", "cause", "effect").agg(F.array_sort(F.collect_set("pattern_id")).alias("patterns"), F.max(F.col("steiners") > 0).alias("has_steiner"))
    whole = isinstance(matches.schema["cause"].dataType, T.ArrayType)
    name = lambda x: F.array_join(x, "-") if whole else F.col(x).cast("string")
    span = lambda x: (F.col(x) if whole else F.array(x)).alias(x)
    c = c.select(*SENT, F.concat_ws("|", F.array_join("connective", "-"), name("cause"), name("effect")).alias("cand_id"), "patterns", "has_steiner", "connective", span("cause"), span("effect"))
    return link(c, gold)


def link(c: DataFrame, gold: DataFrame | None) -> DataFrame:
    """Column gold_inst_id: the last gold instance with exactly the candidate's connective and two arguments."""
    if gold is None:
        return c.withColumn("gold_inst_id", F.lit(None).cast("string"))
    two = gold.filter("size(cause) > 0 and size(effect) > 0").select(*SENT, F.array_sort("connective").alias("connective"), F.col("inst_id").alias("gold_inst_id"))
    return c.join(two.groupBy(*SENT, "connective").agg(F.max("gold_inst_id").alias("gold_inst_id")), [*SENT, "connective"], "left").select(*c.columns, "gold_inst_id")
