"""Graph operators over sentences; each sentence row holds its whole graph, so none of these shuffles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField

from lodestar.functions.graph import FAR, bracketed, graph_of, of_row


def depths(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, idx, depth): distance from ROOT; tokens outside the parse are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, s, i, n) for d, s, e in zip(b["doc_id"], b["sent_id"], b["edges"], strict=True) for i, n in of_row(e).depth.items()], columns=["doc_id", "sent_id", "idx", "depth"])

    return sentences.select("doc_id", "sent_id", "edges").mapInPandas(run, "doc_id string, sent_id int, idx int, depth int")


def paths(sentences: DataFrame, radius: int) -> DataFrame:
    """(doc_id, sent_id, a, b, labels): shortest label paths of at most ``radius`` edges between all tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, s, e in zip(b["doc_id"], b["sent_id"], b["edges"], strict=True):
                g = of_row(e)
                rows += [(d, s, x, y, p) for x in sorted(set(g.depth) - {0}) for y, p in sorted(g.within(x, radius).items()) if y in g.depth]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_id", "a", "b", "labels"])

    return sentences.select("doc_id", "sent_id", "edges").mapInPandas(run, "doc_id string, sent_id int, a int, b int, labels array<string>")


def path_counts(sentences: DataFrame, radius: int) -> DataFrame:
    """(labels, n): ``paths`` counted by labels. Each batch is counted before it leaves Python, so that pairs of tokens are never rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for e in b["edges"]:
                g = of_row(e)
                near = {x: _steps(g, x) for x in g.depth if x}
                if radius == 2:
                    for x, first in near.items():
                        done = {x: None}
                        for y, label in first:
                            if y not in done:
                                done[y] = label
                        level = [(y, label) for y, label in done.items() if y != x]
                        seen.update([(label,) for y, label in level if y in g.depth])
                        for y, label in level:
                            for z, more in near.get(y) or _steps(g, y):
                                if z not in done:
                                    done[z] = more
                                    if z in g.depth:
                                        seen[label, more] += 1
                else:
                    seen.update(tuple(p) for x in near for y, p in g.within(x, radius).items() if y in g.depth)
            yield pd.DataFrame([(list(k), n) for k, n in seen.items()], columns=["labels", "n"])

    counts = sentences.select("edges").mapInPandas(run, "labels array<string>, n long")
    return counts.groupBy("labels").agg(F.sum("n").alias("n"))


def _steps(g, x: int) -> list[tuple[int, str]]:
    return sorted([(y, label) for label, y in g.out.get(x, ()) if y] + [(y, label + "^") for label, y in g.into.get(x, ()) if y])


def with_sentences(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """Rows (doc_id, sent_id, ...) with the tokens and edges of their sentence."""
    return rows.join(sentences.select("doc_id", "sent_id", "tokens", "edges"), ["doc_id", "sent_id"])


def _flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        lists = [list(x) for x in b["rows"]]
        out = b.drop(columns="rows").iloc[np.repeat(np.arange(len(b)), [len(x) for x in lists])].reset_index(drop=True)
        rows = [r for x in lists for r in x]
        if rows:
            yield out.assign(**{c: pd.Series([r[c] for r in rows], dtype=object) for c in rows[0]})


def in_sentences(rows: DataFrame, sentences: DataFrame | None, carried: Sequence[str], run: Callable, schema: str) -> DataFrame:
    """``run`` as mapInPandas over rows with the carried columns of their sentence.

    Without sentences, rows are sentences themselves, and ``rows`` there is the array of what would be joined with them: nothing is shuffled, and a sentence goes to Python once.
    """
    if sentences is None:
        return rows.select("doc_id", "sent_id", *carried, "rows").mapInPandas(lambda b: run(_flat(b)), schema)
    return rows.join(sentences.select("doc_id", "sent_id", *carried), ["doc_id", "sent_id"]).select(*rows.columns, *carried).mapInPandas(run, schema)


def own_columns(rows: DataFrame, sentences: DataFrame | None) -> list[StructField]:
    """Fields of rows as ``in_sentences`` hands them over, without what is carried."""
    if sentences is not None:
        return list(rows.schema)
    return [rows.schema["doc_id"], rows.schema["sent_id"], *rows.schema["rows"].dataType.elementType]


def _depths(edges) -> list[int | None]:
    """Depth of each token by its index; null where there is no way from ROOT."""
    depth = of_row(edges).depth
    return [depth.get(i) for i in range(max(depth) + 1)]


@F.arrow_udf(ArrayType(IntegerType()))
def depth_array(edges: pa.Array) -> pa.Array:
    return pa.array([_depths(e) for e in edges.to_pylist()], pa.list_(pa.int32()))


def head_of(span: str | Column, depths: str | Column = "depths") -> Column:
    """The shallowest token of a span, the first of equals."""
    return F.array_min(F.transform(span, lambda i: F.struct(F.coalesce(F.get(depths, i), F.lit(FAR)).alias("d"), i.alias("i"))))["i"]


def heads(rows: DataFrame, sentences: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """A column ``x_head`` for each token array x. Without sentences, rows carry ``depths`` of theirs (``depth_array``)."""
    found = {f"{c}_head": head_of(c) for c in columns}
    if sentences is None:
        return rows.withColumns(found)
    return rows.join(sentences.select("doc_id", "sent_id", depth_array("edges").alias("depths")), ["doc_id", "sent_id"]).select(*rows.columns, "depths").withColumns(found).drop("depths")


def expand_spans(candidates: DataFrame, sentences: DataFrame | None, skip_first: Sequence[str] = ()) -> DataFrame:
    """Each argument becomes its head and all below it, short of the other argument's head and the connective.

    A missing argument stays missing. ``skip_first``: labels that aren't followed from the head (conj, cc, parataxis in the older variant).
    ``moved`` says whether an argument's head is no longer the one it had.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cause, effect, moved = [], [], []
            graphs = graph_of()
            for e, conn, c, f in zip(b["edges"], b["connective"], b["cause"], b["effect"], strict=True):
                g = graphs(e)
                hc, hf = g.head(c), g.head(f)
                grow = lambda h, o: None if h is None else g.closure(h, {int(x) for x in conn} - {h} | ({o} - {h} if o is not None else set()), skip_first)  # noqa: B023, E731
                nc, nf = grow(hc, hf), grow(hf, hc)
                cause.append(nc)
                effect.append(nf)
                moved.append((nc is not None and g.head(nc) != hc) or (nf is not None and g.head(nf) != hf))
            yield b.assign(cause=cause, effect=effect, moved=moved).drop(columns=["edges"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own_columns(candidates, sentences)] + ["moved boolean"])
    return in_sentences(candidates, sentences, ["edges"], run, schema)


def bracketed_strings(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, line)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "sent_id": b["sent_id"], "line": [bracketed(list(t), list(e)) for t, e in zip(b["tokens"], b["edges"], strict=True)]})

    return sentences.select("doc_id", "sent_id", "tokens", "edges").mapInPandas(run, "doc_id string, sent_id int, line string")


def dot_lines(sentences: DataFrame) -> DataFrame:
    """The graph as a DOT document, in column operations."""
    name = lambda i: F.format_string("n%d", i)
    nodes = F.transform("tokens", lambda t: F.concat(name(t["idx"]), F.lit(' [label="'), F.regexp_replace(t["text"], '"', "'"), F.lit('"];')))
    edges = F.transform("edges", lambda e: F.concat(name(e["head"]), F.lit(" -> "), name(e["dep"]), F.lit(' [label="'), e["label"], F.lit('"];')))
    return sentences.select("doc_id", "sent_id", F.concat(F.lit("digraph {\n"), F.array_join(F.concat(nodes, edges), "\n"), F.lit("\n}")).alias("dot"))


def lemmas_in_arguments(candidates: DataFrame, gold: DataFrame, sentences: DataFrame | None) -> DataFrame:
    """Distinct (pattern_id, lemma) of connective words that lie inside an argument of the gold instance their candidate is linked to. Without sentences, candidates carry the tokens of theirs."""
    own = ["tokens"] if sentences is None else []
    g = gold.select("doc_id", "sent_id", F.col("inst_id").alias("gold_inst_id"), F.array_union(F.coalesce("cause", F.array().cast("array<int>")), F.coalesce("effect", F.array().cast("array<int>"))).alias("_args"))
    r = candidates.select("doc_id", "sent_id", "gold_inst_id", "patterns", "connective", *own).join(g, ["doc_id", "sent_id", "gold_inst_id"])
    r = r.withColumn("_in", F.array_intersect("connective", "_args")).filter(F.size("_in") > 0)
    lemma = F.transform(F.filter("tokens", lambda t: F.array_contains("_in", t["idx"])), lambda t: t["lemma"])
    r = r if sentences is None else r.join(sentences.select("doc_id", "sent_id", "tokens"), ["doc_id", "sent_id"])
    r = r.select("patterns", F.explode(F.array_distinct(lemma)).alias("lemma"))
    return r.select(F.explode("patterns").alias("pattern_id"), "lemma").distinct()
