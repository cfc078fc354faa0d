"""Reader of texts with their parses: one row per sentence, tokens and graph nested, so that sentences travel whole.

A parse file has blocks parted by blank lines: words, ``lemma/TAG`` pairs, an optional bracketed tree, and
``label(head-i, dep-j)`` lines. A sentence that could not be parsed is its words and ``(())``; it has no edges.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.schema import SENTENCE, general_tag

#: Escapes of brackets and quotes in parser output.
ESCAPES = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}", "``": '"', "''": '"', "\\/": "/"}
_EDGE = re.compile(r"^(\S+)\((.*)-(\d+)'*, (.*)-(\d+)'*\)$", re.M)
_ESCAPED = re.compile("|".join(re.escape(x) for x in ESCAPES))
_TREE = re.compile(r"\(|\)|[^\s()]+")


def unescape(word: str) -> str:
    for a, b in ESCAPES.items():
        word = word.replace(a, b)
    return word


def sentences_of(parse: str) -> Iterator[tuple[list[str], list[tuple[str, str]], str, list[tuple[str, int, int]]]]:
    """(words, (lemma, tag) pairs, tree, edges) of each sentence of a parse file."""
    blocks = [b for b in re.split(r"\n[ \t]*\n", parse.strip("\n")) if b.strip()]
    i = 0
    while i < len(blocks):
        words = blocks[i].split()
        i += 1
        tagged: list[tuple[str, str]] = []
        tree, edges = "", []
        if i < len(blocks) and blocks[i].strip() == "(())":
            i += 1
        else:
            if i < len(blocks):
                tagged = [tuple(t.rsplit("/", 1)) for t in blocks[i].split() if "/" in t]
                i += 1
            if i < len(blocks) and blocks[i].lstrip().startswith("("):
                tree = blocks[i]
                i += 1
            if i < len(blocks):
                lines = blocks[i].strip()
                found = _EDGE.findall(lines)
                if len(found) <= lines.count("\n"):  # lines may have blanks around them
                    found = _EDGE.findall("\n".join(line.strip() for line in lines.split("\n")))
                if len(found) == lines.count("\n") + 1:
                    edges = [(label, int(h), int(d)) for label, _, h, _, d in found]
                    i += 1
        yield words, tagged, tree, edges


def tree_nodes(tree: str) -> list[dict]:
    """Rows (node, parent, label, leaf) of a bracketed tree; leaf is the token's index, from 1, for word nodes."""
    rows, stack, leaf, opened = [], [], 0, False
    for t in _TREE.findall(tree):
        if t == "(":
            opened = True
            continue
        if t == ")":
            if stack and not opened:
                stack.pop()
            opened = False
            continue
        node = len(rows)
        if opened:
            rows.append({"node": node, "parent": stack[-1] if stack else None, "label": t, "leaf": None})
            stack.append(node)
            opened = False
        else:
            leaf += 1
            rows.append({"node": node, "parent": stack[-1] if stack else None, "label": t, "leaf": leaf})
    return rows


class _Batch:
    """Sentences column by column; tokens, edges and nodes of all of them lie behind one another."""

    def __init__(self):
        self.head = [[] for _ in range(5)]
        self.tokens, self.edges, self.nodes = ([[] for _ in range(n)] for n in (8, 3, 4))
        self.ends = ([0], [0], [0])

    def add(self, doc_id: str, text: str, parse: str) -> None:
        at = 0
        idx, texts, lower, lemmas, tags, general, starts, ends = self.tokens
        for k, (words, tagged, tree, edges) in enumerate(sentences_of(parse)):
            if any(map(_ESCAPED.search, words)):
                words = [unescape(w) for w in words]
            n, m, small = len(words), min(len(tagged), len(words)), [w.lower() for w in words]
            pos = [t for _, t in tagged[:n]] + [None] * (n - m)
            own = [x for x, _ in tagged[:n]]
            idx += range(n + 1)
            texts += ["ROOT", *words]
            lower += ["root", *small]
            lemmas += ["ROOT", *(unescape(x) if _ESCAPED.search(x) else x for x in [*own, *small[m:]])]
            tags += ["ROOT", *pos]
            general += ["ROOT", *map(_general, pos)]
            starts.append(None)
            ends.append(None)
            first = last = None
            for word in words:
                found = text.find(word, at)
                if found != at + 1 and (found < 0 or text[at:found].strip()) or found == at + 1 and not text[at].isspace():  # not the next thing in the text
                    starts.append(None)
                    ends.append(None)
                else:
                    at = found + len(word)
                    starts.append(found)
                    ends.append(at)
                    first, last = found if first is None else first, at
            first = at if first is None else first
            last = first if last is None else last
            for column, x in zip(self.head, (doc_id, k, first, last, text[first:last]), strict=True):
                column.append(x)
            if edges:
                label, head, dep = zip(*edges, strict=True)
                for column, x in zip(self.edges, (head, dep, label), strict=True):
                    column += x
            for x in tree_nodes(tree) if tree else ():
                for column, name in zip(self.nodes, ("node", "parent", "label", "leaf"), strict=True):
                    column.append(x[name])
            for end, part in zip(self.ends, (self.tokens, self.edges, self.nodes), strict=True):
                end.append(len(part[0]))

    def table(self) -> pa.RecordBatch:
        i, s = pa.int32(), pa.string()
        parts = (self.tokens, ("idx", "text", "lower", "lemma", "pos", "gen_pos", "start", "end"), (i, s, s, s, s, s, i, i)), (self.edges, ("head", "dep", "label"), (i, i, s)), (self.nodes, ("node", "parent", "label", "leaf"), (i, i, s, i))
        nested = [pa.ListArray.from_arrays(pa.array(e, i), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))) for e, (columns, names, kinds) in zip(self.ends, parts, strict=True)]
        head = [pa.array(c, t) for c, t in zip(self.head, (s, i, i, i, s), strict=True)]
        return pa.RecordBatch.from_arrays([*head, *nested], ["doc_id", "sent_id", "start", "end", "text", "tokens", "edges", "nodes"])


_general = functools.cache(general_tag)
#: Tokens after which sentences are handed on.
_TOKENS = 1 << 16


def _read(rows: Iterable[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    now = _Batch()
    for doc_id, text, parse in rows:
        now.add(doc_id, text, parse)
        if len(now.tokens[0]) >= _TOKENS:
            yield now.table()
            now = _Batch()
    if now.head[0]:
        yield now.table()


def files(spark: SparkSession, folder: str, pattern: str, recurse: bool = False) -> DataFrame:
    """(doc_id, content) of whole files; doc_id is the path without its extension."""
    r = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recurse).lower())
    return r.text(folder, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), r"\.[^./]*$", "").alias("doc_id"), F.col("value").alias("content"))


def parse_texts(documents: DataFrame, parser: Callable[[str], str] | None = None) -> DataFrame:
    """Sentences of (doc_id, text, parse) rows, or of (doc_id, text) rows whose parse files a parser writes."""
    columns = ["doc_id", "text"] if parser else ["doc_id", "text", "parse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        return _read((d, t or "", (parser(t or "") if parser else p[0]) or "") for d, t, *p in rows)

    return documents.select(*columns).mapInArrow(run, SENTENCE)


def read_sentences(spark: SparkSession, folder: str, recurse: bool = False) -> DataFrame:
    """Sentences of all texts in a folder; a text without a parse has none."""
    texts = files(spark, folder, "*.txt", recurse).withColumnRenamed("content", "text")
    parses = files(spark, folder, "*.parse", recurse).withColumnRenamed("content", "parse")
    return parse_texts(texts.join(parses, "doc_id"))


def tokens(sentences: DataFrame) -> DataFrame:
    return sentences.select("doc_id", "sent_id", F.inline("tokens"))


def edges(sentences: DataFrame) -> DataFrame:
    return sentences.select("doc_id", "sent_id", F.inline("edges"))


def nodes(sentences: DataFrame) -> DataFrame:
    return sentences.select("doc_id", "sent_id", F.inline("nodes"))
