"""One sentence's dependency graph in plain Python: depth, heads, paths, closures. Sentences are small, at most a few hundred tokens."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Collection, Iterable, Sequence

from lodestar.schema import NOT_FOR_DEPTH

FAR = 10**6


class SentenceGraph:
    """Edges (head, dep, label), from 0 (ROOT). Several parents and cycles are fine.

    Assumptions where contracts were only seen in use: a span's head is its shallowest token, the first of equals; a path ignores
    directions, is as short as can be and, of equals, goes by lower indices.
    """

    def __init__(self, edges: Iterable[tuple[int, int, str]]):
        self.out: dict[int, list[tuple[str, int]]] = {}
        self.into: dict[int, list[tuple[str, int]]] = {}
        for h, d, label in sorted({(int(h), int(d), str(x)) for h, d, x in edges}):
            self.out.setdefault(h, []).append((label, d))
            self.into.setdefault(d, []).append((label, h))
        self.depth = self._depths()

    def _depths(self) -> dict[int, int]:
        depth, queue = {0: 0}, deque([0])
        while queue:
            x = queue.popleft()
            for label, y in self.out.get(x, ()):
                if label not in NOT_FOR_DEPTH and y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        return depth

    def children(self, token: int, label: str | None = None) -> list[int]:
        return [d for x, d in self.out.get(token, ()) if label is None or x == label]

    def head(self, span: Collection[int] | None) -> int | None:
        if span is None or len(span) == 0:
            return None
        return min((int(t) for t in span), key=lambda t: (self.depth.get(t, FAR), t))

    def parent(self, token: int) -> tuple[str, int] | None:
        """The label and index of the shallowest parent."""
        found = sorted(self.into.get(token, ()), key=lambda x: (self.depth.get(x[1], FAR), x[1]))
        return found[0] if found else None

    def path(self, a: int, b: int, limit: int = FAR) -> list[str] | None:
        """Labels from a to b, those against the edge marked with ``^``; null if there is no path of at most limit edges."""
        if a == b:
            return []
        before: dict[int, tuple[int, str]] = {a: (a, "")}
        queue = deque([(a, 0)])
        while queue:
            x, n = queue.popleft()
            if n >= limit:
                continue
            steps = [(y, label) for label, y in self.out.get(x, ())] + [(y, label + "^") for label, y in self.into.get(x, ())]
            for y, label in sorted(steps):
                if y not in before and y != 0:
                    before[y] = (x, label)
                    if y == b:
                        labels = []
                        while y != a:
                            y, label = before[y]
                            labels.append(label)
                        return labels[::-1]
                    queue.append((y, n + 1))
        return None

    def within(self, a: int, limit: int) -> dict[int, list[str]]:
        """``path`` from a to every other token at most limit edges away, from one search."""
        found: dict[int, list[str]] = {a: []}
        queue = deque([a])
        while queue:
            x = queue.popleft()
            if len(found[x]) < limit:
                steps = [(y, label) for label, y in self.out.get(x, ())] + [(y, label + "^") for label, y in self.into.get(x, ())]
                for y, label in sorted(steps):
                    if y not in found and y != 0:
                        found[y] = [*found[x], label]
                        queue.append(y)
        del found[a]
        return found

    def distance(self, a: int, b: int) -> int:
        p = self.path(a, b)
        return FAR if p is None else len(p)

    def nearest(self, token: int, others: Sequence[int]) -> tuple[int, int] | None:
        """The closest of some tokens by path length, the first of equals, and its distance."""
        return min(((int(o), self.distance(token, int(o))) for o in others), key=lambda x: x[1], default=None)

    def dominates(self, a: int, b: int) -> bool:
        return a != b and b in self.closure(a, ())

    def domination(self, a: int, b: int) -> str:
        return "Dominates" if self.dominates(a, b) else "DominatedBy" if self.dominates(b, a) else "Independent"

    def closure(self, start: int, stop: Collection[int], skip_first: Collection[str] = ()) -> list[int]:
        """start and all that is reached from it without stepping on a stop token; sorted. skip_first: labels not followed from start."""
        seen, stack = {start}, [start]
        while stack:
            x = stack.pop()
            for label, y in self.out.get(x, ()):
                if y not in seen and y not in stop and y != 0 and not (x == start and label in skip_first):
                    seen.add(y)
                    stack.append(y)
        return sorted(seen)

    def steiner(self, required: Collection[int]) -> set[int]:
        """Nodes of a small tree that connects the required ones: the nearest unconnected one is joined by its shortest path, again and again."""
        rest = sorted(set(required))
        if not rest:
            return set()
        tree = {rest.pop(0)}
        while rest:
            found = min(((self._walk(t, tree), t) for t in rest), key=lambda x: (FAR if x[0] is None else len(x[0]), x[1]))
            if found[0] is None:
                return set()
            tree |= set(found[0])
            rest = [t for t in rest if t not in tree]
        return tree

    def _walk(self, a: int, goals: Collection[int]) -> list[int] | None:
        """Nodes of a shortest path from a to any goal."""
        if a in goals:
            return [a]
        before, queue = {a: a}, deque([a])
        while queue:
            x = queue.popleft()
            for y in sorted({y for _, y in (*self.out.get(x, ()), *self.into.get(x, ()))}):
                if y not in before and y != 0:
                    before[y] = x
                    if y in goals:
                        nodes = [y]
                        while y != a:
                            y = before[y]
                            nodes.append(y)
                        return nodes
                    queue.append(y)
        return None


def of_row(edges) -> SentenceGraph:
    """Graph of a sentence row's edges, as Arrow or Spark hand them over."""
    return SentenceGraph((e["head"], e["dep"], e["label"]) for e in (edges if edges is not None else ()))


def graph_of() -> Callable[[object], SentenceGraph]:
    """``of_row`` that keeps the last graph, for rows of one sentence behind one another."""
    last: list = [None, None]

    def one(edges) -> SentenceGraph:
        if last[0] is not edges or edges is None:
            last[:] = edges, of_row(edges)
        return last[1]

    return one


def _is(tokens: dict[int, dict], i: int, lemma: str | None = None, tag: str = "") -> bool:
    t = tokens.get(i) or {}
    return (lemma is None or t.get("lemma") == lemma) and tag in (t.get("pos") or "")


def active(edges: Iterable[dict], tokens: dict[int, dict]) -> list[tuple[int, int, str]]:
    """Edges in which passives and reduced relatives look active. An agent is an ``nmod`` of the verb that has *by* as its ``case``.

    1. A passive subject of a verb with *be* as ``auxpass`` and an agent: the subject becomes ``dobj``, the agent ``nsubj``; *by* and *be* go,
       and what hangs on them moves up to the agent and the verb.
    2. A noun with a participle as ``acl`` that has an agent: the agent becomes ``nsubj``, *by* goes with all below it, the noun is ``dobj`` of the participle, too.
    3. Such a noun otherwise, unless the participle has a ``dobj`` or a *by* with an object of its own: the noun becomes its ``dobj``, too.

    The rules run in this order, each on what the ones before left. Each finds all its places first.
    """
    now = {(e["head"], e["dep"], e["label"]) for e in edges}

    def children(h: int, *labels: str) -> list[int]:
        return sorted(d for x, d, label in now if x == h and label in labels)

    def agents(verb: int, tag: str) -> list[tuple[int, int]]:
        return [(a, b) for a in children(verb, "nmod", "nmod:agent") for b in children(a, "case") if _is(tokens, b, "by", tag)]

    def relabel(h: int, d: int, old: Sequence[str], new: str) -> None:
        for label in old:
            now.discard((h, d, label))
        now.add((h, d, new))

    def below(x: int) -> set[int]:
        seen, stack = {x}, [x]
        while stack:
            top = stack.pop()
            new = {d for h, d, _ in now if h == top} - seen
            seen |= new
            stack += new
        return seen

    passive = [(v, s, a, by, be) for v, s, label in sorted(now) if label == "nsubjpass" and _is(tokens, v, tag="V") for be in children(v, "auxpass") if _is(tokens, be, "be") for a, by in agents(v, "IN")]
    for v, s, a, by, be in passive:
        relabel(v, s, ("nsubjpass",), "dobj")
        relabel(v, a, ("nmod", "nmod:agent"), "nsubj")
        for gone, up in ((by, a), (be, v)):
            for h, d, label in [e for e in now if gone in e[:2]]:
                now.discard((h, d, label))
                if h == gone and d != up:
                    now.add((up, d, label))

    def nouns(other: str) -> list[tuple[int, int]]:
        fits = lambda n: _is(tokens, n, tag="NN") or other in (pos := tokens.get(n, {}).get("pos") or "") or pos in ("PRP", "VBG")
        return [(n, v) for n, v, label in sorted(now) if label == "acl" and (tokens.get(v) or {}).get("pos") == "VBN" and fits(n)]

    for n, v in [(n, v) for n, v in nouns("CD") if not any(h == v and d == n for h, d, _ in now) and agents(v, "")]:
        for a, by in agents(v, ""):
            relabel(v, a, ("nmod", "nmod:agent"), "nsubj")
            gone = below(by) - {n, v, a}
            now -= {e for e in now if e[0] in gone or e[1] == by}
        now.add((v, n, "dobj"))
    for n, v in nouns("C"):
        own_by = any(h == v and _is(tokens, d, "by") and children(d, "pobj") for h, d, _ in now)
        if not children(v, "dobj") and not own_by:
            now.add((v, n, "dobj"))
    return sorted(now)


def bracketed(tokens: Sequence[dict], edges: Sequence[dict]) -> str:
    """The graph as a bracketed string ``(lemma_i label TAG children)``; a node that was printed comes again without children; ``ref`` edges are left out."""
    graph = SentenceGraph((e["head"], e["dep"], e["label"]) for e in edges if e["label"] != "ref")
    by = {t["idx"]: t for t in tokens}
    seen: set[int] = set()

    def show(i: int, label: str) -> str:
        t = by[i]
        lemma = str(t["lemma"]).replace("(", "-LRB-").replace(")", "-RRB-")
        children = ""
        if i not in seen:
            seen.add(i)
            children = "".join(" " + show(d, x) for x, d in sorted(graph.out.get(i, ()), key=lambda c: c[1]))
        return f"({lemma}_{i} {label} {t['pos']}{children})"

    return show(0, "root")


def from_bracketed(text: str, excluded: Collection[str] = ()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(edges, edges with an excluded label) of a bracketed string."""
    edges, apart, stack, want = [], [], [], None
    for part in text.replace("(", " ( ").replace(")", " ) ").split():
        if part == "(":
            want = "node"
        elif part == ")":
            stack.pop()
        elif want == "node":
            stack.append(int(part.rsplit("_", 1)[1]))
            want = "label"
        elif want == "label":
            if len(stack) > 1:
                (apart if part in excluded else edges).append((stack[-2], stack[-1], part))
            want = "tag"
    return edges, apart


#: Contracted forms that auxiliaries are expanded from.
CONTRACTIONS = {"'s": "is", "'m": "am", "'d": "would", "'re": "are", "wo": "will", "ca": "can"}


def tense(graph: SentenceGraph, tokens: dict[int, dict], head: int) -> str:
    """Auxiliaries, copulas and the head in text order, joined by ``_``; ``<NOM>`` for a noun without a copula."""
    cops = graph.children(head, "cop")
    if not cops and str(tokens[head]["pos"]).startswith("NN"):
        return "<NOM>"
    parts = sorted({head, *cops, *graph.children(head, "aux"), *graph.children(head, "auxpass")})
    show = lambda i: tokens[i]["pos"] if i == head else f"COP.{tokens[i]['pos']}" if i in cops else CONTRACTIONS.get(tokens[i]["lower"], tokens[i]["lower"])
    return "_".join(str(show(i)) for i in parts)
