"""Which variable may cause which, from the schema: relation paths between classes, the matrix of allowed edges, its views."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np

from lodestone.plans.schema import PropertyNode, Schema, unique_names

EPSILON = (("", "epsilon"),)
FORWARD, INVERSE = "forward", "inverse"
Path = tuple[tuple[str, str], ...]


def relation_paths(schema: Schema, a: str, b: str, hops: int = 1, inverse: bool = True) -> list[Path]:
    """Paths of at most `hops` object properties from class a to class b; none within a class.

    A class on the way is passed once, by its first path in the order of domain, property, range.
    """
    if a == b:
        return []
    steps: dict[str, list[tuple[str, str, str]]] = {}
    for d, p, r in schema.relations():
        steps.setdefault(d, []).append((r, p, FORWARD))
        if inverse:
            steps.setdefault(r, []).append((d, p, INVERSE))
    found: list[Path] = []
    todo, seen = deque([(a, ())]), {a}
    while todo:
        at, path = todo.popleft()
        for to, p, way in steps.get(at, ()):
            if to == b:
                found.append((*path, (p, way)))
            elif to not in seen and len(path) + 1 < hops:
                seen.add(to)
                todo.append((to, (*path, (p, way))))
    return list(dict.fromkeys(found))


def label_text(path: Path) -> str:
    """`^p/q` for p backwards, then q forwards; `epsilon` within a class."""
    return "epsilon" if path == EPSILON else "/".join(("^" if way == INVERSE else "") + p for p, way in path)


def parse_label(text: str) -> Path:
    return EPSILON if text == "epsilon" else tuple((s.lstrip("^"), INVERSE if s.startswith("^") else FORWARD) for s in text.split("/"))


@dataclass
class Constraint:
    names: list[str]
    nodes: list[PropertyNode]
    allowed: np.ndarray  # [cause, effect]
    labels: dict[tuple[str, str], list[Path]]

    def subset(self, names: list[str]) -> Constraint:
        at = [self.names.index(n) for n in names]
        return Constraint(list(names), [self.nodes[i] for i in at], self.allowed[np.ix_(at, at)], {k: v for k, v in self.labels.items() if set(k) <= set(names)})

    def stats(self) -> dict[str, float]:
        n = len(self.names)
        possible, kept = n * (n - 1), int(self.allowed.sum())
        return {"possible": possible, "allowed": kept, "forbidden": possible - kept, "pruning": (possible - kept) / possible if possible else 0.0}

    def skeleton(self) -> np.ndarray:
        return self.allowed | self.allowed.T

    def forbidden(self) -> list[tuple[str, str]]:
        n = range(len(self.names))
        return [(self.names[i], self.names[j]) for i in n for j in n if i != j and not self.allowed[i, j]]

    def white_list(self) -> list[tuple[str, str]]:
        return [(self.names[i], self.names[j]) for i, j in zip(*np.nonzero(self.allowed), strict=True)]

    def order_prior(self) -> np.ndarray:
        """[effect, cause]: -1 unknown, 0 forbidden."""
        out = np.where(self.allowed.T, -1, 0)
        np.fill_diagonal(out, 0)
        return out

    def soft_prior(self, high: float = 0.5, low: float = 0.0) -> np.ndarray:
        return np.where(self.allowed, high, low)


def constraint(schema: Schema, nodes: list[PropertyNode], hops: int = 1, inverse: bool = True, within: bool = True) -> Constraint:
    """Edges within a class (if `within`) and between classes that a path of at most `hops` relations links. Found for each pair of classes once."""
    nodes = sorted(nodes)
    names = list(unique_names(nodes).values())
    classes = sorted({n.domain for n in nodes})
    paths = {(a, b): [EPSILON] if a == b and within else relation_paths(schema, a, b, hops, inverse) for a in classes for b in classes}
    n = len(nodes)
    allowed = np.array([[i != j and bool(paths[nodes[i].domain, nodes[j].domain]) for j in range(n)] for i in range(n)], bool).reshape(n, n)
    labels = {(names[i], names[j]): paths[nodes[i].domain, nodes[j].domain] for i in range(n) for j in range(n) if allowed[i, j]}
    return Constraint(names, nodes, allowed, labels)
