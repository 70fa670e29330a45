"""Directed and partly directed graphs over variables, as boolean matrices: a[i, j] is an edge from i to j, both ways an undirected one."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def find_cycle(a: np.ndarray) -> list[int]:
    """The nodes of one directed cycle, or none."""
    state, stack = [0] * len(a), []

    def visit(i: int) -> list[int]:
        state[i] = 1
        stack.append(i)
        for j in np.flatnonzero(a[i]):
            if state[j] == 1:
                return stack[stack.index(j) :]
            if state[j] == 0 and (found := visit(j)):
                return found
        state[i] = 2
        stack.pop()
        return []

    for i in range(len(a)):
        if state[i] == 0 and (found := visit(i)):
            return [int(x) for x in found]
    return []


def to_dag(a: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """a without the edge of least weight (of ties the first) of each cycle found; ValueError without weights if there is a cycle."""
    a = a.copy()
    while cycle := find_cycle(a):
        if weight is None:
            raise ValueError(f"cycle through {cycle}")
        edges = list(zip(cycle, cycle[1:] + cycle[:1], strict=True))
        a[min(edges, key=lambda e: (abs(weight[e]), e))] = False
    return a


def reaches(a: np.ndarray, i: int, j: int) -> bool:
    seen, todo = set(), [i]
    while todo:
        at = todo.pop()
        if a[at, j]:
            return True
        new = set(np.flatnonzero(a[at]).tolist()) - seen
        seen |= new
        todo += new
    return False


def neighbours(a: np.ndarray, i: int) -> set[int]:
    return set(np.flatnonzero(a[i] & a[:, i]).tolist())


def adjacent(a: np.ndarray, i: int) -> set[int]:
    return set(np.flatnonzero(a[i] | a[:, i]).tolist()) - {i}


def parents(a: np.ndarray, i: int) -> set[int]:
    return set(np.flatnonzero(a[:, i] & ~a[i]).tolist())


def is_clique(a: np.ndarray, nodes: set[int]) -> bool:
    return all(a[i, j] or a[j, i] for i, j in combinations(nodes, 2))


def blocked(a: np.ndarray, start: int, goal: int, by: set[int]) -> bool:
    """Whether every path from start to goal along directed or undirected edges meets `by`."""
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for j in np.flatnonzero(a[at]).tolist():
            if j == goal:
                return False
            if j not in seen and j not in by:
                seen.add(j)
                todo.append(j)
    return True


def meek(a: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Undirected edges oriented as Meek's four rules force, where the direction is allowed."""
    a = a.copy()
    ok = np.ones_like(a) if allowed is None else allowed
    n = range(len(a))

    def forced(i: int, j: int) -> bool:
        line = {k: neighbours(a, k) for k in (i, j)}
        for k in n:
            into = a[k, i] and not a[i, k]
            if into and k != j and not (a[k, j] or a[j, k]):
                return True  # k to i, k not beside j
            if a[i, k] and not a[k, i] and a[k, j] and not a[j, k]:
                return True  # i to k to j
        tails = [k for k in line[i] if a[k, j] and not a[j, k]]
        if any(not (a[k, m] or a[m, k]) for k, m in combinations(tails, 2)):
            return True
        return any(a[m, k] and not a[k, m] and m in adjacent(a, i) and not (a[m, j] or a[j, m]) for k in tails for m in n if m not in (i, j, k))

    changed = True
    while changed:
        changed = False
        for i in n:
            for j in n:
                if a[i, j] and a[j, i] and ok[i, j] and forced(i, j):
                    a[j, i] = False
                    changed = True
    return a


def pdag_to_dag(a: np.ndarray) -> np.ndarray | None:
    """A directed extension without new colliders (Dor and Tarsi), or None."""
    left, work, out = set(range(len(a))), a.copy(), np.zeros_like(a)
    out |= a & ~a.T
    while left:
        for x in sorted(left):
            near = neighbours(work, x)
            if (work[x] & ~work[:, x]).any():
                continue
            if all(adjacent(work, x) - {y} <= adjacent(work, y) for y in near):
                for y in near:
                    out[y, x] = True
                work[x], work[:, x] = False, False
                left.remove(x)
                break
        else:
            return None
    return out


def dag_to_cpdag(dag: np.ndarray) -> np.ndarray:
    """The class of a directed graph: its colliders, and what Meek's rules force from them."""
    out = dag | dag.T
    for j in range(len(dag)):
        for i, k in combinations(np.flatnonzero(dag[:, j]).tolist(), 2):
            if not (dag[i, k] or dag[k, i]):
                out[j, i] = out[j, k] = False
    return meek(out)
