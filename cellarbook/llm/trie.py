"""A prefix tree of ordered sets that finds those similar enough to a probe."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

STRETCH = 64  # keys of a node that are compared before the bound is looked at again


def required_overlap(m: int, n: int, percent: int) -> int:
    """Fewest shared elements of sets of m and n elements whose Jaccard similarity reaches the percentage."""
    return -(-percent * (m + n) // (100 + percent))


@dataclass
class Node:
    """Keys after those of the parent, the members that end here, and the sizes of all members below."""

    keys: np.ndarray
    members: list = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    smallest: int = 0
    largest: int = 0


def build(sets: list[tuple[object, np.ndarray]]) -> Node:
    """Tree of (name, sorted distinct uint64 keys); sets that begin alike share a path."""
    ordered = sorted(sets, key=lambda s: s[1].astype(">u8").tobytes())

    def grow(low: int, high: int, depth: int) -> tuple[Node, list]:
        """A node for sets low..high-1, which agree in their first `depth` keys; and what is left to grow."""
        first, last = ordered[low][1], ordered[high - 1][1]
        most = min(len(first), len(last))
        differs = np.flatnonzero(first[depth:most] != last[depth:most])
        end = depth + int(differs[0]) if len(differs) else most
        sizes = [len(s[1]) for s in ordered[low:high]]
        node = Node(first[depth:end], smallest=min(sizes), largest=max(sizes))
        while low < high and len(ordered[low][1]) == end:
            node.members.append((ordered[low][0], end))
            low += 1
        todo = []
        while low < high:
            key, stop = ordered[low][1][end], low + 1
            while stop < high and ordered[stop][1][end] == key:
                stop += 1
            todo.append((node, low, stop, end))
            low = stop
        return node, todo

    root, todo = grow(0, len(ordered), 0) if ordered else (Node(np.zeros(0, np.uint64)), [])
    while todo:
        parent, low, high, depth = todo.pop()
        node, more = grow(low, high, depth)
        parent.children.append(node)
        todo += more
    return root


def similar(root: Node, probe: np.ndarray, percent: int) -> list:
    """Names of the members whose Jaccard similarity with `probe` reaches the percentage.

    Overlaps found on a path count for everything below it. A subtree is left when even if all keys remaining
    on the shorter side were shared its smallest member could not reach the overlap it needs.
    """
    out, todo, n = [], [(root, 0, 0)], len(probe)
    while todo:
        node, overlap, depth = todo.pop()
        need = required_overlap(n, node.smallest, percent)
        alive = 100 * min(n, node.largest) >= percent * max(n, node.smallest)
        for i in range(0, len(node.keys), STRETCH):
            own = node.keys[i : i + STRETCH]
            at = np.searchsorted(probe, own)
            overlap += int((probe[np.minimum(at, n - 1)] == own).sum())
            depth += len(own)
            left = n - int(np.searchsorted(probe, own[-1], "right"))
            if overlap + min(left, node.largest - depth) < need:
                alive = False
                break
        if alive:
            out += [name for name, size in node.members if (100 + percent) * overlap >= percent * (n + size)]
            todo += [(child, overlap, depth) for child in node.children]
    return out
