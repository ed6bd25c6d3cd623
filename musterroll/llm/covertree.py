"""Cover trees over integer vectors and a dual-tree search for the largest inner products."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

EXACT = 2.0**53
_TOGETHER = 1024


@dataclass
class Node:
    """A ball around ``center`` that covers the rows ``rows``; a leaf has no children."""

    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


class Flat:
    """The nodes of a tree by number, their balls as arrays."""

    def __init__(self, root: Node):
        nodes, at = [root], 0
        self.children: list[np.ndarray] = []
        while at < len(nodes):
            own = nodes[at].children
            self.children.append(np.arange(len(nodes), len(nodes) + len(own)) if own else np.array([at]))
            nodes += own
            at += 1
        self.rows = [n.rows for n in nodes]
        self.sizes = np.array([len(r) for r in self.rows])
        self.centers = np.array([n.center for n in nodes])
        self.norms = np.linalg.norm(self.centers, axis=1)
        self.radii = np.array([n.radius for n in nodes])
        self.inner = np.array([bool(n.children) for n in nodes])


def build(points: np.ndarray, rows: np.ndarray, leaf: int = 64, fan: int = 24) -> Node:
    """Cover ``rows`` by a center's ball, and that by balls of half the radius.

    New centers are the points farthest from those before, so they lie more than half the
    radius apart. In many dimensions that would make nearly every point a center, so at
    most ``fan`` are taken, and fewer than would leave small parts; radii are measured,
    and so cover in any case. Where the points come little closer to their centers, the
    balls could prune nothing and the node stays a leaf, whatever its size.
    """
    own = points[rows]
    mean = own.mean(axis=0)
    center = own[((own - mean) ** 2).sum(axis=1).argmin()]
    distance = np.sqrt(((own - center) ** 2).sum(axis=1))
    node = Node(center, float(distance.max()), rows)
    if len(rows) <= leaf or node.radius == 0:
        return node
    nearest, least = np.zeros(len(rows), dtype=np.int32), distance
    for number in range(1, min(fan, max(2, len(rows) // leaf))):
        far = int(least.argmax())
        if least[far] <= node.radius / 2:
            break
        away = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
        closer = away < least
        nearest[closer], least = number, np.minimum(least, away)
    if least.mean() > 0.7 * distance.mean():
        return node
    parts = [rows[nearest == k] for k in range(nearest.max() + 1)]
    if max(map(len, parts)) == len(rows):
        return node
    node.children = [build(points, part, leaf, fan) for part in parts if len(part)]
    return node


class DualSearch:
    """The ``k`` largest inner products of every query row, ties to the smaller id.

    ``known`` is a score per query below which nothing is wanted.
    """

    def __init__(self, queries, query_ids, points, point_ids, k: int, known: np.ndarray, leaf: int = 64):
        largest = np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * queries.shape[1]
        exact = float if largest < EXACT else np.int64
        self.queries, self.points = queries.astype(exact), points.astype(exact)
        self.query_ids, self.point_ids, self.k, self.leaf = query_ids, point_ids, k, leaf
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.worst = known.astype(float)

    def run(self) -> None:
        if len(self.queries) and len(self.points):
            # Few, larger groups of queries: pruning is by group, and work by pairs of groups.
            queries = build(self.queries.astype(float), np.arange(len(self.queries)), 2 * self.leaf, 4)
            self.tree = Flat(build(self.points.astype(float), np.arange(len(self.points)), self.leaf))
            self._visit(queries, np.array([0]))

    def _alive(self, group: Node, nodes: np.ndarray) -> np.ndarray:
        """Nodes that may hold a score some query of the group wants, the best bound first.

        No point of a ball exceeds the bound with a query of the group (rounding included).
        """
        tree, norm = self.tree, np.linalg.norm(group.center)
        norms, radii = tree.norms[nodes], tree.radii[nodes]
        bounds = tree.centers[nodes] @ group.center + norm * radii + norms * group.radius + group.radius * radii
        bounds += 1e-9 * (norm + group.radius) * (norms + radii)
        order = np.argsort(-bounds, kind="stable")
        return nodes[order[bounds[order] >= self.worst[group.rows].min()]]

    def _visit(self, group: Node, nodes: np.ndarray) -> None:
        """Prune the node pairs of a query group, then split the group or open the nodes."""
        nodes = self._alive(group, nodes)
        while self.tree.inner[nodes].any():
            nodes = self._alive(group, np.concatenate([self.tree.children[n] for n in nodes]))
        if group.children:
            for child in group.children:
                self._visit(child, nodes)
            return
        while len(nodes):
            several = 1 + int(np.searchsorted(np.cumsum(self.tree.sizes[nodes]), _TOGETHER))
            near, nodes = nodes[:several], nodes[several:]
            rows = np.concatenate([self.tree.rows[n] for n in near])
            for at in range(0, len(rows), _TOGETHER):
                for first in range(0, len(group.rows), _TOGETHER // 4):
                    self._compare(group.rows[first : first + _TOGETHER // 4], rows[at : at + _TOGETHER])
            if len(nodes):
                nodes = self._alive(group, nodes)

    def _compare(self, group: np.ndarray, rows: np.ndarray) -> None:
        scores = (self.queries[group] @ self.points[rows].T).astype(float)
        ids = self.point_ids[rows]
        scores[self.query_ids[group][:, None] == ids] = -np.inf
        least = self.worst[group]
        if len(rows) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        changed = np.unique(at)
        if not len(changed):
            return
        own = np.repeat(changed, self.k)
        owner = np.concatenate([own, at])
        value = np.concatenate([self.scores[group[changed]].ravel(), scores[at, column]])
        named = np.concatenate([self.ids[group[changed]].ravel(), ids[column]])
        order = np.lexsort((named, -value, owner))
        starts = np.searchsorted(owner[order], changed)
        best = order[starts[:, None] + np.arange(self.k)]
        self.scores[group[changed]], self.ids[group[changed]] = value[best], named[best]
        self.worst[group[changed]] = np.maximum(self.worst[group[changed]], value[best][:, -1])
