"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and candidates of a pair of blocks are each indexed by a cover tree: a node at level i
holds points within 2**i of its centre, its children have centres more than 2**(i - 1) apart and
cover it. A pair of nodes is dropped if no inner product between them can reach the worst kth
score of the query group; the bound follows from the centres and covering radii.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.shared import named, stored, table
from spendlens.llm.vector_blocks import best_of_blocks, excluded, in_blocks, marked, matrix, pairs_table, usable

#: Points of a leaf at most (unless they coincide), and points that are scored at once at least.
LEAF, BATCH = 128, 512
FOUND = "query_id long, query_mark string, vec_id long, mark string, score long"


class Node:
    """A range of the tree's points with centre and covering radius."""

    __slots__ = ("center", "children", "first", "last", "norm", "radius", "stack")

    def __init__(self, center: np.ndarray, radius: float, first: int, last: int) -> None:
        self.center, self.radius, self.first, self.last = center, radius, first, last
        self.norm = float(np.linalg.norm(center))
        self.children: list[Node] = []
        self.stack: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


class CoverTree:
    """Cover tree over the rows of ``points``; ``order`` lists them as the nodes' ranges do."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.squares = np.einsum("ij,ij->i", points, points)
        self.order = np.arange(len(points))
        self.root = self._build(0, len(points), 0)

    def _build(self, first: int, last: int, center: int) -> Node:
        """Node over ``order[first:last]``, which is put into the order of its children."""
        rows = self.order[first:last]
        inside, squares = self.points[rows], self.squares[rows]

        def distances(point: np.ndarray, square: float) -> np.ndarray:
            return np.sqrt(np.maximum(squares + square - 2 * (inside @ point), 0))

        near = distances(self.points[center], self.squares[center])
        radius = float(near.max(initial=0))
        node = Node(self.points[center], radius, first, last)
        if len(rows) <= self.leaf or radius == 0:
            return node
        apart = 2.0 ** (math.ceil(math.log2(radius)) - 1)
        centers, owner = [center], np.zeros(len(rows), dtype=np.int64)
        while near.max() > apart:  # the point least covered becomes the next centre
            chosen = int(near.argmax())
            beyond = distances(inside[chosen], squares[chosen])
            beyond[chosen] = 0
            closer = beyond < near
            owner[closer] = len(centers)
            near[closer] = beyond[closer]
            centers.append(int(rows[chosen]))
        by_owner = np.argsort(owner, kind="stable")
        self.order[first:last] = rows[by_owner]
        ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(centers)))) + first
        if len(centers) == 1:  # one centre covers all at half the radius: rounding only
            return node
        node.children = [self._build(int(a), int(b), c) for c, a, b in zip(centers, ends[:-1], ends[1:]) if b > a]
        kids = node.children
        node.stack = (np.stack([n.center for n in kids]), np.array([n.radius for n in kids]), np.array([n.norm for n in kids]))
        return node


class DualSearch:
    """Highest inner products of every query row among the candidate rows, ties to smaller ids.

    A candidate with the query's id and vector is the query itself, unless it has ``copies``.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int,
                 copies: np.ndarray | None = None) -> None:
        wide = np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * queries.shape[1] >= 2.0**53
        left, right = CoverTree(queries), CoverTree(points)
        # sums of products below 2**53 are exact in doubles, others are done in whole numbers
        exact = (lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)) if wide else (lambda m: m)
        self.queries, self.query_ids = exact(queries[left.order]), query_ids[left.order]
        self.points, self.ids = exact(points[right.order]), ids[right.order]
        self.copies = np.ones(len(ids), dtype=np.int64) if copies is None else copies[right.order]
        self.query_order, self.order, self.k = left.order, right.order, k
        self.scores = np.full((len(queries), k), -np.inf, dtype=object if wide else np.float64)
        self.best = np.full((len(queries), k), -1, dtype=np.int64)
        if len(queries) and len(points):
            self._pair(left.root, right.root)

    def _worst(self, node: Node) -> float:
        return float(self.scores[node.first:node.last, -1].min())

    def _pair(self, query: Node, node: Node) -> None:
        """Search a pair of nodes that may still hold better scores."""
        together = not query.children or all(not c.children for c in query.children)
        if not node.children and together:
            self._score(query, [node])
        elif node.children and (together or node.radius >= query.radius):
            centers, radii, norms = node.stack
            bound = self._bounds(query, centers, radii, norms)
            waiting: list[Node] = []
            held = 0
            for i in np.argsort(-bound, kind="stable").tolist():
                if bound[i] < self._worst(query):
                    break  # the rest is bounded lower still
                child = node.children[i]
                if child.children or not together:
                    self._pair(query, child)
                    continue
                waiting.append(child)
                held += child.last - child.first
                if held >= BATCH:
                    self._score(query, waiting)
                    waiting, held = [], 0
            if waiting:
                self._score(query, waiting)
        else:
            for child in query.children:
                if self._bounds(child, node.center[None], np.array([node.radius]), np.array([node.norm]))[0] >= self._worst(child):
                    self._pair(child, node)

    @staticmethod
    def _bounds(query: Node, centers: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What no inner product between points of ``query`` and of each node exceeds, rounding included."""
        bound = centers @ query.center + query.norm * radii + norms * query.radius + radii * query.radius
        return bound + 1e-9 * (np.abs(bound) + (query.norm + query.radius) * (norms + radii)) + 1e-6

    def _score(self, query: Node, nodes: list[Node]) -> None:
        """All pairs of the points of a query node and of some leaves."""
        places = np.concatenate([np.arange(n.first, n.last) for n in nodes])
        for start in range(0, len(places), 2 * BATCH):
            columns = places[start:start + 2 * BATCH]
            rows = np.arange(query.first, query.last)
            got = self.queries[rows] @ self.points[columns].T
            own = excluded(self.query_ids[rows], self.queries[rows], self.ids[columns], self.points[columns], self.copies[columns])
            got = np.where(own, -np.inf, got)
            better = (got >= self.scores[rows, -1:]).any(axis=1)
            if better.any():
                rows, got = rows[better], got[better]
                self._keep_best(rows, np.concatenate([self.scores[rows], got], axis=1),
                                np.concatenate([self.best[rows], np.broadcast_to(columns, got.shape)], axis=1))

    def _keep_best(self, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        if scores.dtype == object:
            order = np.array([sorted(range(len(s)), key=lambda j: (-s[j], self.ids[p[j]]))[:self.k] for s, p in zip(scores, places)])
            self.scores[rows], self.best[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)
            return
        least = np.partition(scores, -self.k, axis=1)[:, -self.k]
        row, column = np.nonzero(scores >= least[:, None])  # the best and all that tie with the last of them
        score, at = scores[row, column], places[row, column]
        order = np.lexsort((self.ids[at], -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.scores[rows[row[kept]], place[kept]] = score[order][kept]
        self.best[rows[row[kept]], place[kept]] = at[order][kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Rows of ``queries`` and of ``points`` with their scores, best first for each query."""
        real = (self.scores > -np.inf).astype(bool)
        at = np.repeat(self.query_order, real.sum(axis=1).astype(np.int64))
        return at, self.order[self.best[real]], pa.array([max(-2**63, min(2**63 - 1, int(s))) for s in self.scores[real]], pa.int64())


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, query_block: int = 1024, block: int = 8192) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` highest integer inner products.

    Both inputs have ``vec_id``, ``vector`` (whole numbers as doubles) and may have ``copies``, the
    rows they stand for; vectors meet only those of their own dimension. Of a query only its own
    row is left out: others of its id are candidates, and copies take ranks of their own. Equal
    scores go to smaller ids; with fewer candidates all are returned. Scores that no 64-bit number
    holds are ranked exactly and reported as the nearest one that does.
    """
    queries, candidates = stored(marked(queries)), stored(marked(candidates))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pairs_table(left, right, np.empty(0, int), np.empty(0, int), pa.array([], pa.int64()))
        dual = DualSearch(matrix(left["vector"]), left["vec_id"].to_numpy(), matrix(right["vector"]), right["vec_id"].to_numpy(), k,
                          right["copies"].to_numpy())
        return pairs_table(left, right, *dual.found())

    return best_of_blocks(in_blocks(queries, candidates, [], query_block, block, search, FOUND), queries, candidates, k)


OP9_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""


@named("op9_cover_tree", OP9_SQL)
def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector among all others.

    Components beyond 2**57, whose 64-fold no 64-bit number holds, count as the nearest one that does.
    """
    whole = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(
        "vec_id", "copies", F.transform("vector", lambda x: F.floor(x * 64).cast("double")).alias("vector"))
    return exact_top_k(whole.where(F.col("vec_id") % 20 == 0), whole, 20)
