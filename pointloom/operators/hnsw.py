"""Navigable small-world graphs, one for each segment of bounded size, built and searched in parallel.

A graph is a table: segment, id, vector, level and, for each layer up to its level, the point's neighbours. A segment is
of bounded size, so the neighbours of all points of a layer are found at once, by products of blocks of vectors. Levels
come from a hash of the id and ties go to lower ids, so a graph is the same whenever it is built.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.config import Distance, HnswConfig
from pointloom.operators.search import _matrix

#: Points of a segment, about: what one task builds or searches at once.
SEGMENT_POINTS = 20_000
GRAPH = "segment int, id long, vector array<double>, level int, neighbours array<array<long>>"


def level_of(point: int, seed: int) -> int:
    """Each level holds about half of the points of the one below."""
    bits = int.from_bytes(hashlib.blake2b(f"{seed}:{point}".encode(), digest_size=8).digest(), "big")
    return min(16, (~bits & (bits + 1)).bit_length() - 1)


#: Scores that a batch of walks holds at once, for each of its queries one a point.
HELD_SCORES = 1 << 20
#: Of a walk's breadth, the part that is expanded in one step, and how many at least.
STEP_PART, STEP_LEAST = 8, 8


class _Graph:
    """Layers are (nodes, their neighbours), a row of `near` for each node, filled up with -1."""

    def __init__(self, vectors: np.ndarray, metric: str, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.vectors, self.metric, self.layers = vectors, metric, layers

    def scores(self, q: np.ndarray, of: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        v, asked = self.vectors[nodes], q[of]
        return -((v - asked) ** 2).sum(1) if self.metric == Distance.EUCLID else np.einsum("ij,ij->i", v, asked)

    def descend(self, q: np.ndarray) -> np.ndarray:
        """For each query, the best node that greedy walks down to layer 1 find."""
        each = np.arange(len(q))
        at = np.full(len(q), self.layers[-1][0][0])
        best = self.scores(q, each, at)
        for nodes, near in self.layers[:0:-1]:
            going = each
            while len(going):
                found = near[np.searchsorted(nodes, at[going])]
                row, column = np.nonzero(found >= 0)
                value = np.full(found.shape, -np.inf)
                value[row, column] = self.scores(q, going[row], found[row, column])
                top = value.argmax(1) if found.shape[1] else np.zeros(len(going), int)
                better = value.max(1, initial=-np.inf) > best[going]
                going, top, found, value = going[better], top[better], found[better], value[better]
                here = np.arange(len(going))
                at[going], best[going] = found[here, top], value[here, top]
        return at

    def search(self, q: np.ndarray, breadth: int, k: int, allowed: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best nodes that its walk meets and their scores, best first, ties to the lower node; of
        allowed nodes only, if they are given. A walk goes on with twice the breadth until it has k, or all there are,
        and the wider walk has found none better: no breadth is right for graphs of every size and dimension."""
        batch = max(1, HELD_SCORES // len(self.vectors))
        return [x for at in range(0, len(q), batch) for x in self._search(q[at : at + batch], breadth, k, allowed)]

    def _search(self, q: np.ndarray, breadth: int, k: int, allowed: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(self.vectors)
        met, done = np.full((len(q), n), -np.inf), np.zeros((len(q), n), bool)
        going, start = np.arange(len(q)), self.descend(q)
        met[going, start] = self.scores(q, going, start)
        want = min(k, n if allowed is None else int(allowed.sum()))
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0))] * len(q)
        while True:
            self._walk(q, going, min(breadth, n), met, done)
            more = []
            for i in going.tolist():
                nodes = np.flatnonzero((met[i] > -np.inf) if allowed is None else (met[i] > -np.inf) & allowed)
                value = met[i, nodes]
                if len(nodes) > k > 0:
                    some = value >= np.partition(value, -k)[-k]
                    nodes, value = nodes[some], value[some]
                best = np.lexsort((nodes, -value))[:k]
                before, found[i] = found[i][0], (nodes[best], value[best])
                if len(best) < want or not np.array_equal(before, found[i][0]):
                    more.append(i)
            if breadth >= n or not more:
                return found
            going, breadth = np.array(more), 2 * breadth

    def _walk(self, q: np.ndarray, going: np.ndarray, breadth: int, met: np.ndarray, done: np.ndarray) -> None:
        """Best first in layer 0, from what the queries `going` have met, until the `breadth` best of it are expanded."""
        near, step = self.layers[0][1], max(STEP_LEAST, breadth // STEP_PART)
        beams = np.argpartition(met[going], -breadth, axis=1)[:, -breadth:]
        value = met[going[:, None], beams]  # a place that is not filled stays at -inf, also when its node is met elsewhere
        while len(going):
            rows = np.arange(len(going))[:, None]
            todo = np.where(done[going[:, None], beams], -np.inf, value)
            some = np.argpartition(todo, -step, axis=1)[:, -step:] if step < breadth else np.broadcast_to(np.arange(breadth), beams.shape)
            row, column = np.nonzero(todo[rows, some] > -np.inf)
            nodes = beams[row, some[row, column]]
            done[going[row], nodes] = True
            # Where all are expanded: parts that the walk did not reach are entered at their lowest nodes, to fill the breadth.
            count = np.bincount(row, minlength=len(going))
            to = near[nodes]
            of, place = np.nonzero(to >= 0)
            row, to = row[of], to[of, place]
            for i in np.flatnonzero((count == 0) & (value == -np.inf).any(1)).tolist():
                rest = np.flatnonzero(met[going[i]] == -np.inf)[: int((value[i] == -np.inf).sum())]
                row, to, count[i] = np.r_[row, np.full(len(rest), i)], np.r_[to, rest], len(rest)
            fresh = met[going[row], to] == -np.inf
            row, to = np.divmod(np.unique(row[fresh] * np.int64(len(self.vectors)) + to[fresh]), len(self.vectors))
            met[going[row], to] = self.scores(q, going[row], to)
            met_now = np.bincount(row, minlength=len(going))
            # The new ones, a row for each query, filled up with places of the beam's own that count as not met.
            new = np.zeros((len(going), max(1, met_now.max(initial=0))), np.int64)
            new_value = np.full(new.shape, -np.inf)
            at = np.arange(len(row)) - np.repeat(np.cumsum(met_now) - met_now, met_now)
            new[row, at], new_value[row, at] = to, met[going[row], to]
            both, value = np.concatenate([beams, new], 1), np.concatenate([value, new_value], 1)
            kept, live = np.argpartition(value, -breadth, axis=1)[:, -breadth:], count > 0
            going, beams, value = going[live], both[rows, kept][live], value[rows, kept][live]


#: Rows of a segment's vectors that are multiplied with all of them at once.
BLOCK = 128


def layer_neighbours(vectors: np.ndarray, metric: str, m: int) -> np.ndarray:
    """Of each vector at most m others: the nearest m // 2, then those that have it among theirs, nearest first, as long as
    there is room, then the next nearest. Edges back keep points in reach that are nobody's nearest. A row a vector, filled up with -1."""
    n, width = len(vectors), min(m, len(vectors) - 1)
    if width < 1:
        return np.empty((n, 0), np.int64)
    near, score = np.empty((n, width), np.int64), np.empty((n, width))
    square = (vectors * vectors).sum(1)
    for at in range(0, n, BLOCK):
        rows = np.arange(at, min(at + BLOCK, n))
        s = vectors[rows] @ vectors.T
        if metric == Distance.EUCLID:
            s = 2 * s - square - square[rows][:, None]
        s[np.arange(len(rows)), rows] = -np.inf
        some = np.sort(np.argpartition(s, n - width, axis=1)[:, n - width :], axis=1)  # by place, so that a stable sort lets ties go to lower ids
        order = np.argsort(-np.take_along_axis(s, some, 1), axis=1, kind="stable")
        near[rows] = np.take_along_axis(some, order, 1)
        score[rows] = np.take_along_axis(s, near[rows], 1)
    half = max(1, m // 2)
    to, of, s = near[:, :half].ravel(), np.repeat(np.arange(n), min(half, width)), score[:, :half].ravel()
    order = np.lexsort((of, -s, to))
    to, of = to[order], of[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    back = np.full((n, m - half), -1)
    back[to[place < m - half], place[place < m - half]] = of[place < m - half]
    every = np.concatenate([near[:, :half], back, near[:, half:]], 1)
    for c in range(1, every.shape[1]):
        every[(every[:, c : c + 1] == every[:, :c]).any(1), c] = -1
    return np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)[:, :m]


def build(points: DataFrame, metric: Distance = Distance.DOT, config: HnswConfig | None = None, segment_points: int = SEGMENT_POINTS) -> DataFrame:
    """The graph table of points (id, vector)."""
    config = config or HnswConfig()
    segments = max(1, -(-points.count() // segment_points))

    def graph(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        vectors, ids = _matrix(rows["vector"]), rows["id"].to_numpy()
        levels = np.array([level_of(i, config.seed) for i in ids.tolist()])
        owner, sizes, flat = [], [], []
        for layer in range(levels.max() + 1):
            nodes = np.flatnonzero(levels >= layer)
            near = layer_neighbours(vectors[nodes], metric, config.m)
            owner.append(nodes)
            sizes.append((near >= 0).sum(1))
            flat.append(np.split(ids[nodes[near[near >= 0]]], np.cumsum(sizes[-1])[:-1]))
        order = np.argsort(np.concatenate(owner), kind="stable")  # of each node, its layers from the lowest
        lists = [x for layer in flat for x in layer]
        size = np.concatenate(sizes)[order]
        inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(np.concatenate([lists[i] for i in order]), pa.int64()))
        neighbours = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(levels + 1)], pa.int32()), inner)
        return pa.table([rows["segment"], rows["id"], rows["vector"], pa.array(levels, pa.int32()), neighbours], ["segment", "id", "vector", "level", "neighbours"])

    dealt = points.select(F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int").alias("segment"), "id", "vector")
    return dealt.groupBy("segment").applyInArrow(graph, GRAPH)


#: Queries that a task walks a segment for, about.
PART_QUERIES = 4096


def search(graph: DataFrame, queries: DataFrame, k: int, metric: Distance = Distance.DOT, ef: int = 64, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, score for each row (query_id, q) of queries, which may be of any number. The graph is best a
    table at rest: its segments are looked up before it is walked.

    Every segment is walked with a breadth of max(k, ef), then with twice as much each time, until that finds none better.
    Points that are not in an allowed set (id) are walked through and left out; the walk widens until a segment has k
    allowed points, or all of its. So there are never fewer than k, where k points are allowed.
    """
    breadth, filtered, rows = max(k, ef), allowed is not None, graph.withColumn("ok", F.lit(True))
    if allowed is not None:
        rows = graph.join(allowed.select("id").distinct().withColumn("ok", F.lit(True)), "id", "left")
    parts = max(1, -(-queries.count() // PART_QUERIES))
    rows = rows.select("segment", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "vector", "level", "neighbours", "ok")
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", F.col("q").cast("array<double>").alias("q"))
    asked = asked.crossJoin(F.broadcast(graph.select(F.col("segment").alias("of")).distinct()))  # a row a segment

    def walk(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("id")
            ids, query_ids = rows["id"].to_numpy(), asked["query_id"].to_numpy()
            layers = _layers(ids, rows["level"].to_numpy(), rows["neighbours"])
            ok = rows["ok"].is_valid().to_numpy() if filtered else None
            found = _Graph(_matrix(rows["vector"]), metric, layers).search(_matrix(asked["q"]), breadth, k, ok)
            out = [np.repeat(query_ids, [len(n) for n, _ in found]), ids[np.concatenate([n for n, _ in found])], np.concatenate([s for _, s in found])]
        return pa.table(out, ["query_id", "id", "score"])

    found = rows.groupBy("segment", "part").cogroup(asked.groupBy("of", "part")).applyInArrow(walk, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _layers(ids: np.ndarray, levels: np.ndarray, neighbours: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each layer its nodes and a row of neighbours for each of them, filled up with -1; ids are sorted."""
    inner = neighbours.combine_chunks().flatten()
    size = np.diff(inner.offsets.to_numpy())
    to = np.searchsorted(ids, inner.flatten().to_numpy())
    node = np.repeat(np.arange(len(ids)), levels + 1)
    layer = np.arange(len(node)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    near = np.full((len(node), size.max(initial=0)), -1)
    near[np.arange(near.shape[1]) < size[:, None]] = to
    return [(node[layer == k], near[layer == k]) for k in range(levels.max() + 1)]
