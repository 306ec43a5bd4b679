"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import task_count
from studylake.llm.vectors import RESULT, best, matrix, smallest_ids, top_of_row, usable

INDEX = "shard long, node int, ids array<long>, raw binary, edges array<int>"


def beam(q: np.ndarray, x: np.ndarray, edges: np.ndarray, start: int, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam searches of all rows of q at once: (nodes, squared distances) of the width nearest met, -1 where none.

    Each round expands the step nearest nodes of a beam that are not yet expanded, until no beam has one.
    """
    n, lines = len(q), np.arange(len(q))[:, None]
    near = np.full((n, width), -1)
    far = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, len(x) + 1), bool)
    near[:, 0], done[:, 0], seen[:, start], seen[:, -1] = start, False, True, True
    far[:, 0] = ((q - x[start]) ** 2).sum(1)
    squares, own = (x**2).sum(1), (q**2).sum(1)
    live = np.arange(n)
    while len(live):
        waiting = np.where(done[live], np.inf, far[live])
        pick = np.argpartition(waiting, min(step, width - 1), axis=1)[:, :step]
        ready = np.isfinite(np.take_along_axis(waiting, pick, 1))
        some = ready.any(1)
        live, pick, ready = live[some], pick[some], ready[some]
        if not len(live):
            break
        rows = live[:, None]
        done[rows, pick] |= ready
        found = np.where(ready[:, :, None], edges[near[rows, pick]], -1).reshape(len(live), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[rows, found]] = -1
        seen[rows, found] = True
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        away = np.full(found.shape, np.inf, np.float32)
        away[r, c] = squares[node] + own[live[r]] - 2 * np.einsum("ij,ij->i", x[node], q[live[r]])
        all_far = np.concatenate([far[live], away], 1)
        keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[live] = np.take_along_axis(all_far, keep, 1)
        near[live] = np.take_along_axis(np.concatenate([near[live], found], 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(found, bool)], 1), keep, 1) | ~np.isfinite(far[live])
    order = np.argsort(far, axis=1, kind="stable")
    return near[lines, order], far[lines, order]


def prune(own: np.ndarray, near: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate lists (rows of near, -1 for none): keeps the nearest, drops candidates that it is
    alpha times nearer to than the own node is, and goes on with the rest."""
    near = np.where(near == own[:, None], -1, near)
    near = -np.sort(-near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    far = np.where(near >= 0, ((x[near] - x[own][:, None]) ** 2).sum(2), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
    most = int((near >= 0).sum(1).max(initial=1))
    near, far = near[:, :most], far[:, :most]
    v = x[near]
    s = (v**2).sum(2)
    between = s[:, :, None] + s[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    alive = near >= 0
    out = np.full((len(near), degree), -1)
    rows = np.arange(len(near))
    for i in range(degree):
        j = alive.argmax(1)
        has = alive[rows, j]
        if not has.any():
            break
        out[has, i] = near[rows, j][has]
        alive &= alpha**2 * between[rows, j] > far
        alive[rows, j] = False
    return out


def grow(x: np.ndarray, degree: int, width: int, alpha: float, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges of a graph over the rows of x, and where searches start. Nodes enter in batches that double in size."""
    n = len(x)
    edges = np.full((n, degree), -1)
    start = int(((x - x.mean(axis=0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at : at + min(512, max(16, at))]
        inside = order[:at]
        if at <= width:
            near = np.tile(inside, (len(batch), 1))
        else:
            near, _ = beam(x[batch], x, edges, start, width)
        edges[batch] = prune(batch, near, x, degree, alpha)
        fro, slot = np.nonzero(edges[batch] >= 0)
        to = edges[batch][fro, slot]
        by = np.argsort(to, kind="stable")
        to, fro = to[by], batch[fro[by]]
        heads, first, count = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(heads), int(count.max(initial=0))), -1)
        more[np.repeat(np.arange(len(heads)), count), np.arange(len(to)) - np.repeat(first, count)] = fro
        both = np.concatenate([edges[heads], more], 1)
        full = (both >= 0).sum(1) > degree
        kept = -np.sort(-both[~full], axis=1)[:, :degree]
        edges[heads[~full], : kept.shape[1]] = kept
        for part in np.array_split(np.flatnonzero(full), max(1, full.sum() // 512)):
            if len(part):
                edges[heads[part]] = prune(heads[part], both[part], x, degree, alpha)
        at += len(batch)
    return edges, start


def lifted(v: np.ndarray) -> np.ndarray:
    """Vectors with one more component that gives all the same length: nearest is then largest inner product."""
    squares = (v**2).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(0, squares.max(initial=0) - squares))[:, None]], 1).astype(np.float32)


def build_index(data: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int | None = None, degree: int = 32, width: int = 64, alpha: float = 1.2) -> DataFrame:
    """Returns the index: each distinct vector as a node of its shard's graph, with its edges; node 0 starts searches.

    Vectors are dealt to shards of about shard_rows by a hash: a 256th of all, but 8,192 at least and 65,536 at most, if it
    isn't given. So a query searches at most 256 graphs until each is as large as a task can build; only then does their
    number grow. Each shard's graph is one group of bounded size. Equal
    vectors are one node with the k + 1 smallest of their ids, which is all that a search for k can return of them; so
    repeated rows count once. Rows with a null id and vectors that are null, zero, of an unusual length or hold null or
    non-finite components (see usable) are not indexed. An empty table gives an empty index; further columns play no part.
    """
    rows = usable(data, id_col, vector_col, zero=False)
    nodes = smallest_ids(rows.distinct(), k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    n = nodes.count()
    shards = max(1, -(-n // (shard_rows or min(65_536, max(8192, n // 256)))))

    def one(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ids", key=lambda c: c.map(lambda x: x[0]), ignore_index=True)
        v = np.stack(b["v"].to_numpy()).astype(float)
        edges, start = grow(lifted(v), degree, width, alpha)
        place = np.arange(len(b))
        place[[0, start]] = start, 0
        back = np.append(np.argsort(place), -1)
        b, v, edges = b.iloc[place], v[place], back[edges[place]]
        return pd.DataFrame({"shard": key[0], "node": np.arange(len(b)), "ids": b["ids"].tolist(), "raw": [r.tobytes() for r in v], "edges": [e[e >= 0].tolist() for e in edges]})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(one, INDEX)


class Shard:
    """A shard's graph, opened for searches."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("node", ignore_index=True)
        self.v, self.ids = matrix(rows["raw"], float), rows["ids"].to_list()
        self.x = lifted(self.v)
        self.edges = np.full((len(rows), max(1, rows["edges"].map(len).max())), -1)
        for i, e in enumerate(rows["edges"]):
            self.edges[i, : len(e)] = e

    def answers(self, own: np.ndarray, asks: np.ndarray, k: int, width: int) -> pd.DataFrame:
        """The k best nodes met by the beam of each query, as ids and inner products."""
        scale = np.sqrt((self.v**2).sum(1).max()) / np.sqrt((asks**2).sum(1))
        lines = np.concatenate([asks * scale[:, None], np.zeros((len(asks), 1))], 1).astype(np.float32)
        near, out = beam(lines, self.x, self.edges, 0, min(width, len(self.x)))[0], []
        for i, line, found in zip(own, asks, near, strict=True):
            found = found[found >= 0]
            scores = (self.v[found] * line).sum(axis=1)
            every, each = np.concatenate([self.ids[f] for f in found]), np.repeat(scores, [len(self.ids[f]) for f in found])
            every, each = every[every != i], each[every != i]
            top = top_of_row(each, every, k)
            out.append(pd.DataFrame({"query_id": i, "vec_id": every[top], "score": each[top]}))
        return pd.concat(out)


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, width: int = 96, room: int = 16_384) -> DataFrame:
    """Returns (query_id, rank, vec_id, score): the k largest inner products found, in double precision on the original
    vectors, without the query's own id; ties go to the smaller id.

    Every shard is searched by every query. A shard's graph comes first in its task and the queries stream through it;
    `room` of them, more than a shard has nodes, share one copy of the graph, so that copies are a small part of what is
    sent. Queries that are null, zero, of an unusual length or hold null or non-finite components have no answers;
    repeated query rows count once; an empty index or no queries give no rows; further columns play no part.
    """
    asked = usable(queries, id_col, vector_col, zero=False).distinct()
    n = asked.count()
    slices = max(1, -(-n // room))
    shards = [r[0] for r in index.select("shard").distinct().collect()]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("edges", "array<int>"))]
    cut = F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice")
    sent = asked.select(F.explode(F.lit(shards).cast("array<long>")).alias("shard"), cut, F.lit(1).alias("asks"), F.lit(0).alias("node"), "id", "v", F.lit(None).cast("binary").alias("raw"), *none)
    graph = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")).alias("slice"), F.lit(0).alias("asks"), "node", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), "raw", "ids", "edges")

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, nodes, shard = None, [], None
        for b in batches:
            for now, some in b.groupby(["shard", "slice"]):
                if now != key:
                    key, nodes, shard = now, [], None
                asks = some["asks"].to_numpy() == 1
                if not asks.all():
                    nodes.append(some[~asks])
                if asks.any() and (nodes or shard):
                    shard = shard or Shard(pd.concat(nodes))
                    nodes = []
                    own, lines = some["id"][asks].to_numpy().astype(np.int64), np.stack(some["v"][asks].to_numpy()).astype(float)
                    for at in range(0, len(own), 512):
                        yield shard.answers(own[at : at + 512], lines[at : at + 512], k, width)

    parts = task_count(index.sparkSession, n * len(shards), 4 * room)
    streams = graph.unionByName(sent).repartition(parts, "shard", "slice").sortWithinPartitions("shard", "slice", "asks", "node")
    return best(streams.mapInPandas(rows, RESULT), k).select("query_id", "rank", "vec_id", "score")


def nearest(data: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, **how) -> DataFrame:
    """Index and search in one: queries is a condition over `id_col`."""
    return search(build_index(data, id_col, vector_col, k, **how), data.where(queries), id_col, vector_col, k)
