"""N-gram Jaccard join: count vectors of hashed shingles as points, overlap bounded by summed coordinate minima.

Two texts link when their sets of word shingles have a Jaccard similarity of percent / 100 or more. The points are
searched in two steps that lose no pair:

* Cells. In one global order of all shingles, two linked texts share one of their first n - ceil(percent * n / 100) + 1
  shingles. Each of those is a cell that holds the points of its texts. The order puts shingles last that fall into a
  much-used bucket of a count table, so that common passages hardly make cells.
* A packed R-tree in each cell, of leaves and nodes of nodes, that is descended by pairs of nodes. A node's box is the
  largest count of each group and the smallest size below it; the summed minima of two boxes bound the overlap of any
  pair below them, and those of two points bound that pair's. A cell of over `room` points is met in parts: in the first
  round each part with the cell's first point alone, later those parts of it that are not yet one component.

Pairs that the bound leaves are verified on the whole sets. So that a group of near copies is never spelt out as all its
pairs, the first round takes for each text only the first of its bounded partners in one random order, the second its
best one in another component; the last takes every pair left between components, so each link is either verified or
implied by a path of verified links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from studylake.llm import shingles as sh
from studylake.llm.common import by_unit, components, first_units, forget, id_bitmap, in_bitmap, join_spread, keep, more_units, small_batches, spot

#: Smallest and largest table of shingle counts, counts in a row of it; groups of a short text's count vector; shingles a
#: group of longer ones; points of a leaf, and nodes of a node; pairs that are bounded at once.
TABLE, CHUNK, GROUPS, FILL, LEAF, FAN, STEP = (1 << 15, 1 << 20), 1 << 10, 64, 8, 16, 8, 1 << 15
#: Bytes of text that are hashed at once: a worker keeps the memory of the arrays for it, some forty times as much.
PART = 1 << 18


def bucket(s: np.ndarray, size: int) -> np.ndarray:
    """Place in a table of a power of two of counts."""
    return (s >> np.uint64(65 - size.bit_length())).astype(np.int64)


def count_table(texts: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all texts fall into each bucket: about four times as many buckets as texts, up to a bound that
    suits a broadcast."""
    size = min(TABLE[1], max(TABLE[0], 1 << (2 * texts.count()).bit_length()))

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int32)
        for b in batches:
            for _, raws in sh.parts(b["text"], PART):
                every = list(sh.sets(raws, k))
                total += np.bincount(bucket(np.concatenate(every), size), minlength=size).astype(np.int32)
        chunks = total.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        yield pd.DataFrame({"chunk": some.astype(np.int32), "counts": [chunks[i].tobytes() for i in some]})

    def added(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b["chunk"], b["counts"], strict=True):
                more = np.frombuffer(raw, np.int32)
                total[i] = total[i] + more if i in total else more.astype(np.int64)
        yield pd.DataFrame({"chunk": np.array(list(total), np.int32), "counts": [x.tobytes() for x in total.values()]})

    out = np.zeros(size, np.int64).reshape(-1, CHUNK)
    for i, raw in texts.mapInPandas(rows, "chunk int, counts binary").repartition("chunk").mapInPandas(added, "chunk int, counts binary").collect():
        out[i] = np.frombuffer(raw, np.int64)
    return out.ravel()


def point(s: np.ndarray) -> bytes:
    """The count vector of a set, GROUPS groups or a power of two times as many for about FILL shingles a group: the place
    of a shingle in a short vector is its place in a longer one modulo the length. The first byte is the width of a count."""
    groups = max(GROUPS, 1 << (max(1, len(s)) // FILL).bit_length())
    counts = np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups)
    wide = counts.max(initial=0) > 255
    return (b"\x04" if wide else b"\x01") + counts.astype("<u4" if wide else "u1").tobytes()


def counted(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] == 4 else "u1", offset=1)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A count vector over fewer groups."""
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def features(texts: DataFrame, k: int, percent: int, table: np.ndarray) -> DataFrame:
    """(row, id, n, s1, s2, cells, counts) of each text: size and hash of its set, the first shingles in order, its point."""
    place, size = np.argsort(np.argsort(table, kind="stable"), kind="stable").astype(np.int32), len(table)

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, raws in sh.parts(b["text"], PART):
                out: dict[str, list] = {"n": [], "s1": [], "s2": [], "cells": [], "counts": []}
                for s in sh.sets(raws, k):
                    n = len(s)
                    few = n - (percent * n + 99) // 100 + 1 if n else 0
                    order = np.argsort(place[bucket(s, size)], kind="stable")[:few]  # ties keep the order of the hashes
                    out["n"].append(n), out["cells"].append(s[order].view(np.int64)), out["counts"].append(point(s))
                    out["s1"].append(int(s.sum(dtype=np.uint64).view(np.int64))), out["s2"].append(int(sh.mix(s).sum(dtype=np.uint64).view(np.int64)))
                yield pd.DataFrame({c: b[c].iloc[first : first + len(raws)].reset_index(drop=True) for c in ("row", "id")} | out)

    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInPandas(rows, "row long, id long, n long, s1 long, s2 long, cells array<long>, counts binary")


class Points:
    """The points of a frame of units, with what bounds the overlap of two of them."""

    def __init__(self, n: np.ndarray, raws: list[bytes], comp: np.ndarray, side: np.ndarray, percent: int):
        self.n, self.comp, self.side, self.percent = n, comp, side, percent
        self.long = [counted(x) for x in raws]
        counts = np.stack([folded(x, GROUPS) for x in self.long])
        self.counts = counts.astype(np.uint16) if counts.max(initial=0) < 1 << 16 else counts
        self.groups = np.array([len(x) for x in self.long])

    def bounded(self, p: np.ndarray, q: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of places those that may link: of different components and (where two is set) of different sides; with
        the bound on the shared part of both sizes."""
        n, found = self.n, [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        ok = (self.comp[p] != self.comp[q]) & (~two | (self.side[p] != self.side[q]))
        ok &= 100 * np.minimum(n[p], n[q]) >= self.percent * np.maximum(n[p], n[q])
        p, q = p[ok], q[ok]
        for i in range(0, len(p), STEP):
            x, y = p[i : i + STEP], q[i : i + STEP]
            shared = np.minimum(self.counts[x], self.counts[y]).sum(axis=1, dtype=np.int64)
            fit = shared * (100 + self.percent) >= self.percent * (n[x] + n[y])
            x, y, shared = x[fit], y[fit], shared[fit]
            for j in np.flatnonzero(np.minimum(self.groups[x], self.groups[y]) > GROUPS):
                u, v = self.long[x[j]], self.long[y[j]]
                groups = min(len(u), len(v))
                shared[j] = np.minimum(folded(u, groups), folded(v, groups)).sum()
            fit = shared * (100 + self.percent) >= self.percent * (n[x] + n[y])
            found.append((x[fit], y[fit], shared[fit] / (n[x[fit]] + n[y[fit]])))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def tree_pairs(points: Points, first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """bounded() for the pairs of the points of one unit, some at a time, found by descending a packed R-tree with itself.

    Points are packed in slabs of about equal size, in a slab by their fullest group, LEAF to a leaf and FAN nodes to a
    node. A node's box is the largest count of each group, the smallest and the largest size below it; two nodes are
    opened if their sizes are near enough and the summed minima of their boxes reach what a link of the smallest needs.
    """
    n, counts, percent = points.n[first:end], points.counts[first:end], points.percent
    order = np.argsort(n, kind="stable")
    slab = LEAF * max(1, round((len(order) / LEAF) ** 0.5))
    order = order[np.lexsort((counts.argmax(axis=1)[order], np.arange(len(order)) // slab))]
    starts = np.arange(0, len(order), LEAF)
    levels = [(np.maximum.reduceat(counts[order], starts), np.minimum.reduceat(n[order], starts), np.maximum.reduceat(n[order], starts))]
    while len(levels[-1][0]) > 1:
        box, least, most = levels[-1]
        starts = np.arange(0, len(box), FAN)
        levels.append((np.maximum.reduceat(box, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))
    a = b = np.zeros(1, int)
    for box, least, most in levels[-2::-1]:
        a, b = (a[:, None, None] * FAN + np.arange(FAN)[:, None] + 0 * np.arange(FAN)).ravel(), (b[:, None, None] * FAN + np.arange(FAN) + 0 * np.arange(FAN)[:, None]).ravel()
        ok = (a <= b) & (b < len(box))
        a, b = a[ok], b[ok]
        ok = (100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a])
        a, b = a[ok], b[ok]
        near = [np.minimum(box[a[i : i + STEP]], box[b[i : i + STEP]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), STEP)]
        ok = np.concatenate([*near, np.zeros(0, np.int64)]) * (100 + percent) >= percent * (least[a] + least[b])
        a, b = a[ok], b[ok]
    leaves = np.append(order, np.full(-len(order) % LEAF, -1)).reshape(-1, LEAF)
    one_side = points.side[first:end].min() == points.side[first:end].max()
    place = np.arange(LEAF)
    for i in range(0, len(a), STEP // LEAF**2):
        x, y = a[i : i + STEP // LEAF**2, None, None], b[i : i + STEP // LEAF**2, None, None]
        p, q = leaves[x, place[:, None]] + 0 * place, leaves[y, place] + 0 * place[:, None]
        ok = (p >= 0) & (q >= 0) & ((x != y) | (place[:, None] < place))
        yield points.bounded(p[ok] + first, q[ok] + first, np.full(int(ok.sum()), not one_side))


def unit_pairs(points: Points, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """bounded() for the pairs of each unit (rows of a unit are consecutive), some at a time: small units, of a leaf, together,
    others by trees."""
    edges = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
    first, size = edges[:-1], np.diff(edges)
    low, high = np.minimum.reduceat(points.side, first), np.maximum.reduceat(points.side, first)
    for m in range(2, LEAF + 1):
        at = np.flatnonzero(size == m)
        i, j = np.triu_indices(m, 1)
        step = max(1, STEP // len(i))
        for some in (at[x : x + step] for x in range(0, len(at), step)):
            two = np.repeat(low[some] != high[some], len(i))
            yield points.bounded((first[some][:, None] + i).ravel(), (first[some][:, None] + j).ravel(), two)
    for k in np.flatnonzero(size > LEAF):
        if points.comp[first[k] : edges[k + 1]].min() != points.comp[first[k] : edges[k + 1]].max():
            yield from tree_pairs(points, int(first[k]), int(edges[k + 1]))


def bounded_pairs(units: DataFrame, percent: int, mode: str, rows: int) -> DataFrame:
    """Pairs (a, b) that the trees of units (unit, cell, side, doc, n, comp, counts, cells) leave, each once; cells lists the
    point's cells with others, rows is about as many as units has.

    mode "first": for each point only the partner that comes first in one random order, so that groups become stars;
    "best": the one with the best bound; "every": all.
    """

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})
        if len(b) < 2:
            return none
        doc = b["doc"].to_numpy()
        points = Points(b["n"].to_numpy(), b["counts"].to_list(), b["comp"].to_numpy(), b["side"].to_numpy(), percent)
        found = unit_pairs(points, b["unit"].to_numpy())
        if mode == "every":
            # A pair that shares several cells is given by the first of them alone.
            cell, cells, out = b["cell"].to_numpy(), b["cells"].to_list(), [none]
            for p, q, bound in found:
                once = np.array([min(set(cells[i]) & set(cells[j])) == cell[i] for i, j in zip(p, q, strict=True)], bool)
                out.append(pd.DataFrame({"a": doc[p[once]], "b": doc[q[once]], "score": bound[once]}))
            return pd.concat(out)
        best, partner = np.full(len(doc), np.inf), np.full(len(doc), -1)
        for p, q, bound in found:
            x, y = np.concatenate([p, q]), np.concatenate([q, p])
            rank = -np.concatenate([bound, bound]) if mode == "best" else (sh.mix(doc[y].view(np.uint64)) >> np.uint64(11)).astype(float)
            up = np.lexsort((doc[y], rank, x))
            head = up[np.concatenate([[True], x[up][1:] != x[up][:-1]])] if len(x) else up
            head = head[rank[head] < best[x[head]]]
            best[x[head]], partner[x[head]] = rank[head], y[head]
        some = partner >= 0
        return pd.DataFrame({"a": doc[some], "b": doc[partner[some]], "score": best[some]})

    asked = units.select("unit", "cell", "side", "doc", "n", "comp", "counts", "cells" if mode == "every" else F.array().cast("array<long>").alias("cells"))
    found = by_unit(asked, solve, "a long, b long, score double", rows)
    if mode != "every":
        found = found.groupBy("a").agg(F.min_by("b", F.struct("score", "b")).alias("b"))
    # The first of a pair sends its set to the second: in a star that is the centre.
    return found.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a"), F.min_by("b", "a").alias("b")).select("a", "b")


def verified(pairs: DataFrame, names: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough; names gives a point's (rep, s1), held the set of (id, s1)."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["sa"], batch["sb"], strict=True)):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(u, v, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(u) + len(v) - common)
            yield batch.loc[ok, ["a", "b"]]

    def side(of: str) -> DataFrame:
        return names.select(F.col("doc").alias(of), F.struct("rep", "s1").alias(f"k{of}"))

    def sets(of: str) -> DataFrame:
        return held.select(F.struct(F.col("id").alias("rep"), "s1").alias(f"k{of}"), F.col("s").alias(f"s{of}"))

    named = pairs.join(side("a"), "a").join(side("b"), "b")
    both = named.join(sets("a"), "ka").join(sets("b"), "kb")
    return both.select("a", "b", "sa", "sb").mapInPandas(rows, "a long, b long")


def _cells(points: DataFrame) -> DataFrame:
    """(group, n, member): the points of each cell that holds two or more; cells with the same points count once."""
    every = points.select(F.col("doc").alias("member"), F.explode("cells").alias("group"))
    many = keep(every.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "ngram-sizes")
    rows = keep(join_spread(every, many, ["group"], "n", "member").select("group", "n", "member"), "ngram-cells")
    same = rows.groupBy("group", "n").agg(F.bit_xor(F.xxhash64("member")).alias("x"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("y"))
    once = keep(same.groupBy("n", "x", "y").agg(F.min("group").alias("group")).select("group", F.col("n").alias("rows")), "ngram-once")
    out = keep(join_spread(rows, once, ["group"], "rows", "member").select("group", "n", "member"), "ngram-placed")
    for done in (many, rows, once):
        forget(done)
    return out


def _sets(texts: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(id, s1, s) with the whole sets of the live ids (rep), and of a few others: texts are picked by a bitmap of the ids,
    so that none is shuffled."""
    table, bits = id_bitmap(live, "rep")

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[in_bitmap(table, b["spot"].to_numpy())]
            for first, raws in sh.parts(b["text"], PART):
                every = list(sh.sets(raws, k))
                yield pd.DataFrame({"id": b["id"].iloc[first : first + len(raws)].reset_index(drop=True), "s1": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in every], "s": [s.tobytes() for s in every]})

    return texts.where("id IS NOT NULL").select("id", spot("id", bits).alias("spot"), "text").mapInPandas(rows, "id long, s1 long, s binary")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, room: int = 1024) -> DataFrame:
    """Returns (id, n_shingles, component) for each row: the size of its set of k-word shingles and the smallest id that
    links reach from it.

    Words are runs of characters other than [\\x20\\x09-\\x0D], A-Z in lower case. A text of fewer than k words is one
    shingle; one without words, or null, has none and is linked with nothing. Ids are integers of at most 62 bits; rows
    that share an id are one document with several texts, each with its own set; a row with a null id stands alone and
    has no component. Texts with equal sets are one point. An empty table gives no rows; texts of any length are read
    whole; further columns play no part.
    """
    with small_batches(docs.sparkSession):
        return _near_components(docs, id_col, text_col, k, percent, room)


def _near_components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, room: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = keep(features(texts, k, percent, count_table(texts, k)), "ngram-features")
    key = ["n", "s1", "s2"]
    classes = known.where("n > 0 AND id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("id", "row")).alias("first")).select(*key, F.col("first.id").alias("rep"), F.col("first.row").alias("row"))
    # A point is named by its smallest id; should an id be that of several points, the others get names beyond all ids.
    turn = F.row_number().over(w.Window.partitionBy("rep").orderBy(*key))
    named = F.when(turn == 1, F.col("rep")).otherwise(F.pmod(F.xxhash64("rep", turn), F.lit(1 << 61)) + F.lit(1 << 62))
    classes = keep(classes.withColumn("doc", named), "ngram-classes")
    members = keep(known.select("id", *key).join(classes.drop("row"), key, "left").select("id", "n", "doc", "rep"), "ngram-members")
    points = keep(known.select("row", "s1", "n", "cells", "counts").join(classes.select("row", "doc", "rep"), "row").drop("row"), "ngram-points")
    forget(known)
    cells = _cells(points)
    shared = members.where("doc IS NOT NULL").groupBy("id").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.collect_set("doc").alias("all")).where("a < b")
    links = keep(shared.select("a", F.explode("all").alias("b")).where("a < b"), "ngram-links")
    names, held, label, tried = points.select("doc", "rep", "s1"), None, None, []
    for mode in ("first", "best", "every"):
        if label is None:
            units = first_units(cells, room).withColumn("comp", F.col("member"))
        else:
            labelled = cells.join(label, F.col("member") == F.col("node"), "left").select("group", "n", "member", F.coalesce("component", "member").alias("comp"))
            labelled = keep(labelled, "ngram-labelled")
            units = more_units(labelled, room)
        now = units.select("unit", F.col("group").alias("cell"), "side", F.col("member").alias("doc"), "comp").join(points.select("doc", "n", "counts"), "doc")
        if mode == "every":
            now = now.join(cells.groupBy(F.col("member").alias("doc")).agg(F.collect_set("group").alias("cells")), "doc")
        pairs = bounded_pairs(now, percent, mode, (cells if label is None else labelled).count())
        if tried:
            known_pairs = reduce(DataFrame.unionByName, tried).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            pairs = pairs.join(known_pairs, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
        pairs = keep(pairs, "ngram-pairs")
        tried.append(pairs)
        if held is None:
            # A cell that is one unit gives each of its points a partner, if it has any: a text without one has none at all.
            # In a larger cell a point may have partners in other parts only.
            live = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).union(cells.where(F.col("n") > room).select("member"))
            live = keep(live.distinct(), "ngram-alive")
            left = keep(cells.join(live, "member", "left_semi").select(*cells.columns), "ngram-live")
            forget(cells)
            cells = left
            held = keep(_sets(texts, live.withColumnRenamed("member", "doc").join(names, "doc").select("rep"), k), "ngram-sets")
        more = keep(links.unionByName(verified(pairs, names, held, percent)), "ngram-links")
        forget(links)
        if label is not None:
            forget(label), forget(labelled)
        links, label = more, components(more)
    for done in (points, held, links, cells, classes, live, *tried):
        forget(done)
    joined = members.join(label.withColumnRenamed("node", "doc"), "doc", "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component"))
