"""Exact top-k search as a Voronoi kNN join on the integer inner product."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.vectors import best, first_rows, matrix, smallest_ids, top_of_row, usable


def whole(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(x * scale).cast("long"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of int64 rows: by floating point where that is exact, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return q.astype(float) @ x.astype(float).T if most < 2**53 else q @ x.T


def chunks(counts: dict[int, int], room: int) -> dict[int, tuple[int, int]]:
    """Cells in order to (first block, number of blocks): small neighbours share a block, large cells get several."""
    out, block, filled = {}, 0, 0
    for cell, n in sorted(counts.items()):
        parts = -(-n // room)
        if filled and (parts > 1 or filled + n > room):
            block, filled = block + 1, 0
        out[cell] = (block, parts)
        block, filled = (block + parts, 0) if parts > 1 else (block, filled + n)
    return out


KIND = "id long, raw binary, cell long, far double"


def draw_centres(rows: DataFrame, pivots: int | None) -> np.ndarray:
    """At most `pivots` different vectors drawn by a hash, each next to those like it as far as one direction shows."""
    n = rows.count()
    pivots = pivots or min(2048, max(16, int(n**0.5)))
    # Twice as many are below this hash, so that tasks send few.
    limit = min((1 << 63) - 1, (1 << 65) * pivots // max(1, n) - (1 << 63))
    drawn = rows.where(F.xxhash64("v") <= limit).orderBy(F.xxhash64("v"), "id").limit(pivots).collect()
    centres = np.unique(np.array([r["v"] for r in drawn], np.int64).reshape(len(drawn), -1), axis=0) if drawn else np.zeros((1, 1), np.int64)
    spread = centres - centres.mean(axis=0)
    main = np.linalg.svd(spread, full_matrices=False)[2][0] if len(centres) > 1 else np.ones(centres.shape[1])
    return centres[np.argsort(spread @ main, kind="stable")]


def to_cells(rows: DataFrame, centres: np.ndarray, *more: str) -> DataFrame:
    """(id, raw, cell, far) of rows (id, v): the nearest centre and the distance to it; with further columns of whole numbers."""

    def dealt(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = centres.astype(float)
        for b in batches:
            for at in range(0, len(b), 2048):
                some = b.iloc[at : at + 2048]
                x = np.stack(some["v"].to_numpy()).astype(np.int64)
                f = x.astype(float)
                cell = ((p**2).sum(1) - 2 * f @ p.T).argmin(1)
                yield pd.DataFrame({"id": some["id"], "raw": [r.tobytes() for r in x], "cell": cell, "far": np.sqrt(((f - p[cell]) ** 2).sum(1))} | {c: some[c] for c in more})

    return rows.mapInPandas(dealt, KIND + "".join(f", {c} long" for c in more))


def summaries(held: DataFrame, depth: int) -> list:
    """(cell, n, radius, close) of each cell, close being the depth smallest distances to its centre, in order."""
    close = first_rows(held.select("id", "cell", "far"), "cell", ["far"], depth, "id").groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("close"))
    return held.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(close, "cell").orderBy("cell").collect()


#: Rows of one id that its bounds allow for; an id with more has none and is met with all cells.
SPARE = 64


def with_needs(asked: DataFrame, centres: np.ndarray, sums: list, depth: int) -> DataFrame:
    """asked with reach, a score that the depth best answers of a query reach, cells, those whose bound reaches it, and need, the
    same as bits in the order of sums."""
    known = np.array([r["cell"] for r in sums], int)
    radius = np.array([r["radius"] for r in sums], float)
    lower = [(i, np.array(r["close"])) for i, r in enumerate(sums)]

    def bounds(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b) if len(known) else 0, 512):
                some = b.iloc[at : at + 512]
                q = matrix(some["raw"], np.int64).astype(float)
                norm = np.sqrt((q**2).sum(1))
                mid = q @ centres[known].astype(float).T
                sure = np.concatenate([mid[:, [i]] - norm[:, None] * c for i, c in lower], axis=1)
                slack = 1e-9 * (1 + np.abs(mid).max(initial=0))
                reach = np.partition(sure, -depth, axis=1)[:, -depth] - slack if sure.shape[1] >= depth else np.full(len(q), -np.inf)
                reach[some["own"].to_numpy() > SPARE] = -np.inf
                need = mid + norm[:, None] * radius + slack >= reach[:, None]
                yield some[["id", "raw", "cell"]].assign(reach=reach, cells=[known[x].tolist() for x in need], need=[x.tobytes() for x in np.packbits(need, axis=1)])

    return asked.mapInPandas(bounds, "id long, raw binary, cell long, reach double, cells array<long>, need binary")


def voronoi_join(data: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, pivots: int | None = None, query_room: int = 32_768, data_room: int = 32_768) -> DataFrame:
    """Returns (query_id, rank, vec_id, score): the k largest integer inner products of each query row, exactly.

    queries is a condition over id_col. Components become floor(scale * x). Vectors drawn by a hash, as many as the root
    of the number of rows (16 at least, 2,048 at most) if pivots doesn't say how many, divide data and queries into
    cells. A cell's summary is its radius and its k + 1 smallest distances to the pivot (more where an id asked for has
    several vectors); it bounds the products of a query with the cell's vectors from both sides (|q.x - q.p| <= |q| |x - p|).
    A query's k + 1 best lower bounds, or as many more, give a score that its answers reach, and only cells whose
    upper bound reaches it are replicated to the query's block, and met there only by the queries that need them. Blocks of at most about query_room queries,
    of neighbouring cells, and data_room vectors (a 64th of all, if that is less, but 1,024) are solved locally, 256 queries
    at a time; large cells are split by a hash. So a vector is copied once for query_room queries, not for each. Only pivots and
    summaries (pivots * (k + 1) numbers) come to the driver. On clustered vectors most cells fall away; vectors spread
    evenly over all directions of many dimensions, as in the table of embeddings, leave nearly all.

    Rows with a null id or unusable vector (see usable) take no part; zero vectors do. Equal rows (after
    scaling) count once. Rows of one id with different vectors are a query and a candidate each, but never candidates of
    their own id; ranks are over all query rows of an id. An empty table gives no rows.
    """
    rows = usable(data, id_col, vector_col)
    rows = rows.select("id", whole(F.col("v"), scale).alias("v"))
    asking = rows.where(queries).distinct()
    # A query leaves out all rows of its own id: so many places are needed beyond k.
    times = asking.groupBy(F.col("id").alias("many")).agg(F.count("*").alias("own")).where("own > 1")
    asking = asking.join(times, F.col("id") == F.col("many"), "left").select("id", "v", F.coalesce("own", F.lit(1)).alias("own"))
    spare = min(SPARE, times.agg(F.max("own")).first()[0] or 1)
    rows = smallest_ids(rows.distinct(), k + 1)
    centres = draw_centres(rows, pivots)
    held, asked = to_cells(rows, centres), to_cells(asking, centres, "own")
    sums = summaries(held, k + spare)
    query_blocks = chunks({r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}, query_room)
    data_blocks = chunks({r["cell"]: r["n"] for r in sums}, max(1, min(data_room, max(1024, sum(r["n"] for r in sums) // 64))))
    known = np.array([r["cell"] for r in sums], int)
    spark = data.sparkSession

    def block(blocks: dict[int, tuple[int, int]], cell: str, name: str) -> DataFrame:
        return spark.createDataFrame([(c, f, n) for c, (f, n) in blocks.items()], f"{cell} long, {name}_first long, {name}_parts long")

    def of(name: str) -> Column:
        return F.col(f"{name}_first") + F.pmod(F.xxhash64("id"), F.col(f"{name}_parts"))

    asked = with_needs(asked, centres, sums, k + spare).join(block(query_blocks, "cell", "qb"), "cell").select("id", "raw", "reach", "cells", "need", of("qb").alias("qb"))
    needs = asked.select("qb", F.explode("cells").alias("cell")).distinct()
    where = block(data_blocks, "cell", "db")
    replicas = held.join(where, "cell").withColumn("db", of("db")).join(needs, "cell").select("qb", "db", "id", "cell", "raw")
    blocks = needs.join(where, "cell").select("qb", F.explode(F.sequence(F.col("db_first"), F.col("db_first") + F.col("db_parts") - 1)).alias("db")).distinct()
    sent = asked.join(blocks, "qb").select(F.col("qb").alias("to_qb"), F.col("db").alias("to_db"), "id", "raw", "reach", "need")

    def solve(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            x = x.sort_values("cell", ignore_index=True)
            ids, vectors, cell = x["id"].to_numpy(), matrix(x["raw"], np.int64), np.searchsorted(known, x["cell"].to_numpy())
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                asks, bits = matrix(part["raw"], np.int64), np.unpackbits(matrix(part["need"], np.uint8), axis=1).astype(bool)
                some = np.flatnonzero(bits.any(0)[cell])
                scores = products(asks, vectors[some])
                for own, reach, s, need in zip(part["id"], part["reach"], scores, bits, strict=True):
                    fit = np.flatnonzero((s >= reach) & (ids[some] != own) & need[cell[some]])
                    top = fit[top_of_row(s[fit], ids[some[fit]], k)]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[some[top]], "score": s[top].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = replicas.groupBy("qb", "db").cogroup(sent.groupBy("to_qb", "to_db")).applyInPandas(solve, "query_id long, vec_id long, score long")
    return best(found, k).select("query_id", "rank", "vec_id", "score")
