"""Legacy retrieval: overlapping chunks of a text, nearest chunks of a tenant by distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.text import strip
from studylake.sources.tables import stored


def chunks(docs: DataFrame, text: str, size: int = 900, overlap: float = 0.1) -> DataFrame:
    """Chunks of size words that overlap by a share: (doc_id, chunk, n_tokens, text)."""
    step = int(size * (1 - overlap))
    words = F.filter(F.split(strip(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != "")
    rows = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.slice("w", F.col("chunk") * step + 1, size)
    return rows.select("doc_id", "chunk", F.size(part).cast("long").alias("n_tokens"), F.array_join(part, " ").alias("text"))


def _units(chunks: DataFrame, unit_rows: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with norm and unit, units): a tenant's chunks by ranges of their norm, as many as its rows ask for but 64 at most;
    a range of more than unit_rows rows is dealt by a hash. units has (owner_id, unit, place, low, high) with the norms' bounds."""
    rows = chunks.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    cuts = F.percentile_approx("norm", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1000))
    tenants = rows.groupBy("owner_id").agg(F.count("*").alias("n"), cuts.alias("cuts")).withColumn("ranges", F.least(F.lit(64), F.ceil(F.col("n") / unit_rows)))
    rank = F.size(F.filter("cuts", lambda c: c < F.col("norm")))
    placed = rows.join(tenants, "owner_id").withColumn("range", F.floor(rank * F.col("ranges") / 64).cast("int")).drop("cuts", "n", "ranges")
    bounds = placed.groupBy("owner_id", "range").agg(F.ceil(F.count("*") / unit_rows).cast("int").alias("parts"), F.min("norm").alias("low"), F.max("norm").alias("high"))
    unit = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int") * 64 + F.col("range")
    placed = placed.join(bounds.select("owner_id", "range", "parts"), ["owner_id", "range"]).withColumn("unit", unit)
    units = bounds.select("owner_id", "low", "high", "range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return placed.select("owner_id", "unit", "vec_id", "v"), units.select("owner_id", (F.col("part") * 64 + F.col("range")).alias("unit"), "low", "high")


def _searched(asked: DataFrame, placed: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, distance): the nearest chunks of each unit for the queries sent to it. A unit's chunks come first and
    are held as one matrix; its queries stream past."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, squares = None, [], [], None
        for b in batches:
            out: list[tuple] = []
            owner, unit, side, number = (b.column(i).to_pylist() for i in range(4))
            values = b.column(4)
            for i in range(b.num_rows):
                if (owner[i], unit[i]) != key:
                    key, ids, vectors, squares = (owner[i], unit[i]), [], [], None
                v = np.array(values[i].as_py(), float)
                if side[i] == 0:
                    ids.append(number[i])
                    vectors.append(v)
                    continue
                if not ids:
                    continue
                if squares is None:
                    names, held = np.array(ids), np.stack(vectors)
                    squares, vectors = (held * held).sum(1), []
                near = np.sqrt(np.maximum(squares - 2 * (held @ v) + v @ v, 0))
                near[names == number[i]] = np.inf
                # What rounding can bring among the first is measured exactly.
                some = np.flatnonzero(near <= (np.partition(near, top - 1)[top - 1] if len(near) >= top else np.inf) + 1e-5)
                some = some[np.isfinite(near[some])]
                exact = np.round(np.sqrt(((held[some] - v) ** 2).sum(1)), 6)
                first = np.lexsort((names[some], exact))[:top]
                out += [(number[i], int(names[some[k]]), float(exact[k])) for k in first]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "distance"])

    both = placed.select("owner_id", "unit", F.lit(0).alias("side"), F.col("vec_id").cast("long").alias("id"), "v").unionByName(asked.select("owner_id", "unit", F.lit(1).alias("side"), F.col("query_id").cast("long").alias("id"), F.col("q").alias("v")))
    return both.repartition("owner_id", "unit").sortWithinPartitions("owner_id", "unit", "side").mapInArrow(rows, "query_id long, vec_id long, distance double")


def nearest_chunks(queries: DataFrame, chunks: DataFrame, top: int = 5, unit_rows: int = 65_536) -> DataFrame:
    """The nearest chunks (owner_id, vec_id, v) of each query (owner_id, query_id, q) of the same tenant, by Euclidean
    distance rounded to six places, ties to the smaller id.

    A tenant's chunks lie in units by their norm (_units). A query is first searched in one unit of its own norm, which bounds
    the distance of its top; it then goes to those other units only whose norms are not further away than that. A tenant of
    one unit is done at once; a large one is searched in many tasks, none of which holds more than a unit. Chunks with null
    vectors take no part.
    """
    placed, units = _units(chunks.where("v IS NOT NULL"), unit_rows)
    placed, units = stored(placed, "chunk-units"), stored(units, "chunk-bounds")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    sent = queries.select("owner_id", "query_id", "q", norm.alias("norm")).join(units, "owner_id")
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("norm"), F.col("norm") - F.col("high"))
    sent = sent.withColumn("gap", gap).drop("low", "high", "norm")
    order = Window.partitionBy("owner_id", "query_id").orderBy("gap", F.xxhash64("query_id", "unit"))
    home = sent.withColumn("place", F.row_number().over(order)).where("place = 1")
    first = stored(_searched(home, placed, top), "chunk-nearest")
    limit = first.groupBy("query_id").agg(F.when(F.count("*") >= top, F.max("distance")).alias("most"))
    others = sent.join(home.select("query_id", F.col("unit").alias("home")), "query_id").where("unit <> home").join(limit, "query_id", "left")
    found = first.unionByName(_searched(others.where(F.col("most").isNull() | (F.col("gap") <= F.col("most") + 1e-5)), placed, top))
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
