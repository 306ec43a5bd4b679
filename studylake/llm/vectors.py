"""What the two vector searches share: usable vectors, repeated vectors, best rows of a query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

RESULT = "query_id long, vec_id long, score double"


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """(id, v) of the rows whose id and vector are not null and whose components are finite; zero: also zero vectors.

    Vectors of another length than most have are left out, as an inner product with them is not defined.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    usual = rows.agg(F.mode(F.size("v"), deterministic=True)).first()[0]
    return rows.where(F.size("v") == F.lit(usual or 0))


def first_rows(rows: DataFrame, group: str, order: list, most: int, spread: str, salts: int = 64) -> DataFrame:
    """The first `most` rows of each group in an order; a large group is first thinned in parts dealt by the column `spread`."""
    part = F.pmod(F.xxhash64(spread), F.lit(salts))
    for by in ([group, part], [group]):
        rows = rows.withColumn("place", F.row_number().over(w.Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most).drop("place")
    return rows


def smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """Of each group of equal vectors the rows with the most smallest ids: among equal scores no others can be in a top
    list of fewer than most. Queries are not thinned, only what they can find."""
    return first_rows(rows, "v", ["id"], most, "id")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller id, ranked from 1."""
    order = w.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_of_row(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in one row, ties to the smaller id."""
    where = np.arange(len(scores))
    if len(scores) > k:
        where = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return where[np.lexsort((ids[where], -scores[where]))][:k]


def matrix(column, kind: str) -> np.ndarray:
    """Rows of raw bytes as a matrix."""
    rows = list(column)
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)
