"""Line deduplication with DataFrame functions only: explode, hash, count documents, drop, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import BLANKS, ascii_lower, join_spread, keep, unused


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _with_lost(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, lost_col: str) -> DataFrame:
    """docs with the places of the lines to drop in lost_col, null where a text loses none. Texts are shuffled once, for that."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    lines = rows.select("id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "text_key", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.length("line") >= min_chars)
    keys = keys.withColumn("line", ascii_lower(F.col("line"))).select("id", "text_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    often = keys.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.count("*").alias("n_lines"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    often = keep(often.drop("n"), "repeated-lines")
    lost = join_spread(keys, often, ["h1", "h2"], "n_lines", "id").where(~F.col("id").eqNullSafe(F.col("last")))
    of_id, of_text = unused(docs.columns, "lost_id", "lost_text")
    lost = lost.groupBy(F.col("id").alias(of_id), F.col("text_key").alias(of_text)).agg(F.collect_set("pos").alias(lost_col))
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_text)), "left")
    return joined.drop(of_id, of_text)


def _kept(text: Column, lost: Column) -> Column:
    parts = F.split(text, "\n", -1)
    left = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost))
    return F.when(lost.isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Returns (id, n_lines, n_dropped, kept) for each row of docs.

    A key of at least min_chars code points held by at least min_docs documents loses its lines everywhere but in the
    largest id holding it. A null or empty text is one empty line and stays ''. Rows that share an id count as one
    document; equal rows get equal results. A row with a null id adds to no count and loses each such line.
    An empty table gives no rows; further columns play no part. A text of any length is one row throughout; its lines are told apart by their places.
    Keys are told apart by 128 bits of hash. Counts are partly added before they are shuffled; the lines of a key that a
    large part of all lines have are salted when they are joined to it, so none is gathered in one task.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = _with_lost(narrow, "id", "text", min_chars, min_docs, "lost")
    return joined.select("id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), _kept(F.col("text"), F.col("lost")).alias("kept"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the lines that drop_repeated_lines drops taken out of the text, and its length in length_col counted anew
    where it changed. Null texts stay null; no row goes; all columns stay, whatever their names. An empty table stays empty."""
    (name,) = unused(docs.columns, "lost")
    joined, lost = _with_lost(docs, id_col, text_col, min_chars, min_docs, name), F.col(name)
    kept = _kept(F.col(text_col), lost)
    changed = {text_col: kept}
    if length_col:
        changed[length_col] = F.when(lost.isNull(), F.col(length_col)).otherwise(F.length(kept).cast(dict(docs.dtypes)[length_col]))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
