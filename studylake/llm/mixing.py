"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from studylake.llm.common import forget, join_spread, keep, row_places, running_sum, uniform, unused


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Returns (source, source_size, n_docs, target) for each source of (source, size) rows.

    Sources, by code point and null last, weigh what weights holds, repeating. They share the sum of all sizes by weight;
    a target stops at most times its source's size and what is over goes to the others by weight. The level at which the
    rest share is found from sorted ratios in closed form. One row a source: only these meet in one place.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = w.Window.partitionBy()
    rank = F.row_number().over(w.Window.partitionBy().orderBy(F.asc_nulls_last("source"))) - 1
    shares = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("weight", F.get(shares, F.pmod(rank, F.lit(len(weights))))).withColumn("cap", most * F.col("source_size").cast("double"))
    by_ratio = w.Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    full = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(w.Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, w.Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - full) / rest)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap") * (1 + 1e-12), F.col("level"))).over(everything)
    return per.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def root_of(size: Column) -> Column:
    """A preference for long documents, whose odds grow with the root of their size."""
    return F.sqrt(F.greatest(size, F.lit(1)).cast("double"))


def _scales(rows: DataFrame, per: DataFrame, most: int) -> DataFrame:
    """(of, scale, shape) of each source: with min(most, scale * worth) copies of each document the target is reached; shape
    lists how many documents have which odds of the fraction. A source has a few dozen levels of worth, so this is small."""
    levels = rows.where("size > 0").groupBy(F.col("source").alias("of"), "worth").agg(F.sum("size").cast("double").alias("words"), F.count("*").alias("n"))
    levels = levels.join(per.select(F.col("of").alias("of2"), "target"), F.col("of").eqNullSafe(F.col("of2"))).drop("of2")
    down = w.Window.partitionBy("of").orderBy(F.desc("worth"))
    full = F.coalesce(F.sum("words").over(down.rowsBetween(w.Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("words") * F.col("worth")).over(down.rowsBetween(0, w.Window.unboundedFollowing))
    levels = levels.withColumn("scale", (F.col("target") - most * full) / rest)
    fits = F.when(F.col("scale") * F.col("worth") <= most * (1 + 1e-12), F.col("scale"))
    levels = levels.withColumn("scale", F.max(fits).over(w.Window.partitionBy("of")))
    p = F.col("expected") - F.floor("expected")
    levels = levels.withColumn("expected", _expected(F.col("scale"), F.col("worth"), most)).withColumn("odds", p / (1 - p))
    return levels.groupBy("of").agg(F.max("scale").alias("scale"), F.collect_list(F.when(F.col("odds") > 0, F.struct("odds", "n"))).alias("shape"))


def _expected(scale: Column, worth: Column, most: int) -> Column:
    """Expected copies; what is within rounding of a whole number is that number."""
    found = F.least(F.lit(float(most)), F.coalesce(scale, F.lit(0.0)) * worth)
    return F.when(F.abs(found - F.round(found)) < 1e-9, F.round(found)).otherwise(found)


def mix(docs: DataFrame, id_col: str, source_col: str, size: Column, preference: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 7, fills: int = 3, bucket_rows: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """Returns (id, source, size, source_size, target, copies) for each row of docs: how often the mix takes it whole.

    A document's expected copies are its preference (positive; 1 where it is null or not given; in steps of an eighth of
    a doubling) times what makes its source's words reach the target, and most at most. Their whole part is certain. The
    fraction is an inclusion probability p: documents are ranked by the odds of a random number over the odds of p, and
    taken in that order while the words left of the target allow, so the sample's size is fixed in words; documents that
    still fit into what is left follow in the same order, fills times, in the last also those that may have one more copy
    than expected. So each source misses its target by about the smallest document that is left. The random number depends on the id and
    seed, so reruns agree; rows equal in id, source and size may get different copies among themselves. Null or empty texts have size 0
    and no copies; an empty table gives no rows. Of further columns only those in carry are kept, as they are.

    A source's words are summed by buckets of about bucket_rows documents: the bucket is the share of the source's
    documents that is expected before a rank, and a hash for documents without a fraction. So no source is sorted as one group.
    """
    liked = F.lit(1.0) if preference is None else F.coalesce(F.when((preference > 0) & (preference < float("inf")), preference.cast("double")), F.lit(1.0))
    worth = F.pow(F.lit(2.0), F.floor(8 * F.log2(liked)) / F.lit(8.0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), worth.alias("worth"), *carry)
    rows = keep(rows, "mix-sizes")
    per = source_targets(rows, weights, most).withColumnRenamed("source", "of")
    per = per.join(_scales(rows, per, most).withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2")
    sizes, per = rows, keep(per.withColumnRenamed("of", "source"), "mix-sources")
    rows = join_spread(rows, per, ["source"], "n_docs", "id")
    expected = F.when(F.col("size") > 0, _expected(F.col("scale"), F.col("worth"), most)).otherwise(0.0)
    rows = rows.withColumn("expected", expected).withColumn("copies", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("copies"))
    u = uniform(F.col("id"), F.lit(seed))
    rows = rows.withColumn("rank", F.try_divide((u / (1 - u)) * (1 - F.col("p")), F.col("p")))
    before = F.aggregate("shape", F.lit(0.0), lambda s, x: s + x["n"] * (F.col("rank") * x["odds"] / (1 + F.col("rank") * x["odds"])))
    every = F.aggregate("shape", F.lit(0.0), lambda s, x: s + x["n"])
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows))
    bucket = F.coalesce(F.least(F.floor(F.try_divide(before, every) * buckets), buckets - 1), F.pmod(F.xxhash64("id", F.lit(seed)), buckets))
    kept = ["id", "source", "size", "source_size", "target", "p", "rank", "copies", *carry]
    rows = keep(rows.select(*kept, bucket.cast("long").alias("bucket"), F.lit(False).alias("taken")), "mix-ranked")
    forget(sizes)
    for turn in range(fills):
        had = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("had"), F.count("*").alias("rows"))
        left = join_spread(rows, had, ["source"], "rows", "id").withColumn("left", F.col("target") - F.col("had"))
        asks = (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        asks &= (F.col("copies") < most) if turn == fills - 1 else (~F.col("taken") & (F.col("p") > 0))
        left = left.withColumn("ask", F.when(asks, F.col("size")).otherwise(F.lit(0)).cast("long"))
        summed = running_sum(left, ["source"], "bucket", ["rank", "id", "size"], "ask", "before")
        take = (F.col("ask") > 0) & (F.col("before") + F.col("ask") <= F.col("left"))
        after = summed.withColumn("taken", F.col("taken") | take).withColumn("copies", F.col("copies") + take.cast("long")).select(*rows.columns)
        after = keep(after, "mix-taken")
        forget(rows)
        rows = after
    forget(per)
    return rows.select("id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", *carry)


def mixed_rows(docs: DataFrame, id_col: str, source_col: str, size: Column, **how) -> DataFrame:
    """docs with each row as often as mix takes it, none to `most` times, and all columns as they are. Rows are told apart by
    their places, so equal ones are taken as mix counts them."""
    placed, names = row_places(docs)
    copy, *of = unused(placed.columns, "mix_copies", "mix_file", "mix_place")
    found = mix(placed, id_col, source_col, size, carry=tuple(names), **how).where("copies > 0")
    found = found.select(F.col("copies").cast("int").alias(copy), *[F.col(c).alias(n) for c, n in zip(names, of, strict=True)])
    joined = placed.join(found, [F.col(a) == F.col(b) for a, b in zip(names, of, strict=True)])
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copy)))).select(*docs.columns)
