"""What several operators of this subpackage share: tables in the shared folder, row keys, hot-safe prefix sums, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from studylake.sources.tables import shared_dir, table  # noqa: F401

#: The characters of the class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session has the setting meanwhile."""
    usual = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if usual is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, usual)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: the lineage ends there and no executor's loss undoes it. Nothing
    reads the shuffles of the write again, so their files go at its end and not when the driver happens to collect garbage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Rows that carry whole texts or sets go to and from Python in batches of at most `rows` in what is written meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = int(spark.conf.get(name))
    with setting(spark, name, str(min(rows, usual) if usual > 0 else rows)):
        yield


def text_batches(spark: SparkSession, rows: int = 1024, size: int = 1 << 20) -> None:
    """From now on the session's rows go to and from Python in batches of at most `rows` rows and about `size` bytes, for what is
    given back unwritten: batches are cut when a frame is computed. A smaller number of rows that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, usual) if usual > 0 else rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def forget(df: DataFrame) -> None:
    """Deletes a table that keep() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column already has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_places(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two columns that name a row by its file and its place there, and their names; reads agree on them. Rows that
    do not come from files are written to the shared folder first."""
    names = unused(docs.columns, "row_file", "row_place")
    here = [F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    try:
        return docs.select("*", *here), names
    except AnalysisException:
        return keep(docs, "placed-rows").select("*", *here), names


def join_spread(rows: DataFrame, held: DataFrame, on: list[str], count: str, by: str, parts: int = 2048, least: int = 64) -> DataFrame:
    """rows joined to held on equal (or both null) columns; held has each key once, with its number of rows in `count`.

    A key with more than 1/parts of all rows is dealt to as many salts as it has such parts, by the hash of the column
    `by`, and held's row is repeated for each. There are fewer than `parts` such keys, so they may be broadcast.
    """
    total = held.agg(F.sum(count)).first()[0] or 0
    room = max(-(-total // parts), least)
    salts, salt, salt_of, *keys = unused([*rows.columns, *held.columns], "salts", "salt", "salt_of", *[f"key_{c}" for c in on])
    named = held.withColumnsRenamed(dict(zip(on, keys, strict=True))).withColumn(salts, F.ceil(F.col(count) / room).cast("int"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(on, keys, strict=True)]
    hot = named.where(F.col(salts) > 1).select(*keys, salts)
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn(salt, F.pmod(F.xxhash64(by), F.coalesce(F.col(salts), F.lit(1))).cast("int")).drop(salts, *keys)
    each = named.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(F.col(salts), F.lit(1)) - 1))).drop(salts).withColumnRenamed(salt, salt_of)
    return dealt.join(each, [*same, F.col(salt) == F.col(salt_of)]).drop(salt, salt_of, *keys)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than BLANKS; null has none."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str, fan: int = 1024) -> DataFrame:
    """Adds the sum of value over the rows of the group that come before a row in the order (bucket, *order).

    The rows are sorted bucket by bucket, the buckets' sums `fan` at a time; only sums of (group, fan buckets) meet in
    one place, so a hot group is spread over its buckets. Nulls in group match each other. bucket is an integer.
    """
    total, ahead, many, many_ahead, *keys = unused([*df.columns, out], "sum", "ahead", "many", "many_ahead", *[f"of_{c}" for c in (*group, bucket)])
    before = w.Window.rowsBetween(w.Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias(total)).withColumn(many, F.floor(F.col(bucket) / fan))
    inner = F.coalesce(F.sum(total).over(before.partitionBy(*group, many).orderBy(bucket)), F.lit(0))
    outer = F.coalesce(F.sum(total).over(before.partitionBy(*group).orderBy(many)), F.lit(0))
    large = sums.groupBy(*group, many).agg(F.sum(total).alias(total)).select(*[F.col(c).alias(k) for c, k in zip((*group, many), keys, strict=True)], outer.alias(many_ahead))
    sums = sums.withColumn(ahead, inner).join(large, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip((*group, many), keys, strict=True)])
    sums = sums.select(*[F.col(c).alias(f"{k}_") for c, k in zip((*group, bucket), keys, strict=True)], (F.col(ahead) + F.col(many_ahead)).alias(ahead))
    inside = w.Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(w.Window.unboundedPreceding, 0)
    joined = df.join(sums, [F.col(c).eqNullSafe(F.col(f"{k}_")) for c, k in zip((*group, bucket), keys, strict=True)])
    return joined.withColumn(out, F.col(ahead) + F.sum(value).over(inside) - F.col(value)).drop(ahead, *[f"{k}_" for k in keys])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (node, component) for each node, component being its smallest node; a
    table in the shared folder.

    Alternates large-star and small-star steps until nothing changes: each step links a node's neighbours to the
    smallest of them, so an edge list stays an edge list and no component is ever gathered. Every step is a table in
    the shared folder, of which only the last two are held.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = both(e)
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = e.join(least, "a")
        if large:
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = digest(now)
    was = None
    while seen != was and seen[0]:
        then = keep(star(star(now, True), False), "edges")
        forget(now)
        now, was = then, seen
        seen = digest(now)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = keep(out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    forget(now)
    return out


def first_units(members: DataFrame, room: int) -> DataFrame:
    """(unit, side, group, member) of groups (group, n, member), n being a group's members: each group in parts of about room
    members, dealt by a hash, with the group's first member in each part."""
    n = F.ceil(F.col("n") / room).cast("int")
    own = F.pmod(F.xxhash64("member"), n).cast("int")
    parts = members.select(F.xxhash64("group", own).alias("unit"), F.lit(0).alias("side"), "group", "member")
    heads = members.where(F.col("n") > room).groupBy("group", "n").agg(F.min("member").alias("member"))
    heads = heads.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).where("part <> own")
    return parts.unionByName(heads.select(F.xxhash64("group", "part").alias("unit"), F.lit(0).alias("side"), "group", "member"))


def more_units(members: DataFrame, room: int) -> DataFrame:
    """(unit, side, group, member, comp) of groups (group, n, member, comp) that have members of several components.

    In these units each two members of one group and different components meet, for units with two sides those of
    different sides. A group of at most room members is one unit. Of a larger one the largest component's parts of about
    room members meet all parts of the rest, and the parts of the rest each other; so what the first units have joined
    costs no pairs of parts.
    """
    sizes = members.groupBy("group", "comp").agg(F.count("*").alias("c"))
    most = sizes.groupBy("group").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("total")).where("top.c < total")
    tops, rests = F.ceil(F.col("top.c") / room).cast("int"), F.ceil((F.col("total") - F.col("top.c")) / room).cast("int")
    dealt = join_spread(members, most.select("group", F.col("top.comp").alias("top"), "total", tops.alias("tops"), rests.alias("rests")), ["group"], "total", "member")
    small, large = dealt.where(F.col("total") <= room), dealt.where(F.col("total") > room)

    def part(count: str) -> Column:
        return F.pmod(F.xxhash64("member", F.lit(1)), F.col(count)).cast("int")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def units(rows: DataFrame, side: Column, *name: Column) -> DataFrame:
        return rows.select(F.xxhash64("group", *name).alias("unit"), side.cast("int").alias("side"), "group", "member", "comp")

    inside = large.where("comp = top").withColumn("i", part("tops")).withColumn("j", each("rests"))
    rest = large.where("comp <> top").withColumn("own", part("rests"))
    pairs = rest.withColumn("other", each("rests"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    # A unit of one part with itself has one side.
    among = units(pairs, F.when(F.col("own") == F.col("other"), 0).otherwise(F.col("own")), F.lit(2), i, j)
    across = units(inside, F.lit(0), F.lit(1), F.col("i"), F.col("j")).unionByName(units(rest.withColumn("i", each("tops")), F.lit(1), F.lit(1), F.col("i"), F.col("own")))
    return units(small, F.lit(0), F.lit(0)).unionByName(across).unionByName(among)


def task_count(spark: SparkSession, rows: int, each: int = 1 << 19) -> int:
    """As many tasks as shuffle partitions are set, or more where a task would otherwise get over `each` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def by_unit(units: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows_of_units: int) -> DataFrame:
    """solve applied to frames that hold whole units; a unit's rows are consecutive but may go on in the next Arrow batch.
    rows_of_units, about as many as units has, sets the number of tasks."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            rest = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
            if len(rest):
                last = rest["unit"].to_numpy() == rest["unit"].iloc[-1]
                yield solve(rest[~last])
                rest = rest[last]
        if rest is not None and len(rest):
            yield solve(rest)

    return units.repartition(task_count(units.sparkSession, rows_of_units), "unit").sortWithinPartitions("unit").mapInPandas(rows, schema)


def spot(c: str, bits: int) -> Column:
    """Place of an id in a bitmap."""
    return F.pmod(F.xxhash64(c), F.lit(bits))


def id_bitmap(ids: DataFrame, col: str, most_bits: int = 1 << 27) -> tuple[np.ndarray, int]:
    """(bytes of a bitmap, its bits) in which the spots of all ids are set: 16 bits an id, at most most_bits (16 MB) in all,
    so it can be sent to every task. Beyond that many ids it lets more others through, but never misses one."""
    n = ids.count()
    bits = min(most_bits, 1 << max(20, (16 * n).bit_length()))
    spots = ids.select((spot(col, bits) + 1).alias("spot"))
    blocks = spots.groupBy(F.bitmap_bucket_number("spot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("map"))
    table = np.zeros(bits >> 3, np.uint8)
    for block, raw in blocks.collect():
        table[(block - 1) << 12 : block << 12] = np.frombuffer(raw, np.uint8)
    return table, bits


def in_bitmap(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def by_bitmap(docs: DataFrame, id_col: str, table: np.ndarray, bits: int, hit: bool) -> DataFrame:
    """Rows of docs whose integer id has its spot in a bitmap set, or those whose id hasn't (null ids with them). Only the spots
    go to Python, whatever else the rows carry."""

    @F.pandas_udf("boolean")
    def found(at: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(table, np.maximum(at.to_numpy(), 0)) & (at.to_numpy() >= 0))

    at = F.when(F.col(id_col).isNotNull(), spot(id_col, bits)).otherwise(-1)
    # Not deterministic for the optimiser: it stays where it is written and is moved over no join.
    return docs.where(found.asNondeterministic()(at) == hit)


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame, gone_col: str) -> DataFrame:
    """Rows of docs whose integer id isn't in gone; null ids stay. A bitmap tells most rows apart where they are, and only
    those that it can't clear are shuffled to be compared exactly."""
    table, bits = id_bitmap(gone, gone_col)
    name = unused(docs.columns, "gone_id")[0]
    doubtful = by_bitmap(docs, id_col, table, bits, True)
    left = doubtful.join(gone.select(F.col(gone_col).alias(name)), F.col(id_col) == F.col(name), "left_anti")
    return by_bitmap(docs, id_col, table, bits, False).unionByName(left)
