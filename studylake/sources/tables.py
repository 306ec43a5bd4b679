"""Reading and writing tables: Parquet by name, extraction JSON, stored objects, row checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "struct<page:int,text:string>"
TABLE = "struct<page:int,table_index:int,caption:string,context:string,headers:array<string>,rows:array<array<string>>,row_count:int,col_count:int,page_start:int,page_end:int,merged:boolean>"
FORMULA = "struct<page:int,formula_index:int,latex:string,corrected:boolean>"
CODE = "struct<page:int,code_block_index:int,line_count:int,code:string,language:string>"
IMAGE = "struct<page:int,image_index:int,width:int,height:int,format:string,size_bytes:bigint>"
#: The object that an extraction gives for one document.
EXTRACTION = f"doc_id bigint, pages array<{PAGE}>, tables array<{TABLE}>, images array<{IMAGE}>, formulas array<{FORMULA}>, code_blocks array<{CODE}>"
CONTENTS = ("pages", "tables", "images", "formulas", "code_blocks")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="studylake-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read again: its lineage ends there, and no executor's loss undoes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df if it has the columns with these types, else an error that names the first that differs."""
    have = dict(df.dtypes)
    for name, kind in schema.items():
        if have.get(name) != kind:
            raise TypeError(f"{name} is {have.get(name)}, not {kind}")
    return df


def read_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(extractions, rejects) of JSON files, each with one object or an array of them, over any lines. Files that can't be parsed
    are rejects (file, broken): their whole text, with the place they came from. Fields that a document lacks are null."""
    found = spark.read.schema(f"{EXTRACTION}, broken string").option("columnNameOfCorruptRecord", "broken").json(path, multiLine=True)
    rows = found.withColumn("file", F.col("_metadata.file_path"))
    # Spark gives the text of broken files only to queries that read a further column as well: any hash is.
    any_row = F.hash("doc_id") >= -(1 << 31)
    return rows.where("broken IS NULL").drop("broken", "file"), rows.where(F.col("broken").isNotNull() & any_row).select("file", "broken")


def read_relational(spark: SparkSession, url: str, name: str, schema: dict[str, str], key: str, driver: str | None = None, rows_a_part: int = 100_000) -> DataFrame:
    """A table of a database, read in ranges of an integer key by as many tasks as its rows ask for; the bounds are the key's
    least and largest. Filters and columns that are asked for later are pushed to the database. Rows with a null key are read
    with the first range. The columns' types are checked."""
    options = {"url": url} | ({"driver": driver} if driver else {})
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high, n = spark.read.format("jdbc").options(**options, query=f"SELECT min({quoted}) AS low, max({quoted}) AS high, count(*) AS n FROM {name}").load().first()
    reader = spark.read.format("jdbc").options(**options, dbtable=name)
    if n and low != high:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high + 1, numPartitions=max(1, -(-n // rows_a_part)))
    return checked(reader.load(), schema)


def write_relational(df: DataFrame, url: str, name: str, schema: dict[str, str], driver: str | None = None, column_types: str = "", parts: int = 8) -> None:
    """Puts df in the place of a database's table: written by several tasks into a table of its own, counted, and put in place
    in one transaction, so a reader sees the old rows or the new. A wrong schema, or a write that lost rows, leaves the old table."""
    spark = df.sparkSession
    stage = f"{name}_{uuid.uuid4().hex[:12]}"
    options = {"url": url} | ({"driver": driver} if driver else {})
    rows = checked(df.select(*schema), schema)
    rows.write.format("jdbc").options(**options, dbtable=stage, numPartitions=parts, **({"createTableColumnTypes": column_types} if column_types else {})).mode("errorifexists").save()
    manager = spark._jvm.java.sql.DriverManager
    connection = manager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        found = statement.executeQuery(f"SELECT count(*) FROM {stage}")
        found.next()
        wrote, want = found.getLong(1), rows.count()
        found.close()
        there = connection.getMetaData().getTables(None, None, name.upper(), None)
        old = there.next()
        there.close()
        if wrote != want:
            statement.execute(f"DROP TABLE {stage}")
            connection.commit()
            raise RuntimeError(f"{wrote} of {want} rows reached {name}")
        if old:
            statement.execute(f"DROP TABLE {name}")
        statement.execute(f"RENAME TABLE {stage} TO {name}")
        connection.commit()
    finally:
        connection.rollback()
        connection.close()


def content(extractions: DataFrame, kind: str) -> DataFrame:
    """One content type of extractions as rows (doc_id, ordinal, its fields); absent lists give none."""
    rows = extractions.select("doc_id", F.posexplode(kind).alias("ordinal", "item"))
    return rows.select("doc_id", "ordinal", "item.*")


def parse_output(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of raw extractor output: null texts become '', outputs without pages are rejected."""
    parsed = df.withColumn("parsed", F.from_json(raw, f"pages array<{PAGE}>"))
    good = parsed.where("parsed.pages IS NOT NULL")
    pages = good.select("doc_id", F.explode("parsed.pages").alias("p")).select("doc_id", "p.page", F.coalesce("p.text", F.lit("")).alias("text"))
    return pages, parsed.where("parsed.pages IS NULL").select("doc_id", raw)


def parse_vision(df: DataFrame, raw: str) -> DataFrame:
    """A page's vision JSON; one that can't be parsed keeps its raw text with an error."""
    parsed = F.from_json(raw, "text string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = df.withColumn("parsed", parsed)
    bad = F.col("parsed.broken").isNotNull()
    return rows.select("doc_id", "page", F.when(bad, F.col(raw)).otherwise(F.coalesce("parsed.text", F.lit(""))).alias("text"), F.when(bad, F.lit("invalid JSON")).alias("error"))


def stored_objects(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """Listing of the objects below a path: key, size, time. Their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size_bytes"), "modificationTime")


def json_or(c: Column, schema: str, fallback: Column) -> Column:
    """Decoded JSON, or the fallback where it is null or can't be parsed."""
    return F.coalesce(F.from_json(c, schema), fallback)


def payloads(df: DataFrame, raw: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with the JSON of raw as a variant, payload; rejects): for objects of any shape. Null and malformed JSON are rejects."""
    rows = df.withColumn("payload", F.try_parse_json(raw))
    return rows.where("payload IS NOT NULL"), rows.where("payload IS NULL").drop("payload")


def field(payload: str, path: str, kind: str) -> Column:
    """A path of a variant as a type; null where it is absent or of another kind."""
    return F.try_variant_get(F.col(payload), path, kind)


def shapes(rows: DataFrame, payload: str, *group: str) -> DataFrame:
    """(group, rows, shape): the schema that all payloads of a group have together."""
    return rows.groupBy(*group).agg(F.count("*").alias("rows"), F.schema_of_variant_agg(payload).alias("shape"))


def write_documents(df: DataFrame, path: str, buckets: int = 64, rows_a_file: int = 10_000, rows: int | None = None) -> None:
    """(doc_id, markdown) as Parquet, partitioned by a bucket of the id; a bucket has as many files as its rows ask for, so
    the number of tasks grows with the documents. rows is their number where it is known, else they are counted."""
    files = max(1, -(-(df.count() if rows is None else rows) // (buckets * rows_a_file)))
    placed = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(files))
    placed.repartition(min(buckets * files, 100_000), "bucket", spread).write.option("maxRecordsPerFile", 2 * rows_a_file).partitionBy("bucket").parquet(path)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], first: list[str]) -> DataFrame:
    """Rows of new whose key is not in old, the first of each key in the order given; nulls in a key match each other."""
    names = {c: f"__{c}" for c in key}
    had = old.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
    rest = new.join(had, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left_anti")
    best = rest.groupBy(*key).agg(F.min(F.struct(*first, *[c for c in new.columns if c not in (*key, *first)])).alias("__row"))
    return best.select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in new.columns])


def additive_upsert(old: DataFrame, delta: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """old with the increments of delta added; new keys enter."""
    return old.select(*key, *counters).unionByName(delta.select(*key, *counters)).groupBy(*key).agg(*[F.sum(c).alias(c) for c in counters])
