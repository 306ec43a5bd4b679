"""Courses, documents, chapter sources and jobs: lists, updates, deletions, checks and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.text import half_up, micros, missing, natural_key

UNCATEGORIZED = "Uncategorized"
ACTIVE = ("queued", "processing")


def auto_archived(courses: DataFrame, today: str) -> DataFrame:
    """Courses past their exam are archived today, unless they are or once were."""
    now = F.lit(today).cast("date")
    late = ~F.col("archived") & F.col("archived_on").isNull() & (F.col("exam_date") < now)
    late = F.coalesce(late, F.lit(False))
    return courses.withColumns({"archived": F.col("archived") | late, "archived_on": F.when(late, now).otherwise(F.col("archived_on"))})


def course_list(courses: DataFrame, include_archived: bool) -> DataFrame:
    """An owner's courses in order: active ones first, then newest."""
    c = courses if include_archived else courses.where(~F.col("archived"))
    order = Window.partitionBy("owner_id").orderBy("archived", F.desc("created_on"), "course_id")
    return c.withColumn("place", F.row_number().over(order))


def newest(df: DataFrame, owner: str, by: str, tie: str, top: int) -> DataFrame:
    """The newest rows of each owner."""
    order = Window.partitionBy(owner).orderBy(F.desc(by), tie)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def patched(df: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the fields that a patch (key, fields map<string,string>) supplies, null values included; others stay."""
    j = df.join(patches.select(F.col(key).alias("__key"), F.col("fields").alias("__fields")), F.col(key) == F.col("__key"), "left")

    def new(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        given = F.coalesce(F.map_contains_key("__fields", c), F.lit(False))
        return F.when(given, F.try_element_at("__fields", F.lit(c)).cast(kind)).otherwise(F.col(c)).alias(c)

    return j.select(*[new(c) if c in columns else F.col(c) for c in df.columns])


def cascade_delete(gone: DataFrame, key: list[str], tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the rows of the keys that go, counts of what went by table)."""
    kept = {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        one = df.join(gone, key, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return kept, counts


def sources_by_chapter(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources of each course and chapter in order of creation, those without a chapter under 'uncategorized'."""
    j = sources.join(documents, "document_id")
    got = F.array_sort(F.collect_list(F.struct("source_id", "document_id", "document_title", "page_start", "page_end")))
    return j.groupBy("course_id", F.coalesce(F.col("chapter_number").cast("string"), F.lit("uncategorized")).alias("chapter")).agg(F.count("*").alias("n_sources"), got.alias("sources"))


def chapter_sources(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources with document name, page range and whether they have text."""
    j = sources.where("chapter_number IS NOT NULL").join(documents, "document_id")
    return j.select("course_id", "chapter_number", "source_id", "document_id", F.col("document_title").alias("document_name"), F.concat_ws("-", "page_start", "page_end").alias("page_range"), missing(F.col("markdown_content")).isNotNull().alias("has_markdown"))


def chapter_list(documents: DataFrame, jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Chapters of each course from documents that aren't parents of sources, running jobs and sources, in natural order,
    with 'Uncategorized' last. All three have (course_id, chapter), documents and sources also document_id."""
    own = documents.join(sources.select("document_id").distinct(), "document_id", "left_anti")
    every = own.select("course_id", "chapter").union(jobs.select("course_id", "chapter")).union(sources.select("course_id", "chapter"))
    every = every.select("course_id", F.coalesce(missing(F.col("chapter")), F.lit(UNCATEGORIZED)).alias("chapter")).distinct()
    order = Window.partitionBy("course_id").orderBy(F.col("chapter") == UNCATEGORIZED, natural_key(F.col("chapter")))
    return every.withColumn("place", F.row_number().over(order))


def reassigned(sources: DataFrame, moves: DataFrame) -> DataFrame:
    """Sources moved to another chapter by (source_id, document_id, to_chapter); only a positive number or null moves one."""
    key = ["source_id", "document_id"]
    j = sources.join(moves.withColumn("__moved", F.lit(True)), key, "left")
    moved = F.coalesce("__moved", F.lit(False)) & (F.col("to_chapter").isNull() | (F.col("to_chapter") > 0))
    return j.withColumn("chapter_number", F.when(moved, F.col("to_chapter")).otherwise(F.col("chapter_number"))).select(*sources.columns)


def foreign_references(df: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is to something that their owner doesn't have; null references are fine."""
    return df.where(F.col(key).isNotNull()).join(owned.select(key, "owner_id").distinct(), [key, "owner_id"], "left_anti")


def upload_status(asked: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status of each document asked for: not_found, completed (pages > 0), processing (a job runs) or pending."""
    running = jobs.where(F.col("status").isin(*ACTIVE)).groupBy("document_id").agg(F.min("job_id").alias("job_id"))
    j = asked.join(documents.select("document_id", "pages").withColumn("__there", F.lit(True)), "document_id", "left").join(running, "document_id", "left")
    status = F.when(F.col("__there").isNull(), "not_found").when(F.col("pages") > 0, "completed").when(F.col("job_id").isNotNull(), "processing").otherwise("pending")
    return j.select("document_id", status.alias("status"), F.when(status == "processing", F.col("job_id")).alias("job_id"))


def copied_down(children: DataFrame, parents: DataFrame, key: str, column: str) -> DataFrame:
    """children with a parent's column."""
    return children.drop(column).join(parents.select(key, column), key)


def job_list(jobs: DataFrame, kind: str | None = None, status: str | None = None, top: int = 50) -> DataFrame:
    """The newest jobs of each owner."""
    for column, value in (("type", kind), ("status", status)):
        jobs = jobs if value is None else jobs.where(F.col(column) == value)
    return newest(jobs, "owner_id", "created_at", "job_id", top)


def active_jobs(jobs: DataFrame, resource: str) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE) & (F.get_json_object("data", "$.resource") == resource))


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Jobs and mean seconds of finished ones by type and status."""
    seconds = (micros(F.col("completed_at")) - micros(F.col("created_at"))) / 1e6
    return jobs.groupBy("type", "status").agg(F.count("*").alias("jobs"), F.avg(seconds).alias("avg_seconds"))


def job_state(updates: DataFrame) -> DataFrame:
    """State of each job from (job_id, ts, update_id, status, progress): the last status and progress in 0 to 100, first and last time."""
    last = F.max_by(F.struct("status", "progress"), F.struct("ts", "update_id"))
    j = updates.groupBy("job_id").agg(last.alias("last"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"))
    return j.select("job_id", F.col("last.status").alias("status"), F.least(F.lit(100), F.greatest(F.lit(0), F.col("last.progress"))).alias("progress"), "started_at", "updated_at")


def poll(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Status of the jobs asked for; unknown ids give no row."""
    return ids.distinct().join(jobs, "job_id").select("job_id", "status")


def retained(jobs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Jobs that aren't finished, or were so within the last hours."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return jobs.where(F.col("completed_at").isNull() | (F.col("completed_at") >= cutoff))


def minutes_between(start: Column, end: Column) -> Column:
    return half_up((micros(end) - micros(start)) / 6e7)
