"""Queries of the streaming family: each runs its stream over the table's files to the end and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from studylake.operators import usage as u
from studylake.plans.layout import MD8, md8_converted
from studylake.plans.registry import query
from studylake.plans.usage import ADMITTED
from studylake.sources import derive as d
from studylake.sources import versions
from studylake.sources.derive import ctes
from studylake.sources.tables import shared_dir, table, write_documents
from studylake.streaming import streams as st


def drained(spark, stream, mode="append"):
    """Runs a stream over what there is and returns its rows from the shared folder."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").outputMode("append").start().awaitTermination()
    else:

        def write(batch, batch_id):
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

        writer.foreachBatch(write).outputMode(mode).start().awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch_id", IntegerType())).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


def stream(spark, sf, name, files=1000):
    """A table's files as a stream, at most some in a micro-batch."""
    kind = table(spark, sf, name).schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(f"{sf}/{name}.parquet*")


def attempts_stream(spark, sf):
    concept = F.regexp_extract("props", "[0-9]+", 0).cast("long") % 10
    return stream(spark, sf, "events").select(F.col("user_id").alias("owner_id"), concept.alias("concept_id"), (F.col("value") >= 30).alias("was_correct"), "ts", "event_id")


def timed(spark, sf):
    return stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _mastery_sql():
    from studylake.plans.mastery import WITH_STATES

    return WITH_STATES + "SELECT owner_id, concept_id, event_id, was_correct, t AS total_attempts, r AS correct_attempts, s AS consecutive_correct, coalesce(lag(new_state) OVER (PARTITION BY owner_id, concept_id ORDER BY ts, event_id), 'not_learned') AS old_state, new_state FROM stated"


@query(_mastery_sql())
def str1_live_mastery(spark, sf):
    return drained(spark, st.live_mastery(attempts_stream(spark, sf)))


@query("SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(count(*) AS BIGINT) AS pdfs_uploaded, CAST(sum(event_id % 20) AS BIGINT) AS pages_processed FROM events GROUP BY 1, 2", dates=("month",))
def str2_usage_counters(spark, sf):
    uploads = timed(spark, sf).select("user_id", "ts", (F.col("event_id") % 20).alias("pages"))
    return st.latest_usage(drained(spark, st.usage_counters(uploads, "60 days"), "update"))


@query(ADMITTED + " SELECT owner_id, type, ts_ms, request_id, allowed FROM admitted")
def str3_rate_admission(spark, sf):
    return drained(spark, st.rate_admission(u.requests_of(stream(spark, sf, "events"), 1000), {"lesson": 3, "upload": 2}, expire=False))


@query("SELECT user_id, epoch_us(date_trunc('minute', ts)) // 60000000 AS minute_number, CAST(count(*) AS BIGINT) AS requests FROM events GROUP BY 1, 2")
def str4_minute_counts(spark, sf):
    counts = st.minute_counts(timed(spark, sf).select("user_id", "ts"), "60 days").withColumn("minute_number", F.floor(F.unix_seconds("minute") / 60)).drop("minute")
    rows = drained(spark, counts, "update")
    return rows.groupBy("user_id", "minute_number").agg(F.max_by("requests", "batch_id").alias("requests"))


@query("SELECT user_id, epoch_us(date_trunc('minute', ts)) // 60000000 AS minute_number, CAST(count(*) AS BIGINT) AS requests FROM events GROUP BY 1, 2")
def str4_counts_with_late_rows(spark, sf):
    """Rows behind the watermark are kept apart and added to what the stream has counted."""
    path = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    minute = F.floor(F.unix_seconds("ts") / 60).alias("minute_number")
    counted = lambda df: df.groupBy("user_id", minute).agg(F.count("*").alias("requests"))

    def on_time(batch, batch_id):
        counted(batch).write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")

    rows = timed(spark, sf).select("user_id", "ts")
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(st.late_apart(path, on_time, 2 * 60_000)).start().awaitTermination()
    live = spark.read.schema("user_id long, minute_number long, requests long").parquet(f"{path}/counts").drop("batch_id")
    late = spark.read.schema(rows.schema).parquet(f"{path}/late")
    return live.unionByName(counted(late)).groupBy("user_id", "minute_number").agg(F.sum("requests").alias("requests"))


@query("SELECT DISTINCT event_id // 2 AS event_id FROM events")
def str5_unique_events(spark, sf):
    twice = timed(spark, sf).select(F.floor(F.col("event_id") / 2).alias("event_id"), "ts")
    return drained(spark, st.unique_events(twice, delay="60 days")).select("event_id")


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, least(100, greatest(0, arg_max(CAST(floor(value) AS BIGINT) * 3 - 20, (ts, event_id)))) AS progress FROM events GROUP BY 1")
def str6_job_states(spark, sf):
    e = timed(spark, sf).select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("update_id"), F.col("event_type").alias("status"), (F.floor("value") * 3 - 20).alias("progress"))
    rows = drained(spark, st.job_states(e, "60 days"), "update")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "progress"), "batch_id").alias("x")).select("job_id", "x.*")


@query("""WITH e AS (SELECT user_id * 100 + day(ts) AS session_id, epoch_us(ts) // 1000 AS ms, * FROM events), c AS (SELECT session_id, min(ms) AS completed_ms FROM e WHERE event_type = 'purchase' GROUP BY 1)
    SELECT session_id, min(ms) AS started_ms, completed_ms, CAST(count(*) FILTER (WHERE ms < completed_ms) AS BIGINT) AS check_ins, CAST(count(*) FILTER (WHERE ms < completed_ms AND value >= 30) AS BIGINT) AS correct FROM e JOIN c USING (session_id) GROUP BY 1, 3""")
def str7_completed_sessions(spark, sf):
    return drained(spark, st.completed_sessions(sessions_stream(spark, sf).where("session_id IS NOT NULL"), "60 days", buckets=session_buckets(spark, sf)))


def sessions_stream(spark, sf):
    ms = F.floor(F.unix_micros(F.col("ts")) / 1000)
    return timed(spark, sf).select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"), "ts", ms.alias("ts_ms"), F.when(F.col("event_type") == "purchase", "complete").otherwise("track").alias("kind"), (F.col("value") >= 30).alias("was_correct"))


def session_buckets(spark, sf):
    """A bucket for each 2,048 events."""
    return max(1, -(-table(spark, sf, "events").count() // 2048))


@query("""WITH e AS (SELECT user_id * 100 + day(ts) AS session_id, epoch_us(ts) // 1000 AS ms, * FROM events)
    SELECT session_id, min(ms) AS started_ms, max(ms) AS last_ms, CAST(count(*) AS BIGINT) AS check_ins, CAST(count(*) FILTER (WHERE value >= 30) AS BIGINT) AS correct FROM e GROUP BY session_id
    HAVING NOT bool_or(event_type = 'purchase') AND max(ms) + 2 * 86400000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 10 * 86400000""")
def str7_abandoned_sessions(spark, sf):
    return drained(spark, st.abandoned_sessions(sessions_stream(spark, sf), "10 days", 2 * 86_400_000, session_buckets(spark, sf)))


@query("SELECT DISTINCT user_id AS document_id, event_id % 3 AS section_id, value >= 30 AS with_check_ins FROM events")
def str8_first_requests(spark, sf):
    asks = timed(spark, sf).select(F.col("user_id").alias("document_id"), (F.col("event_id") % 3).alias("section_id"), (F.col("value") >= 30).alias("with_check_ins"), "ts")
    return drained(spark, st.first_requests(asks, "60 days")).drop("ts")


@query("SELECT doc_id, md5(markdown) AS digest FROM (" + MD8 + ")")
def snk1_written_documents(spark, sf):
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    write_documents(md8_converted(spark, sf).select("doc_id", "markdown"), path, rows=table(spark, sf, "documents").count())
    return spark.read.schema("doc_id long, markdown string, bucket long").parquet(path).select("doc_id", F.md5("markdown").alias("digest"))


@query("SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(count(*) AS BIGINT) AS pdfs_uploaded, CAST(sum(event_id % 20) AS BIGINT) AS pages_processed FROM events GROUP BY 1, 2", dates=("month",))
def snk3_streamed_upsert(spark, sf):
    path = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    counters = st.usage_counters(timed(spark, sf).select("user_id", "ts", (F.col("event_id") % 20).alias("pages")), "60 days")
    counters.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(st.upsert_usage(f"{path}/rows")).outputMode("update").start().awaitTermination()
    return versions.snapshot(spark, f"{path}/rows").select("user_id", "month", "pdfs_uploaded", "pages_processed")
