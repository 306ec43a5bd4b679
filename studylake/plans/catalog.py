"""Queries of the catalogue and job family, sinks and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from studylake.operators import catalog as c
from studylake.operators import retrieve
from studylake.plans.registry import query
from studylake.sources import derive as d
from studylake.sources import tables as t
from studylake.sources import versions
from studylake.sources.derive import ctes
from studylake.sources.tables import table

TODAY = "1998-01-13"
TITLES = "titles AS (SELECT s_suppkey AS document_id, s_name AS document_title FROM supplier)"
DOCS = "docs AS (SELECT s_suppkey AS document_id, CAST(s_nationkey AS BIGINT) AS owner_id, s_suppkey % 4 AS course_id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Chapter ' || (s_suppkey % 12) END AS chapter, s_suppkey % 3 * 10 AS pages FROM supplier)"


def titles(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("document_title"))


def docs(spark, sf):
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(s.alias("document_id"), F.col("s_nationkey").cast("long").alias("owner_id"), (s % 4).alias("course_id"), F.when(s % 5 == 0, "").otherwise(F.concat(F.lit("Chapter "), (s % 12).cast("string"))).alias("chapter"), (s % 3 * 10).alias("pages"))


ARCHIVED = f"""SELECT course_id, name, owner_id, exam_date, archived OR late AS archived, CASE WHEN late THEN DATE '{TODAY}' ELSE archived_on END AS archived_on, created_on
    FROM (SELECT *, NOT archived AND archived_on IS NULL AND exam_date < DATE '{TODAY}' AS late FROM courses)"""


@query(ctes("courses") + ARCHIVED, dates=("exam_date", "archived_on", "created_on"))
def cat1_auto_archived(spark, sf):
    return c.auto_archived(d.courses(spark, sf), TODAY)


@query(ctes("courses") + f"SELECT owner_id, course_id, archived, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY archived, created_on DESC, course_id) AS INTEGER) AS place FROM ({ARCHIVED}) WHERE NOT archived")
def cat2_course_list(spark, sf):
    return c.course_list(c.auto_archived(d.courses(spark, sf), TODAY), False).select("owner_id", "course_id", "archived", "place")


@query("SELECT * FROM (SELECT o_custkey AS owner_id, o_orderkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 5")
def cat3_newest_documents(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))
    return c.newest(rows, "owner_id", "created_at", "document_id", 5).drop("created_at")


@query("WITH " + DOCS + """ SELECT document_id, owner_id, CASE WHEN document_id % 3 = 0 THEN NULL ELSE course_id END AS course_id, CASE WHEN document_id % 4 = 0 THEN 'Moved' ELSE chapter END AS chapter, pages FROM docs""")
def cat4_patched_documents(spark, sf):
    base = docs(spark, sf)
    k = F.col("document_id")
    null_course = F.when(k % 3 == 0, F.create_map(F.lit("course_id"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    chapter = F.when(k % 4 == 0, F.create_map(F.lit("chapter"), F.lit("Moved"))).otherwise(F.create_map().cast("map<string,string>"))
    patches = base.where((k % 3 == 0) | (k % 4 == 0)).select("document_id", F.map_concat(null_course, chapter).alias("fields"))
    return c.patched(base, patches, "document_id", ["course_id", "chapter"])


@query(ctes("attempts", "concepts", "sections") + """
    SELECT 'concepts' AS table_name, CAST(count(*) AS BIGINT) AS deleted FROM concepts WHERE owner_id % 7 = 0
    UNION ALL SELECT 'sections', CAST(count(*) AS BIGINT) FROM sections WHERE owner_id % 7 = 0
    UNION ALL SELECT 'attempts', CAST(count(*) AS BIGINT) FROM attempts WHERE owner_id IN (SELECT owner_id FROM concepts) AND owner_id % 7 = 0""")
def cat5_cascade_counts(spark, sf):
    concepts = d.concepts(spark, sf)
    gone = concepts.where("owner_id % 7 = 0").select("owner_id").distinct()
    return c.cascade_delete(gone, ["owner_id"], {"concepts": concepts, "sections": d.sections(spark, sf), "attempts": d.attempts(spark, sf)})[1]


@query(ctes("attempts", "concepts") + "SELECT owner_id, concept_id, section_id FROM concepts WHERE owner_id % 7 <> 0 AND section_id <> 1")
def cat6_kept_lessons(spark, sf):
    concepts = d.concepts(spark, sf)
    gone = concepts.where("owner_id % 7 = 0").select("owner_id").distinct()
    return c.cascade_delete(gone, ["owner_id"], {"lessons": concepts})[0]["lessons"].where("section_id <> 1").select("owner_id", "concept_id", "section_id")


@query(ctes("chapter_sources").rstrip() + ", " + TITLES + """
    SELECT course_id, coalesce(CAST(chapter_number AS VARCHAR), 'uncategorized') AS chapter, CAST(count(*) AS BIGINT) AS n_sources, string_agg(source_id || ':' || document_title, ';' ORDER BY source_id, document_id) AS sources
    FROM chapter_sources JOIN titles USING (document_id) GROUP BY 1, 2""")
def cat7_sources_by_chapter(spark, sf):
    found = c.sources_by_chapter(d.chapter_sources(spark, sf), titles(spark, sf))
    shown = F.transform("sources", lambda x: F.concat(x["source_id"].cast("string"), F.lit(":"), x["document_title"]))
    return found.withColumn("sources", F.array_join(shown, ";"))


@query(ctes("chapter_sources").rstrip() + ", " + TITLES + """
    SELECT course_id, chapter_number, source_id, document_id, document_title AS document_name, page_start || '-' || page_end AS page_range, markdown_content <> '' AS has_markdown FROM chapter_sources JOIN titles USING (document_id) WHERE chapter_number IS NOT NULL""")
def cat8_chapter_sources(spark, sf):
    return c.chapter_sources(d.chapter_sources(spark, sf), titles(spark, sf))


#: Documents of the corpus; those with labels have sources.
CORPUS = "corpus AS (SELECT doc_id AS document_id, doc_id % 25 AS owner_id, doc_id % 4 AS course_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Chapter ' || (doc_id % 12) END AS chapter FROM documents)"


def corpus(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(k.alias("document_id"), (k % 25).alias("owner_id"), (k % 4).alias("course_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Chapter "), (k % 12).cast("string"))).alias("chapter"))


@query("WITH " + CORPUS + " SELECT document_id, owner_id FROM corpus WHERE document_id NOT IN (SELECT doc_id FROM labels)")
def cat9_documents_without_sources(spark, sf):
    sources = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id")).distinct()
    return corpus(spark, sf).join(sources, "document_id", "left_anti").select("document_id", "owner_id")


CHAPTERS = CORPUS + """, src AS (SELECT DISTINCT doc_id AS document_id, doc_id % 4 AS course_id, CASE WHEN quality = 0 THEN NULL ELSE CAST(doc_id % 30 AS VARCHAR) END AS chapter FROM labels),
    running AS (SELECT o_custkey % 4 AS course_id, 'Chapter ' || (o_orderkey % 40) AS chapter FROM orders WHERE o_orderstatus = 'P'),
    every AS (SELECT DISTINCT course_id, coalesce(nullif(chapter, ''), 'Uncategorized') AS chapter FROM (SELECT course_id, chapter FROM corpus WHERE document_id NOT IN (SELECT document_id FROM src)
        UNION ALL SELECT course_id, chapter FROM running UNION ALL SELECT course_id, chapter FROM src))"""


@query("WITH " + CHAPTERS + """ SELECT course_id, chapter, CAST(row_number() OVER (PARTITION BY course_id ORDER BY chapter = 'Uncategorized', CASE WHEN chapter LIKE 'Chapter %' THEN 'chapter ' || lpad(substr(chapter, 9), 40, '0') ELSE lpad(chapter, 40, '0') END) AS INTEGER) AS place FROM every""")
def cat10_chapter_list(spark, sf):
    k = F.col("doc_id")
    sources = table(spark, sf, "labels").select(k.alias("document_id"), (k % 4).alias("course_id"), F.when(F.col("quality") != 0, (k % 30).cast("string")).alias("chapter"))
    running = table(spark, sf, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 4).alias("course_id"), F.concat(F.lit("Chapter "), (F.col("o_orderkey") % 40).cast("string")).alias("chapter"))
    return c.chapter_list(corpus(spark, sf), running, sources)


@query(ctes("chapter_sources") + """SELECT source_id, document_id, course_id, CASE WHEN source_id % 6 = 0 THEN CASE source_id % 4 WHEN 0 THEN NULL ELSE source_id % 8 END ELSE chapter_number END AS chapter_number FROM chapter_sources""")
def cat11_reassigned(spark, sf):
    sources = d.chapter_sources(spark, sf)
    s = F.col("source_id")
    moves = sources.where(s % 6 == 0).select("source_id", "document_id", F.when(s % 4 != 0, s % 8).alias("to_chapter"))
    return c.reassigned(sources, moves).select("source_id", "document_id", "course_id", "chapter_number")


@query(ctes("sessions") + "SELECT owner_id, session_id, course_id FROM sessions s WHERE course_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s.course_id AND n_regionkey = s.owner_id % 5)")
def cat12_foreign_references(spark, sf):
    courses = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("course_id"), F.col("n_regionkey").cast("long").alias("owner_id"))
    sessions = d.sessions(spark, sf).select(F.col("owner_id").alias("user_id"), "session_id", "course_id", (F.col("owner_id") % 5).alias("owner_id"))
    return c.foreign_references(sessions, courses, "course_id").select(F.col("user_id").alias("owner_id"), "session_id", "course_id")


@query("WITH " + DOCS + """, running AS (SELECT o_orderkey AS document_id, min(o_orderkey) AS job_id FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1)
    SELECT p_partkey AS document_id, status, CASE WHEN status = 'processing' THEN job_id END AS job_id
    FROM (SELECT p_partkey, job_id, CASE WHEN d.document_id IS NULL THEN 'not_found' WHEN pages > 0 THEN 'completed' WHEN job_id IS NOT NULL THEN 'processing' ELSE 'pending' END AS status
        FROM part LEFT JOIN docs d ON d.document_id = p_partkey LEFT JOIN running r ON r.document_id = p_partkey)""")
def cat13_upload_status(spark, sf):
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"))
    jobs = d.jobs(spark, sf).withColumn("document_id", F.col("job_id"))
    return c.upload_status(asked, docs(spark, sf), jobs)


@query("SELECT l_orderkey AS document_id, l_linenumber AS chunk, o_custkey AS owner_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def cat14_copied_owner(spark, sf):
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk"))
    return c.copied_down(children, table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("owner_id")), "document_id", "owner_id")


@query(ctes("jobs") + "SELECT * FROM (SELECT owner_id, job_id, status, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, job_id) AS INTEGER) AS place FROM jobs WHERE type = '1-URGENT') WHERE place <= 50")
def job1_job_list(spark, sf):
    return c.job_list(d.jobs(spark, sf), kind="1-URGENT").select("owner_id", "job_id", "status", "place")


@query(ctes("jobs") + "SELECT job_id, owner_id, status FROM jobs WHERE status IN ('queued', 'processing') AND json_extract_string(data, '$.resource') = '42'")
def job2_active_jobs(spark, sf):
    return c.active_jobs(d.jobs(spark, sf), "42").select("job_id", "owner_id", "status")


@query(ctes("jobs") + "SELECT job_id, owner_id, status FROM jobs WHERE status IN ('queued', 'processing') AND json_extract_string(data, '$.resource') = '42'")
def job2_active_jobs_of_any_payload(spark, sf):
    found, _ = t.payloads(d.jobs(spark, sf), F.col("data"))
    return found.where(F.col("status").isin(*c.ACTIVE) & (t.field("payload", "$.resource", "string") == "42")).select("job_id", "owner_id", "status")


@query(ctes("jobs") + "SELECT type, status, CAST(count(*) AS BIGINT) AS jobs, avg((epoch_us(completed_at) - epoch_us(created_at)) / 1e6) AS avg_seconds FROM jobs GROUP BY ALL")
def job3_job_statistics(spark, sf):
    return c.job_statistics(d.jobs(spark, sf))


@query("""
    SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, least(100, greatest(0, arg_max(CAST(floor(value) AS BIGINT) * 3 - 20, (ts, event_id)))) AS progress, min(ts) AS started_at, max(ts) AS updated_at FROM events GROUP BY 1""")
def job4_job_state(spark, sf):
    e = table(spark, sf, "events")
    return c.job_state(e.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("update_id"), F.col("event_type").alias("status"), (F.floor("value") * 3 - 20).alias("progress")))


@query(ctes("jobs") + "SELECT job_id, status FROM jobs WHERE job_id IN (SELECT p_partkey * 3 FROM part)")
def job5_poll(spark, sf):
    return c.poll(d.jobs(spark, sf), table(spark, sf, "part").select((F.col("p_partkey") * 3).alias("job_id")))


@query(ctes("jobs") + "SELECT job_id, status, completed_at FROM jobs WHERE completed_at IS NULL OR completed_at >= TIMESTAMP '2000-06-01' - INTERVAL 24 HOUR")
def job6_retained(spark, sf):
    return c.retained(d.jobs(spark, sf), "2000-06-01 00:00:00").select("job_id", "status", "completed_at")


@query(ctes("chapter_sources") + """
    SELECT document_id, chapter_number, min(source_id) AS source_id FROM chapter_sources s WHERE source_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM chapter_sources o WHERE o.source_id % 3 = 0 AND o.document_id = s.document_id AND o.chapter_number IS NOT DISTINCT FROM s.chapter_number) GROUP BY 1, 2""")
def snk2_insert_or_ignore(spark, sf):
    s = d.chapter_sources(spark, sf).select("document_id", "chapter_number", "source_id")
    return t.insert_or_ignore(s.where("source_id % 3 = 0"), s.where("source_id % 3 <> 0"), ["document_id", "chapter_number"], ["source_id"])


@query(ctes("chapter_sources") + " SELECT document_id, chapter_number, min(source_id) AS source_id FROM (SELECT *, min(source_id % 3) OVER (PARTITION BY document_id, chapter_number) AS turn FROM chapter_sources) WHERE source_id % 3 = turn GROUP BY 1, 2")
def snk2_inserted_in_turns(spark, sf):
    """Three writers, one after the other: each puts in what the ones before have not."""
    s, path = d.chapter_sources(spark, sf).select("document_id", "chapter_number", "source_id"), f"{t.shared_dir(spark)}/inserted-{uuid.uuid4().hex}"
    for turn in range(3):
        versions.insert(s.where(F.col("source_id") % 3 == turn), path, ["document_id", "chapter_number"], ["source_id"])
    return versions.snapshot(spark, path).select("document_id", "chapter_number", "source_id")


@query("SELECT event_id, coalesce(CAST(json_extract(CASE WHEN event_id % 5 <> 0 THEN props END, '$.k') AS BIGINT), -1) AS k FROM events")
def snk4_json_or_fallback(spark, sf):
    broken = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 5 == 0, "not json").otherwise(F.col("props"))
    k = t.json_or(broken, "k bigint", F.struct(F.lit(-1).cast("long").alias("k")))
    return table(spark, sf, "events").select("event_id", F.coalesce(k["k"], F.lit(-1)).alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 5 = 0")
def snk4_payload_or_rejects(spark, sf):
    broken = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 5 == 0, "not json").otherwise(F.col("props"))
    found, rejects = t.payloads(table(spark, sf, "events"), broken)
    return found.select("event_id", t.field("payload", "$.k", "bigint").alias("k")).unionByName(rejects.select("event_id", F.lit(-1).cast("long").alias("k")))


@query("""
    WITH q AS (SELECT label, vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
    d AS (SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(list_zip(q, embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))), 6) AS distance FROM q JOIN embeddings USING (label) WHERE query_id <> vec_id)
    SELECT * FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 5""")
def ret1_nearest_chunks(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("owner_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return retrieve.nearest_chunks(e.where("vec_id % 20 = 0").select("owner_id", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), e)


@query(r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 900) / 810)) AS BIGINT) + 1)) AS chunk FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(w[chunk * 810 + 1:chunk * 810 + 900]) AS BIGINT) AS n_tokens, array_to_string(w[chunk * 810 + 1:chunk * 810 + 900], ' ') AS text FROM c""")
def ret2_chunks(spark, sf):
    return retrieve.chunks(table(spark, sf, "documents"), "text")
