"""The driver's tables as the tables of a learning platform, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studylake.functions.text import lines, micros
from studylake.sources.tables import table

SQL: dict[str, str] = {}


def ctes(*names: str) -> str:
    """A WITH clause of the derived tables named."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


SQL["attempts"] = """
    SELECT user_id AS owner_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 10 AS concept_id, value >= 30 AS was_correct, ts, event_id FROM events"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    concept = F.regexp_extract("props", "[0-9]+", 0).cast("long") % 10
    return e.select(F.col("user_id").alias("owner_id"), concept.alias("concept_id"), (F.col("value") >= 30).alias("was_correct"), "ts", "event_id")


SQL["concepts"] = """
    SELECT owner_id, concept_id, concept_id % 2 AS document_id, CASE WHEN concept_id % 5 <> 0 THEN concept_id % 3 END AS course_id,
        CASE WHEN concept_id % 4 = 3 THEN '' ELSE 'Chapter ' || (concept_id % 4) END AS chapter, concept_id % 3 AS section_id, concept_id + 1 AS concept_number, 'Concept ' || concept_id AS name
    FROM (SELECT DISTINCT owner_id, concept_id FROM attempts UNION ALL SELECT 1000000 + n_nationkey, CAST(n_nationkey % 10 AS BIGINT) FROM nation)"""


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    """One concept for each owner and concept answered, and some of owners who never answered."""
    seen = attempts(spark, sf).select("owner_id", "concept_id").distinct()
    n = F.col("n_nationkey").cast("long")
    unseen = table(spark, sf, "nation").select((n + 1000000).alias("owner_id"), (n % 10).alias("concept_id"))
    c = F.col("concept_id")
    return seen.unionByName(unseen).select(
        "owner_id", "concept_id", (c % 2).alias("document_id"), F.when(c % 5 != 0, c % 3).alias("course_id"),
        F.when(c % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("Chapter "), (c % 4).cast("string"))).alias("chapter"),
        (c % 3).alias("section_id"), (c + 1).alias("concept_number"), F.concat(F.lit("Concept "), c.cast("string")).alias("name"),
    )


SQL["sections"] = """
    SELECT owner_id, s.section_id, s.section_id + 1 AS section_number, 'Section ' || s.section_id AS name, (owner_id + s.section_id) % 2 = 0 AS concepts_generated
    FROM (SELECT DISTINCT owner_id FROM concepts), (VALUES (CAST(0 AS BIGINT)), (1), (2), (3)) s(section_id)"""


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Four sections for each owner; the last never has a concept."""
    s = F.col("section_id")
    owners = concepts(spark, sf).select("owner_id").distinct()
    rows = owners.select("owner_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("section_id"))
    return rows.select("owner_id", "section_id", (s + 1).alias("section_number"), F.concat(F.lit("Section "), s.cast("string")).alias("name"), ((F.col("owner_id") + s) % 2 == 0).alias("concepts_generated"))


SQL["courses"] = """
    SELECT CAST(n_nationkey AS BIGINT) AS course_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS owner_id, DATE '1998-01-01' + n_nationkey AS exam_date,
        n_nationkey % 2 = 0 AS archived, CASE WHEN n_nationkey % 3 = 0 THEN DATE '1997-06-01' + n_nationkey END AS archived_on, DATE '1996-01-01' + n_nationkey % 7 AS created_on FROM nation"""


def courses(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey").cast("int")
    return table(spark, sf, "nation").select(
        n.cast("long").alias("course_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("owner_id"), F.date_add(F.lit("1998-01-01").cast("date"), n).alias("exam_date"),
        (n % 2 == 0).alias("archived"), F.when(n % 3 == 0, F.date_add(F.lit("1997-06-01").cast("date"), n)).alias("archived_on"), F.date_add(F.lit("1996-01-01").cast("date"), n % 7).alias("created_on"),
    )


SQL["sessions"] = """
    SELECT user_id AS owner_id, user_id * 100 + day(ts) AS session_id, CASE WHEN day(ts) % 4 <> 0 THEN CAST(day(ts) % 30 AS BIGINT) END AS course_id, min(ts) AS started_at, max(ts) AS completed_at,
        CAST(count(*) AS BIGINT) AS total_check_ins, CAST(count(*) FILTER (WHERE value >= 30) AS BIGINT) AS correct_check_ins,
        CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 60 + 0.5) AS BIGINT) AS duration_minutes
    FROM events GROUP BY user_id, day(ts)"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A study session for each learner and day of the month."""
    e = table(spark, sf, "events").withColumn("d", F.dayofmonth("ts").cast("long"))
    seconds = micros(F.max("ts")) - micros(F.min("ts"))
    return e.groupBy(F.col("user_id").alias("owner_id"), "d").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"), F.count("*").alias("total_check_ins"),
        F.count_if(F.col("value") >= 30).alias("correct_check_ins"), F.floor(seconds / 1e6 / 60 + 0.5).alias("duration_minutes"),
    ).select("owner_id", (F.col("owner_id") * 100 + F.col("d")).alias("session_id"), F.when(F.col("d") % 4 != 0, F.col("d") % 30).alias("course_id"), "started_at", "completed_at", "total_check_ins", "correct_check_ins", "duration_minutes")


SQL["subscriptions"] = """
    SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'tier1' ELSE 'tier2' END AS tier,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'trialing' WHEN 'MACHINERY' THEN 'past_due' WHEN 'FURNITURE' THEN 'canceled' ELSE 'active' END AS status, DATE '1998-01-01' - CAST(c_custkey % 60 AS INTEGER) AS updated_on
    FROM customer WHERE c_custkey % 7 <> 0"""


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "trialing", "MACHINERY", "past_due", "FURNITURE", "canceled")])
    return table(spark, sf, "customer").where(k % 7 != 0).select(
        k.alias("user_id"), F.when(k % 3 == 0, "free").when(k % 3 == 1, "tier1").otherwise("tier2").alias("tier"),
        F.coalesce(F.try_element_at(status, F.col("c_mktsegment")), F.lit("active")).alias("status"), F.date_sub(F.lit("1998-01-01").cast("date"), (k % 60).cast("int")).alias("updated_on"),
    )


SQL["usage"] = """
    SELECT o_custkey AS user_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS BIGINT) AS pdfs_uploaded,
        CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS chapters_generated, CAST(sum(o_orderkey % 20) AS BIGINT) AS pages_processed
    FROM orders GROUP BY 1, 2"""


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly counters of each user from orders as uploads, with o_orderkey % 20 pages each."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("user_id"), F.trunc("o_orderdate", "MM").alias("month")).agg(
        F.count("*").alias("pdfs_uploaded"), F.count_if(F.col("o_orderstatus") == "F").alias("chapters_generated"), F.sum(F.col("o_orderkey") % 20).alias("pages_processed"),
    )


SQL["jobs"] = """
    SELECT o_orderkey AS job_id, o_custkey AS owner_id, o_orderpriority AS type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_minutes(CAST(o_orderkey % 50 AS INTEGER)) END AS completed_at, '{"resource": "' || (o_orderkey % 100) || '"}' AS data
    FROM orders"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select(
        k.alias("job_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("type"),
        F.when(done, "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing").alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(done, F.col("o_orderdate") + F.make_dt_interval(mins=(k % 50).cast("int"))).alias("completed_at"), F.concat(F.lit('{"resource": "'), (k % 100).cast("string"), F.lit('"}')).alias("data"),
    )


SQL["chapter_sources"] = """
    SELECT l_suppkey AS document_id, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 9 END AS chapter_number, l_partkey % 4 AS course_id, l_partkey AS source_id, l_partkey % 30 + 1 AS page_start,
        l_partkey % 30 + 1 + l_suppkey % 12 AS page_end, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'Text of part ' || l_partkey END AS markdown_content
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"""


def chapter_sources(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    start = p % 30 + 1
    return table(spark, sf, "lineitem").select(p, s).distinct().select(
        s.alias("document_id"), F.when(p % 11 != 0, p % 9).alias("chapter_number"), (p % 4).alias("course_id"), p.alias("source_id"), start.alias("page_start"), (start + s % 12).alias("page_end"),
        F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("Text of part "), p.cast("string"))).alias("markdown_content"),
    )


SQL["pages"] = """
    SELECT doc_id, page, 'Page ' || page || chr(10) || chr(10) || line || chr(10) || chr(10) || chr(10)
        || CASE WHEN page % 3 = 0 THEN '  Copyright 2024 Some Press' || chr(10) ELSE '' END || '-----' || chr(10) || page || '/' || n || chr(10) AS text
    FROM (SELECT doc_id, unnest(x) AS line, CAST(generate_subscripts(x, 1) AS INTEGER) AS page, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each line of a document as a page with page numbers, a copyright line on each third, a rule and a page count."""
    d = table(spark, sf, "documents").withColumn("n", F.size(F.split("text", "\n", -1)))
    p = (F.col("line_no") + 1).alias("page")
    rows = lines(d, "text", "doc_id", "n").select("doc_id", "n", p, "line")
    press = F.when(F.col("page") % 3 == 0, "  Copyright 2024 Some Press\n").otherwise("")
    return rows.select("doc_id", "page", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit("\n\n"), "line", F.lit("\n\n\n"), press, F.lit("-----\n"), F.col("page").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("\n")).alias("text"))


SQL["section_markdown"] = """
    SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || string_agg(CASE WHEN pos % 5 = 1 THEN '## Section ' || lpad(CAST(pos // 5 + 1 AS VARCHAR), 5, '0') || chr(10) || chr(10) ELSE '' END || line, chr(10) || chr(10) ORDER BY pos) AS markdown
    FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) GROUP BY doc_id"""


def section_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A document's lines as paragraphs under a title, with a section heading before every fifth from the first.
    Numbers are padded, so that no name is the beginning of another."""
    parts = F.split("text", "\n", -1)

    def one(line, i):
        head = F.when(i % 5 == 0, F.concat(F.lit("## Section "), F.lpad((F.floor(i / 5) + 1).cast("string"), 5, "0"), F.lit("\n\n"))).otherwise("")
        return F.concat(head, line)

    body = F.array_join(F.transform(parts, one), "\n\n")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), body).alias("markdown"))


SQL["headings_text"] = """
    SELECT doc_id, string_agg(CASE WHEN pos % 3 = 0 THEN (pos // 3 + 1) || '.' || (pos % 7) || ' Topic Title Words' || chr(10) WHEN pos % 7 = 1 THEN 'Chapter ' || pos || ': Some Part' || chr(10)
        WHEN pos % 11 = 2 THEN 'Table ' || pos || chr(10) ELSE '' END || line, chr(10) ORDER BY pos) AS text
    FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) GROUP BY doc_id"""


def headings_text(spark: SparkSession, sf: str) -> DataFrame:
    """A document's lines with numbered headings, chapter headings and table labels between them."""

    def one(line, i):
        n = i.cast("string")
        numbered = F.concat((F.floor(i / 3) + 1).cast("string"), F.lit("."), (i % 7).cast("string"), F.lit(" Topic Title Words\n"))
        head = F.when(i % 3 == 0, numbered).when(i % 7 == 1, F.concat(F.lit("Chapter "), n, F.lit(": Some Part\n"))).when(i % 11 == 2, F.concat(F.lit("Table "), n, F.lit("\n"))).otherwise("")
        return F.concat(head, line)

    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), one), "\n").alias("text"))


SQL["spans"] = """
    SELECT l_orderkey AS doc_id, l_linenumber % 2 + 1 AS page, l_linenumber AS span_idx, 'Part ' || l_partkey AS text, CAST((l_partkey % 3) * 200 + l_suppkey % 20 AS DOUBLE) AS x0,
        l_quantity * 10 AS y0, CAST((l_partkey % 3) * 200 + l_suppkey % 20 + 80 AS DOUBLE) AS x1, l_quantity * 10 + 12 AS y1, CAST(10 + (l_partkey % 4) * 2 AS DOUBLE) AS font_size,
        CASE WHEN l_returnflag = 'R' THEN 'Times-Bold' WHEN l_returnflag = 'N' THEN 'Courier' ELSE 'Times' END AS font_name, CAST(600 AS DOUBLE) AS page_width FROM lineitem"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    left = ((F.col("l_partkey") % 3) * 200 + F.col("l_suppkey") % 20).cast("double")
    top = F.col("l_quantity") * 10
    font = F.when(F.col("l_returnflag") == "R", "Times-Bold").when(F.col("l_returnflag") == "N", "Courier").otherwise("Times")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).alias("page"), F.col("l_linenumber").alias("span_idx"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("text"),
        left.alias("x0"), top.alias("y0"), (left + 80).alias("x1"), (top + 12).alias("y1"), (10 + (F.col("l_partkey") % 4) * 2).cast("double").alias("font_size"), font.alias("font_name"), F.lit(600.0).alias("page_width"),
    )


SQL["doc_tables"] = """
    SELECT l_orderkey AS doc_id, CAST(rn + CASE WHEN rn > 4 THEN 1 ELSE 0 END AS INTEGER) AS page, 0 AS table_index, CAST(2 + l_suppkey % 2 AS INTEGER) AS col_count,
        CASE WHEN l_tax > 0.04 THEN '' ELSE 'h' || l_suppkey % 2 END AS h, rn
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)"""


def doc_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table of one row on each page of an order (page 5 has none), its headers blank where the tax is high."""
    words = lambda *x: F.array(*[F.lit(y) for y in x])
    headers = F.when(F.col("l_tax") > 0.04, words("", "")).when(F.col("l_suppkey") % 2 == 0, words("Name", "Value")).otherwise(words("Name", "Value", "Unit"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    n = F.row_number().over(order)
    return table(spark, sf, "lineitem").withColumn("n", n).select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("n") > 4, F.col("n") + 1).otherwise(F.col("n")).alias("page"), F.lit(0).alias("table_index"), (2 + F.col("l_suppkey") % 2).cast("int").alias("col_count"),
        headers.alias("headers"), F.array(F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("rows"), F.lit(1).alias("row_count"),
    )


SQL["formulas"] = """
    SELECT p_partkey AS doc_id, p_size AS page, 0 AS formula_index, translate(p_name, 'abps', 'αβπΣ') || CASE WHEN p_size % 5 = 0 THEN ' ≤ ∞' ELSE '' END AS latex FROM part"""


def formulas(spark: SparkSession, sf: str) -> DataFrame:
    latex = F.concat(F.translate("p_name", "abps", "αβπΣ"), F.when(F.col("p_size") % 5 == 0, " ≤ ∞").otherwise(""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("page"), F.lit(0).alias("formula_index"), latex.alias("latex"))


SQL["check_ins"] = """
    SELECT conv_id AS lesson_id, turn AS ordinal, 'Topic ' || (turn % 3) AS concept, text AS question, answer AS expected_answer
    FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user'"""


def check_ins(spark: SparkSession, sf: str) -> DataFrame:
    """A user's turn as a question with the next turn as its answer, on one of three concepts of the lesson."""
    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf, "conversations").withColumn("answer", answer).where("role = 'user'")
    return rows.select(F.col("conv_id").alias("lesson_id"), F.col("turn").alias("ordinal"), F.concat(F.lit("Topic "), (F.col("turn") % 3).cast("string")).alias("concept"), F.col("text").alias("question"), F.col("answer").alias("expected_answer"))
