"""Queries of the section and chapter family."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import sections as s
from studylake.plans.registry import query
from studylake.sources import derive as d
from studylake.sources.derive import ctes
from studylake.sources.tables import table

LINES = """ln AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM headings_text)), tr AS (SELECT *, regexp_replace(line, '\\A\\s+|\\s+\\z', '', 'g') AS t FROM ln)"""
#: Heading patterns as literals of the SQL's own.
VALID = r"NOT (length(t) < 8 OR (regexp_matches(t, '\d+') AND regexp_matches(t, '(?i)\b(St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd|Boulevard|Pl|Place|Way|Court|Ct)\b')) OR regexp_matches(t, '^[A-Z]+$') OR regexp_matches(t, '^\d+\s+\d+') OR regexp_matches(t, '^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$') OR regexp_matches(t, '(?i)^(Page|Figure|Table|Appendix|Index|References|Bibliography|Glossary)\s+\d+$'))"
FITS = r"""regexp_matches(t, '(?i)^Chapter\s+\d+[\.:]\s*.+$') OR regexp_matches(t, '^\d+\.\d+\s+[A-Z][^\.]+$') OR regexp_matches(t, '(?i)^Section\s+\d+[\.:]\s*.+$')
    OR regexp_matches(t, '^[A-Z][A-Z\s]{8,50}[A-Z]$') OR regexp_matches(t, '^\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){2,6}$')"""
HEADS = LINES + f", heads AS (SELECT doc_id, line_no, t, line_no // 50 + 1 AS page FROM tr WHERE length(t) BETWEEN 8 AND 200 AND ({FITS}) AND {VALID})"
TOC = ", toc AS (SELECT doc_id, row_number() OVER w AS section_number, t AS name, page, nullif(lead(page) OVER w - 1, 0) AS page_end, count(*) OVER (PARTITION BY doc_id) AS n FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"
WITH_HEADS = ctes("headings_text").rstrip() + ", " + HEADS


@query(ctes("headings_text").rstrip() + ", " + LINES + f" SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {VALID} AS valid FROM tr")
def sec1_valid_headings(spark, sf):
    rows = s.lines(d.headings_text(spark, sf), "text", "doc_id")
    return rows.select("doc_id", "line_no", s.valid_heading(s.strip(F.col("line"))).alias("valid"))


@query(WITH_HEADS + " SELECT doc_id, CAST(line_no AS INTEGER) AS line, t AS text, CAST(page AS INTEGER) AS estimated_page FROM heads")
def sec2_headings(spark, sf):
    return s.headings(d.headings_text(spark, sf), "text")


@query(WITH_HEADS + TOC + " SELECT doc_id, CAST(section_number AS INTEGER) AS section_number, name, CAST(page AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end FROM toc WHERE n BETWEEN 3 AND 30")
def sec3_table_of_contents(spark, sf):
    return s.table_of_contents(s.headings(d.headings_text(spark, sf), "text"))


@query("SELECT doc_id, CASE WHEN p <= 10 THEN 3 WHEN p <= 30 THEN 6 ELSE 8 END AS target, CASE WHEN p <= 10 THEN 2 WHEN p <= 30 THEN 4 ELSE 6 END AS least FROM (SELECT doc_id, ceil(length(text) / 2000) AS p FROM documents)")
def sec4_section_counts(spark, sf):
    n = s.section_count(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n["target"].alias("target"), n["min"].alias("least"))


@query("""SELECT doc_id, md5(CASE WHEN n > 3000 THEN text[1:900] || chr(10) || chr(10) || '[... middle section ...]' || chr(10) || chr(10) || substr(text, CAST(floor((n - 900) / 2) AS BIGINT) + 1, 900) || chr(10) || chr(10) || '[... later section ...]' || chr(10) || chr(10) || substr(text, n - 899, 900) ELSE text END) AS digest
    FROM (SELECT doc_id, text, length(text) AS n FROM documents)""")
def sec5_sampled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(s.sampled(F.col("text"), 3000, 900)).alias("digest"))


FALLBACK = """fallback AS (SELECT doc_id, i + 1 AS section_number, title || ' - Part ' || (i + 1) AS name, CAST(floor(i * p / n) AS BIGINT) + 1 AS page_start, CAST(floor((i + 1) * p / n) AS BIGINT) AS page_end
    FROM (SELECT doc_id, title, p, n, unnest(range(0, n)) AS i FROM (SELECT doc_id, title, p, CAST(least(greatest(3, ceil(p / 10)), 8) AS BIGINT) AS n FROM (SELECT doc_id, title, ceil(length(text) / 2000) AS p FROM fdocs))))"""


@query("WITH fdocs AS (SELECT doc_id, text, 'Doc ' || doc_id AS title FROM documents), " + FALLBACK + " SELECT doc_id, CAST(section_number AS INTEGER) AS section_number, name, 'Study material from pages ' || page_start || ' to ' || page_end AS description, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end FROM fallback")
def sec6_fallback_sections(spark, sf):
    return s.fallback_sections(table(spark, sf, "documents"), "text", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))


PROPOSED = """proposed AS (SELECT doc_id, line_no AS position, CASE WHEN line_no % 5 = 4 OR doc_id % 2 = 1 AND line_no > 0 THEN 'SHORT' ELSE 'Topic number ' || line_no || ' of text' END AS name FROM ln),
    pv AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS i FROM proposed) WHERE (n <= 20 OR i <= 15) AND name <> 'SHORT'),
    pn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS section_number, name, count(*) OVER (PARTITION BY doc_id) AS k FROM pv)"""


def proposed(spark, sf):
    n = F.col("line_no")
    rows = s.lines(d.headings_text(spark, sf), "text", "doc_id")
    return rows.select("doc_id", n.alias("position"), F.when((n % 5 == 4) | (F.col("doc_id") % 2 == 1) & (n > 0), "SHORT").otherwise(F.concat(F.lit("Topic number "), n.cast("string"), F.lit(" of text"))).alias("name"))


@query(WITH_HEADS + ", " + PROPOSED + " SELECT doc_id, CAST(section_number AS INTEGER) AS section_number, name FROM pn WHERE k >= 2")
def sec7_validated(spark, sf):
    return s.validated(proposed(spark, sf))


#: Candidates for a cut within 500 characters of the middle, by kind: start of a blank line, after a sentence end, line end.
@query(ctes("section_markdown").rstrip() + r""", r AS (SELECT doc_id, markdown AS t, length(markdown) AS n, CAST(floor(length(markdown) / 2) AS BIGINT) AS p FROM section_markdown),
    c AS (SELECT doc_id, n, p, i, substr(t, i, 1) AS before, substr(t, i + 1, 1) AS x, substr(t, i + 2, 1) AS y, greatest(0, p - 500) AS first, least(n, p + 500) AS last
        FROM (SELECT *, unnest(range(greatest(0, p - 500), least(n, p + 500))) AS i FROM r)),
    k AS (SELECT doc_id, i, p, CASE WHEN x = chr(10) AND y = chr(10) AND i + 1 < last AND (before <> chr(10) OR i = first) THEN 1 END AS a,
        CASE WHEN i > first AND before IN ('.', '!', '?') AND x IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 2 END AS b, CASE WHEN x = chr(10) THEN 3 END AS l FROM c),
    best AS (SELECT doc_id, arg_min(i, (abs(i - p), i)) FILTER (WHERE a = 1) AS a, arg_min(i, (abs(i - p), i)) FILTER (WHERE b = 2) AS b, arg_min(i, (abs(i - p), i)) FILTER (WHERE l = 3) AS l FROM k GROUP BY 1)
    SELECT doc_id, CAST(p AS INTEGER) AS position, CAST(CASE WHEN p >= n THEN n ELSE coalesce(a, b, l, p) END AS INTEGER) AS boundary FROM r LEFT JOIN best USING (doc_id)""")
def sec8_smart_boundaries(spark, sf):
    rows = d.section_markdown(spark, sf).select("doc_id", "markdown", F.floor(F.length("markdown") / 2).cast("int").alias("position"))
    return rows.select("doc_id", "position", s.smart_boundary(F.col("markdown"), F.col("position")).alias("boundary"))


def section_name(k):
    return F.concat(F.lit("Section "), F.lpad(k.cast("string"), 5, "0"))


def named_sections(spark, sf):
    n = F.ceil(F.size(F.split("text", "\n", -1)) / 5).cast("int")
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), n)).alias("section_number"))
    return rows.withColumn("name", section_name(F.col("section_number")))


PARTS = r"""ln AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    parts AS (SELECT doc_id, i // 5 + 1 AS section_number, 'Section ' || lpad(CAST(i // 5 + 1 AS VARCHAR), 5, '0') AS name, '## Section ' || lpad(CAST(i // 5 + 1 AS VARCHAR), 5, '0') || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY i) AS body FROM ln GROUP BY 1, 2)"""


@query("WITH " + PARTS + r" SELECT doc_id, CAST(section_number AS INTEGER) AS section_number, name, regexp_replace(body, '\A\s+|\s+\z', '', 'g') AS markdown_text FROM parts")
def sec9_split_markdown(spark, sf):
    return s.split_by_sections(d.section_markdown(spark, sf), named_sections(spark, sf))


#: Every third document has page markers, every other one a known number of pages; even sections have page ranges, and every
#: fifth one a name that isn't in the text.
@query("WITH " + PARTS + """, t AS (SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || string_agg(CASE WHEN doc_id % 3 = 0 THEN '## Page ' || section_number || chr(10) || chr(10) ELSE '' END || body, chr(10) || chr(10) ORDER BY section_number) AS text, count(*) AS s FROM parts GROUP BY 1),
    r AS (SELECT doc_id, section_number AS k, text, length(text) AS n, s, CASE WHEN section_number % 5 = 0 THEN 'Absent title ' || section_number ELSE name END AS name, CAST(CASE WHEN doc_id % 2 = 0 THEN s ELSE ceil(length(text) / 2000) END AS BIGINT) AS pages FROM parts JOIN t USING (doc_id)),
    e AS (SELECT *, n // pages AS size, strpos(text, name) AS spot, lead(name) OVER (PARTITION BY doc_id ORDER BY k) AS following, strpos(text, '## Page ' || k || chr(10)) AS mark, strpos(text, '## Page ' || (k + 1) || chr(10)) AS mark2 FROM r),
    f AS (SELECT *, CASE WHEN spot > 0 THEN strpos(substr(text, spot + 1), following) END AS stop, (k - 1) * size AS low, least(n, (k + 1) * size) AS high FROM e),
    g AS (SELECT *, CASE WHEN k % 2 = 0 AND mark > 0 THEN 'page_markers' WHEN k % 2 = 0 AND low < high THEN 'page_range_calc' WHEN k % 2 = 0 AND low > high AND high < n THEN 'page_range_calc' WHEN spot > 0 THEN 'name_search' ELSE 'proportional_chunking' END AS strategy FROM f)
    SELECT doc_id, CAST(k AS INTEGER) AS section_number, strategy, md5(CASE strategy WHEN 'page_markers' THEN substr(text, mark, CASE WHEN mark2 > 0 THEN mark2 ELSE n + 1 END - mark) WHEN 'page_range_calc' THEN substr(text, least(low, high) + 1, abs(high - low))
        WHEN 'name_search' THEN CASE WHEN stop > 0 THEN substr(text, spot, stop) ELSE substr(text, spot) END ELSE substr(text, (k - 1) * (n // s) + 1, n // s) END) AS digest FROM g""")
def sec10_section_texts(spark, sf):
    k, doc = F.col("section_number"), F.col("doc_id")
    sections = named_sections(spark, sf).withColumn("page_start", F.when(k % 2 == 0, k)).withColumn("page_end", F.when(k % 2 == 0, k + 1))
    sections = sections.withColumn("name", F.when(k % 5 == 0, F.concat(F.lit("Absent title "), k.cast("string"))).otherwise(F.col("name")))
    pages = sections.groupBy("doc_id").agg(F.count("*").cast("int").alias("s"))
    marked = F.regexp_replace("markdown", r"(?m)^## Section 0*(\d+)$", "## Page $1\n\n$0")
    docs = d.section_markdown(spark, sf).join(pages, "doc_id").select("doc_id", F.when(doc % 3 == 0, marked).otherwise(F.col("markdown")).alias("text"), F.when(doc % 2 == 0, F.col("s")).alias("pages"))
    return s.section_texts(docs, sections).select("doc_id", "section_number", "strategy", F.md5("extracted").alias("digest"))


#: Every third section's text goes on through the next one, every fourth one's through the next two.
@query("WITH " + PARTS + r""", b AS (SELECT doc_id, section_number AS k, name, '## ' || name || chr(10) || chr(10) || regexp_replace(substr(body, length(name) + 4), '\A\s+|\s+\z', '', 'g') AS body FROM parts),
    f AS (SELECT doc_id, sum(length(body) + 2) - 2 + length('# Document ' || doc_id) + 2 AS n FROM parts GROUP BY 1),
    x AS (SELECT *, body || CASE WHEN k % 3 = 0 OR k % 4 = 0 THEN coalesce(chr(10) || chr(10) || lead(body) OVER w, '') ELSE '' END || CASE WHEN k % 4 = 0 THEN coalesce(chr(10) || chr(10) || lead(body, 2) OVER w, '') ELSE '' END AS t FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    o AS (SELECT x.doc_id, x.k, count(*) FILTER (WHERE contains(lower(x.t), lower(y.name))) AS others FROM x JOIN b y ON y.doc_id = x.doc_id AND y.k <> x.k GROUP BY 1, 2)
    SELECT doc_id, CAST(k AS INTEGER) AS section_number, round(greatest(0.0, least(1.0, 0.3 + CASE WHEN length(t) / n > 0.05 AND length(t) / n < 0.5 THEN 0.3 WHEN length(t) / n >= 0.5 THEN -0.2 ELSE 0.0 END
        + CASE coalesce(others, 0) WHEN 0 THEN 0.4 WHEN 1 THEN 0.2 ELSE -0.2 END)), 6) AS quality FROM x JOIN f USING (doc_id) LEFT JOIN o USING (doc_id, k)""")
def sec11_quality(spark, sf):
    from pyspark.sql import Window

    k, order = F.col("section_number"), Window.partitionBy("doc_id").orderBy("section_number")
    docs = d.section_markdown(spark, sf)
    parts = s.markdown_sections(docs, "markdown").select("doc_id", "section_number", "name", F.concat(F.lit("## "), "name", F.lit("\n\n"), "markdown_text").alias("body"))
    more = lambda i, when: F.when(when, F.coalesce(F.concat(F.lit("\n\n"), F.lead("body", i).over(order)), F.lit(""))).otherwise("")
    parts = parts.withColumn("extracted", F.concat("body", more(1, (k % 3 == 0) | (k % 4 == 0)), more(2, k % 4 == 0)))
    return s.scored(parts, docs.select("doc_id", F.length("markdown").alias("size"))).select("doc_id", "section_number", "quality")


@query(WITH_HEADS + TOC + ", " + PROPOSED + ", fdocs AS (SELECT doc_id, text, 'Doc ' || doc_id AS title FROM headings_text WHERE doc_id NOT IN (SELECT doc_id FROM toc WHERE n BETWEEN 6 AND 15) AND doc_id NOT IN (SELECT doc_id FROM pn WHERE k >= 2)), " + FALLBACK + """
    SELECT doc_id, CAST(section_number AS INTEGER) AS section_number, name, 'contents' AS origin FROM toc WHERE n BETWEEN 6 AND 15
    UNION ALL SELECT doc_id, CAST(section_number AS INTEGER), name, 'proposed' FROM pn WHERE k >= 2 AND doc_id NOT IN (SELECT doc_id FROM toc WHERE n BETWEEN 6 AND 15)
    UNION ALL SELECT doc_id, CAST(section_number AS INTEGER), name, 'fallback' FROM fallback""")
def sec12_extracted_sections(spark, sf):
    docs = d.headings_text(spark, sf).withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    return s.extract_sections(docs, proposed(spark, sf))


@query("WITH " + PARTS + r""", c AS (SELECT *, regexp_replace(substr(body, length(name) + 4), '\A\s+|\s+\z', '', 'g') AS content FROM parts), p AS (SELECT *, coalesce(nullif(split_part(content, chr(10) || chr(10), 1), ''), content) AS p FROM c)
    SELECT doc_id, 'Document ' || doc_id AS title, CAST(section_number AS INTEGER) AS section_number, name, CASE WHEN length(p) > 200 THEN p[1:197] || '...' WHEN p <> '' THEN p ELSE 'Section covering ' || name END AS description, content AS markdown_text FROM p""")
def sec13_markdown_sections(spark, sf):
    return s.markdown_sections(d.section_markdown(spark, sf), "markdown")


@query("WITH " + PARTS + " SELECT doc_id, CAST(count(*) AS BIGINT) AS pages, CAST(max(section_number) AS INTEGER) AS last_number FROM parts GROUP BY 1")
def sec14_section_rows(spark, sf):
    rows = s.markdown_sections(d.section_markdown(spark, sf), "markdown")
    return rows.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("section_number").alias("last_number"))


@query(r"SELECT doc_id, CAST(doc_id % 12 AS INTEGER) AS chapter_number, 'Title of ' || doc_id AS chapter_title, regexp_replace(text, '\A\s+|\s+\z', '', 'g') AS markdown FROM documents WHERE doc_id % 5 <> 0")
def chp1_single_chapters(spark, sf):
    k = F.col("doc_id")
    head = F.when(k % 5 == 0, "# No chapter\n").otherwise(F.concat(F.lit("intro\n# Chapter_"), (k % 12).cast("string"), F.lit(": Title of "), k.cast("string"), F.lit("\n\n")))
    return s.chapter_of(table(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("markdown")), "markdown")


LISTS = "lists AS (SELECT o_orderkey AS doc_id, string_agg(l_linenumber || '|' || ' Part ' || l_partkey || ' |' || l_linenumber * 3 || '|' || CASE WHEN l_suppkey % 9 = 0 THEN 'x|y' ELSE CAST(l_linenumber * 3 + 2 AS VARCHAR) END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


def chapter_lists(spark, sf):
    n = F.col("l_linenumber")
    tail = F.when(F.col("l_suppkey") % 9 == 0, "x|y").otherwise((n * 3 + 2).cast("string"))
    line = F.concat(n.cast("string"), F.lit("| Part "), F.col("l_partkey").cast("string"), F.lit(" |"), (n * 3).cast("string"), F.lit("|"), tail)
    got = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("t"))))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(got, lambda x: x["t"]), "\n").alias("text"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS number, 'Part ' || l_partkey AS title, l_linenumber * 3 AS page_start, l_linenumber * 3 + 2 AS page_end FROM lineitem WHERE l_suppkey % 9 <> 0")
def chp2_chapter_rows(spark, sf):
    return s.chapter_rows(chapter_lists(spark, sf), "text").drop("line_no")


@query("SELECT doc_id, CASE WHEN n = 0 THEN 'error' WHEN n = 1 THEN 'single' ELSE 'multi' END AS kind FROM (SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_suppkey % 9 <> 0) AS n FROM lineitem GROUP BY 1)")
def chp3_response_kinds(spark, sf):
    return chapter_lists(spark, sf).select("doc_id", s.response_kind(F.col("text")).alias("kind"))


@query(ctes("pages") + """, ch AS (SELECT doc_id, k AS number, k * 3 - 1 AS s, k * 3 + 3 AS e FROM documents, (VALUES (0), (1), (2)) v(k))
    SELECT doc_id, number, CAST(count(*) AS BIGINT) AS n_pages, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM ch JOIN pages USING (doc_id) WHERE page BETWEEN greatest(1, s) AND e GROUP BY 1, 2""")
def chp4_cut_chapters(spark, sf):
    k = F.col("number")
    chapters = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("number"))
    return s.cut_chapters(chapters.withColumns({"page_start": k * 3 - 1, "page_end": k * 3 + 3}), d.pages(spark, sf))


@query(ctes("chapter_sources") + "SELECT source_id, document_id, markdown_content <> '' AS cached FROM chapter_sources")
def chp5_cached_sources(spark, sf):
    has, needs = s.cached(d.chapter_sources(spark, sf))
    return has.select("source_id", "document_id", F.lit(True).alias("cached")).unionByName(needs.select("source_id", "document_id", F.lit(False).alias("cached")))


@query(ctes("chapter_sources") + "SELECT DISTINCT document_id, n AS chapter_number FROM chapter_sources, (SELECT unnest(range(0, 12)) AS n) WHERE NOT EXISTS (SELECT 1 FROM chapter_sources o WHERE o.document_id = chapter_sources.document_id AND o.chapter_number = n)")
def chp6_absent_chapters(spark, sf):
    have = d.chapter_sources(spark, sf)
    asked = have.select("document_id").distinct().select("document_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(12)])).alias("chapter_number"))
    return s.absent(asked, have, ["document_id", "chapter_number"])


@query(ctes("chapter_sources") + """, placed AS (SELECT *, row_number() OVER (PARTITION BY course_id, chapter_number ORDER BY source_id, document_id) AS i FROM chapter_sources WHERE chapter_number IS NOT NULL)
    SELECT course_id, chapter_number, CAST(count(*) AS BIGINT) AS n_sources, string_agg('## Source ' || i || ': ' || s_name || chr(10) || markdown_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS markdown FROM placed JOIN supplier ON s_suppkey = document_id GROUP BY 1, 2""")
def chp7_joined_sources(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("document_title"))
    placed = d.chapter_sources(spark, sf).where("chapter_number IS NOT NULL")
    return s.joined_sources(placed.join(names, "document_id"))


#: A chapter's sources are a hundred documents in a row, of one language.
@query(r"""WITH p AS (SELECT DISTINCT lang, chapter, doc_id, p FROM (SELECT lang, doc_id // 100 AS chapter, doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\A\s+|\s+\z', '', 'g') AS p FROM documents) WHERE p <> ''), n AS (SELECT lang, chapter, doc_id, count(*) AS n FROM p GROUP BY ALL),
    j AS (SELECT x.lang, x.chapter, x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM p x JOIN p y ON x.lang = y.lang AND x.chapter = y.chapter AND x.p = y.p AND x.doc_id < y.doc_id GROUP BY ALL)
    SELECT j.lang, j.chapter, a, b, CAST(shared AS BIGINT) AS shared, round(CAST(shared AS DOUBLE) / (na.n + nb.n - shared), 6) AS similarity, round(CAST(shared AS DOUBLE) / (na.n + nb.n - shared), 6) < 0.1 AS conflict_detected
    FROM j JOIN n na ON na.lang = j.lang AND na.doc_id = a JOIN n nb ON nb.lang = j.lang AND nb.doc_id = b""")
def chp8_source_similarity(spark, sf):
    sources = table(spark, sf, "documents").withColumn("chapter", F.floor(F.col("doc_id") / 100))
    return s.source_similarity(sources, "text", ["lang", "chapter"], "doc_id")


CLASSES = r"""p AS (SELECT DISTINCT lang, chapter, doc_id, p FROM (SELECT lang, doc_id // 100 AS chapter, doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\A\s+|\s+\z', '', 'g') AS p FROM documents) WHERE p <> ''),
    sets AS (SELECT lang, chapter, doc_id, count(*) AS n, string_agg(md5(p), '' ORDER BY p) AS marks FROM p GROUP BY ALL), named AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, chapter, marks) AS class FROM sets)"""


@query("WITH " + CLASSES + " SELECT lang, chapter, doc_id, class FROM named")
def chp8_source_classes(spark, sf):
    sources = table(spark, sf, "documents").withColumn("chapter", F.floor(F.col("doc_id") / 100))
    return s.source_classes(sources, "text", ["lang", "chapter"], "doc_id")[0].withColumnRenamed("of", "class")


@query("WITH " + CLASSES + """, heads AS (SELECT * FROM named WHERE class = doc_id), j AS (SELECT x.lang, x.chapter, x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM p x JOIN p y ON x.lang = y.lang AND x.chapter = y.chapter AND x.p = y.p AND x.doc_id < y.doc_id GROUP BY ALL)
    SELECT j.lang, j.chapter, a, b, CAST(shared AS BIGINT) AS shared, round(CAST(shared AS DOUBLE) / (na.n + nb.n - shared), 6) AS similarity FROM j JOIN heads na ON na.doc_id = a JOIN heads nb ON nb.doc_id = b WHERE 10 * shared >= na.n + nb.n - shared""")
def chp8_agreeing_sources(spark, sf):
    sources = table(spark, sf, "documents").withColumn("chapter", F.floor(F.col("doc_id") / 100))
    return s.agreeing_classes(s.source_classes(sources, "text", ["lang", "chapter"], "doc_id")[1], ["lang", "chapter"])
