"""Queries of the cleaning family."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from studylake.operators import clean as c
from studylake.plans.registry import query
from studylake.sources import derive as d
from studylake.sources import tables as t
from studylake.sources.derive import ctes
from studylake.sources.tables import table


#: The rules as literals, so that they are told apart from the operator's own.
NOISE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(TEXT, '(?im)第\s*\d+\s*页', '', 'g'), '(?im)Page\s+\d+', '', 'g'), '(?im)^\s*\d+\s*$', '', 'g'), '(?im)\d+\s*/\s*\d+', '', 'g'),
    '(?im)- \d+ -', '', 'g'), '(?im)---+\n+', chr(10), 'g'), '(?im)===+\n+', chr(10), 'g'), '(?im)___+\n+', chr(10), 'g'), '(?im)^\s*Copyright.*?$', '', 'g'), '(?im)^\s*©.*?$', '', 'g'),
    '(?im)^\s*All rights reserved.*?$', '', 'g'), '(?im)^\s*Confidential.*?$', '', 'g'), '(?im)^\s*Proprietary.*?$', '', 'g'), '(?im)^\s*Draft.*?$', '', 'g'), '(?im)\n{3,}', chr(10) || chr(10), 'g'),
    '(?im)[ \t]{2,}', ' ', 'g'), '\A\s+|\s+\z', '', 'g')"""
SYMBOL_SQL = r"""replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
    replace(replace(replace(replace(replace(replace(replace(replace(TEXT, 'α', '\alpha'), 'β', '\beta'), 'γ', '\gamma'), 'δ', '\delta'), 'Δ', '\Delta'), 'ε', '\epsilon'), 'θ', '\theta'), 'λ', '\lambda'), 'μ', '\mu'),
    'π', '\pi'), 'σ', '\sigma'), 'Σ', '\Sigma'), 'φ', '\phi'), 'ω', '\omega'), 'Ω', '\Omega'), '≤', '\leq'), '≥', '\geq'), '≠', '\neq'), '≈', '\approx'), '∞', '\infty'), '√', '\sqrt'), '∑', '\sum'), '∫', '\int'),
    '∂', '\partial'), '∇', '\nabla'), '×', '\times'), '÷', '\div'), '±', '\pm'), '∈', '\in'), '⊂', '\subset'), '∪', '\cup'), '∩', '\cap')"""


def noise_sql(text: str) -> str:
    return NOISE_SQL.replace("TEXT", text)


def symbol_sql(text: str) -> str:
    return SYMBOL_SQL.replace("TEXT", text)


CLEAN = f"cleaned AS (SELECT doc_id, page, clean AS text, length(text) AS original_length, length(clean) AS cleaned_length FROM (SELECT *, {noise_sql('text')} AS clean FROM pages) WHERE length(clean) >= 20)"
WITH_CLEAN = ctes("pages").rstrip() + ", " + CLEAN + " "


@query(ctes("pages") + f"SELECT doc_id, page, {noise_sql('text')} AS text FROM pages")
def cln1_remove_noise(spark, sf):
    return d.pages(spark, sf).select("doc_id", "page", c.remove_noise(F.col("text")).alias("text"))


@query(WITH_CLEAN + "SELECT doc_id, page, text, CAST(original_length AS INTEGER) AS original_length, CAST(cleaned_length AS INTEGER) AS cleaned_length, CAST(original_length - cleaned_length AS INTEGER) AS noise_removed FROM cleaned")
def cln2_clean_pages(spark, sf):
    return c.clean_pages(d.pages(spark, sf))


@query(ctes("formulas") + f"SELECT doc_id, page, formula_index, {symbol_sql('latex')} AS latex, true AS corrected FROM formulas")
def cln3_correct_symbols(spark, sf):
    return c.correct_symbols(d.formulas(spark, sf))


@query(r"SELECT page_id, md5(regexp_replace(chr(7) || html || chr(27), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS digest FROM pages")
def cln4_sanitized(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(c.sanitized(F.concat(F.lit("\x07"), "html", F.lit("\x1b")))).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'id' ELSE '' END || CASE WHEN length(text) BETWEEN 100 AND 2000 THEN '' ELSE 'length' END || CASE WHEN lang IN ('en', 'fr') THEN '' ELSE 'lang' END AS broken
    FROM documents WHERE doc_id % 4 = 0 OR NOT (length(text) BETWEEN 100 AND 2000) OR lang NOT IN ('en', 'fr')""")
def cln5_rejected_rows(spark, sf):
    docs = table(spark, sf, "documents")
    made = F.concat(F.lpad(F.hex("doc_id"), 8, "0"), F.when(F.col("doc_id") % 4 == 0, "-0000-0000-0000-0").otherwise("-0000-4000-8000-000000000000"))
    rules = {"id": c.is_uuid(F.col("uuid")), "length": F.length("text").between(100, 2000), "lang": F.col("lang").isin("en", "fr")}
    return c.validity(docs.withColumn("uuid", made), rules)[1].select("doc_id", F.array_join("broken", "").alias("broken"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'textbook' WHEN 'click' THEN 'exam' END AS material FROM events")
def cln6_material_types(spark, sf):
    said = F.when(F.col("event_type") == "view", " TextBook ").when(F.col("event_type") == "click", "EXAM").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", c.one_of(said, c.MATERIALS).alias("material"))


@query(r"SELECT doc_id, CASE WHEN length(x) > 600 THEN x[1:600] || '…' ELSE x END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)")
def cln7_snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", c.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:40], ' ') AS words FROM documents")
def cln8_first_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", c.first_words(F.col("text"), 40).alias("words"))


@query(ctes("section_markdown") + r"""
    SELECT doc_id, CAST(page AS INTEGER) AS page, coalesce(parts[page], '') AS text FROM (SELECT doc_id, parts, unnest(range(1, 13)) AS page
        FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(markdown, '\f|\n{2,}'), lambda x: regexp_replace(x, '\A\s+|\s+\z', '', 'g')), lambda x: x <> '') AS parts FROM section_markdown))""")
def cln9_split_pages(spark, sf):
    return c.split_pages(d.section_markdown(spark, sf), "markdown", F.lit(12))


@query(WITH_CLEAN.rstrip() + f""", docs AS (SELECT DISTINCT doc_id FROM cleaned UNION SELECT DISTINCT l_orderkey FROM lineitem UNION SELECT p_partkey FROM part)
    SELECT doc_id, CAST(coalesce(p, 0) AS BIGINT) AS total_pages, CAST(coalesce(t, 0) AS BIGINT) AS total_tables, CAST(coalesce(f, 0) AS BIGINT) AS total_formulas, true AS postprocessed
    FROM docs LEFT JOIN (SELECT doc_id, count(*) AS p FROM cleaned GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT l_orderkey AS doc_id, count(*) AS t FROM lineitem GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT p_partkey AS doc_id, count(*) AS f FROM part GROUP BY 1) USING (doc_id)""")
def cln10_extraction_summary(spark, sf):
    return c.extraction_summary(c.clean_pages(d.pages(spark, sf)), d.doc_tables(spark, sf), d.formulas(spark, sf))


DOC_TABLES = f"doc_tables AS ({d.SQL['doc_tables']})"
RUNS = """fold AS (SELECT doc_id, page, col_count, h, rn, page AS start_page, h AS start_h FROM doc_tables WHERE rn = 1
        UNION ALL SELECT doc_id, page, col_count, h, rn, CASE WHEN joins THEN start_page ELSE page END, CASE WHEN joins THEN start_h ELSE h END
        FROM (SELECT n.*, f.start_page, f.start_h, n.page = f.page + 1 AND n.col_count = f.col_count AND (n.h = '' OR n.h = f.start_h) AS joins FROM fold f JOIN doc_tables n ON n.doc_id = f.doc_id AND n.rn = f.rn + 1))"""
MERGED = "merged AS (SELECT doc_id, CAST(start_page AS INTEGER) AS page_start, CAST(max(page) AS INTEGER) AS page_end, CAST(count(*) AS INTEGER) AS row_count, count(*) > 1 AS merged FROM fold GROUP BY doc_id, start_page)"
RECURSIVE = f"WITH RECURSIVE {DOC_TABLES}, {RUNS}, {MERGED}"


@query(RECURSIVE + " SELECT doc_id, page_start, page_end, row_count, merged FROM merged")
def tab1_merged_tables(spark, sf):
    return c.merge_tables(d.doc_tables(spark, sf)).select("doc_id", "page_start", "page_end", "row_count", "merged")


@query(f"WITH {DOC_TABLES}" + """, n AS (SELECT *, lead(page) OVER w AS p2, lead(col_count) OVER w AS c2, lead(h) OVER w AS h2 FROM doc_tables WINDOW w AS (PARTITION BY doc_id ORDER BY page))
    SELECT doc_id, page, coalesce(p2 = page + 1 AND c2 = col_count AND (h2 = '' OR h2 = h), false) AS joins FROM n""")
def tab1b_pairs_to_merge(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("page")
    x = d.doc_tables(spark, sf)
    for name in ("page", "col_count", "headers"):
        x = x.withColumn(f"next_{name}", F.lead(name).over(order))
    joins = c.should_merge(*[F.col(n) for n in ("page", "col_count", "headers", "next_page", "next_col_count", "next_headers")])
    return x.select("doc_id", "page", F.coalesce(joins, F.lit(False)).alias("joins"))


#: Pages with captions for the tables of orders.
CAPTIONS = """cpages AS (SELECT doc_id, page, CASE doc_id % 4 WHEN 0 THEN 'Table ' || page || ': Goods of an order' || chr(10) || chr(10) WHEN 1 THEN 'see fig. 7. A chart' || chr(10) || chr(10) ELSE '' END
    || 'This paragraph tells what order ' || doc_id || ' holds.' || chr(10) || chr(10) || doc_id AS text FROM doc_tables WHERE page % 3 <> 0)"""
CAPTION_PAGES = f"{DOC_TABLES}, {CAPTIONS}"


def caption_pages(spark, sf):
    o, n = F.col("doc_id"), F.col("page")
    head = F.when(o % 4 == 0, F.concat(F.lit("Table "), n.cast("string"), F.lit(": Goods of an order\n\n"))).when(o % 4 == 1, "see fig. 7. A chart\n\n").otherwise("")
    text = F.concat(head, F.lit("This paragraph tells what order "), o.cast("string"), F.lit(" holds.\n\n"), o.cast("string"))
    return d.doc_tables(spark, sf).where(n % 3 != 0).select("doc_id", "page", text.alias("text"))


OWN = "CASE WHEN text IS NOT NULL THEN CASE doc_id % 4 WHEN 0 THEN 'Table ' || page || ': Goods of an order' WHEN 1 THEN 'fig. 7. A chart' END END"
CONTEXT = f"""tabled AS (SELECT doc_id, page, coalesce({OWN}, 'Table ' || rn || ' (Page ' || page || ')') AS caption,
    CASE WHEN text IS NOT NULL THEN 'This paragraph tells what order ' || doc_id || ' holds.' END AS context FROM doc_tables LEFT JOIN cpages USING (doc_id, page))"""


@query("WITH " + CAPTION_PAGES + ", " + CONTEXT + " SELECT doc_id, page, caption, context FROM tabled")
def tab2_table_context(spark, sf):
    return c.with_context(d.doc_tables(spark, sf), caption_pages(spark, sf)).select("doc_id", "page", "caption", "context")


@query("WITH " + CAPTION_PAGES + r" SELECT doc_id, page, coalesce(nullif(regexp_extract(text, '(?i)(Table\s+\d+[:\.][^\n]*)', 1), ''), nullif(regexp_extract(text, '(?i)(Fig\.\s*\d+[:\.][^\n]*)', 1), '')) AS caption FROM cpages")
def tab2a_captions(spark, sf):
    return caption_pages(spark, sf).select("doc_id", "page", c.caption(F.col("text")).alias("caption"))


@query(WITH_CLEAN + r"""SELECT doc_id, page, CASE WHEN length(p) > 200 THEN p[1:200] || '...' ELSE p END AS context FROM (SELECT doc_id, page,
    list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '\A\s+|\s+\z', '', 'g')), lambda x: length(x) > 20 AND NOT regexp_full_match(x, '\d+'))[-1] AS p FROM cleaned)""")
def tab2b_contexts(spark, sf):
    return c.clean_pages(d.pages(spark, sf)).select("doc_id", "page", c.context(F.col("text")).alias("context"))


@query(RECURSIVE + ", " + CAPTIONS + f"""
    SELECT doc_id, page AS page_start, page_end, row_count, merged, coalesce({OWN}, 'Table ' || row_number() OVER (PARTITION BY doc_id ORDER BY page) || ' (Page ' || page || ')') AS caption
    FROM (SELECT *, page_start AS page FROM merged) LEFT JOIN cpages USING (doc_id, page)""")
def cln11_process(spark, sf):
    done = c.process(caption_pages(spark, sf), d.doc_tables(spark, sf), d.formulas(spark, sf))
    return done["tables"].select("doc_id", "page_start", "page_end", "row_count", "merged", "caption")


@query(WITH_CLEAN.rstrip() + """, r AS (SELECT doc_id, sum(length(text)) AS raw, count(*) AS n, count(*) FILTER (WHERE contains(text, 'Page ') OR contains(text, '页')) AS pn, count(*) FILTER (WHERE contains(text, 'Copyright') OR contains(text, '©')) AS cn, count(*) FILTER (WHERE contains(text, '---') OR contains(text, '===')) AS sn FROM pages GROUP BY 1),
    k AS (SELECT doc_id, sum(cleaned_length) AS clean, count(*) AS m FROM cleaned GROUP BY 1)
    SELECT doc_id, CAST(raw AS BIGINT) AS raw_chars, CAST(coalesce(clean, 0) AS BIGINT) AS clean_chars, CAST(raw - coalesce(clean, 0) AS BIGINT) AS removed_chars, CASE WHEN raw > 0 THEN round(100.0 * CAST(raw - coalesce(clean, 0) AS DOUBLE) / raw, 2) ELSE 0.0 END AS removed_percent,
        CAST(n - coalesce(m, 0) AS BIGINT) AS pages_removed, CAST(pn AS BIGINT) AS page_numbers, CAST(cn AS BIGINT) AS copyright_notices, CAST(sn AS BIGINT) AS separators FROM r LEFT JOIN k USING (doc_id)""")
def cln12_noise_report(spark, sf):
    pages = d.pages(spark, sf)
    return c.noise_report(pages, c.clean_pages(pages))


@query(RECURSIVE + """
    SELECT doc_id, tables_before, CAST(count(*) AS BIGINT) AS tables_after, CAST(count(*) FILTER (WHERE merged) AS BIGINT) AS merged_tables, round(avg(row_count), 1) AS avg_rows
    FROM merged JOIN (SELECT doc_id, CAST(count(*) AS BIGINT) AS tables_before FROM doc_tables GROUP BY 1) USING (doc_id) GROUP BY 1, 2""")
def cln13_table_report(spark, sf):
    before = d.doc_tables(spark, sf)
    after = c.merge_tables(before).withColumn("context", F.lit(None).cast("string"))
    return c.table_report(before, after).drop("with_context")


@query(ctes("formulas") + f"SELECT CAST(count(*) AS BIGINT) AS formulas, CAST(count(*) FILTER (WHERE {symbol_sql('latex')} <> latex) AS BIGINT) AS changed, round(100.0 * CAST(count(*) FILTER (WHERE {symbol_sql('latex')} <> latex) AS DOUBLE) / count(*), 1) AS changed_percent FROM formulas")
def cln13_symbol_report(spark, sf):
    before = d.formulas(spark, sf)
    return c.symbol_report(before, c.correct_symbols(before))


@query("""SELECT o_orderpriority AS method, CAST(count(*) FILTER (WHERE k = 0) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE k = 1) AS BIGINT) AS tables, CAST(count(*) FILTER (WHERE k = 2) AS BIGINT) AS formulas,
    CAST(count(*) FILTER (WHERE k = 3) AS BIGINT) AS code_blocks, CAST(count(*) FILTER (WHERE k = 4) AS BIGINT) AS images, round(count(*) FILTER (WHERE k = 0) * 1500 * CAST(0.000002625 AS DOUBLE), 6) AS cost FROM (SELECT *, o_orderkey % 5 AS k FROM orders) GROUP BY 1""")
def cln14_comparison(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("pages", "tables", "formulas", "code_blocks", "images")])
    return c.comparison(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("method"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("content_type")))


@query(ctes("pages") + "SELECT doc_id, page, text FROM pages WHERE doc_id % 7 <> 0")
def src2_parsed_output(spark, sf):
    listed = d.pages(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("page", "text")).alias("pages"))
    raw = F.when(F.col("doc_id") % 7 == 0, F.lit('{"error": "no pages"}')).otherwise(F.to_json(F.struct("pages")))
    return t.parse_output(listed.select("doc_id", raw.alias("raw")), "raw")[0]


@query(ctes("pages") + "SELECT doc_id, page, CASE WHEN page % 5 = 0 THEN 'broken {' ELSE text END AS text, CASE WHEN page % 5 = 0 THEN 'invalid JSON' END AS error FROM pages")
def src3_parsed_vision(spark, sf):
    raw = F.when(F.col("page") % 5 == 0, F.lit("broken {")).otherwise(F.to_json(F.struct("text")))
    return t.parse_vision(d.pages(spark, sf).select("doc_id", "page", raw.alias("raw")), "raw")


@query("SELECT p_partkey AS doc_id, CAST(2 AS BIGINT) AS n_pages, 'Page of ' || p_name AS first_text FROM part")
def src1_extraction_content(spark, sf):
    name = F.col("p_name")
    made = F.struct(F.array(F.struct(F.lit(1).alias("page"), F.concat(F.lit("Page of "), name).alias("text")), F.struct(F.lit(2).alias("page"), name.alias("text"))).alias("pages"))
    raw = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.from_json(F.to_json(made), t.EXTRACTION.split(", ", 1)[1]).alias("x")).select("doc_id", "x.*")
    return t.content(raw, "pages").groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.min_by("text", "ordinal").alias("first_text"))


def extraction_files(spark, sf):
    """The documents' pages as JSON files of about a hundred documents, an array over several lines each; every seventh is cut off."""
    pages = d.pages(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    each = pages.select(F.floor(F.col("doc_id") / 100).alias("bucket"), F.to_json(F.struct("doc_id", "pages")).alias("j"))
    files = each.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list("j")), ",\n").alias("j"))
    path = f"{t.shared_dir(spark)}/extractions-{uuid.uuid4().hex}"
    text = F.concat(F.lit("[\n"), "j", F.when(F.col("bucket") % 7 == 3, F.lit("")).otherwise(F.lit("\n]")))
    files.select("bucket", text.alias("value")).repartition("bucket").write.partitionBy("bucket").text(path)
    return path


@query(ctes("pages") + " SELECT doc_id, CAST(count(*) AS BIGINT) AS n_pages, md5(string_agg(text, '|' ORDER BY page)) AS digest FROM pages WHERE (doc_id // 100) % 7 <> 3 GROUP BY doc_id")
def src1_extraction_files(spark, sf):
    found, _ = t.read_extractions(spark, extraction_files(spark, sf))
    rows = t.content(found, "pages").groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return rows.select("doc_id", "n_pages", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "|")).alias("digest"))


@query(ctes("pages") + " SELECT CAST(doc_id // 100 AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS pages FROM pages WHERE (doc_id // 100) % 7 = 3 GROUP BY 1")
def src1_rejected_files(spark, sf):
    _, rejects = t.read_extractions(spark, extraction_files(spark, sf))
    held = F.size(F.regexp_extract_all("broken", F.lit(r'\{"page":'), F.lit(0)))
    return rejects.select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("int").alias("bucket"), held.cast("long").alias("pages"))


CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double"}


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal > 0")
def src5_relational_customers(spark, sf):
    """Through the embedded database of Spark's jars, which lives in the driver's process: for local sessions."""
    url = f"jdbc:derby:memory:studylake{uuid.uuid4().hex};create=true"
    rows = table(spark, sf, "customer").select(*[F.col(c).cast(k).alias(c) for c, k in CUSTOMER.items()])
    t.write_relational(rows, url, "customer", CUSTOMER, column_types="c_name VARCHAR(200)")
    return t.read_relational(spark, url, "customer", CUSTOMER, "c_custkey", rows_a_part=500).where("c_acctbal > 0 AND c_custkey % 3 = 0")


@query("SELECT r_regionkey, r_name FROM region")
def src5_checked_table(spark, sf):
    return t.checked(table(spark, sf, "region"), {"r_regionkey": "int", "r_name": "string"}).select("r_regionkey", "r_name")


@query()
def src4_stored_objects(spark, sf):
    found = t.stored_objects(spark, sf)
    return found.select(F.regexp_replace("key", r"^.*/(?=[^/]+\.parquet(/|$))", "").alias("key"), "size_bytes")
