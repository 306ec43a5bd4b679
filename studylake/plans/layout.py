"""Queries of the layout and Markdown family."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import clean
from studylake.operators import layout as y
from studylake.plans.registry import query
from studylake.sources import derive as d
from studylake.sources.derive import ctes
from studylake.sources.tables import table

CLUSTERS = """, gaps AS (SELECT *, CASE WHEN x0 - lag(x0) OVER w > 30 THEN 1 ELSE 0 END AS new FROM uniq WINDOW w AS (PARTITION BY doc_id, page ORDER BY x0, span_idx)),
    clustered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY x0, span_idx ROWS UNBOUNDED PRECEDING) AS cluster FROM gaps),
    lefts AS (SELECT doc_id, page, cluster, min(x0) AS x_left, max(page_width) AS width FROM clustered GROUP BY ALL),
    cols AS (SELECT *, coalesce(lead(x_left) OVER (PARTITION BY doc_id, page ORDER BY x_left) - 15, width) AS x_right FROM lefts),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY x_left) - 1 AS idx FROM cols WHERE x_right - x_left >= 100),
    pages_l AS (SELECT doc_id, page, count(*) AS clusters, count(*) FILTER (WHERE x_right - x_left >= 100) AS n FROM cols GROUP BY ALL),
    layouts AS (SELECT *, CASE WHEN clusters <= 1 OR n = 1 THEN 'single_column' WHEN n = 2 THEN 'two_column' WHEN n = 3 THEN 'three_column' ELSE 'mixed' END AS layout FROM pages_l),
    assigned AS (SELECT s.*, coalesce((SELECT min(idx) FROM kept k WHERE k.doc_id = s.doc_id AND k.page = s.page AND k.x_left <= (s.x0 + s.x1) / 2 AND (s.x0 + s.x1) / 2 <= k.x_right), 0) AS col FROM uniq s),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, y0, span_idx) - 1 AS reading_order FROM assigned),
    bodies AS (SELECT doc_id, page, list(font_size ORDER BY font_size)[count(*) // 2 + 1] AS body FROM uniq GROUP BY ALL),
    headed AS (SELECT o.*, regexp_matches(font_name, '(?i)bold') AS bold, CASE WHEN NOT ((font_size / body >= 1.2 AND font_size >= 12) OR (regexp_matches(font_name, '(?i)bold') AND font_size / body >= 1.1)) THEN 0 WHEN font_size / body >= 1.5 THEN 1 WHEN font_size / body >= 1.3 THEN 2 ELSE 3 END AS heading_level
        FROM ordered o JOIN bodies USING (doc_id, page))"""
#: Spans with one row for each index of a page.
UNIQ = ", uniq AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY doc_id ORDER BY span_idx, text, y0) AS INTEGER) AS span_idx) FROM spans)"
LAID = ctes("spans").rstrip() + UNIQ + CLUSTERS + " "


def spans(spark, sf):
    order = y.Window.partitionBy("doc_id").orderBy("span_idx", "text", "y0")
    return d.spans(spark, sf).withColumn("span_idx", F.row_number().over(order))


def laid(spark, sf):
    s = spans(spark, sf)
    return y.headed(y.read_in_order(y.assigned(s, y.columns(s))))


@query(ctes("spans").rstrip() + UNIQ + " SELECT doc_id, page, span_idx, text, regexp_matches(font_name, '(?i)bold') AS bold FROM uniq")
def lay1_flattened(spark, sf):
    s = spans(spark, sf)
    blocks = s.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("span_idx", F.concat(F.lit("  "), "text").alias("text"), "font_name"))).alias("spans"))
    nested = blocks.select("doc_id", "page", F.array(F.struct(F.array(F.struct("spans"), F.struct(F.array(F.struct(F.lit(0).alias("span_idx"), F.lit(" ").alias("text"), F.lit("x").alias("font_name"))).alias("spans"))).alias("lines"))).alias("blocks"))
    return y.flattened(nested).select("doc_id", "page", "span_idx", "text", "bold")


@query(LAID + "SELECT doc_id, page, span_idx, CAST(cluster AS BIGINT) AS cluster FROM clustered")
def lay2_clusters(spark, sf):
    return y.clustered(spans(spark, sf)).select("doc_id", "page", "span_idx", "cluster")


@query(LAID + "SELECT doc_id, page, CAST(clusters AS BIGINT) AS clusters, CAST(n AS INTEGER) AS n_columns, layout FROM layouts")
def lay3_columns(spark, sf):
    return y.columns(spans(spark, sf)).select("doc_id", "page", "clusters", F.size("columns").alias("n_columns"), "layout")


@query(LAID + "SELECT doc_id, page, span_idx, CAST(col AS INTEGER) AS col FROM assigned")
def lay4_assigned(spark, sf):
    s = spans(spark, sf)
    return y.assigned(s, y.columns(s)).select("doc_id", "page", "span_idx", F.col("column").alias("col"))


@query(LAID + "SELECT doc_id, page, span_idx, CAST(reading_order AS INTEGER) AS reading_order FROM ordered")
def lay5_reading_order(spark, sf):
    return laid(spark, sf).select("doc_id", "page", "span_idx", "reading_order")


@query(LAID + "SELECT doc_id, page, span_idx, CAST(heading_level AS INTEGER) AS heading_level FROM headed")
def lay6_headings(spark, sf):
    return laid(spark, sf).select("doc_id", "page", "span_idx", "heading_level")


@query(LAID + "SELECT doc_id, CASE WHEN count(DISTINCT layout) = 1 THEN min(layout) ELSE 'mixed' END AS layout_type FROM layouts GROUP BY doc_id")
def lay7_overall(spark, sf):
    return y.overall(y.columns(spans(spark, sf)))


@query(LAID + """, h AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, reading_order) AS INTEGER) AS pos FROM headed WHERE heading_level > 0),
    p AS (SELECT *, last_value(CASE WHEN heading_level = 1 THEN pos END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN heading_level = 2 THEN pos END IGNORE NULLS) OVER w AS h2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id, page, pos, CAST(heading_level AS INTEGER) AS heading_level, text, CASE heading_level WHEN 2 THEN h1 WHEN 3 THEN CASE WHEN h2 > coalesce(h1, 0) THEN h2 ELSE h1 END END AS parent_pos FROM p""")
def lay8_outline(spark, sf):
    return y.outline(laid(spark, sf))


@query(LAID + """SELECT doc_id, CAST(count(DISTINCT page) AS BIGINT) AS total_pages, CAST(count(*) FILTER (WHERE heading_level > 0) AS BIGINT) AS total_headings, layout_type
    FROM headed JOIN (SELECT doc_id, CASE WHEN count(DISTINCT layout) = 1 THEN min(layout) ELSE 'mixed' END AS layout_type FROM layouts GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, layout_type""")
def lay9_totals(spark, sf):
    return y.totals(laid(spark, sf), y.columns(spans(spark, sf)))


@query(ctes("spans").rstrip() + UNIQ + """ SELECT doc_id, page, span_idx // 3 AS block, string_agg(text, chr(10) ORDER BY span_idx) AS code, CAST(count(*) AS BIGINT) AS line_count FROM uniq GROUP BY 1, 2, 3
    HAVING bool_or(regexp_matches(font_name, 'Mono|Courier|Code')) AND length(string_agg(text, chr(10))) >= 10""")
def lay10_code_blocks(spark, sf):
    return y.code_blocks(spans(spark, sf).withColumn("block", F.floor(F.col("span_idx") / 3).cast("int")))


@query(ctes("doc_tables") + """, r AS (SELECT doc_id, page, '### Table of ' || doc_id || chr(10) || CASE WHEN h = '' THEN '' ELSE '*About ' || doc_id || '*' || chr(10) END
        || CASE WHEN h = '' THEN '|  |  |' WHEN col_count = 2 THEN '| Name | Value |' ELSE '| Name | Value | Unit |' END || chr(10) || CASE WHEN h = '' OR col_count = 2 THEN '| --- | --- |' ELSE '| --- | --- | --- |' END || chr(10) AS top, h, col_count FROM doc_tables)
    SELECT doc_id, page, top || '| x | ' || page || CASE WHEN h = '' OR col_count = 2 THEN ' |' ELSE ' |  |' END || chr(10) || CASE WHEN page % 2 = 0 THEN '<!-- Source: Page ' || page || ' -->' ELSE '<!-- Source: Pages ' || page || '-' || (page + 1) || ' -->' END AS markdown FROM r""")
def md1_tables(spark, sf):
    t = d.doc_tables(spark, sf)
    named = t.withColumns({"caption": F.concat(F.lit("Table of "), F.col("doc_id").cast("string")), "context": F.when(F.get("headers", F.lit(0)) != "", F.concat(F.lit("About "), F.col("doc_id").cast("string"))), "rows": F.array(F.array(F.lit(" x"), F.col("page").cast("string"))), "page_start": F.col("page"), "page_end": F.col("page") + F.col("page") % 2})
    return named.select("doc_id", "page", y.table_markdown().alias("markdown"))


@query(ctes("formulas") + "SELECT doc_id, CASE WHEN length(latex) > 20 THEN '$$' || chr(10) || latex || chr(10) || latex || chr(10) || '$$' ELSE '$' || latex || '$' END AS markdown FROM formulas")
def md2_formulas(spark, sf):
    latex = F.when(F.length("latex") > 20, F.concat("latex", F.lit("\n"), "latex")).otherwise(F.col("latex"))
    return d.formulas(spark, sf).select("doc_id", y.formula_markdown(latex).alias("markdown"))


@query("""SELECT p_partkey AS doc_id, '```' || CASE p_size % 3 WHEN 0 THEN 'cpp' WHEN 1 THEN '' ELSE 'sql' END || chr(10) || p_name || chr(10) || '```' || chr(10) || '<!-- Code from page ' || p_size || ', detected as: ' || CASE p_size % 3 WHEN 0 THEN 'c++' WHEN 1 THEN 'text' ELSE 'sql' END || ' -->' AS markdown FROM part""")
def md3_code(spark, sf):
    p = table(spark, sf, "part")
    lang = F.when(F.col("p_size") % 3 == 0, "C++").when(F.col("p_size") % 3 == 1, "Text").otherwise("SQL")
    return p.select(F.col("p_partkey").alias("doc_id"), y.code_markdown(F.col("p_name"), lang, F.col("p_size")).alias("markdown"))


@query("SELECT p_partkey AS doc_id, '![Image 0 from page ' || p_size || ' (' || p_size * 10 || 'x' || p_size * 5 || ')](image_p' || p_size || '_0.png)' AS markdown FROM part")
def md4_images(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("page"), F.lit(0).alias("image_index"), (F.col("p_size") * 10).alias("width"), (F.col("p_size") * 5).alias("height"), F.lit(None).cast("string").alias("format"))
    return p.select("doc_id", y.image_markdown().alias("markdown"))


def contents(spark, sf):
    pages = d.pages(spark, sf)
    f = pages.where("page % 2 = 0").select("doc_id", "page", F.lit(2).alias("rank"), F.lit(0).alias("ordinal"), F.lit("$x$").alias("markdown"))
    i = pages.where("page % 3 = 0").select("doc_id", "page", F.lit(4).alias("rank"), F.lit(0).alias("ordinal"), F.lit("![i](i.png)").alias("markdown"))
    return pages, f.unionByName(i)


PAGED = r"""paged AS (SELECT doc_id, page, regexp_replace(text, '\A\s+|\s+\z', '', 'g') || CASE WHEN page % 2 = 0 THEN chr(10) || chr(10) || '$x$' ELSE '' END || CASE WHEN page % 3 = 0 THEN chr(10) || chr(10) || '![i](i.png)' ELSE '' END AS markdown FROM pages)"""


@query(ctes("pages").rstrip() + ", " + PAGED + " SELECT doc_id, page, markdown FROM paged")
def md5_pages(spark, sf):
    return y.pages_markdown(*contents(spark, sf))


@query(LAID + """, items AS (SELECT doc_id, page, reading_order AS place, y0, CASE WHEN heading_level > 0 THEN repeat('#', CAST(heading_level AS INTEGER)) || ' ' || text WHEN bold THEN '**' || text || '**' ELSE text END AS markdown FROM headed
        UNION ALL SELECT DISTINCT doc_id, page, 9999, 0.0, '$x$' FROM uniq WHERE doc_id % 3 = 0)
    SELECT doc_id, page, string_agg(markdown, chr(10) || chr(10) ORDER BY place, y0) AS markdown FROM items GROUP BY 1, 2""")
def md6_layout_pages(spark, sf):
    s = laid(spark, sf)
    extra = s.where("doc_id % 3 = 0").select("doc_id", "page", F.lit(0.0).alias("y0"), F.lit(0).alias("ordinal"), F.lit("$x$").alias("markdown")).distinct()
    return y.layout_markdown(s, extra)


@query(ctes("spans").rstrip() + UNIQ + " SELECT doc_id, page, span_idx FROM uniq s WHERE NOT EXISTS (SELECT 1 FROM uniq t WHERE t.span_idx % 4 = 0 AND t.doc_id = s.doc_id AND t.page = s.page AND abs(round(s.y0, 1) - round(t.y0 + 2, 1)) < 5 AND abs(round(s.y1, 1) - round(t.y1 + 2, 1)) < 5)")
def md7_outside_tables(spark, sf):
    s = spans(spark, sf)
    return y.outside_tables(s, s.where("span_idx % 4 = 0").select("doc_id", "page", (F.col("y0") + 2).alias("top"), (F.col("y1") + 2).alias("bottom"))).select("doc_id", "page", "span_idx")


MD8 = ctes("pages").rstrip() + ", " + PAGED + """ SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || '<!-- Extraction mode: deterministic -->' || chr(10) || chr(10) || string_agg(markdown, chr(10) || chr(10) ORDER BY page)
    || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Document Metadata' || chr(10) || chr(10) || '- **Total Pages**: ' || count(*) || chr(10) || '- **Tables**: 0' || chr(10) || '- **Formulas**: 0' AS markdown FROM paged GROUP BY doc_id"""


@query(MD8)
def md8_converted(spark, sf):
    pages, extra = contents(spark, sf)
    none = pages.where("false")
    summary = clean.extraction_summary(pages, none, none)
    return y.converted(y.pages_markdown(pages, extra), F.concat(F.lit("Document "), F.col("doc_id").cast("string")), "deterministic", summary)


MARKED = "marked AS (SELECT doc_id, 'before' || chr(10) || string_agg('## Page ' || page || chr(10) || chr(10) || text, chr(10) ORDER BY page) AS markdown FROM pages GROUP BY doc_id)"


def marked(spark, sf):
    got = F.array_sort(F.collect_list(F.struct("page", "text")))
    one = F.transform(got, lambda x: F.concat(F.lit("## Page "), x["page"].cast("string"), F.lit("\n\n"), x["text"]))
    return d.pages(spark, sf).groupBy("doc_id").agg(F.concat(F.lit("before\n"), F.array_join(one, "\n")).alias("markdown"))


@query(ctes("pages") + r"SELECT doc_id, page, regexp_replace(text, '\A\s+|\s+\z', '', 'g') AS text FROM pages")
def md9_parsed_pages(spark, sf):
    return y.parsed_pages(marked(spark, sf), "markdown")


@query(ctes("pages") + """, ranges AS (SELECT doc_id, r AS range_id, r * 4 + 1 AS s, r * 4 + 5 AS e FROM documents, (VALUES (0), (1), (2)) v(r))
    SELECT doc_id, range_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, CAST(count(*) AS BIGINT) AS n_pages FROM ranges JOIN pages USING (doc_id) WHERE page BETWEEN s AND e GROUP BY 1, 2""")
def md10_page_ranges(spark, sf):
    r = F.col("range_id")
    ranges = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("range_id"))
    return y.page_ranges(d.pages(spark, sf), ranges.withColumns({"page_start": r * 4 + 1, "page_end": r * 4 + 5}))
