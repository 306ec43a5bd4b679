"""Page layout and Markdown: columns, reading order, headings, outline; tables, formulas, code and pages as Markdown.

Everything about columns and order is per (doc_id, page): windows stay as small as a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.text import strip

GAP, MARGIN, NARROWEST = 30, 15, 100
PAGE = ("doc_id", "page")
#: Names of languages in fences.
FENCES = {"c++": "cpp", "shell": "bash", "plaintext": "", "text": ""}
#: Rank of a page's contents where no layout is known, and of anything but text where one is.
RANKS, LAST = {"text": 0, "table": 1, "formula": 2, "code": 3, "image": 4}, 9999


def flattened(blocks: DataFrame) -> DataFrame:
    """Spans with text from blocks (doc_id, page, blocks array<struct<lines array<struct<spans array<span>>>>>), bold marked."""
    rows = blocks.select(*PAGE, F.posexplode("blocks").alias("block", "b")).select(*PAGE, "block", F.posexplode("b.lines").alias("line", "l"))
    rows = rows.select(*PAGE, "block", "line", F.posexplode("l.spans").alias("span", "s")).select(*PAGE, "block", "line", "span", "s.*")
    return marked_bold(rows.withColumn("text", strip(F.col("text"))).where("text <> ''"))


def marked_bold(spans: DataFrame) -> DataFrame:
    return spans.withColumn("bold", F.col("font_name").rlike("(?i)bold|heavy|black|semibold"))


def clustered(spans: DataFrame, gap: float = GAP) -> DataFrame:
    """Spans with the cluster of their left edge on the page, numbered from 0: a new one after each gap."""
    order = Window.partitionBy(*PAGE).orderBy("x0", "span_idx")
    new = F.coalesce((F.col("x0") - F.lag("x0").over(order) > gap).cast("int"), F.lit(0))
    return spans.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(order)).drop("__new")


def columns(spans: DataFrame, gap: float = GAP) -> DataFrame:
    """By page: the columns (x_left, x_right) that are wide enough and the layout's name."""
    left = clustered(spans, gap).groupBy(*PAGE, "cluster").agg(F.min("x0").alias("x_left"), F.max("page_width").alias("width"))
    after = F.lead("x_left").over(Window.partitionBy(*PAGE).orderBy("x_left"))
    left = left.withColumn("x_right", F.coalesce(after - MARGIN, F.col("width")))
    wide = F.when(F.col("x_right") - F.col("x_left") >= NARROWEST, F.struct("x_left", "x_right"))
    per = left.groupBy(*PAGE).agg(F.count("*").alias("clusters"), F.array_sort(F.collect_list(wide)).alias("columns"))
    n = F.size("columns")
    name = F.when((F.col("clusters") <= 1) | (n == 1), "single_column").when(n == 2, "two_column").when(n == 3, "three_column").otherwise("mixed")
    return per.select(*PAGE, "clusters", "columns", name.alias("layout"))


def assigned(spans: DataFrame, cols: DataFrame) -> DataFrame:
    """Spans with the first column that holds their centre, else column 0."""
    centre = (F.col("x0") + F.col("x1")) / 2
    hits = F.transform("columns", lambda c: (c["x_left"] <= centre) & (centre <= c["x_right"]))
    return spans.join(cols.select(*PAGE, "columns"), list(PAGE), "left").withColumn("column", F.greatest(F.lit(0), F.coalesce(F.array_position(hits, True), F.lit(0)) - 1).cast("int")).drop("columns")


def read_in_order(spans: DataFrame) -> DataFrame:
    """Spans with column numbered in reading order from 0: by column, from top, then as extracted."""
    order = Window.partitionBy(*PAGE).orderBy("column", "y0", "span_idx")
    return spans.withColumn("reading_order", F.row_number().over(order) - 1)


def headed(spans: DataFrame) -> DataFrame:
    """Spans with heading level 0 to 3 against the page's body size, the upper median of its font sizes."""
    sizes = F.sort_array(F.collect_list(F.when(F.col("font_size") > 0, F.col("font_size"))).over(Window.partitionBy(*PAGE)))
    body = F.coalesce(F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")), F.lit(0.0))
    ratio = F.when(F.col("body") > 0, F.col("font_size") / F.col("body")).otherwise(F.lit(0.0))
    rows = marked_bold(spans).withColumn("body", body)
    heading = ((ratio >= 1.2) & (F.col("font_size") >= 12)) | (F.col("bold") & (ratio >= 1.1))
    return rows.withColumn("heading_level", F.when(~heading, 0).when(ratio >= 1.5, 1).when(ratio >= 1.3, 2).otherwise(3))


def overall(cols: DataFrame) -> DataFrame:
    """A document's layout: its pages' if all agree, else mixed."""
    return cols.groupBy("doc_id").agg(F.count_distinct("layout").alias("n"), F.min("layout").alias("one")).select("doc_id", F.when(F.col("n") == 1, F.col("one")).otherwise("mixed").alias("layout_type"))


def outline(spans: DataFrame) -> DataFrame:
    """Headings in document order with the place of their parent: level 2 under the last 1, level 3 under the last 2 since
    then, else under the last 1; null at the root."""
    order = Window.partitionBy("doc_id").orderBy("page", "reading_order")
    rows = spans.where("heading_level > 0").withColumn("pos", F.row_number().over(order))
    level = F.col("heading_level")
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("h1", F.last(F.when(level == 1, F.col("pos")), True).over(run)).withColumn("h2", F.last(F.when(level == 2, F.col("pos")), True).over(run))
    parent = F.when(level == 2, F.col("h1")).when(level == 3, F.when(F.col("h2") > F.coalesce("h1", F.lit(0)), F.col("h2")).otherwise(F.col("h1")))
    return rows.select("doc_id", "page", "pos", "heading_level", "text", parent.alias("parent_pos"))


def totals(spans: DataFrame, cols: DataFrame) -> DataFrame:
    per = spans.groupBy("doc_id").agg(F.count_distinct("page").alias("total_pages"), F.count_if(F.col("heading_level") > 0).alias("total_headings"))
    return per.join(overall(cols), "doc_id")


def code_blocks(spans: DataFrame, least: int = 10) -> DataFrame:
    """Blocks (doc_id, page, block) with a span in a code font: their spans as lines, if long enough."""
    got = F.array_sort(F.collect_list(F.struct("span_idx", "text")))
    code = F.array_join(F.transform("spans", lambda s: s["text"]), "\n")
    per = spans.groupBy(*PAGE, "block").agg(F.bool_or(F.col("font_name").rlike("Mono|Courier|Code")).alias("is_code"), got.alias("spans"))
    return per.where("is_code").select(*PAGE, "block", code.alias("code"), F.size("spans").cast("long").alias("line_count")).where(F.length("code") >= least)


def table_markdown() -> Column:
    """A table's Markdown from columns caption, context, headers, rows, page_start, page_end; '' if it has nothing."""
    none = F.array().cast("array<string>")
    headers, rows = F.coalesce("headers", none), F.coalesce("rows", F.array().cast("array<array<string>>"))
    made = F.when(F.size(F.get(rows, F.lit(0))) > 0, F.transform(F.sequence(F.lit(1), F.size(F.get(rows, F.lit(0)))), lambda i: F.concat(F.lit("Column "), i.cast("string")))).otherwise(none)
    head = F.when(F.size(headers) > 0, headers).otherwise(made)

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: strip(F.coalesce(x, F.lit("")))), " | "), F.lit(" |"))

    body = F.transform(rows, lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.size(head) - F.size(r)))), 1, F.size(head))))
    source = F.when(F.col("page_start") == F.col("page_end"), F.format_string("<!-- Source: Page %d -->", "page_start")).otherwise(F.format_string("<!-- Source: Pages %d-%d -->", "page_start", "page_end"))
    top = F.array(F.when(F.length("caption") > 0, F.concat(F.lit("### "), "caption")), F.when(F.length("context") > 0, F.concat(F.lit("*"), "context", F.lit("*"))), line(head), line(F.transform(head, lambda _: F.lit("---"))))
    lines = F.concat(F.array_compact(top), body, F.array(source))
    return F.when((F.size(headers) == 0) & (F.size(rows) == 0), "").otherwise(F.array_join(lines, "\n"))


def formula_markdown(latex: Column) -> Column:
    """Inline, or display if long or of several lines; null for nothing."""
    x = strip(F.coalesce(latex, F.lit("")))
    block = (F.length(x) > 50) | F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\\begin"))
    return F.when(x == "", F.lit(None)).when(block, F.concat(F.lit("$$\n"), x, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), x, F.lit("$")))


def code_markdown(code: Column, language: Column, page: Column) -> Column:
    x, lang = strip(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(language, F.lit("")))
    fence = reduce(lambda c, kv: F.when(lang == kv[0], kv[1]).otherwise(c), FENCES.items(), lang)
    return F.when(x == "", "").otherwise(F.concat(F.lit("```"), fence, F.lit("\n"), x, F.lit("\n```\n<!-- Code from page "), page.cast("string"), F.lit(", detected as: "), lang, F.lit(" -->")))


def image_markdown() -> Column:
    """From columns page, image_index, width, height, format."""
    return F.format_string("![Image %d from page %d (%dx%d)](image_p%d_%d.%s)", "image_index", "page", "width", "height", "page", "image_index", F.coalesce("format", F.lit("png")))


def pages_markdown(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Pages with their text, then contents (doc_id, page, rank, ordinal, markdown) in order, joined by blank lines."""
    text = pages.select(*PAGE, F.lit(0).alias("rank"), F.lit(0).alias("ordinal"), strip(F.coalesce("text", F.lit(""))).alias("markdown")).where("markdown <> ''")
    every = text.unionByName(contents.select(*PAGE, "rank", "ordinal", "markdown"))
    got = F.array_sort(F.collect_list(F.struct("rank", "ordinal", "markdown")))
    per = every.groupBy(*PAGE).agg(F.array_join(F.transform(got, lambda x: x["markdown"]), "\n\n").alias("markdown"))
    return pages.select(*PAGE).join(per, list(PAGE), "left").fillna("", ["markdown"])


def span_markdown() -> Column:
    """A span's Markdown by heading level and weight."""
    level = F.col("heading_level")
    return F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "text")).when(F.col("bold"), F.concat(F.lit("**"), "text", F.lit("**"))).otherwise(F.col("text"))


def layout_markdown(spans: DataFrame, contents: DataFrame) -> DataFrame:
    """Pages in reading order with what isn't text after it, from top: contents have (doc_id, page, y0, ordinal, markdown)."""
    text = spans.select(*PAGE, F.col("reading_order").alias("place"), "y0", F.lit(0).alias("ordinal"), span_markdown().alias("markdown"))
    every = text.unionByName(contents.select(*PAGE, F.lit(LAST).alias("place"), "y0", "ordinal", "markdown"))
    got = F.array_sort(F.collect_list(F.struct("place", "y0", "ordinal", "markdown")))
    return every.groupBy(*PAGE).agg(F.array_join(F.transform(got, lambda x: x["markdown"]), "\n\n").alias("markdown"))


def outside_tables(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Spans that don't stand where a table of the page does: top and bottom both within 5 of the table's."""
    t = tables.select(F.col("doc_id").alias("td"), F.col("page").alias("tp"), F.round("top", 1).alias("top"), F.round("bottom", 1).alias("bottom"))
    same = (F.col("doc_id") == F.col("td")) & (F.col("page") == F.col("tp"))
    return spans.join(t, same & (F.abs(F.round("y0", 1) - F.col("top")) < 5) & (F.abs(F.round("y1", 1) - F.col("bottom")) < 5), "left_anti")


def converted(pages: DataFrame, title: Column, mode: str, summary: DataFrame | None = None) -> DataFrame:
    """One Markdown text for each document from its pages' Markdown: title, mode, pages and, with a summary, its totals."""
    got = F.array_sort(F.collect_list(F.struct("page", "markdown")))
    docs = pages.groupBy("doc_id").agg(F.transform(got, lambda x: x["markdown"]).alias("parts"))
    head = F.array(F.concat(F.lit("# "), title), F.lit(f"<!-- Extraction mode: {mode} -->"))
    parts = F.concat(head, F.col("parts"))
    if summary is not None:
        docs = docs.join(summary, "doc_id", "left")
        totals = F.format_string("---\n\n## Document Metadata\n\n- **Total Pages**: %d\n- **Tables**: %d\n- **Formulas**: %d", "total_pages", "total_tables", "total_formulas")
        parts = F.when(F.col("total_pages").isNull(), parts).otherwise(F.concat(parts, F.array(totals)))
    return docs.select("doc_id", F.array_join(parts, "\n\n").alias("markdown"))


def parsed_pages(docs: DataFrame, markdown: str) -> DataFrame:
    """Pages of Markdown with `## Page N` lines; what stands before the first is left out."""
    rows = F.posexplode(F.split(F.col(markdown), "\n", -1)).alias("line_no", "line")
    lines = docs.select("doc_id", rows).withColumn("mark", F.regexp_extract("line", r"^## Page (\d+)$", 1))
    part = F.count(F.nullif("mark", F.lit(""))).over(Window.partitionBy("doc_id").orderBy("line_no"))
    got = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    per = lines.withColumn("part", part).where("part > 0").groupBy("doc_id", "part").agg(F.max(F.when(F.col("mark") != "", F.col("mark").cast("int"))).alias("page"), got.alias("got"))
    return per.select("doc_id", "page", strip(F.array_join(F.transform(F.slice("got", 2, F.greatest(F.lit(1), F.size("got"))), lambda x: x["line"]), "\n")).alias("text"))


def page_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Text of each range (doc_id, range_id, page_start, page_end), ends included, from the pages it has."""
    j = ranges.join(pages, "doc_id").where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    got = F.array_sort(F.collect_list(F.struct("page", "text")))
    return j.groupBy("doc_id", "range_id").agg(F.array_join(F.transform(got, lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("n_pages"))
