"""Corpus cleaning: noise, formula symbols, table stitching, captions and context, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.text import strip

#: Noise patterns with what replaces them, in order, for multi-line, case-insensitive matching.
NOISE = (
    (r"第\s*\d+\s*页", ""), (r"Page\s+\d+", ""), (r"^\s*\d+\s*$", ""), (r"\d+\s*/\s*\d+", ""), (r"- \d+ -", ""),
    (r"---+\n+", "\n"), (r"===+\n+", "\n"), (r"___+\n+", "\n"),
    (r"^\s*Copyright.*?$", ""), (r"^\s*©.*?$", ""), (r"^\s*All rights reserved.*?$", ""), (r"^\s*Confidential.*?$", ""), (r"^\s*Proprietary.*?$", ""), (r"^\s*Draft.*?$", ""),
    (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "),
)

#: Symbols of formulas and their LaTeX.
SYMBOLS = (
    ("α", r"\alpha"), ("β", r"\beta"), ("γ", r"\gamma"), ("δ", r"\delta"), ("Δ", r"\Delta"), ("ε", r"\epsilon"), ("θ", r"\theta"), ("λ", r"\lambda"), ("μ", r"\mu"), ("π", r"\pi"),
    ("σ", r"\sigma"), ("Σ", r"\Sigma"), ("φ", r"\phi"), ("ω", r"\omega"), ("Ω", r"\Omega"), ("≤", r"\leq"), ("≥", r"\geq"), ("≠", r"\neq"), ("≈", r"\approx"), ("∞", r"\infty"),
    ("√", r"\sqrt"), ("∑", r"\sum"), ("∫", r"\int"), ("∂", r"\partial"), ("∇", r"\nabla"), ("×", r"\times"), ("÷", r"\div"), ("±", r"\pm"), ("∈", r"\in"), ("⊂", r"\subset"), ("∪", r"\cup"), ("∩", r"\cap"),
)

#: Caption patterns, the first that fits wins.
CAPTIONS = (r"(Table\s+\d+[:\.].*?)(?:\n|$)", r"(表\s*\d+[：:.].*?)(?:\n|$)", r"(Figure\s+\d+[:\.].*?)(?:\n|$)", r"(Fig\.\s*\d+[:\.].*?)(?:\n|$)")

MATERIALS = ("textbook", "lecture", "tutorial", "exam")
SESSION_TYPES = ("lesson", "practice", "review", "flashcards")
#: Cost estimate of an extraction: tokens a page, dollars a token.
TOKENS_A_PAGE, DOLLARS_A_TOKEN = 1500, 0.000002625


def remove_noise(text: Column) -> Column:
    """A page's text without page numbers, rules and notices; null becomes ''."""
    return strip(reduce(lambda c, p: F.regexp_replace(c, "(?dmiuU)" + p[0], p[1]), NOISE, F.coalesce(text, F.lit(""))))


def clean_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """Pages with clean text and lengths before and after; those under least characters go."""
    # As the only element of an exploded array the clean text is worked out once, not again for each use of it.
    rows = pages.withColumn("clean", F.explode(F.array(remove_noise(F.col("text"))))).where(F.length("clean") >= least)
    before, after = F.length(F.coalesce("text", F.lit(""))), F.length("clean")
    return rows.select("doc_id", "page", F.col("clean").alias("text"), before.alias("original_length"), after.alias("cleaned_length"), (before - after).alias("noise_removed"))


def correct_symbols(formulas: DataFrame) -> DataFrame:
    """Formulas with LaTeX for symbols; all count as corrected."""
    latex = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), SYMBOLS, F.col("latex"))
    return formulas.withColumns({"latex": latex, "corrected": F.lit(True)})


def sanitized(c: Column) -> Column:
    """Without control characters but tab and line ends; null becomes ''."""
    return F.coalesce(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit(""))


def snippet(c: Column, most: int = 600) -> Column:
    """White space as single blanks, cut at most characters with an ellipsis."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != ""), 1, n), " ")


def split_pages(docs: DataFrame, text: str, count: Column) -> DataFrame:
    """A text's parts at form feeds or blank lines as pages 1 to count; missing parts are ''."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\f|\n{2,}"), strip), lambda x: x != "")
    rows = docs.select("doc_id", parts.alias("parts"), count.alias("n")).where("n > 0")
    return rows.select("doc_id", "parts", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page")).select("doc_id", "page", F.coalesce(F.get("parts", F.col("page") - 1), F.lit("")).alias("text"))


def validity(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all rules, rows that don't with the names of the rules broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    rows = df.withColumn("broken", broken)
    return rows.where(F.size("broken") == 0).drop("broken"), rows.where(F.size("broken") > 0)


def is_uuid(c: Column) -> Column:
    return c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """The value in lower case if it is one of those allowed, else null."""
    low = F.lower(strip(c))
    return F.when(low.isin(*values), low)


def extraction_summary(pages: DataFrame, tables: DataFrame, formulas: DataFrame) -> DataFrame:
    """Totals of each document over its content frames."""
    frames = [df.groupBy("doc_id").agg(F.count("*").alias(name)) for df, name in ((pages, "total_pages"), (tables, "total_tables"), (formulas, "total_formulas"))]
    j = reduce(lambda a, b: a.join(b, "doc_id", "full"), frames)
    return j.fillna(0).withColumn("postprocessed", F.lit(True))


def noise_report(pages: DataFrame, cleaned: DataFrame) -> DataFrame:
    """By document: characters removed, share, pages removed, pages with marks of noise."""
    has = lambda *x: F.count_if(reduce(lambda a, b: a | b, [F.contains("text", F.lit(y)) for y in x]))
    raw = pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("raw_chars"), F.count("*").alias("pages"), has("Page ", "页").alias("page_numbers"), has("Copyright", "©").alias("copyright_notices"), has("---", "===").alias("separators"))
    done = cleaned.groupBy("doc_id").agg(F.sum("cleaned_length").alias("clean_chars"), F.count("*").alias("clean_pages"))
    j = raw.join(done, "doc_id", "left").fillna(0)
    gone = F.col("raw_chars") - F.col("clean_chars")
    return j.select("doc_id", "raw_chars", "clean_chars", gone.alias("removed_chars"), F.when(F.col("raw_chars") > 0, F.round(100.0 * gone / F.col("raw_chars"), 2)).otherwise(0.0).alias("removed_percent"), (F.col("pages") - F.col("clean_pages")).alias("pages_removed"), "page_numbers", "copyright_notices", "separators")


def should_merge(page_end: Column, columns: Column, headers: Column, page_b: Column, columns_b: Column, headers_b: Column) -> Column:
    """Whether a table goes on in another: on the next page, as many columns, and blank or mostly equal headers."""
    low = lambda h: F.transform(F.coalesce(h, F.array().cast("array<string>")), lambda x: F.lower(strip(x)))
    a, b = low(headers), low(headers_b)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    alike = (F.size(a) == F.size(b)) & (same > 0.7 * F.size(a))
    return (page_b == page_end + 1) & (columns == columns_b) & (F.forall(b, lambda x: x == "") | alike)


def merge_tables(tables: DataFrame) -> DataFrame:
    """Tables that go on across pages as one, with page_start, page_end and merged.

    What follows is compared with the first table of a run, which no fixed offset can name: a fold over tables in page
    order, within the JVM. No table goes on in one that is not on the next page, so a document is first split there, and
    only tables on pages in a row meet in one fold.
    """
    fields = ("page", "table_index", "headers", "rows", "row_count", "col_count")
    order = Window.partitionBy("doc_id").orderBy("page", "table_index")
    apart = F.coalesce(F.col("page") != F.lag("page").over(order) + 1, F.lit(True)).cast("int")
    split = tables.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order))
    listed = split.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tables"))

    def opened(t: Column) -> Column:
        return F.struct(*[t[f].alias(f) for f in fields], t["page"].alias("page_start"), t["page"].alias("page_end"), F.lit(False).alias("merged"))

    def longer(run: Column, t: Column) -> Column:
        new = {"rows": F.concat(run["rows"], t["rows"]), "row_count": run["row_count"] + t["row_count"]}
        return F.struct(*[new.get(f, run[f]).alias(f) for f in fields], run["page_start"].alias("page_start"), t["page"].alias("page_end"), F.lit(True).alias("merged"))

    def step(runs: Column, t: Column) -> Column:
        run = F.element_at(runs, -1)
        joins = should_merge(run["page_end"], run["col_count"], run["headers"], t["page"], t["col_count"], t["headers"])
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer(run, t)))).otherwise(F.concat(runs, F.array(opened(t))))

    rest = F.slice("tables", 2, F.greatest(F.lit(1), F.size("tables") - 1))
    rest = F.when(F.size("tables") > 1, rest).otherwise(F.slice("tables", 1, 0))
    runs = F.aggregate(rest, F.array(opened(F.element_at("tables", 1))), step)
    return listed.select("doc_id", F.explode(runs).alias("t")).select("doc_id", "t.*")


def caption(text: Column) -> Column:
    """The first caption in a page's text, null without one."""
    return F.coalesce(*[F.nullif(strip(F.regexp_extract(text, "(?iuU)" + p, 1)), F.lit("")) for p in CAPTIONS])


def context(text: Column) -> Column:
    """The last paragraph of over 20 characters that isn't a number, cut at 200."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: (F.length(x) > 20) & ~x.rlike(r"^\d+$"))
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(F.length(last) > 200, F.concat(F.substring(last, 1, 200), F.lit("..."))).otherwise(last)


def with_context(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables with caption (from their page or made up) and context."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "table_index"))
    j = tables.withColumn("number", number).join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"], "left")
    made = F.format_string("Table %d (Page %d)", "number", "page")
    return j.withColumns({"caption": F.coalesce(caption(F.col("page_text")), made), "context": context(F.col("page_text"))}).drop("page_text", "number")


def process(pages: DataFrame, tables: DataFrame, formulas: DataFrame) -> dict[str, DataFrame]:
    """The whole cleaning: pages, tables joined with context from the clean pages, formulas and the summary."""
    clean = clean_pages(pages)
    joined = with_context(merge_tables(tables), clean)
    fixed = correct_symbols(formulas)
    return {"pages": clean, "tables": joined, "formulas": fixed, "summary": extraction_summary(clean, joined, fixed)}


def table_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """By document: tables before and after joining, with captions of their own and with context, mean rows."""
    old = before.groupBy("doc_id").agg(F.count("*").alias("tables_before"))
    new = after.groupBy("doc_id").agg(F.count("*").alias("tables_after"), F.count_if("merged").alias("merged_tables"), F.count("context").alias("with_context"), F.round(F.avg("row_count"), 1).alias("avg_rows"))
    return old.join(new, "doc_id", "left").fillna(0)


def symbol_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: formulas, those changed, percentage to one place."""
    j = before.select("doc_id", "formula_index", F.col("latex").alias("old")).join(after.select("doc_id", "formula_index", "latex"), ["doc_id", "formula_index"])
    changed = F.count_if(F.col("old") != F.col("latex"))
    return j.agg(F.count("*").alias("formulas"), changed.alias("changed"), F.round(100.0 * changed / F.nullif(F.count("*"), F.lit(0)), 1).alias("changed_percent"))


def comparison(contents: DataFrame) -> DataFrame:
    """By method: rows of each content type as columns, and the cost of its pages."""
    kinds = ["pages", "tables", "formulas", "code_blocks", "images"]
    counts = contents.groupBy("method").pivot("content_type", kinds).count().fillna(0, kinds)
    return counts.withColumn("cost", F.round(F.col("pages") * TOKENS_A_PAGE * DOLLARS_A_TOKEN, 6))
