"""Sections and chapters: headings, tables of contents, splitting and cutting texts, chapter responses, sources."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import matching
from studylake.functions.text import lines, missing, strip

#: White space, word edges and digits are those of the rules' origin: Unicode blanks, ASCII words.
BLANK, EDGE_BEFORE, EDGE_AFTER = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]", "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Heading patterns of a line; what a street ends with (a whole word); patterns of no headings; a chapter's heading.
HEADINGS = (r"(?i)^Chapter\s+\d+[\.:]\s*.+$", r"^\d+\.\d+\s+[A-Z][^\.]+$", r"(?i)^Section\s+\d+[\.:]\s*.+$", r"^[A-Z][A-Z\s]{8,50}[A-Z]$", r"^\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){2,6}$")
STREETS = r"St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd|Boulevard|Pl|Place|Way|Court|Ct"
NOT_HEADINGS = (r"^[A-Z]+$", r"^\d+\s+\d+", r"^\d{1,2}[-\/]\d{1,2}[-\/]\d{2,4}$", r"(?i)^(Page|Figure|Table|Appendix|Index|References|Bibliography|Glossary)\s+\d+$")
CHAPTER = r"(?i)Chapter[_\s]*(\d+):\s*(.+)"
#: Lines that stand for what a sample leaves out.
MIDDLE, LATER = "\n\n[... middle section ...]\n\n", "\n\n[... later section ...]\n\n"
CHARS_A_PAGE, LINES_A_PAGE, RADIUS = 2000, 50, 500


def fits(c: Column, pattern: str) -> Column:
    """Whether a pattern is found, with \\s as any Unicode blank."""
    return c.rlike(pattern.replace(r"\s", BLANK))


def valid_heading(c: Column) -> Column:
    """Whether a text may be a section's title: long enough, no code, address, date or label."""
    bad = (F.length(c) < 8) | (c.rlike(r"\d+") & c.rlike(f"(?i){EDGE_BEFORE}({STREETS}){EDGE_AFTER}"))
    for p in NOT_HEADINGS:
        bad = bad | fits(c, p)
    return ~bad


def headings(docs: DataFrame, text: str) -> DataFrame:
    """Heading lines with their number from 0 and page estimate."""
    rows = lines(docs, text, "doc_id").withColumn("text", strip(F.col("line"))).where(F.length("text").between(8, 200))
    shaped = F.lit(False)
    for p in HEADINGS:
        shaped = shaped | fits(F.col("text"), p)
    return rows.where(shaped & valid_heading(F.col("text"))).select("doc_id", F.col("line_no").alias("line"), "text", (F.floor(F.col("line_no") / LINES_A_PAGE) + 1).cast("int").alias("estimated_page"))


def table_of_contents(found: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """Headings as sections, of documents with a fit number of them; a section ends before the next one's page."""
    per, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("line")
    rows = found.withColumn("n", F.count("*").over(per)).where(F.col("n").between(least, most))
    end = F.nullif(F.lead("estimated_page").over(order) - 1, F.lit(0))
    return rows.select("doc_id", F.row_number().over(order).alias("section_number"), F.col("text").alias("name"), F.col("estimated_page").alias("page_start"), end.alias("page_end"))


def page_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / CHARS_A_PAGE).cast("int")


def section_count(text: Column) -> Column:
    """Sections to aim at for a text's length: struct of min, max, target."""
    p = page_estimate(text)
    three = lambda a, b, c: F.struct(F.lit(a).alias("min"), F.lit(b).alias("max"), F.lit(c).alias("target"))
    return F.when(p <= 10, three(2, 4, 3)).when(p <= 30, three(4, 8, 6)).otherwise(three(6, 12, 8))


def sampled(text: Column, most: int = 100_000, part: int = 30_000) -> Column:
    """A long text's beginning, middle and end with lines that say so."""
    n = F.length(text)
    middle = F.floor((n - part) / 2).cast("int")
    cut = F.concat(F.substring(text, 1, part), F.lit(MIDDLE), F.substr(text, middle + 1, F.lit(part)), F.lit(LATER), F.substr(text, n - part + 1, F.lit(part)))
    return F.when(n > most, cut).otherwise(text)


def fallback_sections(docs: DataFrame, text: str, title: Column) -> DataFrame:
    """Three to eight equal parts of each text with page ranges."""
    p = page_estimate(F.col(text))
    n = F.least(F.greatest(F.lit(3), F.ceil(p / 10).cast("int")), F.lit(8))
    rows = docs.select("doc_id", title.alias("title"), p.alias("p"), n.alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    start, end = (F.floor(F.col("i") * F.col("p") / F.col("n")) + 1).cast("int"), F.floor((F.col("i") + 1) * F.col("p") / F.col("n")).cast("int")
    return rows.select("doc_id", (F.col("i") + 1).alias("section_number"), F.concat("title", F.lit(" - Part "), (F.col("i") + 1).cast("string")).alias("name"), F.format_string("Study material from pages %d to %d", start, end).alias("description"), start.alias("page_start"), end.alias("page_end"))


def validated(proposed: DataFrame, most: int = 15) -> DataFrame:
    """Proposed sections (doc_id, position, name): of over 20 the first 15, unfit names gone, numbered anew; documents with
    fewer than two left have none."""
    per = Window.partitionBy("doc_id")
    order = per.orderBy("position")
    rows = proposed.withColumn("n", F.count("*").over(per)).withColumn("i", F.row_number().over(order)).where((F.col("n") <= 20) | (F.col("i") <= most))
    rows = rows.where((F.length(strip(F.col("name"))) >= 10) & valid_heading(F.col("name"))).withColumn("left", F.count("*").over(per)).where("left >= 2")
    return rows.select("doc_id", F.row_number().over(order).alias("section_number"), "name")


def smart_boundary(text: Column, position: Column, forward: bool = True) -> Column:
    """Where to cut a text near a position: at the nearest blank line, else sentence end, else line end within the radius, else
    there; of two as near the earlier. A position outside the text gives its end, or its beginning if not forward."""
    n, first = F.length(text), F.greatest(F.lit(0), position - RADIUS)
    region, at = F.substr(text, first + 1, F.least(n, position + RADIUS) - first), position - first

    def nearest(pattern: str, place) -> Column:
        # The region up to and with each find, one after the other: their lengths give the places.
        parts = F.regexp_extract_all(region, F.lit(f"(?s).*?{pattern}".replace(r"\s", BLANK)), F.lit(0))
        none = F.struct(F.lit(0).alias("seen"), F.lit(None).cast("int").alias("best"))

        def step(s: Column, part: Column) -> Column:
            x = (s["seen"] + place(part)).cast("int")
            best = F.when(s["best"].isNull() | (F.abs(x - at) < F.abs(s["best"] - at)), x).otherwise(s["best"])
            return F.struct((s["seen"] + F.length(part)).alias("seen"), best.alias("best"))

        return F.aggregate(parts, none, step, lambda s: s["best"])

    paragraph = nearest(r"\n\n+", lambda part: F.length(F.rtrim(part, F.lit("\n"))))
    sentence = nearest(r"[.!?]\s", lambda part: F.length(part) - 1)
    line = nearest(r"\n", lambda part: F.length(part) - 1)
    inside = F.coalesce(first + F.coalesce(paragraph, sentence, line), position)
    return F.when((position < 0) | (position >= n), n if forward else F.lit(0)).otherwise(inside).cast("int")


def _of_document(docs: DataFrame, sections: DataFrame, text: str, more: list[str], columns: list[str], solve, out: str) -> DataFrame:
    """solve(text, further values, sections) for each document in one row with its sections by number; its results, a tuple for
    each section, with doc_id, section_number and name. A document's text is read once and only parts leave its row."""
    names = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_number", *columns))).alias("s"))
    rows = docs.join(names, "doc_id").select("doc_id", text, *more, "s")
    kinds = dict(rows.dtypes)
    number = dict(sections.dtypes)["section_number"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = list(solve(r[text] or "", [r[c] for c in more], r["s"]))
                cells = [(r["doc_id"], x["section_number"], x["name"], *y) for x, y in zip(r["s"], found, strict=True)]
                kind = b.schema.field("s").type.value_type
                types = [b.schema.field("doc_id").type, kind.field("section_number").type, pa.string(), *[None] * (len(cells[0]) - 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)], ["doc_id", "section_number", "name", *[x.split()[0] for x in out.split(", ")]])

    return rows.mapInArrow(each, f"doc_id {kinds['doc_id']}, section_number {number}, name string, {out}")


def split_by_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Each section's part of its document's Markdown: from its heading, bold name or name in its share of the text to the
    next one's; else to a smart boundary. All names are looked up by one scan of the text (functions.matching)."""

    def parts(text: str, _, own: list[dict]) -> Iterator[tuple[str]]:
        return ((text[a:e],) for a, e in matching.section_spans(text, [x["name"] for x in own]))

    found = _of_document(docs, sections, "markdown", [], ["name"], parts, "markdown_text string")
    return found.withColumn("markdown_text", strip(F.col("markdown_text")))


def section_texts(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Text and strategy of each section (doc_id, section_number, name, page_start, page_end): by page markers, by
    characters a page, by name, by equal parts. docs has text and, where known, pages. Markers and all names are looked up by
    one scan of the text."""

    def parts(text: str, more: list, own: list[dict]) -> Iterator[tuple[str, str]]:
        n, spots, at = len(text), matching.Spots(text, [x["name"] for x in own]), {}
        for m in re.finditer(r"^## Page ([0-9]+)$", text, re.MULTILINE):
            at.setdefault(int(m[1]), m.start())
        total = more[0] or -(-n // CHARS_A_PAGE)
        for i, x in enumerate(own):
            a, e = x["page_start"] or 0, x["page_end"] or 0
            marked = counted = named = None
            if a > 0 and e > 0:
                if total > 0:
                    low, high = max(0, (a - 1) * (n // total)), min(n, e * (n // total))
                    counted = text[min(low, high) : max(low, high)]
                if a in at:
                    marked = text[at[a] : max(at[a], at.get(e, n))]
            first = spots.first(x["name"])
            if first is not None:
                named = text[first : spots.first(own[i + 1]["name"], first + 1) if i + 1 < len(own) else None]
            how = "page_markers" if marked else "page_range_calc" if counted else "name_search" if first is not None else "proportional_chunking"
            size = n // len(own)
            yield how, marked or counted or named or text[i * size : i * size + size]

    return _of_document(docs, sections, "text", ["pages"], ["name", "page_start", "page_end"], parts, "strategy string, extracted string")


def quality(own: Column, ratio: Column, others: Column) -> Column:
    """Score 0 to 1 of an extracted text: own name in it, share of the whole text, number of other sections' names in it."""
    size = F.when((ratio > 0.05) & (ratio < 0.5), 0.3).when(ratio >= 0.5, -0.2).otherwise(0.0)
    other = F.when(others == 0, 0.4).when(others == 1, 0.2).otherwise(-0.2)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(own, 0.3).otherwise(0.0) + size + other)), 6)


def scored(extracted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, section_number, name, quality) of extracted texts (doc_id, section_number, name, extracted); sizes has doc_id
    and size, the length of the whole text. Each text is scanned once for all names of its document."""

    def parts(_, __, own: list[dict]) -> Iterator[tuple[bool, int, int]]:
        times, names = Counter(x["name"].lower() for x in own if x["name"] is not None), Counter(x["name"] for x in own)
        scan = matching.automaton(times)
        for x in own:
            text, name = x["extracted"] or "", x["name"]
            found = matching.contained(text.lower(), scan) | ({""} & times.keys())
            has = name is not None and name.lower() in found
            yield has, len(text), sum(times[f] for f in found) - (names[name] if has else 0)

    found = _of_document(sizes.select("doc_id", F.lit("").alias("text"), "size"), extracted, "text", ["size"], ["name", "extracted"], parts, "own boolean, length long, others long")
    return found.join(sizes.select("doc_id", "size"), "doc_id").select("doc_id", "section_number", "name", quality(F.col("own"), F.col("length") / F.col("size"), F.col("others")).alias("quality"))


def extract_sections(docs: DataFrame, proposed: DataFrame) -> DataFrame:
    """Sections of each document (doc_id, title, text): its table of contents if it has 6 to 15, else the proposed ones if
    valid, else equal parts; with the origin."""
    toc = table_of_contents(headings(docs, "text"), 6, 15).select("doc_id", "section_number", "name", F.lit("contents").alias("origin"))
    offered = validated(proposed).join(toc.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "section_number", "name", F.lit("proposed").alias("origin"))
    have = toc.select("doc_id").union(offered.select("doc_id")).distinct()
    rest = fallback_sections(docs.join(have, "doc_id", "left_anti"), "text", F.col("title"))
    return toc.unionByName(offered).unionByName(rest.select("doc_id", "section_number", "name", F.lit("fallback").alias("origin")))


def markdown_sections(docs: DataFrame, markdown: str) -> DataFrame:
    """Title and `## ` sections of Markdown with description (first paragraph, cut) and text; documents without a section
    give no row."""
    rows = lines(docs, markdown, "doc_id").withColumn("t", strip(F.col("line")))
    per = Window.partitionBy("doc_id")
    is_title, is_section = F.col("t").startswith("# "), F.col("t").startswith("## ")
    rows = rows.withColumn("title_at", F.coalesce(F.min(F.when(is_title, F.col("line_no"))).over(per), F.lit(-1))).withColumn("title", F.min(F.when(is_title & (F.col("line_no") == F.col("title_at")), F.col("t"))).over(per))
    head = is_section & (F.col("line_no") > F.col("title_at"))
    rows = rows.withColumn("head", head).withColumn("section_number", F.count_if(head).over(per.orderBy("line_no"))).where("section_number > 0")
    got = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line"))))
    body = rows.groupBy("doc_id", "section_number").agg(F.first("title").alias("title"), F.max(F.when(F.col("head"), strip(F.substr("t", F.lit(4))))).alias("name"), got.alias("got"))
    content = strip(F.array_join(F.transform("got", lambda x: x["line"]), "\n"))
    body = body.withColumn("content", content).withColumn("p", F.coalesce(missing(F.split_part("content", F.lit("\n\n"), F.lit(1))), F.col("content")))
    description = F.when(F.length("p") > 200, F.concat(F.substring("p", 1, 197), F.lit("..."))).when(F.col("p") != "", F.col("p")).otherwise(F.concat(F.lit("Section covering "), "name"))
    return body.select("doc_id", F.coalesce(strip(F.substr("title", F.lit(3))), F.lit("Untitled Document")).alias("title"), F.col("section_number").cast("int").alias("section_number"), "name", description.alias("description"), F.col("content").alias("markdown_text"))


def chapter_of(docs: DataFrame, markdown: str) -> DataFrame:
    """Number, title and text of the chapter whose heading comes first in a document; others give no row."""
    parts = F.split(F.col(markdown), "\n", -1)
    heads = F.transform(parts, lambda x: F.when(strip(x).startswith("# "), F.nullif(F.regexp_extract(strip(F.substr(strip(x), F.lit(3))), CHAPTER, 1), F.lit(""))))
    at = F.array_position(F.transform(heads, lambda x: x.isNotNull()), True).cast("int")
    rows = docs.select("doc_id", parts.alias("parts"), at.alias("at")).where("at > 0")
    head = strip(F.get("parts", F.col("at") - 1))
    body = F.when(F.col("at") < F.size("parts"), F.slice("parts", F.col("at") + 1, F.size("parts"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.regexp_extract(head, CHAPTER, 1).cast("int").alias("chapter_number"), strip(F.regexp_extract(head, CHAPTER, 2)).alias("chapter_title"), strip(F.array_join(body, "\n")).alias("markdown"))


def chapter_rows(docs: DataFrame, text: str) -> DataFrame:
    """Lines `number|title|start|end` of a response as chapters."""
    rows = lines(docs, text, "doc_id").withColumn("f", F.transform(F.split("line", r"\|", -1), strip)).where((strip(F.col("line")) != "") & (F.size("f") == 4))
    number = lambda i: F.regexp_extract(F.get("f", F.lit(i)), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return rows.select("doc_id", "line_no", number(0).alias("number"), F.get("f", F.lit(1)).alias("title"), number(2).alias("page_start"), number(3).alias("page_end"))


def response_kind(text: Column) -> Column:
    """single (starts as a chapter, or one line of chapters), multi (lines of chapters) or error."""
    t = strip(F.coalesce(text, F.lit("")))
    n = F.size(F.filter(F.split(t, "\n"), lambda x: F.size(F.split(x, r"\|", -1)) == 4))
    return F.when(t.startswith("# Chapter"), "single").when(F.contains(t, F.lit("|")) & (n > 0), F.when(n == 1, "single").otherwise("multi")).otherwise("error")


def cut_chapters(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each chapter, ends included and clipped to the document's pages."""
    j = chapters.join(pages, "doc_id").where((F.col("page") >= F.greatest(F.lit(1), "page_start")) & (F.col("page") <= F.col("page_end")))
    got = F.array_sort(F.collect_list(F.struct("page", "text")))
    return j.groupBy("doc_id", "number").agg(F.count("*").alias("n_pages"), F.array_join(F.transform(got, lambda x: x["text"]), "\n\n").alias("text"))


def cached(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with text, sources that still need it)."""
    has = missing(F.col("markdown_content")).isNotNull()
    return sources.where(has), sources.where(~has)


def absent(requested: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Requests that weren't found."""
    return requested.select(*key).distinct().join(found.select(*key).distinct(), key, "left_anti")


def joined_sources(sources: DataFrame) -> DataFrame:
    """Texts of a chapter's sources as one, under `## Source i: title`."""
    order = Window.partitionBy("course_id", "chapter_number").orderBy("source_id", "document_id")
    rows = sources.withColumn("i", F.row_number().over(order))
    one = F.concat(F.lit("## Source "), F.col("i").cast("string"), F.lit(": "), "document_title", F.lit("\n"), "markdown_content")
    got = F.array_sort(F.collect_list(F.struct("i", one.alias("t"))))
    return rows.groupBy("course_id", "chapter_number").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(got, lambda x: x["t"]), "\n\n---\n\n").alias("markdown"))


def source_similarity(sources: DataFrame, text: str, group: list[str], key: str, least: float = 0.1) -> DataFrame:
    """Pairs of sources of one group that share a distinct paragraph, with the Jaccard similarity of their paragraphs and
    whether they are in conflict (below least). Repeated paragraphs of a source count once. Sources meet through the
    paragraphs that they share, so no pair without one is made; all pairs of a group that share one are the result, so a
    group is to be a chapter's sources, not a corpus."""
    parts = sources.select(*group, key, F.explode(F.split(text, "\n")).alias("p")).select(*group, key, strip(F.col("p")).alias("p")).where("p <> ''").distinct()
    sizes = parts.groupBy(*group, key).agg(F.count("*").alias("n"))
    a, b = parts.withColumnRenamed(key, "a"), parts.withColumnRenamed(key, "b")
    both = a.join(b, [*group, "p"]).where("a < b").groupBy(*group, "a", "b").agg(F.count("*").alias("shared"))
    j = both.join(sizes.select(*group, F.col(key).alias("a"), F.col("n").alias("na")), [*group, "a"]).join(sizes.select(*group, F.col(key).alias("b"), F.col("n").alias("nb")), [*group, "b"])
    share = F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6)
    return j.select(*group, "a", "b", "shared", share.alias("similarity"), (share < least).alias("conflict_detected"))


def source_classes(sources: DataFrame, text: str, group: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): sources of a group with equal sets of paragraphs are one class, named by its smallest key. members
    has a row (group, key, of) for each source, classes one (group, of, n, p) for each class with its n paragraphs' hashes, in
    order. Sources without a paragraph are in no class."""
    cut = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), strip)
    marks = F.sort_array(F.array_distinct(F.transform(F.filter(cut, lambda p: p != ""), lambda p: F.xxhash64(p))))
    sets = sources.select(*group, key, marks.alias("p")).where(F.size("p") > 0)
    classes = sets.groupBy(*group, "p").agg(F.min(key).alias("of")).withColumn("n", F.size("p"))
    named = [F.col(c).alias(f"__{c}") for c in group]
    heads = classes.select(*named, F.xxhash64("p").alias("mark"), F.col("p").alias("__p"), "of")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]
    members = sets.withColumn("own", F.xxhash64("p")).join(heads, [*same, F.col("own") == F.col("mark"), F.col("p") == F.col("__p")]).select(*group, key, "of")
    return members, classes.select(*group, "of", "n", "p")


def agreeing_classes(classes: DataFrame, group: list[str], least: float = 0.1) -> DataFrame:
    """Pairs (group, a, b, shared, similarity) of classes of one group whose paragraphs have a Jaccard similarity of least or
    more; all others are in conflict, and none of them is made.

    A class is listed under its rarest paragraphs only, n less the ceiling of least * n and one more, which two classes that
    agree enough cannot both lack. So a paragraph of very many sources is listed for those alone that have few others. The
    candidates' sets are then compared whole.
    """
    each = classes.select(*group, "of", "n", F.explode("p").alias("mark"))
    often = each.groupBy(*group, "mark").agg(F.count("*").alias("holders"))
    kept = Window.partitionBy(*group, "of").orderBy("holders", "mark")
    listed = each.join(often, [*group, "mark"]).withColumn("place", F.row_number().over(kept)).where(F.col("place") <= F.col("n") - F.ceil(least * F.col("n")) + 1).where("holders > 1")
    a, b = (listed.select(*group, "mark", F.col("of").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    near = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    pairs = a.join(b, [*group, "mark"]).where((F.col("a") < F.col("b")) & near).select(*group, "a", "b").distinct()
    held = lambda x: classes.select(*group, F.col("of").alias(x), F.col("p").alias(f"p{x}"))
    both = pairs.join(held("a"), [*group, "a"]).join(held("b"), [*group, "b"]).withColumn("shared", F.size(F.array_intersect("pa", "pb")).cast("long"))
    share = F.col("shared") / (F.size("pa") + F.size("pb") - F.col("shared"))
    return both.withColumn("similarity", F.round(share, 6)).where(share >= least).select(*group, "a", "b", "shared", "similarity")
