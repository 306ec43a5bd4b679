"""Lessons: Markdown lessons to concepts, formulas, examples, notes and questions; check-ins, context, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.text import lines, missing, strip
from studylake.operators.clean import snippet

#: Headers of a concept's parts.
PARTS = {"## Explanation": "explanation", "## Formulas": "formulas", "## Examples": "examples", "## Important Notes": "important_notes", "## Check Your Understanding": "mcqs"}
#: What stands for a missing topic or feedback.
UNTITLED, WELL_DONE, NOT_QUITE, EVALUATED = "Untitled Lesson", "Great job! You chose the correct answer.", "Not quite. Review the explanation and try again.", "Answer evaluated."
CONTEXT_CHARS = 8000
CHECK_IN = "struct<question:string,expected_answer:string,hint:string>"


def lesson_lines(lessons: DataFrame, markdown: str) -> DataFrame:
    """Lines of each lesson with the number of the concept that they belong to (0: topic and summary)."""
    rows = lines(lessons, markdown, "lesson_id").withColumn("t", strip(F.col("line")))
    per = Window.partitionBy("lesson_id")
    top = F.col("t").startswith("# ")
    rows = rows.withColumn("topic_at", F.coalesce(F.min(F.when(top, F.col("line_no"))).over(per), F.lit(-1)))
    head = top & (F.col("line_no") > F.col("topic_at"))
    return rows.withColumn("head", head).withColumn("concept", F.count_if(head).over(per.orderBy("line_no")))


def lesson_heads(rows: DataFrame) -> DataFrame:
    """Topic and summary of each lesson that has a concept; the summary counts only right after the topic."""
    rows = rows.where("concept = 0").withColumn("header", F.col("t").startswith("#") & (F.col("line_no") > F.col("topic_at")))
    nth = F.count_if("header").over(Window.partitionBy("lesson_id").orderBy("line_no"))
    rows = rows.withColumn("nth", nth)
    first = F.max(F.when(F.col("header") & (F.col("nth") == 1), F.col("t"))).over(Window.partitionBy("lesson_id"))
    rows = rows.withColumn("first", first)
    kept = F.when((F.col("first") == "## Summary") & (F.col("nth") == 1) & ~F.col("header"), F.struct("line_no", "line"))
    per = rows.groupBy("lesson_id").agg(F.max(F.when(F.col("line_no") == F.col("topic_at"), strip(F.substr("t", F.lit(3))))).alias("topic"), F.array_sort(F.collect_list(kept)).alias("got"))
    return per.select("lesson_id", F.coalesce("topic", F.lit(UNTITLED)).alias("topic"), strip(F.array_join(F.transform("got", lambda x: x["line"]), "\n")).alias("summary"))


def concept_parts(rows: DataFrame) -> DataFrame:
    """(lesson_id, concept, name, part, content) of each concept's parts; lines before the first header are dropped."""
    inner = rows.where("concept > 0")
    key = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])
    inner = inner.withColumn("opens", F.try_element_at(key, F.col("t")))
    order = Window.partitionBy("lesson_id", "concept").orderBy("line_no")
    inner = inner.withColumn("part", F.last("opens", True).over(order)).withColumn("nth", F.count("opens").over(order)).withColumn("name", F.first(F.when(F.col("head"), strip(F.substr(strip(F.col("line")), F.lit(3)))), True).over(order))
    body = inner.where(~F.col("head") & F.col("part").isNotNull() & F.col("opens").isNull())
    got = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    per = body.groupBy("lesson_id", "concept", "name", "part", "nth").agg(got.alias("got"))
    per = per.withColumn("content", strip(F.array_join(F.transform("got", lambda x: x["line"]), "\n")))
    return per.groupBy("lesson_id", "concept", "name", "part").agg(F.max_by("content", "nth").alias("content"))


def formula_list(content: Column) -> Column:
    """Formulas with variables from marked or plain bullet lines, folded line by line."""
    kind = "array<struct<formula:string,variables:string>>"
    rows = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x != "")

    def made(f: Column, v: Column) -> Column:
        return F.struct(f.alias("formula"), v.alias("variables"))

    def step(acc: Column, x: Column) -> Column:
        marked = x.rlike(r"(?i)^-?\s*\*\*Formula\*\*:")
        both = F.regexp_extract(x, r"\*\*Formula\*\*:\s*(.+?)(?:\s+\*\*Variables\*\*:\s*(.+))?$", 1), F.regexp_extract(x, r"\*\*Formula\*\*:\s*(.+?)(?:\s+\*\*Variables\*\*:\s*(.+))?$", 2)
        variables = x.rlike(r"(?i)^-?\s*\*\*Variables\*\*:") & (F.size(acc) > 0)
        given = strip(F.regexp_extract(x, r"\*\*Variables\*\*:\s*(.+)", 1))
        last = F.element_at(acc, -1)
        plain = x.startswith("-") & ~x.rlike(r"(?i)\*\*(Formula|Variables)\*\*:")
        return (
            F.when(marked & (both[0] != ""), F.concat(acc, F.array(made(strip(both[0]), strip(both[1])))))
            .when(variables & (given != ""), F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(made(last["formula"], given))))
            .when(plain, F.concat(acc, F.array(made(strip(F.substr(x, F.lit(2))), F.lit("")))))
            .otherwise(acc)
        )

    # element_at on an empty list is never reached, but must not fail when planned ahead.
    safe = F.array(made(F.lit("\x00"), F.lit("")))
    folded = F.aggregate(rows, safe, step)
    return F.slice(folded, 2, F.greatest(F.lit(1), F.size(folded))).cast(kind)


def example_list(content: Column) -> Column:
    """Examples from their marks on, or the whole content; none for nothing."""
    parts = F.transform(F.regexp_extract_all(content, F.lit(r"(?s)(\*\*Example \d+\*\*:.+?)(?=\*\*Example \d+\*\*:|\z)"), F.lit(1)), strip)
    return F.when(F.size(parts) > 0, parts).when(content != "", F.array(content)).otherwise(F.array().cast("array<string>"))


def note_list(content: Column) -> Column:
    """Bullet lines, `**x**:` as `x:`."""
    bullets = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x.startswith("-"))
    return F.transform(bullets, lambda x: F.regexp_replace(strip(F.substr(x, F.lit(2))), r"^\*\*(.+?)\*\*:\s*", "$1: "))


def question_list(mcqs: DataFrame) -> DataFrame:
    """Questions of (keys, content) with four options of which one is marked correct: question, options in an order given
    by hashes (instead of at random, so that reruns agree) with letters, expected answer."""
    keys = [c for c in mcqs.columns if c != "content"]
    blocks = mcqs.select(*keys, F.posexplode(F.split("content", r"\*\*Question \d+\*\*:", -1)).alias("n", "block")).where("n > 0")
    blocks = blocks.withColumn("question", strip(F.regexp_extract("block", r"(?s)\A(.+?)\n\d+\.", 1))).where("question <> ''")
    head = F.split_part("block", F.lit("**Explanations**:"), F.lit(1))
    options = F.regexp_extract_all(head, F.lit(r"(?ms)^\d+\.\s*(.+?)(?=\n\d+\.|\s*\z)"), F.lit(1))
    notes = F.transform(F.filter(F.split(F.split_part("block", F.lit("**Explanations**:"), F.lit(2)), "\n"), lambda x: strip(x).startswith("-")), lambda x: strip(F.regexp_extract(x, r"\*\*Option \d+\*\*:\s*(.+)", 1)))
    blocks = blocks.withColumn("o", options).where(F.size("o") == 4).withColumn("notes", notes)
    one = F.transform("o", lambda x, i: F.struct(F.xxhash64("question", x).alias("order"), strip(F.regexp_replace(x, r"\s*\(CORRECT\)\s*", "")).alias("text"), F.contains(x, F.lit("(CORRECT)")).alias("correct"), F.coalesce(F.get("notes", i), F.lit("")).alias("explanation")))
    blocks = blocks.withColumn("o", F.array_sort(one)).where(F.exists("o", lambda x: x["correct"]))
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    shown = F.transform("o", lambda x, i: F.struct(F.get(letters, i).alias("letter"), x["text"].alias("text"), x["correct"].alias("correct"), x["explanation"].alias("explanation")))
    return blocks.select(*keys, F.col("n").alias("question_number"), "question", shown.alias("options"), F.get(F.filter("o", lambda x: x["correct"]), F.lit(0))["text"].alias("expected_answer"))


def lessons_of(lessons: DataFrame, markdown: str) -> DataFrame:
    """Topic, summary and explanation (concepts joined) of each lesson that has a concept."""
    rows = lesson_lines(lessons, markdown)
    names = rows.where("head").select("lesson_id", "concept", strip(F.substr("t", F.lit(3))).alias("name"))
    told = concept_parts(rows).where("part = 'explanation'").select("lesson_id", "concept", "content")
    each = names.join(told, ["lesson_id", "concept"], "left").select("lesson_id", "concept", F.concat(F.lit("**"), "name", F.lit("**: "), F.coalesce("content", F.lit(""))).alias("t"))
    got = F.array_sort(F.collect_list(F.struct("concept", "t")))
    per = each.groupBy("lesson_id").agg(F.count("*").alias("n_concepts"), F.array_join(F.transform(got, lambda x: x["t"]), "\n\n").alias("explanation"))
    return lesson_heads(rows).join(per, "lesson_id")


def code_block(c: Column) -> Column:
    """The first <cb> block of an example as a fence, in place of the whole example."""
    p = r'(?s)<cb\s+lang="([^"]+)">(.+?)</cb>'
    lang = F.regexp_extract(c, p, 1)
    return F.when(lang != "", F.concat(F.lit("```"), lang, F.lit("\n"), F.replace(F.regexp_extract(c, p, 2), F.lit("\\n"), F.lit("\n")), F.lit("\n```"))).otherwise(F.coalesce(c, F.lit("")))


def json_text(raw: Column) -> Column:
    """The JSON in a model's answer: within a fence if there is one, from the first to the last brace."""
    inner = F.coalesce(missing(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), raw)
    return F.coalesce(missing(F.regexp_extract(inner, r"(?s)(\{.*\})", 1)), inner)


def parsed_json(df: DataFrame, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the parsed object, rows that hold none)."""
    rows = df.withColumn("parsed", F.from_json(json_text(F.col(raw)), schema + ", broken string", {"columnNameOfCorruptRecord": "broken"}))
    good = F.col("parsed").isNotNull() & F.col("parsed.broken").isNull()
    return rows.where(good), rows.where(~good).drop("parsed")


def valid_lesson() -> Column:
    """Whether columns analogies, steps, checkins and sources make a lesson."""
    sources = F.forall("sources", lambda s: s["document_id"].isNotNull() & s["page_start"].isNotNull() & s["page_end"].isNotNull())
    return F.coalesce((F.size("analogies") >= 2) & (F.size("steps") >= 3) & (F.size("checkins") >= 2) & (F.size("sources") > 0) & sources, F.lit(False))


def valid_mcq() -> Column:
    """Whether columns choices and correct_index make a question."""
    return F.coalesce((F.size("choices") == 4) & F.col("correct_index").between(0, 3), F.lit(False))


def normalized(check_ins: Column) -> Column:
    """Check-ins with trimmed texts, those without question or answer gone."""
    return F.filter(F.transform(check_ins, lambda e: F.struct(strip(F.coalesce(e["question"], F.lit(""))).alias("question"), strip(F.coalesce(e["expected_answer"], F.lit(""))).alias("expected_answer"), strip(F.coalesce(e["hint"], F.lit(""))).alias("hint"))), lambda e: (e["question"] != "") & (e["expected_answer"] != ""))


def attached(concepts: DataFrame, check_ins: DataFrame) -> DataFrame:
    """Check-ins (lesson_id, ordinal, concept, question, expected_answer) under concepts (lesson_id, position, name).

    Matched by name without case; what a concept already has is skipped; new names become concepts in order of arrival;
    nameless ones go to the first concept, or to 'General Check-ins' where a lesson has none.
    """
    rows = check_ins.select("lesson_id", "ordinal", strip(F.coalesce("concept", F.lit(""))).alias("given"), strip(F.coalesce("question", F.lit(""))).alias("question"), strip(F.coalesce("expected_answer", F.lit(""))).alias("expected_answer")).where("question <> '' AND expected_answer <> ''")
    known = concepts.select("lesson_id", "position", F.col("name").alias("known"), F.lower(strip(F.col("name"))).alias("key"))
    known = known.groupBy("lesson_id", "key").agg(F.max(F.struct("position", "known")).alias("k")).select("lesson_id", "key", "k.position", "k.known")
    first = known.groupBy("lesson_id").agg(F.min(F.struct("position", "known")).alias("f"))
    j = rows.withColumn("key", F.lower("given")).join(known, ["lesson_id", "key"], "left").join(first, "lesson_id", "left")
    nameless = F.col("given") == ""
    name = F.when(nameless, F.coalesce("f.known", F.lit("General Check-ins"))).otherwise(F.coalesce("known", F.first("given").over(Window.partitionBy("lesson_id", "key").orderBy("ordinal"))))
    place = F.when(nameless, F.col("f.position")).otherwise(F.col("position"))
    j = j.withColumn("name", name).withColumn("place", place).withColumn("repeatable", nameless | F.col("known").isNull())
    again = F.row_number().over(Window.partitionBy("lesson_id", "name", "question", "expected_answer", "repeatable").orderBy("ordinal"))
    j = j.withColumn("again", again).where(F.col("repeatable") | (F.col("again") == 1))
    per = j.groupBy("lesson_id", "name").agg(F.min("place").alias("position"), F.min("ordinal").alias("arrived"), F.array_sort(F.collect_list(F.struct("ordinal", "question", "expected_answer"))).alias("check_ins"))
    every = per.join(concepts.select("lesson_id", "position", "name"), ["lesson_id", "name", "position"], "full")
    order = Window.partitionBy("lesson_id").orderBy(F.asc_nulls_last("position"), "arrived", "name")
    return every.select("lesson_id", "name", F.row_number().over(order).alias("place"), F.coalesce(F.size("check_ins"), F.lit(0)).alias("n_check_ins"), "check_ins")


def flattened_check_ins(attached_: DataFrame) -> DataFrame:
    rows = attached_.select("lesson_id", F.coalesce(missing(F.col("name")), F.lit("Concept")).alias("concept"), "place", F.posexplode("check_ins").alias("n", "c"))
    return rows.select("lesson_id", "concept", "place", "n", "c.question", "c.expected_answer")


def concept_rows(lessons: DataFrame) -> DataFrame:
    """Rows of the concepts (array of names) of each lesson, numbered from 1, not yet learned."""
    return lessons.select("lesson_id", F.posexplode("names").alias("i", "name")).select("lesson_id", (F.col("i") + 1).alias("concept_number"), "name", F.lit("not_learned").alias("mastery_state"))


def without_lesson(requests: DataFrame, lessons: DataFrame) -> DataFrame:
    """Requests without a lesson: by owner and section, or by owner and document where the section is null."""
    have = lessons.select(F.col("owner_id").alias("o"), F.col("document_id").alias("d"), F.col("section_id").alias("s")).distinct()
    same = (F.col("owner_id") == F.col("o")) & F.col("section_id").eqNullSafe(F.col("s")) & (F.col("section_id").isNotNull() | (F.col("document_id") == F.col("d")))
    return requests.join(have, same, "left_anti")


def built_context(hits: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """Snippet lines of each query's hits (query_id, rank, title, document_id, page_start, page_end, text) up to most
    characters, stopping at the first that doesn't fit. Sizes only grow, so a running sum finds the stop."""
    s, e = F.col("page_start").cast("string"), F.col("page_end").cast("string")
    pages = F.when(s.isNotNull() & e.isNotNull(), F.when(s == e, F.concat(F.lit("p."), s)).otherwise(F.concat(F.lit("p."), s, F.lit("-"), e))).otherwise(F.concat(F.lit("p."), F.coalesce(s, e, F.lit("?"))))
    label = F.coalesce(missing(strip(F.coalesce("title", F.lit("")))), F.concat(F.lit("Document "), F.substring(F.col("document_id").cast("string"), 1, 8)), F.lit("Document"))
    rows = hits.withColumn("snippet", snippet(F.col("text"))).where("snippet <> ''").withColumn("line", F.concat(F.lit("- "), label, F.lit(" ("), pages, F.lit("): "), "snippet"))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0)))
    over = F.max((F.col("before") + F.length("line") > most).cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("over", over).where("over = 0")
    got = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.array_join(F.transform(got, lambda x: x["line"]), "\n").alias("context"))


def sources_of(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.groupBy(*keys, "document_id").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))


def graded() -> list[Column]:
    """Grade of a multiple-choice answer from selected_letter, correct_letter, selected_text, correct_text and explanations."""
    up = lambda c: F.upper(strip(F.coalesce(c, F.lit(""))))
    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    a, b = up("selected_letter"), up("correct_letter")
    right = F.when((a != "") & (b != ""), a == b).otherwise(low("selected_text") == low("correct_text"))
    why, said = strip(F.coalesce("correct_explanation", F.lit(""))), strip(F.coalesce("selected_explanation", F.lit("")))
    feedback = F.when(right, F.coalesce(missing(said), F.lit(WELL_DONE))).otherwise(F.coalesce(missing(why), F.lit(NOT_QUITE)))
    none = F.array().cast("array<string>")
    return [right.alias("correct"), F.when(right, 100).otherwise(0).alias("score"), feedback.alias("feedback"), F.when(right & (why != ""), F.array(why)).otherwise(none).alias("key_points"), F.when(~right & (said != ""), F.array(said)).otherwise(none).alias("misconceptions")]


def evaluated(raw: Column) -> Column:
    """Evaluation of a free answer: from its JSON, else by the words in it."""
    j = F.from_json(json_text(raw), "correct boolean, score double, feedback string, broken string", {"columnNameOfCorruptRecord": "broken"})
    low = F.lower(raw)
    guess = F.contains(low, F.lit("correct")) & ~F.contains(low, F.lit("incorrect")) & ~F.contains(low, F.lit("not correct"))
    good = j.isNotNull() & j["broken"].isNull()
    right = F.when(good, F.coalesce(j["correct"], F.lit(False))).otherwise(guess)
    usual = F.when(right, 80.0).otherwise(40.0)
    return F.struct(right.alias("correct"), F.when(good, F.coalesce(j["score"], usual)).otherwise(usual).alias("score"), F.when(good, F.coalesce(missing(j["feedback"]), F.lit(EVALUATED))).otherwise(raw).alias("feedback"))


def concept_order(sections: DataFrame, lessons: DataFrame) -> DataFrame:
    """Names of the concepts of each section's lesson in its order; none without a lesson."""
    j = sections.join(lessons.select("owner_id", "section_id", "names"), ["owner_id", "section_id"], "left")
    return j.select("owner_id", "section_id", F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda x: missing(x).isNotNull()).alias("names"))
