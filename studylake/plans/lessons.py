"""Queries of the lesson family."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import lessons as l
from studylake.plans.registry import query
from studylake.sources import derive as d
from studylake.sources.derive import ctes
from studylake.sources.tables import field, payloads, shapes, table

#: A lesson for each part: two concepts, with all kinds of parts.
BODY = (
    "intro\n# {n}\n\n## Summary\nAbout {n}.\nMore.\n# First {k}\nlost\n## Explanation\nIt is {n}.\n## Formulas\n- **Formula**: a = {k} **Variables**: a is x\n- **Formula**: b = 2\n- **Variables**: b is y\n- c + {k}\nlost\n"
    "## Examples\n**Example 1**: one {k}\n**Example 2**: two\nmore\n## Important Notes\n- **Note**: keep {k}\nno\n- last\n## Check Your Understanding\n**Question 1**: What is {k}?\n1. {n} (CORRECT)\n2. two\n3. three\n4. four\n\n**Explanations**:\n"
    "- **Option 1**: right {k}\n- **Option 2**: wrong\n- **Option 3**: wrong\n- **Option 4**: wrong\n**Question 2**: No options\n1. a (CORRECT)\n# Second {k}\n## Explanation\nIt ends.\n"
)


def lessons(spark, sf):
    p = table(spark, sf, "part")
    text = F.replace(F.replace(F.lit(BODY), F.lit("{n}"), F.col("p_name")), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("lesson_id"), text.alias("markdown"))


def parts(spark, sf):
    return l.concept_parts(l.lesson_lines(lessons(spark, sf), "markdown"))


P = "SELECT p_partkey AS lesson_id, "


@query(P + "p_name AS topic, 'About ' || p_name || '.' || chr(10) || 'More.' AS summary, CAST(2 AS BIGINT) AS n_concepts, '**First ' || p_partkey || '**: It is ' || p_name || '.' || chr(10) || chr(10) || '**Second ' || p_partkey || '**: It ends.' AS explanation FROM part")
def lsn1_lessons(spark, sf):
    return l.lessons_of(lessons(spark, sf), "markdown")


@query("""SELECT p_partkey AS lesson_id, CASE WHEN i = 5 THEN 'Second ' ELSE 'First ' END || p_partkey AS name, CASE i WHEN 0 THEN 'explanation' WHEN 1 THEN 'formulas' WHEN 2 THEN 'examples' WHEN 3 THEN 'important_notes' WHEN 4 THEN 'mcqs' ELSE 'explanation' END AS part,
    CASE i WHEN 0 THEN 'It is ' || p_name || '.' WHEN 5 THEN 'It ends.' WHEN 3 THEN '- **Note**: keep ' || p_partkey || chr(10) || 'no' || chr(10) || '- last' END AS content FROM part, (SELECT unnest(range(0, 6)) AS i)""")
def lsn2_concept_parts(spark, sf):
    return parts(spark, sf).select("lesson_id", "name", "part", F.when(F.col("part").isin("explanation", "important_notes"), F.col("content")).alias("content"))


@query("SELECT p_partkey AS lesson_id, 'a = ' || p_partkey || '|a is x;b = 2|b is y;c + ' || p_partkey || '|' AS formulas FROM part")
def lsn3_formulas(spark, sf):
    rows = parts(spark, sf).where("part = 'formulas'").select("lesson_id", l.formula_list(F.col("content")).alias("f"))
    return rows.select("lesson_id", F.array_join(F.transform("f", lambda x: F.concat(x["formula"], F.lit("|"), x["variables"])), ";").alias("formulas"))


@query("SELECT p_partkey AS lesson_id, '**Example 1**: one ' || p_partkey || ';**Example 2**: two' || chr(10) || 'more' AS examples, 'Note: keep ' || p_partkey || ';last' AS notes FROM part")
def lsn4_examples_and_notes(spark, sf):
    x = parts(spark, sf)
    e = x.where("part = 'examples'").select("lesson_id", F.array_join(l.example_list(F.col("content")), ";").alias("examples"))
    return e.join(x.where("part = 'important_notes'").select("lesson_id", F.array_join(l.note_list(F.col("content")), ";").alias("notes")), "lesson_id")


@query("SELECT p_partkey AS lesson_id, 'What is ' || p_partkey || '?' AS question, p_name AS expected_answer, 'ABCD' AS letters, list_aggregate(list_sort([p_name, 'two', 'three', 'four']), 'string_agg', ',') AS texts, 'right ' || p_partkey AS why FROM part")
def lsn5_questions(spark, sf):
    q = l.question_list(parts(spark, sf).where("part = 'mcqs'").select("lesson_id", "content"))
    field = lambda f: F.transform("options", lambda x: x[f])
    return q.select("lesson_id", "question", "expected_answer", F.array_join(field("letter"), "").alias("letters"), F.array_join(F.array_sort(field("text")), ",").alias("texts"), F.get(F.filter("options", lambda x: x["correct"]), F.lit(0))["explanation"].alias("why"))


@query(P + "CASE WHEN p_partkey % 2 = 0 THEN '```sql' || chr(10) || 'select ' || p_name || chr(10) || 'from t' || chr(10) || '```' ELSE p_name END AS example FROM part")
def lsn6_code_blocks(spark, sf):
    p = table(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('See <cb lang="sql">select '), "p_name", F.lit("\\nfrom t</cb> end"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("lesson_id"), l.code_block(raw).alias("example"))


def answers(spark, sf, obj):
    """obj as a model's answer: alone, in a fence, in a sentence, or none."""
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, F.lit("not json")).when(k % 5 == 1, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```"))).when(k % 5 == 2, F.concat(F.lit("so "), obj, F.lit(" end"))).otherwise(obj)
    return table(spark, sf, "part").select(k.alias("lesson_id"), raw.alias("raw"))


@query(P + "p_name AS topic FROM part WHERE p_partkey % 5 <> 0")
def lsn7_parsed_json(spark, sf):
    obj = F.to_json(F.struct(F.col("p_name").alias("topic")))
    return l.parsed_json(answers(spark, sf, obj), "raw", "topic string")[0].select("lesson_id", "parsed.topic")


def mixed_payloads(spark, sf):
    """Answers of two shapes."""
    plain = F.to_json(F.struct(F.col("p_name").alias("topic"), F.col("p_size").alias("size")))
    deep = F.to_json(F.struct(F.struct(F.col("p_name").alias("topic")).alias("lesson"), F.array(F.col("p_size")).alias("sizes")))
    rows = answers(spark, sf, F.when(F.col("p_partkey") % 2 == 0, plain).otherwise(deep))
    return payloads(rows, l.json_text(F.col("raw")))


@query("SELECT p_partkey AS lesson_id, p_name AS topic, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 5 <> 0")
def lsn7_payloads_of_any_shape(spark, sf):
    found, _ = mixed_payloads(spark, sf)
    topic = F.coalesce(field("payload", "$.topic", "string"), field("payload", "$.lesson.topic", "string"))
    return found.select("lesson_id", topic.alias("topic"), F.coalesce(field("payload", "$.size", "bigint"), field("payload", "$.sizes[0]", "bigint")).alias("size"))


@query("""SELECT p_partkey % 2 AS kind, CAST(count(*) FILTER (WHERE p_partkey % 5 <> 0) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE p_partkey % 5 = 0) AS BIGINT) AS rejects,
    CASE p_partkey % 2 WHEN 0 THEN 'OBJECT<size: BIGINT, topic: STRING>' ELSE 'OBJECT<lesson: OBJECT<topic: STRING>, sizes: ARRAY<BIGINT>>' END AS shape FROM part GROUP BY p_partkey % 2""")
def lsn7_shapes_and_rejects(spark, sf):
    found, bad = mixed_payloads(spark, sf)
    kind = (F.col("lesson_id") % 2).alias("kind")
    return shapes(found.withColumn("kind", kind), "payload", "kind").join(bad.groupBy(kind).agg(F.count("*").alias("rejects")), "kind")


@query("SELECT p_partkey AS lesson_id, p_size % 4 >= 2 AND p_size % 5 >= 3 AND p_size % 3 >= 2 AND p_size % 7 <> 0 AS lesson_ok, p_size % 2 = 0 AND p_size % 6 <= 3 AS mcq_ok FROM part")
def lsn8_valid_payloads(spark, sf):
    n = F.col("p_size")
    some = lambda k: F.array_repeat(F.lit("x"), n % k)
    source = F.struct(F.lit("d").alias("document_id"), F.when(n % 7 != 0, 1).alias("page_start"), F.lit(2).alias("page_end"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("lesson_id"), some(4).alias("analogies"), some(5).alias("steps"), some(3).alias("checkins"), F.array(source).alias("sources"), F.array_repeat(F.lit("c"), 4 - n % 2).alias("choices"), (n % 6).alias("correct_index"))
    return rows.select("lesson_id", l.valid_lesson().alias("lesson_ok"), l.valid_mcq().alias("mcq_ok"))


@query(r"SELECT conv_id AS lesson_id, string_agg(regexp_replace(text, '\A\s+|\s+\z', '', 'g'), '|' ORDER BY turn) AS questions FROM conversations WHERE regexp_replace(text, '\A\s+|\s+\z', '', 'g') <> '' AND turn % 3 <> 1 GROUP BY 1")
def lsn9_normalized(spark, sf):
    entry = F.struct("turn", F.concat(F.lit("  "), "text", F.lit("\n")).alias("question"), F.when(F.col("turn") % 3 == 1, " ").otherwise("a").alias("expected_answer"), F.lit(None).cast("string").alias("hint"))
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("lesson_id")).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    return rows.select("lesson_id", l.normalized(F.col("c")).alias("c")).where(F.size("c") > 0).select("lesson_id", F.array_join(F.transform("c", lambda x: x["question"]), "|").alias("questions"))


ATTACHED = r"""con AS (SELECT DISTINCT lesson_id, i AS position, 'Topic ' || i AS name FROM check_ins, (VALUES (0), (1)) v(i)),
    ci AS (SELECT lesson_id, ordinal, CASE WHEN ordinal % 4 = 2 THEN '' ELSE lower(concept) END AS given, regexp_replace(question, '\A\s+|\s+\z', '', 'g') AS q, regexp_replace(expected_answer, '\A\s+|\s+\z', '', 'g') AS a FROM check_ins),
    m AS (SELECT *, CASE WHEN given = '' THEN 'Topic 0' WHEN given IN ('topic 0', 'topic 1') THEN 'Topic ' || right(given, 1) ELSE given END AS name FROM ci WHERE q <> '' AND a <> ''),
    u AS (SELECT *, row_number() OVER (PARTITION BY lesson_id, name, q, a, given = '' OR given NOT IN ('topic 0', 'topic 1') ORDER BY ordinal) AS again FROM m),
    k AS (SELECT * FROM u WHERE given = '' OR given NOT IN ('topic 0', 'topic 1') OR again = 1)"""


def attached(spark, sf):
    c = d.check_ins(spark, sf)
    concepts = c.select("lesson_id").distinct().select("lesson_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).withColumn("name", F.concat(F.lit("Topic "), F.col("position").cast("string")))
    given = c.withColumn("concept", F.when(F.col("ordinal") % 4 == 2, "").otherwise(F.lower("concept")))
    return l.attached(concepts, given)


@query(ctes("check_ins").rstrip() + ", " + ATTACHED + " SELECT lesson_id, name, CAST(count(q) AS INTEGER) AS n_check_ins FROM (SELECT lesson_id, name FROM con UNION SELECT lesson_id, name FROM k) LEFT JOIN k USING (lesson_id, name) GROUP BY 1, 2")
def lsn10_attached_check_ins(spark, sf):
    return attached(spark, sf).select("lesson_id", "name", "n_check_ins")


@query(ctes("check_ins").rstrip() + ", " + ATTACHED + " SELECT lesson_id, name AS concept, q AS question, a AS expected_answer FROM k")
def lsn11_lesson_check_ins(spark, sf):
    return l.flattened_check_ins(attached(spark, sf)).select("lesson_id", "concept", "question", "expected_answer")


@query("SELECT p_partkey AS lesson_id, CAST(i AS INTEGER) AS concept_number, string_split(p_name, ' ')[i] AS name, 'not_learned' AS mastery_state FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def lsn12_concept_rows(spark, sf):
    return l.concept_rows(table(spark, sf, "part").select(F.col("p_partkey").alias("lesson_id"), F.split("p_name", " ").alias("names")))


@query(ctes("attempts", "concepts") + """, req AS (SELECT owner_id, concept_id, document_id, CASE WHEN concept_id % 4 <> 1 THEN section_id END AS section_id FROM concepts), les AS (SELECT * FROM req WHERE concept_id % 3 = 0)
    SELECT owner_id, concept_id FROM req r WHERE NOT EXISTS (SELECT 1 FROM les l WHERE l.owner_id = r.owner_id AND ((r.section_id IS NOT NULL AND l.section_id = r.section_id) OR (r.section_id IS NULL AND l.section_id IS NULL AND l.document_id = r.document_id)))""")
def lsn13_without_lesson(spark, sf):
    req = d.concepts(spark, sf).withColumn("section_id", F.when(F.col("concept_id") % 4 != 1, F.col("section_id")))
    return l.without_lesson(req, req.where("concept_id % 3 = 0")).select("owner_id", "concept_id")


@query(r"""WITH h AS (SELECT source AS query_id, doc_id AS rank, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id ELSE 'Document ' || doc_id END AS label, CASE doc_id % 4 WHEN 0 THEN 'p.1' WHEN 1 THEN 'p.1-2' WHEN 2 THEN 'p.3' ELSE 'p.?' END AS pages, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
    r AS (SELECT *, '- ' || label || ' (' || pages || '): ' || CASE WHEN length(x) > 600 THEN x[1:600] || '…' ELSE x END AS line FROM h), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - 1 AS upto FROM r)
    SELECT query_id, CAST(count(*) AS BIGINT) AS n, string_agg(line, chr(10) ORDER BY rank) AS context FROM s WHERE upto <= 8000 GROUP BY 1""")
def lsn14_contexts(spark, sf):
    k = F.col("doc_id")
    start, end = F.when(k % 4 <= 1, 1).when(k % 4 == 2, 3), F.when(k % 4 == 0, 1).when(k % 4 == 1, 2)
    hits = table(spark, sf, "documents").select(F.col("source").alias("query_id"), k.alias("rank"), F.when(k % 3 == 0, F.concat(F.lit("Title "), k.cast("string"))).alias("title"), k.alias("document_id"), start.alias("page_start"), end.alias("page_end"), "text")
    return l.built_context(hits)


@query("SELECT l_orderkey AS query_id, l_suppkey AS document_id, min(l_linenumber) AS page_start, max(l_linenumber + l_partkey % 3) AS page_end FROM lineitem GROUP BY 1, 2")
def lsn15_sources(spark, sf):
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("page_start"), (F.col("l_linenumber") + F.col("l_partkey") % 3).alias("page_end"))
    return l.sources_of(chunks, "query_id")


@query("""WITH a AS (SELECT event_id, event_id % 4 = event_id % 3 AS same, event_id % 5 = 0 AS by_text, event_id % 7 = 0 AS by_word FROM events), r AS (SELECT *, CASE WHEN by_text THEN by_word ELSE same END AS correct FROM a)
    SELECT event_id, correct, CASE WHEN correct THEN 100 ELSE 0 END AS score, CASE WHEN correct THEN 'Great job! You chose the correct answer.' ELSE 'Because.' END AS feedback, CAST(CASE WHEN correct THEN 1 ELSE 0 END AS INTEGER) AS n_points FROM r""")
def lsn16_graded(spark, sf):
    e = F.col("event_id")
    abcd = lambda n: F.get(F.array(*[F.lit(x) for x in "abcd"]), n.cast("int"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "events").select("event_id", F.when(e % 5 != 0, F.concat(F.lit(" "), abcd(e % 4))).alias("selected_letter"), F.when(e % 5 != 0, F.upper(abcd(e % 3))).alias("correct_letter"), F.when(e % 7 == 0, " Yes").otherwise("no").alias("selected_text"), F.lit("YES").alias("correct_text"), F.lit("Because. ").alias("correct_explanation"), none.alias("selected_explanation"))
    return rows.select("event_id", *l.graded()).select("event_id", "correct", "score", "feedback", F.size("key_points").alias("n_points"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS correct, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 80.0 ELSE 40.0 END AS score FROM events")
def lsn17_evaluated(spark, sf):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit('```json\n{"correct": true, "score": '), F.col("value").cast("string"), F.lit("}\n```"))).when(e % 4 == 1, "That is Correct.").when(e % 4 == 2, "It is incorrect").otherwise('{"correct": false}')
    return table(spark, sf, "events").select("event_id", l.evaluated(raw).alias("x")).select("event_id", "x.correct", "x.score")


@query(ctes("attempts", "concepts", "sections") + "SELECT owner_id, section_id, CASE WHEN section_id <= 1 THEN 'First,Next ' || section_id ELSE '' END AS names FROM sections")
def lsn18_concept_order(spark, sf):
    sec = d.sections(spark, sf)
    les = sec.where("section_id <= 1").select("owner_id", "section_id", F.array(F.lit("First"), F.lit(""), F.concat(F.lit("Next "), F.col("section_id").cast("string")), F.lit(None).cast("string")).alias("names"))
    return l.concept_order(sec, les).withColumn("names", F.array_join("names", ","))
