"""Queries of the learning analytics family."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import mastery as m
from studylake.plans.registry import query
from studylake.sources import derive as d
from studylake.sources.derive import ctes
from studylake.sources.tables import table

PER = "SELECT owner_id, concept_id, count(*) AS t, count(*) FILTER (WHERE was_correct) AS r FROM attempts GROUP BY ALL"
STATES = """
    runs AS (SELECT *, CAST(count(*) OVER w AS BIGINT) AS t, CAST(sum(CAST(was_correct AS INT)) OVER w AS BIGINT) AS r, sum(CAST(NOT was_correct AS INT)) OVER w AS miss
        FROM attempts WINDOW w AS (PARTITION BY owner_id, concept_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    streaks AS (SELECT *, CAST(sum(CAST(was_correct AS INT)) OVER (PARTITION BY owner_id, concept_id, miss ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM runs),
    ruled AS (SELECT *, CASE WHEN s >= 2 OR (100.0 * r / t >= 75 AND t >= 3) THEN 'mastered' WHEN (100.0 * r / t >= 50 AND t >= 2) OR s >= 1 THEN 'understood' END AS counted FROM streaks),
    stated AS (SELECT *, coalesce(counted, CASE WHEN lag(counted) OVER (PARTITION BY owner_id, concept_id ORDER BY ts, event_id) IS NOT NULL THEN 'needs_review' ELSE 'introduced' END) AS new_state FROM ruled),
    current AS (SELECT owner_id, concept_id, arg_max(new_state, (ts, event_id)) AS mastery_state, max(t) AS t, max(r) AS r FROM stated GROUP BY ALL),
    states AS (SELECT c.*, coalesce(mastery_state, 'not_learned') AS mastery_state, coalesce(t, 0) AS total_attempts, coalesce(r, 0) AS correct_attempts FROM concepts c LEFT JOIN current USING (owner_id, concept_id))"""
WITH_STATES = ctes("attempts", "concepts").rstrip() + ", " + STATES + " "


def states(spark, sf):
    return m.with_state(d.concepts(spark, sf), d.attempts(spark, sf))


def count_of(*names):
    return ", ".join(f"CAST({n} AS BIGINT) AS {n.split('(')[0]}" for n in names)


@query(ctes("attempts") + "SELECT owner_id, concept_id, CAST(count(*) AS BIGINT) AS total_attempts, CAST(count(*) FILTER (WHERE was_correct) AS BIGINT) AS correct_attempts FROM attempts GROUP BY ALL")
def ana1_attempts_per_concept(spark, sf):
    return m.attempts_per_concept(d.attempts(spark, sf))


@query(ctes("attempts", "concepts") + f"""
    SELECT owner_id, concept_id, concept_number, section_id, CAST(coalesce(t, 0) AS BIGINT) AS total_attempts, CAST(coalesce(r, 0) AS BIGINT) AS correct_attempts,
        CASE WHEN t > 0 THEN round_even(CAST(r AS DOUBLE) / t * 100, 0) ELSE 0.0 END AS accuracy,
        CASE WHEN t = 0 THEN 'not_started' WHEN CAST(r AS DOUBLE) / t >= 0.8 THEN 'completed' WHEN r = 0 THEN 'incorrect' ELSE 'in_progress' END AS mastery_level, coalesce(concept_number - 1, 0) AS lesson_position
    FROM concepts LEFT JOIN ({PER}) USING (owner_id, concept_id)""")
def ana2_concept_mastery(spark, sf):
    return m.concept_mastery(d.concepts(spark, sf), d.attempts(spark, sf))


@query(ctes("attempts", "concepts", "sections") + f"""
    , per AS (SELECT owner_id, section_id, count(DISTINCT concept_id) AS n, count(DISTINCT CASE WHEN CAST(r AS DOUBLE) / t >= 0.8 THEN concept_id END) AS done, coalesce(sum(t), 0) AS t, coalesce(sum(r), 0) AS r
        FROM concepts LEFT JOIN ({PER}) USING (owner_id, concept_id) GROUP BY ALL)
    SELECT owner_id, section_id, section_number, CAST(coalesce(n, 0) AS BIGINT) AS total_concepts, CAST(coalesce(done, 0) AS BIGINT) AS completed_concepts, CAST(coalesce(t, 0) AS BIGINT) AS total_attempts, CAST(coalesce(r, 0) AS BIGINT) AS correct_attempts,
        CASE WHEN t > 0 THEN round_even(CAST(r AS DOUBLE) / t * 100, 0) ELSE 0.0 END AS accuracy,
        CASE WHEN t = 0 THEN 'not_started' WHEN CAST(r AS DOUBLE) / t >= 0.8 THEN 'completed' WHEN r = 0 THEN 'incorrect' ELSE 'in_progress' END AS mastery_level
    FROM sections LEFT JOIN per USING (owner_id, section_id)""")
def ana3_section_mastery(spark, sf):
    return m.section_mastery(d.sections(spark, sf), d.concepts(spark, sf), d.attempts(spark, sf))


@query(WITH_STATES + """
    SELECT owner_id, concept_id, event_id, ts, was_correct, t AS total_attempts, r AS correct_attempts, s AS consecutive_correct, coalesce(lag(new_state) OVER (PARTITION BY owner_id, concept_id ORDER BY ts, event_id), 'not_learned') AS old_state,
        new_state, CAST(floor(100.0 * r / t + 0.5) AS BIGINT) AS accuracy_percent FROM stated""")
def ana4_mastery_states(spark, sf):
    return m.mastery_states(d.attempts(spark, sf))


ANSWERS = "answers AS (SELECT user_id AS owner_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 14 END AS concept_id, 'Concept ' || (event_id % 12) AS name, 'Chapter ' || (event_id % 4) AS chapter FROM events)"


@query(ctes("attempts", "concepts").rstrip() + ", " + ANSWERS + """
    SELECT owner_id, event_id, CASE WHEN a.concept_id IS NOT NULL THEN i.concept_id ELSE by_name END AS found_id,
        CASE WHEN a.concept_id IS NOT NULL AND i.concept_id IS NOT NULL THEN 'id' WHEN a.concept_id IS NULL AND by_name IS NOT NULL THEN 'name' ELSE 'created' END AS how
    FROM answers a LEFT JOIN (SELECT owner_id, concept_id FROM concepts) i USING (owner_id, concept_id)
    LEFT JOIN (SELECT owner_id, name, chapter, min(concept_id) AS by_name FROM concepts GROUP BY ALL) USING (owner_id, name, chapter)""")
def ana5_resolve_concepts(spark, sf):
    e = F.col("event_id")
    text = lambda head, n: F.concat(F.lit(head), (e % n).cast("string"))
    answers = table(spark, sf, "events").select(F.col("user_id").alias("owner_id"), "event_id", F.when(e % 3 == 0, e % 14).alias("concept_id"), text("Concept ", 12).alias("name"), text("Chapter ", 4).alias("chapter"))
    found = m.resolve_concepts(answers, d.concepts(spark, sf))
    return found.select("owner_id", "event_id", F.when(F.col("how") != "created", F.col("resolved_id")).alias("found_id"), "how")


@query(WITH_STATES + """
    SELECT owner_id, CASE WHEN grouping(course) = 1 AND grouping(chapter) = 1 THEN 'overall' WHEN grouping(course) = 1 THEN 'chapter' WHEN grouping(chapter) = 1 THEN 'course' ELSE 'course_chapter' END AS scope, course, chapter,
        CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE mastery_state = 'mastered') AS BIGINT) AS mastered, CAST(count(*) FILTER (WHERE mastery_state = 'understood') AS BIGINT) AS understood,
        CAST(count(*) FILTER (WHERE mastery_state = 'needs_review') AS BIGINT) AS needs_review, CAST(count(*) FILTER (WHERE mastery_state IN ('not_learned', 'introduced')) AS BIGINT) AS not_learned,
        CAST(floor(100 * (count(*) FILTER (WHERE mastery_state = 'mastered') + 0.5 * count(*) FILTER (WHERE mastery_state = 'understood')) / count(*) + 0.5) AS BIGINT) AS percentage
    FROM (SELECT owner_id, coalesce(CAST(course_id AS VARCHAR), 'uncategorized') AS course, coalesce(nullif(chapter, ''), 'Uncategorized') AS chapter, mastery_state FROM states)
    GROUP BY GROUPING SETS ((owner_id, chapter), (owner_id, course), (owner_id, course, chapter), (owner_id))""")
def ana6_progress_rollup(spark, sf):
    return m.progress_rollup(states(spark, sf))


LISTED = """, listed AS (SELECT s.*, coalesce(c.name, 'Unassigned Course') AS course_name, row_number() OVER (PARTITION BY s.owner_id ORDER BY s.course_id NULLS LAST, chapter NULLS LAST, concept_number NULLS LAST, concept_id) AS place
    FROM states s LEFT JOIN courses c ON s.course_id = c.course_id)"""
WITH_LISTED = ctes("attempts", "concepts", "courses").rstrip() + ", " + STATES + LISTED


@query(WITH_LISTED + "SELECT owner_id, concept_id, name, course_id, course_name, chapter, CAST(place AS INTEGER) AS place FROM listed")
def ana7_concept_list(spark, sf):
    return m.concept_list(states(spark, sf), d.courses(spark, sf)).select("owner_id", "concept_id", "name", "course_id", "course_name", "chapter", "place")


@query(WITH_LISTED + """
    , weak AS (SELECT *, CASE WHEN total_attempts > 0 THEN CAST(floor(100.0 * correct_attempts / total_attempts + 0.5) AS BIGINT) ELSE 0 END AS accuracy FROM listed
        WHERE mastery_state = 'needs_review' OR (total_attempts >= 2 AND CAST(correct_attempts AS DOUBLE) / total_attempts < 0.5)),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY accuracy, place) AS INTEGER) AS rank FROM weak)
    SELECT owner_id, rank, concept_id, name, chapter, mastery_state, accuracy, total_attempts, course_id, course_name FROM ranked WHERE rank <= 10""")
def ana8_weak_areas(spark, sf):
    return m.weak_areas(states(spark, sf), d.courses(spark, sf))


@query(ctes("sessions", "courses") + """
    SELECT owner_id, rank, session_id, coalesce(c.name, 'Unassigned Course') AS course_name, CASE WHEN total_check_ins > 0 THEN CAST(floor(100.0 * correct_check_ins / total_check_ins + 0.5) AS BIGINT) ELSE 0 END AS accuracy, duration_minutes, started_at
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY started_at DESC, session_id) AS INTEGER) AS rank FROM sessions) s LEFT JOIN (SELECT course_id, name FROM courses) c USING (course_id) WHERE rank <= 10""")
def ana9_recent_sessions(spark, sf):
    return m.recent_sessions(d.sessions(spark, sf), d.courses(spark, sf))


@query(ctes("sessions") + """
    SELECT owner_id, CAST(count(*) AS BIGINT) AS total_sessions, CAST(sum(total_check_ins) AS BIGINT) AS total_check_ins, CAST(sum(correct_check_ins) AS BIGINT) AS total_correct, CAST(sum(duration_minutes) AS BIGINT) AS total_minutes,
        CAST(floor(100.0 * sum(correct_check_ins) / sum(total_check_ins) + 0.5) AS BIGINT) AS overall_accuracy FROM sessions GROUP BY owner_id""")
def ana10_session_statistics(spark, sf):
    return m.session_statistics(d.sessions(spark, sf))


@query(ctes("sessions") + "SELECT owner_id, session_id, course_id, total_check_ins FROM sessions WHERE course_id = 3")
def ana11_filtered_sessions(spark, sf):
    return m.filtered(d.sessions(spark, sf), owner_id=None, course_id=3).select("owner_id", "session_id", "course_id", "total_check_ins")


@query(ctes("attempts") + """
    , seen AS (SELECT owner_id * 100 + day(ts) AS session_id, concept_id, count(*) AS n, count(*) FILTER (WHERE was_correct) AS r, min((ts, event_id)) AS first FROM attempts GROUP BY ALL)
    SELECT session_id, CAST(sum(n) AS BIGINT) AS total_check_ins, CAST(sum(r) AS BIGINT) AS correct_check_ins, list(concept_id ORDER BY first) AS concepts_covered FROM seen GROUP BY session_id""")
def ana12_session_tracking(spark, sf):
    a = d.attempts(spark, sf)
    return m.session_tracking(a.withColumn("session_id", F.col("owner_id") * 100 + F.dayofmonth("ts")))


@query("""
    WITH e AS (SELECT user_id * 100 + day(ts) AS session_id, * FROM events), s AS (SELECT session_id, min(ts) AS started_at FROM e GROUP BY 1), c AS (SELECT session_id, min(ts) AS completed_at FROM e WHERE event_type = 'purchase' GROUP BY 1)
    SELECT session_id, started_at, completed_at, CAST(floor((epoch_us(completed_at) - epoch_us(started_at)) / 6e7 + 0.5) AS BIGINT) AS duration_minutes FROM s JOIN c USING (session_id)""")
def ana13_session_completion(spark, sf):
    e = table(spark, sf, "events").withColumn("session_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return m.session_completion(e.groupBy("session_id").agg(F.min("ts").alias("started_at")), e.where("event_type = 'purchase'").select("session_id", F.col("ts").alias("completed_at")))


SHOWN = """
    , shown AS (SELECT s.owner_id, concept_id, coalesce(nullif(chapter, ''), 'Uncategorized') AS chapter, section_number, t.name AS section_name, concept_number, s.name,
        CASE WHEN total_attempts > 0 THEN CAST(floor(100.0 * correct_attempts / total_attempts + 0.5) AS BIGINT) ELSE 0 END AS accuracy, total_attempts
        FROM states s LEFT JOIN sections t ON s.owner_id = t.owner_id AND s.section_id = t.section_id),
    levels AS (SELECT *, CASE WHEN total_attempts = 0 THEN 'not_started' WHEN accuracy = 100 THEN 'completed' WHEN accuracy = 0 THEN 'incorrect' ELSE 'in_progress' END AS mastery_level FROM shown)"""
WITH_SHOWN = ctes("attempts", "concepts", "sections").rstrip() + ", " + STATES + SHOWN


@query(WITH_SHOWN + "SELECT owner_id, concept_id, chapter, section_number, section_name, accuracy, mastery_level FROM levels")
def ana14_displayed_concepts(spark, sf):
    return m.displayed_concepts(states(spark, sf), d.sections(spark, sf)).drop("place")


@query(WITH_SHOWN + """
    SELECT owner_id, concept_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY CASE WHEN chapter = 'Uncategorized' THEN 'uncategorized' ELSE 'chapter ' || lpad(regexp_extract(chapter, '[0-9]+'), 40, '0') END,
        coalesce(nullif(section_number, 0), 999), concept_number NULLS LAST, name) AS INTEGER) AS place FROM levels""")
def ana15_concept_order(spark, sf):
    return m.displayed_concepts(states(spark, sf), d.sections(spark, sf)).select("owner_id", "concept_id", "place")


@query(ctes("attempts", "concepts", "sections") + "SELECT owner_id, section_id, section_number, CASE WHEN concepts_generated THEN 'introduced' ELSE 'not_started' END AS mastery_level FROM sections")
def ana16_displayed_sections(spark, sf):
    return m.displayed_sections(d.sections(spark, sf))


@query(WITH_SHOWN + """
    SELECT owner_id, section_number, CAST(count(*) FILTER (WHERE mastery_level = 'not_started') AS BIGINT) AS not_started, CAST(count(*) FILTER (WHERE mastery_level = 'incorrect') AS BIGINT) AS incorrect,
        CAST(count(*) FILTER (WHERE mastery_level = 'in_progress') AS BIGINT) AS in_progress, CAST(count(*) FILTER (WHERE mastery_level = 'completed') AS BIGINT) AS completed
    FROM levels WHERE coalesce(section_number, 0) <> 0 GROUP BY ALL""")
def ana17_mastery_histogram(spark, sf):
    return m.mastery_histogram(m.displayed_concepts(states(spark, sf), d.sections(spark, sf)))


@query(ctes("attempts", "concepts") + """
    SELECT owner_id, concept_id, CAST(row_number() OVER (PARTITION BY owner_id, document_id, coalesce(CAST(section_id AS VARCHAR), 'no-section') ORDER BY concept_number NULLS LAST, name) AS INTEGER) AS concept_number FROM concepts""")
def ana18_renumbered(spark, sf):
    return m.renumbered(d.concepts(spark, sf))


@query(ctes("attempts", "concepts", "sections") + "SELECT owner_id, section_id, section_number, lead(section_id) OVER (PARTITION BY owner_id ORDER BY section_number) AS next_section_id FROM sections")
def sec15_next_sections(spark, sf):
    return m.next_sections(d.sections(spark, sf))
