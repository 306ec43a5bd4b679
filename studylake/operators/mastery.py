"""Learning analytics: answers to mastery, progress, weak areas and session figures, for all owners at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.text import half_up, micros, missing, natural_key, percent

#: Weak areas: least attempts, accuracy below which one is weak, how many an owner gets.
WEAK_ATTEMPTS, WEAK_ACCURACY, WEAK_TOP = 2, 0.5, 10
CHAPTERLESS, COURSELESS = "Uncategorized", "Unassigned Course"


def attempts_per_concept(attempts: DataFrame) -> DataFrame:
    """(owner_id, concept_id, total_attempts, correct_attempts)."""
    return attempts.groupBy("owner_id", "concept_id").agg(F.count("*").alias("total_attempts"), F.count_if("was_correct").alias("correct_attempts"))


def level(total: Column, correct: Column, strict: bool = True) -> Column:
    """Mastery level of counts. strict: an unanswered concept has null counts and so falls to in_progress."""
    started = F.when(total == 0, "not_started") if strict else F.when(F.coalesce(total, F.lit(0)) == 0, "not_started")
    return started.when(correct / total >= 0.8, "completed").when(correct == 0, "incorrect").otherwise("in_progress")


def concept_mastery(concepts: DataFrame, attempts: DataFrame, chapter: str | None = None, strict: bool = True) -> DataFrame:
    """Every concept with its attempts, rounded accuracy (halves to even), level and place in the lesson."""
    c = concepts if chapter is None else concepts.where(F.col("chapter") == chapter)
    j = c.join(attempts_per_concept(attempts), ["owner_id", "concept_id"], "left")
    t, r = F.col("total_attempts"), F.col("correct_attempts")
    return j.select(
        "owner_id", "concept_id", "concept_number", "section_id", F.coalesce(t, F.lit(0)).alias("total_attempts"), F.coalesce(r, F.lit(0)).alias("correct_attempts"),
        F.when(t > 0, F.bround(r / t * 100, 0)).otherwise(0.0).alias("accuracy"), level(t, r, strict).alias("mastery_level"), F.coalesce(F.col("concept_number") - 1, F.lit(0)).alias("lesson_position"),
    )


def section_mastery(sections: DataFrame, concepts: DataFrame, attempts: DataFrame, strict: bool = True) -> DataFrame:
    """Every section with its concepts, those at 80% or more, attempts, accuracy and level.

    Attempts are added up by concept before the join, so a section's concepts need no distinct count.
    """
    per = concepts.join(attempts_per_concept(attempts), ["owner_id", "concept_id"], "left").groupBy("owner_id", "section_id").agg(
        F.count("*").alias("total_concepts"), F.count_if(F.col("correct_attempts") / F.col("total_attempts") >= 0.8).alias("completed_concepts"),
        F.coalesce(F.sum("total_attempts"), F.lit(0)).alias("t"), F.coalesce(F.sum("correct_attempts"), F.lit(0)).alias("r"),
    )
    t, r = F.col("t"), F.col("r")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sections.join(per, ["owner_id", "section_id"], "left").select(
        "owner_id", "section_id", "section_number", zero("total_concepts").alias("total_concepts"), zero("completed_concepts").alias("completed_concepts"), zero("t").alias("total_attempts"), zero("r").alias("correct_attempts"),
        F.when(t > 0, F.bround(r / t * 100, 0)).otherwise(0.0).alias("accuracy"), F.when(t == 0, "not_started").otherwise(level(F.nullif(t, F.lit(0)) if strict else t, r, strict)).alias("mastery_level"),
    )


def mastery_states(attempts: DataFrame) -> DataFrame:
    """Each answer with the running counters and the state before and after it.

    Counters are running windows in the order (ts, event_id); the streak counts since the last wrong answer. The state
    follows from the counters and from whether the previous answer's counters alone gave understood or mastered, so one
    sort of an owner's concept serves all columns and nothing recurs.
    """
    order = Window.partitionBy("owner_id", "concept_id").orderBy("ts", "event_id")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = F.col("was_correct").cast("long")
    rows = attempts.withColumn("total", F.count("*").over(run)).withColumn("correct", F.sum(right).over(run))
    rows = rows.withColumn("correct_at_miss", F.coalesce(F.max(F.when(~F.col("was_correct"), F.col("correct"))).over(run), F.lit(0)))
    rows = rows.withColumn("streak", F.col("correct") - F.col("correct_at_miss"))
    share = 100.0 * F.col("correct") / F.col("total")
    counted = F.when((F.col("streak") >= 2) | ((share >= 75) & (F.col("total") >= 3)), "mastered").when(((share >= 50) & (F.col("total") >= 2)) | (F.col("streak") >= 1), "understood")
    rows = rows.withColumn("counted", counted)
    fell = F.lag("counted").over(order).isNotNull()
    rows = rows.withColumn("new_state", F.coalesce("counted", F.when(fell, "needs_review").otherwise("introduced")))
    old = F.lag("new_state", 1, "not_learned").over(order)
    return rows.select("owner_id", "concept_id", "event_id", "ts", "was_correct", F.col("total").alias("total_attempts"), F.col("correct").alias("correct_attempts"), F.col("streak").alias("consecutive_correct"), old.alias("old_state"), "new_state", half_up(share).alias("accuracy_percent"))


def current_state(states: DataFrame) -> DataFrame:
    """The last state of each owner's concept."""
    last = F.max_by(F.struct("new_state", "total_attempts", "correct_attempts", "consecutive_correct", "ts"), F.struct("ts", "event_id")).alias("s")
    return states.groupBy("owner_id", "concept_id").agg(last).select("owner_id", "concept_id", F.col("s.new_state").alias("mastery_state"), "s.total_attempts", "s.correct_attempts", "s.consecutive_correct", F.col("s.ts").alias("last_reviewed_at"))


def with_state(concepts: DataFrame, attempts: DataFrame) -> DataFrame:
    """Concepts with state and counters; not_learned and zero where nobody answered."""
    j = concepts.join(current_state(mastery_states(attempts)), ["owner_id", "concept_id"], "left")
    return j.fillna({"mastery_state": "not_learned", "total_attempts": 0, "correct_attempts": 0, "consecutive_correct": 0})


def resolve_concepts(answers: DataFrame, concepts: DataFrame) -> DataFrame:
    """answers (owner_id, concept_id, name, chapter, …) with resolved_id and how: by id, by (owner, name, chapter), created.

    A created concept's id is a hash of its natural key, so that reruns agree.
    """
    ids = concepts.select("owner_id", "concept_id", F.col("concept_id").alias("by_id")).distinct()
    names = concepts.where("name IS NOT NULL").groupBy("owner_id", "name", "chapter").agg(F.min("concept_id").alias("by_name"))
    j = answers.join(ids, ["owner_id", "concept_id"], "left").join(names, ["owner_id", "name", "chapter"], "left")
    given = F.col("concept_id").isNotNull()
    found = F.when(given, F.col("by_id")).otherwise(F.col("by_name"))
    how = F.when(given & F.col("by_id").isNotNull(), "id").when(~given & F.col("by_name").isNotNull(), "name").otherwise("created")
    return j.withColumn("resolved_id", F.coalesce(found, F.xxhash64("owner_id", "name", "chapter"))).withColumn("how", how).drop("by_id", "by_name")


def tally() -> list[Column]:
    s = F.col("mastery_state")
    return [F.count("*").alias("total"), F.count_if(s == "mastered").alias("mastered"), F.count_if(s == "understood").alias("understood"), F.count_if(s == "needs_review").alias("needs_review"), F.count_if(s.isin("not_learned", "introduced")).alias("not_learned")]


def progress_rollup(states: DataFrame) -> DataFrame:
    """Counts and percentage of each owner's chapters, courses, course chapters and all, in one pass of grouping sets.

    Counts are first added up by (owner, course, chapter): only those few rows are expanded to the four sets.
    """
    base = states.select("owner_id", F.coalesce(F.col("course_id").cast("string"), F.lit("uncategorized")).alias("course"), F.coalesce(missing(F.col("chapter")), F.lit(CHAPTERLESS)).alias("chapter"), "mastery_state")
    base = base.groupBy("owner_id", "course", "chapter").agg(*tally())
    o, c, h = F.col("owner_id"), F.col("course"), F.col("chapter")
    sets = base.groupingSets([(o, h), (o, c), (o, c, h), (o,)], o, c, h)
    sums = sets.agg(F.grouping("course").alias("gc"), F.grouping("chapter").alias("gh"), *[F.sum(x).alias(x) for x in ("total", "mastered", "understood", "needs_review", "not_learned")])
    scope = F.when((F.col("gc") == 1) & (F.col("gh") == 1), "overall").when(F.col("gc") == 1, "chapter").when(F.col("gh") == 1, "course").otherwise("course_chapter")
    share = half_up(100 * (F.col("mastered") + 0.5 * F.col("understood")) / F.col("total"))
    return sums.select("owner_id", scope.alias("scope"), "course", "chapter", "total", "mastered", "understood", "needs_review", "not_learned", share.alias("percentage"))


def concept_list(states: DataFrame, courses: DataFrame) -> DataFrame:
    """Concepts with their course's name and a place in the owner's list (course, chapter and number, nulls last)."""
    names = courses.select("course_id", F.col("name").alias("course_name"))
    j = states.join(names, "course_id", "left").withColumn("course_name", F.coalesce("course_name", F.lit(COURSELESS)))
    order = Window.partitionBy("owner_id").orderBy(F.asc_nulls_last("course_id"), F.asc_nulls_last("chapter"), F.asc_nulls_last("concept_number"), "concept_id")
    return j.withColumn("place", F.row_number().over(order))


def weak_areas(states: DataFrame, courses: DataFrame, top: int = WEAK_TOP) -> DataFrame:
    """An owner's weakest concepts: to be reviewed, or at least two attempts under half right; least accurate first."""
    t, r = F.col("total_attempts"), F.col("correct_attempts")
    weak = concept_list(states, courses).where((F.col("mastery_state") == "needs_review") | ((t >= WEAK_ATTEMPTS) & (r / t < WEAK_ACCURACY)))
    weak = weak.withColumn("accuracy", percent(r, t))
    order = Window.partitionBy("owner_id").orderBy("accuracy", "place")
    ranked = weak.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("owner_id", "rank", "concept_id", "name", "chapter", "mastery_state", "accuracy", "total_attempts", "course_id", "course_name")


def recent_sessions(sessions: DataFrame, courses: DataFrame, top: int = 10) -> DataFrame:
    """An owner's last sessions with course name and accuracy."""
    order = Window.partitionBy("owner_id").orderBy(F.desc("started_at"), "session_id")
    last = sessions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    j = last.join(courses.select("course_id", F.col("name").alias("course_name")), "course_id", "left")
    return j.select("owner_id", "rank", "session_id", F.coalesce("course_name", F.lit(COURSELESS)).alias("course_name"), percent(F.col("correct_check_ins"), F.col("total_check_ins")).alias("accuracy"), "duration_minutes", "started_at")


def session_statistics(sessions: DataFrame) -> DataFrame:
    """Sums over all sessions of an owner."""
    s = sessions.groupBy("owner_id").agg(F.count("*").alias("total_sessions"), F.sum("total_check_ins").alias("total_check_ins"), F.sum("correct_check_ins").alias("total_correct"), F.sum("duration_minutes").alias("total_minutes"))
    return s.withColumn("overall_accuracy", percent(F.col("total_correct"), F.col("total_check_ins")))


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows with the wanted value in each column given; None filters nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def session_tracking(tracked: DataFrame) -> DataFrame:
    """Counters and the concepts covered, in the order first seen, of each session of (session_id, ts, event_id, concept_id, was_correct)."""
    seen = tracked.groupBy("session_id", "concept_id").agg(F.count("*").alias("n"), F.count_if("was_correct").alias("r"), F.min(F.struct("ts", "event_id")).alias("first"))
    seen = seen.groupBy("session_id").agg(F.sum("n").alias("total_check_ins"), F.sum("r").alias("correct_check_ins"), F.array_sort(F.collect_list(F.struct("first", "concept_id"))).alias("seen"))
    return seen.select("session_id", "total_check_ins", "correct_check_ins", F.transform("seen", lambda x: x["concept_id"]).alias("concepts_covered"))


def session_completion(starts: DataFrame, completions: DataFrame) -> DataFrame:
    """The first completion of each session decides; duration in whole minutes."""
    first = completions.groupBy("session_id").agg(F.min("completed_at").alias("completed_at"))
    minutes = (micros(F.col("completed_at")) - micros(F.col("started_at"))) / 6e7
    return starts.join(first, "session_id").select("session_id", "started_at", "completed_at", half_up(minutes).alias("duration_minutes"))


def displayed_concepts(states: DataFrame, sections: DataFrame) -> DataFrame:
    """Concepts as learners see them: level by rounded accuracy, section number and name, place in the list (chapter with
    numbers by value, section, number, name)."""
    t, r = F.col("total_attempts"), F.col("correct_attempts")
    j = states.join(sections.select("owner_id", "section_id", "section_number", F.col("name").alias("section_name")), ["owner_id", "section_id"], "left")
    accuracy = percent(r, t)
    shown = F.when(t == 0, "not_started").when(accuracy == 100, "completed").when(accuracy == 0, "incorrect").otherwise("in_progress")
    chapter = F.coalesce(missing(F.col("chapter")), F.lit(CHAPTERLESS))
    section = F.coalesce(F.nullif("section_number", F.lit(0)), F.lit(999))
    order = Window.partitionBy("owner_id").orderBy(natural_key(chapter), section, F.asc_nulls_last("concept_number"), "name")
    return j.select("owner_id", "concept_id", chapter.alias("chapter"), "section_number", "section_name", accuracy.alias("accuracy"), shown.alias("mastery_level"), F.row_number().over(order).alias("place"))


def displayed_sections(sections: DataFrame) -> DataFrame:
    return sections.select("owner_id", "section_id", "section_number", F.when(F.col("concepts_generated"), "introduced").otherwise("not_started").alias("mastery_level"))


def mastery_histogram(displayed: DataFrame) -> DataFrame:
    """Levels of an owner's sections as columns; section 0 is hidden."""
    levels = ["not_started", "incorrect", "in_progress", "completed"]
    shown = displayed.where(F.coalesce("section_number", F.lit(0)) != 0)
    return shown.groupBy("owner_id", "section_number").pivot("mastery_level", levels).count().fillna(0, levels)


def renumbered(concepts: DataFrame) -> DataFrame:
    """New concept numbers in (owner, document, section): by old number, nulls last, then name."""
    order = Window.partitionBy("owner_id", "document_id", F.coalesce(F.col("section_id").cast("string"), F.lit("no-section"))).orderBy(F.asc_nulls_last("concept_number"), "name")
    return concepts.select("owner_id", "concept_id", F.row_number().over(order).alias("concept_number"))


def next_sections(sections: DataFrame) -> DataFrame:
    """Sections in order with the next one's id."""
    order = Window.partitionBy("owner_id").orderBy("section_number")
    return sections.select("owner_id", "section_id", "section_number", F.lead("section_id").over(order).alias("next_section_id"))
