"""Rules on literal inputs, with values worked out by hand, and helpers against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from studylake.functions import matching
from studylake.functions.text import natural_key
from studylake.operators import clean, layout, lessons, mastery, retrieve, sections, usage
from studylake.sources import tables
from studylake.streaming import streams


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_noise(spark):
    assert one(spark, "Page 1\n\nThis is text.", clean.remove_noise) == "This is text."
    assert one(spark, "This document is confidential.", clean.remove_noise) == "This document is confidential."
    assert one(spark, "Draft of x\n第 6 页\n---\n\nIntro", clean.remove_noise) == "Intro"
    assert one(spark, None, clean.remove_noise) == ""


def test_tables_are_compared_with_the_first_of_a_run(spark):
    t = [(1, 1, 0, list("ABCD"), [["1"] * 4], 1, 4), (1, 2, 0, [""] * 4, [["2"] * 4], 1, 4), (1, 3, 0, ["a ", "b", "c", "X"], [["3"] * 4], 1, 4), (1, 5, 0, [""] * 4, [["4"] * 4], 1, 4), (2, 1, 0, None, None, 0, 2), (2, 1, 1, ["", ""], [["x", "y"]], 1, 2)]
    df = spark.createDataFrame(t, "doc_id long, page int, table_index int, headers array<string>, rows array<array<string>>, row_count int, col_count int")
    got = sorted((r["doc_id"], r["page_start"], r["page_end"], r["row_count"], r["merged"]) for r in clean.merge_tables(df).collect())
    assert got == [(1, 1, 3, 3, True), (1, 5, 5, 1, False), (2, 1, 1, 0, False), (2, 1, 1, 1, False)]


def test_headings_use_the_upper_median(spark):
    rows = [(1, 1, i, "t", 0.0, float(i), 10.0, 1.0, s, f, 600.0) for i, (s, f) in enumerate([(12.0, "T"), (12.0, "T"), (18.0, "T"), (15.0, "T")])]
    df = spark.createDataFrame(rows, "doc_id long, page int, span_idx int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, font_name string, page_width double")
    assert [r["heading_level"] for r in layout.headed(df).orderBy("span_idx").collect()] == [0, 0, 3, 0]


def test_mastery_windows_equal_a_fold(spark):
    rnd = random.Random(5)
    rows = [(o, c, rnd.random() < 0.5, t, t) for o in range(3) for c in range(4) for t in range(12)]
    df = spark.createDataFrame(rows, "owner_id long, concept_id long, was_correct boolean, ts long, event_id long")
    got = {(r["owner_id"], r["concept_id"], r["event_id"]): (r["old_state"], r["new_state"]) for r in mastery.mastery_states(df).collect()}
    held = {}
    for o, c, right, _, e in rows:
        total, correct, streak, now = held.get((o, c), (0, 0, 0, "not_learned"))
        total, correct, streak = total + 1, correct + right, streak + 1 if right else 0
        new = streams.next_state(total, correct, streak, now)
        assert got[o, c, e] == (now, new)
        held[o, c] = total, correct, streak, new


def plain_admission(times, limit):
    """Greedy admission in plain Python: whether a request is allowed, and what remains."""
    held, out = [], []
    for t in times:
        held = [x for x in held if x > t - 60_000]
        out.append((len(held) < limit, max(0, limit - len(held) - 1)))
        held += [t] if out[-1][0] else []
    return out


def test_rate_admission(spark):
    times = [0, 1, 2, 3, 59, 60, 61]
    assert [a for a, _ in plain_admission([1000 * t for t in times], 3)] == [True, True, True, False, False, True, True]
    rnd = random.Random(3)
    rows = [(o, "lesson", rnd.randrange(0, 300_000), i) for i, o in enumerate([0] * 60 + [1] * 2 + [2] * 9)]
    rows += [(3, "lesson", 90_000 * (i // 5) + 59_999 * (i % 5 == 4) + i % 5, 100 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "owner_id long, type string, ts_ms long, request_id long")
    got = {r["request_id"]: (r["allowed"], r["remaining"]) for r in usage.rate_admission(df, {"lesson": 3}).collect()}
    for o in range(4):
        own = sorted((t, i) for x, _, t, i in rows if x == o)
        for (_, i), want in zip(own, plain_admission([t for t, _ in own], 3), strict=True):
            assert got[i] == want


@pytest.mark.parametrize("kind", ["steady", "random", "lulls"])
def test_a_busy_owner_is_admitted_in_slices(spark, kind):
    """Steady requests keep the slices' windows apart to the end; others let them meet."""
    r = random.Random(6)
    n = 4000
    gaps = {"steady": lambda i: 700, "random": lambda i: r.randrange(1, 1500), "lulls": lambda i: 40_000 if i % 90 == 0 else 400}[kind]
    rows, t = [], 0
    for i in range(n):
        t += gaps(i)
        rows.append((i % 400 == 7, t, i))
    df = spark.createDataFrame([(int(o), "lesson", t, i) for o, t, i in rows], "owner_id long, type string, ts_ms long, request_id long")
    got = {x["request_id"]: (x["allowed"], x["remaining"]) for x in usage.rate_admission(df, {"lesson": 23}, slice_rows=150).collect()}
    assert len(got) == n
    for o in (0, 1):
        own = [(t, i) for x, t, i in rows if x == o]
        assert [got[i] for _, i in own] == plain_admission([t for t, _ in own], 23)
    busy = usage.with_slices(df.withColumns({"burst": F.lit(0).cast("long"), "limit": F.lit(23)}), 150)
    assert busy.select("owner_id", "slice").distinct().count() > 15


def plain_boundary(text, position, forward=True):
    """The rule in plain Python."""
    if position < 0 or position >= len(text):
        return len(text) if forward else 0
    first = max(0, position - 500)
    region = text[first : position + 500]
    for pattern, shift in ((r"\n\n+", 0), (r"[.!?]\s", 1), (r"\n", 0)):
        places = [first + m.start() + shift for m in re.finditer(pattern, region)]
        if places:
            return min(places, key=lambda x: (abs(x - position), x))
    return position


def test_smart_boundary(spark):
    r = random.Random(3)
    cases = [("aaa.\n\nbbb. ccc", 9), ("abc", 10), ("abcdef", 3), ("", 0), ("a\n\n\n\n\nb", 4), ("x" * 2000, 1000), ("a.b.\u00a0c", 2)]
    cases += [("".join(r.choice("abc.\n\n ?") for _ in range(r.randrange(1, 1500))), r.randrange(-2, 1500)) for _ in range(60)]
    cases += [("".join(r.choice("abcdefgh" * 40 + ".\n ") for _ in range(1500)), r.randrange(1500)) for _ in range(40)]
    df = spark.createDataFrame(cases, "text string, position int")
    for forward in (True, False):
        got = df.select(sections.smart_boundary(F.col("text"), F.col("position"), forward)).collect()
        assert [x[0] for x in got] == [plain_boundary(t, p, forward) for t, p in cases]


def test_heading_rules_know_ascii_words_and_unicode_blanks(spark):
    texts = ["12 Pläce names here", "12 Place names here", "5th Ave", "Chapter\u00a03: The third", "Chapter 3: The third", "4.1 Real Topic Words", "INTRODUCTION\u00a0TO WORDS", "Appendix\u00a012", "Appendix 12", "12 Best Places Here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, t string")
    valid = {x[0]: x[1] for x in df.select("t", sections.valid_heading(F.col("t"))).collect()}
    assert valid == {texts[0]: False, texts[1]: False, texts[2]: False, texts[3]: True, texts[4]: True, texts[5]: True, texts[6]: True, texts[7]: False, texts[8]: False, texts[9]: True}
    found = {x["text"] for x in sections.headings(df, "t").collect()}
    assert found == {texts[3], texts[4], texts[5], texts[6], texts[9]}


def test_names_that_begin_other_names(spark):
    """A heading is found by the beginning of its text, as in the rules' origin: `Part 1` also fits `## Part 10`, and what
    follows a section's first character counts as the beginning of a line."""
    text = "# T\n\n## Part 10\n\nten\n\n## Part 1\n\none\n\n**Bold One**\n\nbold\n"
    docs = spark.createDataFrame([(1, text)], "doc_id int, markdown string")
    parts = spark.createDataFrame([(1, 1, "Part 10"), (1, 2, "Part 1"), (1, 3, "Bold One")], "doc_id int, section_number int, name string")
    got = [x["markdown_text"] for x in sections.split_by_sections(docs, parts).orderBy("section_number").collect()]
    assert got == ["#", "## Part 10\n\nten\n\n## Part 1\n\none", "**Bold One**\n\nbold"]


def plain_spans(text, names):
    """The rules name by name, each with a scan of its own."""
    blank = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]".replace("\\s", " \\t\\n\\x0b\\f\\r")

    def search(name, least):
        after = text[least:]
        for pattern in (f"^#{{1,3}}{blank}*{re.escape(name)}", rf"\*\*{re.escape(name)}\*\*"):
            if m := re.search(pattern, after, re.MULTILINE | re.IGNORECASE | re.ASCII):
                return least + m.start()
        return None

    n, k, starts, out = len(text), len(names), [], []
    for i, name in enumerate(names):
        low, high = i * n // k, (i + 1) * n // k
        at = search(name, 0)
        if at is None and (inside := text[low:high].lower().find(name.lower())) >= 0:
            at = low + inside
        starts.append(plain_boundary(text, low) if at is None else at)
    for i, start in enumerate(starts):
        end = n if i == k - 1 else search(names[i + 1], start + 1)
        end = plain_boundary(text, (i + 1) * n // k, False) if end is None else end
        out.append(text[min(start, end) : max(start, end)].strip())
    return out


def section_cases():
    r = random.Random(11)
    for case in range(60):
        names = [r.choice(("Part", "part", "Kapitel", "A", "One two", "x.*y", "# y")) + r.choice(("", " 1", " 10", " 2", ":")) for _ in range(r.randrange(1, 9))]
        pieces = ["#", "##", "###", "####", "**", "\n", "\n\n", " ", "\u00a0", "word. ", "end! ", *names, *[x.upper() for x in names], *[f"\n## {x}\n" for x in names], *[f"**{x}**" for x in names]]
        yield case, "".join(r.choice(pieces) for _ in range(r.randrange(1, 120))), names


def test_sections_by_one_scan_are_those_of_many(spark):
    cases = list(section_cases())
    docs = spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id int, markdown string")
    own = spark.createDataFrame([(i, k, n) for i, _, names in cases for k, n in enumerate(names)], "doc_id int, section_number int, name string")
    got = {(x["doc_id"], x["section_number"]): x["markdown_text"] for x in sections.split_by_sections(docs, own).collect()}
    assert got == {(i, k): x for i, t, names in cases for k, x in enumerate(plain_spans(t, names))}


def test_section_scores_count_other_names(spark):
    rows = [(1, k, name, text) for k, (name, text) in enumerate([("Alpha", "ALPHA and beta"), ("Beta", "nothing"), ("beta", "alpha Beta gamma"), ("Gamma", "gamma"), (None, "alpha"), ("Gam", None)])]
    own = spark.createDataFrame(rows, "doc_id int, section_number int, name string, extracted string")
    got = [x["quality"] for x in sections.scored(own, spark.createDataFrame([(1, 100)], "doc_id int, size int")).orderBy("section_number").collect()]
    want = []
    for _, _, name, text in rows:
        low = (text or "").lower()
        others = sum(x is not None and x != name and x.lower() in low for _, _, x, _ in rows)
        ratio = len(low) / 100
        want.append(round(max(0.0, min(1.0, 0.3 * (name is not None and name.lower() in low) + (0.3 if 0.05 < ratio < 0.5 else -0.2 if ratio >= 0.5 else 0) + (0.4, 0.2, -0.2)[min(others, 2)])), 6))
    assert got == want


def test_thousands_of_sections_take_time_in_proportion():
    names = [f"Section number {i} of a long document" for i in range(2000)]
    text = "# T\n\n" + "\n\n".join(f"## {n}\n\n" + "Some words stand here. " * 9 for n in names)
    began = time.process_time()
    spans = list(matching.section_spans(text, names))
    assert [text[a:].startswith(f"## {n}\n") for n, (a, _) in zip(names, spans, strict=True)].count(False) < 3
    assert time.process_time() - began < 2


def test_limits(spark):
    asked = [(1, "free", 1, 0, 5, 0), (2, "free", 0, 0, 11, 0), (3, "tier2", 9, 99, 50, 2), (4, "tier2", 9, 99, 50, 1)]
    df = spark.createDataFrame(asked, "user_id long, tier string, pdfs_uploaded long, chapters_generated long, pages long, chapters long")
    got = {r["user_id"]: (r["pdf_ok"], r["page_ok"], r["chapter_ok"]) for r in usage.limit_decisions(df, usage.tiers(spark)).collect()}
    assert got == {1: (False, True, True), 2: (True, False, True), 3: (True, True, False), 4: (True, True, True)}


def test_extraction_json_and_rejects(spark):
    df = spark.createDataFrame([(1, '{"pages": [{"page": 1, "text": null}]}'), (2, "{}"), (3, "x")], "doc_id long, raw string")
    pages, rejects = tables.parse_output(df, "raw")
    assert [tuple(r) for r in pages.collect()] == [(1, 1, "")]
    assert sorted(r["doc_id"] for r in rejects.collect()) == [2, 3]


def test_lesson_without_concepts_gives_no_row(spark):
    df = spark.createDataFrame([(1, "# Only a topic\n## Summary\nx"), (2, None), (3, "")], "lesson_id long, markdown string")
    assert lessons.lessons_of(df, "markdown").count() == 0


def test_natural_order_of_numbers_of_any_length(spark):
    want = ["1", "Chapter 2", "chapter 009", "Chapter 10", "Chapter 99", "Chapter 123456789", "Chapter 9999999999", "Chapter 99999999999", "Chapter 100000000000", "Chapter " + "9" * 99, "Chapter 1" + "0" * 100, "section"]
    rows = spark.createDataFrame([(x,) for x in reversed(want)], "name string")
    assert [r["name"] for r in rows.orderBy(natural_key(F.col("name"))).collect()] == want


def test_extraction_files_and_their_rejects(spark, tmp_path):
    for name, text in {"a": '[{"doc_id": 1,\n "pages": [{"page": 1, "text": "x"}]},\n {"doc_id": 2}]', "b": '{"doc_id": 3, "tables": []}', "c": '[{"doc_id": 4},', "d": '{"doc_id": "four", "pages": []}', "e": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = tables.read_extractions(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["pages"] is None) for r in good.collect()) == [(1, False), (2, True), (3, True)]
    assert sorted(r["file"].rsplit("/", 1)[1] for r in bad.collect()) == ["c.json", "d.json"]
    assert [tuple(r) for r in tables.content(good, "pages").collect()] == [(1, 0, 1, "x")]


def test_relational_tables_are_replaced_whole(spark):
    url, schema = "jdbc:derby:memory:rules;create=true", {"k": "bigint", "t": "string"}
    first = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    tables.write_relational(first, url, "things", schema, column_types="t VARCHAR(20)")
    tables.write_relational(first.where("k < 700"), url, "things", schema, column_types="t VARCHAR(20)")
    found = tables.read_relational(spark, url, "things", schema, "k", rows_a_part=100)
    assert found.rdd.getNumPartitions() == 7 and found.count() == found.distinct().count() == 700
    plan = found.where("k > 690")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(k), *GreaterThan(k,690)]" in plan
    with pytest.raises(TypeError, match="k is int"):
        tables.write_relational(first.withColumn("k", F.col("k").cast("int")), url, "things", schema)
    with pytest.raises(TypeError, match="t is string"):
        tables.read_relational(spark, url, "things", schema | {"t": "date"}, "k")
    assert tables.read_relational(spark, url, "things", schema, "k").count() == 700


def test_payloads_of_any_shape(spark):
    raws = ['{"a": {"b": [1, 2]}}', '{"a": 7}', "[3]", "not-json", None, ""]
    found, bad = tables.payloads(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"), F.col("raw"))
    got = {r["i"]: (r["x"], r["y"]) for r in found.select("i", tables.field("payload", "$.a.b[1]", "bigint").alias("x"), tables.field("payload", "$.a", "bigint").alias("y")).collect()}
    assert got == {0: (2, None), 1: (None, 7), 2: (None, None)}
    assert sorted(r["i"] for r in bad.collect()) == [3, 4, 5]


def test_agreeing_sources(spark):
    r = random.Random(2)
    words = [f"p{i}" for i in range(40)]
    texts = ["\n".join(r.choices(words, k=r.randrange(0, 12))) for _ in range(150)] + ["p1\np2", "p2\n p1\n\np1", None, ""]
    have = spark.createDataFrame([(i % 2 if i % 9 else None, i, t) for i, t in enumerate(texts)], "chapter int, key int, text string")
    members, classes = sections.source_classes(have, "text", ["chapter"], "key")
    sets = {(i % 2 if i % 9 else None, i): frozenset(x.strip() for x in (t or "").split("\n") if x.strip()) for i, t in enumerate(texts)}
    want = {k: min(j for (c, j), s in sets.items() if c == k[0] and s == own) for k, own in sets.items() if own}
    assert {(x["chapter"], x["key"]): x["of"] for x in members.collect()} == want
    for least in (0.1, 0.5):
        pairs = set()
        heads = [(c, i) for (c, i), of in want.items() if i == of and c is not None]
        for c, i in heads:
            for c2, j in heads:
                a, b = sets[c, i], sets[c2, j]
                if c == c2 and i < j and len(a & b) / len(a | b) >= least:
                    pairs.add((c, i, j, len(a & b), round(len(a & b) / len(a | b), 6)))
        assert {tuple(x) for x in sections.agreeing_classes(classes.where("chapter IS NOT NULL"), ["chapter"], least).collect()} == pairs
    # One paragraph in thousands of sources that have others of their own makes no pairs.
    many = spark.range(3000).select(F.lit(1).alias("chapter"), F.col("id").cast("int").alias("key"), F.concat_ws("\n", F.lit("shared"), *[F.concat(F.lit(f"own{i} "), F.col("id")) for i in range(30)]).alias("text"))
    assert sections.agreeing_classes(sections.source_classes(many, "text", ["chapter"], "key")[1], ["chapter"]).count() == 0


@pytest.mark.parametrize("rows", [65_536, 40])
def test_nearest_chunks_of_tenants(spark, rows):
    """Tenants of many and of few chunks, norms far apart and equal, copies and ties."""
    r = random.Random(9)
    chunks = []
    for i in range(900):
        owner = 1 if i % 3 else i % 7 + 2
        scale = r.choice((1.0, 1.0, 5.0, 40.0))
        chunks.append((owner, i, [round(r.gauss(0, scale), 2) for _ in range(4)] if i % 10 else [1.0, 2.0, 3.0, 4.0]))
    chunks += [(1, 1000, None), (20, 1001, [1.0, 1.0, 1.0, 1.0])]
    have = spark.createDataFrame(chunks, "owner_id long, vec_id long, v array<double>")
    asked = have.where("vec_id % 5 = 0 AND v IS NOT NULL").select("owner_id", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["distance"]) for x in retrieve.nearest_chunks(asked, have, 5, rows).collect()}
    want = {}
    for owner, q, v in chunks:
        if v and q % 5 == 0:
            near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, 6), i) for o, i, w in chunks if o == owner and i != q and w)
            want |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(near[:5])}
    assert got == want
