"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import ann_graph, byte_bpe, knn_join, langid, line_dedup, max_sketch, mixing, ngram_join, packing, quality, substring_dedup, turn_repair, url_filter
from studylake.llm.common import held_out, keep, table, word_count

#: The rules that op8 is to apply: host, beginning of the path, verdict.
SITES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.find_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.col("kept_id").alias("kept_doc_id"), "cluster")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = langid.fit_dictionaries(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs, known)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "accepted")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_count(F.col("text"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", words, mixing.root_of(words))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.voronoi_join(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings")
    index = keep(ann_graph.build_index(data), "ann-index")
    return ann_graph.search(index, data.where(F.col("vec_id") % 20 == 0))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, SITES))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_components(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = quality.score(docs, trees)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    hurt = turn_repair.damaged(rows)
    audited = turn_repair.audits(hurt)
    texts = turn_repair.digests(turn_repair.repaired(hurt, audited)).withColumnRenamed("conv", "text_conv")
    found = audited.join(texts, F.col("conv").eqNullSafe(F.col("text_conv")), "left")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _repair_sql() -> str:
    """The edits by a plain recursion over turns: for each state the least cost and then the least audit, as one string. An
    insert costs more than deleting the turn that it would stand beside and a lone system turn, so none is tried."""

    def edit(state: str, cost: str, initial: str, on: str = "true") -> str:
        return f"CASE WHEN {state} IS NOT NULL AND {on} THEN lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{initial}' END"

    def stays(state: str, initial: str) -> str:
        role = f"{edit(state, 'more', 'K', f"NOT gone AND r = '{initial}'")}"
        return role if initial == "s" else f"{role}, {edit(state, 'more + 1', 'R', 'NOT gone')}"

    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
        WITH RECURSIVE marks AS (
            SELECT list(c ORDER BY i) AS t
            FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(i))),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t,
                list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b
            FROM conversations, marks),
        kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || b, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM kinds WHERE kind <> 0),
        placed AS (
            SELECT conv_id, turn, role, text, copy, trim(text, {blanks}) AS inside, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
            FROM hurt),
        faults AS (
            SELECT *, inside = '' AS blank, inside <> '' AND again AS duplicate, inside <> '' AND NOT again AND right(inside, 1) NOT IN ('.', '!', '?') AS truncated,
                inside = '' OR again AS gone, CASE WHEN right(inside, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more,
                left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM placed),
        counts AS (
            SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM faults GROUP BY conv_id),
        walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS taken, '000000000' AS p, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM counts
            UNION ALL
            SELECT w.conv_id, taken + 1, {edit("p", "2", "D")}, least({edit("s", "2", "D")}, {stays("p", "s")}),
                least({edit("u", "2", "D")}, {stays("p", "u")}, {stays("s", "u")}, {stays("a", "u")}), least({edit("a", "2", "D")}, {stays("u", "a")})
            FROM walk AS w JOIN faults AS f ON f.conv_id = w.conv_id AND f.i = w.taken + 1),
        audits AS (SELECT conv_id, CAST(left(least(p, a), 9) AS BIGINT) AS cost, substr(least(p, a), 10) AS audit FROM walk JOIN counts USING (conv_id) WHERE taken = n),
        stay AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k
            FROM (SELECT f.*, substr(audit, CAST(i AS INTEGER), 1) AS edit FROM faults AS f JOIN audits USING (conv_id)) WHERE edit <> 'D'),
        named AS (
            SELECT *, CASE WHEN edit = 'K' THEN role WHEN (k - CAST(bool_or(k = 1 AND edit = 'K' AND r = 's') OVER (PARTITION BY conv_id) AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS said
            FROM stay),
        texts AS (SELECT conv_id, sha256(string_agg(said || ':' || text, chr(10) ORDER BY k)) AS repaired_sha256 FROM named GROUP BY conv_id)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN audits USING (conv_id) LEFT JOIN texts USING (conv_id)"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup, "op2_language": op2_language, "op3_mix": op3_mix, "op4_pack": op4_pack, "op5_knn": op5_knn, "op6_ann": op6_ann,
    "op7_line_dedup": op7_line_dedup, "op8_url_filter": op8_url_filter, "op9_ngram_join": op9_ngram_join, "op10_quality": op10_quality, "op11_ranked_search": op11_ranked_search,
    "op12_byte_bpe": op12_byte_bpe, "op13_turn_repair": op13_turn_repair,
}

ORACLE_SQL = {
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keys AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        often AS (SELECT k, max(doc_id) AS last FROM keys WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE last IS NOT NULL AND doc_id <> last) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256
        FROM keys LEFT JOIN often USING (k) GROUP BY doc_id""",
    "op8_url_filter": r"""
        WITH parts AS (
            SELECT page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[?&]replytocom=[0-9]|/wp-login\.php([?#]|$)|[?&;](phpsessid|jsessionid)=|/calendar/[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[?&]print=(1|true|yes)\b|[?&]add-to-cart=[0-9]') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
    "op11_ranked_search": r"""
        WITH terms AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS every FROM sizes),
        freq AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM freq, totals GROUP BY term, docs),
        impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // every))) AS adds FROM freq JOIN sizes USING (doc_id) JOIN weights USING (term), totals),
        scores AS (SELECT item_id, doc_id, CAST(sum(adds) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(adds) > 0)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scores QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op13_turn_repair": _repair_sql(),
}
