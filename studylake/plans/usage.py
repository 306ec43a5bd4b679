"""Queries of the usage and subscription family."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import usage as u
from studylake.plans.registry import query
from studylake.sources import derive as d
from studylake.sources import tables as t
from studylake.sources.derive import ctes
from studylake.sources.tables import table

LIMITS = "limits(tier, tier_rank, pdfs_per_month, max_pages, chapters_per_month, price) AS (VALUES ('free', 0, 1, 10, 0, 0), ('tier1', 1, -1, -1, -1, 17), ('tier2', 2, -1, -1, 100, 40))"
USERS = "users AS (SELECT c_custkey AS user_id FROM customer)"
TIERED = USERS + ", tiered AS (SELECT user_id, CASE WHEN status = 'active' THEN tier ELSE 'free' END AS tier FROM users LEFT JOIN subscriptions USING (user_id))"


def users(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))


def tiered(spark, sf):
    return u.user_tiers(users(spark, sf), d.subscriptions(spark, sf))


@query("""
    SELECT o_custkey AS user_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS BIGINT) AS pdfs_uploaded, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS chapters_generated, CAST(sum(n) AS BIGINT) AS pages_processed
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1, 2""", dates=("month",))
def use1_monthly_usage(spark, sf):
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pages"))
    done = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long")
    uploads = table(spark, sf, "orders").join(pages, "o_orderkey").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), "pages", done.alias("chapters"))
    return u.monthly_usage(uploads)


@query("SELECT o_orderkey AS order_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders", dates=("month",))
def use2_month_key(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), u.month_of(F.col("o_orderdate")).alias("month"))


@query(ctes("usage").rstrip() + ", " + USERS + """ SELECT user_id, coalesce(pdfs_uploaded, 0) AS pdfs_uploaded, coalesce(chapters_generated, 0) AS chapters_generated, coalesce(pages_processed, 0) AS pages_processed
    FROM users LEFT JOIN (SELECT * FROM usage WHERE month = DATE '1997-03-01') USING (user_id)""")
def use3_usage_of(spark, sf):
    return u.usage_of(users(spark, sf), d.usage(spark, sf), "1997-03-01")


@query(ctes("usage") + """SELECT month, CAST(count(*) AS BIGINT) AS users, CAST(sum(pdfs_uploaded) AS BIGINT) AS total_pdfs_uploaded, CAST(sum(chapters_generated) AS BIGINT) AS total_chapters_generated, CAST(sum(pages_processed) AS BIGINT) AS total_pages_processed,
    avg(pdfs_uploaded) AS avg_pdfs_uploaded, avg(chapters_generated) AS avg_chapters_generated, avg(pages_processed) AS avg_pages_processed FROM usage GROUP BY month""", dates=("month",))
def use4_usage_statistics(spark, sf):
    return u.usage_statistics(d.usage(spark, sf))


@query(ctes("usage") + """SELECT user_id, month, CASE WHEN hit THEN 0 ELSE pdfs_uploaded END AS pdfs_uploaded, CASE WHEN hit THEN 0 ELSE chapters_generated END AS chapters_generated, CASE WHEN hit THEN 0 ELSE pages_processed END AS pages_processed
    FROM (SELECT *, user_id % 5 = 0 AND month = DATE '1997-03-01' AS hit FROM usage)""", dates=("month",))
def use5_usage_reset(spark, sf):
    return u.usage_reset(d.usage(spark, sf), users(spark, sf).where("user_id % 5 = 0"), "1997-03-01")


@query(ctes("subscriptions").rstrip() + ", " + TIERED + " SELECT user_id, tier FROM tiered")
def sub1_user_tiers(spark, sf):
    return tiered(spark, sf)


@query(ctes("subscriptions").rstrip() + ", " + TIERED + ", " + LIMITS + " SELECT user_id, tier, CAST(pdfs_per_month AS BIGINT) AS pdfs_per_month, CAST(max_pages AS BIGINT) AS max_pages, CAST(chapters_per_month AS BIGINT) AS chapters_per_month FROM tiered JOIN limits USING (tier)")
def sub2_tier_limits(spark, sf):
    return tiered(spark, sf).join(F.broadcast(u.tiers(spark)), "tier").select("user_id", "tier", "pdfs_per_month", "max_pages", "chapters_per_month")


@query(ctes("subscriptions").rstrip() + ", " + TIERED + ", " + LIMITS + " SELECT user_id, tier FROM tiered JOIN limits USING (tier) WHERE tier_rank >= 1")
def sub3_allowed_from_tier1(spark, sf):
    return u.allowed_from(tiered(spark, sf), u.tiers(spark), "tier1")


@query(ctes("subscriptions", "usage").rstrip() + ", " + TIERED + ", " + LIMITS + """
    SELECT user_id, tier, user_id % 20 AS pages, user_id % 4 AS chapters, NOT (pdfs_per_month <> -1 AND coalesce(pdfs_uploaded, 0) >= pdfs_per_month) AS pdf_ok, NOT (tier = 'free' AND user_id % 20 > max_pages) AS page_ok,
        NOT (tier = 'tier2' AND coalesce(chapters_generated, 0) + 98 + user_id % 4 > chapters_per_month) AS chapter_ok
    FROM tiered JOIN limits USING (tier) LEFT JOIN (SELECT * FROM usage WHERE month = DATE '1997-03-01') USING (user_id)""")
def sub4_limit_decisions(spark, sf):
    used = u.usage_of(users(spark, sf), d.usage(spark, sf), "1997-03-01").join(tiered(spark, sf), "user_id")
    asked = used.withColumn("pages", F.col("user_id") % 20).withColumn("chapters", F.col("user_id") % 4).withColumn("chapters_generated", F.col("chapters_generated") + 98)
    return u.limit_decisions(asked, u.tiers(spark))


@query(ctes("subscriptions").rstrip() + ", " + TIERED + ", " + LIMITS + """
    SELECT o_orderkey AS upload_id, o_custkey AS user_id, tier, used, pdfs_per_month = -1 OR used < pdfs_per_month AS allowed
    FROM (SELECT *, CAST(count(*) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS used FROM orders) JOIN tiered ON user_id = o_custkey JOIN limits USING (tier)""")
def sub4_upload_audit(spark, sf):
    uploads = table(spark, sf, "orders").select(F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    return u.upload_audit(uploads, tiered(spark, sf), u.tiers(spark))


@query(ctes("subscriptions").rstrip() + ", " + USERS + """ SELECT user_id, tier, status, CAST(NULL AS DATE) AS period_end FROM subscriptions
    UNION ALL SELECT user_id, 'free', 'active', DATE '1999-01-01' FROM users WHERE user_id NOT IN (SELECT user_id FROM subscriptions)""", dates=("period_end",))
def sub5_default_subscriptions(spark, sf):
    return u.with_default_subscription(users(spark, sf), d.subscriptions(spark, sf), "1998-01-01")


@query(ctes("subscriptions").rstrip() + ", " + LIMITS + """ SELECT count(*) FILTER (WHERE tier = 'tier1') * 100.0 / count(*) AS tier1_conversion,
    count(*) FILTER (WHERE status = 'canceled' AND updated_on > DATE '1998-01-01' - 30) * 100.0 / nullif(count(*) FILTER (WHERE status = 'active'), 0) AS churn_rate, CAST(sum(CASE WHEN status = 'active' THEN price ELSE 0 END) AS BIGINT) AS mrr
    FROM subscriptions JOIN limits USING (tier)""")
def sub6_subscription_report(spark, sf):
    return u.subscription_report(d.subscriptions(spark, sf), u.tiers(spark), "1998-01-01")


@query("SELECT o_custkey AS user_id, arg_max(CASE o_orderkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'tier1' ELSE 'tier2' END, (o_orderdate, o_orderkey)) AS tier, CAST(count(*) AS BIGINT) AS changes FROM orders GROUP BY 1")
def sub7_latest_tier(spark, sf):
    k = F.col("o_orderkey")
    return u.latest_tier(table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), k.alias("change_id"), F.when(k % 3 == 0, "free").when(k % 3 == 1, "tier1").otherwise("tier2").alias("tier")))


def requests_sql(squeeze):
    return f"requests AS (SELECT user_id AS owner_id, CASE WHEN event_type IN ('view', 'click') THEN 'lesson' ELSE 'upload' END AS type, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / {1000 * squeeze}) AS BIGINT) AS ts_ms, event_id AS request_id FROM events)"


#: Few requests a minute in the test tables: small limits over squeezed time.
SMALL = {"lesson": 3, "upload": 2}


#: Requests one after the other, for all owners at once: held are the times of those admitted in the last 60 seconds.
ADMITTED = "WITH RECURSIVE " + requests_sql(1000) + """, r AS (SELECT *, CASE type WHEN 'lesson' THEN 3 ELSE 2 END AS most, row_number() OVER (PARTITION BY owner_id, type ORDER BY ts_ms, request_id) AS i FROM requests),
    admitted AS (SELECT owner_id, type, i, ts_ms, request_id, most, [ts_ms] AS held, true AS allowed FROM r WHERE i = 1
        UNION ALL SELECT owner_id, type, i, ts_ms, request_id, most, CASE WHEN len(held) < most THEN list_append(held, ts_ms) ELSE held END, len(held) < most
        FROM (SELECT r.*, list_filter(a.held, lambda x: x > r.ts_ms - 60000) AS held FROM admitted a JOIN r ON r.owner_id = a.owner_id AND r.type = a.type AND r.i = a.i + 1))"""


@query(ADMITTED + " SELECT owner_id, type, ts_ms, request_id, allowed, CASE WHEN allowed THEN most - len(held) ELSE 0 END AS remaining FROM admitted")
def lim1_rate_admission(spark, sf):
    return u.rate_admission(u.requests_of(table(spark, sf, "events"), 1000), SMALL)


@query("WITH " + requests_sql(1000) + """ SELECT owner_id, type, ts_ms, request_id, n AS count, greatest(0, CASE type WHEN 'lesson' THEN 3 ELSE 2 END - n) AS remaining
    FROM (SELECT *, CAST(count(*) OVER (PARTITION BY owner_id, type ORDER BY ts_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM requests)""")
def lim2_rate_status(spark, sf):
    return u.rate_status(u.requests_of(table(spark, sf, "events"), 1000), SMALL)


@query("WITH " + requests_sql(1000) + """ SELECT owner_id, request_id, minute, number, number <= 2 AS allowed
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id, minute ORDER BY ts_ms, request_id) AS INTEGER) AS number FROM (SELECT *, ts_ms // 60000 AS minute FROM requests))""")
def lim3_fixed_windows(spark, sf):
    return u.fixed_windows(u.requests_of(table(spark, sf, "events"), 1000), 2)


@query(ctes("usage") + """, delta AS (SELECT user_id, month, pdfs_uploaded * 2 AS pdfs_uploaded, chapters_generated, pages_processed FROM usage WHERE user_id % 3 = 0 UNION ALL SELECT user_id + 1000000, month, pdfs_uploaded, chapters_generated, pages_processed FROM usage WHERE user_id % 10 = 0)
    SELECT user_id, month, CAST(sum(pdfs_uploaded) AS BIGINT) AS pdfs_uploaded, CAST(sum(chapters_generated) AS BIGINT) AS chapters_generated, CAST(sum(pages_processed) AS BIGINT) AS pages_processed FROM (SELECT * FROM usage UNION ALL SELECT * FROM delta) GROUP BY 1, 2""", dates=("month",))
def snk3_additive_upsert(spark, sf):
    old = d.usage(spark, sf)
    more = old.where("user_id % 3 = 0").withColumn("pdfs_uploaded", F.col("pdfs_uploaded") * 2)
    delta = more.unionByName(old.where("user_id % 10 = 0").withColumn("user_id", F.col("user_id") + 1000000))
    return t.additive_upsert(old, delta, ["user_id", "month"], ["pdfs_uploaded", "chapters_generated", "pages_processed"])
