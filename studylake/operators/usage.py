"""Usage counters, subscriptions, limits and rate limits, for all users at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studylake.functions.text import micros
from studylake.sources.tables import stored

#: Limits of each tier (-1: none) with its rank and price a month.
TIERS = (("free", 0, 1, 10, 0, 0), ("tier1", 1, -1, -1, -1, 17), ("tier2", 2, -1, -1, 100, 40))
#: Requests a minute of each kind of job.
RATE_LIMITS = {"lesson": 100, "upload": 50}
WINDOW_MS = 60_000


def tiers(spark: SparkSession) -> DataFrame:
    """Three rows: tier, rank, pdfs_per_month, max_pages, chapters_per_month, price."""
    return spark.createDataFrame(list(TIERS), "tier string, tier_rank int, pdfs_per_month long, max_pages long, chapters_per_month long, price int")


def month_of(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def monthly_usage(uploads: DataFrame) -> DataFrame:
    """Counters of each user and month from (user_id, ts, pages, chapters): a PDF a row with pages, chapters as given."""
    return uploads.groupBy("user_id", month_of(F.col("ts")).alias("month")).agg(F.count("pages").alias("pdfs_uploaded"), F.sum(F.coalesce("chapters", F.lit(0))).alias("chapters_generated"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages_processed"))


def usage_of(users: DataFrame, usage: DataFrame, month: str) -> DataFrame:
    """Every user's counters in a month, zero without any."""
    now = usage.where(F.col("month") == F.lit(month).cast("date")).drop("month")
    return users.select("user_id").join(now, "user_id", "left").fillna(0)


def usage_statistics(usage: DataFrame) -> DataFrame:
    """Users, sums and averages of each month."""
    counters = ("pdfs_uploaded", "chapters_generated", "pages_processed")
    return usage.groupBy("month").agg(F.count("*").alias("users"), *[F.sum(c).alias(f"total_{c}") for c in counters], *[F.avg(c).alias(f"avg_{c}") for c in counters])


def usage_reset(usage: DataFrame, users: DataFrame, month: str) -> DataFrame:
    """usage with the counters of the users given set to zero in a month."""
    hit = users.select("user_id").distinct().withColumn("__reset", F.lit(True))
    zero = F.coalesce("__reset", F.lit(False)) & (F.col("month") == F.lit(month).cast("date"))
    j = usage.join(hit, "user_id", "left")
    return j.select("user_id", "month", *[F.when(zero, 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("pdfs_uploaded", "chapters_generated", "pages_processed")])


def user_tiers(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every user's tier; free without an active subscription."""
    j = users.select("user_id").join(subscriptions.select("user_id", "tier", "status"), "user_id", "left")
    return j.select("user_id", F.when(F.col("status") == "active", F.col("tier")).otherwise("free").alias("tier"))


def allowed_from(users: DataFrame, limits: DataFrame, least: str) -> DataFrame:
    """Users whose tier ranks at least as high as the tier given."""
    need = {t[0]: t[1] for t in TIERS}[least]
    return users.join(limits, "tier").where(F.col("tier_rank") >= need).select("user_id", "tier")


def limit_decisions(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """requests (user_id, tier, pdfs_uploaded, chapters_generated, pages, chapters) with pdf_ok, page_ok and chapter_ok."""
    j = requests.join(F.broadcast(limits), "tier")  # three rows
    pdf = (F.col("pdfs_per_month") != -1) & (F.col("pdfs_uploaded") >= F.col("pdfs_per_month"))
    page = (F.col("tier") == "free") & (F.col("max_pages") != -1) & (F.col("pages") > F.col("max_pages"))
    chapter = (F.col("tier") == "tier2") & (F.col("chapters_per_month") != -1) & (F.col("chapters_generated") + F.col("chapters") > F.col("chapters_per_month"))
    return j.select("user_id", "tier", "pages", "chapters", (~pdf).alias("pdf_ok"), (~page).alias("page_ok"), (~chapter).alias("chapter_ok"))


def upload_audit(uploads: DataFrame, users: DataFrame, limits: DataFrame) -> DataFrame:
    """Each upload with the user's uploads of the month before it and whether the limit of PDFs allowed it."""
    before = Window.partitionBy("user_id", month_of(F.col("ts"))).orderBy("ts", "upload_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = uploads.withColumn("used", F.count("*").over(before)).join(users, "user_id").join(F.broadcast(limits), "tier")  # three rows
    return rows.select("upload_id", "user_id", "tier", "used", ((F.col("pdfs_per_month") == -1) | (F.col("used") < F.col("pdfs_per_month"))).alias("allowed"))


def with_default_subscription(users: DataFrame, subscriptions: DataFrame, today: str) -> DataFrame:
    """Subscriptions with a free one for a year for each user who has none."""
    new = users.select("user_id").distinct().join(subscriptions, "user_id", "left_anti")
    start = F.lit(today).cast("date")
    new = new.select("user_id", F.lit("free").alias("tier"), F.lit("active").alias("status"), F.add_months(start, 12).alias("period_end"))
    return subscriptions.select("user_id", "tier", "status", F.lit(None).cast("date").alias("period_end")).unionByName(new)


def subscription_report(subscriptions: DataFrame, limits: DataFrame, today: str) -> DataFrame:
    """One row: share of tier1, cancellations of 30 days against active ones, revenue a month; null for a zero divisor."""
    j = subscriptions.join(F.broadcast(limits.select("tier", "price")), "tier")  # three rows
    late = (F.col("status") == "canceled") & (F.col("updated_on") > F.date_sub(F.lit(today).cast("date"), 30))
    active = F.count_if(F.col("status") == "active")
    return j.agg((F.count_if(F.col("tier") == "tier1") * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("tier1_conversion"), (F.count_if(late) * 100.0 / F.nullif(active, F.lit(0))).alias("churn_rate"), F.sum(F.when(F.col("status") == "active", F.col("price")).otherwise(0)).cast("long").alias("mrr"))


def latest_tier(changes: DataFrame) -> DataFrame:
    """The last tier of each user in (user_id, ts, change_id, tier); an upgrade made the status active, a downgrade kept it."""
    return changes.groupBy("user_id").agg(F.max_by("tier", F.struct("ts", "change_id")).alias("tier"), F.count("*").alias("changes"))


def _limit(limits: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("type")), F.lit(min(limits.values())))


def with_bursts(requests: DataFrame) -> DataFrame:
    """requests with burst: it changes where an owner made no request of a type for a window's length, as nothing before counts
    after that. Only the first and last request of each minute meet in an owner's window, so a busy owner is no large group."""
    minute = F.floor(F.col("ts_ms") / WINDOW_MS)
    ends = requests.groupBy("owner_id", "type", minute.alias("minute")).agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    order = Window.partitionBy("owner_id", "type").orderBy("minute")
    apart = F.coalesce(F.col("first") - F.lag("last").over(order) >= WINDOW_MS, F.lit(True)).cast("int")
    numbered = ends.withColumn("apart", apart).select("owner_id", "type", "minute", F.sum("apart").over(order).alias("burst"))
    return requests.withColumn("minute", minute).join(numbered, ["owner_id", "type", "minute"]).drop("minute")


def rate_status(requests: DataFrame, limits: dict[str, int] = RATE_LIMITS, group: tuple[str, ...] = ("owner_id", "type")) -> DataFrame:
    """Each request (owner_id, type, ts_ms, request_id) with those of the last 60 seconds, itself included, and what remains."""
    last = Window.partitionBy(*group).orderBy("ts_ms").rangeBetween(-(WINDOW_MS - 1), 0)
    return requests.withColumn("count", F.count("*").over(last)).withColumn("remaining", F.greatest(F.lit(0), _limit(limits) - F.col("count")).cast("long"))


def admit(held: deque, t: int, limit: int) -> bool:
    """Greedy admission of a request at a time not before those held; only allowed ones fill the window."""
    while held and held[0] <= t - WINDOW_MS:
        held.popleft()
    if len(held) < limit:
        held.append(t)
        return True
    return False


def rate_admission(requests: DataFrame, limits: dict[str, int] = RATE_LIMITS, slice_rows: int = 50_000) -> DataFrame:
    """Each request with allowed and remaining under the sliding window.

    Requests are met burst by burst (with_bursts). A burst that never fills the window (rate_status) is admitted
    throughout by plain windows. Others are cut into slices of about slice_rows requests, whole minutes each, that are
    admitted in parallel (slice_starts); a slice's requests stream in order through the sequential rule, which holds no more
    than the window.
    """
    group = ("owner_id", "type", "burst")
    status = rate_status(with_bursts(requests), limits, group)
    marked = status.withColumn("limit", _limit(limits)).withColumn("most", F.max("count").over(Window.partitionBy(*group)))
    now = Window.partitionBy(*group, "ts_ms")
    left = F.col("limit") - F.row_number().over(now.orderBy("request_id")) - (F.col("count") - F.count("*").over(now))
    calm = marked.where("most <= limit").select("owner_id", "type", "ts_ms", "request_id", F.lit(True).alias("allowed"), left.cast("long").alias("remaining"))
    busy = with_slices(marked.where("most > limit").select(*group, "ts_ms", "request_id", "limit"), slice_rows)
    if busy.where("slice > 0").isEmpty():
        starts = None
    else:
        busy = stored(busy, "busy-requests")
        starts = slice_starts(busy)
    admitted = _folded(busy, starts, 1, _admissions, "owner_id long, type string, ts_ms long, request_id long, allowed boolean, remaining long")
    return calm.unionByName(admitted)


def with_slices(busy: DataFrame, slice_rows: int) -> DataFrame:
    """busy with slice, the number of the minutes that make about slice_rows requests of a burst; only counts of minutes meet in
    one window."""
    group, minute = ["owner_id", "type", "burst"], F.floor(F.col("ts_ms") / WINDOW_MS)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = busy.groupBy(*group, minute.alias("minute")).agg(F.count("*").alias("n")).select(*group, "minute", F.floor(before / slice_rows).cast("int").alias("slice"))
    return busy.withColumn("minute", minute).join(minutes, [*group, "minute"]).drop("minute")


SLICE = "owner_id long, type string, burst long, slice int, first_ms long, start array<long>, end array<long>"


def slice_starts(busy: DataFrame) -> DataFrame:
    """(owner_id, type, burst, slice, start): the admitted times that fill the window when a slice begins.

    All slices are folded at once from an empty window. Then each gets the last window of the one before, and only those
    for which that is another window than they began with are folded again, until none is. With each round a task goes
    on through twice as many consecutive slices, so that where windows never meet again the rounds are the logarithm of the
    slices; where they do, as after any lull, two or three rounds are all.
    """
    key, size = ["owner_id", "type", "burst", "slice"], 1
    states = stored(_folded(busy, None, 1, _states, SLICE), "slice-states")
    while True:
        handed = F.lag("end").over(Window.partitionBy(*key[:3]).orderBy("slice"))
        wanted = F.filter(F.coalesce(handed, F.array().cast("array<long>")), lambda t: t > F.col("first_ms") - WINDOW_MS)
        wrong = states.withColumn("wanted", wanted).where("wanted <> start").withColumn("run", F.floor(F.col("slice") / size).cast("int"))
        firsts = wrong.groupBy(*key[:3], "run").agg(F.min_by(F.struct("slice", "wanted"), "slice").alias("x")).select(*key[:3], "run", F.col("x.slice").alias("slice"), F.col("x.wanted").alias("start"))
        if firsts.isEmpty():
            return states.select(*key, "start")
        firsts = stored(firsts, "slice-starts")
        again = busy.withColumn("run", F.floor(F.col("slice") / size).cast("int")).join(firsts.select(*key[:3], "run", F.col("slice").alias("least")), [*key[:3], "run"]).where("slice >= least")
        new = stored(_folded(again.drop("run", "least"), firsts.drop("run"), size, _states, SLICE), "slice-states")
        states = stored(states.join(new.select(*key), key, "left_anti").unionByName(new), "slice-states")
        size *= 2


def _folded(busy: DataFrame, starts: DataFrame | None, size: int, fold, out: str) -> DataFrame:
    """fold over the requests of runs of `size` slices, each run in order with its start, if it has one, in front."""
    run = F.floor(F.col("slice") / size).cast("int")
    rows = busy.select("owner_id", "type", "burst", "slice", F.lit(1).alias("side"), "ts_ms", "request_id", "limit", F.lit(None).cast("array<long>").alias("start"))
    if starts is not None:
        rows = rows.unionByName(starts.withColumns({"side": F.lit(0), "ts_ms": F.lit(-1).cast("long"), "request_id": F.lit(-1).cast("long"), "limit": F.lit(0)}))
    placed = rows.withColumn("run", run).repartition("owner_id", "type", "burst", "run")
    return placed.sortWithinPartitions("owner_id", "type", "burst", "run", "slice", "side", "ts_ms", "request_id").mapInPandas(fold, out)


def _turns(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """(row, window, whether a slice begins): the window that a request finds."""
    key, at, held = None, None, deque()
    for b in batches:
        for r in b.itertuples(index=False):
            now = (r.owner_id, r.type, r.burst, r.run)
            if now != key:
                key, at, held = now, None, deque()
            if r.side == 0:
                held = deque(int(t) for t in r.start)
                continue
            while held and held[0] <= r.ts_ms - WINDOW_MS:
                held.popleft()
            yield r, held, at != r.slice
            at = r.slice
        yield None, None, False


def _admissions(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for r, held, _ in _turns(batches):
        if r is None:
            yield pd.DataFrame(out, columns=["owner_id", "type", "ts_ms", "request_id", "allowed", "remaining"])
            out = []
            continue
        allowed = admit(held, int(r.ts_ms), r.limit)
        out.append((r.owner_id, r.type, r.ts_ms, r.request_id, allowed, r.limit - len(held) if allowed else 0))


def _states(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, now, last = [c.split()[0] for c in SLICE.split(", ")], None, None
    for r, held, begins in _turns(batches):
        if r is None:
            continue
        if begins:
            if now is not None:
                yield pd.DataFrame([(*now, [int(t) for t in last])], columns=names)
            now = r.owner_id, r.type, r.burst, r.slice, r.ts_ms, [int(t) for t in held]
        admit(held, int(r.ts_ms), r.limit)
        last = held
    if now is not None:
        yield pd.DataFrame([(*now, [int(t) for t in last])], columns=names)


def fixed_windows(requests: DataFrame, limit: int = 100) -> DataFrame:
    """Requests numbered in their minute (from the epoch) with whether they are over the limit."""
    minute = F.floor(F.col("ts_ms") / WINDOW_MS)
    order = Window.partitionBy("owner_id", minute).orderBy("ts_ms", "request_id")
    return requests.select("owner_id", "request_id", minute.alias("minute"), F.row_number().over(order).alias("number")).withColumn("allowed", F.col("number") <= limit)


def requests_of(events: DataFrame, squeeze: int = 1) -> DataFrame:
    """Events as job requests; squeeze divides the time since 2024 to make them denser."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ms = F.floor((micros(F.col("ts")) - F.unix_micros(start)) / (1000 * squeeze))
    kind = F.when(F.col("event_type").isin("view", "click"), "lesson").otherwise("upload")
    return events.select(F.col("user_id").alias("owner_id"), kind.alias("type"), ms.alias("ts_ms"), F.col("event_id").alias("request_id"))
