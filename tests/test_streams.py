"""Streams over several micro-batches: carried state, expiry, repeated batches; the listing of stored objects."""

import os
import time
from datetime import datetime, timedelta
from functools import partial

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from studylake.plans import streams as plans
from studylake.sources import tables, versions
from studylake.streaming import streams as st

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith("str") or n == "snk3_streamed_upsert")


@pytest.fixture(scope="module")
def split(tmp_path_factory):
    """The events in five files in the order of time, each one a micro-batch."""
    folder = tmp_path_factory.mktemp("split")
    os.mkdir(folder / "events.parquet")
    events = pd.read_parquet(f"{SMALL}/events.parquet").sort_values(["ts", "event_id"])
    for i in range(5):
        part = events.iloc[i * len(events) // 5 : (i + 1) * len(events) // 5]
        part.astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet" / f"part-{i}.parquet", index=False)
        os.utime(folder / "events.parquet" / f"part-{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    return str(folder)


def texts(df):
    return sorted(tuple(str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_many_micro_batches_reach_the_same_rows(spark, split, name, monkeypatch):
    monkeypatch.setattr(plans, "stream", partial(plans.stream, files=1))
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    got = __spark_entry__.queries()[name](spark, split).toPandas()
    assert texts(got) == texts(duck.execute(__spark_entry__.oracle_sql()[name]).df())


def batches(spark, folder, rows, schema):
    """A stream whose micro-batches are the lists of rows."""
    for i, part in enumerate(rows):
        path = f"{folder}/in/part-{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in")


DAY = timedelta(days=1)
START = datetime(2024, 1, 1)


def test_jobs_without_updates_are_forgotten(spark, tmp_path):
    rows = [[(1, START, 1, "queued", 5)], [(2, START + 30 * DAY, 2, "queued", 0)], [(2, START + 31 * DAY, 3, "done", 300)], [(1, START + 32 * DAY, 4, "again", 7), (2, START + 31 * DAY, 2, "late", 9)]]
    jobs = st.job_states(batches(spark, tmp_path, rows, "job_id long, ts timestamp, update_id long, status string, progress long"))
    got = plans.drained(spark, jobs, "update")
    last = {r["job_id"]: r["x"] for r in got.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "started_at"), "batch_id").alias("x")).collect()}
    assert tuple(last[2]) == ("done", 100, START + 30 * DAY)
    assert tuple(last[1]) == ("again", 7, START + 32 * DAY)


def session(number, day, kind, right=True):
    return (number, START + day * DAY, day * 86_400_000, kind, right)


SESSIONS = [[session(1, 0, "track"), session(2, 0, "track"), session(2, 1, "complete")], [session(3, 30, "track")], [session(3, 31, "track", False)], [session(1, 32, "complete"), session(3, 32, "complete"), session(3, 33, "complete")]]
SESSION = "session_id long, ts timestamp, ts_ms long, kind string, was_correct boolean"


def test_abandoned_sessions_are_forgotten(spark, tmp_path):
    done = st.completed_sessions(batches(spark, tmp_path, SESSIONS, SESSION))
    got = sorted(tuple(r) for r in plans.drained(spark, done).collect())
    ms = 86_400_000
    assert got == [(1, 32 * ms, 32 * ms, 0, 0), (2, 0, ms, 1, 1), (3, 30 * ms, 32 * ms, 2, 1)]


def test_abandoned_sessions_are_given_out(spark, tmp_path):
    left = st.abandoned_sessions(batches(spark, tmp_path, SESSIONS, SESSION))
    assert [tuple(r) for r in plans.drained(spark, left).collect()] == [(1, 0, 0, 1, 1)]


def ended(spark, folder, rows, buckets):
    """What ended_sessions gives out, and the most rows that its state had."""
    stream = st.ended_sessions(batches(spark, folder, rows, SESSION), buckets=buckets)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/rows").start()
    query.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    return sorted(map(str, map(tuple, spark.read.schema(stream.schema).parquet(f"{folder}/rows").collect()))), held


def at(number, day, kind, right=True):
    """A row whose time in milliseconds is that of its timestamp."""
    return (number, START + day * DAY, millis(day), kind, right)


def millis(day):
    return int((START + day * DAY).timestamp()) * 1000


def test_sessions_are_held_by_bucket(spark, tmp_path):
    """State is read and written for each bucket, not for each session."""
    rows = [[at(i, d, "track", i % 3 > 0) for i in range(500) for d in (0, 1)], [at(i, 2, "complete") for i in range(0, 500, 5)], [at(500, 20, "track")], [at(501, 20, "track")]]
    got, held = ended(spark, tmp_path, rows, 4)
    want = [(i, "completed", millis(0), millis(2), 2, 2 * (i % 3 > 0)) if i % 5 == 0 else (i, "abandoned", millis(0), millis(1), 2, 2 * (i % 3 > 0)) for i in range(500)]
    assert got == sorted(map(str, want))
    assert held == 4


@pytest.mark.parametrize("buckets", [1, 7])
def test_sessions_of_a_bucket_end_by_themselves(spark, tmp_path, buckets):
    """Idle sessions of a bucket end at their time, to the millisecond, also where others of it get rows; a check-in at the time of
    the completion is not before it; rows without an id are a session, those without a time are in none."""
    rows = [
        [at(1, 0, "track"), at(2, 0, "track"), at(2, 0, "complete"), at(None, 0, "track", None), (4, None, None, "track", True), at(5, 0, "start")],
        [at(3, 8, "track")],
        [at(3, 9, "track", False), at(5, 8, "track")],
        [at(1, 9, "complete"), at(6, 9, "track")],
        [at(5, 10, "complete"), at(2, 9, "complete")],
    ]
    want = [(1, "abandoned", 0, 0, 1, 1), (2, "completed", 0, 0, 0, 0), (None, "abandoned", 0, 0, 1, 0), (1, "completed", 9, 9, 0, 0), (5, "completed", 0, 10, 1, 1), (2, "completed", 9, 9, 0, 0)]
    assert ended(spark, tmp_path, rows, buckets)[0] == sorted(str((i, how, millis(a), millis(b), *n)) for i, how, a, b, *n in want)


@pytest.mark.parametrize(("name", "rows"), [
    ("str7_abandoned_sessions", [("2024-01-01 10:00", 1, "view", 40.0), ("2024-01-01 10:00", 2, "purchase", 10.0), ("2024-01-01 11:00", None, "view", 50.0), ("2024-01-01 12:00", None, "view", None), ("2024-01-01 09:00", 3, None, 30.0), ("2024-01-01 09:30", 3, "view", 1.0), ("2024-02-20 00:00", 3, "view", 1.0)]),
    ("str7_completed_sessions", [("2024-01-01 10:00", 1, "view", 40.0), ("2024-01-01 10:00", 1, "purchase", 10.0), ("2024-01-01 11:00", None, "view", 50.0), ("2024-01-01 12:00", None, "purchase", 1.0), (None, 2, "view", 40.0), ("2024-01-01 09:00", 2, "view", 30.0), ("2024-01-01 09:30", 2, "view", None), ("2024-01-01 10:00", 2, "purchase", 30.0)]),
])
def test_sessions_of_odd_events_as_in_sql(spark, tmp_path, name, rows):
    """Check-ins at the time of a completion, events without a user, a time, a type or a value."""
    events = pd.DataFrame(rows, columns=["ts", "user_id", "event_type", "value"]).astype({"user_id": "Int64"})
    events["ts"] = pd.to_datetime(events["ts"]).astype("datetime64[us]")
    events.assign(event_id=range(len(events)), props="{}").to_parquet(f"{tmp_path}/events.parquet", index=False)
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duck.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in duck.description]
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert len(want) > 1 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


USAGE = "user_id long, month date, pdfs_uploaded long, pages_processed long"


def test_a_repeated_batch_leaves_the_same_usage(spark, tmp_path):
    month = START.date()
    write = st.upsert_usage(f"{tmp_path}/usage")
    write(spark.createDataFrame([(1, month, 2, 10), (2, month, 1, 4)], USAGE), 0)
    for _ in range(2):
        write(spark.createDataFrame([(1, month, 3, 17)], USAGE), 1)
    got = versions.snapshot(spark, f"{tmp_path}/usage").collect()
    assert sorted(tuple(r) for r in got) == [(1, month, 3, 17), (2, month, 1, 4)]
    assert versions.snapshot(spark, f"{tmp_path}/none") is None


def test_upserts_stay_bounded_and_readers_keep_their_snapshot(spark, tmp_path):
    month, path, want = START.date(), f"{tmp_path}/usage", {}
    write = st.upsert_usage(path, deltas=3)
    held = None
    for batch in range(14):
        rows = [(batch % 5, month, batch, 2 * batch), (None, month, batch, 1)]
        write(spark.createDataFrame(rows, USAGE), batch)
        want |= {r[0]: r for r in rows}
        if held is not None:  # a reader of the version before still reads it whole
            assert sorted(tuple(r) for r in held[0].where("user_id IS NOT NULL").collect()) == held[1]
        held = versions.snapshot(spark, path), sorted(r for u, r in want.items() if u is not None)
        assert len(os.listdir(f"{path}/data")) <= 5
        assert len([n for n in os.listdir(f"{path}/manifests") if n.endswith(".json")]) <= 2
    assert {r["user_id"]: tuple(r) for r in held[0].collect()} == want
    # Of two writers that saw the same version one is refused.
    last = versions.manifests(spark, path)[-1]
    versions.commit(spark, path, last | {"number": last["number"] + 1})
    with pytest.raises(RuntimeError, match="another writer"):
        versions.commit(spark, path, last | {"number": last["number"] + 1})


def test_inserts_of_several_writers(spark, tmp_path, monkeypatch):
    path, kind = f"{tmp_path}/lessons", "owner long, section long, id long"
    put = lambda rows: versions.insert(spark.createDataFrame(rows, kind), path, ["owner", "section"], ["id"])
    assert put([(1, 1, 9), (1, 1, 7), (None, 2, 3)]) == 2
    assert put([(1, 1, 1), (1, 2, 5), (None, 2, 1)]) == 1
    real, lost = versions.manifests, []

    def slow(session, at):  # another writer is first between this one's reading and its commit
        found = real(session, at)
        if not lost:
            lost.append(1)
            assert put([(2, 2, 2)]) == 1
        return found

    monkeypatch.setattr(versions, "manifests", slow)
    assert put([(2, 2, 8), (3, 3, 3)]) == 1
    monkeypatch.undo()
    assert sorted((r["owner"] or 0, r["section"], r["id"]) for r in versions.snapshot(spark, path).collect()) == [(0, 2, 3), (1, 1, 7), (1, 2, 5), (2, 2, 2), (3, 3, 3)]


def test_late_rows_and_the_stream_make_the_batch(spark, tmp_path):
    """A stream of hourly counts drops late rows; with the side table it reaches what the batch counts."""
    minute = timedelta(minutes=1)
    rows = [[(1, START), (2, START)], [(1, START + 200 * minute), (2, START + 1 * minute)], [(1, START + 5 * minute), (2, START + 201 * minute), (1, START + 150 * minute)], [(2, START + 2 * minute), (1, START + 500 * minute)]]
    source = batches(spark, tmp_path, rows, "user_id long, ts timestamp")

    def on_time(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/on-time/batch_id={batch_id}")

    write = st.late_apart(f"{tmp_path}/out", on_time, 60 * 60_000)
    twice = lambda b, i: (write(b, i), write(b, i) if i == 2 else None)  # noqa: E731  a batch that comes again
    source.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(twice).start().awaitTermination()
    marks = {r["batch_id"]: r["late_rows"] for r in st.late_marks(spark, f"{tmp_path}/out").collect()}
    assert marks == {0: 0, 1: 0, 2: 1, 3: 1}
    count = lambda df: df.groupBy("user_id", F.window("ts", "60 seconds").start.alias("minute")).agg(F.count("*").alias("requests"))
    kind = "user_id long, ts timestamp"
    live, late = spark.read.schema(kind).parquet(f"{tmp_path}/on-time"), spark.read.schema(kind).parquet(f"{tmp_path}/out/late")
    assert late.count() == 2
    merged = count(live).unionByName(count(late)).groupBy("user_id", "minute").agg(F.sum("requests").alias("requests"))
    want = count(spark.createDataFrame([r for part in rows for r in part], kind))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.collect()))


def test_state_is_in_rocksdb_and_lists_go_with_time(spark, tmp_path):
    rows = [[(1, "lesson", 0, 1), (1, "lesson", 1, 2)], [(1, "lesson", 2, 3), (1, "lesson", 60_000, 4)]]
    source = batches(spark, tmp_path, rows, "owner_id long, type string, ts_ms long, request_id long")
    # With lists that expire by the clock a stream goes on without new rows, so it is stopped here.
    stream = st.rate_admission(source, {"lesson": 2})
    query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").format("memory").queryName("admitted").outputMode("append").start()
    try:
        end = time.time() + 120
        while spark.table("admitted").count() < 4 and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == st.ROCKSDB
    assert {r["request_id"]: r["allowed"] for r in spark.table("admitted").collect()} == {1: True, 2: True, 3: False, 4: True}


def test_listing_of_stored_objects(spark):
    got = {r["key"]: r["size_bytes"] for r in __spark_entry__.queries()["src4_stored_objects"](spark, SMALL).collect()}
    assert got == {n: os.path.getsize(f"{SMALL}/{n}") for n in os.listdir(SMALL)}


def test_documents_in_as_many_files_as_they_ask_for(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("# "), F.col("id").cast("string")).alias("markdown"))
    tables.write_documents(docs, f"{tmp_path}/docs", buckets=4, rows_a_file=50)
    files = [f for _, _, names in os.walk(f"{tmp_path}/docs") for f in names if f.endswith(".parquet")]
    back = spark.read.parquet(f"{tmp_path}/docs")
    assert 12 <= len(files) <= 24 and back.count() == 1000 and back.where("markdown <> '# ' || doc_id").count() == 0
