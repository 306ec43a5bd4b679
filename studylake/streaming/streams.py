"""Structured Streaming forms of the event flows. Each has a batch twin whose result it reaches on the same rows.

Flows with rules of their own are stateful processors with typed state in RocksDB, on the executors' disks and in the
checkpoint: a key's rows come as an iterator of frames, of which only the columns that a rule needs are held. Event time
decides: rows later than the watermark are left out of a stream; late_apart writes them to a side table and counts them, so
that the batch twin can make them good.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from studylake.operators.usage import RATE_LIMITS, WINDOW_MS, admit
from studylake.sources import versions

STATE_OUT = "owner_id long, concept_id long, event_id long, was_correct boolean, total_attempts long, correct_attempts long, consecutive_correct long, old_state string, new_state string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of an output frame.
SLICE = 10_000


def stateful(rows: DataFrame, group: list[str], processor: StatefulProcessor, out: str, mode: str, time: str = "none") -> DataFrame:
    """rows with a processor for each key. State stores of the session are RocksDB from here on, as typed state needs."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*group).transformWithStateInPandas(processor, out, mode, time)


def in_order(rows: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> list[np.ndarray]:
    """The columns of a key's rows in an order, taken from the frames one after the other."""
    parts = [[b[c].to_numpy() for c in dict.fromkeys([*columns, *order])] for b in rows if len(b)]
    whole = dict(zip(dict.fromkeys([*columns, *order]), map(np.concatenate, zip(*parts, strict=True)), strict=True)) if parts else {}
    if not whole:
        return [np.zeros(0) for _ in columns]
    at = np.lexsort([whole[c] for c in reversed(order)])
    return [whole[c][at] for c in columns]


def frames(rows: list[tuple], columns: str) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in columns.split(", ")]
    for i in range(0, len(rows), SLICE):
        yield pd.DataFrame(rows[i : i + SLICE], columns=names)


def next_state(total: int, correct: int, streak: int, old: str) -> str:
    """State after an answer, from the counters after it and the state before."""
    share = 100.0 * correct / total
    if streak >= 2 or (share >= 75 and total >= 3):
        return "mastered"
    if (share >= 50 and total >= 2) or streak >= 1:
        return "understood"
    return "needs_review" if old in ("understood", "mastered") else "introduced"


def live_mastery(attempts: DataFrame) -> DataFrame:
    """Old and new state of each answer of a stream (owner_id, concept_id, event_id, ts, was_correct).

    Within a micro-batch answers are taken in the order (ts, event_id); the counters of each owner's concept are the state.
    """

    return stateful(attempts, ["owner_id", "concept_id"], Mastery(), STATE_OUT, "append")


class Mastery(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "total long, correct long, streak long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, correct, streak, now = self.counts.get() if self.counts.exists() else (0, 0, 0, "not_learned")
        out = []
        for event, right in zip(*in_order(rows, ["event_id", "was_correct"], ["ts", "event_id"]), strict=True):
            total, correct, streak, old = total + 1, correct + int(right), streak + 1 if right else 0, now
            now = next_state(total, correct, streak, old)
            out.append((*key, event, bool(right), total, correct, streak, old, now))
        self.counts.update((total, correct, streak, now))
        yield from frames(out, STATE_OUT)

    def close(self) -> None:
        pass


def usage_counters(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """Monthly counters of a stream (user_id, ts, pages), for update mode with an additive or replacing sink."""
    return uploads.withWatermark("ts", delay).groupBy("user_id", F.trunc("ts", "MM").alias("month")).agg(F.count("*").alias("pdfs_uploaded"), F.sum("pages").alias("pages_processed"))


ADMITTED = "owner_id long, type string, ts_ms long, request_id long, allowed boolean"


def rate_admission(requests: DataFrame, limits: dict[str, int] = RATE_LIMITS, expire: bool = True) -> DataFrame:
    """Admission of a stream (owner_id, type, ts_ms, request_id) under the sliding window. The times that fill an owner's window
    are a list in the state; they go by themselves after twice the window, unless expire is false, as for a stream that is
    only run over what there is."""
    return stateful(requests, ["owner_id", "type"], Admission(limits, expire), ADMITTED, "append", "processingTime" if expire else "none")


class Admission(StatefulProcessor):
    def __init__(self, limits: dict[str, int], expire: bool):
        self.limits, self.ttl = limits, 2 * WINDOW_MS if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "ts_ms long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = deque(t for (t,) in self.times.get()) if self.times.exists() else deque()
        limit, out = self.limits.get(key[1], min(self.limits.values())), []
        for t, request in zip(*in_order(rows, ["ts_ms", "request_id"], ["ts_ms", "request_id"]), strict=True):
            out.append((*key, int(t), int(request), admit(held, int(t), limit)))
        if held:
            self.times.put([(t,) for t in held])
        yield from frames(out, ADMITTED)

    def close(self) -> None:
        pass


def minute_counts(requests: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Requests of each user and minute of a stream (user_id, ts)."""
    return requests.withWatermark("ts", delay).groupBy("user_id", F.window("ts", "60 seconds")).agg(F.count("*").alias("requests")).select("user_id", F.col("window.start").alias("minute"), "requests")


def unique_events(events: DataFrame, key: str = "event_id", delay: str = "1 day") -> DataFrame:
    """A stream with each event once within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


class Forgetful(StatefulProcessor):
    """A processor whose key goes when event time is idle_ms past its last event: one timer a key stands at that time, or just
    after the watermark where that is already later."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def remind(self, last_ms: int, timerValues) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(last_ms + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


JOB_OUT = "job_id long, status string, progress long, started_us long, updated_us long"


class Jobs(Forgetful):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "us long, update_id long, status string, progress long, started long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *last, started = self.job.get() if self.job.exists() else (None, None, None, None, None)
        for b in rows:
            micros = b["ts"].astype("datetime64[us]").astype("int64")
            i = int(np.lexsort((b["update_id"], micros))[-1])
            new = [int(micros.iloc[i]), int(b["update_id"].iloc[i]), b["status"].iloc[i], int(b["progress"].iloc[i])]
            last = new if last[0] is None else max(last, new, key=lambda x: x[:2])
            started = int(micros.min()) if started is None else min(started, int(micros.min()))
        self.job.update((*last, started))
        self.remind(last[0] // 1000, timerValues)
        yield from frames([(key[0], last[2], min(100, max(0, last[3])), started, last[0])], JOB_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        return iter(())


def job_states(updates: DataFrame, delay: str = "1 day", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """Latest state of each job of a stream (job_id, ts, update_id, status, progress), for update mode: a row for each job that
    a micro-batch touches. A job without updates for idle_ms of event time is forgotten."""
    j = stateful(updates.withWatermark("ts", delay), ["job_id"], Jobs(idle_ms), JOB_OUT, "update", "eventTime")
    return j.select("job_id", "status", "progress", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("updated_us").alias("updated_at"))


SESSION_OUT = "session_id long, how string, started_ms long, ended_ms long, check_ins long, correct long"
#: Steps of a session. Of those at one time a completion comes first: what is not before it doesn't count.
COMPLETE, RIGHT, WRONG, OTHER = range(4)
#: Bucket of the rows without a session's id.
NO_ID = -1
LAST_MS = np.iinfo(np.int64).max
#: What is held of a session, and a bucket's sessions as state: an array of each column, and the time of the bucket's timer.
SESSION = np.dtype([("session_id", "i8"), ("start", "i8"), ("n", "i8"), ("correct", "i8"), ("last", "i8"), ("due", "i8"), ("done", "?")])
BUCKET = "timer long, session_id array<long>, start array<long>, n array<long>, correct array<long>, last array<long>, due array<long>, done array<boolean>"


class Sessions(StatefulProcessor):
    """The sessions of a bucket, all at once: Python and the state store are called for each bucket, not for each session. A
    session is due when event time is idle_ms past its last event, or just after the watermark where that is already later; a
    bucket's one timer stands at the time when the first of its sessions is due."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET)

    def held(self) -> tuple[int | None, np.ndarray]:
        """The bucket's timer, if it has sessions, and these in the order of their ids."""
        if not self.bucket.exists():
            return None, np.zeros(0, SESSION)
        timer, *columns = self.bucket.get()
        sessions = np.zeros(len(columns[0]), SESSION)
        for c, values in zip(SESSION.names, columns, strict=True):
            sessions[c] = values
        return timer, sessions

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, old = self.held()
        ids, ms, step = in_order(rows, ["session_id", "ts_ms", "step"], ["session_id", "ts_ms", "step"])
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        end = np.append(first[1:], len(ids))
        # Where each session is completed by these rows, if it is, and what it has before.
        place = np.arange(len(ids))
        closed = np.minimum.reduceat(np.where(step == COMPLETE, place, len(ids)), first)
        before = place < np.repeat(closed, end - first)
        every = np.union1d(old["session_id"], ids[first])
        sessions = np.zeros(len(every), SESSION)
        sessions["session_id"], sessions["start"], sessions["last"] = every, LAST_MS, -LAST_MS
        sessions[np.searchsorted(every, old["session_id"])] = old
        at = np.searchsorted(every, ids[first])
        sessions["start"][at] = np.minimum(sessions["start"][at], ms[first])
        sessions["last"][at] = np.maximum(sessions["last"][at], ms[end - 1])
        sessions["due"][at] = np.maximum(sessions["last"][at] + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        sessions["n"][at] += np.add.reduceat(before & ((step == RIGHT) | (step == WRONG)), first, dtype=np.int64)
        sessions["correct"][at] += np.add.reduceat(before & (step == RIGHT), first, dtype=np.int64)
        now = (closed < len(ids)) & ~sessions["done"][at]
        sessions["done"][at[now]] = True
        yield from self.ended(key, "completed", sessions[at[now]], ms[closed[now]])
        yield from self.settled(key, sessions, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, sessions = self.held()
        yield from self.settled(key, sessions, timer, timerValues, fired=True)

    def settled(self, key, sessions: np.ndarray, timer: int | None, timerValues, fired: bool = False) -> Iterator[pd.DataFrame]:
        """Forgets the sessions that are due, gives out those of them that were not completed, and keeps the others. Spark
        deletes a timer that has fired."""
        gone = sessions["due"] <= timerValues.getCurrentWatermarkInMs()
        kept = sessions[~gone]
        then = int(kept["due"].min()) if len(kept) else None
        if timer not in (None, then) and not fired:
            self.handle.deleteTimer(timer)
        if then not in (None, timer):
            self.handle.registerTimer(then)
        if len(kept):
            self.bucket.update((then, *[kept[c].tolist() for c in SESSION.names]))
        elif timer is not None:
            self.bucket.clear()
        left = sessions[gone & ~sessions["done"]]
        yield from self.ended(key, "abandoned", left, left["last"])

    def ended(self, key, how: str, sessions: np.ndarray, at: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(sessions), SLICE):
            x = sessions[i : i + SLICE]
            yield pd.DataFrame({"session_id": None if key[0] == NO_ID else x["session_id"], "how": how, "started_ms": x["start"], "ended_ms": at[i : i + SLICE], "check_ins": x["n"], "correct": x["correct"]})

    def close(self) -> None:
        pass


def ended_sessions(events: DataFrame, delay: str = "1 day", idle_ms: int = 7 * 86_400_000, buckets: int = 4096) -> DataFrame:
    """Sessions of a stream (session_id, ts, ts_ms, kind in start, track, complete; was_correct) when they end, how telling in
    which way: completed at their first completion, what follows it being refused, or abandoned when event time is idle_ms
    past their last event. Then they are forgotten, completed ones as well. Rows without a time are in no session.

    The state lies in buckets of sessions by a hash of their id. A bucket that gets rows is read and written whole, so buckets
    are to be as many as leave up to a thousand live sessions in each, and stay as many while a checkpoint is used."""
    kind, id_ = F.col("kind"), F.col("session_id")
    step = F.when(kind == "complete", COMPLETE).when(kind == "track", F.when(F.col("was_correct"), RIGHT).otherwise(WRONG)).otherwise(OTHER)
    bucket = F.when(id_.isNull(), NO_ID).otherwise(F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int"))
    rows = events.withWatermark("ts", delay).where("ts IS NOT NULL AND ts_ms IS NOT NULL").select(bucket.alias("bucket"), F.coalesce(id_, F.lit(0)).alias("session_id"), "ts", "ts_ms", step.alias("step"))
    return stateful(rows, ["bucket"], Sessions(idle_ms), SESSION_OUT, "append", "eventTime")


def completed_sessions(events: DataFrame, delay: str = "1 day", idle_ms: int = 7 * 86_400_000, buckets: int = 4096) -> DataFrame:
    """The completed ones of ended_sessions."""
    return ended_sessions(events, delay, idle_ms, buckets).where("how = 'completed'").select("session_id", "started_ms", F.col("ended_ms").alias("completed_ms"), "check_ins", "correct")


def abandoned_sessions(events: DataFrame, delay: str = "1 day", idle_ms: int = 7 * 86_400_000, buckets: int = 4096) -> DataFrame:
    """The abandoned ones of ended_sessions."""
    return ended_sessions(events, delay, idle_ms, buckets).where("how = 'abandoned'").select("session_id", "started_ms", F.col("ended_ms").alias("last_ms"), "check_ins", "correct")


def first_requests(requests: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Generation requests of a stream (document_id, section_id, with_check_ins, ts) not yet seen in the last 24 hours."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["document_id", "section_id", "with_check_ins"])


def late_apart(path: str, on_time: Callable[[DataFrame, int], None], delay_ms: int, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that parts a micro-batch by event time: rows more than delay_ms behind the latest of all earlier
    micro-batches go to path/late, the others to on_time.

    The mark of each batch, its latest time and its number of late rows, is a row of path/marks. A batch that comes again
    finds the marks before its own and replaces what it wrote, so both tables are those of one run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = late_marks(spark, path).where(F.col("batch_id") < batch_id).agg(F.max("latest_us")).first()[0]
        us = F.unix_micros(F.col(ts))
        late = F.coalesce(us < F.lit(None if found is None else found - 1000 * delay_ms).cast("long"), F.lit(False))
        batch = batch.persist()
        try:
            batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            on_time(batch.where(~late), batch_id)
            mark = batch.agg(F.max(us).alias("latest_us"), F.count_if(late).alias("late_rows"))
            mark.write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def late_marks(spark, path: str) -> DataFrame:
    """(latest_us, late_rows, batch_id) of the micro-batches that late_apart has written."""
    kind = "latest_us long, late_rows long, batch_id int"
    return spark.read.schema(kind).parquet(f"{path}/marks") if versions.exists(spark, f"{path}/marks") else spark.createDataFrame([], kind)


def upsert_usage(path: str, deltas: int = 8) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts the months touched by a batch of usage_counters into the table at path (see versions):
    a batch is a delta, every `deltas` of them are merged into a new base, and readers see a batch whole or not at all."""
    return versions.upsert(path, ["user_id", "month"], deltas)


def latest_usage(rows: DataFrame) -> DataFrame:
    """The last version of each user's month among rows with batch_id."""
    return rows.groupBy("user_id", "month").agg(F.max_by(F.struct("pdfs_uploaded", "pages_processed"), "batch_id").alias("u")).select("user_id", "month", "u.*")
