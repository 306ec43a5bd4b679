"""Tables that a stream upserts: a base and a few deltas in Parquet, named by a manifest that is switched in one step.

A batch is written as a delta beside what is there, then a manifest with the next number names it; a manifest appears by a
rename, so it is there whole or not. Readers take the last one. Every few deltas the table is merged into a new base, so
that reading and storage stay bounded; folders are deleted when two manifests no longer name them, which leaves running
readers theirs. A manifest also names the last batch it holds: a batch that comes again is left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from studylake.sources.tables import insert_or_ignore, stored


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """All manifests of a table that are still there, by number."""
    fs, at = _fs(spark, f"{path}/manifests")
    if not fs.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))
    out = []
    for name in names:
        stream = fs.open(_fs(spark, f"{path}/manifests/{name}")[1])
        try:
            out.append(json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()
    return out


def commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Makes a manifest the last one. Its number must be free: of two writers with one number the second fails."""
    fs, at = _fs(spark, f"{path}/manifests/{manifest['number']:012d}.json")
    draft = _fs(spark, f"{path}/manifests/.{manifest['number']:012d}.{manifest['folder']}")[1]
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has put version {manifest['number']} of {path}")


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its last manifest has it; None before the first."""
    found = manifests(spark, path)
    return _merged(spark, path, found[-1]) if found else None


def _merged(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    parts = [spark.read.schema(schema).parquet(f"{path}/data/{name}").withColumn("__turn", F.lit(i)) for i, name in enumerate(manifest["parts"])]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    key, rest = manifest["key"], [c for c in schema.names if c not in manifest["key"]]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "__turn").alias("__row"))
    return last.select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in schema.names])


def upsert(path: str, key: list[str], deltas: int = 8) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of a batch replace those of the same key, nulls in a key being one key. A batch has each key
    once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        known = manifests(batch.sparkSession, path)
        if not known or batch_id > known[-1]["batch"]:
            _put(batch, path, key, known, batch_id, deltas)

    return write


def insert(rows: DataFrame, path: str, key: list[str], first: list[str], deltas: int = 8, tries: int = 5) -> int:
    """Puts into the table the rows whose key it doesn't have, the first of each key in an order, and returns their number.

    What it has is read from the last manifest, and the new rows are named by the next; where another writer has put that in
    the meantime, the rows are told apart again, so no key enters twice. Nulls in a key match each other.
    """
    spark = rows.sparkSession
    for _ in range(tries):
        known = manifests(spark, path)
        old = _merged(spark, path, known[-1]) if known else rows.limit(0)
        fresh = stored(insert_or_ignore(old, rows, key, first).select(*rows.columns), "fresh-rows")
        n = fresh.count()
        if not n:
            return 0
        try:
            _put(fresh, path, key, known, known[-1]["batch"] if known else -1, deltas)
            return n
        except RuntimeError:
            continue
    raise RuntimeError(f"other writers were first {tries} times at {path}")


def _put(rows: DataFrame, path: str, key: list[str], known: list[dict], batch_id: int, deltas: int) -> None:
    spark = rows.sparkSession
    last = known[-1] if known else {"number": -1, "parts": []}
    number, mark = last["number"] + 1, uuid.uuid4().hex[:8]
    folder = f"delta-{number:012d}-{mark}"
    rows.write.parquet(f"{path}/data/{folder}")
    now = {"number": number, "batch": batch_id, "parts": [*last["parts"], folder], "folder": folder, "key": key, "schema": json.loads(rows.schema.json())}
    if len(now["parts"]) > deltas:
        base = f"base-{number:012d}-{mark}"
        _merged(spark, path, now).write.parquet(f"{path}/data/{base}")
        now |= {"parts": [base], "folder": base}
    commit(spark, path, now)
    # What neither of the last two manifests names goes, but for what another writer may be about to name.
    named = {x for m in [*known[-1:], now] for x in m["parts"]}
    fs, at = _fs(spark, f"{path}/data")
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name not in named and int(name.split("-")[1]) <= number:
            fs.delete(f.getPath(), True)
    for m in known[:-1]:
        fs.delete(_fs(spark, f"{path}/manifests/{m['number']:012d}.json")[1], False)
