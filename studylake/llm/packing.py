"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens to target proportions."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import keep, running_sum

#: The special string of the vocabulary, whose id follows the ranks.
SPECIAL = "<|endoftext|>"
#: Stands for all sources that have no queue of their own.
OTHERS = "\0others"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    """A byte-level BPE from a rank file; one for each Python worker. The special string counts as its id."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={SPECIAL: len(table)})


def encode(text: str | None, ranks: str, pattern: str) -> np.ndarray:
    """The ids of a text, then id 0, in 16 bits each where the vocabulary allows it, else in 32."""
    bpe = encoder(ranks, pattern)
    ids = bpe.encode(text, allowed_special="all") if SPECIAL in (text or "") else bpe.encode_ordinary(text or "")
    return np.array([*ids, 0], "<u2" if bpe.n_vocab <= 1 << 16 else "<u4")


def tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, ranks: str, pattern: str) -> DataFrame:
    """(row_id, doc_id, source, n, ids, mark) of each row, as a table in the shared folder. mark is a hash of id and tokens, which
    gives the order; row_id only tells equal rows apart."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                ids = [encode(t, ranks, pattern) for t in part["text"]]
                yield pd.DataFrame({"row_id": part["row_id"], "doc_id": part["doc_id"], "source": part["source"], "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})

    narrow = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    found = narrow.mapInPandas(rows, "row_id long, doc_id long, source string, n long, ids binary")
    return keep(found.withColumn("mark", F.xxhash64("doc_id", "ids")), "pack-tokens")


def queues(sizes: list[tuple[str | None, int]], rest: int, shares: dict[str | None, float] | None, window: int) -> tuple[dict[str | None, int], list[tuple]]:
    """(queue of each source, phases): how the tokens of sources (with those of all others together) make windows.

    A phase (queue, from_queue, low, high, first, length) is a stretch of `length` tokens of the output that begins at `first`, in
    which a queue gives its tokens from from_queue on, high - low of them; low is what the queues before it give. Target
    proportions stay the same in a phase; it ends where a queue with more than its share of what is left runs dry.
    Queues that would give less than two tokens a window are joined to the ones before them.
    """
    named, amounts, parts, places = [], [], [], {}
    for source, n in [*sizes, (None, rest)]:
        if n:
            named.append(source), amounts.append(n)
            parts.append(n if shares is None else shares.get(source, 0.0))
    total = sum(amounts)
    if shares is not None and min(parts, default=1) <= 0:
        raise ValueError("shares must be positive for each source that has one, and for None: all others")
    merged: list[list] = []
    rest_of = sum(parts)
    for i in range(len(named)):
        # With two tokens a window or more, rounding leaves each queue no less than none in any.
        small = merged and (merged[-1][1] * window < 2 * sum(parts) or rest_of * window < 2 * sum(parts))
        if small:
            merged[-1][0] += amounts[i]
            merged[-1][1] += parts[i]
        else:
            merged.append([amounts[i], parts[i]])
        rest_of -= parts[i]
        places[i] = len(merged) - 1
    of = {source: places[i] for i, source in enumerate(named[: len(named) - (rest > 0)])}
    left, at, phases = [m[0] for m in merged], 0, []
    while any(left):
        live = [q for q, n in enumerate(left) if n]
        weight = sum(merged[q][1] for q in live)
        # The first queue to run dry sets the length; the others give their share, rounded down, and all when all end together.
        length = min(Fraction(left[q]) * Fraction(weight) / Fraction(merged[q][1]) for q in live)
        gives = {q: min(left[q], int(length * Fraction(merged[q][1]) / Fraction(weight))) for q in live}
        low = 0
        for q in live:
            phases.append((q, merged[q][0] - left[q], low, low + gives[q], at, sum(gives.values())))
            low += gives[q]
            left[q] -= gives[q]
        at += low
    assert at == total
    return of | {OTHERS: places.get(len(named) - 1, 0)}, phases


def cuts(phases: list[tuple], ahead: int, n: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of each piece of a document with `ahead` tokens before it in its queue.

    After h tokens of a phase the queue has given floor(high * h / length) - floor(low * h / length): the balance of its deficit
    counter in closed form, so no state walks through the windows. Queues stand in their order in a window.
    """
    at, end = ahead, ahead + n
    for _, base, low, high, first, length in phases:
        while base <= at < min(end, base + high - low):
            # The window in which the queue's next token lies: a first guess at most two off.
            sequence = max(first // window, (first + (at - base) * length // (high - low)) // window - 2)
            while True:
                h0, h1 = max(0, sequence * window - first), min(length, (sequence + 1) * window - first)
                had, has = high * h0 // length - low * h0 // length, high * h1 // length - low * h1 // length
                while has > at - base:
                    stop = min(end, base + has)
                    yield at - ahead, stop - at, sequence, max(0, first - sequence * window) + low * h1 // length - low * h0 // length + at - base - had
                    at = stop
                    break
                if at >= min(end, base + high - low):
                    break
                sequence += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shares: dict[str | None, float] | None = None, window: int = 1024, ranks: str | None = None, pattern: str | None = None, bucket_rows: int = 256) -> DataFrame:
    """Returns the pieces of all documents in sequences of window tokens.

    Each source is a queue of its documents in an order given by hashes of id and tokens. Deficit round-robin fills every
    window to the target token proportions: each queue earns its share of a window, gives whole tokens and carries the
    fraction over to the next, also from one partition to another, as a balance follows from the place in the queue alone
    (see cuts). So a window departs from the proportions by less than two tokens a source; only the last one is short.
    shares gives the target proportion of each source named and, under None, of all others together; where a queue runs
    dry the others share what is left. Without shares each source has its part of all tokens, so that all queues last
    equally long. Sources under two tokens a window are one queue. At most window / 2 queues come to the driver.

    The ids are those of `byte_bpe_50k.json` in the library tokenizers without special tokens; they are computed by
    tiktoken from the rank file of the same vocabulary, which is faster (tests compare both). A null or empty text is the
    one id 0; a text of any length is one row, cut wherever windows end; each row, repeated ones too, is packed once; rows with a null source
    are a queue, too. An empty table gives no pieces. Further columns of docs play no part. Token ids move once, to be cut.
    """
    import public_tokenizers

    held = tokens(docs, id_col, text_col, source_col, ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    known = F.array(*[F.lit(x) for x in shares if x is not None]).cast("array<string>") if shares is not None else None
    per = held.groupBy("source").agg(F.sum("n").alias("tokens"))
    total = per.agg(F.sum("tokens")).first()[0] or 0
    # At most window / 2 sources can have two tokens in each window.
    large = per.where(F.col("tokens") * window >= 2 * total) if known is None else per.where(F.array_contains(known, F.col("source")))
    sizes = sorted(((r["source"], r["tokens"]) for r in large.collect()), key=lambda x: (x[0] is None, x[0] or ""))
    of, phases = queues(sizes, total - sum(n for _, n in sizes), shares, window)
    by_queue = {q: [p for p in phases if p[0] == q] for q in set(of.values())}
    others = of.pop(OTHERS)
    named = F.create_map(*[F.lit(x) for kv in of.items() if kv[0] is not None for x in kv]) if any(x is not None for x in of) else F.create_map().cast("map<string,int>")
    queue = F.when(F.col("source").isNull(), F.lit(of.get(None, others))).otherwise(F.coalesce(F.try_element_at(named, F.col("source")), F.lit(others)))
    buckets = max(1, -(-held.count() // bucket_rows))
    lengths = held.select("row_id", "doc_id", queue.alias("queue"), "n", "mark", F.pmod(F.col("mark"), F.lit(buckets)).alias("bucket"))
    queued = running_sum(lengths, ["queue"], "bucket", ["mark", "doc_id", "row_id"], "n", "ahead").select("row_id", "queue", "ahead")

    def pieces(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                out: list[tuple] = []
                for doc, source, n, raw, q, ahead in b.iloc[at : at + 256][["doc_id", "source", "n", "ids", "queue", "ahead"]].itertuples(index=False):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                    out += [(doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, sequence, offset, source) for start, length, sequence, offset in cuts(by_queue[q], int(ahead), int(n), window)]
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return held.join(queued, "row_id").select("doc_id", "source", "n", "ids", "queue", "ahead").mapInPandas(pieces, PIECES)
