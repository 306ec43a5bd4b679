"""Ranked lexical search: hashed max-sketches bound every document's score, exact scores only while a bound may still enter."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm import shingles as sh
from studylake.llm import vectors
from studylake.llm.common import keep

#: Bytes that no term has: ASCII other than digits and letters.
GAPS = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
#: Texts are worked on in runs of about so many bytes.
ROOM = 1 << 19


def term_runs(raws: list[bytes | None], room: int = ROOM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, hash of each term in order, place of each text's first term and of the end) of runs of texts."""
    first = 0
    while first < len(raws):
        size, stop = 0, first
        while stop < len(raws) and (stop == first or size + len(raws[stop] or b"") <= room):
            size += len(raws[stop] or b"")
            stop += 1
        hashes, bounds = sh.words([(x or b"").lower() for x in raws[first:stop]], GAPS)
        yield first, hashes, bounds
        first = stop


def item_terms(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id) and (item, term, times) of the different rows of items; tables in the shared folder."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    rows = keep(rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.col("text").cast("binary").alias("raw")), "search-items")

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(0).to_numpy()
            for first, hashes, bounds in term_runs(b.column(1).to_pylist()):
                for i, (a, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    each, times = np.unique(hashes[a:e], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), items[first + i])), pa.array(each.view(np.int64)), pa.array(times.astype(np.int64))], ["item", "term", "times"])

    return rows.select("item", "item_id"), keep(rows.select("item", "raw").mapInArrow(terms, "item long, term long, times long"), "search-terms")


def statistics(docs: DataFrame, text_col: str, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(documents with terms, all their terms, documents that hold each of `terms`, sorted hashes), each added up where the texts are."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, every, held = 0, 0, np.zeros(len(terms), np.int64)
        for b in batches:
            for _, hashes, bounds in term_runs(b.column(0).to_pylist()):
                sizes = np.diff(bounds)
                some, every = some + int((sizes > 0).sum()), every + len(hashes)
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == hashes)
                row = np.searchsorted(bounds, hit, "right") - 1
                held += np.bincount(np.unique(row * len(terms) + at[hit]) % len(terms), minlength=len(terms))
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], found])), pa.array(np.concatenate([[some, every], held[found]]))], ["term", "n"])

    sums = docs.select(F.col(text_col).cast("binary").alias("raw")).mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}
    return found.pop(-2, 0), found.pop(-1, 0), np.array([found.get(i, 0) for i in range(len(terms))], np.int64)


class Query:
    """A block of items: the terms of all as hashes with their weights, and each item's places in them."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray):
        order = np.lexsort((term, item))
        self.items, firsts = np.unique(item[order], return_index=True)
        self.bounds = np.append(firsts, len(item))
        self.terms, self.place = np.unique(term[order], return_inverse=True)
        self.times = times[order]

    def weigh(self, some: int, df: np.ndarray) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
        self.weights = self.times * weight[self.place]


def impacts(tf: np.ndarray, size: int, some: int, every: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document of `size` terms."""
    m = 25 + 75 * size * some // every
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best_of_block(docs: DataFrame, id_col: str, text_col: str, query: Query, some: int, every: int, k: int, width: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each partition of docs."""
    hashes_of = query.terms[query.place]
    slots = (hashes_of & np.uint64(width - 1)).astype(np.int64)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list[tuple]] = [[] for _ in query.items]
        least = np.ones(len(query.items), np.int64)
        sketch = np.zeros((32, width), np.int64)
        kind = None
        for b in batches:
            kind, ids = b.schema.field(0).type, b.column(0).to_pylist()
            for first, hashes, bounds in term_runs(b.column(1).to_pylist()):
                for a in range(0, len(bounds) - 1, len(sketch)):
                    part = bounds[a : a + len(sketch) + 1]
                    sketch[: len(part) - 1] = 0
                    held = []
                    for row, (x, y) in enumerate(zip(part[:-1], part[1:], strict=True)):
                        terms, tf = np.unique(hashes[x:y], return_counts=True)
                        adds = impacts(tf, int(y - x), some, every)
                        np.maximum.at(sketch[row], (terms & np.uint64(width - 1)).astype(np.int64), adds)
                        held.append((terms, adds))
                    high = np.add.reduceat(sketch[: len(held), slots] * query.weights, query.bounds[:-1], axis=1)
                    for i in np.flatnonzero((high >= least).any(axis=0)):
                        low, stop = query.bounds[i], query.bounds[i + 1]
                        for row in np.argsort(-high[:, i], kind="stable"):
                            if high[row, i] < least[i]:
                                break
                            terms, adds = held[row]
                            at = np.minimum(np.searchsorted(terms, hashes_of[low:stop]), len(terms) - 1)
                            score = int((adds[at] * query.weights[low:stop])[terms[at] == hashes_of[low:stop]].sum())
                            if score >= least[i]:
                                doc = ids[first + a + row]
                                tops[i].append((-score, doc is None, doc))
                                tops[i].sort(key=lambda t: (t[0], t[1], 0 if t[1] else t[2]))
                                del tops[i][k:]
                                if len(tops[i]) == k:
                                    least[i] = -tops[i][-1][0]
        found = [(int(item), doc, -score) for item, top in zip(query.items, tops, strict=True) for score, _, doc in top]
        if found:
            item, doc, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return narrow.mapInArrow(rows, f"item long, doc_id {dict(narrow.dtypes)['doc_id']}, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, width: int = 1 << 14, block_terms: int = 1 << 18) -> DataFrame:
    """Returns (item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, ties to the smaller id.

    Terms are runs of ASCII digits, ASCII letters (in lower case) and all other characters beyond ASCII. A term of an item adds
    to a document its weight (from the number of documents that hold it) times its impact there (from its frequency and
    the document's length), for each time that the item has it.

    Each document's impacts are folded by the terms' hashes into the maxima of `width` coordinates. The sketches of a few
    documents at a time are looked up for all items of a block, which bounds every document's score from above. For each
    item the documents are scored exactly in descending order of the bound until it is below the k-th best score so far of
    the task; a task gives k rows an item at most, and the best of these are the result, which is exact. Sketches are not
    stored: they cost less than the texts' reading, which exact scores need anyhow.

    Items are dealt by a hash to blocks of about block_terms different terms, so what a task holds of them doesn't grow with the
    items (one item alone may be larger); each block reads the documents twice, for the statistics and for the search. Hashes
    of 64 bits stand for terms. A null or empty text has no terms and is found by no item, nor does an item without terms
    find any; a text of any length is one row. Rows with a null id come last among equal scores; repeated rows of docs are documents of
    their own, equal rows of items are one item. Empty tables give no rows; further columns play no part.
    """
    names, terms = item_terms(items, item_col, item_text_col)
    blocks = -(-terms.count() // block_terms)
    parts = []
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item", F.lit(block_terms)), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        query = Query(*(own.column(i).to_numpy() for i in range(3)))
        query.terms = query.terms.view(np.uint64)
        order = np.argsort(query.terms)  # as unsigned numbers
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        query.terms, query.place = query.terms[order], back[query.place]
        some, every, df = statistics(docs, text_col, query.terms)
        if some:
            query.weigh(some, df)
            parts.append(keep(best_of_block(docs, id_col, text_col, query, some, every, k, width), "search-found"))
    kind = dict(docs.dtypes)[id_col]
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], f"item long, doc_id {kind}, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = vectors.first_rows(found, "item", order, k, "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(vectors.w.Window.partitionBy("item").orderBy(*order)))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
