"""Substring dedup: MinHash bands over paragraphs, exact Jaccard of colliding ones, clusters by components.

A text's paragraphs are its lines of a shingle's words or more, its blocks of lines between blank ones, and, as repeated
passages begin and end anywhere, also within a line, runs of `span` words that start where the text itself says so: at the smallest pair-of-words hash in some `gap`
consecutive places. Whatever stands around it, a passage of gap + span + 1 words or more (50 by default) holds at least
one whole run, found at the same words in every copy. Texts of fewer words than a run are one paragraph as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from studylake.llm import shingles as sh
from studylake.llm.common import by_bitmap, by_unit, components, first_units, forget, id_bitmap, join_spread, keep, more_units, unused

#: Words of a shingle; minimum hashes of a band.
SHINGLE, ROWS = 5, 2
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def recall(similarity: float, bands: int, rows: int = ROWS) -> float:
    """Probability that two paragraphs of a similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each n consecutive values, by doubling; one value for each full run."""
    done, size = x, 1
    while size < n:
        step = min(size, n - size)
        done = best(done[:-step], done[step:])
        size += step
    return done


def starts(pairs: np.ndarray, gap: int, bounds: np.ndarray) -> np.ndarray:
    """Which places hold the smallest of some gap consecutive values of one text; of a row of equal ones only the first. A text
    of n words has n - 1 values; what stands before or after it changes nothing."""
    if len(pairs) < gap:
        return np.zeros(len(pairs), bool)
    low = sliding(pairs, gap, np.minimum)
    end = np.repeat(bounds[1:], np.diff(bounds))[: len(low)]
    low[np.arange(len(low)) + gap >= end] = 0
    edge = np.zeros(gap - 1, np.uint64)
    high = sliding(np.concatenate([edge, low, edge]), gap, np.maximum)
    chosen = high[: len(pairs)] == pairs
    chosen[1:] &= pairs[1:] != pairs[:-1]
    return chosen


class Paragraphs(NamedTuple):
    """Paragraphs of some texts: text, first word in it, number of words, hash of the words; and the texts' shingles with
    each paragraph's first."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    whole: np.ndarray
    small: np.ndarray
    at: np.ndarray


def paragraphs(raws: list[bytes], gap: int, span: int) -> Paragraphs:
    hashes, bounds, *heads = sh.words_and_lines(raws)
    n = np.diff(bounds)
    lengths = np.concatenate([np.diff(x, append=len(hashes)) for x in heads])
    heads = np.concatenate(heads)
    chosen = np.flatnonzero(starts(sh.shingles(hashes, 2), gap, bounds))
    owner = np.searchsorted(bounds, chosen, side="right") - 1
    chosen = chosen[chosen + span <= bounds[owner + 1]]
    first, short = bounds[:-1][n >= span], bounds[:-1][n < span]
    at = np.concatenate([heads, chosen, first, short])
    size = np.concatenate([lengths, np.full(len(chosen) + len(first), span), n[n < span]])
    once = np.unique(np.stack([at, size], axis=1)[size >= SHINGLE], axis=0) if len(at) else np.zeros((0, 2), int)
    at, size = once[:, 0], once[:, 1]
    text = np.searchsorted(bounds, at, side="right") - 1
    # The hash of any run of words: differences of sums in which each word has the next power of an odd number.
    base, back = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), base, np.uint64)]), dtype=np.uint64)
    undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), back, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    whole = sh.mix((sums[at + size] - sums[at]) * undo[at] + size.astype(np.uint64))
    return Paragraphs(text, at - bounds[text], size, whole, sh.shingles(hashes, SHINGLE), at)


def band_hashes(p: Paragraphs, bands: int) -> np.ndarray:
    """A row of band hashes for each paragraph: each joins ROWS minimum hashes of its shingles."""
    if not len(p.at):
        return np.zeros((0, bands), np.uint64)
    edges = np.stack([p.at, p.at + p.size - SHINGLE + 1], axis=1).ravel()
    padded = np.append(p.small, np.uint64(0))
    least = [np.minimum.reduceat(sh.mix(padded ^ _SEEDS[i]), edges)[::2] for i in range(bands * ROWS)]
    return np.stack([sh.mix(least[i] * _SEEDS[i] + least[i + 1] * _SEEDS[i + 1] + np.uint64(i)) for i in range(0, len(least), ROWS)], axis=1)


def leads(p: Paragraphs, bands: np.ndarray) -> np.ndarray:
    """Bits of the bands in which a paragraph overlaps no earlier one of its text with the same band. Paragraphs that overlap
    in one text are alike without being copies; a band with one lead from one text has no others."""
    out = np.zeros(len(p.at), np.int32)
    for i in range(bands.shape[1]):
        order = np.lexsort((p.at, bands[:, i], p.text))
        text, band, at = p.text[order], bands[order, i], p.at[order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (band[1:] != band[:-1])
        group = np.cumsum(new) << 40
        reach = np.maximum.accumulate(group + at + p.size[order])
        new[1:] |= group[1:] + at[1:] >= reach[:-1]
        out[order] |= new.astype(np.int32) << i
    return out


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = 3, gap: int = 24, span: int = 25, room: int = 1024) -> DataFrame:
    """Returns the passages to remove: (id, start_word, end_word, kept_id, cluster), end not included.

    Equal paragraphs are one class. All classes that share a band are compared on the exact Jaccard similarity of
    five-word shingles, but for those that links already join; components of similar classes are the clusters. In a
    cluster the paragraph of the smallest (id, place) stays and all others go; paragraphs that overlap are joined to one
    passage, with the smallest id that is kept for any of them. A pair of paragraphs at similarity 0.8 shares one of
    three bands of two minimum hashes with probability 0.953 (see recall), a nearer one with more.

    Null and empty texts, and those under five words, have no paragraphs, and lines under five words are none alone; an
    empty table gives no rows; a text of any length is read whole. Ids are integers; rows that share an id share its
    places, so a repeated row is not a copy of itself; rows with a null id are left out. Further columns play no part.

    Paragraphs are not stored: bands are counted by class, and the texts are read again for the sets to verify and for
    the places of what is to be removed. Bitmaps of at most 16 MB spare most rows the shuffle; what they let through is
    joined exactly.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    names = [f"band{i}" for i in range(bands)]

    def banded(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, raws in sh.parts(b["text"]):
                p = paragraphs(raws, gap, span)
                found = band_hashes(p, bands)
                ids = b["id"].to_numpy()[first + p.text]
                yield pd.DataFrame({"id": ids, "whole": p.whole.view(np.int64), "leads": leads(p, found)} | {x: found[:, i].view(np.int64) for i, x in enumerate(names)})

    rows = texts.mapInPandas(banded, "id long, whole long, leads int, " + ", ".join(f"{x} long" for x in names))
    classes = rows.groupBy("whole").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.bit_or("leads").alias("leads"), *[F.min(x).alias(x) for x in names])
    classes = keep(classes, "passage-classes")
    members = _members(classes, names)
    label = _similar(members, _sets(members, texts, gap, span), similarity, room)

    flagged = classes.where("n > 1").select("whole", "n").join(label.select(F.col("node").alias("whole"), "component"), "whole", "full")
    # A class that is not repeated itself is in a cluster with others.
    flagged = keep(flagged.select("whole", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("component", "whole").alias("cluster")), "passage-flagged")
    for done in (classes, members, label):
        forget(done)
    held = keep(_places(texts, flagged, gap, span), "passage-places")
    first = keep(held.groupBy("cluster").agg(F.min(F.struct("id", "start", "size")).alias("kept"), F.count("*").alias("rows")).where("rows > 1"), "passage-kept")
    gone = join_spread(held, first, ["cluster"], "rows", "id").where((F.col("id") != F.col("kept.id")) | (F.col("start") != F.col("kept.start")))
    order = w.Window.partitionBy("id").orderBy("start", "size", "cluster")
    reach = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(w.Window.unboundedPreceding, -1))
    runs = gone.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy("id", "run").agg(F.min("start").alias("start_word"), F.max(F.col("start") + F.col("size")).alias("end_word"), F.min("kept.id").alias("kept_id"), F.min("cluster").alias("cluster"))
    return spans.drop("run")


def _members(classes: DataFrame, names: list[str]) -> DataFrame:
    """(group, n, member, id): the classes of each band that more than one place shares, n of them."""
    each = [F.struct(F.xxhash64(F.lit(i), F.col(x)).alias("group"), F.shiftright("leads", i).bitwiseAND(1).alias("lead")) for i, x in enumerate(names)]
    shared = classes.select(F.col("whole").alias("member"), "id", F.inline(F.array(*each)))
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 16))
    # Classes of one band whose only lead is the same class belong to one text, or to copies of it.
    many = shared.groupBy("group").agg(F.count("*").alias("n"), F.sum("lead").alias("leads"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    many = keep(many.where("n > 1 AND (leads > 1 OR low < high)").select("group", "n"), "passage-bands")
    near = by_bitmap(shared.select("group", "member", "id"), "group", *id_bitmap(many, "group"), True)
    out = keep(join_spread(near, many, ["group"], "n", "member").select("group", "n", "member", "id"), "passage-members")
    forget(many)
    return out


def _sets(members: DataFrame, texts: DataFrame, gap: int, span: int) -> DataFrame:
    """(whole, id, start, size, s) with a place and the set of shingles of each class of members."""
    asked = keep(members.groupBy(F.col("id").alias("of")).agg(F.collect_set("member").alias("classes")), "passage-asked")

    def sets(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, raws in sh.parts(b["text"]):
                p, out = paragraphs(raws, gap, span), []
                ids, wanted = b["of"].to_numpy()[first:], [np.asarray(x, np.int64).view(np.uint64) for x in b["classes"].iloc[first : first + len(raws)]]
                low = np.searchsorted(p.text, np.arange(len(raws) + 1))
                for i, asks in enumerate(wanted):
                    for j in low[i] + np.flatnonzero(np.isin(p.whole[low[i] : low[i + 1]], asks)):
                        out.append((int(p.whole[j].view(np.int64)), ids[i], p.start[j], p.size[j], np.unique(p.small[p.at[j] : p.at[j] + p.size[j] - SHINGLE + 1]).tobytes()))
                yield pd.DataFrame(out, columns=["whole", "id", "start", "size", "s"])

    few = by_bitmap(texts, "id", *id_bitmap(asked, "of"), True)
    found = few.join(asked, F.col("id") == F.col("of")).select("of", "text", "classes").mapInPandas(sets, "whole long, id long, start int, size int, s binary")
    # Of a class's places the first, so that runs agree.
    found = found.groupBy("whole").agg(F.min(F.struct("id", "start", "size", "s")).alias("at"))
    out = keep(found.select("whole", "at.*"), "passage-sets")
    forget(asked)
    return out


def _places(texts: DataFrame, flagged: DataFrame, gap: int, span: int) -> DataFrame:
    """(id, start, size, cluster) of all paragraphs whose class is flagged, each once."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, raws in sh.parts(b["text"]):
                p = paragraphs(raws, gap, span)
                yield pd.DataFrame({"id": b["id"].to_numpy()[first + p.text], "start": p.start.astype(np.int32), "size": p.size.astype(np.int32), "whole": p.whole.view(np.int64)})

    every = texts.mapInPandas(rows, "id long, start int, size int, whole long")
    near = by_bitmap(every, "whole", *id_bitmap(flagged, "whole"), True)
    return join_spread(near, flagged, ["whole"], "n", "id").select("id", "start", "size", "cluster").distinct()


def links_of(whole: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Verified pairs of classes that link all similar ones of different sides (where both occur) and of different
    components; a pair that others already link is left out."""
    size = np.array([len(x) for x in sets])
    shingle, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    two = side.min() != side.max()
    comp = np.unique(comp, return_inverse=True)[1]
    asked, out = np.zeros(len(shingle), bool), []
    for i in range(len(whole) - 1):
        ok = (comp[i + 1 :] != comp[i]) & (np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :]))
        ok &= (ids[i + 1 :] != ids[i]) | (start[i + 1 :] >= start[i] + length[i]) | (start[i] >= start[i + 1 :] + length[i + 1 :])
        if two:
            ok &= side[i + 1 :] != side[i]
        if not ok.any():
            continue
        own = code[first[i] : first[i] + size[i]]
        asked[own] = True
        common = np.add.reduceat(asked[code[first[i + 1] :]], first[i + 1 :] - first[i + 1], dtype=np.int64)
        asked[own] = False
        near = i + 1 + np.flatnonzero(ok & (common >= similarity * (size[i] + size[i + 1 :] - common)))
        if len(near):
            joined, at = np.unique(comp[near], return_index=True)
            out += [(int(whole[i]), int(whole[j])) for j in near[at]]
            comp[np.isin(comp, joined)] = comp[i]
    return out


def _unit_links(units: DataFrame, held: DataFrame, similarity: float, rows: int) -> DataFrame:
    """The links (a, b) within each of units (unit, side, member, comp), of about so many rows; held gives the sets."""

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(b):
            unit, whole, ids, start, size, comp, side = (b[c].to_numpy() for c in ("unit", "whole", "id", "start", "size", "comp", "side"))
            sets = [np.frombuffer(x, np.uint64) for x in b["s"]]
            edges = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(b)]])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e - s > 1:
                    out += links_of(whole[s:e], ids[s:e], start[s:e], size[s:e], comp[s:e], side[s:e], sets[s:e], similarity)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    placed = units.join(held, F.col("member") == F.col("whole")).select("unit", "side", "whole", "id", "start", "size", "comp", "s")
    return by_unit(placed, solve, "a long, b long", rows)


def _similar(members: DataFrame, held: DataFrame, similarity: float, room: int) -> DataFrame:
    """Components (node, component) of the classes of bands (group, n, member): every pair that shares a band and is similar
    enough is linked or joined by a path of links. A band of at most room classes is one unit, in which all pairs are
    met; a larger one is met in parts, and again those parts that are not yet one component."""
    links = keep(_unit_links(first_units(members, room).withColumn("comp", F.col("member")), held, similarity, members.count()), "passage-links")
    label = components(links)
    large = members.where(F.col("n") > room)
    if not large.isEmpty():
        labelled = large.join(label, F.col("member") == F.col("node"), "left").select("group", "n", "member", F.coalesce("component", "member").alias("comp"))
        labelled = keep(labelled, "passage-labelled")
        more = keep(links.unionByName(_unit_links(more_units(labelled, room), held, similarity, labelled.count())), "passage-links")
        forget(label), forget(labelled), forget(links)
        links, label = more, components(more)
    forget(links), forget(held)
    return label


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of each passage cut out of the text (what stands between other words stays as it is).

    All columns of docs stay. A text without passages stays as it is, null included, as do rows with a null id; rows that
    share an id lose the same words. An empty table of passages changes nothing, one of docs gives no rows.
    """
    cut_id, cuts_col = unused(docs.columns, "cut_id", "cuts")
    cuts = passages.groupBy(F.col("id").alias(cut_id)).agg(F.sort_array(F.collect_list(F.array(F.col("start_word").cast("int"), F.col("end_word").cast("int")))).alias(cuts_col))

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        import re

        def one(t: str | None, spans) -> str | None:
            if t is None or spans is None or not len(spans):
                return t
            at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            out, end = [], 0
            for a, e in spans:
                out.append(t[end : at[a][0]])
                end = at[e - 1][1]
            return "".join([*out, t[end:]])

        return pd.Series([one(t, c) for t, c in zip(text, cuts, strict=True)], dtype=object)

    joined = docs.join(cuts, F.col(id_col).cast("long") == F.col(cut_id), "left")
    return joined.select(*[cut(F.col(text_col), F.col(cuts_col)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
