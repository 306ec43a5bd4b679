"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What statistics() gives, in this order.
FEATURES = (
    "chars", "words", "word_length", "lines", "line_length", "digits", "upper", "letters", "wide", "blanks", "stops", "commas", "pipes", "brackets", "symbols",
    "distinct_words", "longest_word", "common_word", "distinct_lines", "entropy", "words_a_stop", "short_words", "wordlike", "odd_words", "repeated_marks", "stop_ends",
)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOLS = np.frombuffer(b"#$%&*+=<>@^_~\\/`", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Counts and shares over the bytes, words and lines of a whole text; an empty or null text gives zeros mostly."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    b = np.frombuffer(raw, np.uint8)
    c = np.bincount(b, minlength=256)
    p = c[c > 0] / n
    words = raw.split()
    k = max(1, len(words))
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    lines = raw.split(b"\n")
    letters, wide = c[_LETTER].sum(), c[128:].sum()
    odd = sum(not x.rstrip(b".,;:!?").isalpha() for x in tally if x.isascii())
    same = (b[1:] == b[:-1]) & ~(_LETTER[b[1:]] | (b[1:] >= 128)) if len(b) > 1 else np.zeros(0, bool)
    stops = c[46] + c[33] + c[63]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / k, np.log1p(len(lines)), np.log1p(len(raw) / len(lines)), c[48:58].sum() / n, c[65:91].sum() / max(1, letters), letters / n, wide / n, (c[32] + c[10] + c[9]) / n,
        stops / k, c[44] / k, c[124] / k, c[[40, 41, 91, 93, 123, 125]].sum() / n, c[_SYMBOLS].sum() / n, len(tally) / k, np.log1p(max(map(len, words), default=0)), max(tally.values(), default=0) / k, len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()),
        np.log1p(len(words) / (1 + stops)), sum(len(x) <= 3 for x in words) / k, sum(2 <= len(x) <= 12 for x in words) / k, odd / max(1, len(tally)), same.sum() / n, sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines),
    ]


@dataclass(frozen=True)
class Trees:
    """All trees of an ensemble in flat arrays: a node's feature (-1: leaf), threshold, first child and value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows walk all trees at once, level by level."""
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[row, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(inner, self.child[at] + right, at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosts trees on the logistic loss, with splits found in histograms of quantile bins. One label only: a constant."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_1 / (1 - rate_1)))
    raw = np.full(len(y), base)
    feature, threshold, child, value, roots = [], [], [], [], []
    offsets = np.arange(x.shape[1]) * bins

    def node() -> int:
        feature.append(-1), threshold.append(0.0), child.append(0), value.append(0.0)
        return len(feature) - 1

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)), 0)]
        while open_nodes:
            k, rows, level = open_nodes.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            step = -gs / (hs + ridge) * rate
            best = None
            if level < depth and hs > 2 * least:
                flat = (binned[rows] + offsets).ravel()
                gh = np.bincount(flat, np.repeat(g[rows], x.shape[1]), minlength=x.shape[1] * bins).reshape(-1, bins).cumsum(1)
                hh = np.bincount(flat, np.repeat(h[rows], x.shape[1]), minlength=x.shape[1] * bins).reshape(-1, bins).cumsum(1)
                gain = gh**2 / (hh + ridge) + (gs - gh) ** 2 / (hs - hh + ridge) - gs**2 / (hs + ridge)
                gain[(hh < least) | (hs - hh < least)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                best = (j, b) if gain[j, b] > 1e-6 and b < len(edges[j]) else None
            if best is None:
                value[k] = step
                raw[rows] += step
                continue
            j, b = best
            feature[k], threshold[k] = int(j), float(edges[j][b])
            left, right = node(), node()
            child[k] = left
            go = binned[rows, j] > b
            open_nodes += [(left, rows[~go], level + 1), (right, rows[go], level + 1)]
    return Trees(np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(child, int), np.array(value), base, depth)


def with_statistics(docs: DataFrame, id_col: str, text_col: str, extra: dict[str, str] | None = None) -> DataFrame:
    """(id, x) and the extra columns; x holds the statistics of the whole text."""
    extra = extra or {}

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], **{c: b[c] for c in extra}, "x": [statistics(t) for t in b["text"]]})

    narrow = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast(t).alias(c) for c, t in extra.items()], F.col(text_col).alias("text"))
    return narrow.mapInPandas(rows, ", ".join([f"id {dict(narrow.dtypes)['id']}", *[f"{c} {t}" for c, t in extra.items()], "x array<double>"]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, **how) -> Trees:
    """Fits trees to at most about sample labelled documents, drawn by a hash of the id: the only rows the driver sees.

    Labels other than 0 and 1 are left out. Repeated label rows, and rows of repeated documents, count as often as they
    stand. Texts of any length are read whole. Without labelled documents the trees give a constant. Further columns, in
    either table, play no part.
    """
    marks = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    n = marks.count()
    share = min(1.0, sample / max(1, n))
    drawn = marks.where(F.pmod(F.xxhash64(F.col("of"), F.lit(11)), F.lit(1 << 40)) <= share * (1 << 40))
    joined = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body")).join(drawn, F.col("doc") == F.col("of"))
    rows = with_statistics(joined, "doc", "body", {"y": "int"}).select("id", "y", "x").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array([r["y"] for r in rows], float), **how)


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, text_key, score) for each row: the probability of label 1. Null and empty texts are scored too, texts
    of any length whole; equal texts have equal scores; an empty table gives no rows; further columns play no part."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                x = np.array([statistics(t) for t in part["text"]], float)
                yield pd.DataFrame({"id": part["id"], "text_key": part["text_key"], "score": trees.score(x)})

    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(rows, f"id {dict(narrow.dtypes)['id']}, text_key long, score double")
