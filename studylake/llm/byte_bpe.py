"""Byte-level BPE: pre-tokenisation by scans over transition functions, cached pair merging, decoding by retained offsets."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# What a character means to the automaton: its class; an apostrophe before one or two letters of a contraction; a blank that
# is followed by a blank or the end of the text, the last space or other blank before something else; the end of a text; nothing.
LETTERS, NUMBERS, OTHERS, SHORT, LONG, INNER, JOINING, ALONE, END, NOTHING = range(10)
# What has been read of a token: none yet, letters, numbers, others, blanks, a space that what follows joins, an apostrophe that
# awaits one or two letters, a whole token.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, JOINS, ONE_MORE, TWO_MORE, WHOLE = range(9)

#: Texts are worked on in runs of about so many bytes.
ROOM = 1 << 20
#: Ids and the place in the text's bytes where each token ends.
ENCODED = "ids array<int>, ends array<int>"


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) by symbol and state.

    The tokens are those of the public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    follows = np.zeros((10, 9), np.uint8)
    begins = np.ones((10, 9), bool)
    for symbol, state in ((LETTERS, IN_LETTERS), (NUMBERS, IN_NUMBERS), (OTHERS, IN_OTHERS), (SHORT, IN_OTHERS), (LONG, IN_OTHERS)):
        follows[symbol] = state
        begins[symbol, [state, JOINS]] = False
    # An apostrophe is a contraction's only where a token begins.
    follows[SHORT, begins[SHORT]] = ONE_MORE
    follows[LONG, begins[LONG]] = TWO_MORE
    follows[LETTERS, [ONE_MORE, TWO_MORE]] = WHOLE, ONE_MORE
    begins[LETTERS, [ONE_MORE, TWO_MORE]] = False
    follows[INNER] = IN_BLANKS
    begins[INNER, IN_BLANKS] = False
    follows[JOINING], follows[ALONE], follows[END] = JOINS, WHOLE, FRESH
    follows[NOTHING] = np.arange(9)
    begins[NOTHING] = False
    return follows, begins


FOLLOWS, BEGINS = _automaton()


def states_before(symbols: np.ndarray, functions: np.ndarray, first: int = 0, width: int = 64) -> np.ndarray:
    """The state before each symbol; functions[symbol] is a function of states.

    Functions are composed in chunks, all chunks at once. Composition is associative, so the chunks' functions are scanned in
    the same way, which gives the state before each chunk; from there all chunks are read at once.
    """
    n, many = len(symbols), functions.shape[1]
    if n <= width:
        out = np.empty(n, np.uint8)
        for i, s in enumerate(symbols.tolist()):
            out[i] = first
            first = functions[s, first]
        return out
    chunks = -(-n // width)
    padded = np.full(chunks * width, len(functions), np.int32)
    padded[:n] = symbols
    flat = np.concatenate([functions, np.arange(many, dtype=np.uint8)[None]]).ravel()
    columns = np.ascontiguousarray(padded.reshape(chunks, width).T) * np.int32(many)
    whole = np.broadcast_to(np.arange(many, dtype=np.uint8), (chunks, many))
    for c in columns:
        whole = flat.take(c[:, None] + whole)
    now = states_before(np.arange(chunks), whole, first, width)
    out = np.empty((width, chunks), np.uint8)
    for j, c in enumerate(columns):
        out[j] = now
        now = flat.take(c + now)
    return np.ascontiguousarray(out.T).ravel()[:n]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, read once a Python worker from the Unicode tables that tiktoken itself uses."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = kind
    out[32] = SPACE
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each character's first byte, its code point) of UTF-8 bytes."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    point = raw[at].astype(np.int32)
    wide = np.flatnonzero(point >= 0xC0)
    if len(wide):
        tail = np.concatenate([raw, np.zeros(3, np.uint8)])
        lead, where = point[wide], at[wide]
        b1, b2, b3 = (tail[where + i].astype(np.int32) & 0x3F for i in (1, 2, 3))
        two, three = (lead & 0x1F) << 6 | b1, (lead & 0x0F) << 12 | b1 << 6 | b2
        four = (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
        point[wide] = np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)
    return at, point


def slices(raws: Sequence[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, begin and end of each pre-token in them, number of pre-tokens before each text and in all)."""
    joined = b"\n".join(raws) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    stops = np.cumsum([len(r) + 1 for r in raws]) - 1
    at, point = code_points(b)
    kind = classes()[point]
    symbols = kind.copy()  # letters, numbers and others have the numbers of their classes
    blank = kind >= SPACE
    before_text = np.append(~blank[1:], False)
    symbols[blank] = INNER
    last = blank & before_text
    symbols[last] = np.where(kind[last] == SPACE, JOINING, ALONE)
    # The joined bytes end with a stop, so two characters follow wherever a contraction can begin.
    quotes = np.flatnonzero(point == 39)
    quotes = quotes[quotes + 2 < len(point)]
    one, two = point[quotes + 1], point[quotes + 2]
    symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    symbols[quotes[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = LONG
    stop_chars = np.searchsorted(at, stops)
    symbols[stop_chars] = END
    begins = at[BEGINS[symbols, states_before(symbols, FOLLOWS)]]
    ends = np.append(begins[1:], len(joined))
    real = np.ones(len(begins), bool)
    real[np.searchsorted(begins, stops)] = False
    begins, ends = begins[real], ends[real]
    return joined, begins, ends, np.searchsorted(begins, np.concatenate([[0], stops + 1]))


def cut_long(raw: bytes, room: int = ROOM) -> Iterator[bytes]:
    """A text in parts of room to about twice as many bytes, if it has them: cut before a space between two of a-z, where a token
    begins whatever stands around. Where no such space comes, a part is longer."""
    at = 0
    while len(raw) - at > 2 * room:
        low = at + room
        while low < len(raw):
            b = np.frombuffer(raw, np.uint8, min(room, len(raw) - low), low)
            small = (b >= 97) & (b <= 122)
            found = np.flatnonzero(small[:-2] & (b[1:-1] == 32) & small[2:])
            if len(found):
                cut = low + int(found[0]) + 1
                yield raw[at:cut]
                at = cut
                break
            low += max(1, len(b) - 2)
            if len(b) < 3:
                low = len(raw)
        else:
            break
    yield raw[at:]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: while some two neighbours have a rank together, those of the lowest rank become one, the
    leftmost of equals first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    # Neighbours as a linked list, pairs in a heap; entries whose parts have changed since are passed over.
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    gone = bytearray(n + 1)

    def offer(a: int) -> None:
        if a >= 0 and after[a] < n and (rank := ranks.get(piece[a : after[after[a]]])) is not None:
            heapq.heappush(heap, (rank, a, after[after[a]]))

    while heap:
        _, a, e = heapq.heappop(heap)
        middle = after[a]
        if gone[a] or middle >= n or after[middle] != e or middle == e:
            continue
        gone[middle] = 1
        after[a] = e
        if e < n:
            before[e] = a
        offer(before[a])
        offer(a)
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : after[a]]])
        a = after[a]
    return out


class Merger:
    """Pair merging with the ids of pre-tokens kept: two generations of `room` each, of which the older goes when the younger
    is full. Those that are not kept are merged many at a time; pre-tokens over 64 bytes one by one, and never kept."""

    WIDTHS = (8, 16, 32, 64)

    def __init__(self, path: str, room: int = 1 << 17):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.room, self.young, self.old = room, {}, {}
        self.none = np.int32(max(self.ranks.values(), default=-1) + 1)
        tokens = [b""] * int(self.none)
        for raw, i in self.ranks.items():
            tokens[i] = raw
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # What each two tokens give together, sorted by both.
        pairs = sorted((self._key(a, b), i) for raw, i in self.ranks.items() for k in range(1, len(raw)) if (a := self.ranks.get(raw[:k])) is not None and (b := self.ranks.get(raw[k:])) is not None)
        self.keys = np.array([k for k, _ in pairs] + [-1], np.int64)[: max(1, len(pairs))]
        self.gives = np.array([i for _, i in pairs] + [self.none], np.int32)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    @staticmethod
    def _key(a, b):
        return a << 24 | b

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two tokens as one; the number of ranks where they are none, as where one of them is -1."""
        key = self._key(a.astype(np.int64), b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.gives[at], self.none)

    def merge_many(self, pieces: Sequence[bytes]) -> dict[bytes, bytes]:
        """The ids of pre-tokens of at most 64 bytes. Each step merges the leftmost lowest pair of every pre-token."""
        out, least = {p: np.int32(self.ranks[p]).tobytes() for p in pieces if p in self.ranks}, 0
        for width in self.WIDTHS:
            own = [p for p in pieces if least < len(p) <= width and p not in out]
            least = width
            if not own:
                continue
            ids = self.of_byte[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in own), np.uint8).reshape(-1, width)]
            ids[np.arange(width) >= np.array([len(p) for p in own])[:, None]] = -1
            pairs, who = self.together(ids[:, :-1], ids[:, 1:]), np.arange(len(own))
            while len(own):
                at = pairs.argmin(1)
                rank = pairs[np.arange(len(pairs)), at]
                if (done := rank == self.none).any():
                    for k in np.flatnonzero(done):
                        out[own[who[k]]] = ids[k, : np.count_nonzero(ids[k] >= 0)].tobytes()
                    ids, pairs, who, at, rank = (x[~done] for x in (ids, pairs, who, at, rank))
                    if not len(who):
                        break
                row, column = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
                ids[row, at] = rank
                # What follows the merged pair moves one place to the left.
                from_ = column + (column > at[:, None])
                pairs = np.take_along_axis(np.pad(pairs, ((0, 0), (0, 1)), constant_values=self.none), column + (column >= at[:, None]), 1)
                ids = np.take_along_axis(ids, from_, 1)
                ids = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)
                pairs[row, at] = self.together(rank, ids[row, at + 1])
                left = np.flatnonzero(at > 0)
                pairs[left, at[left] - 1] = self.together(ids[left, at[left] - 1], rank[left])
        return out

    def _keep(self, found: dict[bytes, bytes]) -> None:
        if len(self.young) + len(found) > self.room:
            self.old, self.young = self.young, {}
        self.young.update(found)

    def encode(self, raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, place in its text's bytes where each token ends, number of ids before each text and in all)."""
        joined, begins, ends, firsts = slices(raws)
        pieces = [joined[a:e] for a, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        found = list(map(self.young.get, pieces))
        lost = [k for k, x in enumerate(found) if x is None]
        missed = {pieces[k] for k in lost}
        given = {p: self.old[p] for p in missed & self.old.keys()}
        given |= self.merge_many([p for p in missed if len(p) <= 64 and p not in given])
        self._keep(given)
        given |= {p: np.array(merge(p, self.ranks), "<i4").tobytes() for p in missed if len(p) > 64}
        for k in lost:
            found[k] = given[pieces[k]]
        ids = np.frombuffer(b"".join(found), "<i4")
        counts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2)])
        bounds = counts[firsts]
        reached = np.cumsum(self.lengths[ids])
        ahead = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        return ids, reached - np.repeat(ahead[:-1], np.diff(bounds)), bounds

    def encode_long(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode of one text, part by part (cut_long), so that only its ids and their ends are held whole."""
        ids, ends, ahead = [], [], 0
        for part in cut_long(raw):
            some, reached, _ = self.encode([part])
            ids.append(some)
            ends.append((reached + ahead).astype(np.int32))
            ahead += len(part)
        return np.concatenate(ids), np.concatenate(ends), np.array([0, sum(map(len, ids))])

    def decode(self, ids: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, where each ends): every token's bytes go to the place that its retained end tells."""
        lengths = self.lengths[ids]
        has = np.flatnonzero(np.diff(bounds))
        sizes = np.zeros(len(bounds) - 1, np.int64)
        sizes[has] = ends[bounds[1:][has] - 1]
        stops = np.cumsum(sizes)
        places = np.repeat(stops - sizes, np.diff(bounds)) + ends - lengths
        if len(ids) and not (places[0] == 0 and np.array_equal(places[1:], (places + lengths)[:-1])):
            raise ValueError("the retained ends are not those of these ids")
        return self.bytes[np.repeat(self.starts[ids] - places, lengths) + np.arange(int(lengths.sum()))], stops


@lru_cache(maxsize=1)
def merger(path: str) -> Merger:
    """One for each Python worker."""
    return Merger(path)


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ROOM bytes."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROOM, "right")))
        yield at, stop
        at = stop


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def ranks_path(ranks: str | None) -> str:
    import public_tokenizers

    return ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """Returns (id, ids, ends) of each row: the ids of its whole text and the place in its UTF-8 bytes where each token ends.

    Code points become classes, classes symbols of an automaton, and the states before all symbols are found by composing
    their transition functions (states_before), for many texts at once; no regular expression is run. The slices between
    the boundaries are merged by ranks, the ids of frequent ones kept; long texts are read part by part (cut_long). Results are those of tiktoken's encode_ordinary with
    the rank file and the public pattern that the automaton stands for; special tokens are text. ranks is a path that all
    executors can read. A null or empty text has no ids, a text of any length is one row (of at most 2^31 bytes), equal rows
    have equal ids, an empty table gives no rows; further columns play no part. Ids may be null.
    """
    path = ranks_path(ranks)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for b in batches:
            raws = [x or b"" for x in b.column(1).to_pylist()]
            for a, e in _runs(np.array([len(x) for x in raws], np.int64)):
                if e - a == 1:
                    ids, ends, bounds = own.encode_long(raws[a])
                else:
                    ids, ends, bounds = own.encode(raws[a:e])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), _lists(ids, bounds), _lists(ends, bounds)], ["id", "ids", "ends"])

    return narrow.mapInArrow(rows, f"id {dict(narrow.dtypes)['id']}, {ENCODED}")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """encoded, as encode gives it, with the bytes that its ids stand for as a further column, decoded.

    Each token's bytes are put where its retained end tells, all tokens of many rows at once. Rows without ids, or with null
    ids, give no bytes. Ends that are not those of the ids raise an error, as do ids that the rank file lacks.
    """
    path = ranks_path(ranks)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for b in batches:
            counts = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, e in _runs(counts.astype(np.int64) * 4):
                part = b.slice(a, e - a)
                bounds = np.concatenate([[0], np.cumsum(counts[a:e], dtype=np.int64)])
                ids, ends = (part.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
                raw, stops = own.decode(ids, ends, bounds)
                offsets = pa.py_buffer(np.concatenate([[0], stops]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.Array.from_buffers(pa.binary(), e - a, [None, offsets, pa.py_buffer(raw.tobytes())])], [*part.schema.names, "decoded"])

    narrow = encoded.select("id", "ids", "ends")
    return narrow.mapInArrow(rows, f"id {dict(narrow.dtypes)['id']}, {ENCODED}, decoded binary")
