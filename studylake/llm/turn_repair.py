"""Conversation structure repair by block tables: cost vectors move through blocks of turns by lookup, blocks are traced by expanding them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import BLANKS, keep

# What stands before a place in a repaired conversation: nothing, a system turn, a user turn, an assistant turn. It may end at
# the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that can come next with role user or assistant.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = "uaso"
# Symbols of turns: one that must go, turns of the roles u, a, s and others, the same truncated, and none.
GO, WHOLE, CUT, NO_TURN = 0, 1, 5, 9
SYMBOLS = 10
FAR = 1 << 24
#: Costs of rerole, delete and insert, and what an undeleted truncated turn adds.
COSTS = (1, 2, 5, 5)
CHUNK = 4096
KEY = ["conv", "timed", "turn", "role", "digest"]


def kept_to(state: int, role: str) -> int | None:
    """The state after a turn that keeps its role, if it may stand there."""
    if role == "s":
        return SYSTEM if state == NOTHING else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


class Blocks:
    """Tables over all blocks of `length` symbols.

    A cost vector tells, for each state before a place, the least cost of what follows. Less its least entry it is one of a
    small set: all vectors that symbols can lead to are found by search. For each of them after a block and each block,
    `before` has the vector before the block and `adds` what is to be added to it. Shorter blocks are filled with NO_TURN.
    """

    def __init__(self, costs: tuple[int, int, int, int] = COSTS, length: int = 4):
        self.rerole, self.delete, self.insert, self.cut = costs
        self.length, self.codes = length, SYMBOLS ** np.arange(length - 1, -1, -1)
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.last, _ = self.number(self.inserted((0, FAR, FAR, 0)))
        self.units = [self.number(tuple(0 if q == e else FAR for q in range(4)))[0] for e in range(4)]
        steps: list[list[tuple[int, int]]] = []
        while len(steps) < len(self.vectors):
            v = self.vectors[len(steps)]
            steps.append([self.number(self.step(v, s)) for s in range(SYMBOLS)])
        one = np.array(steps)
        before, adds = one[:, :, 0], one[:, :, 1]
        for _ in range(length - 1):
            # The symbols of a block are taken from its end, so a further one in front is taken last.
            before, adds = (np.stack(x, 1).reshape(len(one), -1) for x in zip(*[(one[before, s, 0], adds + one[before, s, 1]) for s in range(SYMBOLS)], strict=True))
        self.before, self.adds = before.tolist(), adds.tolist()
        self.seen: dict[tuple[int, int, int], tuple[str, int]] = {}

    def number(self, v: tuple[int, ...]) -> tuple[int, int]:
        least = min(v)
        v = tuple(FAR if x >= FAR else x - least for x in v)
        if v not in self.numbers:
            self.numbers[v] = len(self.vectors)
            self.vectors.append(v)
        return self.numbers[v], least

    def inserted(self, v: tuple[int, ...]) -> tuple[int, ...]:
        """v where turns may be inserted, too; a chain of at most three leads everywhere."""
        for _ in range(3):
            v = tuple(min(x, self.insert + v[NEXT[q]]) for q, x in enumerate(v))
        return v

    def choices(self, symbol: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
        """(initial, state after, cost with what follows) of the edits of one turn, by initial."""
        if symbol == NO_TURN:
            return [("", state, after[state])]
        out = [("D", state, self.delete + after[state])]
        if symbol != GO:
            more = self.cut if symbol >= CUT else 0
            if (to := kept_to(state, ROLES[(symbol - WHOLE) % 4])) is not None:
                out.append(("K", to, more + after[to]))
            out.append(("R", NEXT[state], self.rerole + more + after[NEXT[state]]))
        return out

    def step(self, after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
        v = tuple(min(c for _, _, c in self.choices(symbol, q, after)) for q in range(4))
        return v if symbol == NO_TURN else self.inserted(v)

    def cut_up(self, symbols: bytes) -> list[int]:
        """The codes of the blocks; the first is filled in front."""
        raw = np.frombuffer(symbols, np.uint8)
        room = -len(raw) % self.length
        return (np.concatenate([np.full(room, NO_TURN, np.int64), raw]).reshape(-1, self.length) @ self.codes).tolist()

    def back(self, codes: list[int], last: int) -> tuple[list[int], int, int]:
        """(number of the vector after each block, of the one before all, what is to be added to it), by lookup."""
        after, total = [0] * len(codes), 0
        for k in range(len(codes) - 1, -1, -1):
            after[k] = last
            total += self.adds[last][codes[k]]
            last = self.before[last][codes[k]]
        return after, last, total

    def expand(self, after: int, code: int, state: int) -> tuple[str, int]:
        """(audit of a block, state after it) from a state before it. The vectors inside are expanded from the block's end to
        its begin; then the first of the edits by initial is taken that loses nothing, so no tie is decided too early."""
        found = self.seen.get((after, code, state))
        if found is None:
            symbols = [code // int(c) % SYMBOLS for c in self.codes]
            inside = [self.vectors[after]]
            for s in reversed(symbols):
                inside.append(self.step(inside[-1], s))
            inside.reverse()
            audit, q = "", state
            for i, s in enumerate(symbols):
                while True:
                    edits = self.choices(s, q, inside[i + 1])
                    if s != NO_TURN:
                        edits.insert(1, ("I", NEXT[q], self.insert + inside[i][NEXT[q]]))
                    initial, q = next((e, to) for e, to, c in edits if c == inside[i][q])
                    audit += initial
                    if initial != "I":
                        break
            found = self.seen[after, code, state] = audit, q
        return found

    def trace(self, codes: list[int], after: list[int], state: int) -> tuple[str, int]:
        parts = []
        for code, v in zip(codes, after, strict=True):
            part, state = self.expand(v, code, state)
            parts.append(part)
        return "".join(parts), state

    @staticmethod
    def closing(state: int) -> str:
        """Inserts after the last turn."""
        return {SYSTEM: "II", USER: "I"}.get(state, "")

    def through(self, symbols: bytes) -> list[list[int]]:
        """Least cost from each state before the symbols to each after them."""
        codes, out = self.cut_up(symbols), []
        for unit in self.units:
            _, v, total = self.back(codes, unit)
            out.append([min(x + total, FAR) for x in self.vectors[v]])
        return [list(x) for x in zip(*out, strict=True)]

    def ahead(self, through: list[list[int]], after: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(min(c + a for c, a in zip(row, after, strict=True)) for row in through)


@lru_cache(maxsize=2)
def blocks(costs: tuple[int, int, int, int] = COSTS) -> Blocks:
    """One for each Python worker."""
    return Blocks(costs)


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, timed, turn, role, digest, text) of each row; a null role or text is one space."""
    text, role = F.coalesce(F.col(text_col), F.lit(" ")), F.coalesce(F.col(role_col), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).isNotNull().alias("timed"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def marked_turns(turns: DataFrame) -> DataFrame:
    """Equal rows once: (conv, timed, turn, role, digest, blank, cut, n, first); n rows are equal, first tells whether the
    conversation has the role and text for the first time. A table in the shared folder without texts."""
    inner = F.btrim("text", F.lit(BLANKS))
    flags = turns.select(*KEY, (inner == "").alias("blank"), (~F.substring(inner, -1, 1).isin(".", "!", "?")).alias("cut"))
    light = keep(flags.groupBy(*KEY).agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count("*").alias("n")), "turns")
    least = light.groupBy("conv", "role", "digest").agg(F.min(F.struct("timed", "turn")).alias("at"))
    least = least.select(F.col("conv").alias("conv_"), F.col("at.timed").alias("timed_"), F.col("at.turn").alias("turn_"), F.col("role").alias("role_"), F.col("digest").alias("digest_"), F.lit(True).alias("first"))
    joined = light.join(least, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in KEY], "left")
    return keep(joined.select(*KEY, "blank", "cut", "n", F.coalesce("first", F.lit(False)).alias("first")), "turns")


def chunks_of(marked: DataFrame, room: int, costs: tuple[int, int, int, int]) -> DataFrame:
    """Chunks of at most room symbols of consecutive turns, each within a range of the turns of all conversations in order."""
    conv = dict(marked.dtypes)["conv"]
    names = ["symbols", "through", "roles", "turns", "least", "most", "blank", "duplicate", "truncated", "illegal"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, seq, schema = blocks(costs), None, 0, None

        def done(c: dict) -> dict:
            return c | {"symbols": bytes(c["symbols"]), "through": [x for row in tables.through(bytes(c["symbols"])) for x in row], "roles": c["first"] + c["last"]}

        def fresh(r: dict) -> dict:
            return {k: r[k] for k in KEY} | {"seq": seq, "symbols": bytearray(), "first": "", "last": "", "turns": 0, "least": None, "most": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

        def flush(some: list[dict]) -> Iterator[pa.RecordBatch]:
            if some:
                yield pa.RecordBatch.from_arrays([*[pa.array([c[k] for c in some], schema.field(k).type) for k in KEY], *[pa.array([c[k] for c in some]) for k in ("seq", "symbols")], pa.array([c["through"] for c in some], pa.list_(pa.int32())), pa.array([c["roles"] for c in some]), *[pa.array([c[k] for c in some], pa.int64()) for k in names[3:]]], [*KEY, "seq", *names])

        for b in batches:
            schema, out = b.schema, []
            for r in b.to_pylist():
                initial = r["role"][:1] if r["role"][:1] in tuple("uas") else "o"
                stays = r["first"] and not r["blank"]
                left, symbol = r["n"], (CUT if r["cut"] else WHOLE) + ROLES.index(initial) if stays else GO
                if held is not None and held["conv"] != r["conv"]:
                    out.append(done(held))
                    held = None
                while left:
                    if held is not None and len(held["symbols"]) >= room:
                        out.append(done(held))
                        held = None
                    if held is None:
                        seq += 1
                        held = fresh(r)
                    some = min(left, room - len(held["symbols"]))
                    held["illegal"] += (some - 1) + (bool(held["last"]) and held["last"] + initial not in ("su", "ua", "au"))
                    held["first"], held["last"] = held["first"] or initial, initial
                    held["symbols"] += bytes([symbol]) + bytes(some - 1) if left == r["n"] else bytes(some)
                    stay = int(stays and left == r["n"])
                    held["blank"] += some * r["blank"]
                    held["duplicate"] += (some - stay) * (not r["blank"])
                    held["truncated"] += stay * r["cut"]
                    if r["timed"]:
                        held["turns"] += r["turn"] != held["most"]
                        held["least"], held["most"] = r["turn"] if held["least"] is None else held["least"], r["turn"]
                    left -= some
            yield from flush(out)
        if held is not None:
            yield from flush([done(held)])

    ordered = marked.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    schema = f"conv {conv}, timed boolean, turn long, role string, digest binary, seq long, symbols binary, through array<int>, roles string, {', '.join(f'{c} long' for c in names[3:])}"
    return keep(ordered.mapInArrow(rows, schema), "turn-chunks")


AUDITED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: tuple[int, int, int, int] = COSTS, room: int = CHUNK) -> DataFrame:
    """Returns (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of df, as a table in the
    shared folder.

    Turns stand by number, nulls first; those of one number by role and SHA-256 of the text. A turn's first fault counts:
    blank, duplicate (role and text stood before), truncated (last character other than blanks not one of .!?). audit is the
    cheapest way to roles `(s?(ua)+)?` by Keep, Rerole, Delete and Insert, the least string of several; an initial other than
    u, a and s fits nowhere. gaps counts missing numbers between the smallest and the largest, illegal neighbours that are
    not su, ua or au.

    Cost vectors pass through blocks of four turns by lookup (Blocks). A conversation is a row of chunks of at most room turns,
    ranges of all turns in order, so a huge one lies in many tasks: chunks give their least costs between all states, only
    these 16 numbers a chunk meet in one task, which finds the vector after each chunk; then all chunks are traced at once
    from each state before them, and the traces joined. Equal rows count as one with a number. A null or empty text is
    blank, a null role one space, null conversations are one; rows with a null number count no gaps. An empty table gives
    no rows; further columns play no part. An audit is one string, so a conversation has at most 2^31 turns.
    """
    marked = marked_turns(turns_of(df, conv_col, turn_col, role_col, text_col))
    conv = dict(marked.dtypes)["conv"]
    chunks = chunks_of(marked, room, costs)
    chunks = chunks.withColumn("id", F.xxhash64(*KEY, "seq"))
    order = [*KEY, "seq"]

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, one, fields = blocks(costs), None, None

        def result(c: dict) -> dict:
            ends, number, cost = [], tables.last, 0
            if len(c["ids"]) == 1:
                codes = tables.cut_up(c["symbols"])
                after, number, cost = tables.back(codes, number)
                audit, state = tables.trace(codes, after, NOTHING)
                audit += tables.closing(state)
            else:
                audit = None
                for place in range(len(c["ids"]) - 1, -1, -1):
                    # It is the vector that all later turns give one by one, so it is in the tables.
                    v, m = tables.vectors[number], c["through"][place]
                    ends.append((c["ids"][place], place, list(v)))
                    number, more = tables.number(tables.ahead([m[4 * q : 4 * q + 4] for q in range(4)], v))
                    cost += more
            cost += tables.vectors[number][NOTHING]
            gaps = c["most"] - c["least"] + 1 - c["turns"] if c["turns"] else 0
            return {"conv": c["conv"], "gaps": gaps, **{k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "ends": [{"id": i, "place": p, "after": a} for i, p, a in ends]}

        ends_type = pa.list_(pa.struct([("id", pa.int64()), ("place", pa.int64()), ("after", pa.list_(pa.int32()))]))

        def flush(some: list[dict]) -> Iterator[pa.RecordBatch]:
            if some:
                counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
                yield pa.RecordBatch.from_arrays([pa.array([c["conv"] for c in some], fields), *[pa.array([c[k] for c in some], pa.int64()) for k in counts], pa.array([c["audit"] for c in some], pa.string()), pa.array([c["ends"] for c in some], ends_type)], ["conv", *counts, "audit", "ends"])

        for b in batches:
            fields, out = b.schema.field("conv").type, []
            for r in b.to_pylist():
                if one is None or one["conv"] != r["conv"]:
                    if one is not None:
                        out.append(result(one))
                    one = r | {"ids": [r["id"]], "through": [r["through"]]}
                    continue
                one["illegal"] += r["illegal"] + (one["roles"][-1] + r["roles"][0] not in ("su", "ua", "au"))
                one["turns"] += r["turns"] - (r["turns"] > 0 and one["most"] == r["least"])
                one["least"] = r["least"] if one["least"] is None else one["least"]
                one["most"] = one["most"] if r["most"] is None else r["most"]
                for k in ("blank", "duplicate", "truncated"):
                    one[k] += r[k]
                one["roles"] = r["roles"]
                one["symbols"] = b""
                one["ids"].append(r["id"])
                one["through"].append(r["through"])
            yield from flush(out)
        if one is not None:
            yield from flush([result(one)])

    narrow = chunks.repartition("conv").sortWithinPartitions(*order)
    found = keep(narrow.mapInArrow(gathered, f"conv {conv}, {AUDITED}, ends array<struct<id:long,place:long,after:array<int>>>"), "turn-audits")
    pending = found.where("audit IS NULL").select(F.col("conv").alias("of"), F.inline("ends")).withColumnRenamed("id", "end_id")
    open_ = chunks.select("conv", "id", "symbols").join(pending, F.col("conv").eqNullSafe(F.col("of")) & (F.col("id") == F.col("end_id")))

    def traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = blocks(costs)
        for b in batches:
            parts, states = [], []
            for symbols, after in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                codes = tables.cut_up(symbols)
                before = tables.back(codes, tables.numbers[tuple(after)])[0]
                every = [tables.trace(codes, before, q) for q in range(4)]
                parts.append([x for x, _ in every])
                states.append([q for _, q in every])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], ["conv", "place", "parts", "states"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, state, some = blocks(costs), [], NOTHING, None
        for b in batches:
            out, some = [], b.schema.field("conv").type
            for r in b.to_pylist():
                if r["place"] == 0 and held:
                    out.append((conv_of, "".join(held) + tables.closing(state)))
                    held, state = [], NOTHING
                conv_of = r["conv"]
                held.append(r["parts"][state])
                state = r["states"][state]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], some), pa.array([a for _, a in out], pa.string())], ["of", "traced"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([conv_of], some), pa.array(["".join(held) + tables.closing(state)], pa.string())], ["of", "traced"])

    traces = open_.select("conv", "place", "symbols", "after").mapInArrow(traced, f"conv {conv}, place long, parts array<string>, states array<int>")
    whole = traces.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(joined, f"of {conv}, traced string")
    both = found.drop("ends").join(whole, F.col("conv").eqNullSafe(F.col("of")), "left")
    return keep(both.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.coalesce("audit", "traced").alias("audit")), "turn-audits")


def repaired(df: DataFrame, audited: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns (conv, place, role, text): the turns of each conversation after the edits that audits found for df, from place 0.

    Turns are sorted by conversation and stream past the audit, so no conversation is held; its rows lie in one partition in
    their order. Conversations without turns after the edits give no rows. For nulls, ties and the rest see audits.
    """
    turns = turns_of(df, conv_col, turn_col, role_col, text_col)
    conv = dict(turns.dtypes)["conv"]
    heads = audited.select("conv", F.lit(0).alias("side"), F.lit(False).alias("timed"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"))
    both = heads.unionByName(turns.withColumn("side", F.lit(1)))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, state, conv_of = "", 0, 0, NOTHING, None
        for b in batches:
            out: list[tuple] = []

            def inserts() -> None:
                nonlocal at, place, state
                while at < len(audit) and audit[at] == "I":
                    state = NEXT[state]
                    out.append((conv_of, place, "user" if state == USER else "assistant", ""))
                    at, place = at + 1, place + 1

            for of, side, role, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if side == 0:
                    inserts()
                    audit, at, place, state, conv_of = text, 0, 0, NOTHING, of
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = kept_to(state, role[:1]) if edit == "K" else NEXT[state]
                    out.append((of, place, role if edit == "K" else "user" if state == USER else "assistant", text))
                    place += 1
            if out:
                kinds = (b.schema.field("conv").type, pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", "place", "role", "text"])
        if at < len(audit):
            rest, kind = [], b.schema.field("conv").type
            for _ in audit[at:]:
                state = NEXT[state]
                rest.append((conv_of, place, "user" if state == USER else "assistant", ""))
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rest, strict=True), (kind, pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "place", "role", "text"])

    placed = both.repartition("conv").sortWithinPartitions("conv", "side", *KEY[1:]).select("conv", "side", "role", "text")
    return placed.mapInArrow(rows, f"conv {conv}, place long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """Returns (conv, sha256) of what repaired gives: lowercase hex of its role:text, joined by newlines. As the turns of a
    conversation stream past in order, only a hash's state is held."""
    conv = dict(turns.dtypes)["conv"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv_of, kind = None, None, None

        def given(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], kind), pa.array([x for _, x in some], pa.string())], ["conv", "sha256"])

        for b in batches:
            out, kind = [], b.schema.field("conv").type
            for of, place, role, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if place == 0:
                    if state is not None:
                        out.append((conv_of, state.hexdigest()))
                    state, conv_of = hashlib.sha256(), of
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield given(out)
        if state is not None:
            yield given([(conv_of, state.hexdigest())])

    return turns.mapInArrow(rows, f"conv {conv}, sha256 string")


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """df with faults put into its rows by crc32 of `conversation:turn` modulo 20, nulls being one space: 0 drops a row, 1 empties
    its text, 2 takes its `.!?` away, 3 gives it twice, 4 makes it the user's. For tests of repairs."""

    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space(conv_col), F.lit(":"), or_space(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space(text_col), "[.!?]", "")).otherwise(or_space(text_col))
    role = F.when(kind == 4, "user").otherwise(or_space(role_col))
    rows = df.where(kind != 0).select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return rows.drop("again")
