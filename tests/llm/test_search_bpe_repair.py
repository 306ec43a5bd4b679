"""Ranked search, byte-level BPE and conversation repair against plain versions, with nulls, empty and long texts, ties, repeats."""

import base64
import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from pyspark.sql import functions as F

from studylake.llm import byte_bpe, max_sketch, queries, turn_repair

DOCS = "doc_id long, text string, rank int, score string, item string, raw string, ids int"
TURNS = "conv_id long, turn long, role string, text string, symbols string, id long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    some, every = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in set(items):
        found = []
        for i, c in held:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if c[t]:
                    m = 25 + 75 * n * some // every
                    score += math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, place + 1, None if none else i, -s) for place, (s, none, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("width,block", [(1 << 14, 1 << 18), (4, 30)])
def test_search(spark, width, block):
    """Narrow sketches only cost exact scores; many blocks of items give what one gives."""
    r = random.Random(4)
    vocabulary = ["the", "The", "of", "naïve", "日本", "x1", "été", *[f"w{i}" for i in range(150)]]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.choice((0, 3, 30, 90))))) for i in range(150)]
    docs += [(200 + i, "w1-w2,w3 w4") for i in range(20)] + [(7, "w5 w6"), (7, "w5 w6"), (300, None), (301, ""), (None, "w9 w9 été"), (302, ". - \n"), (303, " ".join(r.choices(vocabulary, k=30_000)))]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice((1, 8, 20))))) for i in range(25)] + [(90, "w1 w2 w3 w1"), (91, None), (92, "unseen"), (93, "w5. W5"), (93, "w5. W5"), (None, "w9")]
    have = spark.createDataFrame([(i, t, 1, "x", "y", "z", 2) for i, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string")
    got = [tuple(x) for x in max_sketch.search(have, asked, k=6, width=width, block_terms=block).collect()]
    assert len(got) == len(set(got)) or any(x[2] == 7 for x in got)
    assert set(got) == plain_search(docs, items, 6)


def test_search_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert max_sketch.search(none, asked).count() == 0 and max_sketch.search(some, asked.where("false")).count() == 0
    assert [tuple(x) for x in max_sketch.search(some, asked).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 800)))]


def test_states_are_those_of_a_plain_walk():
    r = np.random.default_rng(3)
    functions = r.integers(0, 5, (7, 5)).astype(np.uint8)
    for n in (0, 1, 63, 64, 65, 5000, 300_000):
        symbols = r.integers(0, 7, n)
        state, want = 2, []
        for s in symbols.tolist():
            want.append(state)
            state = int(functions[s, state])
        assert byte_bpe.states_before(symbols, functions, 2).tolist() == want


def tiktoken_encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(3)
    letters = [*"aab zS'''strevmdl 12٣  \n\t\r 　éß漢字🙂!.,-_", "'s", "'re", "'ll", "  ", " \n", "\x1c", "\x85", "́", "﻿"]
    out = ["", "'", "''s", "don't we'll 'tis", "'sa 're x", "a  b", "a \n b", "  ", "\n\na", " 's", " \n's", "'LL 'll", "<|endoftext|>", None]
    out += ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)]
    return out + ["a" * 3000, "ab" * 3000, "日本" * 700, " " * 2000 + "x", "'re" * 500, "".join(r.choices("abcdefgh", k=4000)), "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x20000)])), "long text. " * 200_000]


def test_byte_bpe(spark):
    texts = odd_texts()
    bpe = tiktoken_encoding()
    docs = spark.createDataFrame([(i, t, 1, "x", "y", "z", 2) for i, t in enumerate(texts)] + [(None, "twice", 1, "x", "y", "z", 2)] * 2, DOCS).repartition(3)
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        text = "twice" if row["id"] is None else texts[row["id"]] or ""
        assert row["ids"] == bpe.encode_ordinary(text) and bytes(row["decoded"]) == text.encode()
        assert row["ends"] == np.cumsum([len(bpe.decode_single_token_bytes(t)) for t in row["ids"]], dtype=int).tolist()
    assert byte_bpe.encode(docs.where("false")).count() == 0


def test_kept_pre_tokens_change_nothing():
    words = [f"{'qxz'[i % 3]}{i % 977}word{i % 31}".encode() for i in range(20_000)]
    small, large = byte_bpe.Merger(RANKS, room=50), byte_bpe.Merger(RANKS)
    for a in range(0, len(words), 500):
        text = [b" ".join(words[a : a + 500])]
        assert all(np.array_equal(x, y) for x, y in zip(small.encode(text), large.encode(text), strict=True))
    assert len(small.young) <= 500


def test_wrong_ends_are_refused():
    own = byte_bpe.Merger(RANKS)
    ids, ends, bounds = own.encode([b"one two", b"three"])
    with pytest.raises(ValueError, match="ends"):
        own.decode(ids, ends + 1, bounds)


def test_byte_bpe_query(spark):
    bpe = tiktoken_encoding()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op12_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = bpe.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


BLANK = " \t\n\x0b\x0c\r"


def plain_repair(rows, costs=turn_repair.COSTS):
    """Dijkstra's search over (turn, role before) with the audit as the second part of the cost."""
    rerole, delete, insert, cut = costs
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, been, found = [(0, "", 0, "", ())], set(), None
    while found is None:
        cost, audit, i, last, turns = heapq.heappop(heap)
        if (i, last) in been:
            continue
        been.add((i, last))
        if i == len(rows) and last in ("", "a"):
            found = cost, audit, turns
        follow = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[follow]
        heapq.heappush(heap, (cost + insert, audit + "I", i, follow, (*turns, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            more = cut if faults[i] == "truncated" else 0
            heapq.heappush(heap, (cost + delete, audit + "D", i + 1, last, turns))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] == follow or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*turns, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + rerole, audit + "R", i + 1, follow, (*turns, f"{name}:{text}")))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, found[0], found[1], "\n".join(found[2])


def conversations():
    r = random.Random(8)
    texts = ["Yes.", "No", "What?", " ", "", "\n\t", "Well done!", "so", None, "Long. " * 3000]
    rows = []
    for c in range(120):
        for t in range(r.choice((1, 2, 5, 9))):
            role = r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            rows.append((c, r.choice((t, t, t, 2 * t, None)), role, r.choice(texts) if r.random() < 0.5 else f"Turn {t}{r.choice('.?!x')}"))
    rows += [(None, 0, "user", "Hm?"), (None, 1, "assistant", "Hm."), (500, 3, "assistant", "A."), (501, 0, "user", "x")]
    return rows + [(600, i // 3, ("user", "assistant", "user")[i % 3], f"{i}{'.x'[i % 7 == 0]}") for i in range(700)] + [(601, 5, "user", "same.")] * 300 + [(602, i, "user", "same.") for i in range(300)]


@pytest.mark.parametrize("room,costs", [(4096, turn_repair.COSTS), (7, turn_repair.COSTS), (3, (1, 2, 1, 4))])
def test_repair(spark, room, costs):
    """Small chunks make the long conversations lie in many tasks; other costs make inserts worth their while."""
    rows = conversations()
    have = spark.createDataFrame([(*x, "s", 1) for x in rows], TURNS).repartition(3)
    audited = turn_repair.audits(have, costs=costs, room=room)
    got = {x["conv"]: tuple(x)[1:] for x in audited.collect()}
    texts = defaultdict(list)
    for x in turn_repair.repaired(have, audited).collect():
        texts[x["conv"]].append((x["place"], f"{x['role']}:{x['text']}"))
    shas = {x["conv"]: x["sha256"] for x in turn_repair.digests(turn_repair.repaired(have, audited)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    assert got.keys() == by.keys()
    for c, own in by.items():
        *want, text = plain_repair(own, costs)
        assert got[c] == tuple(want), c
        assert [p for p, _ in sorted(texts[c])] == list(range(len(texts[c])))
        assert "\n".join(x for _, x in sorted(texts[c])) == text
        assert shas.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
    assert turn_repair.audits(have.where("false")).count() == 0


def test_damage(spark):
    rows = conversations()
    have = spark.createDataFrame([(*x, "s", 1) for x in rows], TURNS)
    want = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = [tuple(x) for x in turn_repair.damaged(have).collect()]
    key = lambda x: [(y is not None, y if y is not None else 0) for y in x[:2]] + list(x[2:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_repair_query_has_all_conversations(spark):
    got = queries.op13_turn_repair(spark, SMALL)
    every = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct()
    assert got.count() == every.count() == got.join(every, "conv_id").where(F.col("audit").isNotNull()).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    shown = lambda df: sorted(tuple("~" if x is None or x != x else str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert sorted(got.columns) == columns and shown(got) == shown(want)


def test_parts_of_long_texts_have_the_tokens_of_the_whole():
    r, own, bpe = random.Random(5), byte_bpe.Merger(RANKS), tiktoken_encoding()
    letters = [*"aab zS'''strevmdl 12٣  \n\t\r éß漢字🙂!., ", "'s", "'re", "'ll", "  ", " \n"]
    for room in (7, 20, 64):
        for _ in range(500):
            text = "".join(r.choices(letters, k=r.randint(0, 400)))
            parts = list(byte_bpe.cut_long(text.encode(), room))
            assert b"".join(parts) == text.encode()
            assert [x for p in parts for x in own.encode([p])[0].tolist()] == bpe.encode_ordinary(text)
    long = "Some words of a long text, isn't it? " * 100_000
    ids, ends, bounds = own.encode_long(long.encode())
    assert len(list(byte_bpe.cut_long(long.encode()))) > 2 and ids.tolist() == bpe.encode_ordinary(long)
    assert ends[-1] == len(long) and bounds.tolist() == [0, len(ids)] and len(list(byte_bpe.cut_long(b"x" * 5_000_000))) == 1
