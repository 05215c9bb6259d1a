"""The prefix trie against a plain one, and cases of odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from factlode.llm import prefix_trie
from factlode.llm.sql import SQL

DDL = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        path = own.get(c - base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    below, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * words
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


def run(spark, rows):
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, DDL))
    assert got.columns == COLUMNS
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in COLUMNS) for r in got.collect())


def conversations(seed, n=260):
    """Few different turns, so that prefixes are shared at all depths; some conversations are copies of a common one."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 2 * n), n):
        length = rng.choice([0, 1, 2, 3, 4, 6, 9, 20])
        turns = [("user" if k % 2 else "assistant", rng.choice(["a b", "c", "d e f"]) if k < 12 else f"t{rng.random()}") for k in range(length)]
        if rng.random() < 0.3:
            turns = [("system", "you are helpful")] + [("user", "same  words\there")] * 8
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_by_brute_force_and_sql(spark, seed):
    rows = conversations(seed)
    want = brute_force(rows)
    assert run(spark, rows) == want
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, DDL).toArrow())
    found = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op12_conversation_trie']})").fetchall()
    assert sorted(tuple(-1 if k == 2 and v is None else v for k, v in enumerate(r)) for r in found) == want


def test_many_ends_of_one_node_go_through_several_pieces(spark, monkeypatch):
    rows = [(c, 0, "user", "hello there") for c in range(0, 60_000, 20)] + [(c, 1, "user", "bye") for c in range(0, 60_000, 40)]
    want = brute_force(rows)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 200)
    assert run(spark, rows) == want


def test_a_long_conversation_is_peeled_in_few_rounds(spark, monkeypatch):
    rows = [(0, k, "user", f"turn {k}") for k in range(700)] + [(40, k, "user", f"turn {k}") for k in range(5)] + [(60, 0, "user", "x")]
    rounds = []
    peel = prefix_trie._peel
    monkeypatch.setattr(prefix_trie, "_peel", lambda chain, tails, folder: rounds.append(tails.agg({"depth": "max"}).first()[0]) or peel(chain, tails, folder))
    assert run(spark, rows) == brute_force(rows)
    assert rounds[0] <= 8


def test_odd_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 5, "user", ""), (None, 0, "user", "none"), (-5, 1, "user", "a"), (-20, 1, "user", "b"),
        (2, 3, "user", "same"), (2, 3, "user", "same"), (2, 3, "assistant", "tie"), (40, 0, "user", "w " * 200_000), (41, 0, "user", "z"),
    ]
    assert run(spark, rows) == brute_force(rows)


def test_further_columns_do_not_clash(spark):
    rows = conversations(3, 40)
    plain = spark.createDataFrame(rows, DDL)
    more = plain.selectExpr("*", "1 AS depth", "'x' AS a", "2 AS place", "3 AS words", "4 AS cut")
    assert sorted(map(repr, prefix_trie.conversation_trie(more).collect())) == sorted(map(repr, prefix_trie.conversation_trie(plain).collect()))
