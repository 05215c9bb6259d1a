"""Mixing against the plain procedure of resharing, and cases of odd rows."""

import duckdb
import pytest

from factlode.llm import mixing
from factlode.llm.sql import SQL

DDL = "doc_id long, text string, source string"


def reshared(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Targets by the words of the rule: what is above the stop is given to the others by weight, again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole = share * sum(sizes.values())
    target = {s: whole * weight[s] / sum(weight.values()) for s in names}
    stopped: set = set()
    for _ in range(1000):
        over = {s: target[s] - most * sizes[s] for s in names if s not in stopped and target[s] > most * sizes[s] + 1e-9}
        if not over:
            break
        stopped |= set(over)
        open_ = [s for s in names if s not in stopped]
        for s in over:
            target[s] = most * sizes[s]
        for s in open_:
            target[s] += sum(over.values()) * weight[s] / sum(weight[x] for x in open_)
    return target


def table(spark, rows):
    return spark.createDataFrame(rows, DDL)


def corpus(n=6000):
    text = lambda k: " ".join(["w"] * (1 + k * 7919 % 60))
    # one source with a third of all rows, one that stops at once, one that stops only after resharing, one of nulls
    source = lambda k: "hot" if k % 3 == 0 else "tiny" if k % 101 == 0 else None if k % 11 == 0 else f"s{k % 5}"
    return [(k, text(k), source(k)) for k in range(n)]


def test_targets_are_those_of_resharing(spark):
    rows = corpus()
    got = mixing.mix_counts(table(spark, rows)).collect()
    sizes: dict = {}
    for r, (_, text, source) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        assert r["size"] == len(text.split())
        sizes[source] = sizes.get(source, 0) + r["size"]
    want = reshared(sizes)
    by_id = {k: source for k, _, source in rows}
    taken: dict = {}
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s], rel=1e-9) and r["source_size"] == sizes[s]
        assert r["taken"] in (int(r["rate"]) * r["size"], (int(r["rate"]) + 1) * r["size"]) and r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert any(want[s] == 2 * sizes[s] for s in want) and any(want[s] < 1.6 * sizes[s] for s in want)
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.12)
    assert taken["hot"] == pytest.approx(want["hot"], rel=0.05)


def test_same_as_sql_and_rerun_alike_on_other_partitions(spark):
    rows = corpus(500)
    first = mixing.mix_counts(table(spark, rows).repartition(1))
    again = mixing.mix_counts(table(spark, rows[::-1]).repartition(5))
    want = sorted(map(tuple, first.collect()))
    assert want == sorted(map(tuple, again.collect()))
    con = duckdb.connect()
    con.register("documents", table(spark, rows).toArrow())
    assert sorted(con.sql(f"SELECT {', '.join(first.columns)} FROM ({SQL['op11_mixing']})").fetchall()) == want


def test_many_sources_are_joined_by_salted_keys(spark, monkeypatch):
    rows = [(k, "a b c " * (k % 4), f"site{k % 150:03d}" if k % 3 else "hot") for k in range(900)]
    want = sorted(map(tuple, mixing.mix_counts(table(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 10)
    assert sorted(map(tuple, mixing.mix_counts(table(spark, rows)).collect())) == want


def test_odd_rows(spark):
    empty = mixing.mix_counts(table(spark, []))
    assert empty.columns == ["doc_id", "size", "source_size", "target", "taken", "rate", "copies"] and empty.count() == 0
    wordless = mixing.mix_counts(table(spark, [(1, None, "x"), (2, " \n", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in wordless] == [(0, 0.0, 0)] * 2
    # nulls in every column, repeated rows, a very long text; the null source is the last of three
    rows = [(None, "a b", "x"), (1, None, None), (2, "a b", None), (2, "a b", None), (3, "a " * 300_000, "y")]
    got = mixing.mix_counts(table(spark, rows)).collect()
    assert sorted(r["size"] for r in got) == [0, 2, 2, 2, 300_000]
    pair = [r for r in got if r["doc_id"] == 2]
    assert len(pair) == 2 and pair[0] == pair[1]
    whole = {r["source_size"]: r["target"] for r in got}
    assert whole == {2: 4.0, 4: 8.0, 300_000: pytest.approx(450_009 - 12.0)}


def test_documents_come_as_often_as_counted_with_all_their_columns(spark):
    rows = corpus(600)
    docs = table(spark, rows).selectExpr("doc_id", "text", "source", "doc_id AS rate", "'k' AS copies", "text AS draw", "1 AS target", "2 AS _of")
    counted = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == [*docs.columns, "copy"]
    seen: dict = {}
    for r in out.collect():
        assert r["rate"] == r["doc_id"] and r["copies"] == "k" and r["draw"] == r["text"]
        seen.setdefault(r["doc_id"], []).append(r["copy"])
    assert {k: len(v) for k, v in seen.items()} == {k: n for k, n in counted.items() if n}
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())
    with pytest.raises(ValueError):
        mixing.mix_documents(docs, copy_column="rate")
