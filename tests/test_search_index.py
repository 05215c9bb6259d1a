"""The stored index: segments, phrases and stems against plain loops."""

import contextlib
import io
import math
import random
import re

from pyspark.sql import functions as F

from factlode.functions.stemming import porter
from factlode.operators import retrieval
from factlode.operators.search_index import OneTimeIndex, SearchIndex
from tests.plain_porter import stem

DDL = "cik string, chunk_id string, form string, accession_number string, section string, subsection string, text string"
WEIGHTS = (2.0, 1.0, 5.0)
WORDS = "report reported reporting sales sale of the and net income incomes filing files risk".split()


def rows_of(seed, n=60):
    rng = random.Random(seed)
    text = lambda size: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(size)))
    return [(str(k % 3), f"c{k}", rng.choice(["10-K", "10-Q"]), f"a{k % 5}", rng.choice(["Item 7", "Item 8"]), rng.choice([None, text(4)]), text(40)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def parts_of(row, stemmed):
    return [[stem(t) if stemmed else t for t in re.findall(r"[a-z0-9]+", (x or "").lower())] for x in row[4:7]]


def occurrences(parts, phrase):
    n = len(phrase)
    return sum(w * sum(p[i : i + n] == phrase for i in range(len(p) - n + 1)) for w, p in zip(WEIGHTS, parts))


def search(rows, queries, stemmed, k=10, own=False, keep=lambda r: True):
    """BM25 by loops: the best k of (score, chunk) for each query."""
    parts = {r[1]: parts_of(r, stemmed) for r in rows}
    size = {c: sum(map(len, p)) for c, p in parts.items()}
    out = {}
    for query_id, cik, query in queries:
        scope = [r for r in rows if not own or r[0] == cik]
        average = sum(size[r[1]] for r in scope) / max(1, len(scope))
        scores: dict = {}
        for word in dict.fromkeys(re.findall(r"[a-z0-9][a-z0-9_-]+", query.lower())):
            phrase = [stem(t) if stemmed else t for t in re.findall("[a-z0-9]+", word)]
            held = {r[1]: occurrences(parts[r[1]], phrase) for r in scope}
            df = sum(f > 0 for f in held.values())
            idf = math.log((len(scope) - df + 0.5) / (df + 0.5))
            idf = idf if idf > 0 else 1e-6
            for r in scope:
                if r[0] == cik and held[r[1]] and keep(r):
                    f = held[r[1]]
                    scores[r[1]] = scores.get(r[1], 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[r[1]] / average))
        out[query_id] = sorted(((-s, c) for c, s in scores.items()))[:k]
    return out


QUERIES = [("q1", "0", "reporting net_income sales"), ("q2", "1", "the-the of-the-and report"), ("q3", "2", "risk-risk-risk files absent-word"), ("q4", "9", "sales")]


def compare(spark, got, want):
    found: dict = {q: [] for q, _, _ in QUERIES}
    for r in got.collect():
        found[r["query_id"]].append((r["rank"], float(r["score"]), r["chunk_id"]))
    for q, hits in want.items():
        mine = sorted(found[q])
        assert len(mine) == len(hits)
        for (rank, score, chunk), (negative, _) in zip(mine, hits):
            assert abs(score + negative) < 1e-8
        assert sorted(c for _, _, c in mine) == sorted(c for _, c in hits) or len({round(s, 8) for s, _ in hits}) < len(hits)


def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, cik string, query string")


def test_one_time_search_with_phrases(spark):
    rows = rows_of(1)
    for stemmed in (False, True):
        compare(spark, retrieval.bm25_search(frame(spark, rows), queries(spark), 10, stemmed=stemmed), search(rows, QUERIES, stemmed))


def test_company_statistics_and_filters(spark):
    rows = rows_of(2)
    got = retrieval.bm25_search(frame(spark, rows), queries(spark), 5, stemmed=True, stats_scope="cik", forms=("10-K",), accessions=("a1", "a2"))
    compare(spark, got, search(rows, QUERIES, True, 5, own=True, keep=lambda r: r[2] == "10-K" and r[3] in ("a1", "a2")))


def test_refreshed_segments_equal_a_fresh_index(spark, tmp_path):
    rows, other = rows_of(3), {r[1]: r for r in rows_of(4)}
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4, slices=2)
    index.refresh(frame(spark, rows[:40]))
    now = {r[1]: r for r in rows[:40]}
    # changed rows keep their company, new ones come, some go; a row that is put in and taken out by one call stays
    changed = [(r[0], *other[r[1]][1:]) for r in rows[30:50]]
    index.refresh(frame(spark, changed + changed[:3]), frame(spark, rows[5:12] + changed[:1]).select("cik", "chunk_id"))
    now = {c: r for c, r in now.items() if c not in {x[1] for x in rows[5:12]}} | {r[1]: r for r in changed}
    index.refresh(frame(spark, rows[6:8]), frame(spark, [("0", "never", "", "", "", "", "")]).select("cik", "chunk_id"))
    now |= {r[1]: r for r in rows[6:8]}
    assert len(index.segments()) == 3
    left = list(now.values())
    for _ in range(2):
        fresh = OneTimeIndex(frame(spark, left), stemmed=True)
        order = lambda f, *columns: sorted(map(tuple, f.select(*columns).collect()))
        assert order(index.chunks(), "cik", "chunk_id", "length") == order(fresh.chunks(), "cik", "chunk_id", "length")
        assert order(index.postings(), "chunk_id", "term", "stem", "places") == order(fresh.postings(), "chunk_id", "term", "stem", "places")
        for stemmed in (False, True):
            assert order(index.frequencies(stemmed), "term", "document_frequency") == order(fresh.frequencies(stemmed), "term", "document_frequency")
            compare(spark, retrieval.bm25_search(None, queries(spark), 10, stemmed=stemmed, index=index), search(left, QUERIES, stemmed))
        assert index.corpus().first() == fresh.corpus().first()
        index.compact()
    assert len(index.segments()) == 1


def test_empty_chunks_and_texts(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=2, slices=1)
    index.refresh(frame(spark, []))
    assert retrieval.bm25_search(None, queries(spark), index=index).collect() == []
    index.refresh(frame(spark, [("0", "blank", None, None, "", None, None), ("0", "c", "10-K", "a", "", None, "sales " * 3)]))
    assert [(r["chunk_id"], r["rank"]) for r in retrieval.bm25_search(None, queries(spark), index=index).collect()] == [("c", 1)]
    assert tuple(index.corpus().first()) == (2, 1.5)


def test_stems_by_the_paper_word_by_word(spark):
    rng = random.Random(7)
    ends = "ational tional enci izer abli entli ousli ization ation ator alism iveness fulness aliti iviti biliti icate ative alize iciti ful ness ement ment ent ion ed ing eed s sses ies y e ll yy".split()
    words = {"", "a", "by", "sky", "naïve", "10ks", "caresses", "agreed", "hopping", "feed", "sing", "plastered", "troubled", "sized", "failing", "controll", "roll", "cease", "probate"}
    words |= {"".join(rng.choice("abcdeilmnostuvwxyz") for _ in range(rng.randint(0, 5))) + "".join(rng.choice(ends) for _ in range(rng.randint(1, 3))) for _ in range(20_000)}
    got = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", porter(F.col("w")).alias("s")).collect()
    assert [(r.w, r.s, stem(r.w)) for r in got if r.s != stem(r.w)] == []


def test_a_narrowed_index_holds_the_asked_tokens_alone(spark):
    """What a search doesn't ask for is left out where postings are unfolded; statistics of the corpus stay whole."""
    chunks = frame(spark, rows_of(5))
    for stemmed, asked in ((False, ["reported", "income", "absent"]), (True, ["report", "incom"])):
        index = OneTimeIndex(chunks, stemmed)
        narrow = index.narrowed(spark.createDataFrame([(t,) for t in [*asked, None, asked[0]]], "token string"))
        name = "stem" if stemmed else "term"
        pick = lambda i: sorted(map(str, i.postings().where(F.col(name).isin(asked)).select("cik", "chunk_id", "term", "stem", "places").collect()))
        assert pick(narrow) == pick(index) and narrow.postings().where(~F.col(name).isin(asked)).isEmpty()
        counts = lambda i: {r.term: r.document_frequency for r in i.frequencies(stemmed).collect() if r.term in asked}
        assert counts(narrow) == counts(index) and narrow.frequencies(stemmed).count() == len(counts(index))
        assert narrow.corpus().first() == index.corpus().first()


def test_postings_tokenise_a_text_once(spark):
    """No filter on the entries is put before they are unfolded; a chunk without tokens has no posting."""
    rows = [("1", "c1", "10-K", "a1", "Item 1", None, "Wares and wares"), ("1", "c2", "10-K", "a1", ".", None, ""), ("2", "c3", "10-Q", "a2", "Item 2", "x", "and")]
    chunks = spark.createDataFrame(rows, DDL)
    found = retrieval.document_frequency(retrieval.postings(chunks))
    assert {r.term: r.document_frequency for r in found.collect()} == {"item": 2, "1": 1, "2": 1, "wares": 1, "and": 2, "x": 1}
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        found.explain(extended=True)
    optimized = text.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("sort_array") == 1
