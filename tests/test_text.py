import html
import math
from collections import Counter

from pyspark.sql import functions as F

from factlode.functions import text
from factlode.functions.html import html_to_text
from tests.plain_porter import stem
from factlode.operators import evidence, filings_text, retrieval

PAGE = (
    "<html><nav>Item 1. Menu</nav><script>var x = '</p> override';</script><body><h1>Cover</h1>"
    "<p>PART II Item 7. Management discussion</p><p>Research and development of products grew.</p>"
    "<p>Item 8. Financial statements</p><p>Net sales were 265.595 billion &amp; rising.</p>"
    "<p>Item 9A. Controls</p><p>Internal control was effective.</p></body></html>"
)


def documents(spark):
    raw = spark.createDataFrame([("0000000001", "acc-1", "10-K", "doc.htm", bytearray(PAGE.encode()))],
                                "cik string, accession_number string, form string, primary_document string, content binary")
    good, bad = filings_text.document_text(raw.withColumns({
        "filing_date": F.lit("2020-01-01").cast("date"), "report_period": F.lit(None).cast("date"),
        "content_sha256": F.sha2("content", 256)}))
    assert bad.count() == 0
    return good.drop("content")


def test_sections_and_offsets(spark):
    docs = documents(spark)
    chunks = filings_text.filing_chunks(docs)
    rows = chunks.orderBy("section_order").collect()
    assert [(r.section, r.subsection) for r in rows] == [
        ("PART II Item 7", "Management discussion"), ("Item 8", "Financial statements"), ("Item 9A", "Controls")]
    body = docs.first().body
    assert all(body[r.start_offset:r.end_offset] == r.text for r in rows)
    assert "override" not in body and "Menu" not in body and "& rising" in body
    assert [r.chunk_id for r in rows] == [r.chunk_id for r in filings_text.filing_chunks(docs).orderBy("section_order").collect()]


def test_labelled_retrieval(spark):
    chunks = filings_text.filing_chunks(documents(spark))
    labels = spark.createDataFrame(
        [("1", "research development products", "PART II Item 7"), ("2", "net sales 265.595", "Item 8"),
         ("3", "internal control effective", "Item 9A")], "query_id string, query string, label string")
    queries = labels.withColumn("cik", F.lit("0000000001"))
    hits = retrieval.bm25_search(chunks, queries, 3)
    joined = retrieval.search_hits(hits, chunks).select("query_id", "rank", F.col("section").alias("label"))
    scored = retrieval.evaluate_retrieval(labels.select("query_id", "label"), joined).first()
    assert (scored.recall_at_k, scored.mean_reciprocal_rank) == (1.0, 1.0)


def test_scores_against_brute_force(spark):
    bodies = {"a": "alpha beta beta net sales", "b": "alpha gamma net", "c": "delta sales net", "d": "omega"}
    chunks = spark.createDataFrame(
        [("1", i, "10-K", "x", "S", None, t) for i, t in bodies.items()],
        "cik string, chunk_id string, form string, accession_number string, section string, subsection string, text string")
    queries = spark.createDataFrame([("q", "1", "alpha beta net_sales")], "query_id string, cik string, query string")
    got = {r.chunk_id: float(r.score) for r in retrieval.bm25_search(chunks, queries, 10, stemmed=False).collect()}
    sizes = {i: len(t.split()) + 1 for i, t in bodies.items()}
    average = sum(sizes.values()) / 4
    want = Counter()
    for matches in ({"a": 1, "b": 1}, {"a": 2}, {"a": 1}):  # alpha, beta, the phrase "net sales"
        df = len(matches)
        idf = max(math.log((4 - df + 0.5) / (df + 0.5)), 0) or 1e-6
        for i, n in matches.items():
            f = 5.0 * n
            want[i] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[i] / average))
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "conflated": "conflat", "hopping": "hop",
             "filing": "file", "happy": "happi", "relational": "relat", "revenues": "revenu", "controlling": "control", "effective": "effect"}
    assert {w: stem(w) for w in pairs} == pairs


def test_packing_against_brute_force(spark):
    words = ["w" * (3 + (i * 7) % 40) for i in range(60)]
    body = "\n".join(words)
    row = spark.createDataFrame([(body,)], "t string").select(filings_text.pack_paragraphs(F.col("t"), "\n", 100).alias("c")).first()
    packed, current = [], ""
    for word in words:
        if current and len(current) + 1 + len(word) > 100:
            packed.append(current)
            current = word
        else:
            current = f"{current}\n{word}" if current else word
    packed.append(current)
    assert [c["text"] for c in row.c] == packed
    assert all(body[c["start"]:c["start"] + len(c["text"])] == c["text"] for c in row.c)


def test_excerpt(spark):
    body = "Intro line.\n" + "Filler sentence here. " * 40 + "The receivables grew fast. " + "Tail words follow. " * 60
    frame = spark.createDataFrame([(body, "receivables policy")], "text string, query string")
    row = evidence.with_excerpt(frame).first()
    assert "receivables" in row.excerpt and row.excerpt.endswith(".")
    assert body[row.excerpt_start:row.excerpt_start + len(row.excerpt)] == row.excerpt
    # brute force over the same rules
    centre = body.lower().find("receivables")
    start, end = centre - 233, centre - 233 + 700
    begin = max(body.rfind(". ", 0, start) + 2, body.rfind("\n", 0, start) + 1)
    stop = body.find(". ", end)
    assert row.excerpt == body[begin:stop + 1].strip()


def test_greedy_assignment(spark):
    queries = spark.createDataFrame([("1", "s1", 1, "q", "t"), ("1", "s2", 2, "q", "t"), ("1", "s3", 3, "q", "t")],
                                    "cik string, query_id string, signal_rank int, query string, test_id string")
    hits = spark.createDataFrame(
        [("1", "s1", 1, "a"), ("1", "s1", 2, "b"), ("1", "s2", 1, "a"), ("1", "s2", 2, "c"), ("1", "s3", 1, "a")],
        "cik string, query_id string, rank int, chunk_id string").withColumn("score", F.lit(1).cast("decimal(28,12)"))
    got = evidence.assign_hits(queries, hits).orderBy("packet_order").collect()
    assert [(r.signal_id, r.chunk_id) for r in got] == [("s1", "a"), ("s2", "c")]
    assert evidence.assign_hits(queries, hits, 1).count() == 1


def test_cleaning(spark):
    frame = spark.createDataFrame([(" a \t b \r\n\r\n c\x0bd ",)], "t string")
    assert frame.select(text.clean_text(F.col("t"))).first()[0] == "a b\nc\nd"
    page = spark.createDataFrame([("x<br>y<svg><p>z</p></svg>&lt;ok",)], "t string")
    assert page.select(html_to_text("t")).first()[0] == "x\ny<ok"


def test_html_nesting_comments_and_references(spark):
    cases = {
        "a<nav>b<svg>c</svg>hidden</nav>d": "ad",
        "a<!-- <nav> -->b<script>if (a < b) { '<nav>' }</script>c": "abc",
        "x<script>never closed <p>": "x",
        "a</nav>b<nav/>c<noscript>d</noscript>e": "abce",
        '<p title="a > b">t</p><BR/>u<tr class=x>v': "\nt\n\nu\nv",
        "<spanner>1 < 2 & 3 <navy>4": "1 < 2 & 3 4",
        "<!DOCTYPE html><?xml x?>k": "k",
    }
    references = ["caf&eacute;", "it&#8217;s", "&euro;5", "&copy2024", "&notit;", "&notin;", "&unknown;", "&#x1F600;", "&#150;", "&#xD800;", "&#99999999999;", "&", "&amp;lt;", "&ampx", "&hellip;&nbsp;!"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*cases, *references])], "k int, t string")
    got = [r.body for r in frame.select("k", html_to_text(F.col("t")).alias("body")).orderBy("k").collect()]
    assert got == [*cases.values(), *map(html.unescape, references)]


def test_folding_covers_the_alphabet(spark):
    words = ["Őrség", "Žižek", "Łódź", "e\u0301te\u0301", "ŞİŞLİ", "straße", "ﬁn", "Ǆ", "ÉCOLE", "ΣΊΣΥΦΟΣ", "plain", "Ⅷ", "ŉ"]
    frame = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, t string").orderBy("k")
    rows = frame.select(text.casefold(F.col("t")).alias("c"), text.fold_accents(F.col("t")).alias("a"), text.document_tokens(F.col("t")).alias("d")).collect()
    assert [r.c for r in rows] == [w.casefold() for w in words]
    assert [r.a for r in rows[:5]] == ["orseg", "zizek", "łodz", "ete", "sisli"] and all(len(r.d) == 1 for r in rows)


def test_case_folding_tells_other_characters_in_few_steps(spark):
    """The class holds runs, and only characters beyond Latin-1 are looked for in them; it matches the folded characters and no other."""
    assert len(text._CASE_CLASS) < 200
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x1F000)]))
    found = spark.createDataFrame([(every,)], "t string").select(F.regexp_extract_all("t", F.lit(text._CASE_CLASS), F.lit(0)).alias("f")).first().f
    assert found == sorted(text._CASE_FOLDED)
