"""Evidence packets: one unused best hit per ranked signal, with a minimal excerpt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlode.functions.relations import let
from factlode.functions.text import QUERY_TERM, casefold, strip_space, word_count
from factlode.operators.retrieval import bm25_search

HITS_PER_SIGNAL = 8
MAX_PACKETS = 12
EXCERPT_CHARS = 700


def signal_queries(signals: DataFrame) -> DataFrame:
    """Search text of each signal: its test name and evidence phrases."""
    text = F.concat_ws(" ", F.replace("test_id", F.lit("_"), F.lit(" ")), F.array_join("evidence_requirements", " "))
    return signals.select(
        F.col("signal_id").alias("query_id"), "cik", text.alias("query"), "signal_rank", "test_id")


def assign_hits(queries: DataFrame, hits: DataFrame, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Greedy assignment in signal order: each signal takes its best chunk not yet used.

    A company has at most ten signals with eight hits each, so its row is bounded and the
    sequential rule is a fold over it.  Signals of equal rank are ordered by id.
    """
    candidates = hits.groupBy("cik", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hits")
    )
    entry = F.struct("signal_rank", F.col("query_id").alias("signal_id"), "hits", "query", "test_id")
    ordered = queries.join(candidates, ["cik", "query_id"]).groupBy("cik").agg(
        F.array_sort(F.collect_list(entry)).alias("queue")
    )
    picked = F.expr(f"""
        aggregate(queue,
          CAST(array() AS ARRAY<STRUCT<signal_id: STRING, signal_rank: INT, query: STRING, test_id: STRING,
                                       chunk_id: STRING, score: DECIMAL(28,12)>>),
          (acc, s) -> CASE WHEN size(acc) >= {max_packets} THEN acc ELSE concat(acc, transform(
            slice(filter(s.hits, h -> NOT exists(acc, a -> a.chunk_id = h.chunk_id)), 1, 1),
            h -> named_struct('signal_id', s.signal_id, 'signal_rank', s.signal_rank, 'query', s.query,
                              'test_id', s.test_id, 'chunk_id', h.chunk_id, 'score', h.score))) END)
    """)
    return ordered.select("cik", F.posexplode(picked).alias("packet_order", "p")).select("cik", "packet_order", "p.*")


def _rfind(text: Column, reversed_needle: str, size: int) -> Column:
    """Zero-based start of the last occurrence, or -1."""
    place = F.locate(reversed_needle, F.reverse(text))
    return F.when(place > 0, F.length(text) - place - (size - 1)).otherwise(F.lit(-1))


def excerpt_bounds(text: Column, query: Column, max_chars: int = EXCERPT_CHARS) -> tuple[Column, Column]:
    """Zero-based (start, end) of the excerpt before trimming.

    The window starts a third before the earliest query term of four or more letters and is
    extended to sentence bounds.
    """
    terms = F.filter(F.regexp_extract_all(query, F.lit(QUERY_TERM), 0), lambda t: F.length(t) >= 4)
    places = let(casefold(text), lambda folded: F.transform(terms, lambda t: F.call_function("instr", folded, casefold(t))))
    centre = F.coalesce(F.array_min(F.filter(places, lambda p: p > 0)) - 1, F.lit(0))
    start = F.greatest(F.lit(0), centre - max_chars // 3)
    end = F.least(F.length(text), start + max_chars)
    before = F.substring(text, F.lit(1), start)
    sentence, line = _rfind(before, " .", 2), _rfind(before, "\n", 1)
    opened = F.when(sentence > line, sentence + 2).otherwise(line + 1)
    stop = F.call_function("locate", F.lit(". "), text, end + 1)
    return opened, F.when(stop > 0, stop).otherwise(end)


def with_excerpt(frame: DataFrame, text: str = "text", query: str = "query", max_chars: int = EXCERPT_CHARS) -> DataFrame:
    """Adds ``excerpt`` and ``excerpt_start`` (the offset of its first kept character)."""
    start, end = excerpt_bounds(F.col(text), F.col(query), max_chars)
    cut = frame.withColumns({"_from": start, "_to": end}).withColumn(
        "_cut", F.substring(F.col(text), F.col("_from") + 1, F.greatest(F.col("_to") - F.col("_from"), F.lit(0)))
    )
    trimmed = strip_space(F.col("_cut"))
    lead = F.when(trimmed == "", 0).otherwise(F.call_function("instr", F.col("_cut"), trimmed) - 1)
    return cut.withColumns({"excerpt": trimmed, "excerpt_start": F.col("_from") + lead}).drop("_from", "_to", "_cut")


def evidence_packets(
    signals: DataFrame, chunks: DataFrame, max_packets: int = MAX_PACKETS, stemmed: bool = True,
    index: DataFrame | None = None,
) -> DataFrame:
    """Citation-ready packets for ranked signals of all companies."""
    queries = signal_queries(signals)
    hits = bm25_search(chunks, queries, HITS_PER_SIGNAL, stemmed=stemmed, phrases=False, index=index)
    picked = assign_hits(queries, hits, max_packets)
    joined = with_excerpt(picked.join(chunks, ["cik", "chunk_id"]))
    start = F.col("start_offset") + F.col("excerpt_start")
    end = start + F.length("excerpt")
    located = joined.withColumns({"start_offset": start, "end_offset": end})
    # stored under the whole hash: twelve digits would meet by chance among some ten million packets
    evidence_id = F.concat(F.lit("E-"), F.upper(F.sha2(F.concat_ws(
        "|", "signal_id", "chunk_id", F.col("start_offset").cast("string"), F.col("end_offset").cast("string")), 256)))
    return located.select(
        evidence_id.alias("evidence_id"), "cik", "signal_id", "signal_rank", "section", "subsection", "chunk_id",
        "start_offset", "end_offset", "excerpt",
        F.greatest(F.col("score").cast("double"), F.lit(0.0)).alias("relevance_score"),
        F.concat(F.lit("Lexical match for "), "test_id", F.lit("; filtered to CIK "), "cik",
                 F.lit(" and retained section "), "section", F.lit(".")).alias("selection_reason"),
        "parser_version", word_count(F.col("excerpt")).alias("token_count"), "accession_number", "source_url",
        "content_sha256",
    )


#: "E-" and twelve digits.
SHORT_ID = 14


def citation(packets: DataFrame) -> Column:
    """``[id] section, accession, url`` with the id's short form."""
    return F.concat(
        F.lit("["), F.substring(packets["evidence_id"], 1, SHORT_ID), F.lit("] "), packets["section"], F.lit(", "),
        F.coalesce(packets["accession_number"], F.lit("unknown accession")), F.lit(", "), packets["source_url"],
    )
