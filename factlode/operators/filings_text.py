"""Filing documents -> sections -> chunks with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlode.functions import ids
from factlode.functions.html import decode_payload, html_to_text
from factlode.functions.relations import let
from factlode.functions.text import EDGE_SPACE, clean_text, strip_space
from factlode.registries import PARSER_VERSION
from factlode.sources.payloads import filing_document_url

MAX_CHUNK_CHARS = 2_400
WHOLE_DOCUMENT = "Document"

# An Item heading at the start of a line, optionally after a Part.
HEADING = "(?imd)^(?:(PART\\s+[IVX]+)\\s+)?ITEM\\s+([0-9]+[A-Z]?)(?:\\.|\\s|$)\\s*(.*)$".replace("\\s", EDGE_SPACE)
TITLE_EDGE = "[ .\\u2014\\-\\t]"
_HEADING_AHEAD = HEADING.replace("(?imd)", "(?imd)(?=", 1) + ")"


def document_text(pages: DataFrame, content: str = "content", max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(readable documents with cleaned ``body``, rejected documents with a reason); ``max_bytes`` rejects larger ones."""
    sized = pages.withColumn("bytes", F.octet_length(content))
    large = F.lit(False) if max_bytes is None else F.coalesce(F.col("bytes") > max_bytes, F.lit(False))
    small = sized.where(~large)
    decoded = small.withColumn("body", clean_text(html_to_text(decode_payload(F.col(content)))))
    rejected = sized.where(large).select("accession_number", F.lit("filing_too_large").alias("reason"))
    empty = decoded.where("body = ''").select("accession_number", F.lit("filing_text_empty").alias("reason"))
    return decoded.where("body <> ''").drop("bytes"), rejected.unionByName(empty)


def _sections(body: Column) -> Column:
    """Pieces of a text that start at each heading, in order.

    The text is split where a heading lies ahead; a line break put before it makes the first
    piece, which is dropped, end there too. A text without headings is one piece.
    """
    pieces = F.split(F.concat(F.lit("\n"), body), _HEADING_AHEAD, -1)
    return F.transform(pieces, lambda piece, k: F.when(k == 0, F.substr(piece, F.lit(2))).otherwise(piece))


def split_sections(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row per section with its label, title, offset and stripped text."""
    positioned = documents.withColumn("pieces", _sections(F.col(body)))
    lengths = F.transform("pieces", F.length)
    starts = F.aggregate(
        lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    rows = positioned.select(
        *[c for c in documents.columns if c != body],
        F.size("pieces").alias("piece_count"),
        F.posexplode(F.arrays_zip(
            F.col("pieces").alias("text"), F.slice(starts, F.lit(1), F.size("pieces")).alias("start")
        )).alias("piece", "s"),
    )
    kept = rows.where((F.col("piece_count") == 1) | (F.col("piece") > 0))
    text = F.col("s.text")
    whole = F.col("piece_count") == 1
    part, item = F.regexp_extract(text, HEADING, 1), F.regexp_extract(text, HEADING, 2)
    title = F.regexp_replace(F.regexp_extract(text, HEADING, 3), f"^{TITLE_EDGE}+|{TITLE_EDGE}+$", "")
    label = F.concat(F.when(part != "", F.concat(part, F.lit(" "))).otherwise(""), F.lit("Item "), item)
    return kept.select(
        *[c for c in documents.columns if c != body],
        F.when(whole, WHOLE_DOCUMENT).otherwise(label).alias("section"),
        F.when(~whole & (title != ""), title).alias("subsection"),
        F.col("piece").alias("section_order"),
        F.col("s.start").alias("section_start"),
        F.when(whole, text).otherwise(strip_space(text)).alias("section_text"),
    )


def pack_paragraphs(text: Column, separator: str, max_chars: int) -> Column:
    """Greedy packing of paragraphs: array of (start, text).

    Only lengths are folded, never strings: the fold yields the first paragraph and the
    offset of every chunk, and each chunk's text is cut once at the end.  A paragraph
    longer than the limit stays whole.
    """
    joint = len(separator)
    empty = F.array().cast("array<struct<first:int,start:int>>")
    zero = F.struct(
        empty.alias("chunks"), F.lit(0).alias("current"), F.lit(0).alias("cursor"), F.lit(0).alias("index"),
    )

    def step(state: Column, length: Column) -> Column:
        opens = (state["current"] == 0) | (state["current"] + joint + length > max_chars)
        chunk = F.struct((state["index"] + 1).alias("first"), state["cursor"].alias("start"))
        return F.struct(
            F.when(opens, F.concat(state["chunks"], F.array(chunk))).otherwise(state["chunks"]).alias("chunks"),
            F.when(opens, length).otherwise(state["current"] + joint + length).alias("current"),
            (state["cursor"] + length + joint).alias("cursor"),
            (state["index"] + 1).alias("index"),
        )

    def cut(paragraphs: Column) -> Column:
        def text_of(chunks: Column) -> Column:
            following = lambda k: F.coalesce(F.get(chunks, k + 1)["first"], F.size(paragraphs) + 1)
            return F.transform(chunks, lambda c, k: F.struct(
                c["start"].alias("start"), F.array_join(F.slice(paragraphs, c["first"], following(k) - c["first"]), separator).alias("text")))

        return let(F.aggregate(F.transform(paragraphs, F.length), zero, step)["chunks"], text_of)

    return let(F.filter(F.transform(F.split(text, separator), strip_space), lambda p: p != ""), cut)


def filing_chunks(
    documents: DataFrame, paragraph_separator: str = "\n\n", max_chars: int = MAX_CHUNK_CHARS,
) -> DataFrame:
    """Chunks of cleaned filing texts, all narrow transformations.

    Paragraphs are packed up to ``max_chars``. Cleaned text has no blank lines, so there the
    default separator gives one chunk per section; ``'\\n'`` packs lines.
    """
    sections = split_sections(documents)
    chunked = pack_paragraphs(F.col("section_text"), paragraph_separator, max_chars)
    rows = sections.select("*", F.posexplode(chunked).alias("sequence", "c")).drop("section_text")
    start = F.col("section_start") + F.col("c.start")
    url = F.col("source_url") if "source_url" in documents.columns else filing_document_url(
        F.col("cik"), F.col("accession_number"), F.col("primary_document")
    )
    ticker = F.col("ticker") if "ticker" in documents.columns else F.lit(None).cast("string")
    return rows.select(
        ids.stable_id(
            F.col("content_sha256"), PARSER_VERSION, F.col("accession_number"), F.col("section"), F.col("sequence"),
            F.col("c.text"),
        ).alias("chunk_id"),
        "cik", ticker.alias("ticker"), "accession_number", "form", "filing_date", "report_period", "section",
        "subsection", "section_order", "sequence", F.col("c.text").alias("text"), start.alias("start_offset"),
        (start + F.length("c.text")).alias("end_offset"), url.alias("source_url"),
        F.lit(PARSER_VERSION).alias("parser_version"), "content_sha256",
    )
