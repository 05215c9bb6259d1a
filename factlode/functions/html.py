"""Filing HTML to text in column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subtrees that carry no text, and tags that break lines.
SKIPPED_TAGS = ("script", "style", "nav", "noscript", "svg")
BREAKING_TAGS = (
    "address", "article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "header", "li", "p",
    "section", "table", "td", "th", "tr",
)


_SKIPPED = "|".join(SKIPPED_TAGS)
_ATTRIBUTES = """(?:"[^"]*"|'[^']*'|[^'">])*+>"""
#: Comments, and scripts and styles, whose content is no markup: neither is looked into.
OPAQUE = "(?is)<!--.*?(?:-->|$)|<(script|style)(?=[\\s/>])" + _ATTRIBUTES + ".*?(?:</\\1(?=[\\s/>])[^>]*>|$)"
SKIPPED_TAG = f"(?i)</?(?:{_SKIPPED})(?=[\\s/>]){_ATTRIBUTES}"
BREAKING_TAG = f"(?i)</?(?:{'|'.join(BREAKING_TAGS)})(?=[\\s/>]){_ATTRIBUTES}"
ANY_TAG = f"</?[A-Za-z]{_ATTRIBUTES}|<[!?][^>]*>"

#: Names of characters that need no semicolon; they also count as the beginning of a longer unknown name.
BARE_NAMES = tuple(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = f"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{'|'.join(BARE_NAMES)}))"


def _outside_skipped(html: Column) -> Column:
    """The pieces between skipped tags that lie in none of them. Only skipped tags are folded, not the whole text."""
    tags = F.regexp_extract_all(html, F.lit(SKIPPED_TAG), F.lit(0))
    pieces = F.split(html, SKIPPED_TAG, -1)
    step = lambda depths, tag: F.concat(depths, F.array(
        F.greatest(F.lit(0), F.element_at(depths, -1) + F.when(tag.startswith("</"), -1).when(tag.endswith("/>"), 0).otherwise(1))
    ))
    depths = F.aggregate(tags, F.array(F.lit(0)), step)
    return F.array_join(F.filter(pieces, lambda piece, k: F.get(depths, k) == 0), "")


def _code_point(number: Column) -> Column:
    """The character of a numeric reference; 128 to 159 are read as Windows-1252, what is no character becomes U+FFFD."""
    windows = F.create_map(*[F.lit(x) for n in range(128, 160) for x in (n, bytes([n]).decode("cp1252", "ignore") or chr(n))])
    no_character = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF) | (number == 0)
    made = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(no_character, "\ufffd").when(number.between(128, 159), F.element_at(windows, number.cast("int"))).otherwise(made)


def _character(reference: Column) -> Column:
    names = F.create_map(*[F.lit(x) for name, c in html5.items() for x in (name, c)])
    body = F.substr(reference, F.lit(2))
    # digits beyond eight are out of range whatever they are
    decimal = F.when(F.length(F.regexp_replace(body, "^#0*|;", "")) <= 8, F.regexp_extract(body, "^#([0-9]+)", 1).try_cast("bigint"))
    hexadecimal = F.when(F.length(F.regexp_replace(body, "^#[xX]0*|;", "")) <= 8, F.conv(F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("bigint"))
    bare = F.regexp_extract(body, f"^({'|'.join(BARE_NAMES)})", 1)
    by_beginning = F.when(bare != "", F.concat(F.try_element_at(names, bare), F.substr(body, F.length(bare) + 1)))
    named = F.coalesce(F.try_element_at(names, body), by_beginning, reference)
    return F.when(body.rlike("^#[xX]"), _code_point(hexadecimal)).when(body.startswith("#"), _code_point(decimal)).otherwise(named)


def decode_references(text: Column) -> Column:
    """Character references replaced by what they stand for; unknown names stay."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    pieces = F.split(text, REFERENCE, -1)
    made = F.concat(F.transform(found, _character), F.array(F.lit("")))
    return F.when(text.contains("&"), F.array_join(F.zip_with(pieces, made, lambda piece, c: F.concat(piece, c)), "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text outside skipped subtrees, with a line break at either side of breaking tags, in column expressions alone."""
    visible = _outside_skipped(F.regexp_replace(html, OPAQUE, ""))
    broken = F.regexp_replace(visible, BREAKING_TAG, "\n")
    return decode_references(F.regexp_replace(broken, ANY_TAG, ""))


def decode_payload(content: Column) -> Column:
    """UTF-8 text of the bytes, or Latin-1 where they are not UTF-8."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
