"""Text functions: case folding, tokens, cleaning, excerpts."""

from __future__ import annotations

from collections.abc import Iterable
from unicodedata import combining, normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case letters that Unicode decomposes into another character and marks, and what remains without the marks.
_FOLDED = {
    c: base for c in map(chr, range(0xC0, 0x30000))
    if c == c.lower() and len(base := "".join(x for x in normalize("NFD", c) if not combining(x))) == 1 and base != c
}
_MARKS = "\\p{Mn}+"
# Characters whose case folding is more, or other, than their lower case (that of a capital sigma depends on its place).
_CASE_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x1F000)) if c.casefold() != c.lower() or c == "\u03a3"}


def _character_class(characters: Iterable[str]) -> str:
    """Regex class of characters from U+0080 on, as runs. The engine looks for a character beyond Latin-1 in one run after the other;
    all others, of which texts mostly consist, are told by one test and one look at a table."""
    points = sorted(map(ord, characters))
    starts = [p for p in points if p - 1 not in points]
    ends = [p for p in points if p + 1 not in points]
    near = "".join(chr(p) for p in points if p < 0x100)
    far = "".join(f"{chr(max(a, 0x100))}-{chr(b)}" for a, b in zip(starts, ends) if b >= 0x100)
    return f"[{near}[\u0100-\U0010FFFF&&[{far}]]]"


_CASE_CLASS = _character_class(_CASE_FOLDED)

QUERY_TERM = "[A-Za-z0-9][A-Za-z0-9_-]+"
DOCUMENT_TOKEN = "[\\p{L}\\p{N}]+"

# Line breaks recognised when text is split into lines, and white space trimmed from lines.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
EDGE_SPACE = "[\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

#: the same as single characters
EDGE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def casefold(text: Column) -> Column:
    """Unicode case folding: expansions such as that of the sharp s, and lower case elsewhere."""
    folded = F.create_map(*[F.lit(x) for pair in _CASE_FOLDED.items() for x in pair])
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(_CASE_CLASS), F.lit(0)), lambda c: F.element_at(folded, c)), F.array(F.lit("")))
    expanded = F.array_join(F.zip_with(F.split(text, _CASE_CLASS, -1), found, lambda piece, c: F.concat(piece, c)), "")
    return F.lower(F.when(text.rlike(_CASE_CLASS), expanded).otherwise(text))


def fold_accents(text: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or follow it."""
    lower = F.lower(text)
    folded = F.regexp_replace(F.translate(lower, "".join(_FOLDED), "".join(_FOLDED.values())), _MARKS, "")
    return F.when(lower.rlike("[^\\x00-\\x7F]"), folded).otherwise(lower)


def query_terms(query: Column, limit: int | None = None) -> Column:
    """Distinct lower-cased terms in order of appearance; the first ``limit`` of them if it is given."""
    terms = F.array_distinct(F.regexp_extract_all(casefold(query), F.lit(QUERY_TERM), 0))
    return terms if limit is None else F.slice(terms, 1, limit)


def document_tokens(text: Column) -> Column:
    """Accent-folded runs of letters and digits."""
    return F.regexp_extract_all(fold_accents(text), F.lit(DOCUMENT_TOKEN), 0)


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE_CHARACTERS))


def clean_lines(text: Column) -> Column:
    """Lines with inner blanks collapsed and ends trimmed; empty lines dropped."""
    lines = F.transform(
        F.split(text, LINE_BREAK),
        lambda line: strip_space(F.regexp_replace(line, "[ \\t]+", " ")),
    )
    return F.filter(lines, lambda line: line != "")


def clean_text(text: Column) -> Column:
    return F.array_join(clean_lines(text), "\n")


def word_count(text: Column) -> Column:
    """White-space separated words, at least one."""
    return F.greatest(F.lit(1), F.size(F.split(strip_space(text), f"{EDGE_SPACE}+")))


def address_line(*parts: Column) -> Column:
    """Non-empty trimmed parts joined with ', '."""
    return F.concat_ws(", ", *[F.nullif(F.trim(F.coalesce(p, F.lit(""))), F.lit("")) for p in parts])
