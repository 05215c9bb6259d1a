"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping" (1980), as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of a word whose consonant y are written Y: V is a vowel, C a consonant. M0 and M1 begin words whose measure is over 0 and over 1.
V, C = "[aeiouy]", "[^aeiouy]"
M0 = f"{C}*{V}+{C}"
M1 = f"{C}*{V}+{C}+{V}+{C}"
#: consonant, vowel, consonant other than w, x and y, in a word of measure 1
SHORT = f"{C}+{V}[^aeiouywxY]"

# The paper's rules, step by step. A rule's suffix is written with the letters that stay in a group; what a longer suffix
# decides is kept from the shorter one by a look behind.
_KEPT = (
    "(?<!a)(tion)al|(ize)r|(al)li|(ent)li|(e)li|(ous)li|(al)ism|(ive)ness|(ful)ness|(ous)ness|(al)iti",
    "(at)ional|(enc)i|(anc)i|(abl)i|(iz)ation|(?<!iz)(at)ion|(at)or|(iv)iti",
    "(b)iliti",
)
_SHORTENED = "(ic)ate|ative|(al)ize|(ic)iti|(ic)al|ful|ness"
_DROPPED = "al|ance|ence|er|ic|able|ible|ant|ement|(?<!e)ment|(?<!m)ent|(?<=[st])ion|ou|ism|ate|iti|ous|ive|ize"


def _groups(first: int, suffixes: str) -> str:
    """All groups of the alternatives in a row: those of rules that did not apply are empty."""
    return "".join(f"${{g{k}}}" for k in range(first, first + suffixes.count("(") - suffixes.count("(?")))


def _named(suffixes: str) -> str:
    """The same alternatives with groups g0, g1, ... by name."""
    out, number = "", 0
    for k, letter in enumerate(suffixes):
        if letter == "(" and suffixes[k + 1] != "?":
            out += f"(?<g{number}>"
            number += 1
        else:
            out += letter
    return out


def _steps() -> list[tuple[str, str]]:
    suffix = lambda start, rules, more="": (f"^(?<stem>{start}.*?)(?:{_named(rules)})$", "${stem}" + _groups(0, rules) + more)
    return [
        ("(^|[aeiou])y", "$1Y"), ("yy", "yY"),
        # plurals
        ("(ss|i)es$|([^s])s$", "$1$2"),
        # past tense and gerund; # marks a word that lost its ending
        (f"^({M0}.*)eed$", "$1ee"), (f"^(.*{V}.*)(?:(?<!e)ed|ing)$", "$1#"),
        ("(at|bl|iz)#$", "$1e"), ("([^aeiouyYlsz])\\1#$|(y)Y#$", "$1$2"), (f"^({SHORT})#$", "$1e"), ("#$", ""),
        (f"^(.*{V}.*)[yY]$", "$1i"),
        # one rule of them alone: the mark keeps the others off
        suffix(M0, _KEPT[0], "#"), suffix(M0, _KEPT[1], "e"), suffix(M0, _KEPT[2], "le"), ("#$", ""),
        suffix(M0, _SHORTENED), suffix(M1, _DROPPED),
        # final e and ll
        (f"^({M1}.*)e$", "$1"), (f"^(?!{SHORT}e$)({C}*{V}+{C}+{V}*)e$", "$1"), (f"^(?={M1})(.*l)l$", "$1"),
    ]


def porter(word: Column) -> Column:
    """Stem of a lower-case word; words of fewer than three letters, or with other characters than a to z, stay as they are."""
    found = word
    for pattern, replacement in _steps():
        found = F.regexp_replace(found, F.lit(pattern), F.lit(replacement))
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(found)).otherwise(word)
