"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Everything is a column expression: pieces between the matches of a pattern come from split, the matches from regexp_extract_all, and the
lengths of both give code-point positions. No rows move between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from factlode.llm.rows import text_rows

CONTEXT = 40
BLOCK = 128
#: A match has two characters at least, so that this many neighbours hold all of the context.
NEAR = CONTEXT // 2


@dataclass(frozen=True)
class Kind:
    """A kind of span. `pattern` is written possessively, so that it matches what the plain greedy form in the SQL text matches but never
    backtracks; `needs` is a character without which a text can't match. Kinds with a `keep` score are added by the method: their spans
    count from that score on. Base kinds always count."""

    name: str
    pattern: str
    needs: str
    score: float
    words: str
    keep: float = 0.0


# The contract's kinds in their order, then the kinds that checksums and context add.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 0.6, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|fax|mobile"),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]++", "", 0.9, "iban|account|konto|cuenta|compte", 0.9),
    Kind("ssn", r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++", "-", 0.3, "ssn|social|security", 0.6),
)
#: Account numbers as they are printed, with single blanks. A run may hold several, and words behind them; see _printed.
PRINTED = Kind("iban", r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9])++", "", 0.9, KINDS[4].words, 0.9)
#: A number of 34 characters with a blank between any two.
LONGEST_PRINTED = 67
BASE = tuple(k.name for k in KINDS if not k.keep)
CONTEXT_GAIN = 0.3
SPAN = "array<struct<start:int,kind_no:int,end:int,score:double>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(text: Column) -> Column:
    """Remainder by 97 of an account number: its first four characters go to the end, letters count from A = 10."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda acc, c: (acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # leading zeros don't count; four digits or more can't be 255 at most
        small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(part, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(match).between(15, 34) & (mod97(match) == 1)
    if kind == "ssn":
        return match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _running_sum(values: Column) -> Column:
    """Sums of all elements before each one. Blocks keep the cost of growing arrays linear in practice: 128 elements within a block,
    one element per block above."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x))
    offsets = F.aggregate(sums, F.array(F.lit(0)), grow)
    inner = F.transform(blocks, lambda block: F.aggregate(F.slice(block, F.lit(1), F.size(block) - 1), F.array(F.lit(0)), grow))
    return F.flatten(F.zip_with(F.slice(offsets, F.lit(1), F.size(inner)), inner, lambda o, xs: F.transform(xs, lambda x: o + x)))


def _cut(text: Column, kind: Kind) -> Column:
    """(matches, the pieces around them) of a text; no matches and no pieces where the needed character is missing."""
    found = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"), F.split(text, kind.pattern, -1).alias("pieces"))
    possible = text.contains(kind.needs) if kind.needs else text.rlike("[0-9]")
    return F.when(possible, found).otherwise(F.struct(F.array().cast("array<string>").alias("matches"), F.array().cast("array<string>").alias("pieces")))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once even if lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbours(cut: Column) -> Column:
    """The cut with the last and first characters of each pair of neighbouring piece and match, as far as contexts need them."""
    matches, pieces = cut["matches"], cut["pieces"]
    tail, head = (lambda x: F.right(x, F.lit(CONTEXT))), (lambda x: F.left(x, F.lit(CONTEXT)))
    return F.struct(
        matches.alias("matches"), pieces.alias("pieces"),
        F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: tail(F.concat(tail(p), tail(m)))).alias("tails"),
        F.zip_with(matches, F.slice(pieces, F.lit(2), F.size(matches)), lambda m, p: head(F.concat(head(m), head(p)))).alias("heads"),
    )


def _context(near: Column, i: Column) -> tuple[Column, Column]:
    """The CONTEXT characters of the text before and after match i, over other matches too."""
    before = F.array_join(F.slice(near["tails"], F.greatest(F.lit(1), i - NEAR + 1), F.least(i, F.lit(NEAR))), "")
    after = F.array_join(F.slice(near["heads"], i + 2, F.lit(NEAR)), "")
    return (
        F.right(F.concat(before, F.right(F.get(near["pieces"], i), F.lit(CONTEXT))), F.lit(CONTEXT)),
        F.left(F.concat(F.left(F.get(near["pieces"], i + 1), F.lit(CONTEXT)), after), F.lit(CONTEXT)),
    )


def _confidence(kind: Kind, before: Column, after: Column) -> Column:
    around = F.concat(before, F.lit("\n"), after)
    return F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.lower(around).rlike(kind.words), CONTEXT_GAIN).otherwise(0.0))


def _printed_length(text: Column) -> Column:
    """Length of the longest account number with blanks that the text begins with, up to the end of a word; null without any, or if
    the first word is an account number by itself."""
    bare = lambda n: F.replace(F.substr(text, F.lit(1), n), F.lit(" "), F.lit(""))
    fits = lambda n: F.length(bare(n)).between(15, 34) & (mod97(bare(n)) == 1)
    ends = lambda n: F.substr(text, n + 1, F.lit(1)).isin(" ", "") & (F.substr(text, n, F.lit(1)) != " ")
    word = F.instr(text, " ") - 1
    lengths = F.sequence(F.lit(16), F.least(F.lit(LONGEST_PRINTED), F.length(text)))
    found = F.array_max(F.filter(lengths, lambda n: (n > word) & ends(n) & fits(n)))
    return F.when((F.length(text) >= 16) & (word >= 4) & ~fits(word), found)


def _printed(run: Column) -> Column:
    """(offset, length) of the account numbers with blanks in a run. Each place where one may begin is tried by itself."""
    parts = F.split(run, "(?=[A-Z][A-Z][0-9][0-9])", -1)
    cut = F.struct(
        F.transform(parts, lambda p: F.left(p, F.lit(LONGEST_PRINTED + 1))).alias("texts"), _running_sum(F.transform(parts, lambda p: F.length(p))).alias("offsets"),
    )
    # parts have four characters at least
    text = lambda c, i: F.left(F.array_join(F.slice(c["texts"], i + 1, F.lit(LONGEST_PRINTED // 4 + 2)), ""), F.lit(LONGEST_PRINTED + 1))
    made = _let(cut, lambda c: F.transform(c["texts"], lambda _, i: F.struct(F.get(c["offsets"], i).alias("offset"), _printed_length(text(c, i)).alias("length"))))
    return F.when(F.contains(run, F.lit(" ")), F.filter(made, lambda s: s["length"].isNotNull())).otherwise(F.array().cast("array<struct<offset:int,length:int>>"))


def _starts(cut: Column) -> Column:
    """Sums of what stands before each pair of piece and match."""
    return _running_sum(F.zip_with(F.slice(cut["pieces"], F.lit(1), F.size(cut["matches"])), cut["matches"], lambda p, m: F.length(p) + F.length(m)))


def _spans(cut: Column, number: int, kind: Kind) -> Column:
    matches = cut["matches"]

    def made(v):
        def span(match, i):
            start = F.get(v["sums"], i) + F.length(F.get(v["near"]["pieces"], i))
            score = F.when(_valid(kind.name, match), _confidence(kind, *_context(v["near"], i))).otherwise(F.lit(-1.0))
            return F.struct(start.alias("start"), F.lit(number).alias("kind_no"), (start + F.length(match)).alias("end"), score.alias("score"))

        return F.filter(F.transform(v["near"]["matches"], span), lambda s: s["score"] >= kind.keep)

    value = F.struct(_neighbours(cut).alias("near"), _starts(cut).alias("sums"))
    return F.when(F.size(matches) > 0, _let(value, made).cast(SPAN)).otherwise(F.array().cast(SPAN))


def _printed_spans(cut: Column, number: int) -> Column:
    matches = cut["matches"]

    def made(v):
        def spans(match, i):
            start = F.get(v["sums"], i) + F.length(F.get(v["near"]["pieces"], i))
            before, after = _context(v["near"], i)

            def span(s):
                end = s["offset"] + s["length"]
                score = _confidence(
                    PRINTED, F.right(F.concat(before, F.substr(match, F.lit(1), s["offset"])), F.lit(CONTEXT)),
                    F.left(F.concat(F.substr(match, end + 1), after), F.lit(CONTEXT)),
                )
                return F.struct((start + s["offset"]).alias("start"), F.lit(number).alias("kind_no"), (start + end).alias("end"), score.alias("score"))

            return F.transform(_printed(match), span)

        return F.flatten(F.transform(v["near"]["matches"], spans))

    value = F.struct(_neighbours(cut).alias("near"), _starts(cut).alias("sums"))
    return F.when(F.size(matches) > 0, _let(value, made).cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, then n_iban, n_ssn and max_score, one row for each row of `docs`.

    Spans are code points, end exclusive, by start and then kind. Base spans (email, ip, card, phone) always stay; an IBAN must pass
    mod-97 and may be written with single blanks, a social security number needs a context word within 40 characters on either side.
    max_score is the best score among all spans, null without any. A null text counts as empty: no spans. Null ids, repeated rows
    and further columns change nothing.
    """
    rows = text_rows(docs, id_column, text_column).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.select("doc_id", *[_cut(F.col("text"), k).alias(k.name) for k in KINDS], _cut(F.col("text"), PRINTED).alias("printed"))
    spans = {k.name: _spans(F.col(k.name), n, k) for n, k in enumerate(KINDS)}
    spans["iban"] = F.concat(spans["iban"], _printed_spans(F.col("printed"), [k.name for k in KINDS].index("iban")))
    each = cut.select("doc_id", *[column.alias(name) for name, column in spans.items()])
    names = F.array(*[F.lit(k.name) for k in KINDS])
    written = lambda spans: F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda name: F.size(name).cast("long").alias(f"n_{name}")
    return each.select(
        "doc_id", *[count(name) for name in BASE], F.sha2(written(F.concat(*BASE)), 256).alias("base_sha256"),
        written(F.concat(*[k.name for k in KINDS])).alias("spans"), *[count(k.name) for k in KINDS if k.keep],
        F.array_max(F.transform(F.concat(*[k.name for k in KINDS]), lambda s: s["score"])).alias("max_score"),
    )


#: Wider kinds first, so that what they hide can't be taken for a part of another kind.
MASK_ORDER = ("email", "iban", "card", "phone", "ip", "ssn")
#: What stands before and after a number that may be a part of a wider kind.
JOINED = r"[0-9][\x20-]?$|\+[\x20().0-9-]*$|@[A-Za-z0-9.-]*$|[A-Za-z._%+-]$", r"^[\x20-]?[0-9]|^[A-Za-z0-9._%+-]*@|^\.[0-9]"


def _replaced(docs: DataFrame, text_column: str, kind: Kind, hide) -> DataFrame:
    """Each match of the kind becomes hide(match, its number, neighbours)."""
    work = docs.withColumn("__cut", _cut(F.col(text_column), kind))
    matches, pieces = F.col("__cut.matches"), F.col("__cut.pieces")
    hidden = _let(_neighbours(F.col("__cut")), lambda near: F.transform(near["matches"], lambda m, i: hide(m, i, near)))
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), hidden, lambda p, m: F.concat(p, m)), ""), F.element_at(pieces, -1))
    return work.withColumn(text_column, F.when(F.size(matches) > 0, joined).otherwise(F.col(text_column))).drop("__cut")


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows with every confirmed span replaced by its kind in brackets, such as [EMAIL]; null and empty texts stay as they are.

    Kinds are masked one after the other, so spans that overlap are hidden as a whole or by what is left of them. Social security numbers
    that can't be a part of another kind come first, while their context is whole. Linear in the text.
    """
    kinds = {k.name: k for k in KINDS}

    def hide_kind(kind, alone=False):
        def hide(match, i, near):
            before, after = _context(near, i)
            free = ~before.rlike(JOINED[0]) & ~after.rlike(JOINED[1]) if alone else F.lit(True)
            return F.when(_valid(kind.name, match) & (_confidence(kind, before, after) >= kind.keep) & free, f"[{kind.name.upper()}]").otherwise(match)

        return hide

    def hide_printed(run, i, near):
        found = F.transform(_printed(run), lambda s: F.substr(run, s["offset"] + 1, s["length"]))
        return F.aggregate(found, run, lambda text, x: F.replace(text, x, F.lit("[IBAN]")))

    masked = _replaced(docs, text_column, kinds["ssn"], hide_kind(kinds["ssn"], alone=True))
    for name in MASK_ORDER:
        if name == "iban":
            masked = _replaced(masked, text_column, PRINTED, hide_printed)
        masked = _replaced(masked, text_column, kinds[name], hide_kind(kinds[name]))
    return masked
