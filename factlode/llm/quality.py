"""Quality rules as a cascade that stops at the first rejection, cheapest rejections first."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from factlode.llm.rows import bound_batches, slices, text_rows

WINDOW = 8
WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, WINDOW + 1)], dtype=np.uint64)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


class Facts:
    """What rules ask about one text; each fact is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.encode().split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of eight words found twice or more; windows are compared by a 64-bit hash of word hashes."""
        windows = self.n_words - WINDOW + 1
        if windows < 2:
            return 0
        hashes = np.array(list(map(xxhash.xxh3_64_intdigest, self.words)), dtype=np.uint64)
        rolled = sum(hashes[k : k + windows] * w for k, w in enumerate(WEIGHTS))
        ordered = np.sort(rolled)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        steps = np.zeros(self.n_words + 1, dtype=np.int64)
        first = np.flatnonzero(np.isin(rolled, twice))
        np.add.at(steps, first, 1)
        np.add.at(steps, first + WINDOW, -1)
        return int((np.cumsum(steps) > 0).sum())

    @cached_property
    def n_upper_words(self) -> int:
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]
    base: bool = False


RULES = (
    Rule("too_short", lambda f: f.n_words < 20, base=True),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 30 * f.n_words, base=True),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: not 25 * f.n_words <= 10 * f.word_chars <= 120 * f.n_words),
    Rule("duplicate_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("capitals", lambda f: 2 * f.n_upper_words > f.n_words),
    Rule("letters", lambda f: 2 * f.n_letters < f.word_chars),
)


class Cascade:
    """Rules in the order of rejections per second, as seen on the first rows of a task; those rows go through every rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, sample: int = 200):
        self.rules, self.left = list(rules), sample
        self.seconds = dict.fromkeys(rules, 1e-9)
        self.rejected = dict.fromkeys(rules, 0)

    def keeps(self, facts: Facts) -> bool:
        if self.left <= 0:
            return not any(rule.rejects(facts) for rule in self.rules)
        verdicts = []
        for rule in self.rules:
            alone = Facts(facts.text)  # a rule pays for all the facts it needs
            started = time.perf_counter()
            verdicts.append(rule.rejects(alone))
            self.seconds[rule] += time.perf_counter() - started
            self.rejected[rule] += verdicts[-1]
        self.left -= 1
        if not self.left:
            self.rules.sort(key=lambda r: -self.rejected[r] / self.seconds[r])
        return not any(verdicts)


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 200) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns, in the same partitions.

    Each task times the rules on its first `sample` rows and then runs them by rejections per second, stopping at the first rejection.
    The order changes the time only, never the verdict. A null text has no words and is rejected as too short.
    """
    bound_batches(docs.sparkSession)
    target, text = docs.schema, docs.schema.names.index("text")

    def run(batches):
        cascade = Cascade(rules, sample)
        for batch in batches:
            kept = [cascade.keeps(Facts(t.as_py())) for t in batch.column(text)]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, target)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, one row for each row of `docs`.

    The report asks for the base facts of every text; the rules then run over them as a cascade. Null and empty texts have no words: all
    counts are 0, base_failed is true. Null ids, repeated rows and further columns change nothing.
    """
    schema = StructType.fromDDL(
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        cascade, arrow = Cascade(rules, sample), to_arrow_schema(schema)
        for part in slices(batches):
            facts = list(map(Facts, part["text"]))
            columns = {"doc_id": part["doc_id"]}
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                columns[name] = [getattr(f, name) for f in facts]
            columns["base_failed"] = [any(r.rejects(f) for r in rules if r.base) for f in facts]
            columns["kept"] = [cascade.keeps(f) for f in facts]
            yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    return text_rows(docs, id_column, text_column).mapInArrow(run, schema)
