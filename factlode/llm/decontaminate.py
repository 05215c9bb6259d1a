"""Benchmark decontamination: word pairs that every alignment must hold seed windows, and Smith-Waterman scores the windows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factlode.llm.rows import bound_batches, slices, text_rows

MATCH, MISMATCH, GAP = 2, -1, -1
FINDINGS = "doc_id long, item_id long, score double, last_word long"


#: Words of texts looked at together, pairs of a seed and its place at once, and cells of a table of windows.
CHUNK, HITS, CELLS = 500_000, 2**20, 2**21


@dataclass(frozen=True)
class Settings:
    """least: share of an item's best possible score from which a passage counts.
    block: words of test items that one pass over the texts looks for; its tables are broadcast, and more items take more passes."""

    least: float = 0.5
    block: int = 500_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


@dataclass(frozen=True)
class Items:
    """A block of test items: their words as numbers, and the seeds. codes[k] is a seed (see _code), of which the items and places
    first[k] to first[k + 1] hold one each. need: the least score of an item that counts."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]
    need: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    places: np.ndarray


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with a word in blocks of about `block` words, fetched one partition at a time."""
    rows, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = words_of(row.text)
        if words:
            rows.append((row.item_id, words))
            size += len(words)
        if size >= block:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def word_counts(rows: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """How often the corpus has each word of the vocabulary, and how many words it has in all."""
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, total = shared.value, Counter(), 0
        for part in slices(batches):
            for text in part["text"]:
                words = words_of(text)
                total += len(words)
                counts.update(filter(known.__contains__, words))
        yield pa.RecordBatch.from_pydict({"word": pa.array([None, *counts], pa.binary()), "n": pa.array([total, *counts.values()], pa.int64())})

    found = rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word if r.word is None else bytes(r.word): r.n for r in found}
    return counts, counts.pop(None, 0)


def _code(size: int, a, b=None):
    """Number of a seed: of a word, or of two words."""
    return a if b is None else (a + 1) * size + b


def _starts(words: np.ndarray, share: np.ndarray, need: int) -> tuple[np.ndarray, bool]:
    """(places of the item at which seeds begin, whether seeds are pairs): every alignment of score `need` holds one of these seeds.

    An alignment of m matches has at most 2 m - need errors. Between two matches that follow one another there are as many errors as the
    longer gap has words, so at least m - 1 - (2 m - need) // 2 = ceil(need / 2) - 1 of its m - 1 steps have one error at most: both
    words are neighbours, or have one word between them, in the item and in the text. That many places begin such a pair; of all but so
    many less one places, one is among them. Where no pair is sure, ceil(need / 2) words are. The rarest places are taken, which decides
    on the cost alone.
    """
    n, sure = len(words), -(-need // 2) - 1
    if sure < 1:
        return np.argsort(share[words], kind="stable")[: n - sure], False
    rate = np.exp(share[words])
    after = rate[1:] + np.append(rate[2:], 0.0)
    return np.argsort(rate[:-1] * after, kind="stable")[: n - sure], True


def _items(block: list[tuple[int, list[bytes]]], counts: dict[bytes, int], total: int, s: Settings) -> Items:
    vocabulary: dict[bytes, int] = {}
    numbers = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64) for _, words in block]
    share = np.array([math.log((counts.get(w, 0) + 0.5) / (total + 1)) for w in vocabulary])
    size, need, made = len(vocabulary) + 1, [], []
    for item, words in enumerate(numbers):
        need.append(max(1, math.ceil(MATCH * s.least * len(words) - 1e-6)))
        starts, pairs = _starts(words, share, need[-1])
        for gap in (1, 2) if pairs else (0,):
            at = starts[starts + gap < len(words)]
            codes = _code(size, words[at], words[at + gap]) if gap else _code(size, words[at])
            made.append(np.stack([codes, np.full(len(at), item, dtype=np.int64), at]))
    codes, items, places = np.concatenate(made, axis=1)
    order = np.argsort(codes, kind="stable")
    codes, first = np.unique(codes[order], return_index=True)
    return Items([i for i, _ in block], numbers, vocabulary, np.array(need), codes, np.append(first, len(order)), items[order], places[order])


class Marks:
    """A set of numbers that may hold some more: one look into a table tells most others apart."""

    def __init__(self, numbers: np.ndarray):
        bits = min(24, max(16, len(numbers).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self._place(numbers)] = True

    def _place(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        return self.table[self._place(numbers)]


def smith_waterman(windows: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of the item in each window of word numbers (rows, -1 matches nothing), and where its last word stands.

    One row of the table per item word, for all windows at once: gaps within a row come from a running maximum.
    """
    n, length = windows.shape
    slope = -GAP * np.arange(length + 1)
    row, best, last = np.zeros((n, length + 1), dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for word in item:
        step = np.zeros_like(row)
        step[:, 1:] = np.maximum(row[:, :-1] + np.where(windows == word, MATCH, MISMATCH), row[:, 1:] + GAP)
        step = np.maximum(step, 0)
        row = np.maximum.accumulate(step + slope, axis=1) - slope
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best, last = np.where(better, value, best), np.where(better, top, last)
    return best, last


class Aligner:
    """Finds the items of a block in texts: all passages of score `least` or more."""

    def __init__(self, items: Items, settings: Settings):
        self.items, self.s = items, settings
        self.size = len(items.vocabulary) + 1
        self.lengths = np.array([len(w) for w in items.words])
        # an alignment begins and ends at most so many words outside the place of the item
        self.reach = np.maximum(0, MATCH * self.lengths - items.need)
        self.seeds = Marks(items.codes)
        self.members = Marks(np.concatenate([_code(self.size, np.int64(i), np.unique(w)) for i, w in enumerate(items.words)]))

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, item and place numbers of the seeds found there), at most HITS of them at once or those of one place."""
        known = numbers >= 0
        for gap in (0, 1, 2):
            at = np.flatnonzero(known[: len(known) - gap] & known[gap:])
            codes = _code(self.size, numbers[at], numbers[at + gap]) if gap else _code(self.size, numbers[at])
            maybe = self.seeds.holds(codes)
            at, codes = at[maybe], codes[maybe]
            seed = np.minimum(np.searchsorted(self.items.codes, codes), len(self.items.codes) - 1)
            exact = self.items.codes[seed] == codes
            at, seed = at[exact], seed[exact]
            count = self.items.first[seed + 1] - self.items.first[seed]
            ends, done = np.cumsum(count), 0
            while done < len(at):
                before = ends[done - 1] if done else 0
                stop = max(done + 1, int(np.searchsorted(ends, before + HITS, side="right")))
                n = count[done:stop]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(at[done:stop], n), np.repeat(self.items.first[seed[done:stop]], n) + within
                done = stop

    def align(self, texts: list[str | None]) -> list[tuple[int, int, float, int]]:
        """(number of the text, item, score as a share of the best possible one, place of the last aligned word)."""
        get, out, chunk, size = self.items.vocabulary.get, [], [], 0
        for k, text in enumerate(texts):
            words = words_of(text)
            if words:
                chunk.append((k, np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))))
                size += len(words)
            if size >= CHUNK:
                out += self._align(chunk)
                chunk, size = [], 0
        return out + self._align(chunk) if chunk else out

    def _align(self, chunk: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, float, int]]:
        apart = np.full(2, -1, dtype=np.int64)
        numbers = np.concatenate([x for _, text in chunk for x in (text, apart)])
        sizes = np.array([len(text) for _, text in chunk])
        lo = np.cumsum(sizes + 2) - sizes - 2
        span, out = int(sizes.max()) + 3, []
        for at, e in self.hits(numbers):
            text, item = np.searchsorted(lo, at, side="right") - 1, self.items.items[e]
            # windows start at multiples of the item's length, so that all seeds of a passage share one or two
            step = (at - lo[text] - self.items.places[e]) // self.lengths[item]
            key = np.unique((item * len(chunk) + text) * span + step + 1)
            step, key = key % span - 1, key // span
            text, item = key % len(chunk), key // len(chunk)
            for length in np.unique(self.lengths[item]):
                here = np.flatnonzero(self.lengths[item] == length)
                for begin in range(0, len(here), 2**16):
                    part = here[begin : begin + 2**16]
                    out += self._score(chunk, numbers, lo, sizes, text[part], item[part], step[part], int(length))
        return out

    def _score(self, chunk, numbers, lo, sizes, text, item, step, length) -> list[tuple[int, int, float, int]]:
        """Scores of windows whose items have the same length: item by item, where the words alone allow the score it needs."""
        reach, out = int(self.reach[item[0]]), []
        width = 2 * (length + reach)
        rows = max(1, min(256, CELLS // width))
        begin, need = step * length - reach, int(self.items.need[item[0]])
        good = []
        for b in range(0, len(item), max(1, CELLS // width)):
            part = np.arange(b, min(len(item), b + max(1, CELLS // width)))
            table = self._windows(numbers, lo, sizes, text[part], begin[part], width)
            # at best each word that the item has is a match and each other word an error: the best run of them bounds the score
            known = (table >= 0) & self.members.holds(_code(self.size, item[part][:, None], table))
            sums = np.zeros((len(part), width + 1), dtype=np.int32)
            np.cumsum(np.where(known, np.int32(MATCH), np.int32(MISMATCH)), axis=1, out=sums[:, 1:])
            good.append(part[(sums - np.minimum.accumulate(sums, axis=1)).max(axis=1) >= need])
        good = np.concatenate(good)
        for i in np.unique(item[good]):
            mine = good[item[good] == i]
            for b in range(0, len(mine), rows):
                part = mine[b : b + rows]
                best, last = smith_waterman(self._windows(numbers, lo, sizes, text[part], begin[part], width), self.items.words[i])
                for t, first, score, end in zip(text[part].tolist(), begin[part].tolist(), best.tolist(), last.tolist()):
                    share = score / (MATCH * length)
                    if share >= self.s.least:
                        out.append((chunk[t][0], int(i), share, first + end - 1))
        return out

    @staticmethod
    def _windows(numbers, lo, sizes, text, begin, width) -> np.ndarray:
        """Words of each text from `begin` on, -1 outside the text."""
        place = begin[:, None] + np.arange(width)
        inside = (place >= 0) & (place < sizes[text][:, None])
        return np.where(inside, numbers[np.where(inside, place + lo[text][:, None], 0)], -1)


def find_contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, item_id, score, last_word: one row for each document and test item that share a passage, the best passage of each.

    score is the Smith-Waterman score of the item's words in the document as a share of the item's best possible score; rows from
    `settings.least` on are returned. last_word is the place of the last aligned word. Words are compared in lower case (A-Z).

    Every passage of that score is found, whatever the size of the corpus: seeds are pairs of words of which each such alignment must
    hold one, and corpus counts of the items' words only decide which pairs are cheapest to look for. Texts stay where they are read: the items of a block (a bounded
    number of words, however large the benchmark) are broadcast, and alignments run where the text is. Null and empty texts and items
    match nothing. Repeated rows give one row each; a document or item without an id keeps the null. An empty table gives no rows.
    """
    rows, found = text_rows(docs, id_column, text_column), None
    for shared in _shared_blocks(rows, benchmark, settings):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            aligner = Aligner(shared.value, settings)
            for part in slices(batches):
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for k, item, share, last in aligner.align(part["text"]):
                    best[k, item] = max(best.get((k, item), (0.0, 0)), (share, -last))
                keys = sorted(best)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([part["doc_id"][k] for k, _ in keys], pa.int64()),
                    "item_id": pa.array([aligner.items.ids[i] for _, i in keys], pa.int64()),
                    "score": pa.array([best[x][0] for x in keys], pa.float64()), "last_word": pa.array([-best[x][1] for x in keys], pa.int64()),
                })

        part = rows.mapInArrow(run, FINDINGS)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], FINDINGS) if found is None else found


def _shared_blocks(rows: DataFrame, benchmark: DataFrame, settings: Settings) -> Iterator:
    """A broadcast of each block of items, with its seeds."""
    for block in _blocks(benchmark, settings.block):
        counts, total = word_counts(rows, {w for _, words in block for w in words})
        yield rows.sparkSession.sparkContext.broadcast(_items(block, counts, total, settings))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_column: str = "text") -> DataFrame:
    """The rows of `docs` that share no passage with a test item, with all their columns, in their partitions: each row is judged by its
    own text, so null and repeated ids need no rule. Null and empty texts stay."""
    bound_batches(docs.sparkSession)
    place = docs.schema.names.index(text_column)
    for shared in _shared_blocks(docs.select(F.col(text_column).cast("string").alias("text")), benchmark, settings):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            aligner = Aligner(shared.value, settings)
            for batch in batches:
                bad = {k for k, *_ in aligner.align(batch.column(place).to_pylist())}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
