"""Cross-tokenizer alignment: where the tokens of two vocabularies overlap in the same bytes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factlode.llm.bpe import UNSETTLED, TextEncoder, byte_symbols
from factlode.llm.rows import map_slices, staged, text_rows

#: Ends that one piece of the merge takes.
WORK = 4_096
#: Id pairs whose counts every task holds, about 17 bytes each; the links of all others meet their counts in a join.
MOST_HELD = 1 << 20
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class ByteLevelEncoder:
    """Ids of a byte-level BPE file and the bytes of each id; strings of special tokens are plain text. Texts with letters on whose class
    the libraries' Unicode versions may disagree, or very long blanks, go through the tokenizer library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.compiled = TextEncoder(path)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        vocabulary = content["model"]["vocab"] | special
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes_of[number] = token.encode() if token in special else bytes(map(byte_of.__getitem__, token))

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        careful = lambda t: not t.isascii() and UNSETTLED.search(t) or len(t) > 10_000 and TextEncoder.BLANKS.search(t)
        return [
            self.library.encode(" " + t, add_special_tokens=False).ids if careful(t) else self.compiled.encoding.encode_ordinary(" " + t)
            for t in texts]


class PieceEncoder:
    """Ids of a sentencepiece model, which puts a space before the text, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self.model.encode(list(texts), num_threads=1) if texts else []


def split_diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted arrays stands after 0, work, 2 * work, ... and all steps: how many of `a` and of `b` are taken. Each
    diagonal is searched by itself, all of them side by side; of equal values that of `a` comes first."""
    steps = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] is among the first steps if it isn't behind the last one of b that would be taken without it
        other = np.clip(steps - middle - 1, 0, max(len(b) - 1, 0))
        taken = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[other])
        low = np.where(taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low, steps - low


def merge_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of two sorted arrays of token ends that close with the same end.

    Returns the A index and the B index of each overlap, in order, and the ends that both share. Pieces of `work` ends are merged by
    themselves: between two neighbouring ends one A token and one B token lie, those that are open after what the piece has taken. An
    end that both have is taken twice; what lies between is empty, whether the two fall into one piece or into neighbouring ones, and
    stitching the pieces drops it.
    """
    at_a, at_b = split_diagonals(a, b, work)
    ends, first, second = [], [], []
    for i0, i1, j0, j1 in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]):
        both = np.concatenate([a[i0:i1], b[j0:j1]])
        order = np.argsort(both, kind="stable")
        from_a = order < i1 - i0
        ends.append(both[order])
        # tokens open just before this end: those of each side that ended among earlier steps
        first.append(i0 + np.cumsum(from_a) - from_a)
        second.append(j0 + np.cumsum(~from_a) - ~from_a)
    if not ends:
        return (np.empty(0, np.int64),) * 3
    whole, first, second = map(np.concatenate, (ends, first, second))
    fresh = np.ones(len(whole), dtype=bool)
    fresh[1:] = whole[1:] != whole[:-1]
    return first[fresh], second[fresh], whole[~fresh]


class Aligner:
    """Alignment of the texts of a slice, all of them merged as one run of bytes: every text ends with an end of both sides."""

    def __init__(self, path_a: str, path_b: str, work: int = WORK):
        self.a, self.b, self.work = ByteLevelEncoder(path_a), PieceEncoder(path_b), work
        self.length_a, self.length_b = (np.array([len(x) for x in e.bytes_of], dtype=np.int64) for e in (self.a, self.b))
        self.size_a, self.size_b = len(self.length_a), len(self.length_b)
        # id and what follows it: A tokens end with a comma or a bar, B tokens with a comma or a semicolon
        self.names = [f"{k}{c}" for n, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for c in marks for k in range(n)]

    def align(self, texts: Sequence[str | None]) -> dict[str, list]:
        kept = [k for k, t in enumerate(texts) if t]
        found = []
        for k, x, y in zip(kept, self.a.encode([texts[k] for k in kept]), self.b.encode([texts[k] for k in kept])):
            want = b" " + texts[k].encode()
            if b"".join(map(self.a.bytes_of.__getitem__, x)) == want == b"".join(map(self.b.bytes_of.__getitem__, y)):
                found.append((k, x, y))
        out = {n: [0] * len(texts) for n in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"groups_sha256": [""] * len(texts), "pairs": [b""] * len(texts), "times": [b""] * len(texts)}
        if not found:
            return out
        ids_a, ids_b = (np.concatenate([np.asarray(f[s], dtype=np.int64) for f in found]) for s in (1, 2))
        many_a, many_b = (np.array([len(f[s]) for f in found], dtype=np.int64) for s in (1, 2))
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        link_a, link_b, shared = merge_ends(ends_a, ends_b, self.work)
        doc_of = np.repeat(np.arange(len(found)), many_a)
        last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        n_groups, n_links = np.bincount(doc_of[last_a], minlength=len(found)), np.bincount(doc_of[link_a], minlength=len(found))

        # ids as text: the A tokens of a group, then its B tokens
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        place_a = np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a]
        place_b = np.arange(len(ids_b)) + (last_a + 1)[group_b]
        named = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        closes_a, closes_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        named[place_a] = ids_a + self.size_a * closes_a
        named[place_b] = 2 * self.size_a + ids_b + self.size_b * closes_b

        # distinct id pairs of each document and how often they are linked
        span = self.size_a * self.size_b
        code, times = np.unique(doc_of[link_a] * span + ids_a[link_a] * self.size_b + ids_b[link_b], return_counts=True)
        bound = np.searchsorted(code, np.arange(len(found) + 1) * span)
        code %= span
        text_end = np.cumsum(many_a + many_b)
        for d, (k, x, y) in enumerate(found):
            text = "".join(map(self.names.__getitem__, named[text_end[d] - len(x) - len(y) : text_end[d]].tolist()))
            low, high = bound[d], bound[d + 1]
            out["n_a"][k], out["n_b"][k], out["n_groups"][k], out["n_links"][k] = len(x), len(y), int(n_groups[d]), int(n_links[d])
            out["groups_sha256"][k] = hashlib.sha256(text[:-1].encode()).hexdigest()
            out["pairs"][k], out["times"][k] = code[low:high].astype("<i8").tobytes(), times[low:high].astype("<i4").tobytes()
        return out


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times: one row for each row of `docs`.

    `path_a` is a byte-level BPE file and reads space + text, `path_b` a sentencepiece model that adds the space itself. Ends of both cut
    the bytes into groups, neighbouring ends of either into links. pairs are the distinct linked ids, A id * size of B + B id, as
    little-endian 64-bit numbers, times how often each is linked (32 bits). Null and empty texts, and texts that either side can't give
    back byte by byte, have no tokens: zeros and empty columns. Null ids and repeated rows are rows like any other; an empty table
    gives none; further columns are left out. Nothing is shuffled.
    """

    def make():
        aligner = Aligner(path_a, path_b)
        return lambda part: {"doc_id": part["doc_id"], **aligner.align(part["text"])}

    return map_slices(text_rows(docs, id_column, text_column), DIGEST + ", pairs binary, times binary", make)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs: how many documents hold each linked id pair. Tasks add up before they send: one row for each pair and task, or more
    where a task has seen over MOST_HELD of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merged():
            codes, place = np.unique(np.concatenate([held, *waiting]), return_inverse=True)
            return codes, np.bincount(place, weights=np.concatenate([sums, *(np.ones(len(w), np.int64) for w in waiting)])).astype(np.int64)

        for batch in batches:
            for data in batch.column("pairs"):
                waiting.append(np.frombuffer(data.as_buffer(), dtype="<i8"))
                size += len(waiting[-1])
                if size > MOST_HELD:
                    held, sums = merged()
                    waiting, size = [], 0
                    if len(held) > MOST_HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], names=["pair", "n"])
                        held, sums = held[:0], sums[:0]
        if waiting or len(held):
            held, sums = merged()
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))


def best_pairs(counts: DataFrame, size_b: int) -> DataFrame:
    """pair, n_docs, best: has no other pair of the same A id a higher count? An A id has at most as many pairs as B has ids."""
    by_a = Window.partitionBy(F.expr(f"pair div {size_b}"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(by_a))


def _held_from(pairs: DataFrame, most: int) -> int:
    """The smallest count from which at most `most` pairs are held in every task; 0 if all are. Read off a histogram by powers of two."""
    power = F.floor(F.log2("n_docs")).cast("int")
    steps = pairs.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = 0
    for power, n in sorted(steps, reverse=True):
        total += n
        if total > most:
            return 2 ** (power + 1)
    return 0


def alignment_report(
    docs: DataFrame, path_a: str, path_b: str, most_held: int = MOST_HELD, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of `docs` (see align_documents).

    An id pair's count is the number of documents of the whole table that hold it linked (a repeated row is a document of its own).
    n_best counts the links whose count is the highest of their A id, ties included; count_sum adds the counts of all links. Texts are
    read once; the alignment is staged. Up to `most_held` pairs, the most frequent ones, are sent to every task; links of rarer pairs
    meet their counts in a join by pair and are added up by row.
    """
    spark = docs.sparkSession
    aligned = staged(align_documents(docs, path_a, path_b, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = staged(best_pairs(pair_counts(aligned), len(PieceEncoder(path_b).bytes_of)), "pair-counts")
    least = _held_from(pairs, most_held)
    frequent = pairs.where(F.col("n_docs") >= least).toArrow()
    held = frequent.column("pair").to_numpy(), frequent.column("n_docs").to_numpy(), frequent.column("best").to_numpy(zero_copy_only=False)
    order = np.argsort(held[0])
    table = spark.sparkContext.broadcast(tuple(x[order] for x in held))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = table.value
        for batch in batches:
            sums, bests, rest, rest_times = [], [], [], []
            for data, often in zip(batch.column("pairs"), batch.column("times")):
                code, times = np.frombuffer(data.as_buffer(), dtype="<i8"), np.frombuffer(often.as_buffer(), dtype="<i4").astype(np.int64)
                if not len(known):
                    hit, at = np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=np.int64)
                else:
                    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    hit = known[at] == code
                sums.append(int((times[hit] * counts[at[hit]]).sum()))
                bests.append(int((times[hit] * best[at[hit]]).sum()))
                rest.append(code[~hit].tolist())
                rest_times.append(times[~hit].tolist())
            keep = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            more = [pa.array(x, type=t) for x, t in ((bests, pa.int64()), (sums, pa.int64()), (rest, pa.list_(pa.int64())), (rest_times, pa.list_(pa.int64())))]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest", "rest_times"]
            yield pa.RecordBatch.from_arrays([*keep, *more], names=names)

    looked = aligned.mapInArrow(look_up, "row long, " + DIGEST + ", n_best long, count_sum long, rest array<long>, rest_times array<long>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not least:
        return looked.select(*columns)
    looked = staged(looked, "aligned-counts")
    rare = looked.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("p")).select("row", F.col("p.rest").alias("pair"), F.col("p.rest_times").alias("times"))
    added = rare.join(pairs.where(F.col("n_docs") < least), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"))
    return looked.join(added, "row", "left").select(*[
        (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) if (m := {"n_best": "more_best", "count_sum": "more_sum"}.get(c)) else c for c in columns])
