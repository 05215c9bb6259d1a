"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound by multiplying its letters' vectors, each rotated by its place; a text
is the bundle (sum) of its n-grams, and so is a language. Texts are compared with languages by cosine.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from factlode.llm.rows import bound_batches, map_slices, remainder, slices, text_rows

NOT_LETTERS = re.compile(r"[\W\d_]+")
N = 3
UNDETERMINED = "und"


class GramVectors:
    """Vectors of letters and of n-grams; the latter are kept in a bounded table."""

    def __init__(self, dimensions: int, seed: int, remember: int = 40_000):
        self.dimensions, self.seed, self.remember = dimensions, seed, remember
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.table = np.empty((1024, dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= self.remember:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def bound(self, gram: int) -> np.ndarray:
        vector = np.ones(self.dimensions, dtype=np.int8)
        for k in range(N):
            vector = vector * np.roll(self.letter(gram >> 21 * (N - 1 - k) & 0x1FFFFF), N - 1 - k)
        return vector

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Places of n-grams in the table, which grows to hold them; what it held before goes when it is full."""
        if len(self.place) + len(grams) > self.remember:
            self.place.clear()
        known = self.place
        for gram in grams.tolist():
            if gram not in known:
                if len(known) == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[len(known)] = self.bound(gram)
                known[gram] = len(known)
        return np.fromiter(map(known.__getitem__, grams.tolist()), dtype=np.int64, count=len(grams))

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for k in range(0, len(grams), 4096):
            at = self.rows(grams[k : k + 4096])
            total += counts[k : k + 4096].astype(np.float32) @ self.table[at].astype(np.float32)
        return total


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams of lower-cased words with a blank around each, and their counts; None for a text without letters."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):  # figures such as a raised two are neither digits nor letters
        return None
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.unique(sum(codes[k : len(codes) - N + 1 + k] << 21 * (N - 1 - k) for k in range(N)), return_counts=True)


@dataclass(frozen=True)
class LanguageModel:
    """Prototypes of unit length, one for each language, in the order of their names."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    seed: int

    @property
    def dimensions(self) -> int:
        return self.prototypes.shape[1]


def fit_languages(rows: DataFrame, dimensions: int = 1024, seed: int = 7, most_languages: int = 20_000) -> LanguageModel:
    """Bundle all rows (text, lang) into one prototype per language. Rows without a text, a letter or a language teach nothing.

    Each task sends one vector per language it has seen, so a language with most of the rows costs no more than any other. The driver
    gets languages x dimensions numbers; more than `most_languages` languages (they come from a column, not from the size of the data)
    is an error.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, totals = GramVectors(dimensions, seed), {}
        for part in slices(batches):
            grams: dict[str, list] = defaultdict(list)
            for text, lang in zip(part["text"], part["lang"]):
                if (found := grams_of(text)) is not None:
                    grams[lang].append(found)
            for lang, found in grams.items():
                each, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([c for _, c in found]))
                totals[lang] = totals.get(lang, 0) + vectors.bundle(each, counts)
        if totals:
            yield pa.RecordBatch.from_pydict({
                "lang": [lang for lang in totals for _ in range(dimensions)], "place": pa.array(list(range(dimensions)) * len(totals), pa.int32()),
                "value": np.rint(np.concatenate(list(totals.values()))).astype(np.int64),
            })

    labelled = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sums = labelled.mapInArrow(bundle, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    found = sums.groupBy("lang").agg(ordered.alias("vector")).orderBy("lang").limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    prototypes = np.array([r.vector for r in found], dtype=np.float64).reshape(len(found), dimensions)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return LanguageModel(tuple(r.lang for r in found), prototypes.astype(np.float32), seed)


def predict_languages(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score: the nearest language and its cosine (0 at least); `und` and 0 for a null text, a text without letters
    or a model without languages. Among equal cosines the first name wins."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        vectors = GramVectors(model.dimensions, model.seed)

        def work(part):
            names, scores = [], []
            for text in part["text"]:
                found = grams_of(text) if text and model.languages else None
                if found is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                vector = vectors.bundle(*found)
                cosines = model.prototypes @ (vector / max(np.linalg.norm(vector), 1e-12))
                best = int(np.argmax(cosines))
                names.append(model.languages[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            return {"doc_id": part["doc_id"], "lang_pred": names, "score": scores}

        return work

    return map_slices(rows.select("doc_id", "text"), "doc_id long, lang_pred string, score double", make)


def identify_languages(docs: DataFrame, held_out: int = 0, modulus: int = 5, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row for each row of `docs`.

    Learns from the rows whose crc32(doc_id as text) mod `modulus` is not `held_out`; a null id counts as the empty text. The language
    column is read for learning only. Repeated rows teach as often as they appear; without rows to learn from all is `und`.
    """
    rows = text_rows(docs, id_column, text_column, F.col(lang_column).cast("string").alias("lang"))
    model = fit_languages(rows.where(remainder(F.col("doc_id"), modulus) != held_out))
    predicted = predict_languages(rows, model)
    return predicted.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, deviations: float = 2.5, short: int = 24) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, ...) whose language can be told: not `und`, and nearer to a language than noise is.

    The cosine of text unlike a language has a standard deviation of 1 / sqrt(dimensions) around 0; a row needs `deviations` of them. Texts of
    fewer than `short` distinct n-grams share few with a language in any case, so for them any cosine from 0 on will do. On held-out rows of
    the given documents 1 of 1,960 lies below 2.5 deviations (a text of one letter, which is short); of random letters 94 in 100 do.

    Fits on all rows that have a language. All columns stay; null ids and repeated rows are judged by their text alone.
    """
    bound_batches(docs.sparkSession)
    model = fit_languages(docs.select("text", "lang"))
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vectors = GramVectors(model.dimensions, model.seed)
        for batch in batches:
            keep = []
            for value in batch.column(text):
                found = grams_of(value.as_py() or "") if model.languages else None
                vector = vectors.bundle(*found) if found is not None else None
                least = 0.0 if found is None or len(found[0]) < short else deviations * model.dimensions**-0.5
                keep.append(found is not None and float(np.max(model.prototypes @ vector)) >= least * float(np.linalg.norm(vector)))
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, StructType(docs.schema.fields))
