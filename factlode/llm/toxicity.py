"""Toxicity by non-negative learning from positive and unlabelled texts.

Confirmed toxic texts are the positives; all other texts of the learning rows are unlabelled, whatever their label says. With the class
prior p and the logistic losses l+ and l-, the risk is  p E+[l+] + max(0, Eu[l-] - p E+[l-]):  a negative second term means that the
classifier has begun to learn single positives by heart, and the step then goes back along it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from factlode.llm.rows import map_slices, remainder, slices, text_rows

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """bits: 2**bits hashed features. shards: classifiers, each trained on its own draw and then averaged. positives, unlabelled: expected
    size of a draw where there are more, by a hash of the id. least_z: how many standard errors more often positives must have a feature
    than unlabelled texts for it to be used."""

    bits: int = 20
    shards: int = 4
    positives: int = 4_000
    unlabelled: int = 8_000
    least_z: float = 5.0
    steps: int = 400
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 11


class Features:
    """Hashed words and word beginnings of a text, each counted once. Hashes of words are remembered in a bounded table."""

    def __init__(self, bits: int, remember: int = 200_000):
        self.mask, self.remember, self.words = (1 << bits) - 1, remember, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        low = word.lower()
        keys = [f"={low}", *(f"<{low[:n]}" for n in PREFIXES if len(low) >= n)]
        return tuple({xxhash.xxh3_64_intdigest(k) & self.mask for k in keys})

    def of(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall(text or ""))
        known, out = self.words, set()
        for word in words:
            found = known.get(word)
            if found is None:
                found = self.of_word(word)
                if len(known) < self.remember and len(word) < 40:
                    known[word] = found
            out.update(found)
        return np.fromiter(out, dtype=np.int32, count=len(out))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier over the features that positives have significantly more often; the others weigh nothing,
    so the length of a text doesn't matter. Unlabelled texts hold positives too: a feature is compared with its rate among the negatives
    that the prior implies, whatever the share of positives. Full-batch steps with adaptive rates."""
    size = 1 << s.bits
    rates = [(np.bincount(np.concatenate(t), minlength=size) + 0.5) / (len(t) + 1) for t in (positive, unlabelled)]
    error = np.sqrt(sum(r * (1 - r) / len(t) for r, t in zip(rates, (positive, unlabelled))))
    negatives = np.maximum(0, rates[1] - prior * rates[0]) / (1 - prior)
    used = np.flatnonzero((rates[0] - rates[1] > s.least_z * error) & (rates[0] > 2 * negatives))
    column = np.full(size, -1, dtype=np.int64)
    column[used] = np.arange(len(used))

    def cells(texts):
        """(row, column) of the used features."""
        row, at = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), column[np.concatenate(texts)]
        return row[at >= 0], at[at >= 0]

    n_p, n_u = len(positive), len(unlabelled)
    (p_row, p_col), (u_row, u_col) = cells(positive), cells(unlabelled)
    weights, bias = np.zeros(len(used) + 1), np.log(prior / (1 - prior))  # the last weight is the change of the bias
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, s.steps + 1):
        mp = np.bincount(p_row, weights[p_col], n_p) + bias + weights[-1]
        mu = np.bincount(u_row, weights[u_col], n_u) + bias + weights[-1]
        negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
        p_part, u_part = prior * _sigmoid(mp) / n_p, _sigmoid(mu) / n_u  # slopes of the two halves of the negative risk
        if negative >= 0:
            p_slope, u_slope = -prior * _sigmoid(-mp) / n_p - p_part, u_part
        else:
            p_slope, u_slope = p_part, -u_part
        slope = np.zeros_like(weights)
        slope[:-1] = np.bincount(p_col, p_slope[p_row], len(used)) + np.bincount(u_col, u_slope[u_row], len(used)) + s.decay * weights[:-1]
        slope[-1] = p_slope.sum() + u_slope.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    all_weights = np.zeros(size)
    all_weights[used] = weights[:-1]
    return all_weights, float(bias + weights[-1])


MOST_PRIOR = 0.98


@dataclass(frozen=True)
class ToxicityModel:
    """The mean of the shards' classifiers; without one, every text scores 0."""

    weights: np.ndarray
    bias: float
    bits: int


def _draw(ids: DataFrame, bound: int, settings: Settings, kind: str) -> DataFrame:
    """For each shard, ids whose hash lies below a rate: `bound` are expected however many there are, and nothing is sorted for it."""
    rate = min(1.0, bound / max(1, ids.count()))
    each = ids.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(settings.shards - 1))))
    draw = F.xxhash64("doc_id", "shard", F.lit(kind), F.lit(settings.seed))
    drawn = each.withColumn("draw", draw).where(F.shiftrightunsigned("draw", 11).cast("double") / float(1 << 53) < rate)
    return drawn.select("doc_id", F.lit(kind == "positive").alias("positive"), "draw", "shard")


def fit_toxicity(rows: DataFrame, labels: DataFrame, prior: float | None = None, settings: Settings = Settings()) -> ToxicityModel:
    """Train on rows (doc_id, text) and labels (doc_id, toxic; one row per id, null ids left out).

    `prior` is the share of toxic texts among all; None takes the share of 1 among the labels, which is the only use of the label 0. A
    share over MOST_PRIOR counts as MOST_PRIOR: without negatives among the unlabelled texts there is nothing to tell apart.
    Unlabelled texts are drawn from all rows, one row of each id. Only ids are joined with labels; the drawn ids, whose number `settings` bounds, are then
    broadcast to fetch their texts. Without a positive text nothing is learnt.
    """
    nothing = ToxicityModel(np.zeros(1 << settings.bits, dtype=np.float32), -50.0, settings.bits)
    ids = rows.select("doc_id").where("doc_id is not null").distinct()
    told = ids.join(labels, "doc_id").agg(F.avg((F.col("toxic") == 1).cast("double")).alias("share")).first().share
    prior = told if prior is None else prior
    if not told or not prior:
        return nothing
    prior = min(max(prior, 1e-4), MOST_PRIOR)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings.bits)
        for part in slices(batches):
            found = [np.sort(features.of(t)).tobytes() for t in part["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(part["doc_id"], pa.int64()), "features": pa.array(found, pa.binary())})

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "features"], kind="stable")
        texts = {kind: [np.frombuffer(b, dtype=np.int32) for b in group.features[group.positive == kind]] for kind in (True, False)}
        if not texts[True] or not texts[False]:
            return pd.DataFrame({"shard": [], "weights": [], "bias": []})
        weights, bias = fit_nnpu(texts[True], texts[False], prior, settings)
        return pd.DataFrame({"shard": [int(key[0])], "weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    drawn = _draw(ids.join(labels.where("toxic = 1"), "doc_id", "left_semi"), settings.positives, settings, "positive")
    drawn = drawn.unionAll(_draw(ids, settings.unlabelled, settings, "unlabelled"))
    # rows that repeat an id count once, by an aggregate that sends one of them from each task
    sample = rows.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(featurize, "doc_id long, features binary")
    sample = sample.groupBy("doc_id").agg(F.min("features").alias("features")).join(F.broadcast(drawn), "doc_id").select("draw", "shard", "positive", "features")
    fitted = sample.groupBy("shard").applyInPandas(fit, "shard int, weights binary, bias double").orderBy("shard").collect()
    if not fitted:
        return nothing
    weights = np.mean([np.frombuffer(r.weights, dtype=np.float32) for r in fitted], axis=0)
    return ToxicityModel(weights, float(np.mean([r.bias for r in fitted])), settings.bits)


def score_texts(rows: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row; a null or empty text is scored by the bias alone."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        features = Features(model.bits)

        def work(part):
            scores = [float(_sigmoid(np.float64(model.weights[features.of(t)].sum() + model.bias))) for t in part["text"]]
            return {"doc_id": part["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    return map_slices(rows.select("doc_id", "text"), "doc_id long, score double, predicted int", make)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2, modulus: int = 4, prior: float | None = None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of `docs` (doc_id, text); `labels` has (doc_id, toxic).

    Learns from the rows whose crc32(doc_id as text) mod `modulus` is not `held_out`; rows with a null id are scored and teach nothing. A
    document with several labels counts as toxic if one says so; repeated rows are rows of their own. A null text counts as empty.
    Without positives every score is (nearly) 0.
    """
    rows = text_rows(docs)
    is_held = remainder(F.col("doc_id"), modulus) == held_out
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    told = told.where(remainder(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit_toxicity(rows.where(~is_held), told, prior, settings)
    scored = score_texts(rows, model)
    return scored.select("doc_id", is_held.alias("held_out"), "score", "predicted")
