"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train linear classifiers over the presence
of hashed words. The risk of taking unlabelled texts for clean is corrected by the
class prior: with losses l+ and l- it is  prior * E_p[l+] + max(0, E_u[l-] - prior *
E_p[l-]);  where the second part falls below zero its gradient is turned round, so that
a flexible model does not learn single unlabelled texts by heart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe import chunks
from ledgerline.llm.common import mapped, stored, table
from ledgerline.llm.features import hashed_words
from ledgerline.llm.quality import drawn, held_out, learnable

#: Labelled rows that are trained on at most (expected; drawn by a hash of the id): confirmed ones, and rows of any label
#: whose label is hidden, which stand for unlabelled text.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Bits of a word's hash; confirmed texts that must hold a word (at least and as a part of all), and by how many standard
#: deviations more than unlabelled ones do; classifiers; steps, rate and decay of their training.
HASH_BITS, LEAST_TEXTS, LEAST_PART, LEAST_EXCESS, MODELS, STEPS, RATE, DECAY = 20, 3, 0.015, 5.0, 3, 300, 0.1, 1e-4


def word_slots(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct hashed words of each text."""
    for group in chunks(texts):
        of, names = hashed_words(group)
        keys = np.unique((of.astype(np.uint64) << np.uint64(HASH_BITS)) | (names >> np.uint64(64 - HASH_BITS)))
        edges = np.searchsorted(keys >> np.uint64(HASH_BITS), np.arange(len(group) + 1).astype(np.uint64))
        slots = (keys & np.uint64((1 << HASH_BITS) - 1)).astype(np.uint32)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield slots[s:e]


def _rows(texts: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the words that are features."""
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = place[np.concatenate([np.zeros(0, np.uint32), *texts])]
    return of[at >= 0], at[at >= 0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(p: tuple, u: tuple, n_p: int, n_u: int, n_f: int, prior: float) -> np.ndarray:
    """Weights and, last, the intercept of one classifier, by steps of Adam on the corrected risk."""
    w = np.zeros(n_f + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    margin = lambda x, n: np.bincount(x[0], w[x[1]], n) + w[-1]
    back = lambda x, d: np.append(np.bincount(x[1], d[x[0]], n_f), d.sum())
    for t in range(1, STEPS + 1):
        zp, zu = margin(p, n_p), margin(u, n_u)
        clean_p, clean_u = np.logaddexp(0, zp).mean(), np.logaddexp(0, zu).mean()
        up = back(p, -_sigmoid(-zp) / n_p) * prior
        down = back(u, _sigmoid(zu) / n_u) - prior * back(p, _sigmoid(zp) / n_p)
        g = up + down if clean_u - prior * clean_p >= 0 else -down
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Classifiers:
    """Averaged classifiers; scores are probabilities of being toxic."""

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> None:
        self.prior = min(max(prior, 1e-3), 0.5)
        self.slots, self.weights = np.zeros(0, np.int64), np.zeros((0, MODELS))
        self.base = np.full(MODELS, np.log(self.prior / (1 - self.prior)))
        if not positive or not unlabelled:
            return
        in_p, in_u = (np.bincount(np.concatenate(x), minlength=1 << HASH_BITS) for x in (positive, unlabelled))
        usual = (in_u + 1) / (len(unlabelled) + 2)
        excess = (in_p - len(positive) * usual) / np.sqrt(len(positive) * usual * (1 - usual) + 1)
        self.slots = np.flatnonzero((in_p >= max(LEAST_TEXTS, LEAST_PART * len(positive))) & (excess >= LEAST_EXCESS))
        place = self._places()
        rng, found = np.random.default_rng(0), []
        u = _rows(unlabelled, place)
        for k in range(MODELS):
            chosen = [positive[i] for i in rng.integers(0, len(positive), len(positive))] if k else positive
            found.append(_train(_rows(chosen, place), u, len(positive), len(unlabelled), len(self.slots), self.prior))
        self.weights, self.base = np.stack([w[:-1] for w in found], axis=1), np.array([w[-1] for w in found])

    def _places(self) -> np.ndarray:
        """For each hashed word the number of its feature, or -1."""
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[self.slots] = np.arange(len(self.slots))
        return place

    def score(self, texts: list[str]) -> np.ndarray:
        """A score for each text; an empty one has what the intercepts say."""
        of, at = _rows(list(word_slots(texts)), self._places())
        z = np.stack([np.bincount(of, self.weights[at, k], len(texts)) for k in range(MODELS)], axis=1) + self.base
        return _sigmoid(z).mean(axis=1)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifiers:
    """Classifiers of confirmed toxic texts and unlabelled ones outside the held-out fold.

    The unlabelled texts are those of labelled rows of both kinds, whose labels are hidden:
    the class prior, the part of toxic ones among all labels, is that of their mixture.
    Rows count as often as they stand. Without confirmed texts every score is the least prior.
    """
    known = stored(learnable(labels, "toxic", 4, 2), "labels")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    chosen = drawn(known.filter("y = 1").select("doc_id"), positives, toxic)
    free = drawn(known.select("doc_id"), unlabelled, n, 1)
    wanted = chosen.withColumn("p", F.lit(1)).join(free.withColumn("u", F.lit(1)), "doc_id", "full")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("u"), pa.array([s.tobytes() for s in word_slots(texts)], pa.binary())], names=["p", "u", "slots"])

    # the broadcast and what is collected are bounded by positives + unlabelled
    texts = mapped(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "p", "u"), each, "p int, u int, slots binary").collect()
    apart = lambda c: [np.frombuffer(s, np.uint32) for s in (bytes(r.slots) for r in texts if r[c])]
    return Classifiers(apart("p"), apart("u"), toxic / max(1, n))


def score_toxicity(docs: DataFrame, model: Classifiers) -> DataFrame:
    """``docs`` with toxic_score double. A null text counts as empty; rows and columns are kept."""
    names = [c for c in docs.columns if c != "toxic_score"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model.score(texts))], names=[*names, "toxic_score"])

    schema = docs.select(*names).withColumn("toxic_score", F.lit(0.0)).schema
    return mapped(docs.select(*names), each, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
