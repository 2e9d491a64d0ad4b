"""Quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles. Cyclic boosting visits the features in
turn and adds a shallow tree over one feature's bins to that feature's lookup table;
then the pairs that explain most of what is left get tables of their own in the same
way. A score is the sum of a document's bins in all tables, through the logistic.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe import chunks
from ledgerline.llm.common import mapped, stored, table
from ledgerline.llm.features import NAMES, quality_features

#: Labelled rows that a model is fitted on at most (expected; drawn by a hash of the id).
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, SMOOTH = 32, 8, 6, 60, 0.15, 5.0


@dataclass
class AdditiveModel:
    """Lookup tables over binned features; ``pairs`` maps two features to a table over coarse bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features, by additions of bins."""
        total = np.full(len(x), self.base)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, x[:, f], "right")]
        for (f, g), values in self.pairs.items():
            total += values[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g.sum() / (h.sum() + SMOOTH)


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """Where one cut of a row of bins gains most; 0 for nowhere."""
    if len(g) < 2:
        return 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + SMOOTH) + (g.sum() - gl) ** 2 / (h.sum() - hl + SMOOTH) - g.sum() ** 2 / (h.sum() + SMOOTH)
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a shallow tree over a row of bins with gradients g and curvatures h."""
    k = _split(g, h) if depth else 0
    if not k:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values and gain of the best tree with one cut along one axis and one cut of each side along the other."""
    best, gain = np.full(g.shape, _leaf(g, h)), 0.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        k = _split(a.sum(axis=1), b.sum(axis=1)) or a.shape[0] // 2
        out = np.empty(a.shape)
        won = 0.0
        for part in (slice(0, k), slice(k, None)):
            out[part] = _tree(a[part].sum(axis=0), b[part].sum(axis=0), 1)[None]
            won += float((out[part][0] * a[part].sum(axis=0)).sum()) if len(out[part]) else 0.0
        if won > gain:
            best, gain = (out.T if flip else out), won
    return best, gain


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """A model of labels y (0 or 1) over rows x; a constant one where only one label is known, one half where none is."""
    quantiles = lambda f, n: np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) if len(x) else np.zeros(0)
    cuts = [quantiles(f, BINS) for f in range(x.shape[1])]
    coarse = [quantiles(f, PAIR_BINS) for f in range(x.shape[1])]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, {})
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            n = len(cuts[f]) + 1
            step = RATE * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n))
            model.tables[f] += step
            total += step[b]
    rough = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
    shape = lambda f, g: (len(coarse[f]) + 1, len(coarse[g]) + 1)
    cells = {(f, g): rough[f] * shape(f, g)[1] + rough[g] for f, g in itertools.combinations(range(x.shape[1]), 2)}

    def grid(pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        n = shape(*pair)[0] * shape(*pair)[1]
        return np.bincount(cells[pair], y - p, n).reshape(shape(*pair)), np.bincount(cells[pair], p * (1 - p), n).reshape(shape(*pair))

    chosen = sorted(cells, key=lambda pair: -_pair_tree(*grid(pair))[1])[:PAIRS]
    model.pairs = {pair: np.zeros(shape(*pair)) for pair in chosen}
    for _ in range(ROUNDS // 2):
        for pair in chosen:
            step = RATE * _pair_tree(*grid(pair))[0]
            model.pairs[pair] += step
            total += step.ravel()[cells[pair]]
    return model


def held_out(parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` when divided by ``parts``."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts) == rest


def learnable(labels: DataFrame, label: str, parts: int, rest: int) -> DataFrame:
    """(doc_id, y) of rows outside the held-out fold; of repeated ids the greatest label."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(parts, rest))
    return known.groupBy("doc_id").agg(F.max(label).alias("y"))


def drawn(ids: DataFrame, rows: int, of: int, salt: int = 0) -> DataFrame:
    """About ``rows`` of ``of`` rows with doc_id, by a hash of the id; all where there are fewer."""
    return ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(1, of)))))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x binary) of each row: the numbers of its whole text, 8 bytes each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            rows = [bytes(r) for group in chunks(texts) for r in quality_features(group)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    return mapped(docs.select("doc_id", "text"), each, "doc_id long, x binary")


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of documents.

    A null text counts as empty and is scored like any other; repeated rows stay;
    without labels all scores are 0.5; empty tables give no rows. Columns other than
    doc_id and text are not read.
    """
    found = stored(features(docs), "quality")
    known = stored(learnable(labels, "quality", 5, 0), "labels")
    sample = drawn(known, train_rows, known.count())
    rows = found.join(F.broadcast(sample), "doc_id").select("x", "y").collect()  # bounded by train_rows and copies of an id
    x = np.frombuffer(b"".join(r.x for r in rows)).reshape(-1, len(NAMES))
    model = fit(x, np.array([r.y for r in rows], float))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = mapped(found, each, "doc_id long, score double")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality": op1_quality}
