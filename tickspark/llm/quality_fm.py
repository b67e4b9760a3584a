"""Document quality by a factorisation machine.

Features of a text are its words (hashed, presence scaled to unit length), statistics of its structure
and its metadata, each cut at quantiles of the training rows into indicator features.  The machine
scores ``w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``: every pair of features
interacts through vectors of rank ``RANK``, at a cost linear in the number of features.

``n_chars`` is the metadata used; null there is a category of its own.  Null and empty texts have no
words and the lowest class of every statistic.  Very long texts are read whole.  Repeated rows get equal scores.  Of
labels that contradict each other for one id the lower one counts; of rows that repeat an id the least (by text,
nulls first) is learned from.  Null labels are left out; without both classes the
score is the share of good labels (1 when there are none: nothing is rejected unasked).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import SHINGLE, WordHash, first_texts, fold, mix, read

WORD_BUCKETS = 1 << 15
RANK = 6
#: Most labelled rows taken for learning: low quality, high quality.
MAX_ROWS = (3000, 6000)
STATISTICS = (
    "words", "word_length", "symbols", "marks", "upper", "digits", "punctuation", "lines", "repeated_lines",
    "repeated_neighbours", "repeated_windows", "distinct_words", "n_chars",
)
#: Indicator features of one statistic.
BINS = 12
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGITS = (np.arange(256) >= 48) & (np.arange(256) <= 57)
STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8))


def describe(text: str | None, n_chars: float | None, cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets, and the statistics of one whole text."""
    stats = np.zeros(len(STATISTICS))
    stats[-1] = -1.0 if n_chars is None or n_chars != n_chars else np.log1p(max(0.0, n_chars))
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.lower().split()
    n = len(ws)
    if not n:
        return np.empty(0, np.int64), stats
    h = np.fromiter(map(cache.__getitem__, ws), np.uint64, n)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = max(0, n - SHINGLE + 1)
    repeated = 0.0
    if windows:
        w = np.full(windows, SHINGLE, np.uint64)
        for k in range(SHINGLE):
            w = mix(w + h[k : k + windows])
        repeated = 1 - len(np.unique(w)) / windows
    distinct = np.unique(h)
    letters = sum(map(len, ws))
    stats[:-1] = (
        np.log1p(n), letters / n, count[SYMBOLS].sum() / n, count[MARKS].sum() / n, count[UPPER].sum() / letters,
        count[DIGITS].sum() / n, count[STOPS].sum() / n, len(lines) / n,
        1 - len(set(lines)) / len(lines), float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, repeated, len(distinct) / n,
    )
    return np.unique(distinct % np.uint64(WORD_BUCKETS)).astype(np.int64), stats


@dataclass
class Model:
    """Cuts of the statistics, and weights: words first, then indicators."""

    cuts: list[np.ndarray]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, buckets: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature number, value and row of every non-zero feature."""
        n = len(buckets)
        size = np.array([len(b) for b in buckets], np.int64)
        bins = np.stack([np.searchsorted(c, stats[:, k], side="right") for k, c in enumerate(self.cuts)], 1)
        flags = WORD_BUCKETS + bins + np.arange(len(self.cuts)) * BINS
        ids = np.concatenate([*buckets, flags.ravel()]) if n else np.empty(0, np.int64)
        row = np.concatenate([np.repeat(np.arange(n), size), np.repeat(np.arange(n), len(self.cuts))])
        value = np.concatenate([
            np.repeat(1 / np.sqrt(np.maximum(size, 1)), size), np.full(flags.size, 1 / np.sqrt(len(self.cuts)))
        ])
        return ids, value, row

    def raw(self, ids: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The score by sums of squares, and the sums of factors."""
        vx = self.v[ids] * value[:, None]
        total = np.stack([np.bincount(row, vx[:, f], n) for f in range(RANK)], 1)
        square = np.bincount(row, (vx * vx).sum(1), n)
        return self.w0 + np.bincount(row, self.w[ids] * value, n) + 0.5 * ((total * total).sum(1) - square), total

    def score(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        if not buckets:
            return np.empty(0)
        z, _ = self.raw(*self.rows(buckets, stats), len(buckets))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str | None], n_chars: list[float | None], good: np.ndarray, *, epochs: int = 14,
          rate: float = 0.15, word_decay: float = 2e-3, seed: int = 5) -> Model:
    """Adaptive gradient descent on the logistic loss; word weights are shrunk, structure is not."""
    cache, rng = WordHash(), np.random.default_rng(seed)
    parts = [describe(t, c, cache) for t, c in zip(texts, n_chars, strict=True)]
    buckets, stats = [p[0] for p in parts], np.array([p[1] for p in parts]).reshape(len(parts), len(STATISTICS))
    cuts = [
        np.unique(np.quantile(stats[:, k], np.linspace(0, 1, BINS)[1:])) if len(stats) else np.empty(0)
        for k in range(len(STATISTICS))
    ]
    size = WORD_BUCKETS + BINS * len(STATISTICS)
    m = Model(cuts, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if len(set(good.tolist())) < 2:
        share = float(np.clip(good.mean() if len(good) else 1.0, 1e-6, 1 - 1e-6))
        m.w0, m.v[:] = float(np.log(share / (1 - share))), 0
        return m
    seen_w, seen_v, seen_0 = np.full(size, 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    # Both classes weigh the same, so the score is the chance of high quality if half of all texts had it.
    weight = np.where(good == 1, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(good))
        for k in range(0, len(order), 256):
            c = order[k : k + 256]
            ids, value, row = m.rows([buckets[i] for i in c], stats[c])
            z, total = m.raw(ids, value, row, len(c))
            g = weight[c] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[c]) / len(c)
            used, place = np.unique(ids, return_inverse=True)
            shrink = np.where(used < WORD_BUCKETS, word_decay, 1e-5)
            gw = np.bincount(place, g[row] * value, len(used)) + shrink * m.w[used]
            vx = m.v[ids] * value[:, None]
            gx = (g[row] * value)[:, None] * (total[row] - vx)
            gv = np.stack([np.bincount(place, gx[:, f], len(used)) for f in range(RANK)], 1) + shrink[:, None] * m.v[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_0 += g.sum() ** 2
            m.w[used] -= rate * gw / np.sqrt(seen_w[used])
            m.v[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
            m.w0 -= rate * g.sum() / np.sqrt(seen_0)
    return m


def sample(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> DataFrame:
    """``doc_id, text, n_chars, quality`` of a bounded sample of learnable labelled rows."""
    known = labels.where(F.col("quality").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    part = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows[k]) for k in (0, 1)]
    return first_texts(docs, part[0].unionByName(part[1]), "text", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> Model:
    """Train on at most ``max_rows`` rows of low and high quality, brought to the driver."""
    rows = sorted(sample(docs, labels, max_rows).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    return train([r["text"] for r in rows], [r["n_chars"] for r in rows], np.array([r["quality"] for r in rows], np.int64))


def quality_score(model: Model) -> Column:
    """The score of a whole text, from ``text`` and ``n_chars``."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache = WordHash()
        for text, n_chars in batches:
            parts = [describe(t, c, cache) for t, c in zip(text, n_chars, strict=True)]
            stats = np.array([p[1] for p in parts]).reshape(len(parts), len(STATISTICS))
            yield pd.Series(model.score([p[0] for p in parts], stats))

    return scored("text", F.col("n_chars").cast("double"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    score = quality_score(fit(docs, read(spark, sf_dir, "labels")))
    return docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int")
    )


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents unlikely to be of high quality go."""
    return docs.where(quality_score(fit(docs, read(spark, sf_dir, "labels"))) >= 0.3)
