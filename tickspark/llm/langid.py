"""Language identification by nearest centroid.

A text is a vector of its character n-grams (1 to 3, letters in lower case, everything else one
space), hashed, with logarithmic counts, weighted by inverse document frequency and scaled to unit
length.  Each language has several centroids, found by spherical clustering of its training texts; a
text gets the language of the centroid with the highest cosine.  A text whose highest cosine is below
what nearly all training texts of that language reach is ``rejected``: it is far from everything.

A null text, or one without a letter, is ``und`` with score 0.  Null languages are left out of learning;
with no training text every text is ``und``.  Equal cosines go to the language first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import fold, mix, read

BUCKETS = 1 << 12
CENTROIDS = 4
#: Training texts taken of each language (about; twice as many in all is a hard limit).
PER_LANGUAGE = 1200
#: Share of training texts below the rejection line of their language, and how much lower it is put.
REJECT_QUANTILE, REJECT_SLACK = 0.002, 0.8
#: Cosines are turned into scores by a softmax of this sharpness.
SHARPNESS = 25.0
LETTER = regex.compile(r"\p{L}")
#: Code points below 128 that are letters; all above count as letters.
ASCII_LETTER = np.array([chr(c).isalpha() for c in range(128)])


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of one whole text."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(p < 128, ASCII_LETTER[np.minimum(p, 127)], True)
    p = np.where(letter, p, 32).astype(np.uint64)
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
    p = np.concatenate(([np.uint64(32)], p[keep], [np.uint64(32)]))
    pair = p[:-1] * np.uint64(0x10001) + p[1:]
    triple = pair[:-1] * np.uint64(0x10001) + p[2:]
    out = np.zeros(BUCKETS)
    for k, h in enumerate((p, pair, triple)):
        spread = (h + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        out += np.bincount((spread >> np.uint64(64 - 12)).astype(np.int64), minlength=BUCKETS)
    return out


def vectors(texts: list[str], idf: np.ndarray | None = None) -> np.ndarray:
    """Unit TF-IDF vectors, one row per text; without ``idf`` the plain logarithmic counts."""
    x = np.empty((len(texts), BUCKETS), np.float32)
    for k, t in enumerate(texts):
        x[k] = np.log1p(counts(t))
    if idf is None:
        return x
    x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """``centroids[i]`` belongs to ``languages[owner[i]]``; ``floor`` is the rejection line of a language."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def nearest(self, texts: list[str | None]) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "rejected": True})
        rows = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        if not rows or not self.languages:
            return out
        cosine = vectors([texts[k] for k in rows], self.idf) @ self.centroids.T
        best = np.stack([cosine[:, self.owner == j].max(1) for j in range(len(self.languages))], 1)
        pick = best.argmax(1)
        power = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        out.loc[rows, "lang_pred"] = np.array(self.languages, object)[pick]
        out.loc[rows, "score"] = (power.max(1) / power.sum(1)).astype(float)
        out.loc[rows, "rejected"] = best[np.arange(len(rows)), pick] < self.floor[pick]
        return out


def cluster(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; fewer when there are fewer texts."""
    c = x[rng.choice(len(x), min(k, len(x)), False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(texts: list[str], langs: list[str], seed: int = 3) -> Model:
    """Inverse document frequencies, centroids and rejection lines of labelled texts."""
    rng = np.random.default_rng(seed)
    kept = [k for k, t in enumerate(texts) if LETTER.search(t)]
    if not kept:
        return Model([], np.ones(BUCKETS, np.float32), np.empty((0, BUCKETS), np.float32), np.empty(0, int), np.empty(0))
    x = vectors([texts[k] for k in kept])
    names = sorted({langs[k] for k in kept})
    label = np.array([names.index(langs[k]) for k in kept])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    found = [cluster(x[label == j], CENTROIDS, rng) for j in range(len(names))]
    floor = [
        REJECT_SLACK * np.quantile((x[label == j] @ c.T).max(1), REJECT_QUANTILE) for j, c in enumerate(found)
    ]
    owner = np.repeat(np.arange(len(names)), [len(c) for c in found])
    return Model(names, idf, np.concatenate(found).astype(np.float32), owner, np.array(floor))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Train on a bounded sample of every language outside fold 2 of 4, by id hash.

    Languages are counted first, which reads two columns; the model itself grows with their number.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    n = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not n:
        return train([], [])
    share = F.create_map(*[F.lit(v) for lang, c in sorted(n.items()) for v in (lang, min(1.0, per_language / c))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    rows = usable.where(draw < share[F.col("lang")]).select("doc_id", "text", "lang").limit(2 * per_language * len(n)).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add the struct ``language`` (lang_pred, score, rejected) of every whole text; all columns stay."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            texts = text.tolist()
            # The dense vectors of a slice are held at once, not those of a whole batch.
            yield pd.concat(
                [model.nearest(texts[k : k + 256]) for k in range(0, len(texts), 256)] or [model.nearest([])],
                ignore_index=True,
            )

    return docs.withColumn("language", nearest("text"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score", "language.rejected"
    )
