"""Toxicity by subword embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5, with word marks) and itself (several times, so that
it also counts beside many n-grams), hashed into a table of embeddings.  A word's vector is the mean of these, a passage of up to ``PASSAGE`` words the mean of its
words, and a linear softmax over two classes reads the passage; all are trained together in numpy.
A text scores as its most toxic passage, so that a long text does not thin out a short insult: in
training, each toxic text teaches through its highest passages, each clean one through its highest
and some random ones.  Misspelled words share n-grams with those that were seen.

Since averages and the softmax are linear, a trained model reduces to one number per n-gram; words
are scored once per worker and looked up from then on.  Where the scores of the two classes part is read from texts
that a first model has not seen, since those learned from look too certain.

Null and empty texts get the score of an empty passage, which is that of a clean text.  Very long texts are
scored in all their passages.  Repeated rows get equal scores.  Of labels that contradict each other for one id the
toxic one counts; of texts that repeat an id the first (nulls first) is learned from.  Null labels are left out; without both
classes the score is the share of toxic labels (0 when there are none).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import first_texts, fold, free_memory, mix, read

BUCKETS = 1 << 16
DIM = 8
PASSAGE = 6
NGRAMS = (3, 4, 5)
#: Buckets of the whole word, in the same table.
WORD_COPIES = 3
#: False alarms that a missed toxic text weighs as much as, where the half point is set.
MISS = 3.0
#: Most labelled rows taken for learning: clean, toxic.  With more, learning needs more than 1.5 GB on the driver.
MAX_ROWS = (5000, 1500)
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’¡¿…"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of many words at once: the buckets of all words in turn, and how many each has."""
    parts = [_subwords(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bare = [w.strip(STRIP) or w for w in words]
    points = np.frombuffer("".join(f"<{w}>" for w in bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(bare), dtype=np.int32), np.fromiter((len(w) + 2 for w in bare), np.int64, len(bare)))
    ids, owners = [], []
    for n in NGRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[k : k + m]
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        ids.append(mix(h[inside]) % np.uint64(BUCKETS))
        owners.append(owner[:m][inside])
    for seed in range(WORD_COPIES):
        whole = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in bare), np.uint64, len(bare))
        ids.append(whole % np.uint64(BUCKETS))
        owners.append(np.arange(len(bare), dtype=np.int32))
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return np.concatenate(ids).astype(np.int32)[order], np.bincount(own, minlength=len(bare)).astype(np.int32)


def tokens(text: str) -> list[str]:
    """Lower-cased words; a word repeated on the spot counts once."""
    words = text.lower().split()
    return [w for w, before in zip(words, [None, *words], strict=False) if w != before]


def passages(n: int) -> np.ndarray:
    """Starts of the passages of ``n`` words: as few as fit, of nearly equal length."""
    parts = max(1, -(-n // PASSAGE))
    return np.arange(parts) * n // parts


@dataclass
class Model:
    """Trained parameters; ``effect`` is what each bucket adds to the log odds of an average."""

    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @property
    def effect(self) -> np.ndarray:
        return self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _word_effects(effect: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean effect of each word's n-grams; every word has one at least."""
    starts = np.append(np.cumsum(sizes, dtype=np.int64) - sizes, len(flat))
    out = np.empty(len(sizes), effect.dtype)
    for k in range(0, len(sizes), 20_000):
        at = starts[k : k + 20_001]
        at = at if k + 20_000 < len(sizes) else at[: len(sizes) - k + 1]
        out[k : k + 20_000] = np.add.reduceat(effect[flat[at[0] : at[-1]]], at[:-1] - at[0])
    return out / sizes


def _softmax_step(m: Model, memory: list[np.ndarray], words: np.ndarray, lengths: np.ndarray, y: np.ndarray,
                  start: np.ndarray, sizes: np.ndarray, flat: np.ndarray, rate: float) -> None:
    """One adaptive gradient step on a batch of passages given as concatenated word numbers."""
    n_sub = sizes[words]
    first = np.repeat(start[words] - np.concatenate(([0], np.cumsum(n_sub)[:-1])), n_sub)
    ids = flat[first + np.arange(n_sub.sum())]
    passage = np.repeat(np.arange(len(y)), lengths)
    weight = np.repeat(1.0 / (n_sub * lengths[passage]), n_sub)
    owner = np.repeat(passage, n_sub)
    vec = np.stack([np.bincount(owner, weight * m.embedding[ids, d], len(y)) for d in range(DIM)], 1)
    z = vec @ m.softmax + m.bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    g_vec = p @ m.softmax.T
    g_emb = np.stack([np.bincount(ids, weight * g_vec[owner, d], BUCKETS) for d in range(DIM)], 1)
    for value, grad, seen in zip((m.embedding, m.softmax, m.bias), (g_emb, vec.T @ p, p.sum(0)), memory, strict=True):
        seen += grad * grad
        value -= rate * grad / (np.sqrt(seen) + 1e-8)


def train(texts: list[str], toxic: np.ndarray, epochs: int = 12, rate: float = 0.3, seed: int = 11) -> Model:
    """A model of all labelled texts; its half point is set on the fifth of them that a first model has not seen."""
    seen = np.random.default_rng(seed).random(len(texts)) >= 0.2
    unseen = toxic[~seen]
    first = None
    if min((unseen == 1).sum(), (unseen == 0).sum()) >= 10 and len(set(toxic[seen].tolist())) == 2:
        first = learn([t for t, k in zip(texts, seen, strict=True) if k], toxic[seen], epochs, rate, seed)
        z = Scorer(first).raw([t for t, k in zip(texts, seen, strict=True) if not k])
        first = half_point(z, unseen)
    model = learn(texts, toxic, epochs, rate, seed)
    if first and model.embedding.any():
        model.slope, model.shift = first
    return model


def half_point(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from raw scores to the odds of class 1, by Newton's method."""
    rows, weight = np.stack([x, np.ones(len(x))], 1), np.where(y == 1, MISS, 1.0)
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -30, 30)))
        # A weak pull towards slope 1 keeps the step finite where the classes part completely.
        gradient = rows.T @ (weight * (p - y)) + 0.1 * (at - [1.0, 0.0])
        at = at - np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(2), gradient)
        at[0] = np.clip(at[0], 0.1, 10.0)
    return float(at[0]), float(at[1])


def learn(texts: list[str], toxic: np.ndarray, epochs: int, rate: float, seed: int) -> Model:
    """Fit embeddings and softmax together on labelled texts."""
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2))
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32) for t in texts]
    docs_ok = np.array([len(d) > 0 for d in docs], bool)
    if len(set(toxic[docs_ok].tolist())) < 2:
        rate_toxic = float(np.clip(toxic.mean() if len(toxic) else 0, 1e-6, 1 - 1e-6))
        m.embedding[:] = 0
        m.shift = float(np.log(rate_toxic / (1 - rate_toxic)))
        return m
    flat, sizes = subwords(list(number))
    # The words are long strings beside their numbers; learning needs the numbers.
    number.clear()
    start = np.cumsum(sizes, dtype=np.int64) - sizes
    edges = [passages(len(d)) for d in docs]
    begins = np.concatenate([e + o for e, o in zip(edges, np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1])), strict=True) if len(e)])
    every = np.concatenate(docs)
    doc_of = np.repeat(np.arange(len(docs)), [len(e) for e in edges])
    spans = np.diff(np.append(begins, len(every)))
    full = spans > 0
    begins, doc_of, spans = begins[full], doc_of[full], spans[full]
    label = toxic[doc_of].astype(np.int64)
    memory = [np.full_like(v, 1e-6) for v in (m.embedding, m.softmax, m.bias)]
    n = len(begins)

    def scores() -> np.ndarray:
        w = _word_effects(m.effect.astype(np.float32), flat, sizes)
        return np.add.reduceat(w[every], begins) / spans + m.offset

    def highest(z: np.ndarray) -> np.ndarray:
        order = np.lexsort((-z, doc_of))
        lead = np.ones(n, bool)
        lead[1:] = doc_of[order][1:] != doc_of[order][:-1]
        return order[lead]

    for epoch in range(epochs):
        if epoch < 2:
            bad, good = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
            take = min(len(bad), len(good), 12_000)
            chosen = np.concatenate([rng.choice(bad, take, False), rng.choice(good, take, False)])
        else:
            z = scores()
            top = highest(z)
            sure = np.flatnonzero((label == 1) & (z > 0))
            good = np.flatnonzero(label == 0)
            chosen = np.concatenate([
                top, rng.choice(sure, min(len(sure), 4000), False), rng.choice(good, min(len(good), 8000), False),
            ])
        rng.shuffle(chosen)
        for k in range(0, len(chosen), 512):
            c = chosen[k : k + 512]
            length = spans[c]
            inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            words = every[np.repeat(begins[c], length) + inner]
            _softmax_step(m, memory, words, length, label[c], start, sizes, flat, rate)
    top = highest(z := scores())
    m.slope, m.shift = half_point(z[top], label[top])
    return m


class Scorer:
    """Scores texts with one number per n-gram; remembers words up to a bound."""

    LIMIT = 300_000

    def __init__(self, model: Model) -> None:
        self.effect = model.effect.astype(np.float32)
        self.offset, self.slope, self.shift = model.offset, model.slope, model.shift
        self.known: dict[str, float] = {}

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """The log odds of the most toxic passage of each text."""
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            words = tokens(text) if text else []
            if not words:
                out[k] = self.offset
                continue
            new = [w for w in set(words) if w not in self.known]
            if new:
                if len(self.known) > self.LIMIT:
                    self.known.clear()
                    new = list(set(words))
                self.known.update(zip(new, _word_effects(self.effect, *subwords(new)).tolist(), strict=True))
            w = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
            starts = passages(len(words))
            out[k] = (np.add.reduceat(w, starts) / np.diff(np.append(starts, len(words)))).max() + self.offset
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.shift, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, text, toxic`` of a bounded sample of learnable labelled rows, those of lowest id hash,
    and the number of all learnable rows of each class."""
    known = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    number = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = [
        known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows[k]) for k in (0, 1)
    ]
    return first_texts(docs, part[0].unionByName(part[1]), "text"), number


def fit(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> Model:
    """Train on at most ``max_rows`` clean and toxic rows, brought to the driver.

    The score is then moved from the class shares of the sample to those of all labels.
    """
    chosen, number = sample(docs, labels, max_rows)
    rows = sorted(chosen.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    texts, toxic = [r["text"] or "" for r in rows], np.array([r["toxic"] for r in rows], np.int64)
    del rows
    model = train(texts, toxic)
    del texts
    free_memory()
    have = np.bincount(toxic, minlength=2)
    if have.all() and number.get(0) and number.get(1):
        model.shift += float(np.log(number[1] / number[0]) - np.log(have[1] / have[0]))
    return model


def toxic_score(model: Model, text: str | Column = "text") -> Column:
    """The score (0 to 1) of a whole text."""
    scorer = Scorer(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scorer(texts.tolist()))

    return scored(text)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    score = toxic_score(fit(docs, read(spark, sf_dir, "labels")))
    return docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored toxic go."""
    return docs.where(toxic_score(fit(docs, read(spark, sf_dir, "labels"))) < 0.5)
