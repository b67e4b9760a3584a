"""Quality rules learned as a decision list and applied as Spark conditions.

Text statistics are built-in expressions over whole texts.  A decision list is learned on a bounded
sample of labelled rows: rules are conjunctions of thresholds on statistics, each grown on two thirds
of the rows (the condition with the best information gain first), pruned on the rest, and kept as
long as it is right in enough of what it covers; rows it covers are set aside and the next rule is
sought.  The rules in their order become one ``when ... otherwise`` expression.

Null and empty texts have no words and fail the base rule.  Very long texts are counted whole; repeated rows are
judged alike, and a text on a threshold counts as above it.  Of labels that contradict each other for one id the lower one
counts; of texts that repeat an id the least (nulls first) is learned from.  Labels that are null are left out of
learning; with one class of labels or none the list is empty and every row gets the default verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import SPACE, first_texts, fold, let, read, window_hashes, words
from tickspark.session import materialize

#: Most labelled rows taken for learning.
MAX_ROWS = 12_000
#: Statistics that rules may test, derived from the counted ones.
RATIOS = (
    "n_words", "chars_per_word", "symbols_per_word", "marks_per_word", "upper_share", "dup_line_share",
    "repeat_share", "lines_per_word",
)


def _repeated_words(word_array: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the text."""

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(pairs, lambda s: F.filter(
            s, lambda e, j: F.get(s, j - 1)["h"].eqNullSafe(e["h"]) | F.get(s, j + 1)["h"].eqNullSafe(e["h"])
        ))
        places = F.array_sort(F.transform(repeated, lambda e: e["i"]))
        covered = F.aggregate(
            places,
            F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(5))).alias("n")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered)

    return let(window_hashes(word_array), count)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counted statistics of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def lines(split_lines: Column) -> Column:
        return let(
            F.filter(split_lines, lambda x: x.rlike(f"[^{SPACE}]")),
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        )

    counted = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).alias("n_repeat_words"),
    ))
    upper = F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return docs.select(
        "doc_id", counted.alias("w"), lines(F.split(text, "\n", -1)).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_marks"),
        upper.cast("long").alias("n_upper"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_marks", "n_upper")


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The tested statistics as expressions of the counted ones."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "marks_per_word": F.col("n_marks") / n,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "lines_per_word": F.col("n_lines") / n,
    }


@dataclass(frozen=True)
class Condition:
    """``name >= at`` or ``name < at``."""

    name: str
    above: bool
    at: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.at if self.above else x[self.name] < self.at

    def column(self, x: dict[str, Column]) -> Column:
        return x[self.name] >= self.at if self.above else x[self.name] < self.at


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with the share of bad rows it covered."""

    conditions: tuple[Condition, ...]
    precision: float


def _gain(pos: np.ndarray, neg: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Information gain of keeping (pos, neg) of (p0, n0)."""
    share = np.maximum(pos, 1e-12) / np.maximum(pos + neg, 1e-12)
    return np.where(pos > 0, pos * (np.log2(share) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold with the highest gain over all statistics and both directions."""
    p0, n0 = float(bad.sum()), float((~bad).sum())
    best: tuple[float, Condition] | None = None
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below_p, below_n = np.cumsum(b)[cut - 1], np.cumsum(~b)[cut - 1]
        for above, pos, neg in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
            gain = _gain(pos.astype(float), neg.astype(float), p0, n0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = float(gain[k]), Condition(name, above, float((v[cut[k] - 1] + v[cut[k]]) / 2))
    return best


def _covers(conditions: tuple[Condition, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in conditions:
        out &= c.holds(x)
    return out


def learn(
    x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4,
    min_precision: float = 0.9, min_cover: int = 5, seed: int = 7,
) -> list[Rule]:
    """Sequential covering of the bad rows."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    while len(rules) < max_rules and bad[left].any() and (~bad[left]).any():
        rows = np.flatnonzero(left)
        rng.shuffle(rows)
        grow, prune = rows[: 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]
        conditions: tuple[Condition, ...] = ()
        inside = grow
        while len(conditions) < max_conditions and bad[inside].any() and (~bad[inside]).any():
            found = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside])
            if found is None:
                break
            conditions += (found[1],)
            inside = inside[found[1].holds({k: v[inside] for k, v in x.items()})]

        def worth(cs: tuple[Condition, ...]) -> float:
            hit = _covers(cs, {k: v[prune] for k, v in x.items()}, len(prune))
            p, n = float((hit & bad[prune]).sum()), float((hit & ~bad[prune]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        hit = left & _covers(conditions, x, len(bad))
        covered, wrong = int(hit.sum()), int((hit & ~bad).sum())
        if not conditions or covered < min_cover or 1 - wrong / covered < min_precision:
            break
        rules.append(Rule(conditions, 1 - wrong / covered))
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 when none does."""
    x, out = ratios(), None
    for k, rule in enumerate(rules, 1):
        holds = rule.conditions[0].column(x)
        for c in rule.conditions[1:]:
            holds &= c.column(x)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """A bounded sample of learnable rows with their label: the lowest hashes of the id."""
    known = labels.where(F.col("quality").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return first_texts(docs, known, "text")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Learn rules on rows that pass the base rule; at most ``max_rows`` rows reach the driver."""
    # The sample is written first, or its texts' statistics would be counted before the join, over all texts.
    chosen = materialize(labelled(docs, labels, max_rows).select("doc_id", "text", "quality"), "labelled")
    rows = statistics(chosen.select("doc_id", "text")).where(~base_failed()).join(
        chosen.select(F.col("doc_id").alias("_id"), "quality"), F.col("doc_id") == F.col("_id")
    ).select(*[c.alias(k) for k, c in ratios().items()], "quality").collect()
    if not rows:
        return []
    x = {k: np.array([r[k] for r in rows], float) for k in RATIOS}
    return learn(x, np.array([r["quality"] == 0 for r in rows]))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics of every text, the base rule, the rule that fired and the verdict."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents by rules learned from the labels."""
    docs = read(spark, sf_dir, "documents")
    rules = fit(docs, read(spark, sf_dir, "labels"))
    return judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
