"""Purged cross-validation folds as tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.operators.joins import with_key_row


def embargo_size(n: Column, pct: float = 0.01, low: int = 1, high: int | None = None) -> Column:
    """Rows kept free around a test block: a share of ``n``, at least ``low`` and, if given, at most ``high``."""
    rows = F.floor(n * pct).cast("long")
    return F.greatest(F.lit(low), rows if high is None else F.least(rows, F.lit(high)))


def _fold_start(fold: Column, n: Column, k: int) -> Column:
    """First position of a fold when the remainder goes to the first folds."""
    return fold * F.floor(n / k).cast("long") + F.least(fold, n % k)


def assign_folds(
    samples: DataFrame, k: int = 5, by: Sequence[str] = ("symbol",), pos: str = "pos"
) -> DataFrame:
    """Contiguous folds over the dense sample position ``pos`` of each key."""
    sizes = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"))
    rows = with_key_row(samples, sizes, by, [pos])
    n, p = F.col("n_samples"), F.col(pos)
    base = F.floor(n / k).cast("long")
    long_part = (n % k) * (base + 1)
    in_long = F.floor(p / (base + 1))
    in_short = n % k + F.floor((p - long_part) / F.greatest(base, F.lit(1)))
    return rows.withColumn("fold_of", F.when(p < long_part, in_long).otherwise(in_short).cast("long"))


def purged_kfold(
    samples: DataFrame, k: int = 5, by: Sequence[str] = ("symbol",), pos: str = "pos",
    embargo_pct: float = 0.01, start: str | None = None, holding: str | None = None,
) -> DataFrame:
    """Rows (fold, sample, role) with role ``train`` or ``test``; purged pairs are left out.

    Without ``start`` and ``holding`` a training row must lie at least the embargo away from the
    test block.  With them the time a label spans (``start`` .. ``start + holding``) must not
    meet the time the test block spans, widened by the embargo after it.
    """
    rows = assign_folds(samples, k, by, pos).withColumn(
        "embargo", embargo_size(F.col("n_samples"), embargo_pct)
    )
    wide = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    is_test = F.col("fold_of") == F.col("fold")
    if start is None or holding is None:
        n = F.col("n_samples")
        first, after = _fold_start(F.col("fold"), n, k), _fold_start(F.col("fold") + 1, n, k)
        clear = (F.col(pos) < first - F.col("embargo")) | (F.col(pos) >= after + F.col("embargo"))
        role = F.when(is_test, F.lit("test")).when(clear, F.lit("train"))
        return wide.withColumn("role", role).filter(F.col("role").isNotNull())
    ends = F.col(start) + F.col(holding)
    spans = rows.groupBy(*by, F.col("fold_of").alias("fold")).agg(
        F.min(start).alias("_from"), F.max(ends).alias("_to")
    )
    joined = with_key_row(wide, spans, [*by, "fold"], [pos])
    overlap = (F.col(start) <= F.col("_to") + F.col("embargo")) & (ends >= F.col("_from"))
    role = F.when(is_test, F.lit("test")).when(~overlap, F.lit("train"))
    return joined.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_from", "_to")


def purged_tail(
    samples: DataFrame, parts: int = 5, by: Sequence[str] = ("symbol",), pos: str = "pos",
    start: str = "bar_idx", holding: str = "holding_bars",
) -> DataFrame:
    """Role ``validation`` for the last of ``parts`` stretches of positions of each key, ``train`` for rows before it.

    A row whose label (``start`` .. ``start + holding``) reaches the first start of the tail is left out.  A key's last row
    is always validation; positions may have gaps; a null holding counts as 0.
    """
    keys = list(by)
    span = F.max(pos) - F.min(pos) + 1
    cut = (F.max(pos) - F.greatest(F.floor(span / parts).cast("long"), F.lit(1)) + 1).alias("_cut")
    cuts = samples.groupBy(*keys).agg(cut)
    rows = with_key_row(samples, cuts, keys, [pos])
    in_tail = F.col(pos) >= F.col("_cut")
    firsts = rows.filter(in_tail).groupBy(*keys).agg(F.min(start).alias("_first"))
    rows = with_key_row(rows, firsts, keys, [pos])
    before = F.col(start) + F.coalesce(F.col(holding), F.lit(0)) < F.col("_first")
    role = F.when(in_tail, F.lit("validation")).when(before, F.lit("train"))
    return rows.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_cut", "_first")


#: Combinations a word of a role bitmap holds.
WORD = 63


def _words(k: int, n_test: int) -> list[list[tuple[int, int, tuple[int, ...]]]]:
    """(combination, mask, test folds) by word."""
    combos = [(i, 1 << i % WORD, c) for i, c in enumerate(combination_folds(k, n_test))]
    return [combos[i:i + WORD] for i in range(0, len(combos), WORD)]


def cpcv_roles(
    samples: DataFrame, k: int = 6, n_test: int = 2, by: Sequence[str] = ("symbol",), pos: str = "pos",
    embargo_pct: float = 0.01, start: str | None = None, holding: str | None = None,
) -> DataFrame:
    """Combinatorial folds, one row per sample: every choice of ``n_test`` test folds, purged around each block.

    ``test_bits`` and ``train_bits`` are words of 63 combinations with a bit set where the sample has the role;
    purged samples have neither.  A row does not grow with the number of combinations but by these words;
    :func:`read_combination` gives the rows one model reads, :func:`cpcv` the expanded table.
    """
    rows = assign_folds(samples, k, by, pos).withColumn(
        "embargo", embargo_size(F.col("n_samples"), embargo_pct)
    )
    n, p, e = F.col("n_samples"), F.col(pos), F.col("embargo")
    if start is None or holding is None:
        def is_near(f: int) -> Column:
            return (p >= _fold_start(F.lit(f), n, k) - e) & (p < _fold_start(F.lit(f + 1), n, k) + e)
    else:
        ends = F.col(start) + F.col(holding)
        spans = rows.groupBy(*by, F.col("fold_of").cast("int").alias("_f")).agg(
            F.min(start).alias("_from"), F.max(ends).alias("_to")
        )
        per_key = spans.groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("_f", F.struct("_from", "_to")))).alias("_spans")
        )
        rows = with_key_row(rows, per_key, by, [pos])

        def is_near(f: int) -> Column:
            # A key with fewer samples than folds has empty folds, which nothing lies near to.
            span = F.try_element_at("_spans", F.lit(f))
            return F.coalesce((F.col(start) <= span["_to"] + e) & (ends >= span["_from"]), F.lit(False))

    near = F.filter(F.array(*[F.when(is_near(f), F.lit(f)) for f in range(k)]), lambda f: f.isNotNull())
    marked = rows.withColumn("_near", near)
    own = F.array(F.col("fold_of").cast("int"))

    def bits(word, has_role) -> Column:
        choices = F.array(*[F.struct(
            F.lit(mask).cast("long").alias("mask"), F.array(*[F.lit(f) for f in folds]).alias("folds")
        ) for _, mask, folds in word])
        return F.aggregate(
            F.filter(choices, lambda c: has_role(c["folds"])), F.lit(0).cast("long"),
            lambda acc, c: acc.bitwiseOR(c["mask"]),
        )

    words = _words(k, n_test)
    return marked.withColumns(
        {
            "test_bits": F.array(*[bits(w, lambda folds: F.arrays_overlap(folds, own)) for w in words]),
            "train_bits": F.array(*[
                bits(w, lambda folds: ~F.arrays_overlap(folds, own) & ~F.arrays_overlap(folds, F.col("_near")))
                for w in words
            ]),
        }
    ).drop("_near", "_spans")


def read_combination(roles: DataFrame, combo: int) -> DataFrame:
    """Rows of one combination with their ``role``; purged samples are left out."""
    def has(bits: str) -> Column:
        return F.get(bits, F.lit(combo // WORD)).bitwiseAND(F.lit(1 << combo % WORD).cast("long")) != 0

    role = F.when(has("test_bits"), F.lit("test")).when(has("train_bits"), F.lit("train"))
    return roles.withColumns({"combo": F.lit(combo), "role": role}).filter(
        F.col("role").isNotNull()
    ).drop("test_bits", "train_bits")


def cpcv(
    samples: DataFrame, k: int = 6, n_test: int = 2, by: Sequence[str] = ("symbol",), pos: str = "pos",
    embargo_pct: float = 0.01, start: str | None = None, holding: str | None = None,
) -> DataFrame:
    """:func:`cpcv_roles` expanded to rows (combination, sample, role) with the test ``folds``."""
    roles = cpcv_roles(samples, k, n_test, by, pos, embargo_pct, start, holding)
    choices = F.array(*[
        F.struct(
            F.lit(i).alias("combo"), F.lit(w).alias("word"), F.lit(mask).cast("long").alias("mask"),
            F.array(*[F.lit(f) for f in folds]).alias("folds"),
        )
        for w, word in enumerate(_words(k, n_test)) for i, mask, folds in word
    ])

    def has(bits: str) -> Column:
        return F.get(bits, F.col("_c.word")).bitwiseAND(F.col("_c.mask")) != 0

    role = F.when(has("test_bits"), F.lit("test")).when(has("train_bits"), F.lit("train"))
    wide = roles.withColumn("_c", F.explode(choices)).withColumn("role", role)
    return wide.filter(F.col("role").isNotNull()).withColumns(
        {"combo": F.col("_c.combo"), "folds": F.col("_c.folds")}
    ).drop("_c", "test_bits", "train_bits")


def combination_folds(k: int, n_test: int) -> list[tuple[int, ...]]:
    """Test folds of each combination, in the order of ``combo``."""
    return list(combinations(range(k), n_test))
