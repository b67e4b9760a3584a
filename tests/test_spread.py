"""Per-key statistics, score slices and role bitmaps spread a hot key over tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickspark import schema
from tickspark.layout import Layout
from tickspark.operators import clean, cv, metrics
from tickspark.operators.asof import asof_join
from tickspark.operators.index import SLICE, exact_quantiles, mass_slices
from tickspark.operators.joins import with_key_row
from tickspark.operators.scan import last_known


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_key_rows(spark):
    rows = spark.createDataFrame([("A", 1), ("A", 2), (None, 3), ("B", None), ("C", 5)], "symbol string, x int")
    stats = spark.createDataFrame([("A", 10), ("B", 20)], "symbol string, s int")
    got = sorted(map(tuple, with_key_row(rows, stats, ["symbol"], ["x"]).select("symbol", "x", "s").collect()), key=str)
    assert got == [("A", 1, 10), ("A", 2, 10), ("B", None, 20)]
    left = with_key_row(rows, stats, ["symbol"], ["x"], "left")
    assert left.count() == 5 and left.filter("s is null").count() == 2
    assert with_key_row(rows, stats.limit(0), ["symbol"], ["x"]).count() == 0


def test_one_symbol_is_not_one_join_task(spark, no_broadcast):
    ticks = spark.range(1000).select(
        F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"),
        (100 + F.sin("id")).alias("bid"), (100.1 + F.sin("id")).alias("ask"),
    )
    plan = clean.drop_outliers(ticks)._jdf.queryExecution().optimizedPlan().toString()
    assert "_place" in plan
    rows = with_key_row(ticks, ticks.groupBy("symbol").agg(F.max("bid").alias("m")), ["symbol"], ["seq"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1


def test_crowded_values_use_all_parts(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([0.5 + rng.random(20_000) * 1e-3, rng.random(200) * 1e6, [0.25] * 50])
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "x": x})).unionByName(
        spark.createDataFrame([("A", None), ("B", 1.0)], "symbol string, x double")
    )
    out = mass_slices(df, ["symbol"], "x").toPandas()
    own = out[(out.symbol == "A") & out.x.notna()].sort_values("x")
    parts = own[SLICE].to_numpy()
    assert (np.diff(parts) >= 0).all() and len(out) == len(x) + 2 and out[SLICE].isna().sum() == 1
    sizes = own[own.x != 0.25].groupby(SLICE).size()
    assert len(sizes) > 3000 and sizes.max() < 40
    assert own.groupby("x")[SLICE].nunique().max() == 1
    got = exact_quantiles(df, ["symbol"], "x", [0.1, 0.5, 0.99]).filter("symbol = 'A'").orderBy("q").collect()
    assert [r["value"] for r in got] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.99]).tolist(), abs=1e-12)


def test_auc_of_close_scores(spark):
    rng = np.random.default_rng(4)
    score = 0.7 + rng.integers(0, 300, 2000) * 1e-7
    y = (rng.random(2000) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "score": score, "y": y, "weight": 1.0}))
    got = metrics.ranking_metrics(df, ["k"]).first()
    pos, neg = score[y == 1], score[y == 0]
    pairs = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert got["roc_auc"] == pytest.approx(pairs / (len(pos) * len(neg)), abs=1e-9)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_after_the_last_right_row(spark, strict):
    t = [0, 10, 86_400, 86_405, 5 * 86_400, 9 * 86_400, 9 * 86_400 + 1]
    left = spark.createDataFrame([("A", x) for x in t] + [("B", 7), ("A", None)], "symbol string, s long")
    right = spark.createDataFrame([("A", 10, 1.0), ("A", 86_405, 2.0), ("C", 3, 9.0)], "symbol string, s long, v double")
    at = F.timestamp_seconds("s")
    out = asof_join(
        left.withColumn("lt", at), right.withColumn("rt", at).drop("s"), "lt", "rt", ["v"], strict=strict
    )
    got = {(r["symbol"], r["s"]): r["v"] for r in out.collect()}
    tie = (None, 1.0) if strict else (1.0, 2.0)
    assert got == {
        ("A", 0): None, ("A", 10): tie[0], ("A", 86_400): 1.0, ("A", 86_405): tie[1], ("A", 5 * 86_400): 2.0,
        ("A", 9 * 86_400): 2.0, ("A", 9 * 86_400 + 1): 2.0, ("B", 7): None, ("A", None): None,
    }


def test_role_bitmaps(spark):
    n, k, n_test = 60, 9, 3
    samples = spark.range(n).select(
        F.lit("A").alias("symbol"), F.col("id").alias("pos"), F.col("id").alias("t"), F.lit(2).alias("hold")
    )
    roles = cv.cpcv_roles(samples, k, n_test, start="t", holding="hold").cache()
    assert roles.count() == n and roles.first()["test_bits"].__len__() == 2
    wide = cv.cpcv(samples, k, n_test, start="t", holding="hold").select("pos", "combo", "role").toPandas()
    edges = np.array_split(np.arange(n), k)
    for combo in (0, 62, 63, 83):
        folds = cv.combination_folds(k, n_test)[combo]
        want = {}
        for pos in range(n):
            if any(pos in edges[f] for f in folds):
                want[pos] = "test"
            elif not any(pos <= edges[f][-1] + 2 + 1 and pos + 2 >= edges[f][0] for f in folds):
                want[pos] = "train"
        read = {r["pos"]: r["role"] for r in cv.read_combination(roles, combo).collect()}
        part = wide[wide.combo == combo]
        assert read == want == dict(zip(part.pos, part.role))
    roles.unpersist()
    few = samples.limit(2)
    assert cv.cpcv(few, 6, 2, start="t", holding="hold").filter("role = 'test'").count() == 10


def test_sample_does_not_depend_on_the_layout(spark):
    df = spark.range(5000).select(F.col("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("b"))
    picked = [
        sorted(r["a"] for r in clean.sample(d, 500, seed=7, on=("a", "b")).collect())
        for d in (df, df.repartition(13, "b"))
    ]
    assert picked[0] == picked[1] and 400 < len(picked[0]) < 600
    other = {r["a"] for r in clean.sample(df, 500, seed=8, on=("a", "b")).collect()}
    assert other != set(picked[0])
    assert clean.sample(df, 9000, on=("a",)).count() == 5000 and clean.sample(df.limit(0), 5, on=("a",)).count() == 0


def test_table_hash_sees_names_types_and_order(spark):
    base = spark.sql("select 1.0d as log_return, 2.0d as vpin, 'x' as symbol")
    same = base.withColumn("note", F.lit(1))
    assert schema.table_hash(base) == schema.table_hash(same)
    others = [
        base.select("vpin", "log_return"), base.drop("vpin"), base.withColumn("vpin", F.col("vpin").cast("float")),
    ]
    assert len({schema.table_hash(d) for d in [base, *others]}) == 4


@pytest.mark.parametrize("before", [False, True])
def test_last_known_across_blocks(spark, before):
    rng = np.random.default_rng(6)
    pdf = pd.concat([
        pd.DataFrame({"symbol": k, "bar_idx": np.arange(n), "x": np.where(rng.random(n) < 0.1, rng.random(n), np.nan)})
        for k, n in (("A", 300), ("B", 7), ("C", 40))
    ])
    pdf.loc[pdf.symbol == "C", "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    out = last_known(df, {"x": "y"}, Layout(block_rows=16), before)
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    want = pdf.sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    filled = want.groupby("symbol").x.transform(lambda s: s.ffill().shift() if before else s.ffill())
    assert list(got.columns) == ["symbol", "bar_idx", "x", "y"]
    assert np.array_equal(got.y.astype(float), filled.astype(float), equal_nan=True)
    assert last_known(df.limit(0), {"x": "y"}).count() == 0


def test_best_price_of_positions_over_blocks(spark, monkeypatch):
    """The best price along lives over many blocks equals the window per position, and joined rows are not shuffled again."""
    from pyspark.sql import functions as F

    from tickspark.operators import joins, risk

    monkeypatch.setattr(joins, "LIFE_BLOCK", 8)
    monkeypatch.setattr(joins, "LIFE_TASKS", 4)
    i = F.col("id")
    ticks = spark.range(100).select(
        F.lit("A").alias("symbol"), i.alias("row_idx"), F.timestamp_seconds(i).alias("ts"),
        (100 + (i * 37) % 23).cast("double").alias("bid"), (101 + (i * 53) % 29).cast("double").alias("ask"),
    )
    held = spark.range(60).select(
        F.lit("A").alias("symbol"), i.alias("ticket"), F.when(i % 2 == 0, 1).otherwise(-1).alias("direction"),
        F.lit(100.0).alias("entry_price"), F.lit(0.1).alias("lots"), (i * 2 - 1).alias("start_row"),
        F.when(i % 5 > 0, i * 2 + i % 5 * 9).alias("close_row"),
    )
    marked = risk.mark_positions(joins.positions_on_ticks(held, ticks, best=True))
    plain = risk.mark_positions(joins.positions_on_ticks(held, ticks))
    keys = ["ticket", "row_idx", "best_price", "net_pnl_usd"]
    got, want = (sorted(map(tuple, df.select(*keys).collect())) for df in (marked, plain))
    assert got == want and len(got) > 1000
    # Above the joins stand no exchange: the last operators of both branches are the join and, for the first block, its window.
    plan = marked.select(*keys)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]


def test_marks_come_out_tick_by_tick(spark, monkeypatch):
    """Written marks take less room when the rows of a tick, and so its index and price, lie together."""
    from pyspark.sql import functions as F

    from tickspark.operators import joins

    monkeypatch.setattr(joins, "LIFE_BLOCK", 16)
    monkeypatch.setattr(joins, "LIFE_TASKS", 1)
    i = F.col("id")
    ticks = spark.range(200).select(
        F.lit("A").alias("symbol"), i.alias("row_idx"), F.timestamp_seconds(i).alias("ts"),
        (100 + i % 13).cast("double").alias("bid"), (101 + i % 13).cast("double").alias("ask"),
    )
    held = spark.range(20).select(
        F.lit("A").alias("symbol"), i.alias("ticket"), F.when(i % 2 == 0, 1).otherwise(-1).alias("direction"),
        (i * 3 - 1).alias("start_row"), F.when(i % 4 > 0, i * 3 + 90).alias("close_row"),
    )
    for best in (False, True):
        rows = joins.positions_on_ticks(held, ticks, best=best).select("row_idx", "start_row").collect()
        # With the best price, a position walks the block of its opening alone.
        at = [r.row_idx for r in rows if not best or r.row_idx // 16 > (r.start_row + 1) // 16]
        assert len(at) > 1500
        assert sum(a != b for a, b in zip(at, at[1:])) + 1 == len(set(at))


def test_blocks_of_ticks_are_small(spark):
    """A worker holds a block of a tick scan several times over, so a long series must make many blocks."""
    from pyspark.sql import functions as F

    from tickspark.layout import BLOCK, TICKS, with_blocks

    rows = spark.range(200_000).select(F.lit("A").alias("symbol"), F.col("id").alias("row_idx"))
    sizes = [r["count"] for r in with_blocks(rows, 0, 0, TICKS).groupBy("symbol", BLOCK).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 65_536
