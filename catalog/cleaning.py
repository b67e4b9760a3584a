"""Sources, sinks, cleaning and profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.base import DIRTY, TICKS, dirty_ticks, query, table, ticks
from tickspark.functions.timeparse import parse_ts
from tickspark.operators import clean, profile
from tickspark.operators.bars import with_mid_spread
from tickspark.session import scratch_path
from tickspark.sources import tables
from tickspark.sources import ticks as src


@query(
    "S1_read_ticks", "symbol:s ts:t bid:f ask:f last_volume:f",
    f"with {DIRTY} select * from dirty where ts is not null",
)
def _(spark, sf):
    """CSV in the second export layout: other names, text times, rows without a time."""
    t = dirty_ticks(spark, sf)
    text = t.select(
        "symbol", F.date_format("ts", "yyyy.MM.dd HH:mm:ss.SSSSSS").alias("Time (EET)"),
        F.col("ask").alias("Ask"), F.col("bid").alias("Bid"), F.col("last_volume").alias("Volume"),
    )
    path = scratch_path(spark, "ticks-csv")
    text.write.option("header", True).csv(path)
    return src.read_ticks(spark, path, fmt="csv")


@query(
    "S2_parse_ts", "seq:i parsed:t",
    f"""with {TICKS} select seq, case seq % 4 when 0 then make_timestamp((epoch_us(ts) // 1000) * 1000)
      when 1 then make_timestamp((epoch_us(ts) // 1000) * 1000)
      when 2 then make_timestamp((epoch_us(ts) // 1000000) * 1000000) else null end as parsed from ticks""",
)
def _(spark, sf):
    t = ticks(spark, sf)
    kind = F.col("seq") % 4
    text = (
        F.when(kind == 0, F.floor(F.unix_micros("ts") / 1000).cast("string"))
        .when(kind == 1, F.date_format("ts", "yyyy.MM.dd HH:mm:ss.SSS"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.lit("not a time"))
    )
    return t.select("seq", parse_ts(text).alias("parsed"))


@query("S3_detect_columns", "field:s column_name:s n:i",
       """select 'time' as field, 'Time (EET)' as column_name, count(ts) as n from events union all
          select 'bid', 'Bid', count(value) from events union all select 'ask', 'Ask', count(value) from events""")
def _(spark, sf):
    t = ticks(spark, sf).withColumnsRenamed({"ts": "Time (EET)", "bid": "Bid", "ask": "Ask"})
    found = {k: v for k, v in src.detect_columns(t).items() if v}
    filled = t.agg(*[F.count(F.col(f"`{v}`")).alias(k) for k, v in found.items()])
    rows = F.array(*[
        F.struct(F.lit(k).alias("field"), F.lit(v).alias("column_name"), F.col(k).alias("n"))
        for k, v in found.items()
    ])
    return filled.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "S4_last_days", "symbol:s seq:i ts:t",
    f"""with {TICKS} select symbol, seq, ts from ticks
      where ts >= (select max(ts) from ticks) - interval 7 days""",
)
def _(spark, sf):
    return src.last_days(ticks(spark, sf), 7)


@query("S5_head", "seq:i bid:f", f"with {TICKS} select seq, bid from ticks order by ts, seq limit 500")
def _(spark, sf):
    return src.head(ticks(spark, sf), 500)


@query(
    "S5_most_recent", "seq:i bid:f",
    f"with {TICKS} select seq, bid from ticks order by ts desc, seq desc limit 500",
)
def _(spark, sf):
    return src.most_recent(ticks(spark, sf), 500)


@query("S6_convert", "compression:s n_rows:i",
       "select unnest(['snappy', 'gzip', 'zstd', 'none']) as compression, (select count(*) from events) as n_rows")
def _(spark, sf):
    t = ticks(spark, sf)
    reports = [tables.convert(t, scratch_path(spark, f"conv-{c}"), c) for c in tables.CODECS]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


@query(
    "S7_finalize_ticks", "timestamp_us:i bid:f ask:f mid:f spread:f bidvolume:f",
    f"""with {TICKS} select epoch_us(ts) as timestamp_us, bid, ask, (bid + ask) / 2 as mid,
      ask - bid as spread, last_volume as bidvolume from ticks""",
)
def _(spark, sf):
    t = ticks(spark, sf).withColumn("BidVolume", F.col("last_volume").cast("string"))
    return src.finalize_ticks(with_mid_spread(t))


@query(
    "S8_read_bars", "symbol:s open_time:t open:f high:f low:f close:f tick_volume:i",
    f"""with {TICKS} select symbol, date_trunc('day', ts)::timestamp as open_time,
      round(arg_min((bid + ask) / 2, ts), 4) as open, round(max((bid + ask) / 2), 4) as high,
      round(min((bid + ask) / 2), 4) as low, round(arg_max((bid + ask) / 2, ts), 4) as close,
      count(*) as tick_volume from ticks group by 1, 2""",
)
def _(spark, sf):
    t = with_mid_spread(ticks(spark, sf))
    day = F.date_trunc("day", "ts")
    hist = t.groupBy("symbol", F.date_format(day, "yyyy.MM.dd HH:mm:ss").alias("time")).agg(
        F.round(F.min_by("mid", "ts"), 4).alias("open"), F.round(F.max("mid"), 4).alias("high"),
        F.round(F.min("mid"), 4).alias("low"), F.round(F.max_by("mid", "ts"), 4).alias("close"),
        F.count(F.lit(1)).alias("tick_volume"), F.lit(0.0).alias("spread"),
        F.lit(0.0).alias("real_volume"),
    )
    path = scratch_path(spark, "ohlc-csv")
    # One folder of bars per symbol, as such histories come.
    hist.write.partitionBy("symbol").option("header", True).csv(path)
    names = [r["symbol"] for r in table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct().collect()]
    return reduce(lambda a, b: a.unionByName(b), [src.read_bars(spark, f"{path}/symbol={s}", s) for s in sorted(names)])


def _tick_files(spark, sf) -> str:
    """The tick view as files in the streaming layout."""
    path = scratch_path(spark, "tick-files")
    ticks(spark, sf).write.parquet(path)
    return path


@query(
    "S9_stream_ticks", "symbol:s seq:i ts:t bid:f ask:f",
    f"with {TICKS} select * from ticks",
)
def _(spark, sf):
    stream = src.stream_ticks(spark, _tick_files(spark, sf), max_files_per_trigger=4)
    out, ckpt = scratch_path(spark, "s9"), scratch_path(spark, "s9-ckpt")
    query_ = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return spark.read.schema(src.TICK_FILE_SCHEMA).parquet(out)


@query(
    "S10_write_facts", "table_name:s symbol:s n:i total:f",
    f"""with {TICKS} select 'raw_ticks' as table_name, symbol, count(*) as n, sum((bid + ask) / 2) as total
      from ticks group by symbol union all
      select 'positions_state', symbol, count(*), sum(bid) from ticks group by symbol""",
)
def _(spark, sf):
    stream = src.stream_ticks(spark, _tick_files(spark, sf))
    root, ckpt = scratch_path(spark, "facts"), scratch_path(spark, "facts-ckpt")
    builders = {
        "raw_ticks": tables.tick_facts,
        "positions_state": lambda b: b.select(F.col("ts").alias("time"), "symbol", "bid"),
        "fills": lambda b: b.select(F.col("ts").alias("time"), "symbol", "ask"),
    }
    tables.write_facts(stream, root, ckpt, builders, enabled={"fills": False}).awaitTermination()
    out = None
    for name, value in (("raw_ticks", "mid"), ("positions_state", "bid")):
        part = spark.read.parquet(f"{root}/{name}").groupBy("symbol").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "S11_tick_facts", "symbol:s bid:f ask:f mid:f spread:f volume:f",
    f"""with {DIRTY} select symbol, bid, ask,
      case when bid > 0 and ask > 0 then (bid + ask) / 2 else 0 end as mid,
      case when bid > 0 and ask > 0 then ask - bid else 0 end as spread,
      last_volume as volume from dirty""",
)
def _(spark, sf):
    return tables.tick_facts(dirty_ticks(spark, sf))


@query("S12_bounded_intake", "batches:i n:i", "select 6 // 2 as batches, count(*) as n from events")
def _(spark, sf):
    path = scratch_path(spark, "small-files")
    ticks(spark, sf).repartition(6, "seq").write.parquet(path)
    stream = src.stream_ticks(spark, path, max_files_per_trigger=2)
    out, ckpt = scratch_path(spark, "s12"), scratch_path(spark, "s12-ckpt")
    def sink(batch, batch_id):
        batch.select(F.lit(batch_id).alias("batch"), "seq").write.mode("append").parquet(out)
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).agg(
        F.count_distinct("batch").alias("batches"), F.count(F.lit(1)).alias("n")
    )


def _snapshots(spark, sf):
    """Runtime snapshots: one per event, from the event rows."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("symbol"),
        F.col("event_id").alias("ticks_total"),
        F.least(F.lit(1.0), F.col("event_id") / F.lit(500.0)).alias("warmup_progress"),
        (F.col("user_id") % 3).cast("int").alias("open_positions"),
    )


@query("S13_write_runtime", "time:t symbol:s ticks_total:i warmup_progress:f",
       """select ts as time, event_type as symbol, event_id as ticks_total,
          least(1.0, event_id / 500.0) as warmup_progress from events""")
def _(spark, sf):
    snaps = _snapshots(spark, sf)
    src_path = scratch_path(spark, "snap-in")
    snaps.write.parquet(src_path)
    stream = spark.readStream.schema(snaps.schema).parquet(src_path)
    out = scratch_path(spark, "snap")
    tables.write_runtime(stream, out, scratch_path(spark, "snap-ckpt")).awaitTermination()
    return spark.read.schema(snaps.schema).parquet(out)


@query("S14_runtime_history", "time:t symbol:s ticks_total:i",
       """select ts as time, event_type as symbol, event_id as ticks_total from events
          order by ts desc, event_type desc limit 200 offset 50""")
def _(spark, sf):
    return tables.runtime_history(_snapshots(spark, sf), limit=200, offset=50)


@query("S15_migrate_epoch", "ticks_total:i time:t",
       """select event_id as ticks_total, make_timestamp((epoch_us(ts) // 1000) * 1000) as time from events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    old = e.select(
        F.col("event_id").alias("ticks_total"),
        (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) / 1000.0).alias("ts"),
    )
    return tables.migrate_epoch(old)


@query("S16_save_load", "symbol:s n:i total:f",
       f"with {TICKS} select symbol, count(*) as n, sum(bid) as total from ticks group by symbol")
def _(spark, sf):
    t = ticks(spark, sf)
    path = scratch_path(spark, "saved")
    tables.save_table(t, path, "json")
    back = tables.load_table(spark, path, "json", t.schema)
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("bid").alias("total"))


# ---------------------------------------------------------------- cleaning

@query("C1_mid_spread", "seq:i mid:f spread:f",
       f"with {TICKS} select seq, (bid + ask) / 2 as mid, ask - bid as spread from ticks")
def _(spark, sf):
    return with_mid_spread(ticks(spark, sf))


@query("C2_valid_quotes", "seq:i bid:f ask:f",
       f"with {DIRTY} select seq, bid, ask from dirty where bid > 0 and ask > 0")
def _(spark, sf):
    return clean.valid_quotes(dirty_ticks(spark, sf))


@query("C3_positive_spread", "seq:i bid:f ask:f",
       f"with {DIRTY} select seq, bid, ask from dirty where ask - bid > 0")
def _(spark, sf):
    return clean.positive_spread(dirty_ticks(spark, sf))


RETURNS = """, ret as (
  select *, (bid + ask) / 2 as mid,
         (bid + ask) / 2 - lag((bid + ask) / 2) over (partition by symbol order by ts, seq) as r
  from dirty where ts is not null)"""


@query("C4_tick_returns", "symbol:s seq:i tick_return:f",
       f"with {DIRTY}{RETURNS} select symbol, seq, r as tick_return from ret")
def _(spark, sf):
    return clean.tick_returns(dirty_ticks(spark, sf).filter("ts is not null"))


@query("C5_drop_outliers", "symbol:s seq:i mid:f",
       f"""with {DIRTY}{RETURNS}, lim as (select symbol, 3 * stddev_samp(r) as k from ret group by symbol)
       select ret.symbol, seq, mid from ret join lim using (symbol) where r is null or abs(r) <= k""")
def _(spark, sf):
    return clean.drop_outliers(dirty_ticks(spark, sf).filter("ts is not null"), k=3.0)


@query("C6_null_profile", "column_name:s null_count:i null_pct:f",
       f"""with {DIRTY}, n as (select count(*) as n, count(*) - count(ts) as nts from dirty)
       select c as column_name, case when c = 'ts' then nts else 0 end as null_count,
              case when c = 'ts' then nts / n * 100 else 0 end as null_pct
       from n, unnest(['symbol', 'ts', 'seq', 'bid', 'ask', 'last_volume']) as u(c)""")
def _(spark, sf):
    return profile.null_profile(dirty_ticks(spark, sf))


@query("C7_zero_profile", "symbol:s zero_bid:i zero_ask:i",
       f"""with {DIRTY} select symbol, count(*) filter (where bid = 0) as zero_bid,
       count(*) filter (where ask = 0) as zero_ask from dirty group by symbol""")
def _(spark, sf):
    return profile.zero_profile(dirty_ticks(spark, sf))


@query("C8_price_profile",
       "symbol:s price_min:f price_max:f price_mean:f price_std:f price_range:f bid_min:f ask_max:f",
       f"""with {TICKS}, m as (select *, (bid + ask) / 2 as mid from ticks)
       select symbol, min(mid) as price_min, max(mid) as price_max, avg(mid) as price_mean,
       stddev_samp(mid) as price_std, max(mid) - min(mid) as price_range, min(bid) as bid_min,
       max(ask) as ask_max from m group by symbol""")
def _(spark, sf):
    return profile.price_profile(ticks(spark, sf))


@query("C9_spread_profile",
       "symbol:s spread_min:f spread_max:f spread_mean:f spread_std:f negative_count:i "
       "spread_pips:f negative_pct:f wide_count:i wide_pct:f",
       f"""with {DIRTY}, s as (select symbol, ask - bid as spread from dirty),
       st as (select symbol, count(*) as n, min(spread) as spread_min, max(spread) as spread_max,
         avg(spread) as spread_mean, stddev_samp(spread) as spread_std,
         count(*) filter (where spread < 0) as negative_count from s group by symbol),
       wd as (select symbol, count(*) filter (where spread > spread_mean + 5 * spread_std) as wide_count
         from s join st using (symbol) group by symbol)
       select st.*, wide_count, spread_mean / 0.01 as spread_pips, negative_count / n * 100 as negative_pct,
         wide_count / n * 100 as wide_pct from st join wd using (symbol)""")
def _(spark, sf):
    return profile.spread_profile(dirty_ticks(spark, sf))


@query("C10_return_profile",
       "symbol:s n_returns:i return_mean:f return_std:f return_min:f return_max:f zero_pct:f large_moves:i",
       f"""with {DIRTY}{RETURNS}, st as (select symbol, count(r) as n_returns, avg(r) as return_mean,
         stddev_samp(r) as return_std, min(r) as return_min, max(r) as return_max,
         count(*) filter (where r = 0) / count(r) * 100 as zero_pct from ret group by symbol),
       lm as (select symbol, count(*) filter (where abs(r) > 10 * return_std) as large_moves
         from ret join st using (symbol) group by symbol)
       select * from st join lm using (symbol)""")
def _(spark, sf):
    return profile.return_profile(dirty_ticks(spark, sf).filter("ts is not null"))


@query("C11_volume_profile",
       "symbol:s volume_min:f volume_max:f volume_mean:f volume_std:f zero_volume:i "
       "zero_volume_pct:f volume_note:s",
       f"""with {DIRTY}, st as (select symbol, count(*) as n, min(last_volume) as volume_min,
         max(last_volume) as volume_max, avg(last_volume) as volume_mean,
         stddev_samp(last_volume) as volume_std,
         count(*) filter (where last_volume = 0) as zero_volume from dirty group by symbol)
       select *, zero_volume / n * 100 as zero_volume_pct, case when zero_volume / n * 100 > 90
         then 'mostly zero' when volume_std < 0.0001 then 'low variance' else 'ok' end as volume_note from st""")
def _(spark, sf):
    return profile.volume_profile(dirty_ticks(spark, sf))


@query("C12_rate_profile",
       "symbol:s first_time:t last_time:t n:i span_days:f ticks_per_second:f ticks_per_minute:f",
       f"""with {TICKS}, st as (select symbol, min(ts) as first_time, max(ts) as last_time, count(*) as n,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as sec from ticks group by symbol)
       select *, sec / 86400 as span_days, n / sec as ticks_per_second, n / sec * 60 as ticks_per_minute from st""")
def _(spark, sf):
    return profile.rate_profile(ticks(spark, sf))


ERRORS = """, arr as (
  select symbol, seq, ts, epoch_us(ts) / 1000.0
         - lag(epoch_us(ts) / 1000.0) over (partition by symbol order by seq) as step_ms
  from dirty where ts is not null), err as (
  select *, case when step_ms < -1000 then 'NON_MONOTONIC' when step_ms > 5400000 then 'GAP' end as error
  from arr)"""


@query("C13_feed_errors", "symbol:s seq:i step_ms:f error:s",
       f"with {DIRTY}{ERRORS} select * from err where error is not null")
def _(spark, sf):
    return profile.feed_errors(dirty_ticks(spark, sf), gap_ms=5_400_000)


@query("C13_feed_integrity", "symbol:s gaps:i non_monotonic:i errors:i aborted:b",
       f"""with {DIRTY}{ERRORS}, e as (select * from err where error is not null),
       n as (select *, row_number() over (partition by symbol order by seq) as k from e)
       select symbol, count(*) filter (where error = 'GAP') as gaps,
       count(*) filter (where error = 'NON_MONOTONIC') as non_monotonic, count(*) as errors,
       coalesce(max(case when error = 'NON_MONOTONIC' then k end) > 10, false) as aborted
       from n group by symbol""")
def _(spark, sf):
    return profile.feed_integrity(dirty_ticks(spark, sf), gap_ms=5_400_000)


@query("C14_quality_report", "symbol:s n:i issues:s is_good:b size_class:s",
       f"""with {DIRTY}{RETURNS}, sd as (select symbol, stddev_samp(r) as s,
         count(*) filter (where r = 0) / count(r) * 100 as z from ret group by symbol),
       lg as (select symbol, count(*) filter (where abs(r) > 10 * s) as l, max(z) as z
         from ret join sd using (symbol) group by symbol),
       b as (select symbol, count(*) as n, count(*) filter (where ts is null) as nulls,
         count(*) filter (where ask < bid) as neg from dirty group by symbol),
       i as (select symbol, n, list_filter([case when nulls > 0 then 'missing values' end,
         case when neg > 0 then 'negative spreads' end, case when z > 50 then 'many zero returns' end,
         case when l > 100 then 'many large moves' end], lambda x: x is not null) as li
         from b join lg using (symbol))
       select symbol, n, array_to_string(li, '; ') as issues, len(li) = 0 as is_good,
         case when n < 100000 then 'small' when n < 1000000 then 'medium' else 'large' end as size_class from i""")
def _(spark, sf):
    return profile.quality_report(dirty_ticks(spark, sf))


@query("C15_sample", "symbol:s seq:i",
       f"""with {TICKS}, f as (select least(1.0, 1000.0::double / count(*)) as share from ticks)
       select symbol, seq from ticks, f where share = 1 or
         substr(md5('42|' || symbol || '|' || seq), 1, 13) < printf('%013x', cast(floor(share * 4503599627370496) as bigint))""")
def _(spark, sf):
    return clean.sample(ticks(spark, sf), 1000, seed=42, on=("symbol", "seq"))


@query("C16_is_valid", "symbol:s bar_idx:i is_valid:b",
       """with e as (select event_type as symbol, event_id as bar_idx,
         case when event_id % 7 = 0 then 'nan'::double when event_id % 11 = 0 then 'inf'::double
              else value end as x from events)
       select symbol, bar_idx, not (isnan(x) or isinf(x)) as is_valid from e""")
def _(spark, sf):
    e = table(spark, sf, "events")
    x = (F.when(F.col("event_id") % 7 == 0, F.lit(float("nan")))
         .when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    rows = e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("bar_idx"),
                    x.alias("x"), F.col("value"))
    return clean.with_is_valid(rows, ["x", "value"])

