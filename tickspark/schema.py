"""The feature table: names, types, defaults and valid ranges, and checks derived from them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """One feature of the table."""

    name: str
    category: str
    low: float
    high: float
    dtype: str = "float32"
    history: int = 1
    default: float = 0.0


# The features in table order with category, valid range, type and history in bars.
_SPECS = """
log_return               price           -0.1     0.1
log_return_zscore        price           -5       5
spread_bps               price            0       100
delta_t_log              microstructure  -10      10
tick_intensity           microstructure   0       100
ofi_count                microstructure  -1000    1000    float32  20
ofi_weighted             microstructure  -100     100     float32  20
kyle_lambda_pct          microstructure   0       10      float32  50
pdi                      microstructure  -100     100
micro_volatility_pct     volatility       0       10
realized_volatility_pct  volatility       0       10      float32  20
market_temperature       thermo           0       100     float32  20
market_entropy           thermo           0       2       float32  50
ts_phase                 thermo           0       3       int32
vpin                     orderflow        0       1       float32  50
vpin_zscore              orderflow       -5       5       float32  100
trend_deviation          trend           -10      10      float32  20
trend_direction          trend           -1       1       int32
trend_duration           trend            0       1000    int32
kalman_residual_bps      kalman          -100     100
kalman_gain              kalman           0       1
wavelet_energy_1         wavelet          0       1
wavelet_energy_2         wavelet          0       1
wavelet_trend_ratio      wavelet          0       1
bullish_fvg              fvg              0       1       int32
bearish_fvg              fvg              0       1       int32
fvg_size_atr             fvg              0       10
fvg_age_bars             fvg              0       100     int32
price_to_fvg_mid         fvg             -10      10
fvg_filled_pct           fvg              0       1
active_fvg_count         fvg              0       20      int32
nearest_fvg_distance     fvg              0       20
fvg_event                fvg_event       -1       1       int32
fvg_impulse_atr          fvg_event        0       20
fvg_location_15m         fvg_event       -20      20
fvg_follow_up_3          fvg_follow       0       20
fvg_follow_dn_3          fvg_follow      -20      0
fvg_follow_bars          fvg_follow       0       100     int32
fvg_follow_net           fvg_follow      -20      20
st_trend_15m             supertrend_15m  -1       1       int32
st_distance_15m          supertrend_15m  -20      20
st_bars_since_flip_15m   supertrend_15m   0       500     int32
st_slope_15m             supertrend_15m  -5       5
st_bandwidth_15m         supertrend_15m   0       0.1
session                  time             0       4       int32
hour_of_day              time             0       23      int32
minute_of_hour           time             0       59      int32
day_of_week              time             0       6       int32
bars_from_session_open   time             0       1000    int32
is_session_open          time             0       1       int32
is_session_close         time             0       1       int32
hour_sin                 time            -1       1
hour_cos                 time            -1       1
trend_fvg_alignment      interaction     -1       1
trend_strength_x_fvg     interaction      0       100
trend_duration_x_vol     interaction      0       1000
trend_fvg_distance       interaction     -100     100
session_trend_interaction interaction    -4       4
st_alignment             interaction     -1       1
atr_ratio_1m_15m         atr              0       5
atr_1m                   atr              0       100
atr_15m                  atr              0       500
mid_15m_range            atr              0       100000
"""


def _parse(line: str) -> FeatureSpec:
    name, category, low, high, *rest = line.split()
    dtype = rest[0] if rest else "float32"
    history = int(rest[1]) if len(rest) > 1 else 1
    return FeatureSpec(name, category, float(low), float(high), dtype, history)


FEATURES: tuple[FeatureSpec, ...] = tuple(_parse(x) for x in _SPECS.strip().splitlines())
FEATURE_NAMES = [s.name for s in FEATURES]

# The features that describe how a series evolves, and those that filter events.
SEQUENCE_FEATURES = (
    "log_return", "log_return_zscore", "spread_bps", "delta_t_log", "tick_intensity", "ofi_count",
    "ofi_weighted", "kyle_lambda_pct", "pdi", "micro_volatility_pct", "realized_volatility_pct",
    "market_temperature", "market_entropy", "ts_phase", "vpin", "vpin_zscore", "trend_deviation",
    "trend_direction", "trend_duration", "fvg_event", "fvg_impulse_atr", "fvg_follow_up_3",
    "fvg_follow_dn_3", "st_distance_15m",
)
FILTER_FEATURES = (
    "st_alignment", "st_trend_15m", "fvg_location_15m", "session", "hour_of_day", "day_of_week",
    "is_session_open", "is_session_close", "atr_ratio_1m_15m", "st_bars_since_flip_15m",
)
ZSCORES = ("log_return_zscore", "vpin_zscore")
ZSCORE_LIMIT = 5.0


def feature_struct(specs: Sequence[FeatureSpec] = FEATURES) -> T.StructType:
    """Double columns in table order; the narrower types are for export only."""
    return T.StructType([T.StructField(s.name, T.DoubleType()) for s in specs])


def schema_hash(specs: Sequence[FeatureSpec] = FEATURES) -> str:
    """Short fingerprint of names, types and order."""
    content = [{"name": s.name, "dtype": s.dtype, "idx": i} for i, s in enumerate(specs)]
    return hashlib.md5(json.dumps(content, sort_keys=True).encode()).hexdigest()[:16]


def table_hash(df: DataFrame, specs: Sequence[FeatureSpec] = FEATURES) -> str:
    """Short fingerprint of the feature columns a table holds: names, stored types and order in the table."""
    names = {s.name for s in specs}
    held = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields if f.name in names]
    return hashlib.md5(",".join(held).encode()).hexdigest()[:16]


def list_hash(names: Iterable[str]) -> str:
    """Fingerprint of an ordered list of names."""
    return hashlib.md5(json.dumps(list(names)).encode()).hexdigest()[:16]


def is_compatible(a: Sequence[FeatureSpec], b: Sequence[FeatureSpec]) -> bool:
    return schema_hash(a) == schema_hash(b)


def to_json(specs: Sequence[FeatureSpec] = FEATURES) -> str:
    return json.dumps({"hash": schema_hash(specs), "features": [asdict(s) for s in specs]}, indent=1)


def from_json(text: str) -> tuple[FeatureSpec, ...]:
    """Read specs back, refusing a file whose hash does not fit its content."""
    data = json.loads(text)
    specs = tuple(FeatureSpec(**s) for s in data["features"])
    if schema_hash(specs) != data["hash"]:
        raise ValueError("feature schema hash does not match its content")
    return specs


def _present(df: DataFrame, specs: Sequence[FeatureSpec]) -> list[FeatureSpec]:
    return [s for s in specs if s.name in df.columns]


def validate_features(df: DataFrame, specs: Sequence[FeatureSpec] = FEATURES) -> DataFrame:
    """Messages for NaN, infinite and out-of-range values in ``feature_errors``."""
    def message(s: FeatureSpec) -> Column:
        x = F.col(s.name).cast("double")
        bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        return (
            F.when(bad, F.lit(f"{s.name}: not finite"))
            .when((x < s.low) | (x > s.high), F.lit(f"{s.name}: outside [{s.low:g}, {s.high:g}]"))
        )

    errors = F.array_compact(F.array(*[message(s) for s in _present(df, specs)]))
    return df.withColumns({"feature_errors": errors, "is_in_range": F.size(errors) == 0})


def clip_features(df: DataFrame, specs: Sequence[FeatureSpec] = FEATURES) -> DataFrame:
    """Cut values to their valid range; NULL stays NULL."""
    def clipped(s: FeatureSpec) -> Column:
        x = F.col(s.name).cast("double")
        return F.when(x.isNotNull(), F.greatest(F.lit(s.low), F.least(F.lit(s.high), x)))

    return df.withColumns({s.name: clipped(s) for s in _present(df, specs)})


def clip_zscores(df: DataFrame, limit: float = ZSCORE_LIMIT) -> DataFrame:
    specs = [FeatureSpec(name, "zscore", -limit, limit) for name in ZSCORES]
    return clip_features(df, specs)


def fill_defaults(df: DataFrame, specs: Sequence[FeatureSpec] = FEATURES) -> DataFrame:
    """Warm-up NULLs to the default of each feature."""
    return df.withColumns(
        {s.name: F.coalesce(F.col(s.name).cast("double"), F.lit(s.default)) for s in _present(df, specs)}
    )


def missing_names(names: Sequence[str], available: Iterable[str]) -> list[str]:
    """Requested names that do not exist, in the order asked for."""
    known = set(available)
    return [n for n in names if n not in known]


def select_features(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("symbol", "bar_idx")) -> DataFrame:
    """Keys and the named features; raises on unknown names."""
    lost = missing_names(names, df.columns)
    if lost:
        raise ValueError(f"unknown features {lost}")
    return df.select(*keys, *names)
