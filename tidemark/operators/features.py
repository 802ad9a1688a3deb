"""Leakage-safe feature tables: lags, rolling sums, targets, flow differences, cyclical time, chronological split.

Everything over one series shares one window, so the whole table costs one sort; windows run inside time buckets that also
hold what lies within reach of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import HOUR, cyclical, row_sum
from tidemark.operators.events import chronological_split
from tidemark.operators.grid import BUCKET, with_halo

LAG_HOURS, CUM_HOURS, HORIZONS, PER_HOUR = (1, 2, 3, 6, 12, 24), (3, 6, 12, 24, 48), (1, 6, 24), 6


def _window(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("ts")


def lags(cols: list[str], hours: tuple[int, ...] = LAG_HOURS, keys: tuple[str, ...] = ("series_id",), per_hour: int = PER_HOUR) -> list[Column]:
    w = _window(keys)
    return [F.lag(c, h * per_hour).over(w).alias(f"{c}_lag_{h}h") for c in cols for h in hours]


def leads(col: str, hours: tuple[int, ...] = HORIZONS, keys: tuple[str, ...] = ("series_id",), per_hour: int = PER_HOUR) -> list[Column]:
    w = _window(keys)
    return [F.lead(col, h * per_hour).over(w).alias(f"target_{h}h") for h in hours]


def rolling_sums(cols: list[str], hours: tuple[int, ...] = CUM_HOURS, keys: tuple[str, ...] = ("series_id",), per_hour: int = PER_HOUR) -> list[Column]:
    """Sums over the last rows, the current one included; NULL only if all are NULL."""
    w = _window(keys)
    return [F.sum(c).over(w.rowsBetween(-(h * per_hour - 1), 0)).alias(f"{c}_cum_{h}h") for c in cols for h in hours]


def flow_differences(diffs: dict[str, tuple[str, tuple[str, ...]]], sums: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    """Downstream less the sum of what is known upstream (NULL if either side is), and sums of inflows."""
    out = {k: F.col(down) - row_sum(*ups) for k, (down, ups) in diffs.items()}
    return out | {k: row_sum(*cols) for k, cols in (sums or {}).items()}


def training_table(
    grid: DataFrame, target: str, lagged: list[str], cumulated: list[str], diffs: dict[str, tuple[str, tuple[str, ...]]] | None = None, sums: dict[str, tuple[str, ...]] | None = None, keys: tuple[str, ...] = ("basin",),
    lag_hours: tuple[int, ...] = LAG_HOURS, cum_hours: tuple[int, ...] = CUM_HOURS, horizons: tuple[int, ...] = HORIZONS, per_hour: int = PER_HOUR, splits: tuple[str, str] | None = None, bucket: int = BUCKET,
) -> DataFrame:
    """Wide grid with lags of values and of their ``_missing`` flags, rolling sums, flow features with lags, cyclical time
    and targets; rows without every target go; ``split`` is chronological."""
    flows = flow_differences(diffs or {}, sums)
    base = with_halo(grid.select("*", *[c.alias(k) for k, c in flows.items()]), max(*lag_hours, *cum_hours) * HOUR, max(horizons) * HOUR, bucket)
    masks = [f"{c}_missing" for c in lagged if f"{c}_missing" in grid.columns]
    keys = (*keys, "__b")
    cols = [*lags(lagged + masks + list(flows), lag_hours, keys, per_hour), *rolling_sums(cumulated, cum_hours, keys, per_hour), *[c.alias(k) for k, c in cyclical("ts").items()], *leads(target, horizons, keys, per_hour)]
    table = base.select("*", *cols).filter("NOT __guest").drop("__b", "__guest").dropna(subset=[f"target_{h}h" for h in horizons])
    return table.withColumn("split", chronological_split("ts", *(splits or ())))


def predictor_columns(table: DataFrame, drop_prefixes: tuple[str, ...] = ("target_",), drop_suffixes: tuple[str, ...] = ("_quality", "_data_type"), drop: tuple[str, ...] = ("ts", "split", "event_id", "basin", "series_id")) -> list[str]:
    """Columns that a model may see, by naming rules."""
    return [c for c in table.columns if c not in drop and not c.lower().startswith(drop_prefixes) and not c.lower().endswith(drop_suffixes)]


def drop_like(df: DataFrame, part: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if part in c])
