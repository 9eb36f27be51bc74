"""Missing values and coercion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, col, is_numeric, nan_to_null, numeric_columns
from tabloom.operators.profile import modes
from tabloom.operators.quantiles import quantiles


def handle_missing(df: DataFrame, how: str = "mean") -> DataFrame:
    """'drop' removes rows with a gap; 'mean' and 'median' fill numeric columns.

    Columns that have gaps become double; text columns keep their nulls when filling.
    """
    clean = nan_to_null(df)
    if how == "drop":
        whole = F.lit(True)
        for c in clean.columns:
            whole = whole & col(c).isNotNull()
        return clean.where(whole)
    if how not in ("mean", "median"):
        raise ValueError("missing values: drop, mean or median")
    numeric = numeric_columns(clean)
    if not numeric:
        return clean
    values = {c: as_number(clean, c) for c in numeric}
    row = clean.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())],
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())],
    ).first()
    fills = {c: row[f"m{i}"] for i, c in enumerate(numeric) if row[f"n{i}"] < row["n"]}
    if how == "median" and fills:
        middle = quantiles(clean, {c: values[c] for c in fills}, [0.5])
        fills = {c: middle[c][0] for c in fills}
    filled = {c: F.coalesce(values[c], F.lit(v).cast("double")) for c, v in fills.items()}
    return clean.withColumns(filled) if filled else clean


def missing_fills(train: DataFrame, how: str) -> dict[str, float]:
    """'mean' or 'median' of every numeric column of the training rows, 0 for columns without values."""
    if how not in ("mean", "median"):
        raise ValueError("fills are means or medians")
    values = {c: as_number(train, c) for c in numeric_columns(train)}
    if not values:
        return {}
    if how == "median":
        return {c: v[0] or 0.0 for c, v in quantiles(train, values, [0.5]).items()}
    row = train.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())]).first()
    return {c: row[f"m{i}"] or 0.0 for i, c in enumerate(values)}


def fill_gaps(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Gaps of the named columns filled; those columns become double."""
    clean = nan_to_null(df)
    return clean.withColumns({c: F.coalesce(as_number(clean, c), F.lit(v).cast("double")) for c, v in fills.items()}) if fills else clean


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text that is no number becomes null."""
    return df.withColumns({c: as_number(df, c) for c in cols})


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers with 0 for every gap, as models want them."""
    return df.withColumns({c: F.coalesce(as_number(df, c), F.lit(0.0)) for c in cols})


@dataclass(frozen=True)
class TrainStats:
    """Defaults learned from a training table: one value per column."""

    means: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    columns: tuple[str, ...] = ()


def train_stats(df: DataFrame) -> TrainStats:
    """Mean of numeric columns (0 if all missing), most frequent text of the others."""
    numeric = numeric_columns(df)
    others = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    means: dict[str, float] = {}
    if numeric:
        row = df.agg(*[F.avg(as_number(df, c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
        means = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(numeric)}
    found = modes(df, others) if others else {}
    return TrainStats(means, {c: found.get(c, "") for c in others}, tuple(df.columns))


def fill_from(df: DataFrame, stats: TrainStats) -> DataFrame:
    """Give rows that lack a training column, or hold null in it, the training default."""
    present = nan_to_null(df)
    made = {}
    for c in stats.columns:
        default = F.lit(stats.means[c]) if c in stats.means else F.lit(stats.modes[c])
        if c not in present.columns:
            made[c] = default
        elif c in stats.means:
            made[c] = F.coalesce(as_number(present, c), default)
        else:
            kind = present.schema[c].dataType
            made[c] = F.coalesce(col(c), default.try_cast(kind))
    return present.withColumns(made)
