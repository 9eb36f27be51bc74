"""Feature encoding: time trend, cycles, one-hot, interactions, scaling, assembly."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, as_text, col, is_datetime
from tabloom.functions.dates import as_timestamp
from tabloom.functions.vectors import is_vector, unit_vector
from tabloom.operators.ordered import WINDOW_LIMIT, Ordered, number_rows
from tabloom.operators.profile import sample_values, target_correlations

# Period of each calendar key.
PERIODS = {"month": 12, "dayofweek": 7, "hour": 24, "quarter": 4, "week": 52, "day": 31}

#: Up to this many values a category gets a column per value, beyond it one sparse vector.
MAX_CATEGORIES = 200
MAX_INTERACTING = 10


@dataclass(frozen=True)
class TimeState:
    """Origin of the elapsed-time feature."""

    min_year: float | None = None
    min_month: float | None = None


def time_state(df: DataFrame, detected: dict[str, str]) -> TimeState:
    aggs = [F.min(as_number(df, detected[k])).alias(k) for k in ("year", "month") if k in detected]
    if not aggs:
        return TimeState()
    row = df.agg(*aggs).first().asDict()
    return TimeState(row.get("year"), row.get("month"))


def elapsed_time(df: DataFrame, detected: dict[str, str], state: TimeState | None = None) -> DataFrame:
    """Months (or years) since the earliest year and month; unchanged without either."""
    origin = state or time_state(df, detected)
    parts = []
    if "year" in detected and origin.min_year is not None:
        years = as_number(df, detected["year"]) - F.lit(origin.min_year)
        parts.append(years * 12 if "month" in detected else years)
    if "month" in detected and origin.min_month is not None:
        parts.append(as_number(df, detected["month"]) - F.lit(origin.min_month))
    if not parts:
        return df
    return df.withColumn("elapsed_time", sum(parts[1:], parts[0]))


def wave(value: Column, period: float | Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / (F.lit(float(period)) if not isinstance(period, Column) else period)
    return F.sin(angle), F.cos(angle)


def cyclical_names(detected: dict[str, str]) -> list[str]:
    return [f"{detected[k]}_{part}" for k in PERIODS if k in detected for part in ("sin", "cos")]


def cyclical(df: DataFrame, detected: dict[str, str]) -> DataFrame:
    """sin and cos of every detected calendar column over its period."""
    made = {}
    for key, period in PERIODS.items():
        if key in detected:
            name = detected[key]
            made[f"{name}_sin"], made[f"{name}_cos"] = wave(as_number(df, name), period)
    return df.withColumns(made) if made else df


def periodic_names(config: dict) -> list[str]:
    """Columns that one periodic setting makes."""
    name = config["column"]
    if config.get("type") == "datetime":
        how = config.get("period_type", "auto")
        kinds = {"auto": ["month", "dow"], "month": ["month"], "dayofweek": ["dow"], "hour": ["hour"]}.get(how, [])
        return [f"{name}_{kind}_{part}" for kind in kinds for part in ("sin", "cos")]
    return [f"{name}_sin", f"{name}_cos"]


def periodic_datetime(
    df: DataFrame,
    config: dict,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    limit: int = WINDOW_LIMIT,
) -> DataFrame:
    """Waves of the month and weekday ('auto'), or of one of month, dayofweek, hour.

    A gap takes the nearest earlier date, then the nearest later one, in ``order_by``. The
    ordered pass runs only when there is a gap.
    """
    name = config["column"]
    typed = is_datetime(df.schema[name].dataType)
    stamp = col(name).cast("timestamp") if typed else as_timestamp(col(name).cast("string"))
    frame = df.withColumn("_t", stamp)
    if order_by and frame.where(F.col("_t").isNull()).limit(1).count():
        ordered = Ordered(frame, order_by, partition_by, limit)
        ordered.fill("_t", "_t", forward=True).fill("_t", "_t", forward=False)
        frame = ordered.rows()
    values = {
        "month": (F.coalesce(F.month("_t"), F.lit(1)), 12),
        "dow": (F.coalesce(F.weekday("_t"), F.lit(0)), 7),
        "hour": (F.coalesce(F.hour("_t"), F.lit(0)), 24),
    }
    made = {}
    for full in periodic_names(config):
        kind, part = full.removeprefix(name + "_").split("_")
        sine, cosine = wave(*values[kind])
        made[full] = sine if part == "sin" else cosine
    return frame.withColumns(made).drop("_t")


def range_state(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """min and max of numeric columns with gaps as 0."""
    if not columns:
        return {}
    values = [F.coalesce(as_number(df, c), F.lit(0.0)) for c in columns]
    row = df.agg(
        *[F.min(v).alias(f"lo{i}") for i, v in enumerate(values)],
        *[F.max(v).alias(f"hi{i}") for i, v in enumerate(values)],
    ).first()
    return {c: (row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0) for i, c in enumerate(columns)}


def named_period(name: str) -> float | None:
    lowered = name.lower()
    if "hour" in lowered:
        return 24.0
    if "month" in lowered:
        return 12.0
    if "day" in lowered and "week" in lowered:
        return 7.0
    return None


def periodic_numeric(
    df: DataFrame, column: str, state: dict[str, tuple[float, float]] | None = None, by_name: bool = False
) -> DataFrame:
    """Waves over the value range; ``by_name`` takes 24, 12 or 7 from the column name."""
    low, high = (state or range_state(df, [column]))[column]
    period = (named_period(column) if by_name else None) or ((high - low) if high != low else 1.0)
    value = F.coalesce(as_number(df, column), F.lit(0.0)) - F.lit(low)
    sine, cosine = wave(value, period)
    return df.withColumns({f"{column}_sin": sine, f"{column}_cos": cosine})


def learn_categories(df: DataFrame, cols: Sequence[str], cap: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct texts per column for `one_hot`, refused beyond ``cap``: `split_categories` takes any number."""
    if not cols:
        return {}
    rows = sample_values(df.select(*[col(c) for c in cols]), cap + 1).collect()
    found: dict[str, list[str]] = {c: [] for c in cols}
    for row in rows:
        found[row["name"]].append(row["value"])
    for c, values in found.items():
        if len(values) > cap:
            raise ValueError(f"column {c!r} has more than {cap} categories: use one_hot_vector")
        values.sort()
    return found


def one_hot_names(categories: dict[str, list[str]]) -> list[str]:
    return [f"{c}_{v}" for c, values in categories.items() for v in values]


def one_hot(df: DataFrame, cols: Sequence[str], categories: dict[str, list[str]] | None = None) -> DataFrame:
    """A 0/1 column per category; unseen values and nulls give 0 everywhere."""
    known = categories if categories is not None else learn_categories(df, cols)
    made = {}
    for c in cols:
        if c not in df.columns:
            continue
        text = as_text(df, c)
        for v in known[c]:
            made[f"{c}_{v}"] = F.coalesce((text == v).cast("double"), F.lit(0.0))
    return df.withColumns(made) if made else df


@dataclass(frozen=True)
class Dictionary:
    """The numbered distinct texts of a column: one row (value, slot) each, slots 0.. in the order of the texts."""

    column: str
    table: DataFrame
    size: int

    @property
    def feature(self) -> str:
        """The vector column that stands for the column."""
        return f"{self.column}_onehot"


def learn_dictionary(df: DataFrame, column: str) -> Dictionary:
    """Distinct non-null texts, numbered in order through a range partitioning; no value reaches the driver."""
    values = df.select(as_text(df, column).alias("value")).where(F.col("value").isNotNull()).distinct()
    numbered = number_rows(values, ["value"], "slot").withColumn("slot", F.col("slot") - 1)
    return Dictionary(column, numbered, numbered.count())


def split_categories(
    df: DataFrame, cols: Sequence[str], widest: int = MAX_CATEGORIES
) -> tuple[dict[str, list[str]], dict[str, Dictionary]]:
    """Sorted texts of the columns with at most ``widest`` of them, and a dictionary for each column with more.

    Either way every value is encoded: as a column of its own, or as a place of one sparse vector.
    """
    if not cols:
        return {}, {}
    heads: dict[str, list[str]] = {c: [] for c in cols}
    for row in sample_values(df.select(*[col(c) for c in cols]), widest + 1).collect():
        heads[row["name"]].append(row["value"])
    narrow = {c: sorted(v) for c, v in heads.items() if len(v) <= widest}
    return narrow, {c: learn_dictionary(df, c) for c in cols if c not in narrow}


def one_hot_vector(df: DataFrame, dictionary: Dictionary, out: str | None = None) -> DataFrame:
    """One sparse vector column, 1 at the slot of the row's text; unseen texts and nulls give the zero vector.

    The dictionary is joined by text: broadcast where it is small, else a sort-merge join whose hot texts adaptive
    execution splits. Works on a stream too.
    """
    name = out or dictionary.feature
    if dictionary.column not in df.columns:
        slot, joined = F.lit(None).cast("int"), df
    else:
        known = dictionary.table.select(F.col("value").alias("_value"), F.col("slot").alias("_slot"))
        joined = df.join(known, as_text(df, dictionary.column) == F.col("_value"), "left")
        slot = F.col("_slot")
    size = {"ml_attr": {"num_attrs": dictionary.size}}
    return joined.withColumn(name, unit_vector(slot, dictionary.size).alias(name, metadata=size)).drop("_value", "_slot")


def interaction_pairs(df: DataFrame, feats: Sequence[str], target: str) -> list[tuple[str, str]]:
    """Pairs of numeric features; of more than ten, the ten that go best with the target."""
    feats = [f for f in feats if f != target]
    if len(feats) > MAX_INTERACTING:
        r = target_correlations(df, feats, target)
        feats = sorted(feats, key=lambda f: -abs(r[f]))[:MAX_INTERACTING]
    return [(a, b) for i, a in enumerate(feats) for b in feats[i + 1 :]]


def add_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    made = {f"{a}_x_{b}": F.coalesce(as_number(df, a) * as_number(df, b), F.lit(0.0)) for a, b in pairs}
    return df.withColumns(made) if made else df


def interactions(df: DataFrame, feats: Sequence[str], target: str) -> DataFrame:
    """Products of feature pairs as a_x_b, gaps as 0."""
    return add_interactions(df, interaction_pairs(df, feats, target))


@dataclass(frozen=True)
class Scaler:
    """(value - centre) / scale per feature."""

    method: str
    centre: dict[str, float]
    scale: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        made = {
            f: (as_number(df, f) - F.lit(self.centre[f])) / F.lit(self.scale[f]) for f in self.centre if f in df.columns
        }
        return df.withColumns(made) if made else df


def fit_scaler(train: DataFrame, feats: Sequence[str], method: str) -> Scaler:
    """'minmax' or 'zscore' (population deviation), learned from the training rows; a constant
    feature keeps scale 1, so it becomes 0. 'none' changes nothing. Vectors of categories stay 0 and 1."""
    feats = [f for f in feats if f not in train.columns or not is_vector(train.schema[f].dataType)]
    if method == "none" or not feats:
        return Scaler("none", {}, {})
    if method not in ("minmax", "zscore"):
        raise ValueError("normalization: none, minmax or zscore")
    aggs = []
    for i, f in enumerate(feats):
        v = as_number(train, f)
        if method == "minmax":
            aggs += [F.min(v).alias(f"c{i}"), (F.max(v) - F.min(v)).alias(f"s{i}")]
        else:
            aggs += [F.avg(v).alias(f"c{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    centre = {f: float(row[f"c{i}"] or 0.0) for i, f in enumerate(feats)}
    scale = {f: float(row[f"s{i}"] or 1.0) for i, f in enumerate(feats)}
    return Scaler(method, centre, scale)


def scale(train: DataFrame, test: DataFrame, feats: Sequence[str], method: str) -> tuple[DataFrame, DataFrame]:
    scaler = fit_scaler(train, feats, method)
    return scaler.apply(train), scaler.apply(test)


def ordered_unique(names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(names))


def assemble(df: DataFrame, feats: Sequence[str], out: str = "features") -> DataFrame:
    """One vector of the features, gaps as 0; vector features are joined on."""
    values, inputs = [], []
    for i, f in enumerate(feats):
        if is_vector(df.schema[f].dataType):
            inputs.append(f)
        else:
            values.append(F.coalesce(as_number(df, f), F.lit(0.0)).alias(f"_f{i}"))
            inputs.append(f"_f{i}")
    frame = df.select("*", *values)
    made = VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(frame)
    return made.drop(*[f"_f{i}" for i in range(len(feats))])
