"""Feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import names
from tabloom.functions.columns import as_number, as_text, col, is_numeric, numeric_columns
from tabloom.operators.encode import add_interactions, interaction_pairs
from tabloom.operators.profile import correlation_table, profile, target_correlations
from tabloom.operators.quantiles import quantiles

MIN_VARIANCE = 0.01
MAX_CORRELATION = 0.95
MAX_FEATURES = 30


def variances(df: DataFrame, feats: Sequence[str]) -> dict[str, float]:
    """Population variance per feature, missing -> 0; one aggregate."""
    row = df.agg(*[F.var_pop(as_number(df, f)).alias(f"v{i}") for i, f in enumerate(feats)]).first()
    return {f: row[f"v{i}"] or 0.0 for i, f in enumerate(feats)}


def variance_filter(df: DataFrame, feats: Sequence[str]) -> tuple[list[str], dict[str, float]]:
    """Features with variance >= 0.01, all of them if none reaches it."""
    found = variances(df, feats)
    kept = [f for f in feats if found[f] >= MIN_VARIANCE]
    return kept or list(feats), found


def pearson_importance(df: DataFrame, feats: Sequence[str], target: str) -> DataFrame:
    """|r| with the target, gaps as 0, 4 digits, strongest first."""
    r = target_correlations(df, feats, target)
    rows = sorted(((f, abs(r[f])) for f in feats), key=lambda x: -x[1])
    made = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return made.select("feature", F.round("importance", 4).alias("importance"))


def correlation_filter(df: DataFrame, feats: Sequence[str], target: str) -> tuple[list[str], dict[str, float]]:
    """Walk the features by |r| with the target; leave out one that goes above 0.95 with a kept one.

    The k x k correlations come from Spark; the walk over them is a few names on the driver.
    """
    r = {f: abs(v) for f, v in target_correlations(df, feats, target).items()}
    order = sorted(feats, key=lambda f: -r[f])
    pair: dict[tuple[str, str], float] = {}
    for a, b, value in correlation_table(df, order, "pairwise"):
        pair[a, b] = pair[b, a] = abs(value)
    kept: list[str] = []
    for f in order:
        if all(pair[f, g] <= MAX_CORRELATION for g in kept):
            kept.append(f)
    return kept, r


@dataclass(frozen=True)
class Binning:
    """Cut points of numeric columns; other columns use their values."""

    cuts: dict[str, list[float]]
    zero: bool

    def add(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """Add a bin number per numeric column under the given name, null for gaps.

        A value belongs to the bin whose upper cut it does not exceed, so the bins are closed
        on the right: negated values fall into negated, left-closed bins.
        """
        endless = [float("-inf"), float("inf")]
        values, inputs, outputs, splits = {}, [], [], []
        for name, out in columns.items():
            value = as_number(df, name)
            values[f"_m{out}"] = -(F.coalesce(value, F.lit(0.0)) if self.zero else value)
            inputs.append(f"_m{out}")
            outputs.append(f"_b{out}")
            splits.append([endless[0], *sorted(-c for c in self.cuts[name]), endless[1]])
        if not inputs:
            return df
        made = Bucketizer(inputCols=inputs, outputCols=outputs, splitsArray=splits, handleInvalid="keep").transform(
            df.withColumns(values)
        )
        bins = {out: F.when(F.col(f"_m{out}").isNotNull(), F.col(f"_b{out}").cast("int")) for out in columns.values()}
        return made.withColumns(bins).drop(*inputs, *outputs)


def learn_bins(df: DataFrame, cols: Sequence[str], bins: int, zero: bool) -> Binning:
    """Equal-frequency cut points, duplicates merged."""
    numeric = [c for c in cols if is_numeric(df.schema[c].dataType)]
    values = {c: as_number(df, c) for c in numeric}
    if zero:
        values = {c: F.coalesce(v, F.lit(0.0)) for c, v in values.items()}
    probs = [i / bins for i in range(1, bins)]
    found = quantiles(df, values, probs) if numeric else {}
    return Binning({c: sorted({x for x in cuts if x is not None}) for c, cuts in found.items()}, zero)


def _joint_counts(df: DataFrame, feats: Sequence[str], target: str, binning: Binning) -> DataFrame:
    """(feature number, a, b, n): how often two bins or values meet."""
    places = {f: i for i, f in enumerate(feats)}
    numeric = {f: f"_x{i}" for f, i in places.items() if f in binning.cuts}
    texts = {f: f"_x{i}" for f, i in places.items() if f not in binning.cuts}
    chosen = {**numeric, **({target: "_y"} if target in binning.cuts else {})}
    slim = df.select(*[col(c) for c in dict.fromkeys([*feats, target])])
    made = binning.add(slim, chosen)
    made = made.withColumns({out: as_text(slim, f) for f, out in texts.items()})
    if target not in binning.cuts:
        made = made.withColumn("_y", as_text(slim, target))
    parts = []
    for group in (numeric, texts):
        if not group:
            continue
        # Only the bins travel: one small array per row, combined before the shuffle.
        order = F.array(*[F.lit(places[f]) for f in group])
        long = made.select(F.posexplode(F.array(*[F.col(x) for x in group.values()])).alias("p", "a"), F.col("_y").alias("b"))
        counted = long.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("p", "a", "b")
        counted = counted.agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            counted.select(
                F.element_at(order, F.col("p") + 1).alias("f"), F.col("a").cast("string").alias("a"),
                F.col("b").cast("string").alias("b"), "n",
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def mutual_information_table(
    df: DataFrame, feats: Sequence[str], target: str, bins: int = 10, zero: bool = False
) -> DataFrame:
    """(feature, mi) in nats between binned columns.

    MI = H(a) + H(b) - H(a, b), and each entropy needs only sums of n ln n. The joint counts
    combine before the shuffle; no pair of values is joined to another.
    """
    joint = _joint_counts(df, feats, target, learn_bins(df, [*feats, target], bins, zero))

    def weighted(frame: DataFrame, sign: int) -> DataFrame:
        return frame.groupBy("f").agg(
            (F.sum(F.col("n") * F.log("n")) * sign).alias("s"),
            (F.sum("n") if sign < 0 else F.max(F.lit(None).cast("bigint"))).alias("total"),
        )

    left = joint.groupBy("f", "a").agg(F.sum("n").alias("n"))
    right = joint.groupBy("f", "b").agg(F.sum("n").alias("n"))
    parts = weighted(joint, -1).unionByName(weighted(left, 1)).unionByName(weighted(right, 1))
    summed = parts.groupBy("f").agg(F.sum("s").alias("s"), F.max("total").alias("total"))
    label = F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("f") + 1)
    mi = F.greatest(F.log("total") - F.col("s") / F.col("total"), F.lit(0.0))
    return summed.select(label.alias("feature"), mi.alias("mi"))


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Mutual information of two columns over the rows where both are present."""
    both = df.where(col(a).isNotNull() & col(b).isNotNull())
    return mutual_information_table(both, [a], b, bins).select("mi")


def mi_select(df: DataFrame, feats: Sequence[str], target: str, k: int = MAX_FEATURES, bins: int = 10) -> DataFrame:
    """The k features with the highest mutual information with the target, gaps as 0."""
    scores = mutual_information_table(df, feats, target, bins, zero=True)
    return scores.orderBy(F.desc("mi"), "feature").limit(k)


@dataclass(frozen=True)
class Selection:
    """What each stage of the selection kept."""

    original: tuple[str, ...]
    skipped: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    variance: dict[str, float]
    after_variance: tuple[str, ...]
    target_r: dict[str, float]
    after_correlation: tuple[str, ...]
    scores: dict[str, float]
    selected: tuple[str, ...]


def run_selection(
    train: DataFrame, feats: Sequence[str], target: str, interacting: Sequence[str] | None = None,
    k: int = MAX_FEATURES,
) -> Selection:
    """Interactions -> variance -> correlation -> mutual information on the training rows.

    Features that are no numbers are set aside and reported; they have no variance.
    """
    numeric = set(numeric_columns(train))
    usable = [f for f in feats if f in numeric]
    skipped = [f for f in feats if f not in numeric]
    base = [f for f in (interacting if interacting is not None else usable) if f in usable]
    pairs = interaction_pairs(train, base, target) if len(base) > 1 else []
    frame = add_interactions(train, pairs)
    everything = usable + [f"{a}_x_{b}" for a, b in pairs]
    varied, variance = variance_filter(frame, everything)
    kept, r = correlation_filter(frame, varied, target)
    ranked = mi_select(frame, kept, target, k=len(kept)).collect()
    scores = {row["feature"]: row["mi"] for row in ranked}
    chosen = sorted(kept, key=lambda f: -scores[f])[:k]
    return Selection(
        tuple(feats), tuple(skipped), tuple(pairs), variance, tuple(varied), r, tuple(kept), scores, tuple(chosen)
    )


def selection_report(df: DataFrame, done: Selection) -> DataFrame:
    """Feature counts after each stage."""
    rows = [
        ("stage0_original", len(done.original)),
        ("stage1_generated", len(done.pairs)),
        ("stage2_after_variance", len(done.after_variance)),
        ("stage3_after_correlation", len(done.after_correlation)),
        ("stage4_after_mi", len(done.selected)),
        ("not_numeric", len(done.skipped)),
    ]
    return df.sparkSession.createDataFrame(rows, "stage string, n bigint")


def selected_features(df: DataFrame, done: Selection) -> DataFrame:
    """Every feature that reached the last stage, with its scores."""
    rows = [(f, done.target_r[f], done.scores[f], f in done.selected) for f in done.after_correlation]
    return df.sparkSession.createDataFrame(rows, "feature string, target_r double, mi double, selected boolean")


def _signed(df: DataFrame, target: str, nulls: str) -> dict[str, float]:
    numeric = [c for c in numeric_columns(df) if c != target]
    return target_correlations(df, numeric, target, nulls)


def default_features(
    df: DataFrame, target: str, rule: str = "a", approx: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    """Features to start with.

    Rule 'a': no identifiers by name, no |r| >= 0.98, and with more than five columns no
    |r| < 0.1; columns without r stay. Rule 'b': categories if 1 < distinct <= 25 and below
    0.9 of the rows (one-hot), numbers if 0.05 <= |r| < 0.97, dates (periodic); ``approx`` and ``sketches`` as in
    `profile`.
    """
    spark = df.sparkSession
    if rule == "a":
        r = _signed(df, target, "zero")
        rows = []
        for c in df.columns:
            if c == target or names.name_looks_like_id(c):
                continue
            if c in r and (abs(r[c]) >= 0.98 or (abs(r[c]) < 0.1 and len(df.columns) > 5)):
                continue
            rows.append((c, r.get(c), "plain"))
    elif rule == "b":
        r = _signed(df, target, "pairwise")
        rows = []
        for p in profile(df, approx, sketches=sketches).collect():
            c = p["name"]
            if c == target:
                continue
            if p["type"] == "categorical":
                if 1 < p["nunique"] <= 25 and p["nunique"] < 0.9 * p["n"]:
                    rows.append((c, None, "one_hot"))
            elif p["type"] == "numeric":
                if 0.05 <= abs(r.get(c, 0.0)) < 0.97:
                    rows.append((c, r[c], "plain"))
            else:
                rows.append((c, None, "periodic"))
    else:
        raise ValueError("rule is 'a' or 'b'")
    made = spark.createDataFrame(rows, "feature string, r double, encoding string")
    return made.withColumn("r", F.round("r", 4))


def feature_labels(df: DataFrame, target: str) -> DataFrame:
    """Strength, leak and safety labels of the numeric features by their r with the target."""
    r = _signed(df, target, "zero")
    rows = list(r.items())
    made = df.sparkSession.createDataFrame(rows, "feature string, r double").withColumn("r", F.round("r", 4))
    size = F.abs("r")
    strength = (
        F.when(size >= 0.98, "leak")
        .when(size >= 0.6, "strong")
        .when(size >= 0.2, "moderate")
        .when(size > 0, "weak")
        .otherwise("none")
    )
    id_like = names.looks_like_id(F.col("feature"))
    return made.withColumns(
        {"strength": strength, "id_like": id_like, "safe": (size > 0) & (size < 0.95) & ~id_like}
    )


def feature_groups(profiled: DataFrame) -> DataFrame:
    """Columns as unique_id, date_time, category or influential."""
    ratio = F.col("nunique") / F.greatest(F.col("n"), F.lit(1))
    unique = names.looks_like_id(F.col("name")) | ((ratio > 0.95) & (F.col("type") == "categorical"))
    group = (
        F.when((F.col("type") == "datetime") | names.has_any(F.col("name"), names.DATE_WORDS), "date_time")
        .when(unique, "unique_id")
        .when(F.col("type") == "categorical", "category")
        .otherwise("influential")
    )
    return profiled.select("name", group.alias("feature_group"), "nunique")
