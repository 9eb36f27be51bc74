"""Ranking of columns as prediction targets.

Statistics come from one profile aggregate; names, positions and scores are expressions over
the profile (one row per column). Only the model-based signal trains anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import names
from tabloom.functions.columns import as_text, col, is_datetime, is_flat, numeric_columns
from tabloom.functions.dates import as_timestamp
from tabloom.operators.dependency import GATE, dependency
from tabloom.operators.ordered import BLOCK_ROWS, WINDOW_LIMIT, Ordered
from tabloom.operators.profile import correlation_table, profile, sample_values
from tabloom.operators.select import mutual_information


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 against an empty text."""
    longest = F.greatest(F.length(a), F.length(b))
    shortest = F.least(F.length(a), F.length(b))
    return F.when(shortest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def name_score(name: Column, keywords: Sequence[str] = names.TARGET_WORDS) -> Column:
    """1 for a keyword, 0.65 to 0.8 for a near one, else 0."""
    plain = names.spaced(name)
    words = F.array(*[names.spaced(F.lit(k)) for k in keywords])

    def closeness(word: Column) -> Column:
        shared = F.arrays_overlap(F.split(plain, " "), F.split(word, " "))
        return F.greatest(F.when(shared, 0.7).otherwise(0.0), similarity(plain, word))

    best = F.array_max(F.transform(words, closeness))
    return F.when(F.array_contains(words, plain), 1.0).when(best >= 0.5, F.round(0.5 + 0.3 * best, 4)).otherwise(0.0)


def name_match(profiled: DataFrame, keywords: Sequence[str] = names.TARGET_WORDS) -> DataFrame:
    return profiled.withColumn("name_match", name_score(F.col("name"), keywords))


def position(profiled: DataFrame, columns: int, time_ordered: bool = False) -> DataFrame:
    """1 for the last column, 0.6 for the first, between them in between; 0.5 in time-ordered tables."""
    if columns <= 1:
        return profiled.withColumn("position", F.lit(1.0))
    if time_ordered:
        return profiled.withColumn("position", F.lit(0.5))
    middle = F.round(0.6 + 0.4 * (F.col("pos") / (columns - 1)), 4)
    place = F.when(F.col("pos") == columns - 1, 1.0).when(F.col("pos") == 0, 0.6).otherwise(middle)
    return profiled.withColumn("position", place)


def cardinality_signal(profiled: DataFrame) -> DataFrame:
    """Fit as a class target (few values) or as a number (many); the better one wins."""
    n, u = F.col("n"), F.col("nunique")
    share = u / F.greatest(n, F.lit(1))
    as_class = F.when((share < 0.05) | (u < 20), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (share - 0.05) * 2))
    as_value = F.when(F.col("numeric"), share).otherwise(0.0)
    usable = (n > 0) & (u >= 2)
    wins = usable & (as_value > as_class)
    score = F.when(~usable, 0.0).when(wins, F.round(as_value, 4)).otherwise(F.round(as_class, 4))
    return profiled.withColumns(
        {"cardinality": score, "variant": F.when(wins, "regression").otherwise("classification")}
    )


def missingness(profiled: DataFrame) -> DataFrame:
    n = F.col("n")
    return profiled.withColumn("missingness", F.when(n > 0, F.round(1 - F.col("nulls") / n, 4)).otherwise(0.0))


def smallest_texts(df: DataFrame, columns: Sequence[str], n: int = 5) -> dict[str, list[str]]:
    """The n smallest distinct texts per column in one pass; tasks keep n values a column."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    if columns:
        for row in sample_values(df.select(*[as_text(df, c).alias(c) for c in columns]), n).collect():
            found[row["name"]].append(row["value"])
    return {c: sorted(values)[:n] for c, values in found.items()}


def semantic(
    profiled: DataFrame, samples: dict[str, list[str]], keywords: Sequence[str] = names.TARGET_WORDS
) -> DataFrame:
    """Highest TF-IDF cosine between (name and sample texts) and a keyword, for columns whose name
    score is below 0.3.

    Every keyword is one token, so the cosine is that token's weight over the length of the
    column's vector. Inverse frequencies are smoothed over the keywords and the column.
    """
    spark = profiled.sparkSession
    extra = spark.createDataFrame(list(samples.items()) or [("", [])], "name string, samples array<string>")
    said = F.filter(F.transform("samples", names.spaced), lambda t: t != "")
    extra = extra.select("name", F.array_join(said, " ").alias("sample_text"))
    joined = profiled.join(F.broadcast(extra), "name", "left")
    full = F.lower(F.concat_ws(" ", names.spaced(F.col("name")), F.nullif(F.col("sample_text"), F.lit(""))))
    tokens = F.regexp_extract_all(full, F.lit(r"(?U)\b(\w+)\b"), F.lit(1))
    known = F.array(*[F.lit(k.lower()) for k in dict.fromkeys(keywords)])
    docs = len(keywords) + 1
    rare = F.log(F.lit((1 + docs) / 2)) + 1
    shared = F.log(F.lit((1 + docs) / 3)) + 1
    distinct = F.array_distinct(tokens)

    def weight(token: Column) -> Column:
        count = F.size(F.filter(F.col("_tokens"), lambda t: t == token))
        return count * F.when(F.array_contains(known, token), shared).otherwise(rare)

    frame = joined.withColumn("_tokens", tokens).withColumn("_distinct", distinct)
    weights = F.transform("_distinct", weight)
    norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w * w))
    hits = F.transform(F.filter("_distinct", lambda t: F.array_contains(known, t)), weight)
    best = F.coalesce(safe(F.array_max(hits), norm), F.lit(0.0))
    enough = F.col("name_match") >= GATE
    return frame.withColumns(
        {
            "semantic": F.when(enough, 0.0).otherwise(F.round(best, 4)),
            "semantic_skipped": F.when(enough, "name_match_sufficient"),
        }
    ).drop("_tokens", "_distinct", "sample_text")


def safe(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def is_time_ordered(
    df: DataFrame, order_by: Sequence[str], limit: int = WINDOW_LIMIT, block_rows: int = BLOCK_ROWS
) -> bool:
    """True when a date column only rises or only falls in the given row order."""
    for field in df.schema.fields:
        dated = is_datetime(field.dataType)
        if not dated and not names.name_has(field.name, names.DATE_WORDS):
            continue
        stamp = col(field.name).cast("timestamp") if dated else as_timestamp(col(field.name).cast("string"))
        frame = df.select(*[col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], stamp.alias("_t"))
        frame = frame.where(F.col("_t").isNotNull())
        ordered = Ordered(frame, [f"_o{i}" for i in range(len(order_by))], (), limit, block_rows)
        ordered.look_back(1, lambda w: {"_b": F.lag("_t", 1).over(w)})
        row = ordered.df.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("_t") < F.col("_b")).alias("falls"),
            F.count_if(F.col("_t") > F.col("_b")).alias("rises"),
        ).first()
        if row["n"] > 1 and (row["falls"] == 0 or row["rises"] == 0):
            return True
    return False


def rank_targets(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    weights: dict[str, float] | None = None,
    with_models: bool = True,
    keywords: Sequence[str] = names.TARGET_WORDS,
    approx: bool = False,
    parallelism: int = 4,
    fold_key: Sequence[str] = (),
) -> DataFrame:
    """All columns by weighted score, with the signals, a task hint and the confidence tier.

    ``order_by`` states the row order; without one the table does not count as time-ordered. ``fold_key`` names the
    columns whose hash deals rows to the folds of the model-based signal, instead of the whole row.
    """
    spark = df.sparkSession
    given = weights or names.SIGNAL_WEIGHTS
    timed = bool(order_by) and is_time_ordered(df, order_by)
    signals = missingness(cardinality_signal(position(name_match(profile(df, approx), keywords), len(df.columns), timed)))
    dated = names.has_any(F.col("name"), ("date", "time"))
    hint = F.when(F.lit(timed) & F.col("numeric") & ~dated, "forecasting").otherwise(F.col("variant"))
    signals = signals.withColumn("task_hint", hint)
    # One row per column from here on.
    known = signals.collect()

    def model_signal(row) -> tuple:
        cheap = max(row["name_match"], row["cardinality"])
        return (row["name"], *dependency(df, row["name"], row["task_hint"], cheap, fold_key))

    if with_models:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(model_signal, known))
    else:
        scores = [(row["name"], 0.0, True, "off") for row in known]
    trained = spark.createDataFrame(
        scores, "name string, dependency double, dependency_skipped boolean, dependency_reason string"
    )
    unnamed = [
        r["name"] for r in known if r["name_match"] < GATE and not r["numeric"] and is_flat(df.schema[r["name"]].dataType)
    ]
    small = spark.createDataFrame(known, signals.schema)
    full = semantic(small, smallest_texts(df, unnamed), keywords).join(F.broadcast(trained), "name")
    score = sum((F.lit(given[s]) * F.col(s) for s in names.SIGNAL_WEIGHTS), F.lit(0.0))
    full = full.withColumn("score", F.round(score, 4))
    top = F.max("score").over(Window.partitionBy(F.lit(1)))
    tier = F.when(top > 0.7, "auto").otherwise("user_choice_required")
    return full.withColumn("confidence_tier", tier).orderBy(F.desc("score"), "pos")


def multi_target(df: DataFrame, ranking: DataFrame) -> bool:
    """True when the two best columns both score above 0.25 and tell little about each other."""
    top = ranking.orderBy(F.desc("score"), "pos").limit(2).collect()
    if len(top) < 2 or top[1]["score"] <= 0.25 or top[0]["score"] <= 0.25:
        return False
    a, b = top[0]["name"], top[1]["name"]
    if df.where(col(a).isNotNull() & col(b).isNotNull()).limit(6).count() <= 5:
        return False
    return mutual_information(df, a, b).first()["mi"] < 0.5


def meta_scores(df: DataFrame, threshold: float = 0.0, approx: bool = False) -> DataFrame:
    """The second scorer: name words, mean |r|, position, identifiers, gaps and dates in one sum.

    Columns from the threshold on, at least the best one, with an approach for each.
    """
    spark = df.sparkSession
    numeric = numeric_columns(df)
    mean_r = {}
    if len(numeric) > 1:
        sums = dict.fromkeys(numeric, 0.0)
        for a, b, r in correlation_table(df, numeric, "zero"):
            sums[a] += abs(r)
            if a != b:
                sums[b] += abs(r)
        mean_r = {c: s / len(numeric) for c, s in sums.items()}
    else:
        mean_r = dict.fromkeys(numeric, 0.0)
    rows = [(c, mean_r.get(c, 0.0)) for c in df.columns]
    table = profile(df, approx).join(
        F.broadcast(spark.createDataFrame(rows, "name string, mean_r double")), "name"
    )
    count = len(df.columns)
    typed = [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    target_word = names.has_any(F.col("name"), names.META_TARGET_WORDS)
    id_word = names.has_any(F.col("name"), names.ID_WORDS)
    word = F.when(target_word, 4.0).otherwise(0.0) - F.when(id_word, 6.0).otherwise(0.0)
    place = F.col("pos") / count if count > 1 else F.lit(0.5)
    per_row = F.greatest(F.col("n"), F.lit(1))
    unique = (F.col("nunique") / per_row > 0.95) & (id_word | ~F.col("numeric"))
    dated = F.col("name").isin(typed) | names.has_any(F.col("name"), ("date", "time"))
    score = (
        5.0 * word + 2.5 * F.col("mean_r") + 2.0 * place - F.when(unique, 8.0).otherwise(0.0)
        - 6.0 * F.col("nulls") / per_row - F.when(dated, 4.0).otherwise(0.0)
    )
    dates = {c for c in df.columns if c in typed or names.name_has(c, ("date", "time"))}
    others_dated = F.lit(len(dates) > 1) | (F.lit(len(dates) == 1) & ~F.col("name").isin(list(dates)))
    approach = (
        F.when(dated, "regression")
        .when(~F.col("numeric"), "classification")
        .when(F.col("nunique") <= 10, "classification")
        .when(others_dated, "forecasting")
        .otherwise("regression")
    )
    made = table.select("name", "pos", score.alias("raw_score"), approach.alias("approach"))
    made = made.withColumn("score", F.round("raw_score", 2))
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "pos"))
    kept = made.withColumn("_best", best).where((F.col("score") >= threshold) | (F.col("_best") == 1))
    return kept.orderBy("_best").drop("_best")


def best_meta_target(df: DataFrame) -> str:
    """The column with the highest unrounded meta score, the first among equals."""
    return meta_scores(df, float("-inf")).orderBy(F.desc("raw_score"), "pos").first()["name"]


def first_keyword_target(profiled: DataFrame, keywords: Sequence[str] = names.META_TARGET_WORDS) -> DataFrame:
    """The first column that contains the first keyword any column contains, else the last column."""
    words = F.array(*[F.lit(k) for k in keywords])
    lowered = F.lower(F.col("name"))
    places = F.transform(words, lambda w, i: F.when(lowered.contains(w), i))
    first = F.array_min(F.filter(places, lambda p: p.isNotNull()))
    marked = profiled.withColumn("_word", first)
    found = F.min_by("name", F.when(F.col("_word").isNotNull(), F.struct("_word", "pos")))
    return marked.agg(F.coalesce(found, F.max_by("name", "pos")).alias("target"))


def scale_scores(scores: DataFrame, score: str = "score", least: float = 0.85) -> DataFrame:
    """Scores over the highest one; those from 0.85 on are preselected. One row per column."""
    top = F.max(col(score)).over(Window.partitionBy(F.lit(1)))
    scaled = F.coalesce(F.try_divide(col(score), top), F.lit(0.0))
    return scores.withColumns({"scaled": F.round(scaled, 4), "preselected": scaled >= least})
