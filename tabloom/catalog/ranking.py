"""Target ranking queries."""

from pyspark.sql import functions as F

from tabloom.catalog.profiling import ORDERS, ORDERS_GAPS_SQL, orders_gaps
from tabloom.catalog.registry import per_column, query, table
from tabloom.catalog.series import hash_sql
from tabloom.functions import names
from tabloom.operators import target as T
from tabloom.operators.profile import profile

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "totalPrice", "orderStatus", "label"]

# Customers with a few columns whose names say something.
NAMED_SQL = """SELECT *, c_acctbal * 2 AS "totalPrice", CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'high' END AS "orderStatus",
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_acctbal > 4000)::INTEGER END AS label FROM customer"""


def named(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.withColumns(
        {
            "totalPrice": F.col("c_acctbal") * 2,
            "orderStatus": F.when(F.col("c_nationkey") < 12, "low").otherwise("high"),
            "label": F.when(F.col("c_custkey") % 6 != 0, (F.col("c_acctbal") > 4000).cast("int")),
        }
    )


def profile_sql(columns, numeric):
    rows = per_column(
        columns,
        "SELECT '{c}' AS name, {i}::BIGINT AS pos, count(*) AS n, count(*) - count(\"{c}\") AS nulls,"
        ' count(DISTINCT "{c}") AS u FROM t',
    )
    known = ", ".join(f"'{c}'" for c in numeric)
    return f"SELECT *, name IN ({known}) AS num FROM ({rows})"


NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal", "totalPrice", "label"]
WORDS = "[" + ", ".join(f"'{k.replace('_', ' ')}'" for k in names.TARGET_WORDS) + "]"
PLAIN = (
    "lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\\1 \\2', 'g'),"
    " '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-\\s]+', ' ', 'g')))"
)
NAME_SQL = f"""SELECT *, CASE WHEN list_contains({WORDS}, plain) THEN 1.0 WHEN best >= 0.5 THEN round(0.5 + 0.3 * best, 4) ELSE 0 END::DOUBLE AS name_match
  FROM (SELECT *, list_max(list_transform({WORDS}, lambda k: greatest(CASE WHEN list_has_any(string_split(plain, ' '), string_split(k, ' '))
    THEN 0.7 ELSE 0 END, 1 - levenshtein(plain, k)::DOUBLE / greatest(length(plain), length(k))))) AS best
  FROM (SELECT *, {PLAIN} AS plain FROM prof))"""
BASE = f"WITH t AS ({NAMED_SQL}), prof AS ({profile_sql(CUSTOMER, NUMERIC)}) "


@query("target_name_match", BASE + f"SELECT name, n::BIGINT AS n, nulls::BIGINT AS nulls, name_match FROM ({NAME_SQL})")
def target_name_match(spark, sf_dir):
    return T.name_match(profile(named(spark, sf_dir), distinct=False)).select("name", "n", "nulls", "name_match")


POSITION = "CASE WHEN pos = 7 THEN 1.0 WHEN pos = 0 THEN 0.6 ELSE round(0.6 + 0.4 * (pos / 7.0), 4) END::DOUBLE"


@query("target_position", BASE + f"SELECT name, n::BIGINT AS n, {POSITION} AS position, 0.5::DOUBLE AS position_timed FROM prof")
def target_position(spark, sf_dir):
    p = profile(named(spark, sf_dir), distinct=False)
    plain = T.position(p, len(CUSTOMER)).select("name", "n", "pos", "position")
    return T.position(plain.withColumnRenamed("position", "p"), len(CUSTOMER), True).select(
        "name", "n", F.col("p").alias("position"), F.col("position").alias("position_timed")
    )


CARD_SQL = """SELECT *, CASE WHEN u < 2 THEN 0 WHEN rs > cs THEN round(rs, 4) ELSE round(cs, 4) END::DOUBLE AS cardinality,
  CASE WHEN u >= 2 AND rs > cs THEN 'regression' ELSE 'classification' END AS variant FROM (
  SELECT *, CASE WHEN u / n < 0.05 OR u < 20 THEN 1.0::DOUBLE ELSE greatest(0, 1 - (u / n - 0.05::DOUBLE) * 2) END AS cs,
    CASE WHEN num THEN u / n ELSE 0 END AS rs FROM {source})"""


@query("target_cardinality", BASE + f"SELECT name, u::BIGINT AS nunique, cardinality, variant FROM ({CARD_SQL.format(source='prof')})")
def target_cardinality(spark, sf_dir):
    return T.cardinality_signal(profile(named(spark, sf_dir))).select("name", "nunique", "cardinality", "variant")


@query("target_missingness", BASE + "SELECT name, round(1 - nulls / n, 4)::DOUBLE AS missingness FROM prof")
def target_missingness(spark, sf_dir):
    return T.missingness(profile(named(spark, sf_dir), distinct=False)).select("name", "missingness")


@query("target_dependency")
def target_dependency(spark, sf_dir):
    df = named(spark, sf_dir)
    rows = []
    for name, task, cheap in (("orderStatus", "classification", 1.0), ("totalPrice", "regression", 0.9), ("c_name", "classification", 0.1)):
        rows.append((name, *T.dependency(df, name, task, cheap)))
    return spark.createDataFrame(rows, "name string, dependency double, skipped boolean, reason string")


# Tokens of the name and of the five smallest texts; sample texts are spaced like names.
TEXTS = ["c_name", "c_mktsegment"]
def semantic_sql(columns):
    return f"""texts AS ({per_column(columns, "SELECT '{c}' AS cn, v FROM (SELECT DISTINCT {c} AS v FROM t ORDER BY v LIMIT 5)")}),
  spaced AS (SELECT cn, v, {PLAIN.replace('(name,', '(v,')} AS s FROM texts),
  docs AS (SELECT nm.name, nm.name_match, lower(nm.plain || coalesce(' ' || (SELECT string_agg(s, ' ' ORDER BY v) FROM spaced WHERE cn = nm.name), '')) AS doc
    FROM nm),
  toks AS (SELECT name, tok, count(*) AS tf FROM (SELECT name, unnest(regexp_extract_all(doc, '\\w+')) AS tok FROM docs) GROUP BY ALL),
  wts AS (SELECT name, tok, list_contains([{', '.join(f"'{k}'" for k in names.TARGET_WORDS)}], tok) AS kw,
    tf * CASE WHEN kw THEN ln(26 / 3.0::DOUBLE) + 1 ELSE ln(26 / 2.0::DOUBLE) + 1 END AS w FROM toks),
  sem AS (SELECT name, coalesce(max(w) FILTER (WHERE kw), 0) / sqrt(sum(w * w)) AS s FROM wts GROUP BY name)"""


SEMANTIC_SQL = semantic_sql(TEXTS)


@query(
    "target_semantic",
    BASE + f", nm AS ({NAME_SQL}), {SEMANTIC_SQL} SELECT name, CASE WHEN name_match >= 0.3 THEN 0 ELSE round(s, 4) END::DOUBLE AS semantic,"
    " CASE WHEN name_match >= 0.3 THEN 'name_match_sufficient' END AS semantic_skipped FROM docs JOIN sem USING (name)",
)
def target_semantic(spark, sf_dir):
    df = named(spark, sf_dir)
    p = T.name_match(profile(df, distinct=False))
    return T.semantic(p, T.smallest_texts(df, TEXTS)).select("name", "semantic", "semantic_skipped")


@query(
    "time_order_check",
    """WITH e AS (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS b FROM events),
    o AS (SELECT o_orderdate AS ts, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS b FROM orders)
    SELECT 'events' AS source, count(*)::BIGINT AS n, count(*) FILTER (WHERE ts < b) = 0 OR count(*) FILTER (WHERE ts > b) = 0 AS time_ordered FROM e
    UNION ALL SELECT 'orders', count(*)::BIGINT, count(*) FILTER (WHERE ts < b) = 0 OR count(*) FILTER (WHERE ts > b) = 0 FROM o""",
)
def time_order_check(spark, sf_dir):
    made = None
    for name, key in (("events", "event_id"), ("orders", "o_orderkey")):
        df = table(spark, sf_dir, name)
        ordered = T.is_time_ordered(df, [key])
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n", F.lit(ordered).alias("time_ordered"))
        made = one if made is None else made.unionByName(one)
    return made


# Orders under the name of their customer and a code that stands for it one to one; folds go by the note.
PLANTED = ["note", "code", "customerLabel"]
PLANTED_SQL = f"""SELECT md5(o_orderkey::VARCHAR) AS note, md5(o_custkey::VARCHAR) AS code, c_name AS "customerLabel"
  FROM orders JOIN customer ON o_custkey = c_custkey"""
# A row is predicted right exactly where another fold holds its class, which the code then tells.
PLANTED_SCORE_SQL = f"""f AS (SELECT code, {hash_sql('note', 'fold')} % 3 AS fold FROM t),
  seen AS (SELECT *, count(*) OVER (PARTITION BY code) > count(*) OVER (PARTITION BY code, fold) AS hit FROM f),
  dep AS (SELECT round(avg(acc), 4) AS dependency FROM (SELECT fold, avg(hit::INTEGER) AS acc FROM seen GROUP BY fold))"""


def planted(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customerLabel"))
    rows = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.md5(F.col("o_orderkey").cast("string")).alias("note"), F.md5(F.col("o_custkey").cast("string")).alias("code"), "customerLabel"
    )


@query(
    "target_dependency_classes",
    f"WITH t AS ({PLANTED_SQL}), {PLANTED_SCORE_SQL} SELECT 'with code' AS features, dependency FROM dep"
    " UNION ALL SELECT 'without', 0.0::DOUBLE",
)
def target_dependency_classes(spark, sf_dir):
    """As many classes as customers: with a column that tells them, and with one that only repeats the row's note."""
    df = planted(spark, sf_dir)
    told = T.dependency(df, "customerLabel", "classification", 1.0, ["note"])[0]
    blind = T.dependency(df.withColumn("code", F.md5("note")), "customerLabel", "classification", 1.0, ["note"])[0]
    # Without the code a share of chance hits remains that depends on the trees.
    rows = [("with code", told), ("without", 0.0 if blind < 0.05 else blind)]
    return spark.createDataFrame(rows, "features string, dependency double")


@query(
    "target_ranking_planted",
    f"WITH t AS ({PLANTED_SQL}), prof AS ({profile_sql(PLANTED, [])}), nm AS ({NAME_SQL}), cd AS ({CARD_SQL.format(source='nm')}),"
    f" {semantic_sql(PLANTED)}, {PLANTED_SCORE_SQL}, "
    """r AS (SELECT name, pos, variant AS task_hint, CASE WHEN name = 'note' OR greatest(name_match, cardinality) < 0.3 THEN 0 ELSE dep.dependency END AS dependency,
      round(0.3 * name_match + 0.1 * CASE WHEN pos = 2 THEN 1.0 ELSE round(0.6 + 0.4 * (pos / 2.0), 4) END + 0.2 * cardinality
        + 0.1 * round(1 - nulls / n, 4) + 0.2 * CASE WHEN name = 'note' OR greatest(name_match, cardinality) < 0.3 THEN 0 ELSE dep.dependency END
        + 0.1 * CASE WHEN name_match >= 0.3 THEN 0 ELSE round(s, 4) END, 4)::DOUBLE AS score
      FROM cd JOIN sem USING (name), dep)
    SELECT name, score, task_hint, dependency::DOUBLE AS dependency, CASE WHEN max(score) OVER () > 0.7 THEN 'auto' ELSE 'user_choice_required' END AS confidence_tier FROM r""",
)
def target_ranking_planted(spark, sf_dir):
    """The code tells the label and the label the code; no note comes twice, so nothing tells it."""
    done = T.rank_targets(planted(spark, sf_dir), fold_key=["note"])
    return done.select("name", "score", "task_hint", "dependency", "confidence_tier")


@query("target_ranking")
def target_ranking(spark, sf_dir):
    return T.rank_targets(named(spark, sf_dir)).select(
        "name", "score", "task_hint", "name_match", "position", "cardinality", "missingness", "dependency",
        "dependency_skipped", "semantic", "confidence_tier",
    )


@query(
    "target_ranking_without_models",
    BASE
    + f""", nm AS ({NAME_SQL}), cd AS ({CARD_SQL.format(source='nm')}), {SEMANTIC_SQL},
    r AS (SELECT name, pos, variant AS task_hint, round(0.3 * name_match + 0.1 * {POSITION} + 0.2 * cardinality
      + 0.1 * round(1 - nulls / n, 4) + 0.1 * CASE WHEN name_match >= 0.3 THEN 0 ELSE round(s, 4) END, 4)::DOUBLE AS score
      FROM cd JOIN sem USING (name))
    SELECT name, score, task_hint, CASE WHEN max(score) OVER () > 0.7 THEN 'auto' ELSE 'user_choice_required' END AS confidence_tier FROM r""",
)
def target_ranking_without_models(spark, sf_dir):
    done = T.rank_targets(named(spark, sf_dir), with_models=False)
    return done.select("name", "score", "task_hint", "confidence_tier")


@query(
    "multi_target_flag",
    """WITH b AS (SELECT (c_nationkey < 12) AS a, (c_acctbal > 4000) AS b FROM customer WHERE c_custkey % 6 <> 0),
    j AS (SELECT a, b, count(*) AS n FROM b GROUP BY ALL),
    m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM j),
    mi AS (SELECT greatest(sum(n / t * ln(n::DOUBLE * t / (na * nb))), 0) AS mi FROM m)
    SELECT (SELECT count(*) FROM customer)::BIGINT AS n_rows, mi < 0.5 AS multi_target FROM mi""",
)
def multi_target_flag(spark, sf_dir):
    """`label` and `orderStatus` lead; both are classes and say little about each other."""
    df = named(spark, sf_dir)
    flag = T.multi_target(df, T.rank_targets(df, with_models=False))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(flag).alias("multi_target"))


def _meta_sql():
    target = " OR ".join(f"contains(lower(name), '{w}')" for w in names.META_TARGET_WORDS)
    ids = " OR ".join(f"contains(lower(name), '{w}')" for w in names.ID_WORDS)
    numeric = ["o_orderkey", "o_custkey", "o_totalprice"]
    r = "\nUNION ALL ".join(
        f"SELECT '{a}' AS name, ("
        + " + ".join(f"abs(corr(coalesce({a}, 0), coalesce({b}, 0)))" for b in numeric)
        + ") / 3 AS mean_r FROM t"
        for a in numeric
    )
    rows = per_column(
        ORDERS, "SELECT '{c}' AS name, {i} AS pos, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS u FROM t"
    )
    return f"""WITH t AS ({ORDERS_GAPS_SQL}), prof AS ({rows}), r AS ({r}),
    m AS (SELECT name, pos, n, nulls, u, coalesce(mean_r, 0) AS mean_r, name IN ('o_orderkey', 'o_custkey', 'o_totalprice') AS num,
      ({target}) AS tw, ({ids}) AS iw, name = 'o_orderdate' AS dt FROM prof LEFT JOIN r USING (name)),
    s AS (SELECT name, round(5.0 * (CASE WHEN tw THEN 4 ELSE 0 END - CASE WHEN iw THEN 6 ELSE 0 END) + 2.5 * mean_r + 2.0 * pos / 6
      - CASE WHEN u / n > 0.95 AND (iw OR NOT num) THEN 8 ELSE 0 END - 6.0 * nulls / n - CASE WHEN dt THEN 4 ELSE 0 END, 2)::DOUBLE AS score,
      CASE WHEN dt THEN 'regression' WHEN NOT num THEN 'classification' WHEN u <= 10 THEN 'classification' ELSE 'forecasting' END AS approach FROM m)
    SELECT name, score, approach FROM s WHERE score >= 0"""


@query("target_meta_score", _meta_sql())
def target_meta_score(spark, sf_dir):
    return T.meta_scores(orders_gaps(spark, sf_dir)).select("name", "score", "approach")


@query(
    "target_by_keyword",
    "WITH c AS (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in ORDERS)
    + "]) AS name, generate_subscripts(["
    + ", ".join(f"'{c}'" for c in ORDERS)
    + "], 1) AS pos), k AS (SELECT unnest(["
    + ", ".join(f"'{w}'" for w in names.META_TARGET_WORDS)
    + "]) AS word, generate_subscripts(["
    + ", ".join(f"'{w}'" for w in names.META_TARGET_WORDS)
    + "], 1) AS place) SELECT coalesce((SELECT name FROM c, k WHERE contains(lower(name), word) ORDER BY place, pos LIMIT 1),"
    " (SELECT name FROM c ORDER BY pos DESC LIMIT 1)) AS target, (SELECT count(*) FROM orders)::BIGINT AS n_rows",
)
def target_by_keyword(spark, sf_dir):
    p = profile(table(spark, sf_dir, "orders"), distinct=False)
    n = table(spark, sf_dir, "orders").count()
    return T.first_keyword_target(p).withColumn("n_rows", F.lit(n).cast("bigint"))


@query(
    "target_score_scaled",
    "WITH s AS (" + _meta_sql() + ") SELECT name, round(score / max(score) OVER (), 4) AS scaled,"
    " score / max(score) OVER () >= 0.85 AS preselected FROM s",
)
def target_score_scaled(spark, sf_dir):
    scores = T.meta_scores(orders_gaps(spark, sf_dir))
    return T.scale_scores(scores).select("name", "scaled", "preselected")
