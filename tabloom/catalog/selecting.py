"""Feature selection queries."""

from pyspark.sql import functions as F

from tabloom.catalog.profiling import LINE_GAPS_SQL, LINE_NUMERIC, line_gaps
from tabloom.catalog.registry import per_column, query, table
from tabloom.catalog.series import hash_sql
from tabloom.functions.hashing import key_hash
from tabloom.operators import select as S
from tabloom.operators.neighbours import knn_mutual_information
from tabloom.operators.profile import profile

TARGET = "l_extendedprice"
FEATS = [c for c in LINE_NUMERIC if c != TARGET]

# Lineitem with a twin of the target and products of features.
WIDE_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1 - l_discount) AS net, l_quantity * 2.0 + l_tax AS twin,
  l_extendedprice + l_discount * 600000.0 AS mix FROM lineitem"""
WIDE_FEATS = [*FEATS, "net", "twin", "mix"]


def wide(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LINE_NUMERIC)
    return li.withColumns(
        {
            "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "twin": F.col("l_quantity") * 2.0 + F.col("l_tax"),
            "mix": F.col("l_extendedprice") + F.col("l_discount") * 600000.0,
        }
    )


@query(
    "variance_filter",
    "WITH t AS (SELECT *, 1.0::DOUBLE AS constant FROM (" + LINE_GAPS_SQL + ")), v AS ("
    + per_column(
        [*LINE_NUMERIC, "constant"], "SELECT '{c}' AS feature, coalesce(var_pop({c}), 0) AS variance FROM t"
    )
    + ") SELECT feature, round(sqrt(variance), 4) AS deviation, variance >= 0.01 AS kept FROM v",
)
def variance_filter(spark, sf_dir):
    df = line_gaps(spark, sf_dir).withColumn("constant", F.lit(1.0))
    kept, found = S.variance_filter(df, [*LINE_NUMERIC, "constant"])
    rows = [(f, v, f in kept) for f, v in found.items()]
    made = spark.createDataFrame(rows, "feature string, variance double, kept boolean")
    return made.select("feature", F.round(F.sqrt("variance"), 4).alias("deviation"), "kept")


@query(
    "pearson_importance",
    "WITH t AS (" + LINE_GAPS_SQL + ") "
    + per_column(
        FEATS,
        "SELECT '{c}' AS feature, round(abs(corr(coalesce({c}, 0), coalesce(l_extendedprice, 0))), 4) AS importance FROM t",
    ),
)
def pearson_importance(spark, sf_dir):
    return S.pearson_importance(line_gaps(spark, sf_dir), FEATS, TARGET)


def _walk_sql(source=WIDE_SQL, feats=tuple(WIDE_FEATS), least=None):
    """Features by |r| with the target, and which the walk keeps; with ``least``, of those with that variance only."""
    target = per_column(
        list(feats), "SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS target_r, var_pop({c}) AS variance FROM t"
    )
    pairs = "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM t" for a in feats for b in feats)
    varied = "" if least is None else f" WHERE variance >= {least}"
    return f"""WITH RECURSIVE t AS MATERIALIZED ({source}), y AS ({target}), p AS MATERIALIZED ({pairs}),
    o AS MATERIALIZED (SELECT feature, target_r, row_number() OVER (ORDER BY target_r DESC) AS place FROM y{varied}),
    bad AS MATERIALIZED (SELECT f.place, list(g.place) AS clash FROM o f JOIN p ON p.a = f.feature AND p.r > 0.95
      JOIN o g ON g.feature = p.b AND g.place < f.place GROUP BY f.place),
    walk AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS kept
      UNION ALL SELECT o.place, CASE WHEN len(list_intersect(coalesce(bad.clash, []::BIGINT[]), kept)) > 0 THEN kept
        ELSE list_append(kept, o.place) END
      FROM walk JOIN o ON o.place = walk.place + 1 LEFT JOIN bad ON bad.place = o.place)
    SELECT o.feature, round(o.target_r, 4) AS target_r, list_contains(w.kept, o.place) AS kept FROM o,
      (SELECT kept FROM walk ORDER BY place DESC LIMIT 1) w"""


@query("correlation_filter", _walk_sql())
def correlation_filter(spark, sf_dir):
    kept, r = S.correlation_filter(wide(spark, sf_dir), WIDE_FEATS, TARGET)
    rows = [(f, v, f in kept) for f, v in r.items()]
    made = spark.createDataFrame(rows, "feature string, target_r double, kept boolean")
    return made.withColumn("target_r", F.round("target_r", 4))


def bin_sql(column: str, source: str, bins: int = 10) -> str:
    cuts = " + ".join(f"({column} > (SELECT quantile_cont({column}, {i / bins}) FROM {source}))::INTEGER" for i in range(1, bins))
    return f"({cuts})"


def mi_sql(feats, target, source, bins=10):
    """MI of each binned feature with the binned target, from the joint counts."""
    qs = ", ".join(f"quantile_cont({c}, [{', '.join(str(i / bins) for i in range(1, bins))}]) AS q_{c}" for c in [*feats, target])
    # Equal cut points count once.
    binned = ", ".join(
        f"len(list_filter(list_distinct(q_{c}), lambda q: q < {c})) AS {c}" for c in [*feats, target]
    )
    rows = "\nUNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS a, {target} AS b FROM binned" for f in feats)
    return f"""src AS MATERIALIZED ({source}), q AS MATERIALIZED (SELECT {qs} FROM src),
    binned AS MATERIALIZED (SELECT {binned} FROM src, q),
    joint AS (SELECT feature, a, b, count(*) AS n FROM ({rows}) GROUP BY ALL),
    marg AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, a) AS na, sum(n) OVER (PARTITION BY feature, b) AS nb,
      sum(n) OVER (PARTITION BY feature) AS t FROM joint),
    mi AS (SELECT feature, greatest(sum(n / t * ln(n::DOUBLE * t / (na * nb))), 0) AS mi FROM marg GROUP BY feature)"""


@query(
    "mutual_information",
    "WITH " + mi_sql(["l_quantity"], "l_extendedprice", "SELECT l_quantity, l_extendedprice FROM lineitem")
    + " SELECT round(mi, 6) AS mi FROM mi",
)
def mutual_information(spark, sf_dir):
    done = S.mutual_information(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return done.select(F.round("mi", 6).alias("mi"))


@query(
    "mutual_information_categories",
    """WITH j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL),
    m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM j)
    SELECT round(greatest(sum(n / t * ln(n::DOUBLE * t / (na * nb))), 0), 6) AS mi FROM m""",
)
def mutual_information_categories(spark, sf_dir):
    done = S.mutual_information(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    return done.select(F.round("mi", 6).alias("mi"))


@query(
    "mi_select",
    "WITH "
    + mi_sql(WIDE_FEATS, TARGET, WIDE_SQL)
    + " SELECT feature, round(mi, 6) AS mi FROM mi ORDER BY mi.mi DESC, feature LIMIT 5",
)
def mi_select(spark, sf_dir):
    done = S.mi_select(wide(spark, sf_dir), WIDE_FEATS, TARGET, k=5)
    return done.select("feature", F.round("mi", 6).alias("mi"))


REPORT_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _report_sql():
    pairs = [(a, b) for i, a in enumerate(REPORT_FEATS) for b in REPORT_FEATS[i + 1 :]]
    products = ", ".join(f"{a} * {b} AS {a}_x_{b}" for a, b in pairs)
    source = f"SELECT {', '.join(REPORT_FEATS)}, {products}, l_extendedprice FROM lineitem"
    walk = _walk_sql(source, tuple([*REPORT_FEATS, *[f"{a}_x_{b}" for a, b in pairs]]), 0.01)
    return f"""WITH w AS ({walk}), c AS (SELECT count(*) AS varied, count(*) FILTER (WHERE kept) AS kept FROM w)
    SELECT unnest(['stage0_original', 'stage1_generated', 'stage2_after_variance', 'stage3_after_correlation', 'stage4_after_mi', 'not_numeric']) AS stage,
      unnest([5, {len(pairs)}, varied, kept, kept, 1])::BIGINT AS n FROM c"""


@query("selection_report", _report_sql())
def selection_report(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return S.selection_report(df, S.run_selection(df, [*REPORT_FEATS, "l_returnflag"], TARGET))


def _keep_sql(rule):
    cols = [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "net", "twin",
        "mix",
    ]
    fill = "coalesce({c}, 0)" if rule == "a" else "{c}"
    y = "coalesce(l_extendedprice, 0)" if rule == "a" else "l_extendedprice"
    r = per_column(cols, f"SELECT '{{c}}' AS feature, corr({fill}, {y}) AS r FROM t")
    return f"WITH t AS MATERIALIZED ({WIDE_SQL}), r AS ({r}) "


@query(
    "default_features_a",
    _keep_sql("a")
    + """SELECT feature, round(r, 4) AS r, 'plain' AS encoding FROM r WHERE abs(r) < 0.98 AND abs(r) >= 0.1""",
)
def default_features_a(spark, sf_dir):
    return S.default_features(wide(spark, sf_dir), TARGET, "a")


@query(
    "default_features_b",
    """WITH t AS (SELECT *, o_totalprice * 2 + o_custkey * 100 AS o_charge FROM orders), n AS (SELECT count(*) AS n FROM t)
    SELECT 'o_orderstatus' AS feature, NULL::DOUBLE AS r, 'one_hot' AS encoding FROM t
      HAVING count(DISTINCT o_orderstatus) BETWEEN 2 AND 25 AND count(DISTINCT o_orderstatus) < 0.9 * count(*)
    UNION ALL SELECT 'o_orderpriority', NULL, 'one_hot' FROM t
      HAVING count(DISTINCT o_orderpriority) BETWEEN 2 AND 25 AND count(DISTINCT o_orderpriority) < 0.9 * count(*)
    UNION ALL SELECT 'o_orderdate', NULL, 'periodic' FROM t HAVING count(*) > 0
    UNION ALL SELECT 'o_orderkey', round(corr(o_orderkey, o_totalprice), 4), 'plain' FROM t
      HAVING abs(corr(o_orderkey, o_totalprice)) BETWEEN 0.05 AND 0.9699999
    UNION ALL SELECT 'o_custkey', round(corr(o_custkey, o_totalprice), 4), 'plain' FROM t
      HAVING abs(corr(o_custkey, o_totalprice)) BETWEEN 0.05 AND 0.9699999
    UNION ALL SELECT 'o_charge', round(corr(o_charge, o_totalprice), 4), 'plain' FROM t
      HAVING abs(corr(o_charge, o_totalprice)) BETWEEN 0.05 AND 0.9699999""",
)
def default_features_b(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return S.default_features(
        o.withColumn("o_charge", F.col("o_totalprice") * 2 + F.col("o_custkey") * 100), "o_totalprice", "b"
    )


@query(
    "feature_labels",
    _keep_sql("a")
    + """, q AS (SELECT feature, round(r, 4) AS r FROM r)
    SELECT feature, r, CASE WHEN abs(r) >= 0.98 THEN 'leak' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.2 THEN 'moderate'
      WHEN abs(r) > 0 THEN 'weak' ELSE 'none' END AS strength, false AS id_like, abs(r) > 0 AND abs(r) < 0.95 AS safe FROM q""",
)
def feature_labels(spark, sf_dir):
    return S.feature_labels(wide(spark, sf_dir), TARGET)


@query(
    "feature_groups",
    """SELECT 'c_custkey' AS name, 'influential' AS feature_group, count(DISTINCT c_custkey)::BIGINT AS nunique FROM customer
    UNION ALL SELECT 'c_name', 'unique_id', count(DISTINCT c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', 'influential', count(DISTINCT c_nationkey) FROM customer
    UNION ALL SELECT 'c_acctbal', 'influential', count(DISTINCT c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'category', count(DISTINCT c_mktsegment) FROM customer
    UNION ALL SELECT 'row_id', 'unique_id', count(DISTINCT c_custkey) FROM customer
    UNION ALL SELECT 'load_date', 'date_time', 1 FROM customer HAVING count(*) > 0""",
)
def feature_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    df = c.withColumns({"row_id": F.col("c_custkey"), "load_date": F.lit("2024-01-01").cast("date")})
    return S.feature_groups(profile(df))


# A balance and a number that follows it in part; the digest spreads the rest.
NEAR_SQL = f"""SELECT c_custkey, c_acctbal AS a, c_acctbal + {hash_sql('c_custkey', 'blur')} / 4294967296.0 * 4000 AS b,
  {hash_sql('c_custkey', 'u')} / 4294967296.0 - 0.5 AS u, {hash_sql('c_custkey', 'v')} / 4294967296.0 - 0.5 AS v FROM customer"""


@query(
    "mutual_information_neighbours",
    f"""WITH t AS ({NEAR_SQL}), f AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(abs(a)) / stddev_pop(a) AS ma, avg(abs(b)) / stddev_pop(b) AS mb FROM t),
    p AS MATERIALIZED (SELECT c_custkey AS i, a / sa + 1e-10 * greatest(1, ma) * u AS x, b / sb + 1e-10 * greatest(1, mb) * v AS y FROM t, f),
    d AS MATERIALIZED (SELECT p.i, abs(p.x - q.x) AS dx, abs(p.y - q.y) AS dy FROM p, p AS q),
    k AS (SELECT i, greatest(dx, dy) AS r FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY greatest(dx, dy)) = 4),
    c AS (SELECT i, count(*) FILTER (WHERE dx < r * (1 - 1e-9)) AS cx, count(*) FILTER (WHERE dy < r * (1 - 1e-9)) AS cy FROM d JOIN k USING (i) GROUP BY i),
    h AS MATERIALIZED (SELECT m, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / (m - 1)) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS psi
      FROM (SELECT unnest(range(2, (SELECT count(*) + 2 FROM p))) AS m) UNION ALL SELECT 1, -0.5772156649015329)
    SELECT round(greatest(any_value(hn.psi) + 0.9227843350984671 - avg(hx.psi) - avg(hy.psi), 0), 5) AS mi, count(*)::BIGINT AS n
    FROM c JOIN h AS hx ON hx.m = cx JOIN h AS hy ON hy.m = cy JOIN h AS hn ON hn.m = (SELECT count(*) FROM p)""",
)
def mutual_information_neighbours(spark, sf_dir):
    """Cells of about sixty rows."""
    key = F.col("c_acctbal") + key_hash(["c_custkey"], "blur") / 2**32 * 4000
    frame = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), key.alias("b"))
    done = knn_mutual_information(frame, "a", "b", ["c_custkey"], cell_rows=64)
    return done.select(F.round("mi", 5).alias("mi"), "n")
