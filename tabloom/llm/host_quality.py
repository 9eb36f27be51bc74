"""Quality rules with verdicts on whole hosts, in DataFrame functions only.

Every document is measured (words, symbols, repeated lines, repeated 8-word windows). A document that
breaks a rule goes and counts as a failure of its host. A host's failure rate is shrunk towards the corpus by a
beta prior whose two parameters are estimated from the spread of all hosts' rates. The shrunk rate then judges the
host's other documents: over the prior's mean, it tightens every limit by as many times as it is higher, and hosts
whose shrunk rate is above ``host_limit`` are rejected as a whole.

Defined cases: a null text has no words and fails; null hosts form one host of their own; repeated rows
count once each; an empty table gives an empty table; other columns pass through untouched. With one host
only, or no failures, or nothing but failures, the prior is uniform (1, 1).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import bind, free_name, shield, stored, words

WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the document rules and of the host verdict."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbols_per_word: float = 0.5
    host_limit: float = 0.8
    #: Hosts above the prior's mean up to this number are sent to all tasks, more are joined by shuffle.
    broadcast_hosts: int = 100_000


def repeat_words(w: Column) -> Column:
    """Words inside windows of 8 words that occur at least twice in the array."""

    def of_windows(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_ordered(s):
            twin = F.filter(
                s, lambda e, j: (e.h == F.get(s, j - 1).h) | (e.h == F.get(s, j + 1).h)
            )
            places = F.array_sort(F.transform(twin, lambda e: e.i))

            def covered(p):
                widths = F.transform(
                    p, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW)))
                )
                return F.aggregate(widths, F.lit(0).cast("bigint"), lambda a, x: a + x)

            return bind(places, covered)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(bind(ordered, of_ordered))

    def of_words(a):
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(a) - WINDOW), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(WINDOW)])
        )
        return F.when(F.size(a) < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(bind(hashes, of_windows))

    return bind(w, of_words)


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of one text, as a struct."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    return F.struct(
        bind(
            words(whole),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        bind(
            lines,
            lambda a: F.struct(
                F.size(a).cast("bigint").alias("n_lines"),
                (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
            ),
        ).alias("l"),
    )


def fails(q: Column, rules: Rules, strictness: Column, symbols: bool = True) -> Column:
    """Whether measures break a rule whose limits are ``strictness`` times as tight."""
    few = q.n_words < rules.min_words * strictness
    repeated = 100 * q.n_repeat_words * strictness > rules.max_repeat_pct * q.n_words
    return few | repeated | (q.n_symbols * strictness > rules.max_symbols_per_word * q.n_words) if symbols else few | repeated


def measured(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``df`` with a struct column ``quality`` of measures, ``base_failed`` and ``failed`` (any rule)."""
    raw = df.withColumn("quality", measures(F.col(text)))
    q = F.col("quality")
    flat = raw.withColumn(
        "quality",
        F.struct(
            q.w.n_words.alias("n_words"), q.w.word_chars.alias("word_chars"), q.n_symbols.alias("n_symbols"),
            q.l.n_lines.alias("n_lines"), q.l.n_dup_lines.alias("n_dup_lines"), q.w.n_repeat_words.alias("n_repeat_words"),
        ),
    )
    once = F.lit(1)
    base = fails(q, rules, once, symbols=False).alias("base_failed")
    return flat.withColumn("quality", F.struct("quality.*", base, fails(q, rules, once).alias("failed")))


def host_rates(df: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, strictness, rejected. ``df`` comes from ``measured``."""
    hosts = df.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("quality.failed").cast("bigint")).alias("n_failed")
    )
    alpha, beta = beta_prior(hosts)
    rate = (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta)
    strictness = F.greatest(F.lit(1.0), rate / F.lit(alpha / (alpha + beta)))
    return hosts.withColumns({"rate": rate, "strictness": strictness, "rejected": rate > rules.host_limit})


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Method of moments over all hosts' failure rates; one row reaches the driver."""
    rate = F.col("n_failed") / F.col("n_docs")
    row = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
        F.var_samp(rate).alias("spread"), F.avg(1 / F.col("n_docs")).alias("inverse"),
    ).first()
    if not row.k or row.k < 2 or not 0 < row.f < row.n:
        return 1.0, 1.0
    mean = row.f / row.n
    noise = mean * (1 - mean)
    between = max(row.spread - noise * row.inverse, noise * 1e-4)
    strength = max(noise / between - 1, 1.0)
    return mean * strength, (1 - mean) * strength


def judged_measured(df: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``df`` from ``measured`` with ``kept``: no rule broken, within the limits of its host, and no rejected host.

    The measured rows are stored once, since both the host rates and the result need them.
    """
    rows = stored(df.drop("kept"), "quality-measured")
    verdict, times, out = free_name(rows, "host_name"), free_name(rows, "host_strictness"), free_name(rows, "host_out")
    judged = host_rates(rows, host, rules).filter("rejected OR strictness > 1")
    judged = judged.select(F.col("host").alias(verdict), F.col("strictness").alias(times), F.col("rejected").alias(out))
    judged = stored(judged, "quality-hosts")
    if judged.count() <= rules.broadcast_hosts:
        judged = F.broadcast(judged)
    joined = rows.join(judged, rows[host].eqNullSafe(judged[verdict]), "left")
    broken = fails(F.col("quality"), rules, F.coalesce(F.col(times), F.lit(1.0)))
    return joined.withColumn("kept", ~broken & ~F.coalesce(F.col(out), F.lit(False))).drop(verdict, times, out)


def survivors(df: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows that stay, with the columns of ``df``."""
    if text in ("quality", "kept") or host in ("quality", "kept"):
        raise ValueError("the text and host columns cannot be called quality or kept")
    rows, back = shield(df, ("quality", "kept"))
    judged = judged_measured(measured(rows, text, rules), host, rules)
    return judged.filter("kept").select(*rows.columns).withColumnsRenamed(back)
