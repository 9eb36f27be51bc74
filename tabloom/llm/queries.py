"""The registered queries of these operators and, where SQL can say it, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.registry import query, table
from tabloom.llm import (
    bpe, exact_dedup, host_quality, katz, packing, pii, pivot_search, resampling, simhash_dedup, token_counts, url_rules, warc, whitening,
)
from tabloom.llm.common import stored

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_SQL = f"""WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS s FROM documents),
  g AS (SELECT s, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM d JOIN g USING (s)"""


@query("op6_exact_dedup", EXACT_SQL)
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicated(table(spark, sf_dir, "documents"), prefer="largest", carry=False)


QUALITY_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
  twin AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
  r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twin, range(8) AS t(k) GROUP BY doc_id),
  l AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words,
      length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
  b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
  f AS (SELECT *, base_failed OR n_symbols > 0.5 * n_words AS failed FROM b),
  h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM f GROUP BY source),
  a AS (SELECT count(*) AS k, sum(f) AS f, sum(n) AS n, sum(f) / sum(n) AS mean, var_samp(f / n) AS spread,
    avg(1 / n) AS inverse FROM h),
  s AS (SELECT *, greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * inverse,
    mean * (1 - mean) * 1e-4) - 1, 1.0) AS strength FROM a),
  p AS (SELECT CASE WHEN k >= 2 AND f > 0 AND f < n THEN mean * strength ELSE 1 END AS alpha,
    CASE WHEN k >= 2 AND f > 0 AND f < n THEN (1 - mean) * strength ELSE 1 END AS beta FROM s),
  v AS (SELECT source, (f + alpha) / (n + alpha + beta) AS rate, greatest(1.0::DOUBLE, rate / (alpha / (alpha + beta))) AS s FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (n_words < 20 * s OR 100 * n_repeat_words * s > 30 * n_words OR n_symbols * s > 0.5 * n_words) AND rate <= 0.8 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""


@query("op8_quality_rules", QUALITY_SQL)
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = host_quality.Rules()
    measured = host_quality.measured(docs, "text", rules).drop("text", "lang", "n_chars")
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return host_quality.judged_measured(measured, "source", rules).select("doc_id", *[q[n].alias(n) for n in names], "kept")


@query("op3_simhash_dedup")
def op3_simhash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored(simhash_dedup.with_fingerprints(docs).drop("text"), "fingerprinted")
    found = simhash_dedup.with_components(rows)
    return found.select("doc_id", simhash_dedup.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op10_pii_surrogates")
def op10_pii_surrogates(spark, sf_dir):
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_units")


@query("op1_bestfit_packing")
def op1_bestfit_packing(spark, sf_dir):
    # Nothing else runs beside it, so there is room for more words than in the pipeline.
    found = packing.packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), words=250_000)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark, sf_dir):
    both = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.counted(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
  g AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
  bits AS (SELECT h, string_agg(right(('0x' || c)::INTEGER::BIT::VARCHAR, 4), '' ORDER BY i) AS b
    FROM (SELECT DISTINCT h, unnest(range(1, 41)) AS i, substr(h, i::INTEGER, 1) AS c FROM p) GROUP BY h),
  codes AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (substr(b, k, 1)::INTEGER * 16 + substr(b, k + 1, 1)::INTEGER * 8 + substr(b, k + 2, 1)::INTEGER * 4
        + substr(b, k + 3, 1)::INTEGER * 2 + substr(b, k + 4, 1)::INTEGER), 1), '' ORDER BY k) AS d
    FROM (SELECT h, b, unnest(range(1, 161, 5))::INTEGER AS k FROM bits) GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN g USING (h) JOIN codes USING (h)"""


@query("op4_warc_round_trip", WARC_SQL)
def op4_warc_round_trip(spark, sf_dir):
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select(
        F.col("record_key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_key").cast("bigint").alias("refers_to"),
    )


#: The stated rules, and words that no good host carries in a label.
STATED_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
HOST_WORDS = ("spam", "cheap-pills", "casino", "porn", "xxx", "warez", "payday-loans", "replica-watches")


def url_rule_list():
    stated = [url_rules.host_path_rule(text, action) for text, action in STATED_RULES]
    return [*stated, *[url_rules.host_word_rule(word) for word in HOST_WORDS]]


_STATED_SQL = "\n    ".join(
    f"WHEN ('.' || host) LIKE '%.{t.partition('/')[0]}' AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t}'"
    for t, _ in sorted(STATED_RULES, key=lambda r: -len(r[0]))
)
URL_SQL = rf"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
  r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
  s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
  t AS (SELECT *, CASE {_STATED_SQL} END AS rule FROM s)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ({", ".join(f"'{t}'" for t, a in STATED_RULES if a == "block")}) THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[.-])({"|".join(HOST_WORDS)})([.:-]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM t"""


@query("op9_url_filters", URL_SQL)
def op9_url_filters(spark, sf_dir):
    found = url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), url_rule_list())
    stated = F.when(F.col("rule_tier") == 2, F.col("rule"))
    return found.select("page_id", "host", "path", stated.alias("rule"), "verdict")


@query("op5_katz_scores")
def op5_katz_scores(spark, sf_dir):
    found = katz.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_importance_resampling")
def op11_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.scored(docs, table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = model.identity_error(vectors)
    rows = model.transform(vectors, carry_vector=False)
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place_", "whitened"))
    shares = F.array(*[F.lit(x) for x in model.explained]) if model.explained else F.array(F.lit(0.0))
    return rows.select(
        "vec_id", (F.col("place_") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place_") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


TOP_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


@query("op13_exact_top_k", TOP_SQL)
def op13_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = pivot_search.nearest_rows(vectors, F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")
