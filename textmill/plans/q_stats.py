"""Registered queries: sources S4, projections P1-P12, aggregations A1-A13,
sorts O1-O5, set operations U1-U2.  Floats are rounded to 6 decimals (12 for
densities) on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import projection as P
from textmill.operators import stats as A
from textmill.operators.labels import one_hot
from textmill.plans import sqlfrag as S
from textmill.plans.registry import query, sql_lit, table
from textmill.sources.io import read_parquet

LANGS = ["en", "fr", "de", "es"]


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("s4_read_parquet", sql="SELECT doc_id, lang, n_chars FROM documents")
def q_read_parquet(spark, sf):
    return read_parquet(spark, f"{sf}/documents.parquet", n=8).select("doc_id", "lang", "n_chars")


@query("p1_p2_select_drop_nulls",
       sql="SELECT role, text FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL")
def q_select_drop(spark, sf):
    return P.drop_nulls(P.select_cols(table(spark, sf, "conversations"), "role", "text"))


@query("p3_cast_label", sql="""
SELECT doc_id, TRY_CAST(TRY_CAST(substr(source, 4) AS DOUBLE) AS INTEGER) AS label FROM documents""")
def q_cast_label(spark, sf):
    d = docs(spark, sf).select("doc_id", F.substring("source", 4, 100).alias("label"))
    return P.cast_label(d, "label")


@query("p4_rename_cols", sql="SELECT doc_id AS id, quality AS q, toxic AS t FROM labels")
def q_rename(spark, sf):
    return P.rename_cols(table(spark, sf, "labels"), ["id", "q", "t"])


@query("p5_drop_cols", sql="SELECT doc_id, lang, source, n_chars FROM documents")
def q_drop(spark, sf):
    return P.drop_cols(docs(spark, sf), "text")


@query("p6_min_length", sql="SELECT doc_id FROM documents WHERE length(text) >= 2")
def q_min_length(spark, sf):
    return P.min_length(docs(spark, sf), "text", 2).select("doc_id")


@query("p7_of_class", sql="SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def q_of_class(spark, sf):
    return P.of_class(docs(spark, sf).select("doc_id", "lang"), "lang", "fr")


@query("p9_having_token_freq", sql=f"""
SELECT token, count(*) AS freq FROM (SELECT unnest({S.tokenize('text')}) AS token FROM documents)
GROUP BY token HAVING count(*) > 4""")
def q_having(spark, sf):
    counts = A.word_counts(docs(spark, sf).select(T.tokenize("text").alias("tokens")), "tokens")
    return P.having(counts, "freq", 4)


@query("p10_tag_split", sql="""
SELECT doc_id, CASE WHEN n_chars < 500 THEN 'tiny' WHEN n_chars < 1000 THEN 'short' ELSE 'not_set' END AS split
FROM documents""")
def q_tag_split(spark, sf):
    d = docs(spark, sf).select("doc_id", "n_chars")
    rules = [(F.col("n_chars") < 1000, "short"), (F.col("n_chars") < 500, "tiny")]
    return P.tag_split(d, rules).select("doc_id", "split")


@query("p11_first_result", sql="SELECT doc_id, lang AS prediction FROM documents")
def q_first_result(spark, sf):
    d = docs(spark, sf).select("doc_id", F.array(F.struct(F.col("lang").alias("result"))).alias("class"))
    return P.first_result(d, "class").select("doc_id", "prediction")


LANG_CODES = {"en": 0, "fr": 1, "de": 2, "es": 3}


@query("p12_map_label", sql="""
SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END AS code
FROM documents""")
def q_map_label(spark, sf):
    return P.map_label(docs(spark, sf).select("doc_id", "lang"), "lang", LANG_CODES, out="code") \
        .select("doc_id", "code")


@query("a1_value_counts", sql="SELECT lang, count(*) AS count FROM documents GROUP BY lang")
def q_value_counts(spark, sf):
    return A.value_counts(docs(spark, sf), "lang")


@query("a1_value_counts_role", sql="SELECT role, count(*) AS count FROM conversations GROUP BY role")
def q_value_counts_role(spark, sf):
    return A.value_counts(table(spark, sf, "conversations"), "role")


@query("a4_length_stats", sql="""
SELECT CAST(max(length(text)) AS BIGINT) AS max_len, CAST(min(length(text)) AS BIGINT) AS min_len,
       round(avg(length(text)), 6) AS mean_len FROM documents""")
def q_length_stats(spark, sf):
    d = docs(spark, sf).select(F.length("text").cast("bigint").alias("len"))
    return A.length_stats(d, "len").withColumn("mean_len", F.round("mean_len", 6))


@query("a5_describe_words", sql=f"""
SELECT count(w) AS count, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std,
       round(min(w)::DOUBLE, 6) AS min, round(quantile_cont(w, 0.25), 6) AS p25,
       round(quantile_cont(w, 0.5), 6) AS p50, round(quantile_cont(w, 0.75), 6) AS p75,
       round(max(w)::DOUBLE, 6) AS max
FROM (SELECT CAST({S.n_words('text')} AS BIGINT) AS w FROM documents)""")
def q_describe(spark, sf):
    d = docs(spark, sf).select(T.n_words("text").cast("bigint").alias("w"))
    out = A.describe(d, "w")
    return out.select("count", *[F.round(c, 6).alias(c) for c in out.columns if c != "count"])


@query("a6_quantile", sql="SELECT round(quantile_cont(length(text), 0.9), 6) AS q FROM documents")
def q_quantile(spark, sf):
    d = docs(spark, sf).select(F.length("text").alias("len"))
    return A.quantile(d, "len", 0.9).select(F.round("q", 6).alias("q"))


@query("a7_histogram", sql="""
WITH v AS (SELECT length(text)::DOUBLE AS x FROM documents),
     b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
     c AS (SELECT CAST(least(floor((x - lo) * 100 / (hi - lo)), 99) AS BIGINT) AS bin, count(*) AS n
           FROM v, b GROUP BY 1)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 100), 6) AS lower,
       round(lo + (g.bin + 1) * ((hi - lo) / 100), 6) AS upper, coalesce(c.n, 0) AS count
FROM (SELECT range AS bin FROM range(100)) g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin""")
def q_histogram(spark, sf):
    d = docs(spark, sf).select(F.length("text").alias("len"))
    h = A.histogram(d, "len", 100)
    return h.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "count")


@query("a8_density", sql="""
WITH v AS (SELECT length(text)::DOUBLE AS x FROM documents),
     s AS (SELECT count(x) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM v),
     p AS (SELECT n, sd * pow(n, -0.2) AS h, lo - 0.5 * (hi - lo) AS start,
                  ((hi + 0.5 * (hi - lo)) - (lo - 0.5 * (hi - lo))) / 999 AS step FROM s),
     w AS (SELECT x AS v, count(*) AS w FROM v GROUP BY x),
     g AS (SELECT range AS point FROM range(1000)),
     d AS (SELECT g.point, sum(w.w * exp(-0.5 * ((p.start + g.point * p.step - w.v) / p.h)
                                      * ((p.start + g.point * p.step - w.v) / p.h)))
                          * (1.0 / (p.n * p.h * sqrt(2 * pi()))) AS density
           FROM g, p, w GROUP BY g.point, p.n, p.h)
SELECT g.point, round(p.start + g.point * p.step, 6) AS x, round(coalesce(d.density, 0.0), 12) AS density
FROM g CROSS JOIN p LEFT JOIN d ON g.point = d.point""")
def q_density(spark, sf):
    d = docs(spark, sf).select(F.length("text").alias("len"))
    k = A.density(d, "len", grid=1000)
    return k.select("point", F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


@query("a9_word_counts", sql=f"""
SELECT token, count(*) AS freq FROM (SELECT unnest({S.tokenize('text')}) AS token FROM documents)
GROUP BY token""")
def q_word_counts(spark, sf):
    return A.word_counts(docs(spark, sf).select(T.tokenize("text").alias("tokens")), "tokens")


@query("a10_min_count", sql=f"""
SELECT token, count(*) AS freq FROM (SELECT unnest({S.tokenize('text')}) AS token FROM documents)
GROUP BY token HAVING count(*) >= 2""")
def q_min_count(spark, sf):
    counts = A.word_counts(docs(spark, sf).select(T.tokenize("text").alias("tokens")), "tokens")
    return A.min_count(counts, 2)


@query("a10_min_count_report", sql=f"""
SELECT count(*) AS words_before, CAST(count_if(freq >= 2) AS BIGINT) AS words_after FROM
(SELECT token, count(*) AS freq FROM (SELECT unnest({S.tokenize('text')}) AS token FROM documents) GROUP BY token)""")
def q_min_count_report(spark, sf):
    counts = A.word_counts(docs(spark, sf).select(T.tokenize("text").alias("tokens")), "tokens")
    return A.min_count_report(counts, 2)


@query("a11_distinct_labels", sql="""
SELECT role, min(conv_id * 1000000 + turn) AS first_seen FROM conversations GROUP BY role""")
def q_distinct_labels(spark, sf):
    c = table(spark, sf, "conversations").withColumn("pos", F.col("conv_id") * 1000000 + F.col("turn"))
    return A.distinct_labels(c, "role", "pos")


@query("a12_label_totals", sql="""
SELECT sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS is_en,
       sum(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END)::BIGINT AS is_fr,
       sum(CASE WHEN lang = 'de' THEN 1 ELSE 0 END)::BIGINT AS is_de,
       sum(CASE WHEN lang = 'es' THEN 1 ELSE 0 END)::BIGINT AS is_es FROM documents""")
def q_label_totals(spark, sf):
    d = one_hot(docs(spark, sf).select("lang"), "lang", LANGS)
    return A.label_totals(d, [f"is_{v}" for v in LANGS])


@query("a13_row_count", sql="SELECT source, count(*) AS rows FROM documents GROUP BY source")
def q_row_count(spark, sf):
    return A.row_count(docs(spark, sf), "source")


@query("o2_top_tokens", sql=f"""
SELECT token, count(*) AS freq FROM (SELECT unnest({S.tokenize('text')}) AS token FROM documents)
GROUP BY token ORDER BY freq DESC, token LIMIT 120""")
def q_top_tokens(spark, sf):
    counts = A.word_counts(docs(spark, sf).select(T.tokenize("text").alias("tokens")), "tokens")
    return A.top_k(counts, 120, F.desc("freq"), F.asc("token"))


@query("o5_shuffle", sql=f"SELECT doc_id, {S.seeded_hash(7, 'doc_id')} AS order_key FROM documents")
def q_shuffle(spark, sf):
    return A.shuffle(docs(spark, sf).select("doc_id"), 7)


@query("u1_stack", sql="""
SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'fr'""")
def q_stack(spark, sf):
    """All classes stacked, the one of ``fr`` once more."""
    d = docs(spark, sf).select("doc_id", "lang")
    rest = d.where(F.col("lang").isNotNull() & ~F.col("lang").isin("fr", "de"))
    fr, de = P.of_class(d, "lang", "fr"), P.of_class(d, "lang", "de")
    return A.stack(fr, de, rest, fr)


def _default_stops_sql() -> str:
    return "(VALUES " + ", ".join(f"({sql_lit(w)})" for w in T.default_stop_words()) + ") s(word)"


@query("u2_stop_list", sql=f"""
SELECT DISTINCT word FROM (
  SELECT word FROM {_default_stops_sql()}
  UNION ALL
  SELECT token AS word FROM (SELECT token, count(*) AS freq FROM
     (SELECT unnest({S.tokenize('text')}) AS token FROM documents) GROUP BY token
     ORDER BY freq DESC, token LIMIT 20))""")
def q_stop_list(spark, sf):
    counts = A.word_counts(docs(spark, sf).select(T.tokenize("text").alias("tokens")), "tokens")
    frequent = A.top_k(counts, 20, F.desc("freq"), F.asc("token")).select("token")
    return A.stop_list(spark, T.default_stop_words(), frequent)
