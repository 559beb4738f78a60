"""Registered queries: rank H1 (W2, W3), balancing and splitting B1-B7, K1,
J2, J7, A3, A13, P8, and label codes L1-L5.

Multi-class stand-in: ``documents.lang`` (en 62 %, three small classes), so
the hot class really is hot.  Every oracle reproduces the seeded md5 draws
with DuckDB's md5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions.hashing import seeded_hash
from textmill.operators import labels as L
from textmill.operators import sampling as B
from textmill.operators.projection import of_split
from textmill.operators.rank import bucketed_rank, hash_bucket
from textmill.operators.stats import row_count, split_leakage
from textmill.plans.registry import query, table
from textmill.plans.sqlfrag import seeded_hash as h

SEED = 42


def docs(spark, sf, *cols):
    d = table(spark, sf, "documents")
    return d.select(*cols) if cols else d


# --- H1 ----------------------------------------------------------------------

@query("h1_bucketed_rank", sql=f"""
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {h(SEED, 'doc_id')}, doc_id) AS rank
FROM documents""")
def q_bucketed_rank(spark, sf):
    d = docs(spark, sf, "doc_id", "lang").withColumn("h", seeded_hash(SEED, "doc_id"))
    return bucketed_rank(d, ["lang"], ["h", "doc_id"], hash_bucket("h"), out="rank").drop("h")


# --- B3 and friends ----------------------------------------------------------

def _strat_sql(share: float, src: str = "documents", label: str = "lang", keys=("doc_id",),
               names=("train", "test"), cols="doc_id, lang") -> str:
    order = ", ".join([h(SEED, *keys)] + list(keys))
    return f"""(SELECT {cols}, CASE WHEN rk <= round(n * {share!r}) THEN '{names[1]}' ELSE '{names[0]}' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {order}) AS rk,
             count(*) OVER (PARTITION BY {label}) AS n FROM {src} WHERE {label} IS NOT NULL))"""


@query("b3_stratified_split", sql=f"SELECT * FROM {_strat_sql(0.15)}")
def q_stratified(spark, sf):
    return B.stratified_split(docs(spark, sf, "doc_id", "lang"), "lang", 0.15, SEED)


@query("p8_of_split", sql=f"SELECT doc_id FROM {_strat_sql(0.25)} WHERE split = 'test'")
def q_of_split(spark, sf):
    s = B.stratified_split(docs(spark, sf, "doc_id", "lang"), "lang", 0.25, SEED)
    return of_split(s, "test").select("doc_id")


@query("a13_rows_per_split", sql=f"SELECT split, count(*) AS rows FROM {_strat_sql(0.33)} GROUP BY split")
def q_rows_per_split(spark, sf):
    s = B.stratified_split(docs(spark, sf, "doc_id", "lang"), "lang", 0.33, SEED)
    return row_count(s, "split")


@query("b2_fraction_split", sql=f"""
SELECT doc_id, CASE WHEN rk <= round(n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {h(200, 'doc_id')}, doc_id) AS rk,
             count(*) OVER () AS n FROM documents)""")
def q_fraction(spark, sf):
    return B.fraction_split(docs(spark, sf, "doc_id"), 0.8, 200)


@query("j2_complement", sql=f"""
SELECT doc_id FROM documents WHERE doc_id NOT IN (
  SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {h(200, 'doc_id')}, doc_id) AS rk,
                             count(*) OVER () AS n FROM documents) WHERE rk <= round(n * 0.8))""")
def q_complement(spark, sf):
    d = docs(spark, sf, "doc_id")
    sample = B.fraction_split(d, 0.8, 200).where(F.col("split") == "train")
    return B.complement(d, sample)


@query("b4_random_split", sql=f"""
SELECT doc_id, CASE WHEN (({h(SEED, 'doc_id')})::DOUBLE + 0.5) / {float(1 << 60)!r} < 0.8
                    THEN 'train' ELSE 'test' END AS split FROM documents""")
def q_random_split(spark, sf):
    return B.random_split(docs(spark, sf, "doc_id"), 0.2, SEED)


@query("b7_holdout", sql="""
SELECT doc_id, CASE WHEN rk <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'val' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rk, count(*) OVER () AS n FROM documents)""")
def q_holdout(spark, sf):
    return B.holdout(docs(spark, sf, "doc_id"), 0.2)


@query("k1_stratified_folds", sql=f"""
SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY {h(SEED, 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM documents""")
def q_folds(spark, sf):
    return B.stratified_folds(docs(spark, sf, "doc_id", "lang"), "lang", 5, SEED)


# --- B1: resample every class to the size of 'fr' ------------------------------

def _resample_sql(target: str = "fr") -> str:
    return f"""(
WITH base AS (SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL),
ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {h(SEED, 'doc_id')}, doc_id) AS rk
           FROM base),
sizes AS (SELECT lang, count(*) AS n FROM base GROUP BY lang),
draws AS (SELECT lang, n, unnest(range(0, (SELECT n FROM sizes WHERE lang = '{target}'))) AS copy_no
          FROM sizes WHERE lang <> '{target}'),
picks AS (SELECT lang, copy_no, ({h(f'{SEED}:draw', 'lang', 'copy_no')} % n) + 1 AS rk FROM draws)
SELECT r.doc_id, r.lang, p.copy_no FROM picks p JOIN ranked r ON r.lang = p.lang AND r.rk = p.rk
UNION ALL SELECT doc_id, lang, 0 AS copy_no FROM base WHERE lang = '{target}')"""


@query("b1_resample_to_class", sql=f"SELECT * FROM {_resample_sql()}")
def q_resample(spark, sf):
    return B.resample_to_class(docs(spark, sf, "doc_id", "lang"), "lang", "fr", SEED)


@query("b1_class_sizes_after", sql=f"SELECT lang, count(*) AS rows FROM {_resample_sql()} GROUP BY lang")
def q_resample_sizes(spark, sf):
    return row_count(B.resample_to_class(docs(spark, sf, "doc_id", "lang"), "lang", "fr", SEED), "lang")


@query("b5_split_by_row", sql=f"""
WITH over AS {_resample_sql()},
s AS {_strat_sql(0.15, src='over', keys=('doc_id', 'copy_no'), names=('train', 'val'), cols='doc_id, lang, copy_no')},
flag AS (SELECT doc_id, max(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS v FROM s GROUP BY doc_id)
SELECT s.doc_id, s.lang, s.copy_no, CASE WHEN flag.v = 1 THEN 'val' ELSE 'train' END AS split
FROM s JOIN flag USING (doc_id)""")
def q_split_by_row(spark, sf):
    over = B.resample_to_class(docs(spark, sf, "doc_id", "lang"), "lang", "fr", SEED)
    return B.split_by_row(over, "lang", 0.15, SEED)


@query("b6_a3_split_leakage", sql=f"""
WITH over AS {_resample_sql()},
s AS {_strat_sql(0.15, src='over', keys=('doc_id', 'copy_no'), cols='doc_id, lang, copy_no')},
t AS (SELECT d.text, s.lang, s.split FROM s JOIN documents d USING (doc_id)),
per AS (SELECT text, lang, split, count(*) AS n FROM t GROUP BY ALL),
spread AS (SELECT text, count(DISTINCT split) AS n_splits FROM t GROUP BY text)
SELECT per.text, lang, split, n, n_splits FROM per JOIN spread USING (text)""")
def q_leakage(spark, sf):
    s = B.split_copies(docs(spark, sf, "doc_id", "lang"), "lang", "fr", 0.15, SEED)
    t = s.join(docs(spark, sf, "doc_id", "text"), on="doc_id").select("text", "lang", "split")
    return split_leakage(t, "text", "lang", "split")


# --- labels ------------------------------------------------------------------

@query("l1_label_codes_first_seen", sql="""
SELECT d.doc_id, c.code FROM documents d JOIN
 (SELECT lang, CAST(row_number() OVER (ORDER BY min(doc_id), lang) - 1 AS INTEGER) AS code
  FROM documents WHERE lang IS NOT NULL GROUP BY lang) c USING (lang)""")
def q_codes_first(spark, sf):
    return L.label_codes(docs(spark, sf, "doc_id", "lang"), "lang", "first_seen").select("doc_id", "code")


@query("l2_label_codes_sorted", sql="""
SELECT e.vec_id, c.code FROM embeddings e JOIN
 (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)) c USING (label)""")
def q_codes_sorted(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return L.label_codes(e, "label", "sorted").select("vec_id", "code")


@query("l4_decode_label", sql="""
SELECT doc_id, lang AS label_name FROM documents WHERE lang IS NOT NULL""")
def q_decode(spark, sf):
    d = docs(spark, sf, "doc_id", "lang")
    codes = L.code_table(d, "lang", "sorted")
    coded = L.apply_codes(d, codes, "lang")
    return L.decode_label(coded, codes, "code", label="lang").select("doc_id", "label_name")


@query("l5_one_hot", sql="""
SELECT doc_id, CAST(lang = 'en' AS INTEGER) AS is_en, CAST(lang = 'fr' AS INTEGER) AS is_fr,
       CAST(lang = 'de' AS INTEGER) AS is_de, CAST(lang = 'es' AS INTEGER) AS is_es FROM documents""")
def q_one_hot(spark, sf):
    return L.one_hot(docs(spark, sf, "doc_id", "lang"), "lang", ["en", "fr", "de", "es"]).drop("lang")
