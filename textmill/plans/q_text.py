"""Registered queries for the cleaning and text functions (T1-T17, F1) and the
flagship duplicate-text report (S4, P1, P2, P6, T6, A2, O2).

Stand-ins on the driver tables: text = ``documents.text``, label =
``documents.lang``.  No driver text holds an apostrophe, so the contraction
query first turns chosen words into contractions (same rewrite on both
sides) to exercise T4 on whole documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators.clean import clean
from textmill.operators.projection import drop_nulls, min_length, select_cols
from textmill.operators.stats import duplicate_texts, top_k
from textmill.plans import sqlfrag as S
from textmill.plans.registry import query, sql_lit, table


def docs(spark, sf):
    return table(spark, sf, "documents")


# --- flagship: most repeated cleaned texts, top 120 -------------------------

def top_duplicate_texts(spark, sf, k: int = 120):
    d = select_cols(docs(spark, sf), "text", "lang")
    d = drop_nulls(d)
    d = min_length(d, "text", 2)
    d = clean(d, "text", "text")
    counts = duplicate_texts(d, "text", "lang")
    return top_k(counts, k, F.desc("n"), F.asc("text"))


query("a2_top_duplicate_texts", sql=f"""
SELECT text, count(lang) AS n
FROM {S.clean_cte("(SELECT text AS t0, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND length(text) >= 2)", text="t0", keep="lang", out="text")}
GROUP BY text ORDER BY n DESC, text LIMIT 120
""")(top_duplicate_texts)


@query("a2_duplicate_texts", sql=f"""
SELECT text, count(lang) AS n
FROM {S.clean_cte("(SELECT text AS t0, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND length(text) >= 2)", text="t0", keep="lang", out="text")}
GROUP BY text
""")
def q_duplicate_texts(spark, sf):
    d = min_length(drop_nulls(select_cols(docs(spark, sf), "text", "lang")), "text", 2)
    return duplicate_texts(clean(d, "text", "text"), "text", "lang")


# --- single functions over every document -----------------------------------

@query("t1_lower", sql="SELECT doc_id, lower(text) AS out FROM documents")
def q_lower(spark, sf):
    return docs(spark, sf).select("doc_id", T.lower("text").alias("out"))


@query("t2_clean_text", sql=f"""
SELECT doc_id, text AS out,
       {S.rr('text', '[^a-zA-z0-9' + S.WS_BODY + ']', '')} AS strict_out
FROM documents""")
def q_clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.clean_text("text").alias("out"),
                                  T.clean_text("text", strict=True).alias("strict_out"))


@query("t3_mask_numbers", sql=f"SELECT doc_id, {S.mask_numbers('text')} AS out FROM documents")
def q_mask_numbers(spark, sf):
    return docs(spark, sf).select("doc_id", T.mask_numbers("text").alias("out"))


# Chosen words turned into contractions, identically on both sides.
INJECT = [(" on ", " can't "), (" the ", " it's "), (" and ", " y'all'd've "),
          (" of ", " 'cause "), (" is ", " won't've ")]


def _inject_sql(e: str) -> str:
    for a, b in INJECT:
        e = f"replace({e}, {sql_lit(a)}, {sql_lit(b)})"
    return e


@query("t4_expand_contractions", sql=f"""
SELECT doc_id, {S.expand_contractions('src')} AS out
FROM (SELECT doc_id, {_inject_sql('text')} AS src FROM documents)""")
def q_expand_contractions(spark, sf):
    src = F.col("text")
    for a, b in INJECT:
        src = F.replace(src, F.lit(a), F.lit(b))
    d = docs(spark, sf).select("doc_id", src.alias("src"))
    return d.select("doc_id", T.expand_contractions("src").alias("out"))


@query("t5_remove_punctuation", sql=f"SELECT doc_id, {S.remove_punctuation('text')} AS out FROM documents")
def q_remove_punctuation(spark, sf):
    return docs(spark, sf).select("doc_id", T.remove_punctuation("text").alias("out"))


@query("t6_clean", sql=f"SELECT doc_id, clean AS out FROM {S.clean_cte('documents')}")
def q_clean(spark, sf):
    return clean(docs(spark, sf).select("doc_id", "text"), "text", "out").select("doc_id", "out")


@query("t7_clean_keep_masks",
       sql=f"SELECT doc_id, clean AS out FROM {S.clean_cte('documents', punctuation=False)}")
def q_clean_keep_masks(spark, sf):
    return clean(docs(spark, sf).select("doc_id", "text"), "text", "out",
                 punctuation=False).select("doc_id", "out")


@query("t8_letters_only", sql=f"SELECT doc_id, {S.letters_only('text')} AS out FROM documents")
def q_letters_only(spark, sf):
    return docs(spark, sf).select("doc_id", T.letters_only("text").alias("out"))


@query("t9_collapse_ws", sql=f"SELECT doc_id, {S.collapse_ws('text')} AS out FROM documents")
def q_collapse_ws(spark, sf):
    return docs(spark, sf).select("doc_id", T.collapse_ws("text").alias("out"))


@query("t10_t11_lengths", sql=f"""
SELECT doc_id, CAST({S.n_words('text')} AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars
FROM documents""")
def q_lengths(spark, sf):
    return docs(spark, sf).select("doc_id", T.n_words("text").cast("bigint").alias("n_words"),
                                  T.n_chars("text").cast("bigint").alias("n_chars"))


def _stop_sql() -> str:
    words = sorted(set(T.default_stop_words()) | set(T.symbols()))
    return "[" + ", ".join(sql_lit(w) for w in words) + "]"


@query("t12_normalize_drop_stop", sql=f"""
SELECT doc_id, list_filter({S.split_ws('norm')}, lambda t: NOT list_contains({_stop_sql()}, t)) AS tokens
FROM (SELECT doc_id, lower(replace(replace({S.strip_ws('text')}, chr(10), ' '), chr(13), ' ')) AS norm
      FROM documents)""")
def q_normalize(spark, sf):
    d = docs(spark, sf).select("doc_id", T.normalize("text").alias("norm"))
    toks = T.drop_tokens(T.split_ws("norm"), T.default_stop_words() + T.symbols())
    return d.select("doc_id", toks.alias("tokens"))


@query("t14_tokenize", sql=f"SELECT doc_id, {S.tokenize('text')} AS tokens FROM documents")
def q_tokenize(spark, sf):
    return docs(spark, sf).select("doc_id", T.tokenize("text").alias("tokens"))


@query("t15_normalized_tokens", sql=f"""
SELECT doc_id, list_filter(list_transform({S.split_ws('text')},
         lambda t: regexp_replace(t, '[^\\p{{L}}+]', '', 'g')), lambda t: t <> '') AS tokens
FROM documents""")
def q_normalized_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalized_tokens("text").alias("tokens"))


@query("t16_capitalize", sql=f"""
SELECT doc_id, list_transform({S.split_ws('text')}, lambda w: {S.capitalize('w')}) AS words
FROM documents""")
def q_capitalize(spark, sf):
    return docs(spark, sf).select("doc_id", F.transform(T.split_ws("text"), T.capitalize).alias("words"))


@query("t17_join_tokens", sql=f"""
SELECT doc_id, array_to_string({S.tokenize('text')}, ' ') AS out FROM documents""")
def q_join_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.join_tokens(T.tokenize("text")).alias("out"))
