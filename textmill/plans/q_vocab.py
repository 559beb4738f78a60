"""Registered queries: vocabularies and encodings V1-V8, J3, J4, J8, J9, W1,
W5, T13.  V1 is built on the training split only (stratified, 25 % test),
as in the reference; V2 on all documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import sampling as B
from textmill.operators import vocab as V
from textmill.plans import sqlfrag as S
from textmill.plans.q_sampling import SEED, _strat_sql
from textmill.plans.registry import query, sql_lit, table
from textmill.session import ensure_checkpoint_dir


def docs(spark, sf, *cols):
    d = table(spark, sf, "documents")
    return d.select(*cols) if cols else d


def _train_docs(spark, sf):
    s = B.stratified_split(docs(spark, sf, "doc_id", "lang", "text"), "lang", 0.25, SEED)
    return s.where(F.col("split") == "train").select("doc_id", "text")


def _v1(spark, sf, cap=None):
    tr = V.vocab_tokens(_train_docs(spark, sf), "text")
    return V.freq_vocab(tr, "tokens", cap=cap)


def _v2(spark, sf):
    d = docs(spark, sf, "doc_id", "text").withColumn("tokens", T.tokenize("text"))
    return V.first_seen_vocab(d, "tokens", min_count=2)


# ---- SQL pieces ----

TRAIN_SQL = f"(SELECT doc_id, text FROM {_strat_sql(0.25, cols='doc_id, lang, text')} WHERE split = 'train')"


def _pos_sql(src: str, toks: str) -> str:
    return (f"(SELECT doc_id, unnest(tk) AS token, generate_subscripts(tk, 1) - 1 AS pos "
            f"FROM (SELECT doc_id, {toks} AS tk FROM {src}))")


def _first_seen_sql(pos: str) -> str:
    return f"""(WITH p AS {pos},
c AS (SELECT token, count(*) AS freq, min(doc_id) AS fd FROM p GROUP BY token)
SELECT c.token, c.freq, c.fd, min(p.pos) AS fp FROM c JOIN p ON p.token = c.token AND p.doc_id = c.fd
GROUP BY c.token, c.freq, c.fd)"""


V1_SQL = f"""(SELECT token, freq, row_number() OVER (ORDER BY freq DESC, fd, fp) AS id
FROM {_first_seen_sql(_pos_sql(TRAIN_SQL, S.vocab_words('text')))})"""
V1_CAP_SQL = f"(SELECT * FROM {V1_SQL} WHERE id < 5000)"
V2_SQL = f"""(SELECT token, freq, row_number() OVER (ORDER BY fd, fp) + 1 AS id
FROM {_first_seen_sql(_pos_sql('documents', S.tokenize('text')))} WHERE freq >= 2)"""
V3_SQL = f"""(WITH p AS {_pos_sql('documents', S.vocab_words('text'))},
e AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM p JOIN {V1_CAP_SQL} v USING (token) GROUP BY doc_id)
SELECT d.doc_id, coalesce(e.ids, []::BIGINT[]) AS ids FROM documents d LEFT JOIN e USING (doc_id))"""


def _pad_sql(e: str, n: int, padding: str) -> str:
    cut = f"(CASE WHEN len({e}) > {n} THEN {e}[len({e}) - {n - 1}:len({e})] ELSE {e} END)"
    zeros = f"list_transform(range({n} - len({cut})), lambda x: 0::BIGINT)"
    return f"list_concat({zeros}, {cut})" if padding == "pre" else f"list_concat({cut}, {zeros})"


@query("v1_freq_vocab", sql=f"SELECT * FROM {V1_SQL}")
def q_v1(spark, sf):
    return _v1(spark, sf)


@query("v1_freq_vocab_capped", sql=f"SELECT * FROM {V1_CAP_SQL}")
def q_v1_cap(spark, sf):
    return _v1(spark, sf, cap=5000)


@query("v1_freq_vocab_cap_20000", sql=f"SELECT * FROM {V1_SQL} WHERE id < 20000")
def q_v1_cap_large(spark, sf):
    """A cap above the top-k limit: the distributed global rank, filtered."""
    return _v1(spark, sf, cap=20000)


@query("v2_first_seen_vocab", sql=f"SELECT * FROM {V2_SQL}")
def q_v2(spark, sf):
    return _v2(spark, sf)


@query("v3_encode_drop", sql=f"SELECT * FROM {V3_SQL}")
def q_v3(spark, sf):
    d = V.vocab_tokens(docs(spark, sf, "doc_id", "text"), "text")
    return V.encode_drop(d, "tokens", _v1(spark, sf, cap=5000), cap=5000)


@query("v5_pad_pre_750", sql=f"SELECT doc_id, {_pad_sql('ids', 750, 'pre')} AS padded FROM {V3_SQL}")
def q_v5_pre(spark, sf):
    return q_v3(spark, sf).select("doc_id", V.pad("ids", 750, "pre", "pre").alias("padded"))


@query("v5_pad_post_200", sql=f"SELECT doc_id, {_pad_sql('ids', 200, 'post')} AS padded FROM {V3_SQL}")
def q_v5_post(spark, sf):
    return q_v3(spark, sf).select("doc_id", V.pad("ids", 200, "post", "pre").alias("padded"))


@query("v4_encode_fixed", sql=f"""
WITH p AS (SELECT * FROM {_pos_sql('documents', S.tokenize('text'))} WHERE pos < 70),
e AS (SELECT doc_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM p LEFT JOIN {V2_SQL} v USING (token)
      GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(e.ids, []::BIGINT[]) AS ids FROM documents d LEFT JOIN e USING (doc_id))
SELECT doc_id, list_concat(ids, list_transform(range(70 - len(ids)), lambda x: 0::BIGINT)) AS encoded,
       CAST(len(ids) AS INTEGER) AS length FROM a""")
def q_v4(spark, sf):
    d = docs(spark, sf, "doc_id", "text").withColumn("tokens", T.tokenize("text"))
    return V.encode_fixed(d, "tokens", _v2(spark, sf), n=70)


@query("v6_encode_masked", sql=f"""
WITH p AS (SELECT * FROM {_pos_sql('documents', S.tokenize('text'))} WHERE pos < 126),
e AS (SELECT doc_id, list(coalesce(v.id + 2, 1) ORDER BY pos) AS ids FROM p LEFT JOIN {V2_SQL} v USING (token)
      GROUP BY doc_id),
a AS (SELECT d.doc_id, list_concat([2::BIGINT], coalesce(e.ids, []::BIGINT[]), [3::BIGINT]) AS body
      FROM documents d LEFT JOIN e USING (doc_id))
SELECT doc_id, list_concat(body, list_transform(range(128 - len(body)), lambda x: 0::BIGINT)) AS input_ids,
       list_concat(list_transform(range(len(body)), lambda x: 1), list_transform(range(128 - len(body)), lambda x: 0))
         AS attention_mask FROM a""")
def q_v6(spark, sf):
    d = docs(spark, sf, "doc_id", "text").withColumn("tokens", T.tokenize("text"))
    return V.encode_masked(d, "tokens", _v2(spark, sf), n=128)


@query("v7_term_counts", sql=f"""
SELECT doc_id, term, count(*) AS n FROM
 (SELECT doc_id, unnest({S.tokenize('text')}) AS term FROM documents) GROUP BY doc_id, term""")
def q_v7(spark, sf):
    d = docs(spark, sf, "doc_id", "text").withColumn("tokens", T.tokenize("text"))
    return V.term_counts(d, "tokens")


TERMS_SQL = f"""(SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS id
FROM (SELECT unnest({S.tokenize('text')}) AS term FROM documents) GROUP BY term)"""


@query("v7_bag_of_words", sql=f"""
WITH t AS {TERMS_SQL},
c AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n
      FROM (SELECT doc_id, unnest({S.tokenize('text')}) AS term FROM documents) GROUP BY ALL),
b AS (SELECT doc_id, list(id ORDER BY id) AS indices, list(n ORDER BY id) AS v FROM c JOIN t USING (term) GROUP BY doc_id)
SELECT d.doc_id, (SELECT count(*) FROM t) AS size, coalesce(b.indices, []::BIGINT[]) AS indices,
       coalesce(b.v, []::DOUBLE[]) AS values FROM documents d LEFT JOIN b USING (doc_id)""")
def q_v7_vectors(spark, sf):
    """Sparse vectors over all words, from the saved and loaded stage."""
    from textmill.operators.pipeline import BagOfWords, fit_bag_of_words
    d = docs(spark, sf, "doc_id", "text").withColumn("tokens", T.tokenize("text"))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bag_{uuid.uuid4().hex}"
    fit_bag_of_words(d, f"{base}/terms").write().save(f"{base}/stage")
    got = BagOfWords.load(f"{base}/stage").transform(d)
    return got.select("doc_id", "features.size", "features.indices", "features.values")


@query("v8_ngrams", sql=f"""
SELECT doc_id, CASE WHEN len(t) >= 2 THEN list_transform(range(len(t) - 1), lambda i: t[i + 1] || ' ' || t[i + 2])
                    ELSE []::VARCHAR[] END AS grams
FROM (SELECT doc_id, {S.tokenize('text')} AS t FROM documents)""")
def q_v8(spark, sf):
    return docs(spark, sf, "doc_id", "text").select("doc_id", T.ngrams(T.tokenize("text"), 2).alias("grams"))


def _stops_sql() -> str:
    return "[" + ", ".join(sql_lit(w) for w in T.default_stop_words()) + "]"


@query("j8_drop_stop_join", sql=f"""
SELECT doc_id, list_filter({S.tokenize('text')}, lambda t: NOT list_contains({_stops_sql()}, t)) AS tokens
FROM documents""")
def q_j8(spark, sf):
    d = docs(spark, sf, "doc_id", "text").withColumn("tokens", T.tokenize("text"))
    words = spark.createDataFrame([(w,) for w in T.default_stop_words()], "word string")
    return V.drop_tokens_join(d, "tokens", words)


def _lemma_table(spark, sf):
    toks = T.explode_tokens(docs(spark, sf, "text"), T.tokenize("text"), "token").distinct()
    cand = toks.where(F.col("token").endswith("s") & (F.length("token") > 3)) \
        .select("token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    return cand.join(toks.select(F.col("token").alias("lemma")), on="lemma", how="left_semi")


@query("j9_t13_lemmatize", sql=f"""
WITH toks AS (SELECT DISTINCT unnest({S.tokenize('text')}) AS token FROM documents),
lem AS (SELECT token, substr(token, 1, length(token) - 1) AS lemma FROM toks
        WHERE suffix(token, 's') AND length(token) > 3
          AND substr(token, 1, length(token) - 1) IN (SELECT token FROM toks)),
p AS {_pos_sql('documents', S.tokenize('text'))},
e AS (SELECT doc_id, list(coalesce(lem.lemma, p.token) ORDER BY pos) AS lemmas
      FROM p LEFT JOIN lem USING (token) GROUP BY doc_id)
SELECT d.doc_id, coalesce(e.lemmas, []::VARCHAR[]) AS lemmas FROM documents d LEFT JOIN e USING (doc_id)""")
def q_j9(spark, sf):
    d = docs(spark, sf, "doc_id", "text").withColumn("tokens", T.tokenize("text"))
    return V.lemmatize(d, "tokens", _lemma_table(spark, sf))
