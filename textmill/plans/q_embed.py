"""Registered queries: word vectors S5, embedding matrix E1 (J5, J6), pooling
E2-E3, trained vectors E5.

The driver tables have no word-vector file.  A vector table is derived
from them: the ``embeddings`` row ``vec_id`` gives the vector of the
min-count vocabulary word with id ``vec_id + 2``, keyed by the word itself
for even ``vec_id`` and by its capitalised form for odd ones (so the exact,
capitalised and filled paths of E1 all occur).  Floats rounded to 6.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions.fixed import (
    EMB_FILL_MEAN,
    EMB_FILL_STD,
    EMB_FILL_UNIFORM_HIGH,
    EMB_FILL_UNIFORM_LOW,
)
from textmill.functions.hashing import sql_normal_vector, sql_uniform
from textmill.operators import embed as E
from textmill.plans import sqlfrag as S
from textmill.plans.q_vocab import V1_CAP_SQL, V2_SQL, _v1, _v2
from textmill.plans.registry import query, table
from textmill.plans.sqlfrag import round6_sql
from textmill.session import barrier, ensure_checkpoint_dir
from textmill.sources.io import read_word_vectors

DIM = 64


def word_vectors(spark, sf, v2=None):
    v2 = v2 if v2 is not None else _v2(spark, sf)
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    j = v2.join(e, v2["id"] == e["vec_id"] + 2, "inner")
    key = F.when(F.col("vec_id") % 2 == 0, F.col("token")).otherwise(T.capitalize("token"))
    return j.select(key.alias("token"), "vec")


WV_SQL = f"""(SELECT CASE WHEN e.vec_id % 2 = 0 THEN v.token ELSE {S.capitalize('v.token')} END AS token,
        e.embedding AS vec FROM {V2_SQL} v JOIN embeddings e ON v.id = e.vec_id + 2)"""


#: Lower-cased words, one row each: the lower-case spelling, else the first.
FOLDED_SQL = f"""(SELECT lower(token) AS token, vec FROM {WV_SQL}
        QUALIFY row_number() OVER (PARTITION BY lower(token) ORDER BY token <> lower(token), token) = 1)"""


def _round_vec(c):
    return F.transform(c, lambda x: F.round(x.cast("double"), 6))


def _round_vec_sql(e: str) -> str:
    return f"list_transform({e}, lambda x: {round6_sql('x::DOUBLE')})"


@query("s5_read_word_vectors", sql=f"SELECT token, {_round_vec_sql('vec')} AS vec FROM {WV_SQL}")
def q_read_vectors(spark, sf):
    """Write the derived vectors as 'token f1 ... f64' lines to the shared
    checkpoint folder, read them back with the word-vector reader."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/word_vectors_{uuid.uuid4().hex}"
    lines = word_vectors(spark, sf).select(
        F.concat_ws(" ", F.col("token"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
        .alias("value"))
    lines.write.mode("overwrite").text(path)
    return read_word_vectors(spark, path, DIM).select("token", _round_vec(F.col("vec")).alias("vec"))


def _fill_sql(seed, id_expr: str) -> str:
    z = sql_normal_vector(seed, id_expr, DIM, mean=EMB_FILL_MEAN, std=EMB_FILL_STD)
    return f"list_transform({z}, lambda x: CAST(x AS FLOAT))"


@query("e1_embedding_table", sql=f"""
WITH v AS {V2_SQL}, wv AS {WV_SQL}
SELECT v.id, v.token, {_round_vec_sql(f"coalesce(w1.vec, w2.vec, {_fill_sql(42, 'v.id')})")} AS vec
FROM v LEFT JOIN wv w1 ON w1.token = v.token
       LEFT JOIN wv w2 ON w2.token = {S.capitalize('v.token')}""")
def q_embedding_table(spark, sf):
    v2 = _v2(spark, sf)
    t = E.embedding_table(v2, word_vectors(spark, sf, v2), DIM, fill="normal", try_capitalized=True)
    return t.select("id", "token", _round_vec(F.col("vec")).alias("vec"))


@query("e1_matrix_freq_normal", sql=f"""
WITH v AS (SELECT id, token FROM {V1_CAP_SQL} UNION ALL SELECT 0, ''), wv AS {WV_SQL}
SELECT CAST(v.id AS BIGINT) AS id, v.token,
       {_round_vec_sql(f"coalesce(w1.vec, w2.vec, {_fill_sql(42, 'v.id')})")} AS vec
FROM v LEFT JOIN wv w1 ON w1.token = v.token AND v.id > 0
       LEFT JOIN wv w2 ON w2.token = {S.capitalize('v.token')} AND v.id > 0""")
def q_matrix_normal(spark, sf):
    """Frequency vocabulary (5,000), normal fill, row 0 drawn like the rest."""
    t = E.embedding_table(_v1(spark, sf, cap=5000), word_vectors(spark, sf), DIM, fill="normal", first_row=True)
    return t.select("id", "token", _round_vec(F.col("vec")).alias("vec"))


@query("e1_matrix_freq_zeros", sql=f"""
WITH v AS (SELECT id, token FROM {V1_CAP_SQL} UNION ALL SELECT 0, ''), wv AS {WV_SQL}
SELECT CAST(v.id AS BIGINT) AS id, v.token,
       {_round_vec_sql(f"coalesce(w1.vec, list_transform(range({DIM}), lambda i: 0.0::FLOAT))")} AS vec
FROM v LEFT JOIN wv w1 ON w1.token = v.token AND v.id > 0""")
def q_matrix_zeros(spark, sf):
    """Frequency vocabulary (5,000), exact words only, zeros elsewhere, row 0 zero."""
    t = E.embedding_table(_v1(spark, sf, cap=5000), word_vectors(spark, sf), DIM, fill="zeros",
                          try_capitalized=False, first_row=True)
    return t.select("id", "token", _round_vec(F.col("vec")).alias("vec"))


def _uniform_sql(seed, id_expr: str) -> str:
    span = EMB_FILL_UNIFORM_HIGH - EMB_FILL_UNIFORM_LOW
    return (f"list_transform(range({DIM}), lambda j: CAST({EMB_FILL_UNIFORM_LOW!r} + {span!r} * "
            f"{sql_uniform(seed, id_expr, 'j')} AS FLOAT))")


@query("e1_matrix_min_count_uniform", sql=f"""
WITH v AS (SELECT id, token FROM {V2_SQL}), wv AS {WV_SQL}
SELECT CAST(0 AS BIGINT) AS id, '' AS token, list_transform(range({DIM}), lambda i: 0.0::DOUBLE) AS vec
UNION ALL SELECT CAST(1 AS BIGINT), 'UNK', {_round_vec_sql(_uniform_sql(42, '1'))}
UNION ALL SELECT CAST(v.id AS BIGINT), v.token,
       {_round_vec_sql(f"coalesce(w1.vec, {_uniform_sql(42, 'v.id')})")}
FROM v LEFT JOIN wv w1 ON w1.token = v.token""")
def q_matrix_uniform(spark, sf):
    """Min-count vocabulary, exact words only, uniform fill, special rows 0 and 1."""
    v2 = _v2(spark, sf)
    t = E.embedding_table(v2, word_vectors(spark, sf, v2), DIM, fill="uniform", try_capitalized=False, special_rows=True)
    return t.select("id", "token", _round_vec(F.col("vec")).alias("vec"))


ZERO_SQL = f"list_transform(range({DIM}), lambda i: 0.0::DOUBLE)"


def _pool_sql(agg: str, wv: str = WV_SQL, token: str = "token") -> str:
    return f"""(WITH wv AS {wv},
c AS (SELECT doc_id, {token} AS token, count(*) AS n FROM (SELECT doc_id, unnest({S.tokenize('text')}) AS token FROM documents)
      GROUP BY ALL),
u AS (SELECT c.doc_id, c.n, unnest(w.vec)::DOUBLE AS x, generate_subscripts(w.vec, 1) AS k
      FROM c JOIN wv w USING (token)),
a AS (SELECT doc_id, k, {agg} AS m FROM u GROUP BY doc_id, k),
p AS (SELECT doc_id, list({round6_sql('m')} ORDER BY k) AS doc_vec FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.doc_vec, {ZERO_SQL}) AS doc_vec FROM documents d LEFT JOIN p USING (doc_id))"""


def _pool(spark, sf, how):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("tokens"))
    p = E.pool(d, "tokens", word_vectors(spark, sf), how=how)
    return p.select("doc_id", _round_vec(F.col("doc_vec")).alias("doc_vec"))


@query("e2_pool_avg", sql=f"SELECT * FROM {_pool_sql('sum(n * x) / sum(n)')}")
def q_pool_avg(spark, sf):
    return _pool(spark, sf, "avg")


@query("e2_pool_avg_blocked", sql=f"SELECT * FROM {_pool_sql('sum(n * x) / sum(n)')}")
def q_pool_avg_blocked(spark, sf):
    """The same with no table small enough to broadcast: the blocked product."""
    d = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("tokens"))
    p = E.pool(d, "tokens", word_vectors(spark, sf), how="avg", max_bytes=0)
    return p.select("doc_id", _round_vec(F.col("doc_vec")).alias("doc_vec"))


@query("e2_pool_avg_no_case", sql=f"SELECT * FROM {_pool_sql('sum(n * x) / sum(n)', FOLDED_SQL, 'lower(token)')}")
def q_pool_avg_no_case(spark, sf):
    """Look-up without regard to case, as the main pipeline does it."""
    d = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("tokens"))
    p = E.pool(d, "tokens", word_vectors(spark, sf), how="avg", case_sensitive=False)
    return p.select("doc_id", _round_vec(F.col("doc_vec")).alias("doc_vec"))


@query("e2_pool_avg_oov_zero", sql=f"""
WITH wv AS {WV_SQL},
toks AS (SELECT doc_id, unnest({S.tokenize('text')}) AS token FROM documents),
t AS (SELECT doc_id, count(*) AS tot FROM toks GROUP BY doc_id),
c AS (SELECT doc_id, token, count(*) AS n FROM toks GROUP BY doc_id, token),
u AS (SELECT c.doc_id, c.n, unnest(w.vec)::DOUBLE AS x, generate_subscripts(w.vec, 1) AS k
      FROM c JOIN wv w USING (token)),
a AS (SELECT doc_id, k, sum(n * x) AS m FROM u GROUP BY doc_id, k),
p AS (SELECT a.doc_id, list({round6_sql('a.m / t.tot')} ORDER BY a.k) AS doc_vec
      FROM a JOIN t USING (doc_id) GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(p.doc_vec, {ZERO_SQL}) AS doc_vec FROM documents d LEFT JOIN p USING (doc_id)""")
def q_pool_avg_zero(spark, sf):
    """Average with unknown tokens counted as zero vectors."""
    d = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("tokens"))
    p = E.pool(d, "tokens", word_vectors(spark, sf), how="avg", oov="zero")
    return p.select("doc_id", _round_vec(F.col("doc_vec")).alias("doc_vec"))


@query("e3_pool_max", sql=f"SELECT * FROM {_pool_sql('max(x)')}")
def q_pool_max(spark, sf):
    return _pool(spark, sf, "max")


@query("e3_pool_avg_max", sql=f"""
SELECT a.doc_id, list_concat(a.doc_vec, m.doc_vec) AS doc_vec
FROM {_pool_sql('sum(n * x) / sum(n)')} a JOIN {_pool_sql('max(x)')} m USING (doc_id)""")
def q_pool_avg_max(spark, sf):
    return _pool(spark, sf, "avg_max")


@query("e5_train_word_vectors", sql=f"""
SELECT token, CAST(16 AS INTEGER) AS dim FROM (SELECT unnest({S.tokenize('text')}) AS token FROM documents)
GROUP BY token HAVING count(*) >= 5""")
def q_train_vectors(spark, sf):
    """One vector per word seen at least 5 times; the oracle checks the words."""
    d = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("tokens"))
    v = E.train_word_vectors(d, "tokens", dim=16, min_count=5, seed=42)
    return v.select("token", F.size("vec").alias("dim"))


_PAIRS_SQL = f"""p AS (SELECT doc_id, unnest(tk) AS token, generate_subscripts(tk, 1) AS pos
  FROM (SELECT doc_id, {S.tokenize('text')} AS tk FROM documents)),
f AS (SELECT token FROM p GROUP BY token HAVING count(*) >= 5),
k AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS at FROM p JOIN f USING (token)),
n AS (SELECT least(x.token, y.token) AS a, greatest(x.token, y.token) AS b, count(*) AS n
  FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.at > x.at AND y.at <= x.at + 5 GROUP BY ALL)"""


def _pairs(spark, sf):
    """Co-occurrence counts by id, and the words of the ids."""
    from textmill.operators import wordvec as W
    from textmill.operators.vocab import encode_drop, first_seen_vocab
    d = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("tokens"))
    vocab = barrier(first_seen_vocab(d, "tokens", min_count=5).select("token", "id"))
    return W.cooccurrence(encode_drop(d, "tokens", vocab), "ids", 5), vocab


def _named(df, vocab, *cols):
    from textmill.operators.lookup import join_prepared, prepared
    kept, small = prepared(vocab, "id")
    for c in cols:
        names = kept.select(F.col("id").alias(c), F.col("token").alias(f"{c}_token"))
        df = join_prepared(df, c, names, small).drop(c).withColumnRenamed(f"{c}_token", c)
    return df


@query("e5_cooccurrence", sql=f"WITH {_PAIRS_SQL} SELECT a, b, n FROM n")
def q_cooccurrence(spark, sf):
    """How often words stand within five places of each other."""
    pairs, vocab = _pairs(spark, sf)
    named = _named(pairs, vocab, "a", "b")
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")


@query("e5_positive_pmi", sql=f"""
WITH {_PAIRS_SQL},
s AS (SELECT a AS i, b AS j, n FROM n UNION ALL SELECT b, a, n FROM n WHERE a <> b),
r AS (SELECT i, sum(n)::BIGINT AS s FROM s GROUP BY i),
m AS (SELECT s.i, s.j, ln(s.n / x.s * (SELECT sum(n)::DOUBLE FROM s) / y.s) AS m FROM s JOIN r x ON x.i = s.i JOIN r y ON y.i = s.j)
SELECT i, j, {round6_sql('m')} AS m FROM m WHERE m > 0""")
def q_positive_pmi(spark, sf):
    """The weights that the word vectors factorise."""
    from textmill.operators import wordvec as W
    pairs, vocab = _pairs(spark, sf)
    return _named(W.positive_pmi(W._stored(pairs)), vocab, "i", "j").select("i", "j", F.round("m", 6).alias("m"))
