"""The registered queries: each applies one operator, with the parameters of
production, to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@register("op1_ngram_join", sql=fr"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) >= 3
        THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM w),
n AS (SELECT doc_id, len(gs) AS n, md5(array_to_string(list_sort(gs), chr(10))) AS same FROM g),
s AS (SELECT doc_id, unnest(gs) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
k AS (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links,
       CASE WHEN n = 0 THEN 1 ELSE count(*) OVER (PARTITION BY same) END AS n_copies
FROM n JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.ngram_join import ngram_join
    return ngram_join(table(spark, sf_dir, "documents"), size=3, percent=90)


@register("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from textmill.llm.token_files import new_folder, read_token_files, write_token_files
    path = write_token_files(table(spark, sf_dir, "documents"), new_folder(spark),
                             public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op9_bpe_replay")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from textmill.llm.bpe_replay import bpe_decode, bpe_encode
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks,
                       public_tokenizers.PATTERN).drop("text")
    return bpe_decode(coded, ranks).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Texts that score less are rejected.
QUALITY_THRESHOLD = 0.3


@register("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textmill.llm.rff_classifier import fit_quality, score_quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"))


@register("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textmill.llm.pii import digest, find_pii
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}")
             for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *count, F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"))


@register("op8_divergence_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.divergence import divergence_rules
    return divergence_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "js_chars", "js_words")


@register("op2_source_mix")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textmill.llm.mixing import mix
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@register("op7_ann_forest")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.ann_forest import nearest
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@register("op6_html_model")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textmill.llm.html_model import extract_text, train_pages
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    got = extract_text(pages, train_pages(pages))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: host, path, verdict
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _rules_sql() -> str:
    return "(VALUES " + ", ".join(map(str, URL_RULES)) + ") r(h, p, v)"


def _url_sql(u: str) -> dict[str, str]:
    """Host, path and alias key of a url, as SQL."""
    rest = f"CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) END"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), {_AZ}), '')"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
    query = (f"array_to_string(list_filter(string_split(regexp_extract({rest}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda q: q <> '' AND "
             "NOT regexp_matches(q, '^(utm_[a-z]+|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|$)')), '&')")
    key = (f"CASE WHEN strpos({u}, '://') > 0 THEN '//' || {host} || {path} || "
           f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END ELSE {u} END")
    return {"host": host, "path": path, "key": key}


_U = _url_sql("url")


def _tags_sql(name: str) -> str:
    from textmill.llm.url_filter import RAW
    return f"regexp_extract_all(regexp_replace(html, '(?is){RAW}', ' ', 'g'), '(?i)<{name}\\s[^>]*>')"


#: The oracle knows links by absolute address, which is what pages declare.
@register("op4_url_filter", sql=fr"""
WITH RECURSIVE
t AS (SELECT DISTINCT url, unnest(list_concat(
        list_transform(list_filter({_tags_sql('link')}, lambda x: regexp_matches(x, '(?i)\srel="(?:[^"]*\s)?canonical(?:\s[^"]*)?"')),
                       lambda x: regexp_extract(x, 'href="([^"]*)"', 1)),
        list_transform(list_filter({_tags_sql('meta')}, lambda x: regexp_matches(x, '(?i)\shttp-equiv="refresh"')),
                       lambda x: regexp_extract(x, '(?i)url=([^"]*)"', 1)))) AS target
      FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM t WHERE target <> ''),
x AS (SELECT url, {_U['host']} AS host, {_U['path']} AS path, {_U['key']} AS key FROM u),
f AS (SELECT url, key, h || p AS rule, v FROM x JOIN {_rules_sql()}
      ON x.host <> '' AND (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p)
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(h || p) DESC, v, h || p) = 1),
e AS (SELECT a.key AS a, b.key AS b FROM t JOIN x a ON a.url = t.url JOIN x b ON b.url = t.target
      UNION SELECT b.key, a.key FROM t JOIN x a ON a.url = t.url JOIN x b ON b.url = t.target),
bad(key) AS (SELECT key FROM f WHERE v = 'block' UNION SELECT e.b FROM bad JOIN e ON e.a = bad.key)
SELECT page_id, {_U['host'].replace('url', 'pages.url')} AS host, {_U['path'].replace('url', 'pages.url')} AS path, f.rule,
       coalesce(f.v, CASE WHEN x.key IN (SELECT key FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN x ON x.url = pages.url LEFT JOIN f ON f.url = pages.url""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.url_filter import judge_urls
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules, keep=["page_id"])


def _repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the texts whose h = crc32(doc_id) ends in 0, the
    words from a certain one on repeat the first of them."""
    from pyspark.sql import functions as F

    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def change(w):
        n = F.size(w)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, n - a)), " ")

    # one entry, so that the words are taken once
    changed = F.transform(F.array(words), change)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textmill.llm.periodic_runs import periodic_runs, runs_digest, strongest
    docs = _repeated_tails(table(spark, sf_dir, "documents"))
    got = periodic_runs(docs, min_length=24, min_exponent=3, keep=["doc_id"])
    best = strongest(F.col("runs"))
    got = got.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                     F.sha2(runs_digest(F.col("runs")), 256).alias("runs_sha256"),
                     F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return got.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256", "n_words")


@register("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textmill.llm.simhash import simhash_classes
    got = simhash_classes(table(spark, sf_dir, "documents"), size=4, bits=4, seed=42)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register("op12_hard_negatives", sql="""
WITH
r AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n AS a, a.vec_id AS anchor_id, a.label = r.label AS same, r.n, r.vec_id,
        CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM r a JOIN r ON a.n <> r.n AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, n) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id, s.n) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id, s.n) <= 3""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textmill.llm.hard_negatives import hard_negatives
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)
