"""Registered queries: readers S1-S3, preview S10, column-wise join J1.

The driver tables are parquet; the text readers are exercised on files
Spark derives from them (written to the shared checkpoint folder, then read
back), so the oracle is the source table itself.  The texts hold newlines,
so S1 really reads quoted multi-line records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textmill.operators.labels import one_hot
from textmill.operators.projection import zip_columns
from textmill.plans.registry import query, table
from textmill.session import ensure_checkpoint_dir
from textmill.sources import io


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


@query("s1_read_reviews_csv", sql="""
SELECT CAST(doc_id AS BIGINT) AS doc_id, text AS review_body,
       CAST(substr(source, 4) AS INTEGER) AS star_rating FROM documents""")
def q_read_reviews(spark, sf):
    path = _scratch(spark, "reviews_csv")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("review_body"),
                                             F.substring("source", 4, 10).alias("star_rating"))
    d.write.option("header", True).option("escape", '"').csv(path)
    return io.read_reviews(spark, path).select("doc_id", "review_body", "star_rating")


@query("s2_read_csv_strings", sql="""
SELECT role, text, CAST(turn AS VARCHAR) AS turn FROM conversations""")
def q_read_csv(spark, sf):
    path = _scratch(spark, "conv_csv")
    table(spark, sf, "conversations").select("role", "text", "turn").write \
        .option("header", True).option("escape", '"').csv(path)
    return io.read_csv(spark, path + "/*.csv", ["role", "text", "turn"], multi_line=True)


@query("s3_read_news_tsv", sql="""
SELECT CAST(doc_id AS BIGINT) AS "ID", 'title ' || CAST(n_chars AS VARCHAR) AS "TITLE",
       'http://' || source || '.example/' || lang AS "URL", source AS "PUBLISHER", lang AS "CATEGORY",
       md5(text) AS "STORY", lang || '.' || source AS "HOSTNAME", CAST(n_chars AS BIGINT) AS "TIMESTAMP"
FROM documents""")
def q_read_tsv(spark, sf):
    path = _scratch(spark, "news_tsv")
    d = table(spark, sf, "documents")
    d.select(F.col("doc_id").alias("ID"), F.concat(F.lit("title "), F.col("n_chars").cast("string")).alias("TITLE"),
             F.concat(F.lit("http://"), "source", F.lit(".example/"), "lang").alias("URL"),
             F.col("source").alias("PUBLISHER"), F.col("lang").alias("CATEGORY"), F.md5("text").alias("STORY"),
             F.concat("lang", F.lit("."), "source").alias("HOSTNAME"), F.col("n_chars").cast("bigint").alias("TIMESTAMP")) \
        .write.option("sep", "\t").csv(path)
    return io.read_news_tsv(spark, path).select("ID", "TITLE", "URL", "PUBLISHER", "CATEGORY", "STORY", "HOSTNAME", "TIMESTAMP")


@query("s10_preview", sql="""
SELECT doc_id, substr(text, 1, 20) AS text, substr(lang, 1, 20) AS lang
FROM documents ORDER BY doc_id LIMIT 5""")
def q_preview(spark, sf):
    return io.preview(table(spark, sf, "documents").select("doc_id", "text", "lang"), 5, 20, ["doc_id"])


@query("j1_zip_columns", sql="""
SELECT doc_id, text, CAST(lang = 'en' AS INTEGER) AS is_en, CAST(lang = 'fr' AS INTEGER) AS is_fr,
       CAST(lang = 'de' AS INTEGER) AS is_de, CAST(lang = 'es' AS INTEGER) AS is_es FROM documents""")
def q_zip(spark, sf):
    d = table(spark, sf, "documents")
    dummies = one_hot(d.select("doc_id", "lang"), "lang", ["en", "fr", "de", "es"]).drop("lang")
    return zip_columns(d.select("doc_id", "text"), dummies, on=["doc_id"])
