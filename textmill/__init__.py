"""textmill: text-classification data work as Spark DataFrame operators.

Layout:
  sources/    readers and writers (CSV, TSV, parquet, word vectors, models, logs)
  functions/  Column expressions (cleaning, tokenising, seeded hashes, fixed values)
  operators/  DataFrame -> DataFrame operators (stats, ranks, sampling, labels,
              vocabulary, embeddings, evaluation, models)
  plans/      the registered queries and their DuckDB oracles
  streaming/  file-stream scoring with a saved pipeline
"""

__version__ = "0.1.0"
