"""Training-data operators: toxicity, fingerprints, sharding, near-duplicate joins,
decontamination, chat formatting, token counts, mixing, token files, quality, language-model
scores, centroid clustering and phrase mining.

Each module holds one operator with its own interface and one thin query; the
queries are gathered in ``novelspark.llm.entry``.  Nothing outside this package
imports it.
"""
