"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from docflow.llm import chat, classifier, knn, licenses, ngram_join, oracles, packing, rules, sharding, word_bpe


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op2_token_counts(spark, sf_dir):
    return word_bpe.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_bpe_roundtrip(spark, sf_dir):
    return word_bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_jaccard(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), 4, 85, 100)


def op5_voronoi_knn(spark, sf_dir):
    return knn.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_chat_perspectives(spark, sf_dir):
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op7_virtual_slots(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_license_scan(spark, sf_dir):
    return licenses.scan_documents(_table(spark, sf_dir, "documents"))


def op10_rule_cascade(spark, sf_dir):
    return rules.judge(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_token_counts, op3_bpe_roundtrip, op4_ngram_jaccard, op5_voronoi_knn, op6_chat_perspectives, op7_virtual_slots, op8_best_fit_packing, op9_license_scan, op10_rule_cascade)
}

ORACLE_SQL = {
    "op4_ngram_jaccard": oracles.NGRAM_JACCARD_SQL, "op10_rule_cascade": oracles.RULES_SQL, "op5_voronoi_knn": knn.SEARCH_SQL, "op6_chat_perspectives": chat.ROTATE_SQL,
}
