"""Retrieval metrics: precision, recall, nDCG, MAP over runs (query_id, rank, doc_id, score) and judgements (query_id, doc_id, relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.config import EVALUATION_DEPTHS


def judged_queries(qrels: DataFrame) -> DataFrame:
    """Queries with a relevant document, and how many."""
    return qrels.where(F.col("relevance") > 0).groupBy("query_id").agg(F.count("*").alias("n_relevant"))


def ideal_gains(qrels: DataFrame, depth: int) -> DataFrame:
    """query_id, ideal_rank, gain."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    return qrels.where(F.col("relevance") > 0).withColumn("ideal_rank", F.row_number().over(w)).where(F.col("ideal_rank") <= depth)


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = EVALUATION_DEPTHS) -> DataFrame:
    """query_id, k, precision, recall, ndcg, ap for each judged query and depth; a query without results scores 0.

    Gains are linear, discounted by log2(rank + 1); average precision divides by the number of relevant documents.
    """
    judged = judged_queries(qrels)
    hits = run.join(judged.select("query_id"), "query_id", "left_semi").join(qrels, ["query_id", "doc_id"], "left")
    return measures(hits, judged, ideal_gains(qrels, max(ks)), ks)


def per_query_by_class(run: DataFrame, queries: DataFrame, docs: DataFrame, ks: tuple[int, ...] = EVALUATION_DEPTHS) -> DataFrame:
    """As per_query, where the documents of a query's class are its judgements: queries (query_id, class), docs (doc_id, class,
    relevance), without the one whose doc_id is query_id.

    These judgements are about queries times documents. So each class is counted and its best documents are found once; of a query's
    own document only the relevance is taken off.
    """
    relevant = docs.where((F.col("relevance") > 0) & F.col("class").isNotNull())
    own = relevant.select(F.col("doc_id").alias("query_id"), "class", F.lit(1).alias("own"))
    counts = queries.join(relevant.groupBy("class").agg(F.count("*").alias("n")), "class").join(own, ["query_id", "class"], "left")
    judged = counts.select("query_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_relevant")).where(F.col("n_relevant") > 0)
    best = Window.partitionBy("class").orderBy(F.desc("relevance"), "doc_id")
    top = relevant.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(ks) + 1)
    ideal = ideal_gains(queries.join(top, "class").where(F.col("query_id") != F.col("doc_id")).select("query_id", "doc_id", "relevance"), max(ks))
    hits = run.join(judged.select("query_id"), "query_id", "left_semi").join(queries, "query_id").withColumnRenamed("class", "asked")
    gains = F.when((F.col("asked") == F.col("class")) & (F.col("query_id") != F.col("doc_id")), F.col("relevance"))
    hits = hits.join(docs.select("doc_id", "class", "relevance"), "doc_id", "left").withColumn("relevance", gains)
    return measures(hits, judged, ideal, ks)


def measures(hits: DataFrame, judged: DataFrame, ideal: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """From the results of judged queries with their relevance (null: not judged), the numbers of relevant documents, the ideal gains."""
    depths = hits.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = hits.withColumn("gain", F.greatest(F.coalesce("relevance", F.lit(0)), F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("hit", (F.col("gain") > 0).cast("int")).withColumn("so_far", F.sum("hit").over(order))
    discount = F.log2(F.col("rank") + 1)
    at = hits.crossJoin(F.broadcast(depths)).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(
        F.sum("hit").alias("hits"), F.sum(F.col("gain") / discount).alias("dcg"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions")
    )
    ideal = ideal.crossJoin(F.broadcast(depths)).where(F.col("ideal_rank") <= F.col("k"))
    ideal = ideal.groupBy("query_id", "k").agg(F.sum(F.col("relevance") / F.log2(F.col("ideal_rank") + 1)).alias("idcg"))
    every = judged.crossJoin(F.broadcast(depths)).join(at, ["query_id", "k"], "left").join(ideal, ["query_id", "k"], "left").fillna(0, ["hits", "dcg", "precisions", "idcg"])
    return every.select(
        "query_id", "k", (F.col("hits") / F.col("k")).alias("precision"), (F.col("hits") / F.col("n_relevant")).alias("recall"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), (F.col("precisions") / F.col("n_relevant")).alias("ap"),
    )


def evaluate(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = EVALUATION_DEPTHS) -> DataFrame:
    """The means over judged queries, one row for each depth."""
    return means(per_query(run, qrels, ks))


def means(measured: DataFrame) -> DataFrame:
    columns = [F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "ndcg")]
    return measured.groupBy("k").agg(*columns, F.round(F.avg("ap"), 6).alias("map"))


def run_map(run: DataFrame) -> DataFrame:
    """query_id and the map of its documents to scores."""
    return run.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_id", "score")))).alias("results"))


def success_rate(run: DataFrame, queries: DataFrame) -> DataFrame:
    """The share of queries with a result."""
    found = run.select("query_id").distinct().withColumn("has", F.lit(1))
    return queries.select("query_id").join(found, "query_id", "left").agg(F.round(F.avg(F.coalesce("has", F.lit(0))), 6).alias("success_rate"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of _id, title, text."""
    return spark.read.schema("_id string, title string, text string").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgements of three columns (query, document, relevance) or four (with an iteration), with or without a header."""
    raw = spark.read.schema("a string, b string, c string, d string").option("sep", "\t").option("mode", "PERMISSIVE").csv(path)
    four = F.col("d").isNotNull()
    rows = raw.select(F.col("a").alias("query_id"), F.when(four, F.col("c")).otherwise(F.col("b")).alias("doc_id"), F.expr("try_cast(coalesce(d, c) as int)").alias("relevance"))
    return rows.where(F.col("relevance").isNotNull())
