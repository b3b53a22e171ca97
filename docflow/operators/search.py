"""Vector search: exact top-k by score, inverted-file probing, two-stage retrieval with a re-ranker."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.config import IndexConfig, SearchConfig
from docflow.functions import nearest
from docflow.functions.text import lower, words
from docflow.functions.vectors import cosine, inner_product
from docflow.session import ship

#: Queries by which the recall of an index is measured, at most.
RECALL_QUERIES = 256
#: Rows and queries of a block, of which the best go on, and of one whose pairs are all kept; about as many, as rows are dealt by hash.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 8_192
PAIR_VECTORS, PAIR_QUERIES = 4_096, 256


def score_pairs(queries: DataFrame, data: DataFrame, metric: Callable[[Column, Column], Column] = inner_product, digits: int = 6, max_broadcast: int = SearchConfig.max_broadcast_queries) -> DataFrame:
    """Every query (query_id, q) with every row of data (vec_id, embedding, ...), scored; the queries are broadcast only if counted
    to be few. Scores are rounded so that ties do not hang on the order of a sum."""
    few = queries.limit(max_broadcast + 1).count() <= max_broadcast
    pairs = data.crossJoin(F.broadcast(queries) if few else queries)
    return pairs.withColumn("score", F.round(metric(F.col("embedding"), F.col("q")), digits)).drop("q", "embedding")


def top_k(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best rows for each query with their 1-based rank; Spark limits each task to k rows a query before the shuffle."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_blocks(queries: DataFrame, data: DataFrame, run: Callable, parts: int, groups: int, on: list[str] | None = None) -> DataFrame:
    """query_id, vec_id, score from run(rows of data, queries), which gets each part of the data with each group of the queries once;
    within equal values of `on` if there are any. So a task holds one part and one group."""
    ship(data.sparkSession)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [*(on or []), "_part", "_group"]
    d = data.withColumn("_part", deal("vec_id", parts)).withColumn("_group", each(groups))
    q = queries.withColumn("_group", deal("query_id", groups)).withColumn("_part", each(parts))
    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    return d.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, f"query_id {kind(queries, 'query_id')}, vec_id {kind(data, 'vec_id')}, score double")


def batch_search(queries: DataFrame, data: DataFrame, k: int = 10, metric: Callable = inner_product, exclude_self: bool = False) -> DataFrame:
    """The k best rows of data (vec_id, embedding) for each query (query_id, q), exactly. Inner products and cosines come from matrix
    products of blocks (functions/nearest), and only the k best of each block go on; other metrics score all pairs."""
    if metric not in (inner_product, cosine) or set(data.columns) != {"vec_id", "embedding"} or set(queries.columns) != {"query_id", "q"}:
        scored = score_pairs(queries, data, metric)
        return top_k(scored.where(F.col("query_id") != F.col("vec_id")) if exclude_self else scored, k)
    parts, groups = 1 + data.count() // BLOCK_VECTORS, 1 + queries.count() // BLOCK_QUERIES
    return top_k(best_in_blocks(queries, data, k, metric is cosine, exclude_self, parts, groups), k)


def best_in_blocks(queries: DataFrame, data: DataFrame, k: int, cosine: bool, exclude_self: bool, parts: int, groups: int, on: list[str] | None = None) -> DataFrame:
    asked = queries.withColumn("own", F.col("query_id").cast(data.schema["vec_id"].dataType)) if exclude_self else queries
    return by_blocks(asked, data, lambda d, q: nearest.best(d, q, k, cosine, exclude_self), parts, groups, on)


def all_products(queries: DataFrame, data: DataFrame) -> DataFrame:
    """query_id, vec_id, score: the inner product of every query with every row of data. The result is as large as their product; a task
    holds the pairs of one block."""
    parts, groups = 1 + data.count() // PAIR_VECTORS, 1 + queries.count() // PAIR_QUERIES
    return by_blocks(queries, data, lambda d, q: nearest.every(d, q), parts, groups)


def with_min_similarity(ranked: DataFrame, least: float) -> DataFrame:
    """after the top-k, never before."""
    return ranked.where(F.col("score") >= least)


def build_index(data: DataFrame, config: IndexConfig) -> tuple[DataFrame, list]:
    """K6: the cell of each vector (a partition column when stored) and the cells' centres."""
    points = data.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=config.n_cells, seed=config.seed, maxIter=10).fit(points)
    return model.transform(points).withColumnRenamed("prediction", "cell").drop("features"), model.clusterCenters()


def near_cells(spark: SparkSession, centers: list, queries: DataFrame) -> DataFrame:
    """query_id, q, cell, near: the rank of each cell by its centre."""
    cells = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, centre array<double>")
    order = Window.partitionBy("query_id").orderBy(F.desc(inner_product(F.col("q"), F.col("centre"))), "cell")
    return queries.crossJoin(F.broadcast(cells)).withColumn("near", F.row_number().over(order)).select("query_id", "q", "cell", "near")


def with_recall(indexed: DataFrame, centers: list, queries: DataFrame, k: int, config: IndexConfig, least: float = 0.95) -> IndexConfig:
    """config with the fewest probes, n_probe at least, that find the share `least` of the exact top k of sampled queries.

    A sample only sets the number of probes; the probe answers every query.
    """
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(RECALL_QUERIES)
    exact = batch_search(sample, indexed.select("vec_id", "embedding"), k).select("query_id", "vec_id")
    at = exact.join(indexed.select("vec_id", "cell"), "vec_id").join(near_cells(indexed.sparkSession, centers, sample).drop("q"), ["query_id", "cell"])
    found = {r.near: r.hits for r in at.groupBy("near").agg(F.count("*").alias("hits")).collect()}
    total, n, hits = sum(found.values()), 0, 0
    while hits < least * total:
        n += 1
        hits += found.get(n, 0)
    return replace(config, n_probe=max(n, config.n_probe))


def probe(indexed: DataFrame, centers: list, queries: DataFrame, k: int, config: IndexConfig) -> DataFrame:
    """Approximate top-k: only rows in the n_probe cells with the best centres are scored, in blocks of one cell."""
    near = near_cells(indexed.sparkSession, centers, queries)
    wanted = near.where(F.col("near") <= config.n_probe).select("query_id", "q", "cell")
    largest = indexed.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    parts, groups = 1 + largest // BLOCK_VECTORS, 1 + queries.count() // BLOCK_QUERIES
    return top_k(best_in_blocks(wanted, indexed.select("vec_id", "embedding", "cell"), k, False, False, parts, groups, ["cell"]), k)


def lexical_score(query: Column, content: Column) -> Column:
    """The offline re-ranker: the share of the query's distinct words that the content has, times 10, less 5."""
    q, c = F.array_distinct(words(lower(query))), words(lower(content))
    return F.coalesce(F.size(F.array_intersect(q, c)) / F.when(F.size(q) > 0, F.size(q)), F.lit(0.0)) * 10 - 5


def rerank(candidates: DataFrame, logit: Column, k: int) -> DataFrame:
    """original_rank and final_rank from 0; the sort is stable. rerank_score is scaled to 0..1 within the query (as it is where
    all are equal), rerank_probability is the sigmoid of the raw logit."""
    w = Window.partitionBy("query_id")
    scored = candidates.withColumn("logit", logit)
    low, high = F.min("logit").over(w), F.max("logit").over(w)
    scaled = scored.withColumn("low", low).withColumn("high", high)
    scaled = scaled.withColumn("rerank_score", F.when(F.col("high") > F.col("low"), (F.col("logit") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("logit"))).drop("low", "high")
    ranked = scaled.withColumn("rerank_probability", 1 / (1 + F.exp(-F.col("logit")))).withColumn("original_rank", F.col("rank") - 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("logit"), "rank")
    return ranked.withColumn("final_rank", F.row_number().over(order) - 1).where(F.col("final_rank") < k)


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def two_stage(queries: DataFrame, data: DataFrame, contents: DataFrame, config: SearchConfig = SearchConfig(), scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """O2: k * multiplier by vector, those of min_similarity, re-ranked, k best, one for each content key (so fewer than k may stay).

    queries: query_id, q, query; contents: vec_id, chunk_key, content. The window filters keep the scorer on exactly the candidates.
    """
    first = with_min_similarity(batch_search(queries.select("query_id", "q"), data, config.k * config.multiplier), config.min_similarity)
    named = first.join(contents, "vec_id").join(F.broadcast(queries.select("query_id", "query")), "query_id")
    best = rerank(named, scorer(F.col("query"), F.col("content")), config.k)
    return keep_first(best, ["query_id", "chunk_key"], [F.col("final_rank")])


__all__ = ["all_products", "batch_search", "build_index", "cosine", "keep_first", "lexical_score", "probe", "rerank", "score_pairs", "top_k", "two_stage", "with_min_similarity", "with_recall"]
