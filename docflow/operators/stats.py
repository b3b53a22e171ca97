"""Corpus and embedding statistics."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import word_count
from docflow.functions.vectors import doubles, features, norm

# Word counts under and over which a chunk is short or long, and the range that is best.
SHORT, LONG, BEST = 50, 500, (100, 300)


def size_stats(rows: DataFrame, value: Column) -> DataFrame:
    """A5: with exact quartiles; percentile keeps one count for each distinct value, not the rows."""
    v = rows.select(value.cast("double").alias("v"))
    q = lambda p: F.percentile("v", F.lit(p))
    return v.agg(
        F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(q(0.5), 6).alias("median"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.round(q(0.25), 6).alias("q25"), F.round(q(0.75), 6).alias("q75"), F.round(q(0.75) - q(0.25), 6).alias("iqr"),
    )


def size_flags(rows: DataFrame, value: Column) -> DataFrame:
    """Counts and percentages."""
    v = rows.select(value.alias("v"))
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 6)
    short, long_, best = F.col("v") < SHORT, F.col("v") > LONG, F.col("v").between(*BEST)
    return v.agg(F.count_if(short).alias("very_short"), F.count_if(long_).alias("very_long"), F.count_if(best).alias("optimal"), share(short).alias("short_pct"), share(long_).alias("long_pct"), share(best).alias("optimal_pct"))


def counts_by(rows: DataFrame, key: Column, name: str, n: int | None = None) -> DataFrame:
    """Most frequent first, ties by key."""
    out = rows.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out.limit(n) if n else out


def embedding_features(rows: DataFrame) -> DataFrame:
    """P17 for each row."""
    return rows.select("vec_id", "label", *[F.round(f, 6).alias(n) for f, n in zip(features(F.col("embedding")), ("norm", "mean", "std", "min_value", "max_value", "value_range"), strict=True)])


def embedding_stats(rows: DataFrame) -> DataFrame:
    """Of all vectors at once, from one row of sums for each vector."""
    e = doubles(F.col("embedding"))
    each = rows.select(norm(F.col("embedding")).alias("norm"), F.array_min(e).alias("lo"), F.array_max(e).alias("hi"), F.size(F.filter(e, lambda x: F.abs(x) < 1e-6)).alias("zeros"), F.size(e).alias("d"))
    return each.agg(
        F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("mean_norm"), F.round(F.stddev_pop("norm"), 6).alias("std_norm"), F.round(F.min("lo"), 6).alias("min_value"),
        F.round(F.max("hi"), 6).alias("max_value"), F.round(100.0 * F.sum("zeros") / F.sum("d"), 6).alias("sparsity_pct"), (F.sum("d") * 4).alias("bytes"),
    )


def dimension_stats(rows: DataFrame) -> DataFrame:
    """A10."""
    return rows.select(F.posexplode(doubles(F.col("embedding"))).alias("dim", "x")).groupBy("dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """All pairs of columns in one pass over the rows; null where a column is constant."""
    pairs = [(a, b) for a in names for b in names]
    one = rows.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 4).alias("r")) for a, b in pairs])
    return one.select(F.inline(cells))


def clusters(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The cell of each vector."""
    points = rows.withColumn("features", array_to_vector(doubles(F.col("embedding"))))
    return KMeans(k=k, seed=seed).fit(points).transform(points).withColumnRenamed("prediction", "cluster").drop("features")


def best_clusters(rows: DataFrame, ks: range, seed: int = 42) -> DataFrame:
    """Silhouette and inertia for each k; one model after the other, each a distributed fit."""
    points = rows.withColumn("features", array_to_vector(doubles(F.col("embedding")))).cache()
    found = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(points)
        found.append((k, float(ClusteringEvaluator().evaluate(model.transform(points))), float(model.summary.trainingCost)))
    points.unpersist()
    return rows.sparkSession.createDataFrame(found, "k int, silhouette double, inertia double")


def principal_components(rows: DataFrame, k: int = 2) -> DataFrame:
    """The mean is taken off first, which Spark's PCA leaves to the caller."""
    points = rows.withColumn("raw", array_to_vector(doubles(F.col("embedding"))))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(points).transform(points)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    return model.transform(centred).select("vec_id", vector_to_array("pc").alias("components"))


def ecdf(rows: DataFrame, value: Column) -> DataFrame:
    """I / n over the sorted values. Ranks come from counts by value, so no task holds all rows."""
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("value", "n", F.round(upto / total, 6).alias("cumulative"))


def advice(stats: DataFrame) -> DataFrame:
    """From one row with mean, std, short_pct, long_pct, optimal_pct, and what it has of sparsity_pct, mean_norm, silhouette."""
    c = F.col
    rules = [
        (c("std") > 0.5 * c("mean"), "sizes vary widely"), (c("short_pct") > 10, "many short chunks"),
        (c("long_pct") > 5, "many long chunks"), (c("optimal_pct") > 70, "most chunks have a good size"),
    ]
    if "sparsity_pct" in stats.columns:
        rules.append((c("sparsity_pct") > 10, "embeddings are sparse"))
    if "mean_norm" in stats.columns:
        usual = c("mean_norm").between(0.1, 10)
        rules += [(~usual, "norms are unusual"), (usual, "norms are usual")]
    if "silhouette" in stats.columns:
        strong, some = c("silhouette") > 0.5, c("silhouette") > 0.3
        rules += [(strong, "clusters are strong"), (some & ~strong, "clusters are moderate"), (~some, "clusters are weak")]
    return stats.select(F.array_compact(F.array(*[F.when(when, said) for when, said in rules])).alias("advice"))


#: The nine properties whose correlations are asked for.
PROPERTIES = ["word_count", "content_length", "section_depth", "norm", "mean", "std", "value_range", "max_value", "min_value"]


def property_correlations(chunks: DataFrame) -> DataFrame:
    """A, b, r for the nine properties of chunks (content, section_path, embedding) that have an embedding."""
    found = chunks.where(F.size("embedding") > 0)
    names = ("norm", "mean", "std", "min_value", "max_value", "value_range")
    rows = found.select(
        word_count(F.col("content")).alias("word_count"), F.length("content").alias("content_length"), F.coalesce(F.size("section_path"), F.lit(0)).alias("section_depth"),
        *[f.alias(n) for f, n in zip(features(F.col("embedding")), names, strict=True)],
    )
    return correlations(rows, PROPERTIES)


def enrichment_counts(chunks: DataFrame, matched: Column, core: list[str], entities: list[str]) -> DataFrame:
    """Chunks, those that match, those with a column beside the core ones, and the entities in all (arrays)."""
    extended = F.lit(False)
    for name in chunks.columns:
        if name not in core:
            extended = extended | F.col(name).isNotNull()
    each = F.lit(0)
    for name in entities:
        each = each + F.coalesce(F.size(name), F.lit(0))
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(matched).alias("matched"), F.count_if(extended).alias("extended"), F.coalesce(F.sum(each), F.lit(0)).alias("entities"))
