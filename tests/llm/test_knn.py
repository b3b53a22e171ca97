"""op5 against all products."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import knn, queries


def brute(rows, k, is_query):
    usable = {(i, tuple(math.floor(1024 * c) for c in x)) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)}
    out = []
    for i, q in sorted(usable):
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for j, x in usable if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = queries.op5_voronoi_knn(spark, sf)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(con.sql(knn.SEARCH_SQL).fetchall())


def test_clusters_are_pruned_and_whole(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6)) * 20
    rows = [(i, [float(c) for c in centres[i % 8] + rng.normal(size=6) * 0.05]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (None, rows[0][1]), (2010, [None] * 6), (2020, [float("nan")] * 6), (2030, [1.0]), (2040, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = knn.search(df, F.col("vec_id") % 10 == 0, 5, n_pivots=8, group_queries=10, block_rows=100)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, lambda i: i % 10 == 0)


def test_bounds_exclude_most_products_at_the_defaults(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 10
    rows = [(i, [float(c) for c in centres[i * 7 % 40] + rng.normal(size=8) * 0.1]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = knn.plan(df, F.col("vec_id") % 100 == 0, 10, 1024, None, knn.GROUP_QUERIES)
    assert len(made.grouping.cells) > 1 and made.routed_share < 0.5
    assert sorted(map(tuple, knn.search(df, F.col("vec_id") % 100 == 0).collect())) == brute(rows, 10, lambda i: i % 100 == 0)


def test_a_group_of_many_queries_is_cut(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.search(df, F.col("vec_id") % 2 == 0, 3, n_pivots=2, group_queries=16, block_rows=64).collect())) == brute(rows, 3, lambda i: i % 2 == 0)


@pytest.mark.parametrize("x", [1e18, 4e9])
def test_scores_beyond_64_bits_are_an_error(spark, x):
    df = spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="Overflow|too large"):
        knn.search(df, F.col("vec_id") % 100 == 0).collect()


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (100, [1e6, -1e9])], "vec_id long, embedding array<double>")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 10, lambda i: i % 100 == 0)
    assert sorted(map(tuple, knn.search(df, F.col("vec_id") % 100 == 0).collect())) == want
    assert knn.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
