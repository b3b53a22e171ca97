"""Statistics that SQL does not express, and odd rows."""

from docflow.operators import enrich, maintenance, stats
from docflow.operators.tables import grid_to_markdown


def test_correlation_with_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 5.0, 7.0)], "x double, y double, c double")
    got = {(r.a, r.b): r.r for r in stats.correlations(rows, ["x", "y", "c"]).collect()}
    assert got["x", "x"] == 1.0 and got["x", "y"] == 0.982 and got["x", "c"] is None and got["c", "c"] is None


def test_advice_on_clusters_and_vectors(spark):
    base = "mean double, std double, short_pct double, long_pct double, optimal_pct double"

    def said(schema, *row):
        return stats.advice(spark.createDataFrame([row], schema)).first().advice

    assert said(base, 10.0, 9.0, 0.0, 6.0, 0.0) == ["sizes vary widely", "many long chunks"]
    more = base + ", sparsity_pct double, mean_norm double, silhouette double"
    assert said(more, 10.0, 1.0, 0.0, 0.0, 0.0, 11.0, 20.0, 0.5) == ["embeddings are sparse", "norms are unusual", "clusters are moderate"]
    assert said(more, 10.0, 1.0, 0.0, 0.0, 0.0, 0.0, 10.0, 0.51) == ["norms are usual", "clusters are strong"]
    assert said(more, 10.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.3) == ["norms are usual", "clusters are weak"]


def test_last_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (None, 1, "d"), (2, None, "e")], "k int, at int, v string")
    got = {r.k: (r.v, r.merged) for r in maintenance.last_wins(rows, ["k"], ["at"]).collect()}
    assert got == {1: ("c", 3), None: ("d", 1), 2: ("e", 1)}


def test_priority_of_matches_with_the_fuzzy_step(spark):
    elements = spark.createDataFrame([(1, 0, "the exact words", 1), (1, 1, "a part of it all", 2), (1, 2, "almost the very same line", 3)], "doc_id long, idx int, text string, page int")
    chunks = [("a", 1, "The  exact words", 9), ("b", 1, "here is a part of it all, and many more words follow it", 9), ("c", 1, "almost the very same lime", 9), ("d", 1, "no", 4), ("e", 1, "no", 9), ("f", 2, "the exact words", 1)]
    got = enrich.match_priority(spark.createDataFrame(chunks, "chunk_id string, doc_id long, content string, page int"), elements).collect()
    assert {r.chunk_id: (r.method, r.idx) for r in got} == {"a": ("content_exact", 0), "b": ("content_contains", 1), "c": ("content_fuzzy", 2), "d": ("position", 1), "e": (None, None), "f": (None, None)}


def test_a_grid_of_one_row(spark):
    rows = spark.createDataFrame([([["a", "b"]],), ([["a"], ["1"], ["2"]],)], "g array<array<string>>")
    assert [r.m for r in rows.select(grid_to_markdown(rows.g).alias("m")).collect()] == ["| a | b |\n| --- | --- |", "| a |\n| --- |\n| 1 |\n| 2 |"]
