"""Work grows with the input, and odd characters, halves and rows come out as in SQL."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docflow.config import IndexConfig
from docflow.functions import substrings, text
from docflow.operators import context, enrich, evaluate, search, structure, tables
from docflow.plans import registry


def same_rows(spark, folder, name):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    rows = want.fetchall()
    assert rows and sorted(got, key=repr) == sorted(rows, key=repr)


# F1


@pytest.mark.parametrize("block", [40, 1 << 19])
def test_first_substring(monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "PLACES", block)
    made = random.Random(block)
    for letters in ("a", "ab", "abc ", "aß€ 😀"):
        word = lambda low, high: "".join(made.choice(letters) for _ in range(made.randrange(low, high)))  # noqa: B023, E731
        texts = [word(0, 300) for _ in range(20)]
        strings = list({word(10, 30) for _ in range(20)} | {t[i : i + n] for t in texts for i, n in ((3, 12), (0, 90), (5, 200)) if len(t) >= i + n})
        made.shuffle(strings)
        most = np.array([made.choice([10, 20, 400]) for _ in texts])
        got = substrings.Substrings(pa.array(strings)).first(pa.array(texts), most)
        assert got.tolist() == [next((i for i, s in enumerate(strings) if len(s) <= m and s in t), -1) for t, m in zip(texts, most, strict=True)]


@pytest.mark.parametrize("chars", [60, 1 << 26])
def test_contained_elements_without_a_join(spark, monkeypatch, chars):
    monkeypatch.setattr(enrich, "ELEMENT_CHARS", chars)
    chunks = [("a", 1, "Some words, and  THE LAST ONES of all of them in here"), ("b", 1, "too short"), ("c", 2, "the last ones of all"), ("d", 3, None), ("e", 1, "x the last ones of all, of all of them in here y z")]
    elements = [(1, 5, "the last ones of all"), (1, 3, "of all of them in here"), (1, 4, "of all  of them in here"), (1, 1, "words"), (2, 0, "something else"), (1, 9, "the last ones")]
    found = enrich.match_contains(spark.createDataFrame(chunks, "chunk_id string, doc_id long, content string"), spark.createDataFrame(elements, "doc_id long, idx int, text string"))
    assert sorted((r.chunk_id, r.idx) for r in found.collect()) == [("a", 3), ("e", 3)]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


# F2


def test_three_digits(spark):
    scores = [0.4165, 0.0005, -0.0005, 0.0625, 0.1875, 0.9995, 2.0, None]
    got = [r.t for r in spark.createDataFrame([(s,) for s in scores], "s double").select(context.three_digits(F.col("s")).alias("t")).collect()]
    assert got == ["0.416", "0.001", "-0.001", "0.062", "0.188", "1.000", "2.000", "null"]


# F3, F4


def test_letters_one_by_one(spark):
    r = spark.createDataFrame([("straße ﬁ ǆ ᾀ éΣς",)], "t string").select(text.upper(F.col("t")).alias("u"), text.lower(text.upper(F.col("t"))).alias("l"), text.lower(F.lit("ΟΔΟΣ İ")).alias("s")).first()
    assert (r.u, r.l, r.s) == ("STRAẞE ﬁ Ǆ ᾈ ÉΣΣ", "straße ﬁ ǆ ᾀ éσσ", "οδοσ i")


@pytest.mark.parametrize("name", ["match_exact", "match_contains", "match_priority", "normalize_text"])
def test_matches_of_odd_letters(spark, tmp_path, name):
    texts = ["Eine Straße, groß genug\nund mehr davon", "ΟΔΟΣ ΑΣ ΟΔΟΣ\nΑΣ", "İstanbul ist eine Stadt\nIJ", "plain text\nplain text"] * 3
    pq.write_table(pa.table({"doc_id": pa.array(range(0, 97 * len(texts), 97), pa.int64()), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts)}), tmp_path / "documents.parquet")
    same_rows(spark, tmp_path, name)


# Searches, and metrics of classes


def odd_vectors(spark, seed=1):
    made = np.random.default_rng(seed)
    rows = [(i, made.integers(-3, 4, 4).astype(float).tolist(), i % 5) for i in range(300)]
    rows += [(i, v, 1) for i, v in enumerate([None, [1.0, None, 2.0, 0.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], [1.0, 2.0], [0.0] * 4, [1e200] * 4, [1e-200] * 4, []], 300)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" if seed else "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("name", ["inner_product", "cosine"])
@pytest.mark.parametrize("seed", [0, 1])
def test_blocks_give_the_rows_of_all_pairs(spark, monkeypatch, name, exclude_self, seed):
    monkeypatch.setattr(search, "BLOCK_VECTORS", 90)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 20)
    data = odd_vectors(spark, seed).select("vec_id", "embedding")
    asked = data.where("vec_id % 10 = 0 or vec_id >= 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    metric = getattr(search, name)
    want = search.batch_search(asked, data, 7, lambda a, b: metric(a, b), exclude_self)
    found = search.batch_search(asked, data, 7, metric, exclude_self)
    rows = lambda df: sorted(map(repr, df.select("query_id", "rank", "vec_id", (F.col("score") + 0.0).alias("score")).collect()))
    assert rows(found) == rows(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("NestedLoop", "CartesianProduct")) and "FlatMapCoGroupsInArrow" in plan


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VECTORS", 700)
    data = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    asked = data.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = search.batch_search(asked, data, 3, exclude_self=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(q, k + 1, v) for q in range(0, 3000, 100) for k, v in enumerate([1, 2, 3] if q == 0 else [0, 1, 2])]


def test_metrics_of_classes(spark):
    made = np.random.default_rng(3)
    rows = [(i, None if i % 50 == 7 else int(made.integers(0, 6)) if i else 77, int(made.integers(0, 3))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, class int, relevance int")
    queries = docs.where("doc_id % 20 in (0, 7)").select(F.col("doc_id").alias("query_id"), "class")
    run = spark.createDataFrame([(q, k + 1, int(d)) for q in (*range(0, 400, 20), *range(7, 380, 20)) for k, d in enumerate(made.permutation(400)[:20])], "query_id long, rank int, doc_id long")
    qrels = queries.join(docs, "class").where("query_id <> doc_id").select("query_id", "doc_id", "relevance")
    run = run.where("query_id <> doc_id")
    rows = lambda df: sorted((r.query_id, r.k, *(round(x, 9) for x in r[2:])) for r in df.collect())
    found = evaluate.per_query_by_class(run, queries, docs)
    assert rows(found) == rows(evaluate.per_query(run, qrels)) and found.count() > 100


# F21


def test_all_products_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIR_VECTORS", 90)
    monkeypatch.setattr(search, "PAIR_QUERIES", 20)
    data = odd_vectors(spark).select("vec_id", "embedding")
    asked = data.where("vec_id % 10 = 0 or vec_id >= 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = lambda df: sorted(map(repr, df.select("query_id", "vec_id", (F.col("score") + 0.0).alias("score")).collect()))
    found = search.all_products(asked, data)
    assert rows(found) == rows(search.score_pairs(asked, data))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


# F22


def test_probes_of_all_cells_are_exact(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VECTORS", 50)
    data = odd_vectors(spark).where("vec_id < 300").select("vec_id", "embedding")
    asked = data.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    config = IndexConfig(4, 4)
    indexed, centers = search.build_index(data, config)
    found = search.probe(indexed, centers, asked, 5, config)
    rows = lambda df: sorted(map(repr, df.select("query_id", "rank", "vec_id", "score").collect()))
    assert rows(found) == rows(search.batch_search(asked, data, 5, lambda a, b: search.inner_product(a, b)))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


# F9


def test_parts_of_a_large_table(spark):
    made = random.Random(9)
    rows = {t: [(i, f"row {t} {i}", made.choice([0, 3, 20, 20, 500])) for i in range(n)] for t, n in ((1, 5000), (2, 1), (3, 12), (None, 4))}
    want = []
    for t, xs in rows.items():
        head, room, held, parts = xs[0], 1 << 30 if sum(x[2] for x in xs) <= 512 else 450 - xs[0][2], 0, [[]]
        for x in xs[1:]:
            if held > 0 and held + x[2] > room:
                held, parts = 0, [*parts, []]
            held += x[2]
            parts[-1].append(x[1])
        want += [(t, k + 1, len(parts), "\n".join([head[1], *p])) for k, p in enumerate(parts)]
    flat = [(t, *x) for t, xs in rows.items() for x in xs]
    made.shuffle(flat)
    found = tables.pack_rows(spark.createDataFrame(flat, "table_id long, row_index long, line string, tokens int"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert "aggregate(" not in found._jdf.queryExecution().analyzed().toString()


# F6, F23, F24


def test_headings_over_contents():
    body = "# One\n  first words   of all\there \n### Deep\nshort\x0b\n## Two\nlast words of the text\n" + "#" * 13 + " far\nend of it all comes now"
    contents = ["first words   of all\there", "first words of all here", "short", "last words of the text", "end of it all comes now", "not there at all in it", None, ""]
    got = structure.headings_over(body, contents)
    far = (["One", "Two", "far"], [1, 2, 13])
    assert got == [(["One"], [1]), (["One"], [1]), (["One", "Deep"], [1, 3]), (["One", "Two"], [1, 2]), far, far, far, (["One"], [1])]
    assert structure.headings_over("no heading", ["no heading"]) == [None] == structure.headings_over(None, ["x"])


@pytest.mark.parametrize("name", ["chunk_under_headings", "toc_candidates", "toc_density"])
def test_documents_are_not_dealt_out(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_chunks_of_a_document_meet_its_text_once(spark, sf):
    plan = registry.QUERIES["chunk_headings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and "collect_list" in plan
