"""Searches ask with every row whose id is divisible by 100, against all rows."""

import numpy as np
import pytest

from docflow.plans import registry


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    return np.array([r.embedding for r in rows], np.float64)


def best(vectors, k, exclude_self, cosine=False):
    """query_id -> the k best (vec_id, score), by comparing with every vector."""
    out = {}
    for q in range(0, len(vectors), 100):
        s = vectors @ vectors[q]
        s = np.round(s / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(vectors[q])) if cosine else s, 6)
        ids = np.array([i for i in range(len(vectors)) if not exclude_self or i != q])
        order = ids[np.lexsort((ids, -s[ids]))][:k]
        out[q] = [(int(i), round(float(s[i]), 6)) for i in order]
    return out


def answers(spark, sf, name):
    out = {}
    for r in registry.QUERIES[name](spark, sf).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score, abs=2e-6)))
    return out


@pytest.mark.parametrize(("name", "k", "exclude_self"), [("vector_topk", 10, False), ("cosine_topk", 10, False), ("batch_search", 20, True)])
def test_top_k(spark, sf, vectors, name, k, exclude_self):
    assert answers(spark, sf, name) == best(vectors, k, exclude_self, name == "cosine_topk")


def test_min_similarity_and_success(spark, sf, vectors):
    want = best(vectors, 20, True)
    assert answers(spark, sf, "topk_min_sim") == {q: kept for q, hits in want.items() if (kept := [h for h in hits if h[1] >= 0.2])}
    assert registry.QUERIES["success_rate"](spark, sf).first().success_rate == pytest.approx(np.mean([hits[0][1] >= 0.5 for hits in want.values()]), abs=1e-6)


@pytest.mark.parametrize("name", ["minmax_norm", "rerank_ranks", "rerank_probability"])
def test_reranked(spark, sf, vectors, name):
    got = {(r.query_id, r.vec_id) for r in registry.QUERIES[name](spark, sf).collect()}
    assert got == {(q, i) for q, hits in best(vectors, 20, True).items() for i, _ in hits}


def test_runs_and_metrics(spark, sf, vectors):
    want = best(vectors, 20, True)
    assert {r.query_id: r.n_results for r in registry.QUERIES["beir_run"](spark, sf).collect()} == {q: 20 for q in want}
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    relevant = {q: {i for i in label if i != q and label[i] == label[q]} for q in want}
    for k in (1, 5, 20):
        hits = {q: sum(i in relevant[q] for i, _ in found[:k]) for q, found in want.items()}
        at = lambda name: registry.QUERIES[f"ir_{name}"](spark, sf).where(f"k = {k}").first()[name]  # noqa: E731, B023
        assert at("precision") == pytest.approx(np.mean([hits[q] / k for q in want]), abs=1e-6)
        assert at("recall") == pytest.approx(np.mean([hits[q] / len(relevant[q]) for q in want]), abs=1e-6)


@pytest.mark.parametrize("name", ["context_budget", "format_context"])
def test_contexts(spark, sf, vectors, name):
    ids = {r.query_id for r in registry.QUERIES[name](spark, sf).select("query_id").collect()}
    assert ids <= set(range(0, len(vectors), 100)) and max(ids) >= 100


def test_every_question_is_asked(spark, sf):
    items = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r.query_id for r in registry.QUERIES["rag_answers"](spark, sf).select("query_id").collect()} == items
    assert max(r.query_id for r in registry.QUERIES["two_stage_retrieval"](spark, sf).select("query_id").collect()) >= 8


def test_inner_products_of_all_rows(spark, sf, vectors):
    got = {(r.a, r.b): r["product"] for r in registry.QUERIES["inner_products"](spark, sf).collect()}
    assert got.keys() == {(a, b) for a in range(0, len(vectors), 100) for b in range(len(vectors))}
    assert all(abs(p - vectors[a] @ vectors[b]) < 2e-6 for (a, b), p in got.items())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_of_the_index(spark, folder):
    path = f"/root/testdata/{folder}"
    hits = lambda name: {(r.query_id, r.vec_id) for r in registry.QUERIES[name](spark, path).collect()}
    exact, found = hits("vector_topk"), hits("ivf_search")
    assert {q for q, _ in exact} == {q for q, _ in found}
    assert len(exact & found) / len(exact) >= 0.9
