"""Matches over all lines of a group of documents, against loops in plain Python."""

import re

import pytest

from docflow.plans import registry, structure_queries


def norm(x):
    return re.sub(r"\s+", " ", x.lower().strip(" \t\n\r\f\v"), flags=re.ASCII)


@pytest.fixture(scope="module")
def want(spark, sf):
    """chunk_id -> kind of match -> (idx, confidence)."""
    groups = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        groups.setdefault(d.doc_id % 97, []).extend((line, n % 7) for n, line in enumerate(d.text.split("\n")))
    out = {}
    for c in structure_queries.parts(spark, sf).collect():
        content, elements = norm(c.content), [(i, norm(x), page) for i, (x, page) in enumerate(groups[c.doc_id])]
        exact = [i for i, x, _ in elements if x == content]
        holds = [i for i, x, _ in elements if 10 <= len(x) <= max(len(content) // 2, 20) and x in content]
        near = [(i, 0.6 if page == c.page else 0.4) for i, _, page in elements[:20] if abs(page - c.page) <= 2]
        out[c.chunk_id] = {"match_exact": (exact[-1], 1.0) if exact else None, "match_contains": (holds[0], 0.9) if holds else None, "match_page": near[0] if near else None}
    return out


@pytest.mark.parametrize("name", ["match_exact", "match_contains", "match_page"])
def test_each_kind(spark, sf, want, name):
    got = {r.chunk_id: (r.idx, r.confidence) for r in registry.QUERIES[name](spark, sf).collect()}
    assert got == {c: kinds[name] for c, kinds in want.items() if kinds[name]}


def test_priority(spark, sf, want):
    got = {r.chunk_id: None if r.idx is None else (r.idx, r.confidence) for r in registry.QUERIES["match_priority"](spark, sf).collect()}
    assert got == {c: next(filter(None, kinds.values()), None) for c, kinds in want.items()}


def test_all_lines_are_elements(spark, sf):
    lines = sum(len(r.text.split("\n")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    found = structure_queries.elements(spark, sf).collect()
    assert len(found) == lines == len({(r.doc_id, r.idx) for r in found}) and min(r.idx for r in found) == 0
