"""Merges of small chunks that are whole texts, against a loop in plain Python."""

from docflow.plans import registry


def test_merges_hold_whole_texts(spark, sf):
    documents = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = lambda x: set(x.lower().split())
    paths = [["A"], ["A", "B"], ["C", "D", "E"], []]
    mergeable, merged = {}, {}
    for g in sorted({i // 8 for i in documents}):
        ids, skip = [i for i in sorted(documents) if i // 8 == g], False
        for n, i in enumerate(ids):
            a, path, text = documents[i], paths[i % 4], documents[i].text
            ok = False
            if n + 1 < len(ids):
                b, after = documents[ids[n + 1]], paths[ids[n + 1] % 4]
                x, y = words(a.text), words(b.text)
                related = after[: len(path)] == path or path[: len(after)] == after or (len(path) == len(after) and sum(p != q for p, q in zip(path, after, strict=True)) <= 1)
                mergeable[g, i % 8] = ok = related or bool(x | y) and len(x & y) / len(x | y) > 0.6
            if skip:
                skip = False
                continue
            skip = ok and len(text.split()) < 50
            merged[g, i % 8] = (text + "\n\n" + b.text, True) if skip else (text, False)
    assert {(r.doc_id, r.chunk_index): r.mergeable for r in registry.QUERIES["mergeable_pairs"](spark, sf).collect()} == mergeable
    assert {(r.doc_id, r.chunk_index): (r.content, r.merges) for r in registry.QUERIES["merge_small"](spark, sf).collect()} == merged
