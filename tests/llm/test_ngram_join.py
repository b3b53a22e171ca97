"""op4 against all pairs."""

import random
import re

from pyspark.sql import functions as F

from docflow.llm import ngram_join, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k, num, den):
    """doc_id -> (set size, least doc_id of the component), from all pairs that share a shingle."""
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_gram = {}
    for i, s in sets.items():
        for g in s:
            by_gram.setdefault(g, []).append(i)
    tested = set()
    for group in by_gram.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in tested:
                    tested.add((a, b))
                    if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard(spark, sf).collect()}
    assert got == brute(texts, 4, 85, 100)


def test_near_copies(spark):
    rng = random.Random(3)
    texts = {}
    for group in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"x{rng.randrange(30)}"] * rng.randrange(1, 3)
            texts[len(texts) * 3 + 1] = " ".join(words)
    odd = [None, "", " \n", "one", "One", "ONE two", "a b c", "A\tB\nC", "é É", "a b c d"]
    texts |= {10_000 + i: t for i, t in enumerate(odd)}
    texts[20_000] = "z y x " * 30_000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        want = brute(texts, k, num, den)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, k, num, den).collect()} == want
        kept = ngram_join.one_of_each(docs, k, num, den)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (7, ""), (7, ""), (None, "q r s t u")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert rows == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (7, 0, 7), (7, 0, 7), (None, 2, None)], key=str)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    assert [r.doc_id for r in ngram_join.one_of_each(docs.where("doc_id = 1")).collect()] == [1]
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_one_row_of_each_component_with_null_and_shared_ids(spark):
    a, b, c, d = "a b c d e f", "q r s t u v", "g h i j k l", "m n o p w x"
    kept = lambda rows: sorted(map(tuple, ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, fp string")).select("doc_id", "text").collect()), key=str)
    assert kept([(1, a, ""), (None, a, ""), (None, b, ""), (None, c, "")]) == sorted([(1, a), (None, b), (None, c)], key=str)
    assert kept([(1, a, ""), (1, b, ""), (2, b, ""), (3, c, "")]) == [(1, a), (1, b), (3, c)]
    assert kept([(1, a, ""), (2, a, ""), (2, b, ""), (2, b.upper(), ""), (4, d, "")])[::2] == [(1, a), (4, d)]
    assert kept([(7, "", ""), (7, "", ""), (7, " ", ""), (7, None, ""), (7, d, ""), (None, None, ""), (None, None, "")]) == sorted([(7, ""), (7, " "), (7, None), (7, d), (None, None)], key=str)


def form_letters(n):
    """Letters with three filled fields of twelve values."""
    rng = random.Random(5)
    texts = {}
    for i in range(n):
        words = [f"b{j}" for j in range(120)]
        for f in range(3):
            v = rng.randrange(12)
            words[20 + f * 40 : 23 + f * 40] = [f"n{f}_{v}_{j}" for j in range(3)]
        texts[i] = " ".join(words)
    return texts


def test_a_family_of_form_letters_gives_few_pairs(spark, monkeypatch):
    pairs, classes = [], []
    links = ngram_join.links

    def counted(found, sets, num, den):
        pairs.append(found.count())
        classes.append(sets.count())
        return links(found, sets, num, den)

    monkeypatch.setattr(ngram_join, "links", counted)
    totals = []
    for n in (300, 1200):
        pairs.clear()
        texts = form_letters(n)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        if n == 300:
            assert got == brute(texts, 4, 85, 100)
        totals.append((classes[-1], sum(pairs)))
    (few, a), (many, b) = totals
    assert b / a < (many / few) ** 1.3


def test_narrow_tables_are_few_files_where_partitions_are_not_merged(spark, monkeypatch):
    files, write = {}, ngram_join.materialize

    def counted(df, name, keep=False):
        out = write(df, name, keep)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    docs = spark.createDataFrame([(i, t) for i, t in form_letters(600).items()], "doc_id long, text string")
    want = sorted({c for _, c in brute(form_letters(600), 5, 80, 100).values()})
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    most = spark.sparkContext.defaultParallelism
    for name in ("classes", "centres", "pairs", "stars", "edges", "labels", "band-centres", "main", "components", "heads"):
        assert files[name] and max(files[name]) <= most, name
