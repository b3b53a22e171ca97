"""op2 and op3 against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docflow.llm import queries, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "Hello <|endoftext|> wörld it's 12!", "<|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ İstanbul ß", "é a b　c",
    "x\x1cy \x1f z", "don't they'RE'LL 's'", "a" * 3000, "!!! ??? ...", "日本語 テキスト 한국어", "İ̇ x\u0085y z", "tab\tnew\nline\r\n", "<|endoftext", "1234 ½ ²", "😀😀 👨‍👩‍👧",
    "abc " * 2000,
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_odd_texts(spark, reference):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)] + [(0, None, 1), (4, ODD[4], 1)], "doc_id long, text string, n_tokens long")
    want = []
    for i, t in [*enumerate(ODD), (0, None), (4, ODD[4])]:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, word_bpe.encode_digests(docs, PATH).collect())) == sorted(want)
    counted = sorted(map(tuple, word_bpe.token_counts(docs, PATH, 5, block_chars=50).collect()))
    assert counted == sorted((i, len((t or "").encode()), n, n > 5) for (i, n, _, _), t in zip(want, [*ODD, None, ODD[4]], strict=True))
    full = {r.doc_id: r for r in word_bpe.encode_documents(docs.limit(len(ODD)), PATH).collect()}
    assert all(list(full[i].ids) == reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD))


def test_whole_table(spark, sf, reference):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_bpe_roundtrip(spark, sf).collect()}
    counts = {r.doc_id: r for r in queries.op2_token_counts(spark, sf).collect()}
    assert set(got) == set(counts) == set(rows)
    for i, text in rows.items():
        ids = reference.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == counts[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert word_bpe.encode_digests(docs, PATH).count() == 0
    assert word_bpe.token_counts(docs, PATH).count() == 0


def test_segment_tree_against_scan():
    ranks = {(0, 0): (1, 2), (0, 1): (0, 3), (2, 3): (2, 4), (3, 3): (3, 5), (2, 2): (4, 6)}

    def scan(s):
        while True:
            found = min(((ranks[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks), default=None)
            if not found:
                return s
            i = found[1]
            s = [*s[:i], ranks[s[i], s[i + 1]][1], *s[i + 2 :]]

    for n in range(1, 200):
        s = [(n * k * k + k // 3) % 2 for k in range(n)]
        assert word_bpe.segment_tree_merge(s, ranks) == scan(s)


def test_trees_side_by_side_against_one_tree():
    import numpy as np

    ranks = {(0, 0): (1, 2), (0, 1): (0, 3), (2, 3): (2, 4), (3, 3): (3, 5), (2, 2): (4, 6), (1, 1): (5, 2)}
    pairs = word_bpe.PairTable(ranks, 7)
    for width in (2, 4, 16, 64):
        words = [[(n * k * k + k // 3 + n // 7) % 2 for k in range(1 + n % width)] for n in range(300)]
        symbols = np.full((len(words), width), 7, np.int64)
        for i, w in enumerate(words):
            symbols[i, : len(w)] = w
        left, counts = word_bpe.segment_trees_merge(symbols, np.array([len(w) for w in words]), pairs)
        ends = np.cumsum(counts)
        got = [left[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
        assert got == [word_bpe.segment_tree_merge(w, ranks) for w in words]


def test_groups_and_a_cache_that_rolls_over(reference, monkeypatch):
    """Small groups, a cache of five strings and narrow lanes give the same digests."""
    monkeypatch.setattr(word_bpe, "GROUP_CHARS", 40)
    monkeypatch.setattr(word_bpe, "LANE_LEAVES", 128)
    monkeypatch.setattr(word_bpe, "KNOWN", 5)
    bpe = word_bpe.WordBpe(PATH)
    texts = [t or "" for t in ODD] * 2 + [f"wort{i} the of {i}isch-{i % 3} " * 3 for i in range(50)]
    for text, got in zip(texts, bpe.digests(texts), strict=True):
        ids = reference.encode(text, add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        assert got == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.digests([]) == []
