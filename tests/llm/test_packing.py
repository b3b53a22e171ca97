"""op8: ids against tokenizers, a valid packing, dominance against search."""

import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def valid(rows, texts, capacity):
    reference = Tokenizer.from_file(PATH)
    ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids[i])
        assert len(ids[i]) > capacity or len(parts) == 1
        assert all(r.length == capacity for r in parts[1:])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes())
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), -(-sum(r.length for r in rows) // capacity)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n, bound = valid(queries.op8_best_fit_packing(spark, sf).collect(), texts, 2048)
    assert n <= bound + 1


def test_odd_texts(spark):
    odd = [None, "", " ", "  a  b ", "a\n b", "a \nb", "a\n \nb", "x\n\n  y", "<|endoftext|> z<|endoftext|>", "it's  'S 12 345", "word " * 300, "日本 語　　x", "a   b", "tail \n", "\n lead", "\x1c \x1c x"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumn("length", F.lit("clash"))
    n, bound = valid(packing.pack(docs, PATH, 64).collect(), dict(enumerate(odd)), 64)
    assert n <= bound + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = packing.pack(docs.union(docs), PATH, 64).collect()
    assert len(twice) == 2 * packing.pieces(docs, PATH, 64).count()


def test_a_long_run_of_white_space_is_encoded():
    reference = Tokenizer.from_file(PATH)
    for text in (" " * 1_100_000 + "x", "a" + " \t" * 600_000, "<|endoftext|> y" + " " * 1_100_000 + "<|endoftext|>"):
        assert packing.load(PATH).encode(text) == np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_that_occur_once_cost_no_more_than_the_encoder_takes():
    rng, bpe = random.Random(3), packing.load(PATH)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(300)) for _ in range(1000)]

    def least(encode):
        spent = []
        for _ in range(3):
            begun = time.process_time()
            for t in texts:
                encode(t)
            spent.append(time.process_time() - begun)
        return min(spent)

    assert least(bpe.encode) < 1.6 * least(lambda t: bpe.encoding.encode_to_numpy(t, allowed_special="all"))


def fewest(items, capacity):
    """Exact number of bins by search over subsets."""
    n = len(items)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        for i in range(n):
            if mask >> i & 1:
                bins, room = best[mask ^ (1 << i)]
                got = (bins, room - items[i]) if room >= items[i] else (bins + 1, capacity - items[i])
                if (got[0], -got[1]) < (best[mask][0], -best[mask][1]):
                    best[mask] = got
    return best[-1][0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _, capacity in itertools.product(range(60), (20, 37)):
        items = [rng.randint(2, capacity) for _ in range(9)]
        counts = {s: items.count(s) for s in items}
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        left = [s for s, c in rest.items() for _ in range(c)]
        assert all(sum(b) <= capacity for _, b in fixed)
        assert sum(n for n, _ in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity)
        packed = packing.best_fit(counts, capacity)
        assert sorted(s for n, b in packed for s in b * n) == sorted(items) and all(sum(b) <= capacity for _, b in packed)
