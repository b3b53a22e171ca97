"""op1: held-out accuracy, calibration, odd rows."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from docflow.llm import classifier, queries


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) >= 0.95
    assert np.mean([p for p, q in held if q == 1]) >= 0.97


def test_odd_rows(spark):
    good, bad = "The small cat sat on a mat and ate the fish. " * 5, "BUY*** NOW!!! $$$ "
    docs = spark.createDataFrame([(i, good if i % 2 else bad * (1 + i)) for i in range(80)] + [(None, None), (200, ""), (200, ""), (201, "x" * 10**6)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (500, 1), (3, None)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    out = classifier.score(docs, model).collect()
    assert len(out) == 84 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 80)
    kept = classifier.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert classifier.score(docs.limit(0), model).count() == 0
    none = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}
    assert {r.score for r in classifier.score(docs, classifier.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}


def test_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < classifier.sigmoid(2 * x[:, 0])).astype(float)
    net = classifier.Network(np.zeros(3), np.ones(3), np.eye(3) * 0.01, np.zeros(3), np.array([800.0, 0, 0]), 0.0)
    classifier.calibrate(net, x, y)
    assert 3 < net.temperature < 5.5


def plain_tokens(text):
    """The tokens of a text, from the definition."""
    out, before, seen = [], None, set()
    for line in text.split("\n"):
        again = line in seen
        seen.add(line)
        for chunk in line.split():
            word, shape, end = classifier.describe(chunk)
            signs = [shape, end, classifier._SIGN["repeats"] if word >= 0 and word == before else -1, classifier._SIGN["repeated line"] if again else -1]
            out.append([t for t in (word, *signs) if t >= 0])
            before = word
    return out


def test_scores_against_plain_python(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    net, got = model.net, {r.doc_id: r.score for r in classifier.score(docs, model).collect()}
    for r in docs.collect():
        chunks = plain_tokens(r.text or "")
        pooled = sum((model.vectors[t].astype(float) for c in chunks for t in c), np.zeros(classifier.DIM)) / max(len(chunks), 1)
        hidden = [math.tanh(float(((pooled - net.mean) / net.scale) @ net.w1[:, j] + net.b1[j])) for j in range(classifier.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-40, min(40, logit))))) < 1e-4


def test_word_vectors_against_loops():
    rows = [np.array([[5, 9, -1, -1, -1], [7, 9, 3, -1, -1]], np.int16), np.array([[7, -1, -1, -1, -1]], np.int16)]
    got = classifier.word_vectors(rows, reach=2)
    index = classifier.index_vectors(classifier.ROWS + len(classifier.SIGNS), classifier.DIM, classifier.SEED)
    around = {t: np.zeros(classifier.DIM) for t in (3, 5, 7, 9)}
    for seq in ([5, 9, 7, 9, 3], [7]):
        for i, t in enumerate(seq):
            around[t] += sum((index[seq[j]] for j in range(max(0, i - 2), min(len(seq), i + 3)) if j != i), np.zeros(classifier.DIM))
    for t, v in around.items():
        whole = (v / np.linalg.norm(v) if v.any() else v) + index[t] / math.sqrt(8)
        assert np.allclose(got[t], whole / np.linalg.norm(whole), atol=1e-5)
    assert set(index.any(1)) == {True} and not any((index != 0).sum(1) - 8)


def test_signs_count_through_their_vectors():
    """The pooled vector is all that the network sees; its size does not depend on the number of signs."""
    model = classifier.Model(classifier.word_vectors([]), None, 0.5)
    pooled = [model.pool(classifier.Reader().read(t)) for t in ("a b c d", "a b c d!", "A b c d")]
    assert {x.shape for x in pooled} == {(classifier.DIM,)} and not np.allclose(pooled[0], pooled[1]) and not np.allclose(pooled[0], pooled[2])
