"""Quality classifier: random-indexing vectors of words and signs pooled for each document, a two-layer numpy network on the pooled
vector alone, and probabilities calibrated by a temperature.

A text is read as a sequence of tokens: each word, followed by signs of what the word alone does not show: its shape (case, digits),
the kind of sign at its end, that it repeats the word before, that its line occurred before. Words are hashed into a fixed number of
rows; signs have rows of their own. All get an index vector and the vector of their contexts alike.

The model is fitted on the driver from the tokens of a bounded number of labelled rows (`sample_rows`), each read whole on the
executors; scoring reads every whole text where it lies, without a shuffle. Labels, doc_id, lang and source are never inputs of a
score: doc_id only selects the rows that may be learnt from.

Defined results: a null text is an empty one; an empty text has the pooled vector 0 and the score that the network gives it;
repeated rows are scored each; a label row without a document, with a null label or a null doc_id is not learnt from; without
labels of both kinds the score is the share of label 1 (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.hashing import Cache, releasing
from docflow.session import ship

ROWS = 1 << 14
DIM = 96
HIDDEN = 32
SEED = 11
#: Labelled documents that the model is fitted on, at most.
SAMPLE_ROWS = 4000
THRESHOLD = 0.3
#: Remainder of the rows that are never learnt from, and of those that only calibrate.
HELD_OUT, CALIBRATE = 0, 1

SIGNS = ["lower", "Title", "UPPER", "MiXed", "digits", "mixed digits", "signs only", "repeats", "repeated line", "end .", "end ,", "end !?", "end symbol", "end other"]
_SIGN = {m: ROWS + i for i, m in enumerate(SIGNS)}
_END = {".": "end .", ",": "end ,", "!": "end !?", "?": "end !?"} | dict.fromkeys("#*$%&|<>~^=_+@\\/", "end symbol")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def describe(chunk: str) -> tuple[int, int, int]:
    """Tokens of a string between white space: the word, its shape, its end (-1: none)."""
    core = chunk.rstrip("".join(_END) + ";:)]}'\"-…»”").lstrip("([{'\"«“")
    end = -1 if chunk[-1] == core[-1:] else _SIGN[_END.get(chunk[-1], "end other")]
    if not core:
        return -1, _SIGN["signs only"], end
    if core.isdigit():
        shape = "digits"
    elif any(c.isdigit() for c in core):
        shape = "mixed digits"
    elif core.islower():
        shape = "lower"
    elif core.isupper() and len(core) > 1:
        shape = "UPPER"
    elif core[0].isupper() and (len(core) == 1 or core[1:].islower()):
        shape = "Title"
    else:
        shape = "MiXed"
    return zlib.crc32(core.lower().encode()) % ROWS, _SIGN[shape], end


class Reader:
    """Turns texts into tokens."""

    def __init__(self):
        self.of = Cache(describe, 50_000)

    def read(self, text: str) -> np.ndarray:
        """A row for each string between white space: the tokens of word, shape, end, repeated word, repeated line (-1: none)."""
        chunks = text.split()
        out = np.full((len(chunks), 5), -1, np.int16)
        if not chunks:
            return out
        out[:, :3] = list(map(self.of.__getitem__, chunks))
        words = out[:, 0]
        out[1:, 3][(words[1:] == words[:-1]) & (words[1:] >= 0)] = _SIGN["repeats"]
        lines = text.split("\n")
        if len(lines) > len(set(lines)):
            seen: set[str] = set()
            again = []
            for line in lines:
                again.append(line in seen)
                seen.add(line)
            out[np.repeat(again, [len(line.split()) for line in lines]), 4] = _SIGN["repeated line"]
        return out


def index_vectors(n: int, dim: int, seed: int) -> np.ndarray:
    """Sparse random vectors: eight entries of +1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.float32)
    places = rng.random((n, dim)).argsort(1)[:, :8]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (n, 8)), 1)
    return out


def word_vectors(sequences: list[np.ndarray], dim: int = DIM, reach: int = 2, seed: int = SEED) -> np.ndarray:
    """Random indexing: a token's vector is the sum of the index vectors of its neighbours, and of its own, at unit length."""
    index = index_vectors(ROWS + len(SIGNS), dim, seed)
    total = np.zeros_like(index)
    for rows in sequences:
        rows = rows[rows >= 0].reshape(-1)
        if not len(rows):
            continue
        around = np.zeros((len(rows), dim), np.float32)
        own = index[rows]
        for k in range(1, reach + 1):
            around[k:] += own[:-k]
            around[:-k] += own[k:]
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        total[rows[order][starts]] += np.add.reduceat(around[order], starts)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    total = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0) + index / np.sqrt(8)
    return total / np.linalg.norm(total, axis=1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """One hidden layer of tanh units and a logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3, seed: int = SEED) -> Network:
    """Adam on the log loss, with both labels given equal weight."""
    rng = np.random.default_rng(seed)
    scale = x.std(0) + 0.02
    net = Network(x.mean(0), scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z, weight = (x - net.mean) / scale, np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step, batch = 0, 128
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), batch):
            at = order[i : i + batch]
            h = np.tanh(z[at] @ net.w1 + net.b1)
            d = (sigmoid(h @ net.w2 + net.b2) - y[at]) * weight[at] / len(at)
            dh = np.outer(d, net.w2) * (1 - h * h)
            slopes = (z[at].T @ dh + decay * net.w1, dh.sum(0), h.T @ d + decay * net.w2, np.array([d.sum()]))
            step += 1
            moves = []
            for g, s in zip(slopes, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                moves.append(rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature, and the shift that undoes the equal weights, with the least log loss on rows that were not trained on."""
    if len(y) < 20 or y.min() == y.max():
        return
    raw, best = net.logits(x), (np.inf, 1.0, 0.0)
    for t in np.geomspace(0.5, 8, 25):
        for shift in np.linspace(-3, 3, 25):
            p = np.clip(sigmoid((raw + shift) / t), 1e-6, 1 - 1e-6)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            best = min(best, (loss, t, shift))
    net.temperature = best[1]
    net.b2 += best[2]


class Model:
    def __init__(self, vectors: np.ndarray | None, net: Network | None, share: float):
        self.vectors, self.net, self.share = vectors, net, share

    @classmethod
    def fit(cls, tokens: list[np.ndarray], labels: np.ndarray, calibration: np.ndarray) -> Model:
        if not len(labels) or labels.min() == labels.max():
            return cls(None, None, float(labels.mean()) if len(labels) else 0.5)
        fitted = np.flatnonzero(~calibration)
        if not len(fitted) or labels[fitted].min() == labels[fitted].max():
            fitted = np.arange(len(labels))
        model = cls(word_vectors([tokens[i] for i in fitted]), None, float(labels.mean()))
        x = np.array([model.pool(t) for t in tokens])
        model.net = train(x[fitted], labels[fitted])
        calibrate(model.net, x[calibration], labels[calibration])
        return model

    def pool(self, tokens: np.ndarray) -> np.ndarray:
        """The sum of the vectors of a document's tokens by the number of its strings between white space."""
        words, signs = tokens[:, 0], tokens[:, 1:]
        counts = np.bincount(signs[signs >= 0] - ROWS, minlength=len(SIGNS))
        total = self.vectors[words[words >= 0]].sum(0, dtype=np.float64) + counts @ self.vectors[ROWS:]
        return total / max(len(tokens), 1)

    def scores(self, texts: list[str], reader: Reader) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        return self.net.probabilities(np.array([self.pool(reader.read(t)) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of at most sample_rows labelled documents outside the held-out fold, taken in the order of a hash of their id.

    The texts are read where they lie; the driver gets their tokens.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    once = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("sample_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", fold(F.col("doc_id")).alias("fold"), "sample_text")

    def run(batches):
        reader = Reader()
        for b in batches:
            tokens = [pa.compress(reader.read(t).tobytes(), "zstd", asbytes=True) for t in b.column(3).to_pylist()]
            size = [10 * len(t.split()) for t in b.column(3).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(size, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "label", "fold", "size", "tokens"])

    read = found.mapInArrow(releasing(run), "doc_id long, label int, fold long, size long, tokens binary")
    rows = sorted(read.orderBy(F.xxhash64("doc_id"), "doc_id", "tokens").limit(sample_rows).collect())
    tokens = [np.frombuffer(pa.decompress(bytes(r.tokens), r.size, "zstd", asbytes=True), np.int16).reshape(-1, 5) for r in rows]
    return Model.fit(tokens, np.array([r.label for r in rows], np.float64), np.array([r.fold == CALIBRATE for r in rows], bool))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""
    ship(docs.sparkSession)

    def run(batches):
        reader = Reader()
        for b in batches:
            scores = [model.scores([t or "" for t in b.slice(i, 256).column(2).to_pylist()], reader) for i in range(0, b.num_rows, 256)]
            p = np.concatenate([np.zeros(0), *scores])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "text").mapInArrow(releasing(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        reader = Reader()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array(model.scores([t or "" for t in part.column(at).to_pylist()], reader) >= threshold))

    return docs.mapInArrow(releasing(run), docs.schema)
