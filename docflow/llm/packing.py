"""Packing documents into sequences of fixed length: dominance reduction after Martello and Toth, then best fit.

Packing depends only on how many pieces there are of each length, and there are at most `capacity` lengths. So the plan is made
on the driver from that histogram, whatever the number of documents, and has one entry for each group of equal bins and length.

Defined results: a null text is an empty one and becomes the end token alone; repeated rows are packed each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.hashing import releasing
from docflow.llm.word_bpe import byte_symbols
from docflow.session import materialize, ship

CAPACITY = 2048
END_ID = 0
#: Rows of one length that are numbered by one task, about.
RANK_ROWS = 500_000

_loaded: dict[str, ByteBpe] = {}


class ByteBpe:
    """Ids of the byte-level BPE of a tokenizers JSON file as little-endian unsigned 32-bit integers.

    Whole texts go to tiktoken. A cache of parts costs more than it saves: many words of a corpus occur once. The pattern's search
    gives up on a run of about a million white-space characters; such a text goes to the tokenizers library, which is slower.
    """

    #: Fixed value: the pre-token pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.path = path
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.encoding = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer  # hardly any task needs it

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def encode(self, text: str) -> bytes:
        try:
            ids = self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the search gave up
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids)
        return ids.astype("<u4", copy=False).tobytes()


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut only where longer than capacity; then every
    piece but the first is full."""
    ship(docs.sparkSession)

    def run(batches):
        bpe, end = load(path), np.array([end_id], "<u4").tobytes()
        for b in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text or "") + end
                n = len(ids) // 4
                at, upto, k = 0, n % capacity or capacity, 0
                while at < n:
                    rows.append((doc_id, k, at, upto - at, zlib.crc32(ids[4 * at : 4 * upto])))
                    at, upto, k = upto, upto + capacity, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), PIECE_SCHEMA)


class _Stock:
    """Counts by length, and the lengths that are left in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def put(self, size: int, n: int) -> None:
        if size not in self.counts:
            self.sizes.insert(bisect_left(self.sizes, size), size)
            self.counts[size] = 0
        self.counts[size] += n

    def largest(self, limit: int) -> int:
        """The largest length up to limit; 0 if none."""
        i = bisect_right(self.sizes, limit)
        return self.sizes[i - 1] if i else 0

    def least(self, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes[:n]:
            out += [s] * min(self.counts[s], n - len(out))
            if len(out) == n:
                break
        return out


def dominating_set(stock: _Stock, size: int, capacity: int) -> list[int] | None:
    """Companions of an item of this length such that the bin dominates every other bin with that item; None if none is proven.

    stock holds the other items. One bin dominates another if the other's items can be shared out among its items so that each
    share is no larger than the item that takes it: then swapping shares for items turns any packing into one with this bin.
    """
    room = capacity - size
    one = stock.largest(room)
    if not one:
        return []
    least = stock.least(3)
    if one == room or len(least) < 2 or least[0] + least[1] > room:
        return [one]  # it fills the bin, or nothing more than one item fits
    if len(least) == 3 and sum(least) <= room:
        return None  # three more may fit
    sums, small = 0, 0  # over all pairs that fit: the greatest sum, and the greatest smaller item
    for s in stock.sizes:
        if 2 * s > room and s > least[0]:
            break
        partner = stock.largest(room - s)
        if partner > s or partner == s and stock.counts[s] > 1:
            sums, small = max(sums, s + partner), max(small, s)
    if one >= sums:
        return [one]
    stock.take(one, 1)
    two = stock.largest(room - one)
    stock.put(one, 1)
    return [one, two] if two and small <= two else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Bins fixed for good as (number, lengths), and the counts that remain."""
    stock, fixed, changed = _Stock(counts), [], True
    while changed:
        changed = False
        for size in reversed(list(stock.sizes)):
            while stock.counts.get(size):
                stock.take(size, 1)
                more = dominating_set(stock, size, capacity)
                stock.put(size, 1)
                if more is None:
                    break
                bin_, used = [size, *more], {}
                for s in bin_:
                    used[s] = used.get(s, 0) + 1
                n = min(stock.counts[s] // k for s, k in used.items())
                for s, k in used.items():
                    stock.take(s, n * k)
                fixed.append((n, bin_))
                changed = True
    return fixed, stock.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, the longest first, on groups of equal bins: (number, lengths)."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def leave(room: int, n: int, bin_: list[int]) -> None:
        if room not in open_:
            rooms.insert(bisect_left(rooms, room), room)
            open_[room] = []
        open_[room].append((n, bin_))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = min(capacity // size, left)
                n = left // each
                leave(capacity - each * size, n, [size] * each)
                left -= n * each
                continue
            room = rooms[i]
            n, bin_ = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            each = min(room // size, left)  # the room that is left after one is again the best fit
            some = min(n, left // each)
            leave(room - each * size, some, bin_ + [size] * each)
            if n > some:
                leave(room, n - some, bin_)
            left -= some * each
    return [x for group in open_.values() for x in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks at which a group of bins begins, its first sequence, the offset in it."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    entries: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, bin_ in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for size in bin_:
            entries.setdefault(size, []).append((used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        sequence += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*e, strict=True)) for s, e in entries.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, path, capacity, end_id), "pieces")
    total = cut.count()
    parts = max(16, -(-total // RANK_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    shifts = groups.withColumn("shift", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = plan(counts, capacity)
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("inside", inside).join(shifts, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inside") + F.col("shift")).alias("rank"))

    def assign(batches):
        for b in batches:
            lengths, ranks = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequences, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for s in np.unique(lengths):
                of = np.flatnonzero(lengths == s)
                begins, first, offset = where[int(s)]
                k = np.searchsorted(begins, ranks[of], "right") - 1
                sequences[of], offsets[of] = first[k] + ranks[of] - begins[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequences), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(releasing(assign), PIECE_SCHEMA + ", sequence_id long, offset long")
