"""BPE encoding and decoding with a segment tree over adjacent pair ranks, and token counts by distinct pre-token.

The vocabulary is a tokenizers JSON file with an end-of-word suffix (NFC, white space to one space, lower case; pre-tokens
never hold white space). Its path is a parameter. Every rule here follows the file; nothing is trained.

Defined results: a null text is an empty one and gives no tokens; repeated rows each give their own row; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.hashing import LONG_KEY, Cache
from docflow.session import materialize, ship

#: A block of op2 is closed at so many characters of text.
BLOCK_CHARS = 24_000_000

#: Pre-tokens of so many bytes at most are merged side by side, in arrays; longer ones one by one.
LANE_BYTES = 64

#: Leaves of all trees that are merged side by side.
LANE_LEAVES = 1 << 16

#: Texts are encoded together up to so many characters; a longer text is a group of its own.
GROUP_CHARS = 2_000_000

#: So many strings make a generation of known ones full.
KNOWN = 150_000

_loaded: dict[str, WordBpe] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def segment_tree_merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge adjacent pairs, always the leftmost of the lowest rank, until none can be merged.

    The leaves of the tree are the pairs, each with rank * n + position; the root is the least of them. A merge changes three
    leaves, each in logarithmic time.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    none = 1 << 62
    width = 1
    while width < n:
        width *= 2
    tree = [none] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        found = get((symbols[i], symbols[i + 1]))
        if found:
            tree[width + i] = found[0] * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(at: int, value: int) -> None:
        i = width + at
        if tree[i] == value:
            return
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != none:
        at = tree[1] % n
        right = after[at]
        symbols[at] = get((symbols[at], symbols[right]))[1]
        symbols[right] = -1
        beyond = after[right]
        after[at] = beyond
        if beyond < n:
            before[beyond] = at
        put(right, none)
        found = get((symbols[at], symbols[beyond])) if beyond < n else None
        put(at, found[0] * n + at if found else none)
        left = before[at]
        if left >= 0:
            found = get((symbols[left], symbols[at]))
            put(left, found[0] * n + left if found else none)
    return [s for s in symbols if s >= 0]


class PairTable:
    """Rank of a pair of symbols as an open hash table in arrays, for many pairs at once."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], n_symbols: int):
        self.base = n_symbols + 1  # n_symbols itself stands for no symbol
        bits = max(4, (5 * len(ranks)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.array([a * self.base + b for a, b in ranks], np.int64)
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.zeros(self.mask + 1, np.int64)
        self.merged = np.zeros(len(ranks), np.int64)
        for at, key, (rank, merged) in zip(self._slots(keys).tolist(), keys.tolist(), ranks.values(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.merged[rank] = key, rank, merged

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        keys = a * self.base + b
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def segment_trees_merge(symbols: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """segment_tree_merge of many short words at once: a tree for each row, all of one width, a power of two.

    symbols has a row for each word, filled up with the number for no symbol; sizes are the lengths of the words. Each round takes
    the root of every tree that still has a mergeable pair, changes its three leaves and then their ancestors, level by level.
    Returns the symbols that are left, row after row, and how many each row has.
    """
    n, width = symbols.shape
    none, no_symbol, step = np.int64(1 << 62), pairs.base - 1, width + 2  # behind a row: the end, and what is before the start
    cells = np.full((n, step), no_symbol, np.int64)
    cells[:, :width] = symbols
    after = np.tile(np.arange(1, step + 1), n)
    before = np.tile(np.arange(-1, step - 1), n)
    before[::step] = width + 1
    ranks = pairs.find(cells[:, :width].ravel(), cells[:, 1 : width + 1].ravel()).reshape(n, width)
    tree = np.empty((n, 2 * width), np.int64)
    tree[:, width:] = np.where(ranks >= 0, ranks * width + np.arange(width), none)
    level = width
    while level > 1:
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
        level //= 2
    cells, tree, rows = cells.ravel(), tree.ravel(), np.arange(n)
    while True:
        roots = tree[rows * (2 * width) + 1]
        live = roots != none
        rows, roots = rows[live], roots[live]
        if not len(rows):
            break
        start, trunk, at = rows * step, rows * (2 * width), roots % width
        here = start + at
        right = after[here]
        beyond = after[start + right]
        left = before[here]
        merged = pairs.merged[roots // width]
        cells[here], cells[start + right] = merged, -1
        after[here] = beyond
        before[start + beyond] = at
        found = pairs.find(np.concatenate([merged, cells[start + left]]), np.concatenate([cells[start + beyond], merged]))
        left = np.where(left < width, left, at)  # nothing before the first: its leaf stays as it is
        places = np.concatenate([left, at])
        leaf = np.where(found >= 0, found * width + np.concatenate([at, left]), none)
        # The leaf of the pair that begins here goes last, as it stands in for a missing left one.
        nodes = np.concatenate([trunk + width + left, trunk + width + at, trunk + width + right])
        tree[nodes[: len(rows)]] = leaf[len(rows) :]
        tree[nodes[len(rows) : 2 * len(rows)]] = leaf[: len(rows)]
        tree[nodes[2 * len(rows) :]] = none
        base = np.concatenate([trunk] * 3)
        inner = np.concatenate([places, right]) + width
        while inner[0] > 1:
            inner >>= 1
            child = base + 2 * inner
            tree[base + inner] = np.minimum(tree[child], tree[child + 1])
    kept = cells.reshape(n, step)[:, :width]
    kept_here = (kept >= 0) & (np.arange(width) < sizes[:, None])
    return kept[kept_here], kept_here.sum(1)


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.pairs = PairTable(self.ranks, max(self.token) + 1)
        self.id_text = {i: str(i) for i in self.token}
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        self.inner_of, self.final_of = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self.pieces = Cache(self._pieces)
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def encode_pretoken(self, pretoken: str) -> list[int]:
        raw = pretoken.encode()
        return segment_tree_merge([self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]], self.ranks)

    def _pieces(self, chunk: str) -> tuple[str, ...]:
        return tuple(self.pattern.findall(chunk))

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """Token ids of each of many pre-tokens: those of like length side by side, very long ones one by one."""
        raws = [p.encode() for p in pretokens]
        out: list[list[int]] = [[]] * len(raws)
        lanes: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            if len(raw) > LANE_BYTES:
                out[i] = self.encode_pretoken(pretokens[i])
            else:
                lanes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(i)
        for width, all_of_width in lanes.items():
            for some in range(0, len(all_of_width), LANE_LEAVES // width):
                which = all_of_width[some : some + LANE_LEAVES // width]
                sizes = np.array([len(raws[i]) for i in which], np.int64)
                codes = np.frombuffer(b"".join([raws[i] for i in which]), np.uint8)
                symbols = np.full((len(which), width), self.pairs.base - 1, np.int64)
                symbols[np.arange(width) < sizes[:, None]] = self.inner_of[codes]
                symbols[np.arange(len(which)), sizes - 1] = self.final_of[codes[np.cumsum(sizes) - 1]]
                ids, counts = segment_trees_merge(symbols, sizes, self.pairs)
                ids, at = ids.tolist(), 0
                for i, n in zip(which, counts.tolist(), strict=True):
                    out[i] = ids[at : at + n]
                    at += n
        return out

    def render(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by spaces, tokens joined by spaces of each string between white space."""
        split = [self.pattern.findall(c) for c in chunks]
        pretokens = list({p: None for found in split for p in found})
        id_text, token = self.id_text, self.token
        shown = {
            p: (len(ids), " ".join([id_text[i] for i in ids]), " ".join([token[i] for i in ids]))
            for p, ids in zip(pretokens, self.encode_pretokens(pretokens), strict=True)
        }
        out = []
        for found in split:
            if len(found) == 1:
                out.append(shown[found[0]])
            else:
                parts = [shown[p] for p in found]
                out.append((sum([x[0] for x in parts]), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts])))
        return out

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(is special, string) in order; special strings are found in the raw text, before normalisation."""
        if "<|" not in text:
            return [(False, text)]
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [(False, text[at : m.start()]), (True, m[0])]
            at = m.end()
        return [*out, (False, text[at:])]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Normalised strings between white space: pre-tokens never reach across it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split(), not for the file's pattern
            return [x for x in regex.split(r"[\s--[\x1c-\x1f]]+", text, flags=regex.V1) if x]
        return text.split()

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text."""
        out: list[int] = []
        for special, part in self.segments(text or ""):
            if special:
                out.append(self.specials[part])
            else:
                for chunk in self.chunks(part):
                    out += [i for p in self.pieces[chunk] for i in self.encode_pretoken(p)]
        return out

    def decode(self, ids) -> str:
        """The tokens joined by one space, as the file names no decoder."""
        return " ".join([self.token[i] for i in ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of tokens, SHA-256 of the ids joined by spaces, SHA-256 of the decoded text."""
        out, group, chars = [], [], 0
        for text in texts:
            group.append([(special, part if special else self.chunks(part)) for special, part in self.segments(text)])
            chars += len(text)
            if chars >= GROUP_CHARS:
                out += self._digest_group(group)
                group, chars = [], 0
        return out + self._digest_group(group)

    def _digest_group(self, group: list[list[tuple[bool, str | list[str]]]]) -> list[tuple[int, str, str]]:
        """Strings that are not known from earlier groups are encoded together, once each."""
        words = set().union(*[x for parts in group for special, x in parts if not special])
        shown = {c: v for c in words if (v := self.young.get(c) or self.old.get(c))}
        new = [c for c in words if c not in shown]
        shown.update(zip(new, self.render(new), strict=True))
        self.remember(shown)
        out = []
        for parts in group:
            n, ids, tokens = 0, [], []
            for special, part in parts:
                if special:
                    n, ids, tokens = n + 1, [*ids, str(self.specials[part])], [*tokens, part]
                elif part:
                    counts, some_ids, some_tokens = zip(*map(shown.__getitem__, part), strict=True)
                    n += sum(counts)
                    ids += filter(None, some_ids)
                    tokens += filter(None, some_tokens)
            out.append((n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(tokens).encode()).hexdigest()))
        return out

    def remember(self, shown: dict[str, tuple[int, str, str]]) -> None:
        """Two generations of short strings: the elder goes when the younger is full."""
        self.young.update({c: v for c, v in shown.items() if len(c) <= LONG_KEY})
        if len(self.young) > KNOWN:
            self.old, self.young = self.young, {}


def load(path: str) -> WordBpe:
    """One tokenizer for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for every row: the operator's real outputs."""
    ship(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode each whole text, keep the digests. No shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                n, ids, decoded = zip(*bpe.digests([t or "" for t in part.column(1).to_pylist()]), strict=True)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


# Token counts


def squeeze(parts: list[np.ndarray]) -> bytes:
    """Small unsigned 32-bit numbers, the first bytes of all before the second ones, compressed."""
    whole = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype("<u4")
    return pa.compress(whole.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unsqueeze(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class _Block:
    """Pre-token frequencies of consecutive documents, as one sparse matrix over the block's own dictionary."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.index, self.ids, self.bytes, self.special = bpe, {}, [], [], []
        self.columns, self.values, self.ends, self.chars = [], [], [0], 0
        self.columns_of = Cache(self._columns)

    def _columns(self, chunk: str) -> tuple[int, ...]:
        index = self.index
        return tuple([index.setdefault(p, len(index)) for p in self.bpe.pattern.findall(chunk)])

    def add(self, doc_id, text: str | None) -> None:
        text = text or ""
        special, counts = 0, {}
        for is_special, part in self.bpe.segments(text):
            if is_special:
                special += 1
                continue
            words: dict[str, int] = {}
            for c in self.bpe.chunks(part):
                words[c] = words.get(c, 0) + 1
            columns_of = self.columns_of
            for c, k in words.items():
                for j in columns_of[c]:
                    counts[j] = counts.get(j, 0) + k
        self.ids.append(doc_id)
        self.bytes.append(len(text.encode()))
        self.special.append(special)
        columns, values = np.fromiter(counts.keys(), np.uint32, len(counts)), np.fromiter(counts.values(), np.uint32, len(counts))
        order = np.argsort(columns)
        self.columns.append(np.diff(columns[order], prepend=np.uint32(0)))
        self.values.append(values[order])
        self.ends.append(self.ends[-1] + len(counts))
        self.chars += len(text)

    def rows(self, key: int) -> pa.RecordBatch:
        """The dictionary's rows (column, pretoken) and one row with the matrix."""
        names = list(self.index)
        n = len(names)
        matrix = [np.array(self.ends, np.int64).tobytes(), squeeze(self.columns), squeeze(self.values)]
        return pa.record_batch(
            [
                pa.array([key] * (n + 1), pa.int64()), pa.array([*range(n), None], pa.int32()), pa.array([*names, None], pa.string()),
                pa.array([None] * n + [self.ids], pa.list_(pa.int64())), pa.array([None] * n + [self.bytes], pa.list_(pa.int64())), pa.array([None] * n + [self.special], pa.list_(pa.int64())),
                *(pa.array([None] * n + [x], pa.binary()) for x in matrix),
            ],
            ["block", "col", "pretoken", "ids", "bytes", "special", "ends", "cols", "freqs"],
        )


BLOCK_SCHEMA = "block long, col int, pretoken string, ids array<long>, bytes array<long>, special array<long>, ends binary, cols binary, freqs binary"


def pretoken_blocks(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per-document pre-token frequencies of every text, in blocks with a dictionary each; a block ends at block_chars."""

    def run(batches):
        from pyspark import TaskContext

        bpe, at = load(path), TaskContext.get().partitionId() << 24
        block = _Block(bpe)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    block.add(doc_id, text)
                    if block.chars >= block_chars:
                        yield block.rows(at)
                        block, at = _Block(bpe), at + 1
        if block.ids:
            yield block.rows(at)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA)


def join_pieces(names: DataFrame, path: str) -> DataFrame:
    """of_block, col, n_pieces for each row (block, col, pretoken) of names.

    Rows of one pre-token come together in one sorted partition, where its pieces are counted once and joined to all of them:
    a merge join whose other side is made on the way, so that the dictionaries are shuffled only once.
    """

    def run(batches):
        bpe, last, n = load(path), None, 0
        for b in batches:
            names = b.column(2).to_pylist()
            distinct = [p for p in dict.fromkeys(names) if p != last]
            sizes = dict(zip(distinct, map(len, bpe.encode_pretokens(distinct)), strict=True))
            sizes.setdefault(last, n)
            counts = [sizes[p] for p in names]
            last, n = (names[-1], counts[-1]) if names else (last, n)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(counts, pa.int32())], ["of_block", "col", "n_pieces"])

    return names.repartition("pretoken").sortWithinPartitions("pretoken").mapInArrow(run, "of_block long, col int, n_pieces int")


def token_counts(docs: DataFrame, path: str, limit: int = 2048, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: pieces are counted once for each distinct pre-token of the corpus, joined to the
    pre-token frequencies, and summed by document; no ids are made.

    A pre-token occurs at most once in each block's dictionary, so no key of the join is hot. What is shuffled is the
    dictionaries and, by block, one matrix each; both are bounded by block_chars (or by one text, if that is longer).
    """
    ship(docs.sparkSession)
    blocks = materialize(pretoken_blocks(docs, path, block_chars), "pretoken-blocks")
    names = blocks.where("pretoken is not null").select("block", "col", "pretoken")
    pieces = join_pieces(names, path)
    matrices = blocks.where("pretoken is null").select("block", "ids", "bytes", "special", "ends", "cols", "freqs")

    def total(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = {n: left.column(n)[0].as_py() for n in left.column_names}
        ends = np.frombuffer(row["ends"], np.int64)
        steps, freqs = unsqueeze(row["cols"], ends[-1]), unsqueeze(row["freqs"], ends[-1])
        upto = np.concatenate([[0], np.cumsum(steps)])
        cols = upto[1:] - np.repeat(upto[ends[:-1]], np.diff(ends))
        pieces = np.zeros(right.num_rows, np.int64)
        pieces[right.column("col").to_numpy()] = right.column("n_pieces").to_numpy()
        sums = np.concatenate([[0], np.cumsum(pieces[cols] * freqs)])
        n = sums[ends[1:]] - sums[ends[:-1]] + np.array(row["special"], np.int64)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(row["bytes"], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    return matrices.groupBy("block").cogroup(pieces.groupBy("of_block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
