"""Scores of blocks of vectors by matrix products, rounded as the column expressions in functions/vectors round them."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries, and single pairs, that are scored at once.
QUERIES, PAIRS = 128, 1 << 16
#: Components within these bounds neither overflow nor vanish when they are squared.
LEAST, MOST = 1e-100, 1e100
WIDE = Context(prec=400)


def rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """Halves go up, by the shortest decimal text of the number."""
    scaled = s * 10.0**digits
    whole = np.rint(scaled)
    out = whole / 10.0**digits + 0.0
    for i in np.flatnonzero(unsure(scaled, whole)):
        out[i] = float(Decimal(repr(float(s[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, WIDE)) + 0.0
    return out


def unsure(scaled: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Numbers so near a half, or so large, that another order of a sum might round them otherwise."""
    return (np.abs(np.abs(scaled - whole) - 0.5) < 1e-4) | ~(np.abs(scaled) < 1e9)


def plain(a: list | None, b: list | None, cosine: bool) -> float | None:
    """The score of any two vectors, in the order of the column expressions; null where one is null, has nulls or is the longer one."""
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    with np.errstate(all="ignore"):
        dot = lambda x, y: float(np.add.accumulate(np.array([0.0, *(np.array(x, np.float64) * np.array(y, np.float64))]))[-1])
        if not cosine:
            return dot(a, b)
        both = float(np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
        return float(np.float64(dot(a, b)) / both) if both > 0 or np.isnan(both) else None


class Vectors:
    """The vectors of a column: those of one length without nulls or extreme values as a matrix (rows tells which they are), and others."""

    def __init__(self, column: pa.ChunkedArray, width: int, cosine: bool) -> None:
        column = column.combine_chunks()
        size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(size == width)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False) if len(rows) else np.empty(0)
        matrix = flat.astype(np.float64).reshape(len(rows), width)
        good = (np.abs(matrix) < MOST).all(axis=1)
        self.norm = sums(matrix, matrix) ** 0.5
        if cosine:
            good &= self.norm > LEAST
        self.rows, self.matrix, self.norm = rows[good], matrix[good], self.norm[good]
        self.column, self.others = column, np.setdiff1d(np.arange(len(column)), self.rows)


def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from left to right."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
    return total


def width(*columns: pa.ChunkedArray) -> int:
    return max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns)


def exact(data: Vectors, asked: Vectors, d: np.ndarray, q: np.ndarray, cosine: bool, digits: int) -> np.ndarray:
    out = np.empty(len(d))
    for at in range(0, len(d), PAIRS):
        i, j = d[at : at + PAIRS], q[at : at + PAIRS]
        s = sums(data.matrix[i], asked.matrix[j])
        out[at : at + PAIRS] = rounded(s / (data.norm[i] * asked.norm[j]) if cosine else s, digits)
    return out


def odd_scores(data: Vectors, asked: Vectors, rows: np.ndarray, queries: np.ndarray, cosine: bool, digits: int) -> tuple:
    """Rows, queries, scores and kinds of all these pairs, one by one; kinds: 0 not a number (the highest), 1 a number, 2 null."""
    xs, ys = data.column.take(pa.array(rows, pa.int64())).to_pylist(), asked.column.take(pa.array(queries, pa.int64())).to_pylist()
    found = [plain(x, y, cosine) for x in xs for y in ys]
    kind = np.array([2 if s is None else 0 if s != s else 1 for s in found], np.int8)
    value = np.array([0.0 if s is None or s != s else s for s in found], np.float64)
    ends = np.isfinite(value)
    value[ends] = rounded(value[ends], digits)
    return np.repeat(rows, len(queries)), np.tile(queries, len(rows)), value, kind


def best(data: pa.Table, queries: pa.Table, k: int, cosine: bool, exclude_self: bool, digits: int = 6) -> pa.Table:
    """query_id, vec_id, score of the k best rows of data (vec_id, embedding) for each row of queries (query_id, q, own): the highest
    scores, of equal ones the smallest vec_id; a row whose vec_id is own takes no part if exclude_self.

    A matrix product tells which rows may be among the best; only those are scored in the exact order of sums and rounded.
    """
    data = data.take(pc.sort_indices(data["vec_id"], null_placement="at_start"))
    size = width(data["embedding"], queries["q"])
    d, q = Vectors(data["embedding"], size, cosine), Vectors(queries["q"], size, cosine)
    if exclude_self:
        known = data["vec_id"].combine_chunks()
        ids = known.unique()
        codes, mine = (pc.fill_null(pc.index_in(x, value_set=ids), -1).to_numpy(zero_copy_only=False) for x in (known, queries["own"].combine_chunks()))
        nobody = pc.is_null(known).to_numpy(zero_copy_only=False)
    found = []

    def keep(i, j, value, kind):
        """The k best of these for each query."""
        if exclude_self:
            others = (codes[i] != mine[j]) & ~nobody[i]
            i, j, value, kind = i[others], j[others], value[others], kind[others]
        order = np.lexsort((i, -value, kind, j))
        j = j[order]
        rank = np.arange(len(j)) - np.searchsorted(j, j, "left")
        order = order[rank < k]
        found.append((i[order], j[rank < k], value[order], kind[order]))

    scale = d.matrix if not cosine else d.matrix / d.norm[:, None]
    high = 1.0 if cosine else d.norm.max(initial=0.0)
    own = codes[d.rows] if exclude_self else None
    for at in range(0, len(q.rows) if len(d.rows) else 0, QUERIES):
        part = slice(at, at + QUERIES)
        asked = q.matrix[part] / q.norm[part, None] if cosine else q.matrix[part]
        s = asked @ scale.T
        if exclude_self:
            s[mine[q.rows[part]][:, None] == own[None, :]] = -np.inf
        slack = 1.1e-6 + 16 * size * np.finfo(float).eps * high * (1.0 if cosine else q.norm[part])
        last = np.partition(s, len(d.rows) - k, axis=1)[:, len(d.rows) - k] if len(d.rows) > k else np.full(len(s), -np.inf)
        j, i = np.nonzero((s >= (last - slack)[:, None]) & (s > -np.inf))
        value = exact(d, q, i, j + at, cosine, digits)
        keep(d.rows[i], q.rows[j + at], value, np.ones(len(i), np.int8))
    if len(d.others):
        for at in range(0, queries.num_rows, QUERIES):
            keep(*odd_scores(d, q, d.others, np.arange(at, min(at + QUERIES, queries.num_rows)), cosine, digits))
    for j in q.others:
        keep(*odd_scores(d, q, d.rows, np.array([j]), cosine, digits))
    if found:
        i, j, value, kind = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        keep(i, j, value, kind)
    i, j, value, kind = found[0] if found else (np.empty(0, np.int64),) * 2 + (np.empty(0), np.empty(0, np.int8))
    return pa.table({"query_id": queries["query_id"].take(pa.array(j, pa.int64())), "vec_id": data["vec_id"].take(pa.array(i, pa.int64())), "score": scores(value, kind)})


def scores(value: np.ndarray, kind: np.ndarray) -> pa.Array:
    return pa.array(np.where(kind == 0, np.nan, value), pa.float64(), mask=kind == 2)


def every(data: pa.Table, queries: pa.Table, digits: int = 6) -> pa.Table:
    """query_id, vec_id and the inner product of all pairs of rows of data (vec_id, embedding) and of queries (query_id, q)."""
    size = width(data["embedding"], queries["q"])
    d, q = Vectors(data["embedding"], size, False), Vectors(queries["q"], size, False)
    value, kind = np.zeros((queries.num_rows, data.num_rows)), np.ones((queries.num_rows, data.num_rows), np.int8)
    scaled = (q.matrix @ d.matrix.T) * 10.0**digits
    whole = np.rint(scaled)
    j, i = np.nonzero(unsure(scaled, whole))
    whole = whole / 10.0**digits + 0.0
    whole[j, i] = exact(d, q, i, j, False, digits)
    value[np.ix_(q.rows, d.rows)] = whole
    for rows, asked in ((d.others, np.arange(queries.num_rows)), (d.rows, q.others)):
        if len(rows) and len(asked):
            i, j, s, k = odd_scores(d, q, rows, asked, False, digits)
            value[j, i], kind[j, i] = s, k
    at = np.arange(data.num_rows * queries.num_rows)
    take = lambda column, i: column.combine_chunks().take(pa.array(i))
    return pa.table({"query_id": take(queries["query_id"], at // max(1, data.num_rows)), "vec_id": take(data["vec_id"], at % max(1, data.num_rows)), "score": scores(value.ravel(), kind.ravel())})
