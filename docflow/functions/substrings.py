"""The first of many strings that a text contains, by rolling hashes over all positions of many texts at once, in numpy."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the shortest prefix that is looked for, and how many prefixes there are, each twice as long as the one before.
SHORTEST, LEVELS = 10, 5
#: Bytes of texts that are hashed at once (or one text), places that are compared at once, and bits of the filter.
BLOCK, PLACES, FILTER_BITS = 1 << 19, 1 << 20, 22
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64; as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            each = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
            self.up, self.down = each(BASE), each(pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings without nulls, and where each string begins; the last place is the end."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = POWERS(len(data) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]), down


def blocks(at: np.ndarray) -> list[tuple[int, int]]:
    """Runs of strings of BLOCK bytes, or of one string."""
    cuts, n = [0], len(at) - 1
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + BLOCK, "right")) - 1))
    return list(pairwise(cuts))


def expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n[i] copies of each i: i, and the number of the copy."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


class Substrings:
    """Strings of SHORTEST bytes or more, in the order in which they are preferred.

    A string is found by the hash of its longest prefix of SHORTEST * 2 ** i bytes, then, for each length that strings with this prefix
    have, by the hash of the whole; what is found is compared itself, so that a hash never decides.
    """

    def __init__(self, strings: pa.Array) -> None:
        self.data, self.at = raw(strings)
        self.chars = pc.utf8_length(strings).to_numpy(zero_copy_only=False)
        size = np.diff(self.at)
        level = np.clip(np.frexp(size / SHORTEST)[1] - 1, 0, LEVELS - 1)
        prefix, full = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
        for a, b in blocks(self.at):
            total, down = sums(self.data[self.at[a] : self.at[b]])
            begin = self.at[a:b] - self.at[a]
            prefix[a:b] = (total[begin + (SHORTEST << level[a:b])] - total[begin]) * down[begin]
            full[a:b] = (total[begin + size[a:b]] - total[begin]) * down[begin]
        self.order = np.argsort(full, kind="stable")  # of equal hashes the preferred one first
        self.full = full[self.order]
        self.levels = []
        for i in range(LEVELS):
            own = np.flatnonzero(level == i)
            if len(own):
                kinds = np.unique(np.rec.fromarrays([prefix[own], size[own]], names="prefix,size"))
                keys, first = np.unique(kinds["prefix"], return_index=True)
                bits = np.zeros(1 << FILTER_BITS, bool)
                bits[self.bucket(keys)] = True
                self.levels.append((SHORTEST << i, bits, keys, np.append(first, len(kinds)), kinds["size"]))

    @staticmethod
    def bucket(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * MIX) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def first(self, texts: pa.Array, most: np.ndarray) -> np.ndarray:
        """For each text (none is null) the place of the first string that it contains and that has most[i] characters at most, else -1."""
        data, at = raw(texts)
        out = np.full(len(texts), -1, np.int64)
        for a, b in blocks(at):
            out[a:b] = self._first(data[at[a] : at[b]], at[a : b + 1] - at[a], most[a:b])
        return out

    def _first(self, data: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        total, down = sums(data)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        found = []
        for width, bits, keys, first, sizes in self.levels:
            if len(data) < width:
                continue
            hashes = (total[width:] - total[:-width]) * down[: len(data) - width + 1]
            place = np.flatnonzero(bits[self.bucket(hashes)])
            key = np.searchsorted(keys, hashes[place])
            hit = keys[np.minimum(key, len(keys) - 1)] == hashes[place]
            place, key = place[hit], key[hit]
            n = first[key + 1] - first[key]
            done = np.cumsum(n)
            cuts = [0]
            while cuts[-1] < len(n):
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(done, (done[cuts[-1] - 1] if cuts[-1] else 0) + PLACES, "right"))))
            for x, y in pairwise(cuts):
                found.append(self._whole(total, down, at, owner, most, place[x:y], *self._sizes(n[x:y], first[key[x:y]], sizes)))
        out = np.full(len(at) - 1, -1, np.int64)
        if found:
            who, which, where = map(np.concatenate, zip(*found, strict=True))
            for k in np.lexsort((which, who)):
                i, s = who[k], which[k]
                if out[i] < 0 and np.array_equal(data[where[k] : where[k] + self.at[s + 1] - self.at[s]], self.data[self.at[s] : self.at[s + 1]]):
                    out[i] = s
        return out

    @staticmethod
    def _sizes(n: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, copy = expand(n)
        return i, sizes[first[i] + copy]

    def _whole(self, total, down, at, owner, most, place, i, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, string and place where the hash of the whole string is found; of one text and string only the first place."""
        where = place[i]
        inside = where + size <= at[owner[where] + 1]
        where, size = where[inside], size[inside]
        hashes = (total[where + size] - total[where]) * down[where]
        low, high = (np.searchsorted(self.full, hashes, side) for side in ("left", "right"))
        i, copy = expand(high - low)
        where, which = where[i], self.order[low[i] + copy]
        right = (self.at[which + 1] - self.at[which] == size[i]) & (self.chars[which] <= most[owner[where]])
        where, which = where[right], which[right]
        who = owner[where]
        _, once = np.unique(np.stack([who, which]), axis=1, return_index=True) if len(who) else (None, slice(0))
        return who[once], which[once], where[once]
