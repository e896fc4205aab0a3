"""Splitting many texts at once into the pre-tokens of byte-level vocabularies, and remembering their ids.

``split`` gives what ``PATTERN`` matches, by character classes in numpy arrays; ``PieceIds`` maps each match to
its ids through a table sorted by 64-bit hashes, and asks a resolver once for each piece it lacks. At a billion different
pieces the chance that any two share a hash is about 3 %.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np

from .common import _powers, mix64

#: Fixed value: the pattern that ``split`` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
_END = 0x110000  # stands between texts; no character
_U = np.uint64


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, _END)])
    text = "".join(map(chr, points))
    out = np.full(_END + 1, OTHER, np.uint8)
    for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    out[_END] = EDGE
    return out


@functools.lru_cache(1)
def _values() -> np.ndarray:
    return mix64(np.arange(1, 0x10001, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with an end mark behind each, where each text begins and the last ends)."""
    mark = np.array([_END], np.uint32)
    parts, at, n = [], [0], 0
    for t in texts:
        cp = np.frombuffer((t or "").encode("utf-32-le"), np.uint32)
        parts += [cp, mark]
        n += len(cp) + 1
        at.append(n)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array(at, np.int64)


_BLANK = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def parts(text: str | None, most: int = 400_000) -> Iterator[str]:
    """A long text in parts that are split as the whole is: a match never crosses a blank between letters or digits."""
    t, at = text or "", 0
    while len(t) - at > most and (m := _BLANK.search(t, at + most)):
        yield t[at : m.start()]
        at = m.start()
    yield t[at:]


def split(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each match in code points of ``code_points``."""
    k = classes()[cp]
    n = len(cp)
    prev, nxt = np.full(n, EDGE, np.uint8), np.full(n, EDGE, np.uint8)
    prev[1:], nxt[:-1] = k[:-1], k[1:]
    text, after_blank = (k != SPACE) & (k != EDGE), np.zeros(n, bool)
    after_blank[1:] = cp[:-1] == 32
    start = (k != prev) & (k != EDGE)
    start &= ~(text & after_blank)  # one blank belongs to what follows
    start |= (k == SPACE) & (nxt != SPACE) & (nxt != EDGE)  # the last white space before text stands alone, or is that blank
    # contractions, where a match begins at an apostrophe
    at = np.flatnonzero(start & (cp == 39))
    at = at[at + 2 < n]
    if len(at):
        a, b = cp[at + 1], cp[at + 2]
        two = np.isin(a, np.array([ord(x) for x in "stmd"], np.uint32))
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[at[two | three] + 1] = False
        for hit, size in ((two, 2), (three, 3)):
            to = at[hit] + size
            to = to[to < n]
            start[to[k[to] == LETTER]] = True
    bound = np.flatnonzero(start | (k == EDGE))
    first = np.flatnonzero(start[bound])
    return bound[first], bound[np.minimum(first + 1, len(bound) - 1)]


def piece_hashes(cp: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece's code points."""
    n = len(cp)
    up, down = _powers(n + 1)
    v = _values()[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        v[far] = mix64((cp[far].astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(v * up[:n], out=s[1:])
    return mix64((s[end] - s[first]) * down[first] + (end - first).astype(np.uint64))


class PieceIds:
    """Ids of pieces by hash; ``resolve`` gives those of pieces that aren't known. Beyond ``limit`` ids and pieces all are forgotten."""

    def __init__(self, resolve: Callable[[list[str]], list], limit: int = 6_000_000):
        self.resolve, self.limit = resolve, limit
        self._forget()

    def _forget(self):
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        got = self.resolve(pieces)
        size = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((x for g in got for x in g), np.int32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, flat])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last's end)."""
        if len(texts) == 1 and (cut := list(parts(texts[0])))[1:]:
            ids = np.concatenate([self._encode([p])[0] for p in cut])
            return ids, np.array([0, len(ids)])
        return self._encode(texts)

    def _encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        cp, begins = code_points(texts)
        first, end = split(cp)
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if len(self.ids) + len(self.keys) > self.limit:
            self._forget()
        distinct, where, which = np.unique(piece_hashes(cp, first, end), return_index=True, return_inverse=True)
        _, known = self._find(distinct)
        if not known.all():
            lost = where[~known]
            self._learn(distinct[~known], [cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(first[lost].tolist(), end[lost].tolist(), strict=True)])
        at, _ = self._find(distinct)
        at = at[which]
        size, begin = self.size[at].astype(np.int64), self.at[at]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (stop - size), size) + np.arange(stop[-1])]
        so_far = np.concatenate([[0], stop])
        return ids, so_far[np.searchsorted(first, begins)]
