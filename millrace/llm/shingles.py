"""Word shingles of whole texts as sets of 64-bit hashes.

Words are runs of bytes other than space and the five control separators, with
A-Z lower-cased.  All words of a run of texts are hashed at once, by byte and
place; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.tokens import _begins, in_runs

#: Characters hashed at once: about a hundred bytes of memory each.
RUN_CHARS = 250_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Random words for hashing bytes by their place in a word.
_MIX = np.random.default_rng(23).integers(0, 1 << 63, 64 * 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M1
    return h ^ (h >> np.uint64(31))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 places where texts begin and end."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(_begins([len(r) + 1 for r in raw]), start, "right") - 1
    size = end - start
    place = _begins(size)
    at = np.arange(place[-1]) - np.repeat(place[:-1], size)
    values = _MIX[(at & 63) << 8 | data[~gap]]
    if len(size) and size.max() > 64:
        values = values * (2 * (at >> 6) + 1).astype(np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    hashes = _stir(sums[place[1:]] - sums[place[:-1]] + size.astype(np.uint64) * _M1)
    return hashes, _begins(np.bincount(doc, minlength=len(texts)))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, sorted; shorter texts have their whole sequence as one."""
    return [s for of in in_runs(texts, RUN_CHARS) for s in _sets_of_run(texts[of], k)]


def _sets_of_run(texts: list[str | None], k: int) -> list[np.ndarray]:
    hashes, begin = words(texts)
    n = max(0, len(hashes) - k + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(k):
        mixed = _stir(mixed * _M1 + hashes[i : i + n])
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(mixed[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for i in range(a, b):
                h = _stir(h * _M2 + hashes[i : i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
