"""Words of UTF-8 texts as numpy arrays: where they stand and 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased: 0-9, a-z and all but ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
CHUNK = 1 << 22
_P = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    p = np.full(n, _P, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def words(lowered: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words; a long text is read in chunks cut between words."""
    raw, at, out = np.frombuffer(lowered, np.uint8), 0, []
    while at < len(raw):
        to = min(len(raw), at + CHUNK)
        while to < len(raw) and ALNUM[raw[to]] and ALNUM[raw[to - 1]]:
            to += 1
        part = raw[at:to]
        flag = np.empty(len(part) + 2, bool)
        flag[0] = flag[-1] = False
        flag[1:-1] = ALNUM[part]
        edge = np.flatnonzero(flag[1:] != flag[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            size = e - s
            first = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(first, size)
            pw = powers(int(size.max()))
            h = np.add.reduceat((part[flag[1:-1]].astype(np.uint64) + np.uint64(1)) * pw[inside], first)
            out.append((s + at, e + at, mix(h)))
        at = to
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(_P) + h[i : i + n])
    return out
