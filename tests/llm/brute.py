"""Plain Python versions of the operators' contracts."""

import re
from collections import Counter

WS = r"[^\x20\x09-\x0D]+"
UP = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(WS, t or "")


def simhash(t):
    import xxhash

    w = words((t or "").translate(UP))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, bits=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def quality(t):
    t = t or ""
    w = words(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(wins)
    rep = {i + k for i, x in enumerate(wins) if c[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(rep)


def targets(sizes):
    w = {i: (5, 2, 1)[i % 3] for i in range(len(sizes))}
    out, rest = {}, 1.5 * sum(sizes)
    while True:
        share = {i: rest * w[i] / sum(w.values()) for i in w}
        over = [i for i in w if share[i] > 2 * sizes[i]]
        if not over:
            return [(out | share).get(i, 0.0) for i in range(len(sizes))]
        for i in over:
            out[i] = 2.0 * sizes[i]
            rest -= 2 * sizes[i]
            del w[i]
