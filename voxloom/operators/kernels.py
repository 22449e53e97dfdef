"""Numpy kernels for one slice, object or tile; the grouped pandas functions call them.

Arrays are small here: a group is one 2-D slice, one object's box or one tile.
"""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Normalised samples at -r..r, r = int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def along(a: np.ndarray, w: np.ndarray, axis: int, border: str = "symmetric") -> np.ndarray:
    """Correlation with odd weights along an axis."""
    r = len(w) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    p, n = np.pad(a, pad, mode=border), a.shape[axis]
    return sum(k * np.take(p, range(i, i + n), axis) for i, k in enumerate(w))


def gaussian(a: np.ndarray, sigma, border: str = "symmetric") -> np.ndarray:
    """Separable Gaussian; the border repeats the edge value (``symmetric``)."""
    a = np.asarray(a, float)
    for axis, s in enumerate(np.broadcast_to(sigma, a.ndim)):
        if s > 0:
            a = along(a, gaussian_weights(float(s)), axis, border)
    return a


def gradient(a: np.ndarray) -> np.ndarray:
    """Central differences, one-sided at the ends; zeros along an axis of length one."""
    return np.stack([np.gradient(a, axis=k) if a.shape[k] > 1 else np.zeros(a.shape) for k in range(a.ndim)])


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt((v**2).sum(axis=0)) + 1e-20)


def component_labels(mask: np.ndarray, reach: int) -> np.ndarray:
    """Components 1..n in raster order; neighbours differ by one in at most ``reach`` coordinates."""
    ids = np.full(mask.shape, -1)
    n = int(mask.sum())
    ids[mask] = np.arange(n)
    root, us, vs = np.arange(n), [], []
    for o in product((-1, 0, 1), repeat=mask.ndim):
        if o > (0,) * mask.ndim and sum(map(abs, o)) <= reach:
            a = ids[tuple(slice(max(0, -d), s - max(0, d)) for d, s in zip(o, mask.shape))].ravel()
            b = ids[tuple(slice(max(0, d), s - max(0, -d)) for d, s in zip(o, mask.shape))].ravel()
            both = (a >= 0) & (b >= 0)
            us.append(a[both])
            vs.append(b[both])
    u, v = np.concatenate(us), np.concatenate(vs)
    while len(u):
        low = np.minimum(root[u], root[v])
        new = root.copy()
        for side in (u, v):
            np.minimum.at(new, root[side], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.unique(root, return_inverse=True)[1] + 1 if n else 0
    return out


def largest(mask: np.ndarray, reach: int = 1) -> np.ndarray:
    c = component_labels(mask, reach)
    return c == np.bincount(c.ravel())[1:].argmax() + 1 if c.any() else mask


def disk(radius: int, dims: int) -> list[tuple]:
    r = range(-radius, radius + 1)
    return [o for o in product(r, repeat=dims) if sum(d * d for d in o) <= radius * radius]


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    p = np.pad(mask, radius)
    return np.logical_or.reduce([p[tuple(slice(radius + d, radius + d + s) for d, s in zip(o, mask.shape))] for o in disk(radius, mask.ndim)]) if radius else mask


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~mask, radius)


def close(mask: np.ndarray, radius: int) -> np.ndarray:
    return erode(dilate(mask, radius), radius)


def fill(mask: np.ndarray) -> np.ndarray:
    """Background components that touch no side become part of the mask."""
    back = component_labels(~mask, 1)
    sides = [np.take(back, (0, -1), axis=k).ravel() for k in range(mask.ndim)]
    return mask | ~np.isin(back, np.concatenate([*sides, [0]]))


def inner_boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels of the mask with a neighbour outside it (the patch's own border does not count)."""
    out = np.zeros(mask.shape, bool)
    for k in range(mask.ndim):
        step = np.diff(mask.astype(np.int8), axis=k) != 0
        lead = [slice(None)] * mask.ndim
        for part in (slice(1, None), slice(None, -1)):
            lead[k] = part
            out[tuple(lead)] |= step
    return out & mask


def label_distance(labels: np.ndarray, border: bool = False) -> np.ndarray:
    """Exact Euclidean distance to the nearest cell of another label; background is 0.

    One min-plus pass per axis, as far along a line as a nearer cell can be. With ``border`` the
    outside counts as background; without it an array of a single label has no other cell and
    gets the sum of its sides.
    """
    if border:
        inside = (slice(1, -1),) * labels.ndim
        return label_distance(np.pad(labels, 1))[inside]
    far = float(sum(labels.shape)) ** 2
    best = np.where(labels > 0, far, 0.0)
    for axis in range(labels.ndim):
        f = np.moveaxis(best, axis, -1)
        moved, n = f.shape, f.shape[-1]
        f, own = f.reshape(-1, n), np.moveaxis(labels, axis, -1).reshape(-1, n)
        one = (own == own[:, :1]).all(axis=1)
        out = np.zeros_like(f)
        for rows in (np.flatnonzero(~one), np.flatnonzero(one & (own[:, 0] > 0))):
            if len(rows):
                out[rows] = _lowest(f[rows], own[rows])
        best = np.where(labels > 0, np.moveaxis(out.reshape(moved), -1, axis), 0.0)
    return np.sqrt(best)


def _lowest(f: np.ndarray, own: np.ndarray) -> np.ndarray:
    """min over j of (f_j where line cells i and j have one label, else 0) + (i - j)^2, for cells with a label."""
    n = f.shape[1]
    at = np.broadcast_to(np.arange(n), own.shape)
    cut = own[:, 1:] != own[:, :-1]
    none = np.zeros((len(own), 1), bool)
    # the last other cell before a run and the first one after it
    before = np.maximum.accumulate(np.where(np.hstack([none, cut]), at - 1, -n), axis=1)
    after = np.minimum.accumulate(np.where(np.hstack([cut, none]), at + 1, 2 * n)[:, ::-1], axis=1)[:, ::-1]
    near = np.minimum(at - before, after - at)
    # what is farther than an other cell, or costs more than the cell has (in a line of one label: than it has above the least), is no gain
    spare = np.where(cut.any(axis=1, keepdims=True), f, f - f.min(axis=1, keepdims=True))
    near = np.minimum(near, np.ceil(np.sqrt(spare)))
    out = f.copy()
    for d in range(1, int(min(n - 1, near[own > 0].max(initial=0))) + 1):
        same = own[:, d:] == own[:, :-d]
        np.minimum(out[:, :-d], np.where(same, f[:, d:], 0.0) + d * d, out=out[:, :-d])
        np.minimum(out[:, d:], np.where(same, f[:, :-d], 0.0) + d * d, out=out[:, d:])
    return out


def signed_distance(mask: np.ndarray) -> np.ndarray:
    """Positive outside, 1 - distance inside."""
    return np.where(mask, 1 - label_distance(mask.astype(int)), label_distance((~mask).astype(int)))


def poisson(mask: np.ndarray, sources: np.ndarray | None) -> np.ndarray:
    """Solution of the five-point system over the mask and a ring around its patch, less its minimum.

    Cells outside the mask keep their right-hand side. ``sources`` are cells of the ringed
    grid; with None all cells of the mask are sources. Conjugate gradients on the unknowns.
    """
    free = np.pad(mask, 1, constant_values=True)
    b = np.zeros(free.shape)
    if sources is None:
        b[1:-1, 1:-1] = mask
    else:
        b[sources[:, 0], sources[:, 1]] = 1

    def near(x):
        p = np.pad(x, 1)
        return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]

    fixed = np.where(free, 0.0, b)
    r = np.where(free, b + near(fixed), 0.0)
    x, d, rr = np.zeros(free.shape), r.copy(), float((r * r).sum())
    stop = rr * 1e-24
    for _ in range(4 * free.size):
        if rr <= stop or rr == 0:
            break
        q = np.where(free, 4 * d - near(d), 0.0)
        step = rr / float((d * q).sum())
        x += step * d
        r -= step * q
        rr, old = float((r * r).sum()), rr
        d = r + rr / old * d
    x = (x + fixed)[1:-1, 1:-1]
    return x - x.min()


def geodesic(mask: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """First-order eikonal distance from the source cells inside the mask; infinite where none leads."""
    u = np.full(mask.shape, np.inf)
    u[sources[:, 0], sources[:, 1]] = 0
    u[~mask] = np.inf
    while True:
        p = np.pad(u, 1, constant_values=np.inf)
        a, b = np.minimum(p[:-2, 1:-1], p[2:, 1:-1]), np.minimum(p[1:-1, :-2], p[1:-1, 2:])
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        wide = np.where(np.isfinite(hi), hi, 0) - np.where(np.isfinite(lo), lo, 0)
        two = (np.isfinite(hi)) & (wide < 1)
        new = np.where(two, (np.where(two, lo + hi, 0) + np.sqrt(np.maximum(2 - np.where(two, wide, 0) ** 2, 0))) / 2, lo + 1)
        new = np.where(mask, np.minimum(u, new), np.inf)
        known = np.isfinite(u)
        if (known == np.isfinite(new)).all() and (u[known] - new[known]).max(initial=0) < 1e-9:
            return new
        u = new


def thin(mask: np.ndarray) -> np.ndarray:
    """Two-pass parallel thinning (Zhang and Suen) down to lines one pixel wide."""
    m = mask.copy()
    while True:
        before = m.copy()
        for first in (True, False):
            p = np.pad(m, 1).astype(np.int8)
            n = [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]
            count = sum(n)
            turns = sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
            up, right, down, left = n[0], n[2], n[4], n[6]
            gates = (up * right * down == 0) & (right * down * left == 0) if first else (up * right * left == 0) & (up * down * left == 0)
            m = m & ~((count >= 2) & (count <= 6) & (turns == 1) & gates)
        if (m == before).all():
            return m


def heat(mask: np.ndarray, centre: tuple, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(log heat, flow) of repeated nine-cell means with a unit source.

    The logarithm lands on the cells one down and right of the mask's, and the differences
    read the grid after that, as the flows this one is compared with are made.
    """
    t, m = np.zeros(np.array(mask.shape) + 3), np.zeros(np.array(mask.shape) + 3, bool)
    m[1:-2, 1:-2] = mask
    cy, cx = centre[0] + 1, centre[1] + 1
    for _ in range(steps):
        t[cy, cx] += 1
        p = np.pad(t, 1)
        mean = sum(p[i : i + t.shape[0], j : j + t.shape[1]] for i in range(3) for j in range(3)) / 9
        t = np.where(m, mean, t)
    y, x = np.nonzero(m)
    t[y + 1, x + 1] = np.log(1 + t[y + 1, x + 1])
    return t[y + 1, x + 1], np.stack([t[y + 1, x] - t[y - 1, x], t[y, x + 1] - t[y, x - 1]])


def medial_cell(patch: np.ndarray, guide: np.ndarray | None, quantile: float) -> np.ndarray:
    """The object's cell nearest to its median coordinates, among inner cells of a high guide value."""
    own = np.argwhere(patch)
    inner = np.argwhere(patch & ~inner_boundary(patch))
    cells = inner if len(inner) else own
    if guide is not None:
        g = guide[cells[:, 0], cells[:, 1]]
        cells = cells[g >= np.percentile(g, quantile * 100)]
    return cells[np.linalg.norm(cells - np.median(own, axis=0), axis=1).argmin()]


def spine(patch: np.ndarray, sigma: float) -> np.ndarray:
    """Thickened centre line of an object's interior, smoothed first if sigma > 0."""
    inner = patch & ~inner_boundary(patch)
    if sigma <= 0:
        return dilate(thin(inner), 1)
    soft = gaussian(inner * 255.0, sigma)
    base = thin(soft / (soft.max() + 1e-12) > 0.5)
    soft = gaussian(base * 255.0, sigma)
    soft = soft / (soft.max() + 1e-12)
    line = soft > soft.mean()
    return dilate(thin(largest(line)) if line.any() else base, 1)


def object_flow(patch: np.ndarray, method: str, guide: np.ndarray | None = None, quantile: float = 0.01, iter_factor: int = 5, skel_sigma: float = 3, power: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distance, flow of 2 rows) at the object's cells in raster order; zeros for 8 cells or fewer.

    Methods: poisson, poisson_skeleton, heat, fmm, fmm_skeleton. The patch is moved by one
    row and column, and Poisson sources stay at that index on the ringed grid.
    """
    n = int(patch.sum())
    if n <= 8:
        return np.zeros(n), np.zeros((2, n))
    room = np.pad(patch, ((1, 0), (1, 0)))
    y, x = np.nonzero(room)
    if method.endswith("skeleton"):
        source = np.argwhere(spine(patch, skel_sigma)) + 1
        if not len(source):
            return np.zeros(n), np.zeros((2, n))
    else:
        source = medial_cell(patch, guide, quantile)[None, :] + 1
    if method == "heat":
        span = int(np.ptp(x) + np.ptp(y))
        return heat(patch, tuple(source[0] - 1), iter_factor * span)
    if method.startswith("poisson"):
        f = gaussian(poisson(room, source), 1)
        if power is not None:
            f = np.clip(f, 0, 1) ** power if method == "poisson" else (f - f.min()) ** power
    elif method.startswith("fmm"):
        f = geodesic(room, source)
        top = f[room & np.isfinite(f)].max(initial=0)
        f = np.where(np.isfinite(f), top - f, 0)
        f = np.where(room, f, -label_distance((~room).astype(int)))
    else:
        raise ValueError(f"no flow method {method}")
    g = gradient(f)
    if method.endswith("skeleton"):
        g[:, source[:, 0], source[:, 1]] = 0
    return f[y, x], g[:, y, x]


def slice_flow(labels: np.ndarray, method: str, guide: np.ndarray | None = None, **how) -> tuple[np.ndarray, np.ndarray]:
    """(distance, unit flow) of a 2-D label image, object by object; method edt: distance to other labels."""
    if method == "edt":
        d = label_distance(labels)
        return d, unit(gradient(d))
    dist, flow = np.zeros(labels.shape), np.zeros((2, *labels.shape))
    r, c = np.nonzero(labels)
    order = np.argsort(labels[r, c], kind="stable")
    r, c = r[order], c[order]
    for own in np.split(np.arange(len(r)), np.flatnonzero(np.diff(labels[r, c])) + 1):
        if not len(own):
            continue
        y, x = r[own], c[own]
        box = (slice(y.min(), y.max() + 1), slice(x.min(), x.max() + 1))
        dist[y, x], flow[:, y, x] = object_flow(labels[box] == labels[y[0], x[0]], method, None if guide is None else guide[box], **how)
    return dist, unit(flow)


def sample(field: np.ndarray, at: np.ndarray, origin=0, shape: tuple | None = None) -> np.ndarray:
    """Multilinear samples of a (k, ...) field at (n, dims) points; zero outside the grid.

    ``field`` may be a piece of a grid of ``shape`` that starts at ``origin``.
    """
    shape = shape or field.shape[1:]
    low = np.floor(at).astype(int)
    part, out = at - low, np.zeros((len(at), len(field)))
    inside = ((at >= 0) & (at <= np.array(shape) - 1)).all(axis=1)
    for corner in product((0, 1), repeat=len(shape)):
        cell = np.clip(low + corner, 0, np.array(shape) - 1) - origin
        w = np.prod(np.where(corner, part, 1 - part), axis=1) * inside
        out += w[:, None] * field[(slice(None), *cell.T)].T
    return out


def advect(field: np.ndarray, start: np.ndarray, n_iter: int = 200, delta: float = 1.0, momentum: float = 0.98, decay: float = 0.0, interp: bool = False, renorm: bool = False, nearest: bool = False, each=None, origin=0, shape: tuple | None = None) -> np.ndarray:
    """End points of the steps p += (delta v + momentum v_before) / (delta + momentum) * delta / (1 + i decay).

    v is the field at p, truncated to a cell (rounded to even with ``nearest``, or interpolated);
    points stay on the grid. ``each`` is called with the step's number and positions. ``field`` may
    be the piece from ``origin`` of a grid of ``shape``, where points are places of the whole grid.
    """
    top = np.array(shape or field.shape[1:]) - 1
    p, before = start.astype(float), None
    for i in range(n_iter):
        if interp:
            v = sample(field, p, origin, shape)
        else:
            cell = (np.rint(p) if nearest else p).astype(int) - origin
            v = field[(slice(None), *cell.T)].T
        if renorm:
            v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-20)
        before = v if before is None else before
        p = np.clip(p + (delta * v + momentum * before) / (delta + momentum) * delta / (1 + i * decay), 0, top)
        before = v
        if each is not None:
            each(i + 1, p)
    return p


def flood(seeds: np.ndarray, mask: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Seeded watershed inside the mask: cells are taken in the order of cost, then of arrival."""
    out = np.where(mask, seeds, 0)
    steps = [o for o in product((-1, 0, 1), repeat=mask.ndim) if sum(map(abs, o)) == 1]
    heap = [(float(cost[tuple(c)]), i, tuple(c)) for i, c in enumerate(np.argwhere(out > 0).tolist())]
    heapq.heapify(heap)
    k = len(heap)
    while heap:
        _, _, c = heapq.heappop(heap)
        for o in steps:
            q = tuple(a + b for a, b in zip(c, o))
            if all(0 <= a < n for a, n in zip(q, mask.shape)) and mask[q] and not out[q]:
                out[q] = out[c]
                heapq.heappush(heap, (float(cost[q]), k, q))
                k += 1
    return out


def perona_malik(a: np.ndarray, niter: int = 1, kappa: float = 50, gamma: float = 0.1, step=(1.0, 1.0), option: int = 1) -> np.ndarray:
    """niter - 1 steps of anisotropic diffusion; option 1: exponential, 2: rational conduction."""
    out = np.asarray(a, float).copy()
    for _ in range(1, niter):
        move = np.zeros_like(out)
        for k, s in enumerate(step):
            d = np.diff(out, axis=k)
            g = (np.exp(-((d / kappa) ** 2)) if option == 1 else 1 / (1 + (d / kappa) ** 2)) / s
            f = g * d
            pad = [(0, 0)] * out.ndim
            pad[k] = (0, 1)
            move += np.pad(f, pad)
            pad[k] = (1, 0)
            move -= np.pad(f, pad)
        out += gamma * move
    return out


def ridges(a: np.ndarray, sigmas=(3,), black: bool = False) -> np.ndarray:
    """Neuriteness ridge filter (Meijering and others) of a 2-D image, scaled to 0..1."""
    a = np.asarray(a, float) if black else -np.asarray(a, float)
    best = np.zeros(a.shape)
    for s in sigmas:
        g = gradient(gaussian(a, s)) * s
        (hyy, hyx), (_, hxx) = gradient(g[0]) * s, gradient(g[1]) * s
        mid, gap = (hyy + hxx) / 2, np.sqrt(((hyy - hxx) / 2) ** 2 + hyx**2)
        e = np.stack([mid + gap, mid - gap])
        mixed = e + e[::-1] / 3  # weight 1 / (dims + 1)
        v = np.where(np.abs(mixed[0]) >= np.abs(mixed[1]), mixed[0], mixed[1]).clip(0)
        best = np.maximum(best, v / v.max() if v.max() > 0 else v)
    return best


def local_equalize(a: np.ndarray, tile: tuple[int, int], clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of values scaled to 0..1, blended between tiles."""
    a = np.asarray(a, float)
    span = np.ptp(a)
    q = ((a - a.min()) / (span if span else 1) * (bins - 1)).astype(int)
    n = [max(1, -(-s // t)) for s, t in zip(a.shape, tile)]
    maps = np.zeros((*n, bins))
    for i, j in np.ndindex(*n):
        part = q[i * tile[0] : (i + 1) * tile[0], j * tile[1] : (j + 1) * tile[1]]
        h = np.bincount(part.ravel(), minlength=bins).astype(float)
        top = max(1.0, clip * part.size)
        over = (h - top).clip(0).sum()
        c = (np.minimum(h, top) + over / bins).cumsum()
        maps[i, j] = c / c[-1]
    at = [np.clip((np.arange(s) + 0.5) / t - 0.5, 0, k - 1) for s, t, k in zip(a.shape, tile, n)]
    low = [np.floor(x).astype(int) for x in at]
    high = [np.minimum(x + 1, k - 1) for x, k in zip(low, n)]
    wy, wx = (at[0] - low[0])[:, None], (at[1] - low[1])[None, :]
    pick = lambda y, x: maps[y[:, None], x[None, :], q]
    return (pick(low[0], low[1]) * (1 - wy) + pick(high[0], low[1]) * wy) * (1 - wx) + (pick(low[0], high[1]) * (1 - wy) + pick(high[0], high[1]) * wy) * wx


def multi_otsu(a: np.ndarray, classes: int, bins: int = 256) -> np.ndarray:
    """classes - 1 bin centres of the largest between-class variance."""
    h, edges = np.histogram(a, bins)
    mid = (edges[1:] + edges[:-1]) / 2
    w, s = np.r_[0, h.cumsum()].astype(float), np.r_[0, (h * mid).cumsum()]
    with np.errstate(invalid="ignore", divide="ignore"):
        part = (s[None, :] - s[:, None]) ** 2 / (w[None, :] - w[:, None])
    part = np.where(w[None, :] > w[:, None], part, -np.inf)  # part[i, j]: bins i .. j-1
    best, back = part[0], []
    for _ in range(classes - 1):
        total = best[:, None] + part
        back.append(total.argmax(axis=0))
        best = total.max(axis=0)
    cuts, j = [], bins
    for b in reversed(back):
        j = int(b[j])
        cuts.append(mid[j - 1])
    return np.array(cuts[::-1])


def box_filter(a: np.ndarray, size: int) -> np.ndarray:
    """Box mean with edge values repeated; an even size leans to lower coordinates."""
    if size <= 1:
        return a
    for k in range(a.ndim):
        pad = [(0, 0)] * a.ndim
        pad[k] = (size // 2 + 1, (size - 1) // 2)
        c = np.pad(a, pad, mode="symmetric").cumsum(axis=k)
        n = a.shape[k]
        a = (np.take(c, range(size, size + n), k) - np.take(c, range(n), k)) / size
    return a


def guided(i: np.ndarray, g: np.ndarray, size: int, eps: float) -> np.ndarray:
    m = lambda x: box_filter(x, size)
    a = (m(i * g) - m(i) * m(g)) / (m(g * g) - m(g) ** 2 + eps)
    return a * g + m(i) - a * m(g)


def diffuse_labels(labels: np.ndarray, guide: np.ndarray, clamp: float, n_iter: int, alpha: float, kind: str = "heat") -> np.ndarray:
    """Label propagation F = (1 - clamp) A F + clamp Y over the grid graph; argmax, the lowest label on ties.

    A mixes affinities of the guide's differences (alpha) and of the plain grid. A kernel's
    width is the mean of the stored entries, diagonals included: the guide's own values, and ones.
    """
    kernel = lambda d, s: np.exp(-(d**2) / (2 * s**2 + 1e-20)) if kind == "heat" else np.exp(-np.abs(d) / (s + 1e-20))
    diffs = [np.abs(np.diff(guide, axis=k)) for k in range(guide.ndim)]
    stored = sum(2 * d.sum() for d in diffs) + guide.sum()
    width = stored / (sum(2 * d.size for d in diffs) + guide.size)
    own = alpha * (kernel(guide, width) + 1) + (1 - alpha) * (kernel(np.ones(guide.shape), 1.0) + 1)
    edge = [alpha * kernel(d, width) + (1 - alpha) * kernel(np.ones(d.shape), 1.0) for d in diffs]
    names = np.unique(np.r_[0, labels.ravel()])
    y = (labels[None] == names.reshape(-1, *[1] * labels.ndim)).astype(float)
    f = np.zeros_like(y)
    for _ in range(n_iter):
        af = own * f
        for k, w in enumerate(edge):
            lo = (slice(None), *[slice(None)] * k, slice(None, -1))
            hi = (slice(None), *[slice(None)] * k, slice(1, None))
            af[lo] += w * f[hi]
            af[hi] += w * f[lo]
        f = (1 - clamp) * af + clamp * y
    return names[f.argmax(axis=0)]


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of an assignment of the largest total score (Kuhn and Munkres, O(n^3))."""
    turned = score.shape[0] > score.shape[1]
    cost = -(score.T if turned else score)
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[match[j] - 1, free - 1] - u[match[j]] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j
            nxt = free[least[free].argmin()]
            d = least[nxt]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)
