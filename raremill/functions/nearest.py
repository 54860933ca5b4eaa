"""Numpy kernels run inside Arrow tasks: exact nearest neighbours of one bounded
block of vectors in another, and placement of vectors around pivots."""

from __future__ import annotations

import numpy as np

_CHUNK = 256
_MATRIX_CELLS = 1 << 20
_SLACK = 1e-6


def exact_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of the pairs (a[rows], b[cols]), terms added in feature order, so
    that they equal the scalar expression bit for bit."""
    total = np.zeros(len(rows))
    for j in range(a.shape[1]):
        gap = a[rows, j] - b[cols, j]
        total += gap * gap
    return np.sqrt(total)


def block_neighbours(seeds, seed_ids, limits, data, data_ids, k):
    """Up to ``k`` nearest rows of ``data`` per seed, no farther than its limit.

    A matrix product finds the pairs that can be among the k best, with room for
    its rounding error; only those get an exact distance. Ties are ordered by id
    and a row is not its own neighbour. Returns (seed position, data position,
    distance, rank) arrays.
    """
    centre = data.mean(axis=0)
    moved = data - centre
    data_sq = np.einsum("ij,ij->i", moved, moved)
    top = data_sq.max(initial=0.0)
    # one product gives |x|^2 - 2 s.x, the squared distance less the seed's own norm
    spread = np.vstack([-2.0 * moved.T, data_sq])
    out = []
    for start in range(0, len(seeds), _CHUNK):
        part = seeds[start : start + _CHUNK]
        limit = limits[start : start + _CHUNK]
        near = part - centre
        near_sq = np.einsum("ij,ij->i", near, near)
        with np.errstate(all="ignore"):
            rough = np.hstack([near, np.ones((len(near), 1))]) @ spread
            room = 1e-13 * data.shape[1] * (near_sq + top)
            bound = limit * limit * (1 + 1e-9) + room - near_sq
            # "not greater" also keeps pairs whose rough distance overflowed
            maybe = ~(rough > bound[:, None])
            crowded = np.flatnonzero(np.count_nonzero(maybe, axis=1) > 4 * (k + 1))
            if len(crowded):
                # the k-th best other row is no farther than the (k+1)-th of all
                kth = np.partition(rough[crowded], k, axis=1)[:, k] + 2 * room[crowded]
                maybe[crowded] &= ~(rough[crowded] > kth[:, None])
        rows, cols = np.divmod(np.flatnonzero(maybe), len(data))
        other = seed_ids[start + rows] != data_ids[cols]
        rows, cols = rows[other], cols[other]
        dist = exact_distances(part, data, rows, cols)
        keep = dist <= limit[rows]
        rows, cols, dist = rows[keep], cols[keep], dist[keep]
        order = np.lexsort((data_ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = rank < k
        out.append((rows[best] + start, cols[best], dist[best], rank[best]))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0), empty
    return tuple(np.concatenate(column) for column in zip(*out))


def load_neighbours(seeds, seed_ids, limits, asked, data, data_ids, data_runs, k):
    """Up to ``k`` nearest rows of ``data`` per seed, no farther than its limit, among the runs
    of rows that it asks for (``asked``: seeds by runs). What a run has bounds the search in
    the next. Returns (seed position, data position, distance) arrays."""
    limits, found = limits.copy(), []
    order = np.argsort(data_runs, kind="stable")
    cuts = np.flatnonzero(np.diff(data_runs[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        take = np.flatnonzero(asked[:, data_runs[own[0]]])
        if not len(take):
            continue
        position, column, dist, rank = block_neighbours(
            seeds[take], seed_ids[take], limits[take], data[own], data_ids[own], k
        )
        position = take[position]
        last = rank == k - 1
        limits[position[last]] = np.minimum(limits[position[last]], dist[last])
        found.append((position, own[column], dist))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    position, column, dist = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((data_ids[column], dist, position))
    position, column, dist = position[order], column[order], dist[order]
    best = np.arange(len(position)) - np.searchsorted(position, position) < k
    return position[best], column[best], dist[best]


def near_order(points: np.ndarray) -> np.ndarray:
    """The points in an order in which near ones stand near: halved along their widest dimension, again and again."""
    parts, out = [np.arange(len(points))], []
    while parts:
        own = parts.pop()
        if len(own) < 3:
            out.append(own)
            continue
        held = points[own]
        with np.errstate(all="ignore"):
            wide = int(np.argmax(held.max(axis=0) - held.min(axis=0)))
        own = own[np.argsort(held[:, wide], kind="stable")]
        parts += [own[len(own) // 2 :], own[: len(own) // 2]]
    return points[np.concatenate(out)] if out else points


def rough_distances(data: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to all pivots by a matrix product; see ``distance_room``."""
    squares = (
        np.einsum("ij,ij->i", data, data)[:, None]
        + np.einsum("ij,ij->i", pivots, pivots)[None, :]
        - 2.0 * (data @ pivots.T)
    )
    return np.sqrt(np.maximum(squares, 0.0))


def _chunks(rows: int, columns: int):
    """Row ranges whose matrices with that many columns stay small."""
    step = max(1, _MATRIX_CELLS // max(1, columns))
    return [slice(start, start + step) for start in range(0, rows, step)]


def closest_pivots(data: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest pivot of each row, and the exact distance to it."""
    cell = np.zeros(len(data), np.int64)
    for part in _chunks(len(data), len(pivots)):
        cell[part] = rough_distances(data[part], pivots).argmin(axis=1)
    return cell, exact_distances(data, pivots, np.arange(len(data)), cell)


def distance_room(data: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A bound on the error of ``rough_distances``, far above its rounding error."""
    widest = np.sqrt(np.einsum("ij,ij->i", pivots, pivots).max())
    return _SLACK * (np.sqrt(np.einsum("ij,ij->i", data, data)) + widest)


def reachable_cells(seeds, limits, pivots, inner, outer):
    """Which cells may hold a vector within its limit of each seed.

    A cell holds vectors at distances inner..outer from its pivot, so by the
    triangle inequality any of them is at least max(d - outer, inner - d) away
    from a seed at distance d from that pivot.
    """
    out = np.zeros((len(seeds), len(pivots)), bool)
    for part in _chunks(len(seeds), len(pivots)):
        d = rough_distances(seeds[part], pivots)
        room = distance_room(seeds[part], pivots)[:, None]
        least = np.maximum(d - outer[None, :], inner[None, :] - d) - room
        out[part] = ~(least > limits[part, None])
    return out
