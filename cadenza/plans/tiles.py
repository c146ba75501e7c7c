"""Merged lengths of all pairs of two tiles of curves.

Where a point of a right curve falls among a left one is the same for all points between two neighbouring times
of the left tile. So the left tile keeps a row for each such stretch, with the neighbours in every left curve, and
a right point picks one row for all left curves at once: no pair is sorted or searched by itself.
"""

from __future__ import annotations

import numpy as np

#: Left curves whose neighbours are kept together.
LEFTS = 128


class Points:
    """Curves one after another, each sorted by band, time and tie: their row counts, bands (codes from 0), times, fluxes."""

    def __init__(self, counts: np.ndarray, band: np.ndarray, time: np.ndarray, flux: np.ndarray):
        self.counts, self.band, self.time, self.flux = counts, band, time, flux
        self.first = np.cumsum(counts) - counts

    def slice(self, a: int, b: int) -> Points:
        rows = slice(self.first[a], self.first[b - 1] + self.counts[b - 1])
        return Points(self.counts[a:b], self.band[rows], self.time[rows], self.flux[rows])


class Neighbours:
    """Of every stretch between the times of some left curves: the place in each curve and the points on either side."""

    def __init__(self, left: Points, bands: int):
        n = len(left.counts)
        of = np.repeat(np.arange(n), left.counts)
        self.times, self.offset, parts, at = [], np.zeros(bands, np.int64), [], 0
        for b in range(bands):
            rows = np.flatnonzero(left.band == b)
            rows = rows[np.argsort(left.time[rows], kind="stable")]  # a curve's own order stays
            self.times.append(left.time[rows])
            self.offset[b] = at
            at += len(rows) + 1
            passed = np.zeros((len(rows) + 1, n), np.int16 if left.counts.max(initial=0) < 2**15 else np.int32)
            passed[np.arange(1, len(rows) + 1), of[rows]] = 1
            parts.append(np.cumsum(passed, axis=0, dtype=passed.dtype))
        self.place = np.concatenate(parts)
        size = np.stack([p[-1] for p in parts]).astype(np.int64)  # band, curve
        begin = left.first + np.cumsum(size, axis=0) - size
        of_row = np.repeat(np.arange(bands), [len(p) for p in parts])
        after = begin[of_row] + self.place
        self.there = np.stack([self.place > 0, self.place < size[of_row]], axis=1)  # stretch, before or after, curve
        to = np.where(self.there, np.stack([after - 1, after], axis=1), len(left.time))
        self.time, self.flux = np.append(left.time, 0.0)[to], np.append(left.flux, 0.0)[to]
        dt, df = self.time[:, 1] - self.time[:, 0], self.flux[:, 1] - self.flux[:, 0]
        self.step = np.where(self.there.all(axis=1), np.sqrt(dt * dt + df * df), 0.0)
        inner = (of[1:] == of[:-1]) & (left.band[1:] == left.band[:-1])
        dt, df = (left.time[1:] - left.time[:-1])[inner], (left.flux[1:] - left.flux[:-1])[inner]
        steps = np.sqrt(dt * dt + df * df)
        self.unknown = bool(np.isnan(left.flux).any())
        if self.unknown:
            steps, self.step = np.nan_to_num(steps), np.nan_to_num(self.step)
        self.own = np.bincount(of[1:][inner], steps, n)

    def rows(self, band: np.ndarray, time: np.ndarray) -> np.ndarray:
        """The stretch of each point; points of the left curves at its very time come before it."""
        out = np.empty(len(time), np.int64)
        for b in np.unique(band):
            own = band == b
            out[own] = self.offset[b] + np.searchsorted(self.times[b], time[own], side="right")
        return out


def _by_time(grid: np.ndarray) -> list[tuple[float, float, list[int]]]:
    """Candidates that move times alike: translate_time, dilate_time and which they are."""
    alike: dict[tuple[float, float], list[int]] = {}
    for i, (shift, _, stretch, _) in enumerate(grid.tolist()):
        alike.setdefault((shift, stretch), []).append(i)
    return [(*key, own) for key, own in alike.items()]


def merged_lengths(left: Points, right: Points, grid: np.ndarray, bands: int, wanted: np.ndarray | None = None):
    """For parts of the left curves and each right curve: (left curves, right curve, lengths), lengths by candidate (rows
    of translate_time, translate_flux, dilate_time, dilate_flux) and left curve. With `wanted` (left, right) only those.

    Steps to or from a point without flux (NaN) count nothing.
    """
    alike = _by_time(grid)
    for a in range(0, len(left.counts), LEFTS):
        b = min(a + LEFTS, len(left.counts))
        if wanted is not None and not wanted[a:b].any():
            continue
        near = Neighbours(left.slice(a, b), bands)
        moved = []  # of all right points: stretches, times and order under each movement of times
        for shift, stretch, own in alike:
            time, order = stretch * (right.time + shift), None
            if stretch <= 0:
                order = np.lexsort((time, right.band, np.repeat(np.arange(len(right.counts)), right.counts)))
                time = time[order]
            moved.append((near.rows(right.band, time), time, right.flux if order is None else right.flux[order], own))
        for r in range(len(right.counts)):
            asked = None
            if wanted is not None and not wanted[a:b, r].all():
                asked = np.flatnonzero(wanted[a:b, r])
                if not len(asked):
                    continue
            span = slice(right.first[r], right.first[r] + right.counts[r])
            yield (np.arange(a, b) if asked is None else a + asked), r, _lengths(near, asked, right.band[span], [(s[span], t[span], f[span], own) for s, t, f, own in moved], grid)


def _lengths(near: Neighbours, asked: np.ndarray | None, band: np.ndarray, moved: list, grid: np.ndarray) -> np.ndarray:
    own = near.own if asked is None else near.own[asked]
    out = np.empty((len(grid), len(own)))
    if not len(band):
        out[:] = own
        return out
    heads = np.append(True, band[1:] != band[:-1])
    for rows, time, flux, candidates in moved:
        pick = lambda v: v.take(rows, axis=0) if asked is None else v.take(rows, axis=0).take(asked, axis=-1)  # noqa: E731,B023
        place, edges = pick(near.place), pick(near.there)
        same = np.zeros(place.shape, bool)  # as the right point before it, with no left one between
        np.equal(place[1:], place[:-1], out=same[1:])
        same[heads] = False
        alone = ~same
        edges[:, 0] &= alone
        edges[:-1, 1] &= alone[1:]
        counts, stays = edges.astype(float), same.astype(float)
        base = own - np.einsum("ij,ij->j", pick(near.step), counts[:, 1])
        away = pick(near.time)
        away -= time[:, None, None]
        away *= away
        sides = pick(near.flux)
        for i in candidates:
            _, shift, _, stretch = grid[i]
            f = stretch * (flux + shift)
            inner = np.append(0.0, np.sqrt(np.square(time[1:] - time[:-1]) + np.square(f[1:] - f[:-1])))
            steps = sides - f[:, None, None]
            steps *= steps
            steps += away
            np.sqrt(steps, out=steps)
            if near.unknown or np.isnan(f).any():
                steps, inner = np.nan_to_num(steps), np.nan_to_num(inner)
            out[i] = base + np.einsum("ijk,ijk->k", steps, counts) + inner @ stays
    return out


def best_candidates(lengths: np.ndarray) -> np.ndarray:
    """Of each left curve the candidate of least length, the first of those equal after rounding to 6 digits."""
    return np.round(lengths, 6).argmin(axis=0)
