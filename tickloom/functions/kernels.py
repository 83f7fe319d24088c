"""Numeric kernels in NumPy for the grouped-map operators."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np

#: The eight scaling coefficients of the order-4 Daubechies wavelet, first to last.
DB4 = np.array([0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278])
_HIGH = DB4[::-1] * np.array([1, -1] * 4)


def dwt(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail of one level, the ends mirrored half a sample out; floor((n + 7) / 2) values each."""
    n, taps = len(x), len(DB4)
    index = np.arange(-(taps - 1), n + taps - 1)
    period = index % (2 * n)
    padded = x[np.where(period < n, period, 2 * n - 1 - period)]
    size = (n + taps - 1) // 2
    at = 1 + 2 * np.arange(size)[:, None] + np.arange(taps)[None, :]
    return padded[at] @ DB4, padded[at] @ _HIGH


def idwt(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Inverse of ``dwt`` for an even length: 2 * size - 6 values."""
    taps, size = len(DB4), len(low)
    out = np.zeros(2 * size + taps - 2)
    for k in range(taps):
        out[k : k + 2 * size : 2] += low * DB4[k] + high * _HIGH[k]
    return out[taps - 2 : 2 * size]


def wavedec(x: np.ndarray, levels: int = 4) -> list[np.ndarray]:
    """Coarsest approximation, then details from the coarsest to the finest."""
    details = []
    for _ in range(levels):
        x, d = dwt(x)
        details.append(d)
    return [x, *details[::-1]]


def waverec(parts: list[np.ndarray]) -> np.ndarray:
    x = parts[0]
    for d in parts[1:]:
        x = idwt(x[: len(d)], d)
    return x


def smooth_detail(x: np.ndarray, levels: int = 4) -> np.ndarray:
    """The series rebuilt without its coarsest detail."""
    parts = wavedec(np.asarray(x, float), levels)
    parts[1] = np.zeros_like(parts[1])
    return waverec(parts)[: len(x)]


def spectrogram(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """One-sided spectrum of detrended, tapered segments: frequencies by segments."""
    step = size - overlap
    starts = np.arange(0, len(x) - size + 1, step)
    width = 0.25 * (size - 1) / 2
    n = np.arange(size)
    rise = np.minimum(n, size - 1 - n)
    taper = np.where(rise < width, 0.5 * (1 - np.cos(np.pi * rise / max(width, 1e-300))), 1.0) if size > 1 else np.ones(1)
    parts = x[starts[:, None] + n[None, :]]
    parts = (parts - parts.mean(axis=1, keepdims=True)) * taper
    power = np.abs(np.fft.rfft(parts, axis=1)) ** 2 / taper.sum() ** 2
    power[:, 1 : (size + 1) // 2] *= 2
    return power.T


def banded_volatility(r: np.ndarray, smooth: int, size: int = 256, overlap: int = 128) -> np.ndarray:
    """Per-tick volatility from three frequency bands, scaled to the deviation of the returns."""
    n = len(r)
    size, overlap = min(size, n // 10), min(overlap, n // 20)
    if size < 2:
        raise ValueError("too few returns")
    power = spectrogram(r, size, overlap)
    f = len(power)
    low, mid, high = (np.sqrt(power[a:b].sum(axis=0)) for a, b in ((0, f // 10), (f // 10, f // 3), (f // 3, f)))
    mixed = 0.3 * low + 0.5 * mid + 0.2 * high
    out = np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(mixed)), mixed)
    out = out * (r.std() / out.mean())
    return centred_mean(out, smooth) if smooth > 0 else out


def centred_mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.append(0.0, np.cumsum(x))
    i = np.arange(len(x))
    lo, hi = np.maximum(i - width // 2, 0), np.minimum(i + (width - 1) // 2 + 1, len(x))
    return (total[hi] - total[lo]) / (hi - lo)


def ewma_volatility(r: np.ndarray, span: float, least: int = 10) -> np.ndarray:
    """Root of the exponentially weighted mean square, NaN for the first rows."""
    keep, top, bottom, out = 1 - 2 / (span + 1), 0.0, 0.0, np.full(len(r), np.nan)
    for i, x in enumerate(r * r):
        top, bottom = top * keep + x, bottom * keep + 1
        if i + 1 >= least:
            out[i] = np.sqrt(top / bottom)
    return out


class Forest:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.top(x), self.top(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def simplices(dist: np.ndarray, most: float, top: int = 2) -> list[tuple[float, tuple[int, ...]]]:
    """All simplices of up to ``top`` dimensions whose edges are at most ``most``, with their longest edge, in filtration order."""
    n, out = len(dist), [(0.0, (i,)) for i in range(len(dist))]
    near = [[j for j in range(i + 1, n) if dist[i, j] <= most] for i in range(n)]
    level = [(float(dist[i, j]), (i, j)) for i in range(n) for j in near[i]]
    for _ in range(top):
        out += level
        level = [(max(f, *(float(dist[v, k]) for v in s)), (*s, k)) for f, s in level for k in near[s[-1]] if all(dist[v, k] <= most for v in s)]
    return sorted(out, key=lambda x: (x[0], len(x[1]), x[1]))


def persistence(filtered: list[tuple[float, tuple[int, ...]]], least: float = 0.0) -> list[tuple[int, float, float]]:
    """Pairs ``(dimension, birth, death)`` by column reduction over two elements; classes that never die have death inf."""
    index = {s: i for i, (_, s) in enumerate(filtered)}
    owner: dict[int, int] = {}
    columns: dict[int, set[int]] = {}
    dead, out = set(), []
    for i, (f, s) in enumerate(filtered):
        column = {index[s[:k] + s[k + 1 :]] for k in range(len(s))} if len(s) > 1 else set()
        while column and (low := max(column)) in owner:
            column ^= columns[owner[low]]
        if column:
            low = max(column)
            owner[low], columns[i] = i, column
            dead |= {low, i}
            if f - filtered[low][0] > least:
                out.append((len(filtered[low][1]) - 1, filtered[low][0], f))
    top = max((len(s) for _, s in filtered), default=1)
    out += [(len(s) - 1, f, float("inf")) for i, (f, s) in enumerate(filtered) if i not in dead and (len(s) < top or top == 1)]
    return sorted(out)


def rank2(rows: Iterable[Iterable[int]]) -> int:
    """Rank over two elements of rows given by the columns of their ones.

    The column with the fewest ones goes first and its shortest row is added to the others, so sparse rows stay sparse.
    """
    left = [set(row) for row in rows]
    held: dict[int, set[int]] = {}
    for i, row in enumerate(left):
        for column in row:
            held.setdefault(column, set()).add(i)
    queue = [(len(among), column) for column, among in held.items()]
    heapq.heapify(queue)
    rank = 0
    while queue:
        n, column = heapq.heappop(queue)
        among = held.get(column)
        if not among:
            continue
        if len(among) != n:
            heapq.heappush(queue, (len(among), column))
            continue
        rank += 1
        del held[column]
        first = min(among, key=lambda i: len(left[i]))
        among.discard(first)
        pivot, left[first] = left[first], set()
        pivot.discard(column)
        for x in pivot:
            held[x].discard(first)
        for i in among:
            row = left[i]
            row.discard(column)
            for x in pivot:
                held[x] ^= {i}
            row ^= pivot
        for x in pivot:
            heapq.heappush(queue, (len(held[x]), x))
    return rank
