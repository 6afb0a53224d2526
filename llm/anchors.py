"""Content-defined anchors over sequences of units (words or bytes), in numpy.

A window is ``width`` consecutive units of one document. Each window owns the
smallest (by hash) of the k-grams inside it, its *anchor*; equal windows own
equal anchors at the same offset, so windows need comparing only where their
anchors' hashes meet. All functions work on one flat array that holds many
documents one after another; ``left`` holds for each position the number of
units from it to the end of its document.
"""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x2545F4914F6CDD1D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> list[np.uint64]:
    out, p = [], 1
    for _ in range(n + 1):
        out.append(np.uint64(p))
        p = p * _BASE % (1 << 64)
    return out


def gram_hashes(units: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hash of units[i : i + n] for each i and each n of ``lengths``, by doubling.

    The hashes near the end of the array, where no full gram starts, are
    meaningless; callers mask them with ``left``.
    """
    size = len(units)
    out: dict[int, np.ndarray] = {n: None for n in lengths}
    done = {n: 0 for n in lengths}
    top = max(lengths)
    power = _powers(top)
    level, span = units.astype(np.uint64), 1
    acc: dict[int, np.ndarray] = {}
    while span <= top:
        for n in lengths:
            if n & span:
                k = done[n]
                part = np.zeros(size, np.uint64)
                part[: size - k] = level[k:]
                acc[n] = part if k == 0 else acc[n] * power[span] + part
                done[n] = k + span
        if span * 2 > top:
            break
        nxt = level * power[span]
        nxt[: size - span] += level[span:]
        level, span = nxt, span * 2
    for n in lengths:
        out[n] = mix(acc[n])
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i (past the end counts as nothing)."""
    out, span = x.copy(), 1
    while span * 2 <= width:
        out[:-span] = np.minimum(out[:-span], out[span:]) if span < len(out) else out[:-span]
        span *= 2
    rest = width - span
    if rest and rest < len(out):
        out[:-rest] = np.minimum(out[:-rest], out[rest:])
    return out


def owned_runs(units: np.ndarray, left: np.ndarray, width: int, k: int):
    """Maximal runs of windows that own the same anchor, at one place (the leftmost of equal grams).

    Returns (first, last, anchor, fragment): positions of the first and last
    window start of each run, the anchor's hash, and a hash of the run's whole
    text units[first : last + width] together with the anchor.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(units) < width:
        return none
    grams = gram_hashes(units, (k, width))
    h = grams[k]
    low = sliding_min(h, width - k + 1)
    ok = left >= width
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none
    m = low[starts]
    cut = np.empty(len(starts), bool)
    cut[0] = True
    # the leftmost smallest gram leaves a window that starts with it
    cut[1:] = (m[1:] != m[:-1]) | (starts[1:] != starts[:-1] + 1) | (h[starts[:-1]] == m[:-1])
    at = np.flatnonzero(cut)
    first = starts[at]
    last = starts[np.append(at[1:], len(starts)) - 1]
    # a run is shorter than a window, so the windows at its ends and its length fix its text
    w = grams[width]
    anchor = low[first]
    fragment = mix(mix(w[first] ^ anchor) + mix(w[last] + np.uint64(1)) * _M1 + (last - first).astype(np.uint64))
    return first, last, anchor, fragment
