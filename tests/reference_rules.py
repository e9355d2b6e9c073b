"""Plain one-row-at-a-time statements of the rules, for small fixtures."""

from __future__ import annotations

import math
import statistics


def greedy(speeds, window, threshold, currents=None, current_threshold=None):
    """Chosen and rejected starts of one segment."""
    chosen, rejected, i = [], [], 0
    while i + window <= len(speeds):
        part = speeds[i : i + window]
        fine = all(v is not None and abs(v - part[0]) <= threshold for v in part) and part[0] is not None
        for series in currents or []:
            c = series[i : i + window]
            steps = [abs(b - a) for a, b in zip(c, c[1:]) if a is not None and b is not None]
            fine = fine and all(s < current_threshold for s in steps)
        if fine:
            chosen.append(i)
            i += window
        else:
            rejected.append(i)
            i += 1
    return chosen, rejected


def rounding(values):
    out = []
    for i, v in enumerate(values):
        if i and abs(v - values[i - 1]) <= 0.01:
            out.append(out[-1])
        else:
            out.append(round(v * 100 + 0.5) / 100)
    return out


def runs(flags):
    found, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            found.append((start, i))
            start = None
    return found


def excursion(x, threshold, samples):
    m = statistics.median(x)
    return any(b - a >= samples for a, b in runs([abs(v - m) > threshold for v in x]))


def drift(x, samples, amplitude):
    if len(x) < samples:
        return False
    d = [b - a for a, b in zip(x, x[1:])]
    longest = max([b - a for s in (1, -1) for a, b in runs([s * v > 0 for v in d])], default=0)
    return longest >= samples and max(x) - min(x) >= amplitude


def bump(x, k, floor, shortest, longest, band, width=20):
    n, half = len(x), width // 2
    base = [
        sorted(x[min(max(j, 0), n - 1)] for j in range(i - half, i - half + width))[half]
        for i in range(n)
    ]
    res = [a - b for a, b in zip(x, base)]
    m = statistics.median(res)
    sigma = 1.4826 * statistics.median([abs(r - m) for r in res])
    limit = max(k * sigma, floor)
    level = statistics.median(base)
    for a, b in runs([abs(r) > limit for r in res]):
        if shortest <= b - a <= longest and b < n:
            if abs(statistics.median(x[b : b + 30]) - level) < band * sigma:
                return True
    return False


def variability(x, ptp, band, fraction):
    m = statistics.median(x)
    outside = sum(abs(v - m) > band for v in x) / len(x)
    return max(x) - min(x) > ptp or outside > fraction


def drift_timed(points, min_run, amplitude):
    kept = [(t, v) for t, v in points if v is not None and math.isfinite(v)]
    if len(kept) < 3:
        return False
    dt = statistics.median([b[0] - a[0] for a, b in zip(kept, kept[1:])])
    if dt <= 0:
        return False
    v = [p[1] for p in kept]
    sign = [(b > a) - (b < a) for a, b in zip(v, v[1:])]
    for i in range(1, len(sign)):
        sign[i] = sign[i] or sign[i - 1]
    start = 0
    for i in range(1, len(sign) + 1):
        if i == len(sign) or sign[i] != sign[start]:
            if sign[start] and (i - start) * dt >= min_run and abs(v[i] - v[start]) >= amplitude:
                return True
            start = i
    return False


def excursion_timed(points, threshold, min_duration):
    if len(points) < 3:
        return False
    t = [p[0] for p in points]
    dt = statistics.median([b - a for a, b in zip(t, t[1:])])
    known = [v for _, v in points if v is not None]
    if dt <= 0 or not known:
        return False
    m = statistics.median(known)
    far = [v is not None and abs(v - m) > threshold for _, v in points]
    return max([b - a for a, b in runs(far)], default=0) * dt >= min_duration


def spike_free(x, jump):
    med = [
        statistics.median(x[i - 2 : i + 3]) if 2 <= i < len(x) - 2 and None not in x[i - 2 : i + 3] else None
        for i in range(len(x))
    ]
    kept = list(x)
    for i in range(1, len(x)):
        if med[i] is not None and med[i - 1] is not None and abs(med[i] - med[i - 1]) > jump:
            kept[i] = None
    known = [i for i, v in enumerate(kept) if v is not None]
    out = []
    for i, v in enumerate(kept):
        left = max((k for k in known if k <= i), default=None)
        right = min((k for k in known if k >= i), default=None)
        if v is not None or not known:
            out.append(v)
        elif left is None or right is None:
            out.append(kept[right if left is None else left])
        else:
            out.append(kept[left] + (kept[right] - kept[left]) * (i - left) / (right - left))
    return out
