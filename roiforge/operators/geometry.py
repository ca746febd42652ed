"""Geometry and spectra of single regions: what needs an ordered contour, a hull or a dense image.

One grouped pass over a region's pixels (Arrow in, Arrow out) computes the asked groups of features with numpy. Large regions take another way where
there is one, see operators.outline.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiforge.functions.sqltext import KEYS
from roiforge.operators.shape import WEIGHTED_INTENSITY_NAMES, WEIGHTED_SHAPE_NAMES, moment_names

# fixed values: in which order a walk along the border tries its neighbours, (dx, dy), y downwards
_STRAIGHT, _DIAGONAL = ((-1, 0), (0, -1), (1, 0), (0, 1)), ((-1, -1), (1, -1), (1, 1), (-1, 1))
_STATS = ("MIN", "MAX", "MEAN", "MEDIAN", "STDDEV", "MODE")
_CHORDS = ("MAX", "MAX_ANG", "MIN", "MIN_ANG", "MEDIAN", "MEAN", "MODE", "STDDEV")
#: Cells of a box up to which a region is small.
SMALL = 1024
#: Groups of features that one pass can compute.
GROUPS: dict[str, tuple[str, ...]] = {
    "contour": ("PERIMETER", "DIAMETER_EQUAL_PERIMETER", "EDGE_MEAN_INTENSITY", "EDGE_STDDEV_INTENSITY", "EDGE_MAX_INTENSITY", "EDGE_MIN_INTENSITY", "EDGE_INTEGRATED_INTENSITY", "CIRCULARITY"),
    "hull": ("CONVEX_HULL_AREA", "SOLIDITY"),
    "erosion": ("EROSIONS_2_VANISH", "EROSIONS_2_VANISH_COMPLEMENT"),
    "fractal": ("FRACT_DIM_PERIMETER",),
    "caliper": ("MIN_FERET_ANGLE", "MAX_FERET_ANGLE", *(f"STAT_{k}_DIAM_{s}" for k in ("FERET", "MARTIN", "NASSENSTEIN") for s in _STATS)),
    "chords": tuple(f"{k}CHORDS_{s}" for k in ("MAX", "ALL") for s in _CHORDS),
    "circles": ("DIAMETER_MIN_ENCLOSING_CIRCLE", "DIAMETER_CIRCUMSCRIBING_CIRCLE", "DIAMETER_INSCRIBING_CIRCLE"),
    "geodetic": ("GEODETIC_LENGTH", "THICKNESS"),
    "radius": ("ROI_RADIUS_MEAN", "ROI_RADIUS_MAX", "ROI_RADIUS_MEDIAN"),
    "radial": tuple(f"{k}_{b}" for k in ("FRAC_AT_D", "MEAN_FRAC", "RADIAL_CV") for b in range(8)),
    "gabor": tuple(f"GABOR_{k}" for k in range(4)),
    "zernike": tuple(f"ZERNIKE2D_Z{k}" for k in range(30)),
    "weighted_moments": tuple(moment_names(WEIGHTED_SHAPE_NAMES, True)),
    "weighted_intensity_moments": tuple(moment_names(WEIGHTED_INTENSITY_NAMES, True)),
    "sharpness": ("SHARPNESS",),
    "spectrum": ("POWER_SPECTRUM_SLOPE",),
}


class Region:
    """A region's pixels in rows, repeated ones once, with what several features draw on computed at most once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, inten: np.ndarray) -> None:
        x, y = x.astype(np.int64), y.astype(np.int64)
        self.x0, self.y0 = int(x.min()), int(y.min())
        self.w, self.h = int(x.max()) - self.x0 + 1, int(y.max()) - self.y0 + 1
        cell, at = np.unique((y - self.y0) * self.w + (x - self.x0), return_index=True)
        self.x, self.y, self.inten = cell % self.w + self.x0, cell // self.w + self.y0, inten[at].astype(float)
        self.n = len(self.x)

    @cached_property
    def mask(self) -> np.ndarray:
        mask = np.zeros((self.h, self.w), dtype=bool)
        mask[self.y - self.y0, self.x - self.x0] = True
        return mask

    @cached_property
    def image(self) -> np.ndarray:
        image = np.zeros((self.h, self.w))
        image[self.y - self.y0, self.x - self.x0] = self.inten
        return image

    @cached_property
    def centre(self) -> np.ndarray:
        """Mean place, relative to the box."""
        return np.array([(self.x - self.x0).mean(), (self.y - self.y0).mean()])

    def values(self, points: np.ndarray) -> np.ndarray:
        """Intensities at places relative to the box."""
        return self.image[points[:, 1], points[:, 0]]

    @cached_property
    def contours(self) -> list[np.ndarray]:
        y, x = np.nonzero(border(self.mask))
        return walks(x, y, self.w)

    @cached_property
    def contour(self) -> np.ndarray:
        """All walks one after the other: x, y relative to the box."""
        return np.concatenate([np.zeros((0, 2), dtype=np.int64), *self.contours])

    @cached_property
    def perimeter(self) -> float:
        """Length of the contour as one closed chain, steps between walks included."""
        c = self.contour
        return float(np.hypot(*(np.roll(c, 1, axis=0) - c).T).sum())

    @cached_property
    def hull(self) -> np.ndarray:
        rows = np.flatnonzero(self.mask.any(1))
        left, right = self.mask.argmax(1)[rows], self.w - 1 - self.mask[:, ::-1].argmax(1)[rows]
        return hull(np.concatenate([np.stack([left, rows], axis=1), np.stack([right, rows], axis=1)]))

    @cached_property
    def distances(self) -> np.ndarray:
        """Squared distance of each pixel to the nearest contour pixel; 0 where there is no contour."""
        if not len(self.contour):
            return np.zeros(self.n, dtype=np.int64)
        at = np.zeros((self.h, self.w), dtype=bool)
        at[self.contour[:, 1], self.contour[:, 0]] = True
        return squared_distances(at)[self.y - self.y0, self.x - self.x0]


def border(mask: np.ndarray) -> np.ndarray:
    """Pixels of which a 4-neighbour lies outside, be it around the region or in a hole."""
    p = np.pad(mask, 1)
    return mask & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])


def walks(x: np.ndarray, y: np.ndarray, w: int) -> list[np.ndarray]:
    """Border pixels, given by rows within a box of width w, in the order of walks along them: (x, y).

    A walk starts at the first pixel left, by rows, and steps to unvisited border pixels, straight ones before diagonal ones and each in a
    fixed order. Where it gets stuck it ends, if its last pixel lies in a row or column next to its first one's; else it goes on from
    the last place where it had a choice. A walk that never had one is dropped, unless it used up the border. So are pixels
    without neighbours on the border.
    """
    stride = w + 2
    cell = (x + 1) + stride * (y + 1)
    beside = np.zeros(len(cell), dtype=bool)
    for dx, dy in (*_STRAIGHT, *_DIAGONAL):
        near = cell + dx + stride * dy
        at = np.minimum(np.searchsorted(cell, near), len(cell) - 1)
        beside |= cell[at] == near
    order = cell[beside].tolist()
    left = set(order)
    straight, diagonal = ([dx + stride * dy for dx, dy in steps] for steps in (_STRAIGHT, _DIAGONAL))
    found = []
    for start in order:
        if start not in left:
            continue
        left.discard(start)
        walk, forks, tip, done = [start], [], start, False
        while left:
            near = [tip + s for s in straight if tip + s in left] or [tip + s for s in diagonal if tip + s in left]
            if near:
                if len(near) > 1:
                    forks.append(tip)
                tip = near[0]
                left.discard(tip)
                walk.append(tip)
                continue
            done = abs(tip // stride - start // stride) == 1 or abs(tip % stride - start % stride) == 1
            if done or not forks:
                break
            tip = forks.pop()
        else:
            done = len(walk) > 1
        if done:
            cells = np.array(walk)
            found.append(np.stack([cells % stride - 1, cells // stride - 1], axis=1))
    return found


def squared_distances(targets: np.ndarray) -> np.ndarray:
    """Squared distance of each cell to the nearest target: first along columns, then the least over rows' offsets, as far as one can gain."""
    h, w = targets.shape
    far = h + w
    rows = np.arange(h)[:, None]
    above = rows - np.maximum.accumulate(np.where(targets, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(targets, rows, 2 * far)[::-1], axis=0)[::-1] - rows
    column = np.minimum(np.minimum(above, below), far).astype(np.int64) ** 2
    best = column.copy()
    for d in range(1, w):
        if d * d >= best.max():
            break
        np.minimum(best[:, d:], column[:, :-d] + d * d, out=best[:, d:])
        np.minimum(best[:, :-d], column[:, d:] + d * d, out=best[:, :-d])
    return best


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, from pixel centres."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p, dtype=float)

    def half(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(reversed(p)), dtype=float)


def _whole_mode(v: np.ndarray) -> float:
    values, n = np.unique(v.astype(np.int64), return_counts=True)
    return float(values[np.argmax(n)])


def _stats(v: np.ndarray) -> list[float]:
    return [float(v.min()), float(v.max()), float(v.mean()), float(np.median(v)), float(v.std()), _whole_mode(v)] if len(v) else [0.0] * 6


def _rotated(p: np.ndarray, degrees: float, about: np.ndarray | float = 0.0) -> np.ndarray:
    t = math.radians(degrees)
    return (p - about) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + about


def _slope(pairs: list[tuple[float, float]]) -> float:
    if len(pairs) < 2:
        return 0.0
    u, v = np.log(np.array(pairs)).T
    spread = ((u - u.mean()) ** 2).sum()
    return float(((u - u.mean()) * (v - v.mean())).sum() / spread) if spread > 0 else 0.0


def contour_features(r: Region) -> list[float]:
    if not len(r.contour):
        return [0.0] * 8
    e = r.values(r.contour)
    round_ = math.sqrt(4 * math.pi * r.n / r.perimeter**2) if r.perimeter else 0.0
    return [r.perimeter, r.perimeter / math.pi, e.mean(), e.std(ddof=1) if len(e) > 1 else 0.0, e.max(), e.min(), e.sum(), round_]


def hull_features(r: Region) -> list[float]:
    c = r.hull
    if len(c) < 3:
        area = float(r.n)
    else:
        d = np.roll(c, -1, axis=0)
        shoelace = abs(float((c[:, 0] * d[:, 1] - c[:, 1] * d[:, 0]).sum())) / 2
        border = sum(math.gcd(abs(int(a)), abs(int(b))) for a, b in (d - c))
        area = shoelace + border / 2 + 1
    return [area, r.n / area]


def erosion_features(r: Region) -> list[float]:
    """How many erosions by the 4-neighbourhood leave something; outside the box there is nothing. The complement is defined as 0."""
    m, survived = r.mask, -1
    while m.any():
        m = m & ~border(m)
        survived += 1
    return [float(survived), 0.0]


def fractal_features(r: Region) -> list[float]:
    c, pairs = r.contour.astype(float), []
    stride = len(c) // 4
    while stride > 0 and len(c) >= 3:
        stops = c[np.arange(0, len(c), stride)]
        legs = np.hypot(*(np.roll(stops, -1, axis=0) - stops).T)
        if legs.sum() > 0:
            pairs.append((legs.mean(), legs.sum()))
        stride //= 2
    return [1 - _slope(pairs) if pairs else 0.0]


def _martin(c: np.ndarray) -> np.ndarray:
    """Widths of convex outlines (one for each first index) at the level that halves their area, over 100 levels."""
    low, high = c[:, :, 1].min(1), c[:, :, 1].max(1)
    levels = low[:, None] + (np.arange(100) + 0.5) * (high - low)[:, None] / 100
    a, b = c[:, None], np.roll(c, -1, axis=1)[:, None]
    v = levels[:, :, None]
    cross = (a[..., 1] <= v) != (b[..., 1] <= v)
    rise = np.where(a[..., 1] == b[..., 1], 1.0, b[..., 1] - a[..., 1])
    xs = a[..., 0] + (v - a[..., 1]) / rise * (b[..., 0] - a[..., 0])
    met = cross.any(2)
    widths = np.where(met, np.where(cross, xs, -np.inf).max(2) - np.where(met, np.where(cross, xs, np.inf).min(2), 0.0), 0.0)
    total = np.cumsum(widths, axis=1)
    at = np.minimum(99, (total < total[:, -1:] / 2).sum(1))
    return np.where(high > low, widths[np.arange(len(c)), at], 0.0)


def _nassenstein(c: np.ndarray) -> np.ndarray:
    """Vertical extents of convex outlines (one for each first index) above the mean place of their lowest tangent."""
    top = c[:, :, 1].max(1)
    lowest = c[:, :, 1] >= top[:, None] - 1e-3
    x = (np.where(lowest, c[:, :, 0], 0.0).sum(1) / lowest.sum(1))[:, None]
    a, b = c, np.roll(c, -1, axis=1)
    hit = (np.minimum(a[..., 0], b[..., 0]) <= x + 1e-9) & (np.maximum(a[..., 0], b[..., 0]) >= x - 1e-9)
    upright = np.abs(b[..., 0] - a[..., 0]) < 1e-12
    ys = np.where(upright, a[..., 1], a[..., 1] + (x - a[..., 0]) / np.where(upright, 1.0, b[..., 0] - a[..., 0]) * (b[..., 1] - a[..., 1]))
    return np.where(hit.any(1), top - np.where(hit, ys, np.inf).min(1), 0.0)


def _turns(degrees: Sequence[float]) -> np.ndarray:
    """What _rotated() multiplies places by, for several angles."""
    return np.array([[[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]] for t in map(math.radians, degrees)])


_CALIPER_TURNS = _turns([math.degrees(np.float32(t) * np.float32(math.pi) / np.float32(180)) for t in range(0, 181, 10)])
_CHORD_TURNS = _turns([180.0 * k / 20 for k in range(20)])


def caliper_features(r: Region) -> list[float]:
    """Diameters of the hull turned in steps of ten degrees about its corners' mean, in single precision: modes of whole diameters depend on it."""
    c = r.hull
    if len(c) < 3:
        return [0.0] * len(GROUPS["caliper"])
    turned = ((c - c.mean(0)) @ _CALIPER_TURNS + c.mean(0)).astype(np.float32).astype(float)
    widths = [(t, float(v)) for t, v in zip(range(0, 181, 10), np.ptp(turned[:, :, 0], axis=1), strict=True) if v > 0]
    feret = np.array([v for _, v in widths])
    others = [f(turned[:18]) for f in (_martin, _nassenstein)]
    angles = [float(min(widths, key=lambda p: (p[1], p[0]))[0]), float(max(widths, key=lambda p: (p[1], -p[0]))[0])] if widths else [0.0, 0.0]
    return [*angles, *_stats(feret), *_stats(others[0][others[0] > 0]), *_stats(others[1][others[1] > 0])]


def _column_runs(x: np.ndarray, y: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest run of rows in each column with one, in columns' order, and which set of places (x and y have one for each first index) it is of.

    A run that reaches the row `last` of its set doesn't count.
    """
    x0, y0 = x.min(1), y.min(1)
    w, h = x.max(1) - x0 + 1, int((last - y0).max()) + 2
    base = np.cumsum(w) - w
    seen = np.zeros(int(w.sum()) * h, dtype=bool)
    seen[(x - (x0 - base)[:, None]) * h + (y - y0[:, None])] = True
    # each column ends with a blank row, so no run spans two columns
    edge = np.diff(seen.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.repeat(np.arange(len(w)), w)
    open_ = ends % h != (last - y0 + 1)[owner[begins // h]]
    longest = np.zeros(len(owner), dtype=np.int64)
    np.maximum.at(longest, begins[open_] // h, (ends - begins)[open_])
    step = np.where(w >= 200, w // 100, 1)[owner]
    kept = ((np.arange(len(owner)) - base[owner]) % step == 0) & (longest > 0)
    return longest[kept], owner[kept]


def chord_features(r: Region) -> list[float]:
    """Chords are columns of the pixels turned about the box's centre, places cut to whole numbers, in 20 directions; pixels of intensity 0 are blank.

    From 200 columns on every (width / 100)-th column is a chord, which is how the feature is defined.
    """
    seen = r.inten != 0
    if not seen.any():
        return [0.0] * 16
    p = np.stack([r.x, r.y], axis=1).astype(float)
    about = np.array([r.x0 + (r.w - 1) / 2, r.y0 + (r.h - 1) / 2])
    # few angles at a time where there are many places
    longest, every = [], []
    some = max(1, min(20, 1_000_000 // r.n))
    for k in range(0, 20, some):
        q = np.trunc(((p - about) @ _CHORD_TURNS[k : k + some] + about).astype(np.float32)).astype(np.int64)
        runs, of = _column_runs(q[:, seen, 0], q[:, seen, 1], q[:, :, 1].max(1))
        every.append((180.0 * (of + k) / 20, runs.astype(float)))
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
        longest.append((every[-1][0][first], np.maximum.reduceat(every[-1][1], first) if len(first) else every[-1][1]))
    out = []
    for sets in (longest, every):
        angle, v = (np.concatenate(c) for c in zip(*sets, strict=True))
        if not len(v):
            return [0.0] * 16
        # the least angle of equally long chords
        out += [v.max(), math.radians(angle[v.argmax()]), v.min(), math.radians(angle[v.argmin()]), float(np.median(v)), v.mean(), _whole_mode(v), v.std(ddof=1) if len(v) > 1 else 0.0]
    return out


def enclosing_circle(points: np.ndarray) -> float:
    """Diameter of the least circle around points: Welzl's move-to-front scheme, iteratively, over the hull's corners."""

    def through(b: list[np.ndarray]) -> tuple[np.ndarray, float]:
        if len(b) == 1:
            return b[0], 0.0
        if len(b) == 2:
            return (b[0] + b[1]) / 2, float(np.hypot(*(b[0] - b[1]))) / 2
        (ax, ay), (bx, by), (cx, cy) = b
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            far = max(((p, q) for p in b for q in b), key=lambda t: float(np.hypot(*(t[0] - t[1]))))
            return through(list(far))
        s, t, u = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        centre = np.array([(s * (by - cy) + t * (cy - ay) + u * (ay - by)) / d, (s * (cx - bx) + t * (ax - cx) + u * (bx - ax)) / d])
        return centre, float(np.hypot(*(centre - b[0])))

    p = [np.array(v, dtype=float) for v in points.tolist()]
    inside = lambda c, q: np.hypot(*(q - c[0])) <= c[1] + 1e-9
    circle = through(p[:1])
    for i, a in enumerate(p):
        if not inside(circle, a):
            circle = through([a])
            for j, b in enumerate(p[:i]):
                if not inside(circle, b):
                    circle = through([a, b])
                    for c in p[:j]:
                        if not inside(circle, c):
                            circle = through([a, b, c])
    return 2 * circle[1]


def circle_features(r: Region, shift: float = 2.0) -> list[float]:
    """The least enclosing circle, and those through the contour's farthest and nearest pixel about the centroid, shifted up and left.

    A shift of 2 is what the feature is defined by here; with 0 both lie about the centroid itself.
    """
    if not len(r.contour):
        return [0.0] * 3
    d = np.hypot(*(r.contour - (r.centre - shift)).T)
    return [enclosing_circle(r.hull), 2 * d.max(), 2 * d.min()]


def geodetic_features(r: Region) -> list[float]:
    length = r.perimeter / 4 + math.sqrt(max(r.perimeter**2 / 16 - r.n, 0.0))
    return [length, r.perimeter / 2 - length]


def radius_features(r: Region) -> list[float]:
    d = r.distances
    return [d.mean(), float(d.max()), float(np.median(d))]


def radial_features(r: Region) -> list[float]:
    """Eight rings about the pixel whose distances to the contour differ least, the first by rows; eight wedges in each ring."""
    if not len(r.contour):
        return [0.0] * 24
    p = np.stack([r.x - r.x0, r.y - r.y0], axis=1)
    # the farthest contour pixel is a corner of the contour's hull
    corners = hull(r.contour)
    beyond = [(p[k : k + 50_000] @ (-2 * corners.T) + (corners**2).sum(1)).max(1) for k in range(0, r.n, 50_000)]
    farthest = (p**2).sum(1) + np.concatenate(beyond)
    at = int(np.argmin(farthest - r.distances))
    centre, most = p[at], math.sqrt(farthest[at])
    d = np.hypot(*(p - centre).T)
    ring = np.minimum((7 * (d / most)).astype(np.int64), 7) if most else np.zeros(len(p), dtype=np.int64)
    angle = np.arctan2(p[:, 1] - centre[1], p[:, 0] - centre[0])
    wedge = np.minimum((np.where(angle < 0, angle + 2 * math.pi, angle) / (math.pi / 4)).astype(np.int64), 7)
    n, total = np.bincount(ring, minlength=8), np.bincount(ring, r.inten, minlength=8)
    wedges = np.bincount(ring * 8 + wedge, r.inten, minlength=64).reshape(8, 8)
    return [*(n / (r.n + 1e-9)), *(total / (n + 1e-9)), *(wedges.std(1) / (wedges.mean(1) + 1e-9))]


def _gabor_kernel(n: int, f0: float, theta: float, gamma: float, sig2lam: float) -> np.ndarray:
    """A wave under a Gaussian of sig2lam wavelengths; a wave of frequency 0 is flat."""
    v = np.arange(n) - n // 2
    gx, gy = np.meshgrid(v, v)
    along, across = gx * math.cos(theta) + gy * math.sin(theta), gy * math.cos(theta) - gx * math.sin(theta)
    narrow = (f0 / (sig2lam * 2 * math.pi)) ** 2
    kernel = np.exp(-(along**2 + gamma**2 * across**2) * narrow / 2) * np.exp(1j * f0 * along)
    return kernel / np.abs(kernel).sum()


def _filtered(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    shape = [a + b - 1 for a, b in zip(image.shape, kernel.shape, strict=True)]
    full = np.fft.ifft2(np.fft.fft2(image, shape) * np.fft.fft2(kernel, shape))
    at = math.ceil(len(kernel) / 2)
    return np.abs(full[at : at + image.shape[0], at : at + image.shape[1]])


def gabor_features(r: Region, pairs: Sequence[tuple[float, float]] = ((0.0, 4.0), (45.0, 16.0), (90.0, 32.0), (135.0, 64.0)), n: int = 16, gamma: float = 0.1, sig2lam: float = 0.8, low: float = 0.1, threshold: float = 0.025) -> list[float]:
    """For each (theta, frequency) the share of pixels whose response exceeds threshold, relative to the low-pass baseline."""
    base = _filtered(r.image, _gabor_kernel(n, low, math.pi / 2, gamma, sig2lam))
    count = float((base > base.min()).sum())
    top = base.max()
    return [float((_filtered(r.image, _gabor_kernel(n, f, math.radians(t), gamma, sig2lam)) / top > threshold).sum()) / count if top > 0 and count else 0.0 for t, f in pairs]


def zernike_features(r: Region, order: int = 9, shift: int = 1) -> list[float]:
    """Magnitudes of the Zernike moments up to order 9 over the disc of the box's lesser side about the centroid of intensity.

    The angle turns m + shift times for repetition m: 1 is what the feature is defined by here, 0 the textbook's form.
    """
    total = r.image.sum()
    if not total:
        return [0.0] * 30
    yy, xx = np.mgrid[1 : r.h + 1, 1 : r.w + 1]
    cx, cy = (xx * r.image).sum() / total, (yy * r.image).sum() / total
    u, v = (xx - cx) / min(r.w, r.h), (yy - cy) / min(r.w, r.h)
    rho, phi = np.hypot(u, v), np.arctan2(v, u)
    on = (rho <= 1) & (rho > np.finfo(float).eps) & (r.image > 0)
    rho, phi, f = rho[on], phi[on], r.image[on] / total
    out = []
    for n in range(order + 1):
        for m in range(n % 2, n + 1, 2):
            radial = sum((-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + m) // 2 - s) * math.factorial((n - m) // 2 - s)) * rho ** (n - 2 * s) for s in range((n - m) // 2 + 1))
            out.append(float(abs((n + 1) / math.pi * (f * radial * np.exp(-1j * (m + shift) * phi)).sum())))
    return out


def _weighted(r: Region, f: np.ndarray) -> list[float]:
    f = f * np.log(np.sqrt(r.distances) + 0.001)
    x, y = (r.x - r.x0).astype(float), (r.y - r.y0).astype(float)
    raw = lambda p, q: float((f * x**p * y**q).sum())
    m00 = raw(0, 0)
    cx, cy = (raw(1, 0) / m00, raw(0, 1) / m00) if m00 else (0.0, 0.0)
    central = lambda p, q: float((f * (x - cx) ** p * (y - cy) ** q).sum())
    second = [(0, 2), (0, 3), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)]
    # the weights' sum may be negative: its magnitude is what normalises
    norm = {k: central(*k) / abs(m00) ** (sum(k) / 2 + 1) if m00 else 0.0 for k in second}
    a, b = norm[3, 0] + norm[1, 2], norm[2, 1] + norm[0, 3]
    c, d = norm[3, 0] - 3 * norm[1, 2], 3 * norm[2, 1] - norm[0, 3]
    e = norm[2, 0] - norm[0, 2]
    invariants = [
        norm[2, 0] + norm[0, 2], e**2 + 4 * norm[1, 1] ** 2, c**2 + d**2, a**2 + b**2, c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2),
        e * (a**2 - b**2) + 4 * norm[1, 1] * a * b, d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2),
    ]
    return [*(raw(p, q) for p in range(4) for q in range(4) if p + q <= 3), *(central(*k) for k in second), *(norm[k] for k in second), *invariants]


def sharpness_features(r: Region, width: int = 2) -> list[float]:
    """Second differences of the 3x3 median, over its contrast at edges, down the rows and along them; hypot of both means over edges.

    What lies beyond the box is 0 in differences, and the nearest pixel in the median. Windows are 2 * width rows for both; a box of 2 * width
    rows or less has no window, and sharpness 0.
    """
    image, h, w = r.image.astype(float), r.h, r.w
    near = np.pad(image, 1, mode="edge")
    blurred = np.median(np.stack([near[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)]), axis=0) / 255

    def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        return np.pad(a, 2)[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]

    along, down = ((shifted(image, dy, dx) - shifted(image, -dy, -dx)) / 2 for dy, dx in ((0, 1), (1, 0)))
    steepest, ratios = along.max() + 1e-8, []
    # contrast down the rows counts where intensities change along them, and the other way round
    for slope, dy, dx in ((along, 1, 0), (down, 0, 1)):
        edge = np.abs(slope) / steepest > 0.0001
        bend = np.abs(shifted(blurred, -2 * dy, -2 * dx) - 2 * blurred + shifted(blurred, 2 * dy, 2 * dx))
        contrast = np.abs(shifted(blurred, dy, dx) - blurred) * edge
        if h <= 2 * width:
            return [0.0]
        over, under = (sum(v[width + k : h - width + k] for k in range(-width, width)) for v in (bend, contrast))
        share = np.divide(over, under, out=np.zeros_like(over), where=under > 1e-3)
        ratios.append(share[:, : max(w - width, 0)].sum() / (edge.sum() + 1e-8))
    return [float(np.hypot(*ratios))]


def spectrum_features(r: Region) -> list[float]:
    """Slope of log power over log radius of the image's spectrum, mean removed; 0 for images under 24 pixels."""
    if min(r.w, r.h) // 8 < 3 or np.ptp(r.image) == 0:
        return [0.0]
    median = np.median(r.image)
    image = r.image / median if median else r.image
    side = 1 << (max(r.w, r.h) - 1).bit_length()
    power = np.abs(np.fft.fft2(image - image.mean(), (side, side))) ** 2
    f = np.fft.fftfreq(side) * side
    ring = np.rint(np.hypot(*np.meshgrid(f, f))).astype(np.int64).ravel()
    total = np.bincount(ring, power.ravel())
    most = int(min(r.w, r.h) / 8) * 4
    return [_slope([(float(k), float(total[k])) for k in range(2, min(most, len(total))) if total[k] > 0])]


COMPUTE: dict[str, Callable[..., list[float]]] = {
    "contour": contour_features, "hull": hull_features, "erosion": erosion_features, "fractal": fractal_features, "caliper": caliper_features, "chords": chord_features, "circles": circle_features, "geodetic": geodetic_features, "radius": radius_features,
    "radial": radial_features, "gabor": gabor_features, "zernike": zernike_features, "weighted_moments": lambda r: _weighted(r, np.ones(len(r.x))), "weighted_intensity_moments": lambda r: _weighted(r, r.inten), "sharpness": sharpness_features, "spectrum": spectrum_features,
}


def whole_regions(pixels: DataFrame, groups: Sequence[str], noval: float = 0.0, options: Mapping[str, Mapping] | None = None, small: bool = False) -> DataFrame:
    """The features of the given groups, one row a region, in one pass over all of a region's pixels; what isn't finite is noval. Repeated pixels count once.

    options: further arguments of groups' functions, such as {"gabor": {"n": 20}}. A group's number of features stays the same, but
    for gabor, which has one for each of its pairs. small: regions have few pixels (SMALL), so that Python gets a row for each and many rows at once.
    """
    given = {g: dict((options or {}).get(g, {})) for g in groups}
    named = {g: tuple(f"GABOR_{k}" for k in range(len(given[g]["pairs"]))) if "pairs" in given[g] else GROUPS[g] for g in groups}
    columns = [n for g in groups for n in named[g]]

    def one(key: tuple, table: pa.Table) -> pa.Table:
        region = Region(*(table.column(c).to_numpy() for c in ("x", "y", "inten")))
        values = [float(v) for g in groups for v in COMPUTE[g](region, **given[g])]
        return pa.table({**{k: [v.as_py()] for k, v in zip(KEYS, key, strict=True)}, **{n: [v if math.isfinite(v) else noval] for n, v in zip(columns, values, strict=True)}})

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, places = lists.offsets.to_numpy(), [c.to_numpy() for c in lists.values.flatten()]
            values = np.empty((len(batch), len(columns)))
            for row, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                region = Region(*(c[a:b] for c in places))
                values[row] = [v for g in groups for v in COMPUTE[g](region, **given[g])]
            values[~np.isfinite(values)] = noval
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(v) for v in values.T)], names=[*KEYS, *columns])

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in KEYS), *(f"`{n}` double" for n in columns)])
    if small:
        return pixels.groupBy(*KEYS).agg(F.collect_list(F.struct("x", "y", "inten")).alias("places")).mapInArrow(many, schema)
    return pixels.select(*KEYS, "x", "y", "inten").groupBy(*KEYS).applyInArrow(one, schema)


POLYGONS = ("POLYGONALITY_AVE", "HEXAGONALITY_AVE", "HEXAGONALITY_STDDEV")


def polygon_scores(neighbours: float, perimeter: float, area: float, hull_area: float, feret_min: float, feret_max: float) -> tuple[float, float, float]:
    """Likeness to a polygon of as many sides as neighbours, and to a regular hexagon: 10 at best; no value under 3 neighbours.

    The hexagon score compares all areas (and perimeters) that a regular hexagon would have by each measure at hand.
    """
    if neighbours < 3 or not (perimeter and area and feret_min and feret_max and hull_area):
        return 0.0, 0.0, 0.0
    side, tangent = perimeter / neighbours, math.tan(math.pi / neighbours)
    agree = lambda a, b: 1 - abs(1 - a / b)
    polygon = 5 * (agree(side, math.sqrt(4 * area * tangent / neighbours)) + agree(area, neighbours * side * side / (4 * tangent)))
    root = math.sqrt(3)
    hull_side = math.sqrt(hull_area / (1.5 * root))
    # a regular hexagon's side by perimeter, greatest and least diameter, and hull; and its apothem by the first three
    sides = (perimeter / 6, feret_max / 2, feret_min / root, hull_side)
    apothems = (root * sides[0] / 2, root * sides[1] / 2, feret_min / 2)
    areas = [*(1.5 * root * s * s for s in sides[:3]), 3 * sides[0] * apothems[1], 3 * sides[0] * apothems[2], 3 * sides[1] * apothems[2], *(3 * hull_side * a for a in apothems), hull_area, area]
    hull_apothems = (root * hull_side / 2, math.sqrt(4 * hull_area / (4.5 * root)))
    perimeters = [math.sqrt(24 * area / root), math.sqrt(24 * hull_area / root), perimeter, 6 * hull_side, 3 * feret_max, 6 * feret_min / root, *(2 * area / a for a in (*apothems, *hull_apothems)), *(2 * hull_area / a for a in apothems)]
    ratios = [np.array([agree(v[i], v[k]) for i in range(len(v)) for k in range(i + 1, len(v))]) for v in (areas, perimeters)]
    return polygon, 5 * (ratios[0].mean() + ratios[1].mean()), math.sqrt((ratios[0].var() + ratios[1].var()) / 2)


def polygonality(neighbours: DataFrame, shapes: DataFrame) -> DataFrame:
    """POLYGONALITY_AVE, HEXAGONALITY_AVE and HEXAGONALITY_STDDEV from neighbour counts and contour, hull and caliper features."""

    def run(batches):
        for b in batches:
            t = b.to_pydict()
            rows = [polygon_scores(*v) for v in zip(t["n"], t["p"], t["a"], t["h"], t["lo"], t["hi"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *(pa.array([float(r[k]) for r in rows]) for k in range(3))], names=[*KEYS, *POLYGONS])

    kinds = {f.name: f.dataType.simpleString() for f in shapes.schema.fields}
    both = shapes.join(neighbours, list(KEYS)).selectExpr(*KEYS, "NUM_NEIGHBORS n", "PERIMETER p", "CONVEX_HULL_AREA * SOLIDITY a", "CONVEX_HULL_AREA h", "STAT_FERET_DIAM_MIN lo", "STAT_FERET_DIAM_MAX hi")
    return both.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in KEYS), *(f"{n} double" for n in POLYGONS)]))
