"""What the quality models need around them: head angles (X5), faces turned upright (X3), features of natural scenes (X4),
boxes of masks (X8, F15)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import area, pad
from .kernels import PIECE_BYTES, PIXELS, gray, pieces

#: Where eyes, nose and corners of the mouth are in an upright face of 112 by 112 pixels.
UPRIGHT = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
UPRIGHT_SIDE = 112
#: A mask is a subject from here on; pixels around its box; the least share that a crop removes.
LEAST_ALPHA, PADDING, LEAST_REMOVED = 0.10, 32, 0.05
EDGE_WARNING = "subject_mask_touches_source_edge"


# -- head angles


def head_angles(parameters: Column) -> Column:
    """(yaw, pitch, roll) in degrees from the parameters of a face model, whose first twelve are rows of four: a scaled
    rotation and a shift. The third axis is across the first two; at the poles the cosine is held above 10^-6. Null for less than
    eleven parameters, and for rows without a length."""
    row = lambda k: [F.get(parameters, 4 * k + j).cast("double") for j in range(3)]
    a, b = row(0), row(1)
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    unit = lambda v: [F.when(norm(v) > 0, x / norm(v)) for x in v]
    a, b = unit(a), unit(b)
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    yaw = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c[0]))))
    cosine = F.greatest(F.lit(1e-6), F.cos(F.radians(yaw)))
    whole = c[0].isNotNull() & c[1].isNotNull() & c[2].isNotNull()
    return F.when(whole, F.struct(yaw.alias("yaw"), F.degrees(F.atan2(c[1] / cosine, c[2] / cosine)).alias("pitch"), F.degrees(F.atan2(b[0] / cosine, a[0] / cosine)).alias("roll")))


# -- upright faces


def similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The (2, 3) turn, scale and shift of source points to target points with the least squares, by the singular values of
    their covariance; None where all source points are one."""
    a, b = source - source.mean(0), target - target.mean(0)
    spread = (a**2).sum()
    if spread <= 1e-12:
        return None
    u, s, vt = np.linalg.svd(b.T @ a)
    mirror = np.diag([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    turn = u @ mirror @ vt * ((s * np.diag(mirror)).sum() / spread)
    return np.column_stack([turn, target.mean(0) - turn @ source.mean(0)])


def robust_similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The similarity of the points that agree: of those of all pairs the one with the least median of squares, fitted again to
    the points within 2.5 robust standard deviations of it."""
    fits = [m for i, j in combinations(range(len(source)), 2) if (m := similarity(source[[i, j]], target[[i, j]])) is not None]
    if not fits:
        return None
    off = lambda m: ((source @ m[:, :2].T + m[:, 2] - target) ** 2).sum(1)
    best = min(fits, key=lambda m: float(np.median(off(m))))
    sigma = 2.5 * 1.4826 * (1 + 5 / max(1, len(source) - 2)) * math.sqrt(float(np.median(off(best))))
    near = off(best) <= max(sigma, 1e-3) ** 2
    return similarity(source[near], target[near]) if near.sum() > 1 else best


def warped(image: np.ndarray, matrix: np.ndarray, width: int, height: int) -> np.ndarray:
    """(height, width) pixels of an image under a (2, 3) map to them; between pixels linear, outside black."""
    turn = np.linalg.inv(matrix[:, :2])
    y, x = np.mgrid[:height, :width]
    at = (np.stack([x, y], -1) - matrix[:, 2]) @ turn.T
    low = np.floor(at).astype(int)
    part = at - low
    out = np.zeros((height, width, image.shape[2]))
    for dy in (0, 1):
        for dx in (0, 1):
            u, v = low[..., 0] + dx, low[..., 1] + dy
            inside = (u >= 0) & (v >= 0) & (u < image.shape[1]) & (v < image.shape[0])
            weight = np.abs(1 - dx - part[..., 0]) * np.abs(1 - dy - part[..., 1]) * inside
            out += weight[..., None] * image[np.clip(v, 0, image.shape[0] - 1), np.clip(u, 0, image.shape[1] - 1)]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def upright(pixels: Column, points: Column) -> Column:
    """Pixels of a face turned upright by its five points ([x, y] of eyes, nose, corners of the mouth). Null for null, for
    data of another length and for points that fix no turn."""

    def turned(batch: pd.DataFrame, marks: pd.Series) -> pd.DataFrame:
        out = []
        for w, h, data, mark in zip(batch["width"], batch["height"], batch["data"], marks):
            good = data is not None and mark is not None and len(mark) == 5 and not pd.isna(w) and not pd.isna(h) and w * h > 0 and len(data) == 3 * int(w) * int(h)
            fit = robust_similarity(np.array([list(p) for p in mark], float), np.array(UPRIGHT)) if good else None
            if fit is None or abs(np.linalg.det(fit[:, :2])) < 1e-12:
                out.append((None, None, None))
            else:
                out.append((UPRIGHT_SIDE, UPRIGHT_SIDE, warped(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3), fit, UPRIGHT_SIDE, UPRIGHT_SIDE).tobytes()))
        return pd.DataFrame(out, columns=["width", "height", "data"]).astype({"width": "Int32", "height": "Int32"})

    @F.pandas_udf(PIXELS)
    def run(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, marks in batches:
            for part in pieces(batch, 3 * UPRIGHT_SIDE**2):  # what comes out is larger than what goes in
                yield turned(batch[part], marks[part])

    return run(pixels, points)


# -- features of natural scenes


def _blurred(plane: np.ndarray, size: int = 7, sigma: float = 7 / 6) -> np.ndarray:
    """The Gaussian mean of each pixel's surroundings, the edge carried on."""
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    wide = np.pad(plane, size // 2, mode="edge")
    rows = sum(k[j] * wide[:, j : j + plane.shape[1]] for j in range(size))
    return sum(k[j] * rows[j : j + plane.shape[0]] for j in range(size))


def contrasts(plane: np.ndarray) -> np.ndarray:
    """Each pixel less the local mean, by the local deviation."""
    mean = _blurred(plane)
    return (plane - mean) / (np.sqrt(np.abs(_blurred(plane * plane) - mean * mean)) + 1 / 255)


_GAMMAS = np.arange(0.2, 10.0005, 0.001)
_RATIOS = np.array([math.exp(2 * math.lgamma(2 / g) - math.lgamma(1 / g) - math.lgamma(3 / g)) for g in _GAMMAS])


def _shape(ratio: float) -> float:
    """The shape whose ratio of squared mean to variance is nearest; ratios grow with shapes."""
    k = int(np.searchsorted(_RATIOS, ratio))
    near = [j for j in (k - 1, k) if 0 <= j < len(_RATIOS)]
    return float(_GAMMAS[min(near, key=lambda j: abs(_RATIOS[j] - ratio))])


def symmetric_fit(x: np.ndarray) -> tuple[float, float]:
    """(shape, variance) of a generalised Gaussian with the moments of x; zeros where all are 0."""
    variance = float((x * x).mean())
    return (_shape(float(np.abs(x).mean()) ** 2 / variance), variance) if variance > 0 else (0.0, 0.0)


def skewed_fit(x: np.ndarray) -> tuple[float, float, float, float]:
    """(shape, mean, variance of the left side, of the right) of an asymmetric generalised Gaussian with the moments of x."""
    side = lambda part: float((part * part).mean()) if len(part) else 0.0
    left, right = side(x[x < 0]), side(x[x > 0])
    square = float((x * x).mean())
    if square <= 0:
        return 0.0, 0.0, 0.0, 0.0
    g = math.sqrt(left) / math.sqrt(right) if right > 0 else 1e3
    shape = _shape(float(np.abs(x).mean()) ** 2 / square * (g**3 + 1) * (g + 1) / (g * g + 1) ** 2)
    scale = math.exp(0.5 * (math.lgamma(1 / shape) - math.lgamma(3 / shape)))
    mean = (math.sqrt(right) - math.sqrt(left)) * scale * math.exp(math.lgamma(2 / shape) - math.lgamma(1 / shape))
    return shape, mean, left, right


def halved(plane: np.ndarray) -> np.ndarray:
    """Half as wide and high, each pixel from the four by four around it by the cubic through them."""
    k = np.array([-0.09375, 0.59375, 0.59375, -0.09375])

    def once(p: np.ndarray) -> np.ndarray:
        n = p.shape[1] // 2
        wide = np.pad(p, ((0, 0), (1, 2)), mode="edge")
        return sum(k[j] * wide[:, j : j + 2 * n : 2] for j in range(4))

    return once(once(plane).T).T


def scene_features(plane: np.ndarray) -> list[float]:
    """The 36 features of a plane of bytes: at its size and at half of it the fit of its contrasts and the fits of the products
    of neighbours across, down and along both diagonals; pairs inside the plane count."""
    out, now = [], plane.astype(float) / 255
    for scale in (0, 1):
        now = halved(now) if scale else now
        if min(now.shape) < 2:
            out += [0.0] * 18
            continue
        c = contrasts(now)
        out += symmetric_fit(c)
        for a, b in ((c[:, :-1], c[:, 1:]), (c[:-1], c[1:]), (c[:-1, :-1], c[1:, 1:]), (c[:-1, 1:], c[1:, :-1])):
            out += skewed_fit((a * b).ravel())
    return out


def natural_scene_features(pixels: Column) -> Column:
    """X4 over pixels; null for null and for data of another length."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.DataFrame) -> pd.Series:
        out = []
        for w, h, data in zip(batch["width"], batch["height"], batch["data"]):
            good = data is not None and not pd.isna(w) and not pd.isna(h) and w * h > 0 and len(data) == 3 * int(w) * int(h)
            out.append(scene_features(gray(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3))) if good else None)
        return pd.Series(out, dtype=object)

    return run(pixels)


# -- boxes of masks


def letterbox(width: int, height: int, side: int) -> tuple[int, int, int, int]:
    """(x, y, width, height) of an image in the middle of a square: the longer side fills it, the other is rounded down."""
    w, h = (max(1, int(side * width / height)), side) if height > width else (side, max(1, int(side * height / width)))
    return (side - w) // 2, (side - h) // 2, w, h


def _resampled(planes: np.ndarray, width: int, height: int) -> np.ndarray:
    """Planes at another size, linear between the middles of their pixels."""

    def once(p: np.ndarray, n: int) -> np.ndarray:
        if p.shape[-1] == n:
            return p
        at = np.clip((np.arange(n) + 0.5) * p.shape[-1] / n - 0.5, 0, p.shape[-1] - 1)
        low = np.minimum(at.astype(int), max(0, p.shape[-1] - 2))
        part = (at - low).astype(np.float32)
        return p[..., low] * (1 - part) + p[..., np.minimum(low + 1, p.shape[-1] - 1)] * part

    return once(once(planes, width).swapaxes(-1, -2), height).swapaxes(-1, -2)


def subject_boxes(squares: np.ndarray, width: int, height: int, least: float = LEAST_ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """The boxes (n, 4) of a model's square masks, floats or bytes, in images of one size; and which have a pixel of the subject."""
    x, y, w, h = letterbox(width, height, squares.shape[-1])
    own = squares[:, y : y + h, x : x + w]
    share = lambda v: v.astype(np.float32) / np.float32(255) if squares.dtype == np.uint8 else v.astype(np.float32)
    if squares.dtype == np.uint8 and (w, h) == (width, height):
        on = own >= int(np.searchsorted(share(np.arange(256, dtype=np.uint8)), np.float32(least))) if least <= 1 else np.zeros(own.shape, bool)
    else:
        on = _resampled(share(own), width, height) >= np.float32(least)
    rows, columns = on.any(2), on.any(1)
    ends = lambda v: (v.argmax(1), v.shape[1] - v[:, ::-1].argmax(1))
    (x0, x1), (y0, y1) = ends(columns), ends(rows)
    return np.stack([x0, y0, x1, y1], 1), rows.any(1)


def subject_box(square: np.ndarray, width: int, height: int, least: float = LEAST_ALPHA) -> list[int] | None:
    """subject_boxes of one mask; None where no pixel is of the subject."""
    boxes, some = subject_boxes(square.astype(np.float32)[None], width, height, least)
    return boxes[0].tolist() if some[0] else None


def mask_box(side: Column, data: Column, width: Column, height: Column, least: float = LEAST_ALPHA) -> Column:
    """The box of a square mask of bytes (255ths) or floats in an image of so many pixels. Masks stay in the workers; those of one
    kind and size go together."""

    @F.arrow_udf("array<int>")
    def run(n: pa.Array, masks: pa.Array, ws: pa.Array, hs: pa.Array) -> pa.Array:
        k, w, h, size = (c.fill_null(-1).to_numpy().astype(np.int64) for c in (n, ws, hs, pc.binary_length(masks)))
        boxes, some = np.zeros((len(k), 4), np.int32), np.zeros(len(k), bool)
        good = np.flatnonzero((k > 0) & (w > 0) & (h > 0) & ((size == k * k) | (size == 4 * k * k)))
        kinds, of = np.unique(np.stack([k, w, h, size], 1)[good], axis=0, return_inverse=True)
        for j, (a, b, c, length) in enumerate(kinds.tolist()):
            own, most = good[of == j], max(1, PIECE_BYTES // (4 * max(a * a, b * c)))
            for part in (own[u : u + most] for u in range(0, len(own), most)):
                raw = np.frombuffer(masks.take(pa.array(part)).buffers()[2], np.uint8, len(part) * length)
                squares = raw.reshape(-1, a, a) if length == a * a else raw.view("<f4").reshape(-1, a, a)
                boxes[part], some[part] = subject_boxes(squares, b, c, least)
        offsets = pa.array(np.append(0, np.cumsum(some) * 4), pa.int32(), mask=np.append(~some, False))
        return pa.ListArray.from_arrays(offsets, pa.array(boxes[some].ravel()))

    return run(side, data, width, height)


def proposed_crop(box: Column, width: Column, height: Column, padding: int = PADDING, least_removed: float = LEAST_REMOVED, least: float = LEAST_ALPHA) -> Column:
    """The proposal of a subject's box with all that is stored of it; null without a box, and where too little would go."""
    wide = pad(box, padding, width, height)
    removed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - area(wide).cast("double") / F.greatest(F.lit(1), width * height)))
    touches = (box[0] <= 0) | (box[1] <= 0) | (box[2] >= width) | (box[3] >= height)
    warnings = F.when(touches, F.array(F.lit(EDGE_WARNING))).otherwise(F.array().cast("array<string>"))
    made = F.struct(
        F.lit(2).alias("version"), wide.alias("auto_box"), wide.alias("box"), F.lit("pending").alias("decision"), removed.alias("auto_removed_area_ratio"), removed.alias("removed_area_ratio"), F.lit(least).alias("alpha_min"),
        F.lit(padding).alias("padding_px"), touches.alias("mask_touches_edge"), warnings.alias("warnings"), F.lit(False).alias("manually_adjusted"), F.array(width, height).alias("image_size"),
    )
    return F.when(box.isNotNull() & (removed >= least_removed), made)
