"""Text regions from the probability map of a detector: connected regions, smallest turned rectangles, grown and ordered.

A map is a struct (width, height, data): data has a byte a pixel, which stands for its 255th parts, or four, a little-endian
float. Work goes by runs of pixels in a row, so that a map costs what it has of edges and not what it has of pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pixel is text above LEAST; a region counts from a mean of LEAST_MEAN on; it grows by GROWTH times its area
#: by its length; its shorter side is not below LEAST_SIDE pixels, grown not below two more; at most MOST regions of a map.
LEAST, LEAST_MEAN, GROWTH, LEAST_SIDE, MOST = 0.3, 0.6, 1.5, 3, 1000
#: Fixed value: how far a chord of a rounded corner may be from the arc, in pixels.
CHORD = 0.25
FOUND = "array<struct<poly:array<array<int>>,score:double>>"


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of each run of true pixels, row by row."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def components(row: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, reach: int) -> np.ndarray:
    """The component of each run, named by its first run. Runs of neighbouring rows are one component if they share a column;
    with reach 1 also if their ends touch at a corner."""
    n, wide = len(row), width + 4
    # Of each run those of the row above from the first that doesn't end too early to the last that doesn't begin too late.
    low = np.searchsorted(row * wide + last, (row - 1) * wide + first - reach)
    high = np.searchsorted(row * wide + first, (row - 1) * wide + last + reach, side="right")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), many)
    b = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(a))
    label = np.arange(n)
    while len(a):  # the smaller name of two neighbours spreads, and names of names are followed at once
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def borders(mask: np.ndarray) -> Iterator[np.ndarray]:
    """Points (x, y) that span the outer border of each region, and the borders of its holes; that of which the first
    pixel comes last, row by row, first. Regions touch at corners too, holes along sides only."""
    full, others = _regions(mask)
    found = [((y0, x0), np.array([(x0, y0), (x0, y1), (x1, y0), (x1, y1)])) for x0, y0, x1, y1 in full.tolist()] + others
    for _, points in sorted(found, key=lambda f: f[0], reverse=True):
        yield points


def _regions(mask: np.ndarray) -> tuple[np.ndarray, list[tuple[tuple[int, float], np.ndarray]]]:
    """The first and last pixels (x, y, x, y) of the regions that are upright rectangles without holes; and of the others what
    borders gives, with the place (y, x) of the first pixel."""
    height, width = mask.shape
    row, first, last = runs(mask)
    found, upright = [], np.zeros((0, 4), np.int64)
    label = components(row, first, last, width, 1)
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(label[order]) != 0)) if len(order) else order
    if len(order):
        own_first, own_last = first[order], last[order]
        many = np.diff(np.append(starts, len(order)))
        a, b = np.minimum.reduceat(own_first, starts), np.maximum.reduceat(own_last, starts)
        y0, y1 = row[order[starts]], row[order[starts + many - 1]]
        full = (a == np.maximum.reduceat(own_first, starts)) & (b == np.minimum.reduceat(own_last, starts)) & (y1 - y0 + 1 == many)
        upright = np.stack([a, y0, b, y1], 1)[full]
        for s, n in zip(starts[~full].tolist(), many[~full].tolist()):
            part = order[s : s + n]
            found.append(((int(row[part[0]]), int(first[part[0]])), np.concatenate([np.stack([first[part], row[part]], 1), np.stack([last[part], row[part]], 1)])))
    name = np.zeros(0, np.int64)
    around = np.pad(~mask, 1, constant_values=True)
    r, a, b = runs(around)
    name = components(r, a, b, width + 2, 0)
    inner = np.flatnonzero(name != 0)  # the first run is that of the frame
    if len(inner):
        at = np.searchsorted(row * (width + 4) + first, np.arange(height) * (width + 4))  # the first run of each row
        order = inner[np.argsort(name[inner], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(name[order])) + 1):
            y, x0, x1 = r[part] - 1, a[part] - 1, b[part] - 1
            holder = label[_run_at(row, last, at, int(y[0]), int(x0[0]) - 1)]
            points = [np.stack([x0 - 1, y], 1), np.stack([x1 + 1, y], 1)]
            for k, lo, hi in zip(y.tolist(), x0.tolist(), x1.tolist()):
                for other in (k - 1, k + 1):
                    xs = np.arange(lo, hi + 1)
                    points.append(np.stack([xs[mask[other, lo : hi + 1]], np.full(int(mask[other, lo : hi + 1].sum()), other)], 1))
            edge = np.concatenate(points)
            own = np.array([label[_run_at(row, last, at, int(v), int(u))] == holder for u, v in edge])  # not those of islands in it
            edge = edge[own]
            top = edge[np.lexsort((edge[:, 0], edge[:, 1]))[0]]
            found.append(((int(top[1]), int(top[0]) + 0.5), edge))  # behind an outer border that begins there
    return upright, found


def _run_at(row: np.ndarray, last: np.ndarray, at: np.ndarray, y: int, x: int) -> int:
    """The run that holds a true pixel."""
    end = at[y + 1] if y + 1 < len(at) else len(row)
    return int(at[y] + np.searchsorted(last[at[y] : end], x))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, without points on its sides, in the order of growing angle where y grows upwards."""
    own = np.unique(np.asarray(points, float), axis=0)
    if len(own) < 3:
        return own

    def half(ps: np.ndarray) -> list:
        out: list = []
        for p in ps.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(own) + half(own[::-1]))


def smallest_rectangle(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Corners (4, 2) of the turned rectangle of the smallest area around the points, and its shorter side: one side lies on a
    side of the hull. Of equal ones, the one that is turned least."""
    h = hull(points)
    if len(h) < 3:
        ends = h if len(h) == 2 else np.repeat(h, 2, 0)
        return np.concatenate([ends, ends[::-1]]), 0.0
    side = np.roll(h, -1, 0) - h
    angle = np.unique(np.round(np.arctan2(side[:, 1], side[:, 0]) % (math.pi / 2), 12))
    u = np.stack([np.cos(angle), np.sin(angle)], 1)
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    along, across = h @ u.T, h @ v.T
    lo, hi, bottom, top = along.min(0), along.max(0), across.min(0), across.max(0)
    area = (hi - lo) * (top - bottom)
    k = int(np.flatnonzero(area <= area.min() * (1 + 1e-9))[0])
    corners = np.array([(lo[k], bottom[k]), (hi[k], bottom[k]), (hi[k], top[k]), (lo[k], top[k])])
    return corners @ np.stack([u[k], v[k]]), float(min(hi[k] - lo[k], top[k] - bottom[k]))


def ordered(corners: np.ndarray) -> np.ndarray:
    """the upper of the two leftmost corners, the upper and the lower of the two rightmost, the lower of the leftmost."""
    by_x = corners[np.lexsort((corners[:, 1], corners[:, 0]))]
    left, right = (half[np.argsort(half[:, 1], kind="stable")] for half in (by_x[:2], by_x[2:]))
    return np.stack([left[0], right[0], right[1], left[1]])


def outline(polygon: np.ndarray) -> np.ndarray:
    """Pixels (x, y) on the sides of a polygon of whole numbers: one in each step along the longer way of a side."""
    out = []
    for a, b in zip(polygon, np.roll(polygon, -1, 0)):
        n = int(np.abs(b - a).max())
        t = np.arange(n + 1)
        out.append(a + np.floor_divide(2 * t[:, None] * (b - a) + max(n, 1), 2 * max(n, 1)))
    return np.concatenate(out)


def filled(polygon: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mask of a polygon of whole numbers, clipped to (height, width): pixels inside by the even-odd rule, and its sides."""
    mask = np.zeros((height, width), bool)
    p, q = np.asarray(polygon, np.int64), np.roll(np.asarray(polygon, np.int64), -1, 0)
    edge = outline(p)
    edge = edge[(edge >= 0).all(1) & (edge[:, 0] < width) & (edge[:, 1] < height)]
    mask[edge[:, 1], edge[:, 0]] = True
    for y in range(max(0, int(p[:, 1].min())), min(height - 1, int(p[:, 1].max())) + 1):
        cross = (p[:, 1] <= y) != (q[:, 1] <= y)
        a, b = p[cross], q[cross]
        at = np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
        for x0, x1 in zip(at[::2], at[1::2]):
            mask[y, max(0, math.ceil(x0 - 1e-9)) : max(0, math.floor(x1 + 1e-9) + 1)] = True
    return mask


def mean_inside(plane: np.ndarray, box: np.ndarray) -> float:
    """The mean of a plane inside a box of four corners, which are cut to whole pixels of its surroundings."""
    height, width = plane.shape
    x0, x1 = (int(np.clip(f(box[:, 0]), 0, width - 1)) for f in (lambda v: math.floor(v.min()), lambda v: math.ceil(v.max())))
    y0, y1 = (int(np.clip(f(box[:, 1]), 0, height - 1)) for f in (lambda v: math.floor(v.min()), lambda v: math.ceil(v.max())))
    inside = filled(np.trunc(box - [x0, y0]).astype(np.int64), x1 - x0 + 1, y1 - y0 + 1)
    part = plane[y0 : y1 + 1, x0 : x1 + 1]
    return float(part[inside].mean()) if inside.any() else 0.0


def grown(box: np.ndarray, ratio: float = GROWTH) -> np.ndarray | None:
    """Points around a box of four corners grown on all sides by its area times ratio by its length, with round corners, in
    whole numbers; None of a box without an area."""
    x, y = box[:, 0], box[:, 1]
    area = abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2
    length = float(np.hypot(*(np.roll(box, -1, 0) - box).T).sum())
    if area <= 0 or length <= 0:
        return None
    d = area * ratio / length
    step = 2 * math.acos(max(-1.0, 1 - CHORD / d)) if d > CHORD else math.pi / 2
    core = hull(np.rint(box))
    if len(core) < 3:
        return None
    side = np.roll(core, -1, 0) - core
    angle = np.arctan2(side[:, 1], side[:, 0]) - math.pi / 2  # outward, as the hull turns left
    points = []
    for p, a, b in zip(core, np.roll(angle, 1), angle):
        turn = (b - a) % (2 * math.pi)
        t = a + turn * np.linspace(0, 1, max(2, math.ceil(turn / step) + 1))
        points.append(p + d * np.stack([np.cos(t), np.sin(t)], 1))
    wide = np.concatenate(points)
    return np.sign(wide) * np.floor(np.abs(wide) + 0.5)


@lru_cache(maxsize=65536)
def _grown_upright(x0: int, y0: int, x1: int, y1: int, ratio: float) -> tuple[np.ndarray, bool] | None:
    """The smallest rectangle around an upright one of whole numbers once it is grown, and whether it is upright too; None where a
    side is too short."""
    wide = grown(np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float), ratio)
    if wide is None:
        return None
    box, short = smallest_rectangle(wide)
    return None if short < LEAST_SIDE + 2 else (box, bool(box[0, 1] == box[1, 1] or box[0, 0] == box[1, 0]))


def _grown_boxes(full: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """_grown_upright of many, and which have a box: rectangles of one size that don't reach below 0 grow alike."""
    low, size = full[:, :2], full[:, 2:] - full[:, :2]
    shift = np.maximum(0, low - (3 + np.ceil(max(0.0, ratio) * size.min(1, initial=1 << 30)).astype(np.int64))[:, None])
    kinds, of = np.unique(np.concatenate([low - shift, size], 1), axis=0, return_inverse=True)
    found = [_grown_upright(x, y, x + w, y + h, ratio) for x, y, w, h in kinds.tolist()]
    boxes = np.array([np.zeros((4, 2)) if f is None else f[0] for f in found]).reshape(-1, 4, 2)[of] + shift[:, None]
    good = np.array([f is not None for f in found], bool)[of]
    for k in np.flatnonzero(np.array([f is not None and not f[1] for f in found], bool)[of]):  # turned: as it is, without a shift
        own = _grown_upright(*full[k].tolist(), ratio)
        good[k], boxes[k] = own is not None, 0 if own is None else own[0]
    return boxes, good


@lru_cache(maxsize=65536)
def _mean_of_one(value: float, n: int) -> float:
    return float(np.full(n, value, np.float32).mean())


def decoded(plane: np.ndarray, width: int, height: int, most: int | None = MOST, least: float = LEAST, least_mean: float = LEAST_MEAN, ratio: float = GROWTH) -> tuple[np.ndarray, np.ndarray]:
    """decode as arrays (n, 4, 2) and (n,)."""
    rows, columns = plane.shape
    mask = plane > least
    full, others = _regions(mask)
    place = np.concatenate([full[:, [1, 0]], np.array([f[0] for f in others], float).reshape(-1, 2)])
    boxes, scores, good = np.zeros((len(place), 4, 2)), np.zeros(len(place)), np.zeros(len(place), bool)
    order = np.lexsort((place[:, 1], place[:, 0]))[::-1][:most]
    mine = order[order < len(full)]
    size = full[mine, 2:] - full[mine, :2]
    mine, size = mine[size.min(1, initial=1 << 30) >= LEAST_SIDE], (size + 1).prod(1)[size.min(1, initial=1 << 30) >= LEAST_SIDE]
    if len(mine):
        ink = plane[mask]
        if plane.dtype == np.float32 and ink.min() == ink.max():
            scores[mine] = [_mean_of_one(float(ink[0]), n) for n in size.tolist()]
        else:
            scores[mine] = [plane[y0 : y1 + 1, x0 : x1 + 1].ravel().mean() for x0, y0, x1, y1 in full[mine].tolist()]
        mine = mine[~(scores[mine] < least_mean)]
        boxes[mine], good[mine] = _grown_boxes(full[mine], ratio)
    for k in order[order >= len(full)]:
        box, short = smallest_rectangle(others[k - len(full)][1])
        if short < LEAST_SIDE or (score := mean_inside(plane, box)) < least_mean:
            continue
        wide = grown(box, ratio)
        if wide is None:
            continue
        box, short = smallest_rectangle(wide)
        if short >= LEAST_SIDE + 2:
            boxes[k], scores[k], good[k] = box, score, True
    order = order[good[order]]
    moved, scores = boxes[order], scores[order]
    to = np.round(moved.astype(np.float32) / np.float32([columns, rows]) * np.float32([width, height]))
    own = np.clip(to, 0, [width, height]).astype(np.int64)
    by_x = np.take_along_axis(own, np.lexsort((own[..., 1], own[..., 0]), axis=1)[..., None], 1)
    left, right = (np.take_along_axis(half, np.argsort(half[..., 1], axis=1, kind="stable")[..., None], 1) for half in (by_x[:, :2], by_x[:, 2:]))
    own = np.clip(np.stack([left[:, 0], right[:, 0], right[:, 1], left[:, 1]], 1), 0, [width - 1, height - 1])  # as ordered() has them
    sides = own[:, :1] - own[:, [1, 3]]
    kept = np.hypot(sides[..., 0], sides[..., 1]).astype(np.int64).min(1, initial=1 << 30) > 3
    return own[kept], scores if kept.all() else np.ones(int(kept.sum()))


def decode(plane: np.ndarray, width: int, height: int, most: int | None = MOST, least: float = LEAST, least_mean: float = LEAST_MEAN, ratio: float = GROWTH) -> list[tuple[list[list[int]], float]]:
    """(corners, score) of the text regions of a map in an image of so many pixels; `most`: contours looked at, or all.

    Corners are clipped to the image; regions with a side of at most 3 pixels go, and where one goes all scores are 1."""
    boxes, scores = decoded(plane, width, height, most, least, least_mean, ratio)
    return list(zip(boxes.tolist(), scores.tolist()))


def plane_of(width: int, height: int, data: bytes) -> np.ndarray | None:
    """A map as floats; None where its data have another length."""
    if len(data) == width * height:
        return np.frombuffer(data, np.uint8).reshape(height, width).astype(np.float32) / np.float32(255)
    return np.frombuffer(data, "<f4").reshape(height, width) if len(data) == 4 * width * height else None


def text_regions(probability: Column, width: Column, height: Column, most: int | None = MOST) -> Column:
    """X9 over a struct (width, height, data): the regions in an image of so many pixels. Null for null and for data of another length;
    an empty map has none."""

    @F.arrow_udf(FOUND)
    def run(maps: pa.Array, ws: pa.Array, hs: pa.Array) -> pa.Array:
        widths, heights, data = maps.flatten()
        sizes = zip(*(c.to_pylist() for c in (widths, heights, ws, hs)))
        many, boxes, scores, missing = [], [np.zeros((0, 4, 2), np.int64)], [np.zeros(0)], []
        for k, size in enumerate(sizes):
            plane = None if not data[k].is_valid or None in size else plane_of(*size[:2], data[k].as_buffer())
            box, score = decoded(plane, *size[2:], most) if plane is not None and plane.size else (boxes[0], scores[0])
            missing.append(plane is None)
            many.append(len(score))
            boxes.append(box)
            scores.append(score)
        points = pa.array(np.concatenate(boxes).ravel(), pa.int32())
        listed = lambda values, each: pa.ListArray.from_arrays(pa.array(np.arange(len(values) // each + 1) * each, pa.int32()), values)
        found = pa.StructArray.from_arrays([listed(listed(points, 2), 4), pa.array(np.concatenate(scores))], ["poly", "score"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *many]), pa.int32(), mask=np.array([*missing, False])), found)

    return run(probability, width, height)
