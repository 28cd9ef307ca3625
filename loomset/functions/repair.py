"""Masks of text regions, and repair of what they cover from what is around them.

Repair marches from the edge of the mask inwards, nearest pixels first (Sethian's fast marching): a pixel's time is the
distance from the edge, found from two known neighbours by the eikonal equation. A pixel then gets the weighted mean of the
known ones around it, after Telea: those count more that lie along the direction of the march, near, and at a like time, and
each adds its own gradient. The other method weighs those more that lie along the isophote through them, and adds nothing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import PIXELS, pieces
from .regions_of_maps import filled

#: Names of the methods.
TELEA, ISOPHOTES = "telea", "ns"
_FAR = 1e6


def ellipse(reach: int) -> list[tuple[int, int]]:
    """(rows away, columns to either side) of the element of 2 reach + 1 pixels in each direction."""
    return [(d, int(np.rint(math.sqrt(reach * reach - d * d)))) for d in range(-reach, reach + 1)]


def dilated(mask: np.ndarray, reach: int) -> np.ndarray:
    if reach <= 0 or not mask.any():
        return mask
    height, width = mask.shape
    out = np.zeros_like(mask)
    for down, across in ellipse(reach):
        if abs(down) >= height:
            continue
        # How many true pixels are at most `across` columns away, from sums along the row.
        total = np.cumsum(np.pad(mask, ((0, 0), (across + 1, across))).astype(np.int32), 1)
        near = total[:, 2 * across + 1 :] - total[:, : width] > 0
        a, b = max(0, down), min(height, height + down)
        out[a:b] |= near[a - down : b - down]
    return out


def mask_of(polygons: list[np.ndarray], width: int, height: int, expand: int) -> np.ndarray:
    """Pixels of any polygon, and those within an ellipse around them."""
    mask = np.zeros((height, width), bool)
    for p in polygons:
        if len(p):
            mask |= filled(p, width, height)
    return dilated(mask, max(0, int(expand)))


def _time(times: np.ndarray, known: np.ndarray, y: int, x: int) -> float:
    """The earliest time of a pixel from its known neighbours: |grad T| = 1."""
    best = _FAR
    for dy in (-1, 1):
        a = times[y + dy, x] if known[y + dy, x] else None
        for dx in (-1, 1):
            b = times[y, x + dx] if known[y, x + dx] else None
            if a is None and b is None:
                continue
            if a is None or b is None or abs(a - b) >= 1:
                t = 1 + min(v for v in (a, b) if v is not None)
            else:
                t = (a + b + math.sqrt(2 - (a - b) ** 2)) / 2
            best = min(best, t)
    return best


def _march(todo: np.ndarray, known: np.ndarray, start: np.ndarray):
    """Pixels of todo in order of their times, from the pixels of start on, which are known and beside them; times and known
    grow as it goes."""
    times, known, heap = np.where(todo, _FAR, 0.0), known.copy(), []

    def near(y: int, x: int) -> None:
        for v, u in ((y - 1, x), (y, x - 1), (y + 1, x), (y, x + 1)):
            if todo[v, u] and not known[v, u]:
                t = _time(times, known, v, u)
                if t < times[v, u]:
                    times[v, u] = t
                    heapq.heappush(heap, (t, v, u))

    for y, x in zip(*np.nonzero(start)):
        near(y, x)
    while heap:
        t, y, x = heapq.heappop(heap)
        if known[y, x]:
            continue
        yield y, x, times, known
        known[y, x] = True
        near(y, x)


def _beside(mask: np.ndarray) -> np.ndarray:
    """Pixels outside a mask that has a border of false ones with a neighbour in it."""
    out = np.zeros_like(mask)
    out[1:-1, 1:-1] = ~mask[1:-1, 1:-1] & (mask[:-2, 1:-1] | mask[2:, 1:-1] | mask[1:-1, :-2] | mask[1:-1, 2:])
    return out


def _outer_times(mask: np.ndarray, inside: np.ndarray, radius: int) -> np.ndarray:
    """Of pixels outside the mask, up to some distance, minus their distance from it: the march the other way."""
    out = np.zeros(mask.shape)
    todo = inside & ~mask
    for y, x, times, _ in _march(todo, mask, mask & _beside(todo)):
        if times[y, x] > 2 * radius + 1:
            break
        out[y, x] = 1 - times[y, x]
    return out


def _slope(values: np.ndarray, known: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient (down, across) of values at pixels, from those neighbours that are known: both, else one, else nothing."""

    def one(a: tuple, b: tuple) -> np.ndarray:
        ka, kb = known[a], known[b]
        if values.ndim == 3:
            ka, kb = ka[:, None], kb[:, None]
        here = values[ys, xs]
        return np.where(ka & kb, (values[b] - values[a]) / 2, np.where(kb, values[b] - here, np.where(ka, here - values[a], 0.0)))

    return one((ys - 1, xs), (ys + 1, xs)), one((ys, xs - 1), (ys, xs + 1))


def _window(mask: np.ndarray, radius: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(first row, first column, mask, pixels of the image) of the surroundings that a repair can look at; none of the image's
    pixels lies on the window's border."""
    reach = 2 * radius + 5
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    y0, y1, x0, x1 = int(ys[0]), int(ys[-1]) + 1, int(xs[0]), int(xs[-1]) + 1
    room = [min(reach - 1, d) for d in (y0, mask.shape[0] - y1, x0, mask.shape[1] - x1)]
    todo = np.pad(mask[y0:y1, x0:x1], reach)
    inside = np.zeros_like(todo)
    inside[reach - room[0] : reach + y1 - y0 + room[1], reach - room[2] : reach + x1 - x0 + room[3]] = True
    return y0 - reach, x0 - reach, todo, inside


def _steps(todo: np.ndarray, inside: np.ndarray, radius: int, method: str):
    """What is done to a window, pixel by pixel, of which nothing depends on the image: (pixel, known ones around it, of each way
    of the gradient the pixels whose difference counts and how much, rows and columns away, their square, weights). Pixels are places
    in the window row by row."""
    edge, wide = radius + 2, todo.shape[1]
    outer = _outer_times(todo, inside, radius)
    down, across = (d.ravel() for d in np.mgrid[-radius : radius + 1, -radius : radius + 1])
    ring = (down**2 + across**2 <= radius**2) & ((down != 0) | (across != 0))
    down, across = down[ring], across[ring]
    far2 = (down**2 + across**2).astype(float)
    for y, x, times, known in _march(todo, inside & ~todo, inside & _beside(todo)):
        ys, xs = y + down, x + across
        use = known[ys, xs] & inside[ys, xs]
        ys, xs, d2 = ys[use], xs[use], far2[use]
        if not len(ys):
            continue
        ry, rx = (y - ys).astype(float), (x - xs).astype(float)
        at, w = ys * wide + xs, None
        valid = (known & inside).ravel()
        slopes = []
        for step in (wide, 1):
            low, high = valid[at - step], valid[at + step]
            slopes += [np.where(high, at + step, at), np.where(low, at - step, at), np.where(low & high, 0.5, 1.0)[:, None]]
        if method == TELEA:
            window = slice(y - edge, y + edge + 1), slice(x - edge, x + edge + 1)
            t = np.where(todo[window], times[window], outer[window])
            gy, gx = _slope(t, known[window] | (t < _FAR), np.array([edge]), np.array([edge]))
            turn = np.abs(ry * gy[0] + rx * gx[0]) / np.sqrt(d2)
            turn[turn < 0.01] = 1e-6
            w = turn / (d2 * (1 + np.abs(t[ys - y + edge, xs - x + edge] - times[y, x])))
        yield y * wide + x, at, *slopes, ry[:, None], rx[:, None], d2, w


#: Steps of masks of so few pixels are kept for the next image with the same mask.
KEPT_PIXELS = 500


@lru_cache(maxsize=64)
def _kept_steps(todo: bytes, inside: bytes, wide: int, radius: int, method: str) -> list:
    plane = lambda b: np.frombuffer(b, bool).reshape(-1, wide)
    return list(_steps(plane(todo), plane(inside), radius, method))


def _paint(values: np.ndarray, steps: Iterable, method: str) -> None:
    """values (pixels of a window, channels of its images) with the steps' pixels filled in, in all images at once."""
    for pixel, at, top, low, half_y, right, left, half_x, ry, rx, d2, w in steps:
        iy, ix = (values[top] - values[low]) * half_y, (values[right] - values[left]) * half_x
        if method == TELEA:
            value = (w[:, None] * (values[at] + iy * ry + ix * rx)).sum(0) / w.sum()
        else:
            steep = np.sqrt(iy**2 + ix**2) * np.sqrt(d2)[:, None]
            along = np.where(steep > 0, np.abs(ry * -ix + rx * iy) / np.where(steep > 0, steep, 1), 0.0)
            w = np.maximum(along, 1e-6) / (d2[:, None] + 1)
            value = (w * values[at]).sum(0) / w.sum(0)
        values[pixel] = np.clip(np.floor(value + 0.5), 0, 255)


def repaired_alike(images: list[np.ndarray], masks: list[np.ndarray], radius: int, method: str = TELEA) -> list[np.ndarray]:
    """Images (height, width, channels) of bytes with the pixels of their masks filled in; those whose masks have the same
    surroundings go together. An empty mask gives a copy; where all pixels are in the mask there is nothing to go by, and a copy comes back too."""
    radius, out = max(1, int(radius)), [image.copy() for image in images]
    alike: dict[tuple, list] = {}
    for k, mask in enumerate(masks):
        if mask.any() and not mask.all():
            y, x, todo, inside = _window(mask, radius)
            alike.setdefault((todo.tobytes(), inside.tobytes(), todo.shape, out[k].shape[2]), []).append((k, y, x))
    for (todo, inside, shape, channels), own in alike.items():
        own_todo, own_inside = (np.frombuffer(b, bool).reshape(shape) for b in (todo, inside))
        ys, xs = np.nonzero(own_inside)
        py, px = np.nonzero(own_todo)
        few = len(py) <= KEPT_PIXELS
        steps = _kept_steps(todo, inside, shape[1], radius, method) if few else None
        most = max(1, 1_000_000 // (own_todo.size * channels))
        for part in (own[j : j + most] for j in range(0, len(own), most)):
            values = np.zeros((own_todo.size, len(part), channels))
            for j, (k, y, x) in enumerate(part):
                values[ys * shape[1] + xs, j] = out[k][ys + y, xs + x]
            _paint(values.reshape(own_todo.size, -1), steps if few else _steps(own_todo, own_inside, radius, method), method)
            for j, (k, y, x) in enumerate(part):
                out[k][py + y, px + x] = values[py * shape[1] + px, j]
    return out


def repaired(image: np.ndarray, mask: np.ndarray, radius: int, method: str = TELEA) -> np.ndarray:
    """repaired_alike of one image."""
    return repaired_alike([image], [mask], radius, method)[0]


@lru_cache(maxsize=256)
def _small_mask(polygons: tuple, width: int, height: int, expand: int) -> np.ndarray:
    return mask_of([np.array(p, np.int64) for p in polygons], width, height, expand)


def repair(pixels: Column, polygons: Column, expand: int = 2, radius: int = 3, method: str = TELEA) -> Column:
    """X10 over pixels and an array of polygons (arrays of [x, y]): the pixels with what the polygons cover filled in.

    Null for null pixels and for data of another length; no polygons, or none that covers a pixel, give the pixels back."""

    def masked(w: int, h: int, cover) -> np.ndarray:
        own = tuple(tuple(map(tuple, poly)) for poly in (cover if cover is not None else []) if poly is not None and len(poly))
        return _small_mask(own, w, h, expand) if w * h <= 16384 else mask_of([np.array(p, np.int64) for p in own], w, h, expand)

    def fixed(batch: pd.DataFrame, covers: pd.Series) -> pd.DataFrame:
        out, places, images, masks = [], [], [], []
        for w, h, data, cover in zip(batch["width"], batch["height"], batch["data"], covers):
            if data is None or pd.isna(w) or pd.isna(h) or w * h < 1 or len(data) != 3 * int(w) * int(h):
                out.append((None, None, None))
                continue
            w, h = int(w), int(h)
            mask = masked(w, h, cover)
            if mask.any():
                places.append(len(out))
                images.append(np.frombuffer(data, np.uint8).reshape(h, w, 3))
                masks.append(mask)
            out.append((w, h, data))
        for k, image in zip(places, repaired_alike(images, masks, radius, method)):
            out[k] = (*out[k][:2], image.tobytes())
        return pd.DataFrame(out, columns=["width", "height", "data"]).astype({"width": "Int32", "height": "Int32"})

    @F.pandas_udf(PIXELS)
    def run(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, covers in batches:
            for part in pieces(batch):
                yield fixed(batch[part], covers[part])

    return run(pixels, polygons)


def _united(group: np.ndarray, first: np.ndarray, last: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (group, first, last) in order, those that overlap or touch made one; columns are below wide."""
    start, end = group * (wide + 1) + first, group * (wide + 1) + last
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1] + 1)) if len(start) else order
    group, end = group[order][new], end[np.append(new[1:], len(start)) - 1] if len(new) else end
    return group, start[new] - group * (wide + 1), end - group * (wide + 1)


def masked_rows(image: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray, widths: np.ndarray, heights: np.ndarray, expand: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, pixels) of each row that the masks of many images cover, as mask_of has them. Points x, y are of polygons
    `of`, which lie together and are numbered in order; image names each polygon's. Masks are runs of pixels, not planes."""
    wide, high = int(widths.max(initial=1)), int(heights.max(initial=1))
    ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else np.zeros(0, np.int64)
    follow = np.arange(1, len(of) + 1)
    follow[ends] = np.append(0, ends[:-1] + 1)[: len(ends)]
    bx, by, own = x[follow], y[follow], image[of]
    counted = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    # Sides: a level one is a run, of another each step is a pixel.
    level = by == y
    steps = np.maximum(np.abs(bx - x), np.abs(by - y))
    side, t = counted(np.where(level, 1, steps + 1))
    on, n = level[side], np.maximum(steps, 1)[side]
    step = lambda a, b: a[side] + np.floor_divide(2 * t * (b - a)[side] + n, 2 * n)
    along = step(x, bx)
    runs = [(own[side], step(y, by), np.where(on, np.minimum(x, bx)[side], along), np.where(on, np.maximum(x, bx)[side], along))]
    # Inside by the even-odd rule: crossings of a polygon and row in order, two by two.
    top, below = np.maximum(0, np.minimum(y, by)), np.minimum(heights[own], np.maximum(y, by))
    side, t = counted(np.maximum(0, below - top))
    row = top[side] + t
    at = x[side] + (row - y[side]) * (bx - x)[side] / (by - y)[side]
    order = np.lexsort((at, row, of[side]))
    side, row, at = side[order], row[order], at[order]
    runs.append((own[side[::2]], row[::2], np.ceil(at[::2] - 1e-9).astype(np.int64), np.floor(at[1::2] + 1e-9).astype(np.int64)))

    def clipped(who, row, first, last):
        first, last = np.maximum(first, 0), np.minimum(last, widths[who] - 1)
        use = (first <= last) & (row >= 0) & (row < heights[who])
        return who[use], row[use], first[use], last[use]

    who, row, first, last = clipped(*(np.concatenate(c) for c in zip(*runs)))
    group, first, last = _united(who * high + row, first, last, wide)
    if expand > 0:
        who, row = np.divmod(group, high)
        away, across = (np.array(c) for c in zip(*ellipse(expand)))
        spread = lambda v, d: (v[:, None] + d).ravel()
        who, row, first, last = clipped(np.repeat(who, len(away)), spread(row, away), spread(first, -across), spread(last, across))
        group, first, last = _united(who * high + row, first, last, wide)
    rows = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
    return *np.divmod(group[rows], high), np.add.reduceat(last - first + 1, rows) if len(rows) else rows


#: Pixels of sides and rows around them that are in hand at once.
MASK_WORK = 1_000_000


def masked_pixels(polygons: Column, width: Column, height: Column, expand: int = 0) -> Column:
    """The rows of the image that a mask covers, in order, with how many pixels of each; null for null."""
    reach = max(0, int(expand))

    @F.arrow_udf("array<struct<row:int,n:int>>")
    def run(covers: pa.Array, ws: pa.Array, hs: pa.Array) -> pa.Array:
        good = pc.and_(pc.and_(covers.is_valid(), ws.is_valid()), hs.is_valid()).to_numpy(zero_copy_only=False)
        widths, heights = (np.maximum(0, c.fill_null(0).to_numpy().astype(np.int64)) for c in (ws, hs))
        image = np.repeat(np.arange(len(covers)), pc.list_value_length(covers).fill_null(0).to_numpy())
        own = covers.flatten()
        many = pc.list_value_length(own).fill_null(0).to_numpy()
        points = own.flatten()
        x, y = (pc.list_element(points, k).to_numpy().astype(np.int64) for k in (0, 1))
        of = np.repeat(np.arange(len(image)), many)
        work = np.ones(len(covers))
        if len(of):
            near = np.append(of[1:] == of[:-1], False)
            work += np.bincount(image[of], np.maximum(np.abs(np.roll(x, -1) - x), np.abs(np.roll(y, -1) - y)) * near * 2 + 2 * reach, len(covers))
        part = (np.cumsum(work * (2 * reach + 1)) // MASK_WORK).astype(np.int64)
        out, places = [], np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for a, b in zip(places, [*places[1:], len(part)]):
            p, q = np.searchsorted(image, [a, b])
            u, v = np.searchsorted(of, [p, q])
            found = masked_rows(image[p:q] - a, of[u:v] - p, x[u:v], y[u:v], widths[a:b], heights[a:b], reach)
            out.append((found[0] + a, *found[1:]))
        who, row, n = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        offsets = pa.array(np.searchsorted(who, np.arange(len(covers) + 1)), pa.int32(), mask=np.append(~good, False))
        values = pa.StructArray.from_arrays([pa.array(row, pa.int32()), pa.array(n, pa.int32())], ["row", "n"])
        return pa.ListArray.from_arrays(offsets, values)

    return run(polygons, width, height)
