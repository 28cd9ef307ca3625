"""Pixel and detection kernels in numpy, and the column functions that run them over Arrow batches.

Pixels are a struct (width, height, data), data being RGB bytes by row. What needs a trained model is not here: its raw
output, as an array, is decoded by decode_detections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIXELS = "struct<width:int,height:int,data:binary>"
METRICS = "phash long, brightness double, dark_fraction double, bright_fraction double, blur double"


#: Bytes of pixels, read or made, that a worker has in hand at once.
PIECE_BYTES = 16_000_000


def pieces(batch: pd.DataFrame, least: int = 0) -> Iterator[slice]:
    """Slices of a batch of PIXELS of some PIECE_BYTES of data; an image counts as `least` bytes at least."""
    size = np.maximum([0 if d is None else len(d) for d in batch["data"]], least)
    part = (np.cumsum(size) // PIECE_BYTES).astype(np.int64)
    ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(part) else [0]
    for a, b in zip([0, *ends[:-1]], ends):
        yield slice(int(a), int(b))


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of (h, w, 3) bytes in whole numbers (ITU-R 601, 16 bits of fraction)."""
    wide = rgb.astype(np.int64)
    return ((wide[..., 0] * 19595 + wide[..., 1] * 38470 + wide[..., 2] * 7471 + 0x8000) >> 16).astype(np.uint8)


def _lanczos(size: int, wanted: int) -> np.ndarray:
    """(wanted, size) weights of a three-lobed Lanczos filter, widened where the image shrinks."""
    scale = max(1.0, size / wanted)
    centre = (np.arange(wanted) + 0.5) * size / wanted
    at = (np.arange(size)[None] + 0.5 - centre[:, None]) / scale
    weight = np.where(np.abs(at) < 3, np.sinc(at) * np.sinc(at / 3), 0.0)
    return weight / weight.sum(1, keepdims=True)


def resized(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """A plane of bytes at another size: rows first, each pass rounded to bytes."""
    byte = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = byte(plane.astype(float) @ _lanczos(plane.shape[1], width).T)
    return byte(_lanczos(plane.shape[0], height) @ across).astype(np.uint8)


def dct(plane: np.ndarray) -> np.ndarray:
    """The orthonormal two-dimensional DCT of a square plane."""
    n = len(plane)
    k = np.arange(n)
    base = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    base[0] /= np.sqrt(2)
    return base @ plane.astype(float) @ base.T


def phash(plane: np.ndarray) -> int:
    """64 bits in two's complement, the first the highest: low DCT frequencies of the 32 x 32 plane above their median.

    The DCT counts by its unnormalised weights: row and column 0 twice the root of 32, the others the root of 64."""
    weight = np.full(32, 8.0)
    weight[0] = 2.0 * math.sqrt(32.0)
    low = (dct(resized(plane, 32, 32)) * weight[:, None] * weight[None])[:8, :8].astype(np.float32)
    value = int("".join("1" if b else "0" for b in (low > np.median(low)).reshape(-1)), 2)
    return value - (1 << 64) if value >> 63 else value


def exposure(plane: np.ndarray) -> tuple[float, float, float]:
    """Mean brightness, share below 20 and share above 235."""
    return (float(plane.mean()), float((plane < 20).mean()), float((plane > 235).mean())) if plane.size else (0.0, 0.0, 0.0)


def sharpness(plane: np.ndarray) -> float:
    """Variance of the Laplacian, the plane mirrored at its edges without the edge itself."""
    if not plane.size:
        return 0.0
    wide = np.pad(plane.astype(float), 1, mode="reflect" if min(plane.shape) > 1 else "edge")
    return float((wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * wide[1:-1, 1:-1]).var())


def rescaled(x: float, y: float, old: tuple[int, int], new: tuple[int, int]) -> tuple[int, int]:
    """a point of the image at size `new` in the image of size `old`, inside it, rounded half to even."""
    return tuple(int(np.round(np.clip(v / n * o, 0, o))) for v, o, n in zip((x, y), old, new))


def non_maximum(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """indexes of boxes by falling score that overlap no kept box by more than threshold; whole pixels count."""
    size = (boxes[:, 2] - boxes[:, 0] + 1) * (boxes[:, 3] - boxes[:, 1] + 1)
    left, kept = scores.argsort(kind="stable")[::-1], []
    while len(left):
        best, left = left[0], left[1:]
        kept.append(int(best))
        corner = np.minimum(boxes[best, 2:], boxes[left, 2:]) - np.maximum(boxes[best, :2], boxes[left, :2]) + 1
        both = np.prod(np.maximum(0.0, corner), 1)
        left = left[both / (size[best] + size[left] - both) <= threshold]
    return kept


def decode_detections(output: np.ndarray, labels: list[str], least: float, overlap: float, old: tuple[int, int], new: tuple[int, int]) -> list[tuple[tuple[int, int, int, int], str, float]]:
    """(box in the image of size `old`, label, score) from a detector's output for the image at size `new`.

    Either rows of (x0, y0, x1, y1, score, class), or columns of (centre x, centre y, width, height, score of each label)."""
    if output.shape[-1] == 6:
        rows = output[output[:, 4] > least]
        boxes, scores, kinds = rows[:, :4], rows[:, 4], rows[:, 5].astype(int)
    elif output.shape[0] == 4 + len(labels):
        columns = output[:, output[4:].max(0) > least].T
        half = columns[:, 2:4] / 2
        boxes = np.concatenate([columns[:, :2] - half, columns[:, :2] + half], 1)
        scores, kinds = columns[:, 4:].max(1, initial=0), columns[:, 4:].argmax(1) if len(columns) else np.zeros(0, int)
    else:
        raise ValueError(f"an output of shape {output.shape} for {len(labels)} labels")
    found = []
    for k in non_maximum(boxes, scores, overlap):
        box = (*rescaled(boxes[k, 0], boxes[k, 1], old, new), *rescaled(boxes[k, 2], boxes[k, 3], old, new))
        found.append((box, labels[kinds[k]], float(scores[k])))
    return found


def metrics(pixels: Column) -> Column:
    """X1's part that needs no model: METRICS of a struct of pixels; null for null and for data of another length."""

    @F.pandas_udf(METRICS)
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w, h, data in zip(batch["width"], batch["height"], batch["data"]):
            if data is None or pd.isna(w) or pd.isna(h) or w * h < 1 or len(data) != 3 * int(w) * int(h):
                out.append((None,) * 5)
                continue
            plane = gray(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3))
            out.append((phash(plane), *exposure(plane), sharpness(plane)))
        columns = [c.split()[0] for c in METRICS.split(", ")]
        return pd.DataFrame(out, columns=columns).astype({"phash": object}) if any(r[0] is None for r in out) else pd.DataFrame(out, columns=columns)

    return run(pixels)
