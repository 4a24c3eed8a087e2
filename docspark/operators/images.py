"""Blank pages from pixels, in numpy over Spark's image column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Profile:
    """Thresholds of one sensitivity (fixed values)."""

    base_margin: float
    max_border: float
    border_occupancy: float
    edge_band: float
    min_contrast: float
    min_background: float
    min_coloured: float
    min_component: float
    rule_lines: int
    blank_ink: float


PROFILES = {
    "safe": Profile(0.02, 0.09, 0.68, 0.045, 28, 235, 225, 1.2e-5, 10_000, 1.0e-4),
    "standard": Profile(0.02, 0.10, 0.45, 0.075, 21, 215, 185, 2.0e-5, 12, 2.0e-4),
    "aggressive": Profile(0.02, 0.12, 0.30, 0.105, 15, 175, 145, 3.2e-5, 5, 3.5e-4),
}


#: By how much a scanner's band is darker than the page (fixed values).
DARKER, MUCH_DARKER = 24.0, 35.0
#: Other names of the sensitivities (fixed values).
ALIASES = {"an toàn": "safe", "an toan": "safe", "chuẩn": "standard", "chuan": "standard", "mạnh mẽ": "aggressive", "manh me": "aggressive", "mạnh": "aggressive", "manh": "aggressive"}


def sensitivity_name(name: str | None) -> str:
    """The profile of a name, its case and white space aside; safe if there is none, an error if it is unknown."""
    given = (name or "safe").strip().casefold()
    found = ALIASES.get(given, given)
    if found not in PROFILES:
        raise ValueError(f"no sensitivity {name!r}; there are {', '.join(PROFILES)}")
    return found


def decode(data: bytes | None, height: int, width: int, channels: int) -> np.ndarray | None:
    """Grey and colour planes of Spark's image struct (rows of BGR or grey bytes); None if they don't fit."""
    if not data or height <= 0 or width <= 0 or channels not in (1, 3, 4) or len(data) != height * width * channels:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., :3].astype(np.float32)


def shrink(pixels: np.ndarray, most: int = 1600) -> np.ndarray:
    """At most `most` pixels a side, by means of whole blocks; never enlarged."""
    k = -(-max(pixels.shape[:2]) // most)
    if k <= 1:
        return pixels
    h, w = pixels.shape[0] // k * k, pixels.shape[1] // k * k
    return pixels[:h, :w].reshape(h // k, k, w // k, k, -1).mean((1, 3))


def box_mean(grey: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the square about each pixel, edges repeated."""
    padded = np.pad(grey, radius + 1, mode="edge").cumsum(0, dtype=np.float64).cumsum(1)
    n = 2 * radius + 1
    return (padded[n:-1, n:-1] - padded[:-n - 1, n:-1] - padded[n:-1, :-n - 1] + padded[:-n - 1, :-n - 1]) / (n * n)


def otsu(values: np.ndarray) -> float:
    """Threshold that parts a histogram of 0..255 with the greatest variance between the parts."""
    counts = np.bincount(np.clip(values, 0, 255).astype(int).ravel(), minlength=256).astype(float)
    below = counts.cumsum()
    mass = (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return float(np.nan_to_num(between).argmax())


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(area, left, top, right, bottom) of the 8-connected parts of a mask, by runs of rows and union-find."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs, before = [], []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].view(np.int8), [0]])))
        now = []
        for a, b in edges.reshape(-1, 2):
            k = len(parent)
            parent.append(k)
            runs.append((y, int(a), int(b), k))
            now.append((int(a), int(b), k))
            for c, d, j in before:
                if c <= b and a <= d:
                    parent[root(k)] = root(j)
        before = now
    out: dict[int, list[int]] = {}
    for y, a, b, k in runs:
        box = out.setdefault(root(k), [0, a, y, b, y + 1])
        box[0] += b - a
        box[1], box[3], box[4] = min(box[1], a), max(box[3], b), y + 1
    return [tuple(v) for v in out.values()]


def _band(lines: np.ndarray, background: float, most: int, p: Profile) -> int:
    """Depth of a scanner's dark band at the first of some pixel lines; it ends before two lines in a row that aren't dark.

    A line is dark if a share of it, by the profile, is darker than the background
    by DARKER, or if its median is by MUCH_DARKER.
    """
    part = lines[: max(most, 0)]
    if not part.size:
        return 0
    dark = ((part < np.clip(background - DARKER, 0, 220)).mean(1) >= p.border_occupancy) | (np.median(part, axis=1) <= background - MUCH_DARKER)
    light = ~dark
    ends = np.flatnonzero(light & np.concatenate([light[1:], [False]]))
    inside = dark[: ends[0]] if len(ends) else dark
    return int(np.flatnonzero(inside)[-1]) + 1 if dark[0] else 0


def crop_borders(grey: np.ndarray, p: Profile) -> tuple[slice, slice]:
    """The page without its margin and the dark bands of a scanner along its edges; bands of a quarter or more in all aren't ones."""
    background = float(np.percentile(grey, 90))
    cut = []
    for lines in (grey, grey.T):
        n = len(lines)
        margin, most = max(1, int(n * p.base_margin)), max(1, int(n * p.max_border))
        first, last = (max(margin, _band(x, background, most, p)) for x in (lines, lines[::-1]))
        if first + last >= 0.25 * n:
            first = last = margin
        cut.append(slice(first, n - last))
    return cut[0], cut[1]


def drop_rules(mask: np.ndarray, p: Profile) -> np.ndarray:
    """Without the ruled lines of a page that has as many as a profile wants: thin rows or columns that are mostly ink."""
    out = mask
    for axis in (1, 0):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (out.mean(axis) >= 0.5).view(np.int8), [0]]))).reshape(-1, 2)
        thin = [(a, b) for a, b in edges if b - a <= max(3, out.shape[1 - axis] // 200)]
        lined = np.zeros(out.shape[1 - axis], bool)
        for a, b in thin:
            lined[a:b] = True
        if len(thin) >= p.rule_lines:
            out = out.copy()
            out[(lined, slice(None)) if axis == 1 else (slice(None), lined)] = False
    return out


def drop_edges(parts: list, shape: tuple[int, int], p: Profile) -> list:
    """Without specks, holes and folds that lie in the band along an edge, or run the whole page."""
    h, w = shape
    bx, by = p.edge_band * w, p.edge_band * h
    kept = []
    for part in parts:
        _, left, top, right, bottom = part
        edge = right <= bx or left >= w - bx or bottom <= by or top >= h - by
        fold = (right - left >= 0.8 * w and bottom - top <= 0.01 * h) or (bottom - top >= 0.8 * h and right - left <= 0.01 * w)
        if not edge and not fold:
            kept.append(part)
    return kept


def classify(pixels: np.ndarray | None, sensitivity: str = "standard") -> str:
    """blank, content or uncertain; an unreadable image is uncertain."""
    if pixels is None or min(pixels.shape[:2]) < 8:
        return "uncertain"
    p, small = PROFILES[sensitivity_name(sensitivity)], shrink(pixels)
    grey = small.mean(2)
    rows, cols = crop_borders(grey, p)
    grey, colour = grey[rows, cols], small[rows, cols]
    if not grey.size:
        return "uncertain"
    light, chroma = float(np.median(grey)), float(np.median(colour.max(2) - colour.min(2)))
    contrast = np.clip(box_mean(grey, max(5, min(grey.shape) // 85)) - grey, 0, 255)
    mask = drop_rules(contrast > min(max(otsu(contrast), p.min_contrast), 60), p)
    total = grey.size
    parts = drop_edges(components(mask), grey.shape, p)
    good = [x for x in parts if x[0] >= max(30, total * p.min_component) and x[3] - x[1] >= 2 and x[4] - x[2] >= 3]
    large = [x for x in good if x[0] >= max(100, 3 * total * p.min_component)]
    ink = sum(x[0] for x in good) / total
    bright = light >= p.min_background or (chroma >= 8 and light >= p.min_coloured)
    if large or len(good) >= 3 or ink > 0.0025:
        return "content"
    return "blank" if bright and not good and ink <= p.blank_ink else "uncertain"


def classify_plain(pixels: np.ndarray | None) -> str:
    """The histogram rule: nearly all light, hardly any strong ink, little spread."""
    if pixels is None:
        return "uncertain"
    grey = pixels.mean(2)
    if (grey >= 235).mean() >= 0.995 and (grey < 128).mean() <= 0.0002 and grey.std() <= 4:
        return "blank"
    return "content" if (grey < 128).mean() > 0.0025 else "uncertain"


def mask_regions(pixels: np.ndarray, regions: list[tuple[float, float, float, float]]) -> np.ndarray:
    """The page with normalised regions whited out."""
    out, (h, w) = pixels.copy(), pixels.shape[:2]
    for l, t, r, b in regions:  # noqa: E741
        out[int(t * h) : int(np.ceil(b * h)), int(l * w) : int(np.ceil(r * w))] = 255
    return out


def chromatic_regions(pixels: np.ndarray, most: int = 4) -> list[tuple[float, float, float, float]]:
    """Normalised boxes of coloured graphics, those with most ink first."""
    small = shrink(pixels)
    h, w = small.shape[:2]
    mask = ((small.max(2) - small.min(2)) >= 24) & (small.mean(2) < 235)
    wide = box_mean(mask.astype(np.float32), max(2, min(h, w) // 120)) > 0
    boxes = []
    for _, left, top, right, bottom in components(wide):
        ink = int(mask[top:bottom, left:right].sum())
        if right - left >= 0.02 * w and bottom - top >= 0.02 * h and right - left <= 0.6 * w and bottom - top <= 0.6 * h:
            boxes.append((ink, left / w, top / h, right / w, bottom / h))
    return [b[1:] for b in sorted(boxes, reverse=True)[:most]]


def _planes(images: pd.DataFrame) -> list[np.ndarray | None]:
    rows = zip(images["data"], images["height"], images["width"], images["nChannels"], strict=True)
    whole = lambda n: 0 if pd.isna(n) else int(n)
    return [decode(d if isinstance(d, bytes) else None, whole(h), whole(w), whole(c)) for d, h, w, c in rows]


def page_state(image: Column, sensitivity: str = "standard", masked: Column | None = None) -> Column:
    """State of Spark's image column; null is uncertain. masked is an array of normalised boxes (l, t, r, b) that are whited out first."""
    name = sensitivity_name(sensitivity)
    boxes = F.array().cast("array<struct<l:double,t:double,r:double,b:double>>") if masked is None else masked

    @F.pandas_udf(T.StringType())
    def state(images: pd.DataFrame, regions: pd.Series) -> pd.Series:
        out = []
        for pixels, found in zip(_planes(images), regions, strict=True):
            given = [] if found is None else [(x["l"], x["t"], x["r"], x["b"]) for x in found]
            out.append(classify(mask_regions(pixels, given) if pixels is not None and given else pixels, name))
        return pd.Series(out)

    return F.coalesce(state(image, boxes), F.lit("uncertain"))


def graphics(image: Column, most: int = 4) -> Column:
    """Array of normalised boxes (l, t, r, b) of the coloured graphics of Spark's image column, those with most ink first; none of a null or unreadable one."""

    @F.pandas_udf("array<struct<l:double,t:double,r:double,b:double>>")
    def found(images: pd.DataFrame) -> pd.Series:
        return pd.Series([[] if p is None else [dict(zip("ltrb", map(float, x), strict=True)) for x in chromatic_regions(p, most)] for p in _planes(images)])

    return found(image)
