"""Image kernels as plain numpy functions on 2-D arrays; none of them knows Spark."""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Fixed values of the assay: smallest component, cell diameter, seed and diameter rules.
MIN_PIXELS, DIAMETER = 4, 10.0
SEED_SHARE, SPACING_SHARE, LEAST_DIAMETER, MOST_DIAMETER = 0.25, 0.55, 0.7, 1.3
#: Squared distance where there is no background at all (fixed value).
FAR = 1e15
#: Mean and deviation of the colour channels of the standard image set (fixed values).
IMAGE_MEAN, IMAGE_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
_NEAR = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def neighbour_max(field: np.ndarray, outside: float) -> np.ndarray:
    """I8: the largest value among each pixel's eight neighbours; `outside` beyond the border."""
    padded = np.pad(field, 1, constant_values=outside)
    h, w = field.shape
    return np.max([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in _NEAR], axis=0)


def otsu(values: np.ndarray) -> float | None:
    """Threshold on values scaled to 0..255, rounded half away; the first largest between-class variance; None for a constant."""
    flat = np.asarray(values, np.float64).ravel()
    flat = flat[np.isfinite(flat)]
    if not len(flat) or flat.max() <= flat.min():
        return None
    low, high = flat.min(), flat.max()
    level = np.clip(np.floor((flat - low) * (255.0 / (high - low)) + 0.5), 0, 255).astype(np.int64)
    best = _first_split(np.bincount(level, minlength=256).astype(np.float64), np.arange(256.0))
    return float(low + best / 255.0 * (high - low))


def _first_split(counts: np.ndarray, places: np.ndarray) -> float:
    weight, mass = np.cumsum(counts), np.cumsum(counts * places)
    rest = weight[-1] - weight
    ok = (weight > 0) & (rest > 0)
    score = np.full(len(counts), -1.0)
    score[ok] = weight[ok] * rest[ok] * (mass[ok] / weight[ok] - (mass[-1] - mass[ok]) / rest[ok]) ** 2
    top = score.max()
    return float(places[int(np.flatnonzero(score >= top * (1 - 1e-12))[0])]) if top >= 0 else float(places[0])


def otsu_by_centres(image: np.ndarray, bins: int = 256) -> float:
    """Threshold at a bin centre; the constant itself for a constant image."""
    flat = np.asarray(image, np.float64).ravel()
    flat = flat[np.isfinite(flat)]
    if not len(flat):
        raise ValueError("no finite pixel")
    if flat.min() == flat.max():
        return float(flat.min())
    counts, edges = np.histogram(flat, bins, (flat.min(), flat.max()))
    return _first_split(counts.astype(np.float64), (edges[:-1] + edges[1:]) / 2)


def minority(image: np.ndarray) -> np.ndarray:
    """I4: the rarer side of the Otsu threshold, above where both are equal; nothing for a constant."""
    threshold = otsu(image)
    if threshold is None:
        return np.zeros(image.shape, bool)
    above = image > threshold
    on = int(above.sum())
    if on in (0, above.size):
        return np.zeros(image.shape, bool)
    return above if on <= above.size - on else ~above


def above_scale(image: np.ndarray, threshold: float) -> np.ndarray:
    """I5."""
    return np.isfinite(image) & (image > threshold)


def above_sigma(image: np.ndarray, sigmas: float = 6.0) -> np.ndarray:
    """Finite pixels more than `sigmas` population deviations above the mean."""
    good = image[np.isfinite(image)]
    if not good.size or good.std() == 0:
        return np.zeros(image.shape, bool)
    return np.isfinite(image) & (image > good.mean() + sigmas * good.std())


def components(mask: np.ndarray, least: int = MIN_PIXELS) -> np.ndarray:
    """8-connected components numbered in raster order from 1; small ones become 0 and keep their number unused.

    Runs of each row are joined to the runs they touch above.
    """
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        above, end_above = int(first[y - 1]), int(first[y])
        for i in range(int(first[y]), int(first[y + 1])):
            while above < end_above and ends[above] < starts[i]:
                above += 1
            j = above
            while j < end_above and starts[j] <= ends[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                j += 1
    labels = np.zeros((h, w), np.int32)
    number: dict[int, int] = {}
    for i in range(len(rows)):
        labels[rows[i], starts[i] : ends[i]] = number.setdefault(find(i), len(number) + 1)
    return drop_small(labels, least)


def drop_small(labels: np.ndarray, least: int = MIN_PIXELS) -> np.ndarray:
    """Labels of fewer pixels become 0."""
    small = np.bincount(labels.ravel()) < least
    return np.where(small[labels], 0, labels)


def distance(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest pixel off the mask; the border is none. First along columns, then exactly along rows by the lower envelope, vectorised over rows."""
    h, w = mask.shape
    if mask.all():
        return np.full((h, w), math.sqrt(FAR))
    down = np.zeros((h, w))
    run = np.full(w, np.inf)
    for y in range(h):
        run = np.where(mask[y], run + 1, 0.0)
        down[y] = run
    run = np.full(w, np.inf)
    for y in range(h - 1, -1, -1):
        run = np.where(mask[y], run + 1, 0.0)
        down[y] = np.minimum(down[y], run)
    square = np.where(np.isinf(down), FAR, down**2)
    x = np.arange(w)
    apart = ((x[:, None] - x[None, :]) ** 2).astype(np.float64)
    return np.sqrt(np.stack([(square[y][None, :] + apart).min(1) for y in range(h)]))


def seeds(dist: np.ndarray, mask: np.ndarray, spacing: float, least: float) -> list[int]:
    """Flat indices of local maxima, the farthest from background first, none closer than `spacing` to an earlier one."""
    around = neighbour_max(np.where(mask, dist, -np.inf), -np.inf)
    flat = np.flatnonzero((mask & (dist >= least) & (dist >= around)).ravel())
    flat = flat[np.argsort(-dist.ravel()[flat], kind="stable")]
    ys, xs = np.divmod(flat, mask.shape[1])
    kept: list[int] = []
    ky, kx = np.zeros(0), np.zeros(0)
    for i, y, x in zip(flat.tolist(), ys.tolist(), xs.tolist(), strict=True):
        if not len(kept) or ((ky - y) ** 2 + (kx - x) ** 2).min() >= spacing * spacing:
            kept.append(i)
            ky, kx = np.append(ky, y), np.append(kx, x)
    return kept


def watershed(dist: np.ndarray, mask: np.ndarray, starts: list[int]) -> np.ndarray:
    """Floods the mask from the seeds, by distance in whole thousandths, then lower index; a pixel takes its label when it is reached."""
    h, w = mask.shape
    height = np.trunc(dist * 1000).astype(np.int64).ravel().tolist()
    open_ = mask.ravel().tolist()
    labels = [0] * (h * w)
    heap = []
    for k, s in enumerate(starts, 1):
        labels[s] = k
        heap.append((-height[s], s))
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)
        y, x = divmod(i, w)
        for dy, dx in _NEAR:
            if 0 <= y + dy < h and 0 <= x + dx < w:
                j = i + dy * w + dx
                if open_[j] and not labels[j]:
                    labels[j] = labels[i]
                    heapq.heappush(heap, (-height[j], j))
    return np.array(labels, np.int32).reshape(h, w)


def keep_diameter(labels: np.ndarray, diameter: float = DIAMETER) -> np.ndarray:
    """Labels whose equivalent diameter is within 0.7 and 1.3 of a cell's."""
    size = 2 * np.sqrt(np.bincount(labels.ravel()) / math.pi)
    good = (size >= LEAST_DIAMETER * diameter) & (size <= MOST_DIAMETER * diameter)
    return np.where(good[labels], labels, 0)


def split_cells(mask: np.ndarray, diameter: float = DIAMETER) -> np.ndarray:
    """Touching round cells taken apart."""
    if not mask.any():
        return np.zeros(mask.shape, np.int32)
    dist = distance(mask)
    starts = seeds(dist, mask, max(SPACING_SHARE * diameter, 1.0), max(SEED_SHARE * diameter, 1.0))
    return keep_diameter(drop_small(watershed(dist, mask, starts) if starts else components(mask)), diameter)


def count_labels(labels: np.ndarray) -> int:
    """A16."""
    return len(np.unique(labels[labels != 0]))


def engagement(tumor: np.ndarray, engager: np.ndarray, diameter: float = DIAMETER) -> tuple[int, int, int]:
    """Tumour components, split engagers, and engagers with a pixel on or next to a tumour component."""
    cells, others = components(tumor), split_cells(engager, diameter)
    on = cells > 0
    near = on | neighbour_max(on.astype(np.int8), 0).astype(bool)
    return count_labels(cells), count_labels(others), count_labels(np.where(near, others, 0))


def box_mean(image: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square window, the border repeated; from a summed-area table."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    image = np.asarray(image, np.float64)
    if not radius:
        return image
    side = 2 * radius + 1
    table = np.pad(np.pad(image, radius, mode="edge"), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    rows = table[side:] - table[:-side]
    return (rows[:, side:] - rows[:, :-side]) / side**2


def local_deviation(image: np.ndarray, radius: int) -> np.ndarray:
    """I18."""
    image = np.asarray(image, np.float64)
    mean = box_mean(image, radius)
    return np.sqrt(np.maximum(box_mean(image * image, radius) - mean * mean, 0))


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable smoothing to three deviations, the border repeated."""
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    image = np.asarray(image, np.float64)
    if sigma == 0:
        return image
    radius = max(1, math.ceil(3 * sigma))
    weight = np.exp(-(np.arange(-radius, radius + 1.0) ** 2) / (2 * sigma * sigma))
    weight /= weight.sum()
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (radius, radius)
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(image, width, mode="edge"), 2 * radius + 1, axis)
        image = windows @ weight
    return image


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask and the background that no 4-connected path joins to the border; the border's background is grown until it stands still."""
    free = ~np.asarray(mask, bool)
    if free.ndim != 2:
        raise ValueError("a mask has two dimensions")
    outside = np.zeros_like(free)
    outside[[0, -1]], outside[:, [0, -1]] = free[[0, -1]], free[:, [0, -1]]
    while True:
        grown = outside.copy()
        grown[1:] |= outside[:-1]
        grown[:-1] |= outside[1:]
        grown[:, 1:] |= outside[:, :-1]
        grown[:, :-1] |= outside[:, 1:]
        grown &= free
        if (grown == outside).all():
            return ~outside
        outside = grown


def segment(frame: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """A cell's mask in brightfield."""
    smooth = gaussian(local_deviation(frame, radius), sigma)
    return fill_holes(smooth > otsu_by_centres(smooth))


def masked_signal(brightfield: np.ndarray, stain: np.ndarray) -> float:
    """Stain inside the cell less its area times the median outside; 0 without a cell."""
    mask = segment(brightfield)
    area = int(mask.sum())
    if not area:
        return 0.0
    background = float(np.median(stain[~mask])) if area < mask.size else 0.0
    return float(stain[mask].sum() - area * background)


def contrast_rgb(image: np.ndarray, limits: tuple[float, float] | None = None, floor: float | None = None) -> np.ndarray:
    """An 8-bit colour image between the 1 and 99 % quantiles or given limits, truncated; a flat image is black.

    With `floor` the range is at least that wide (the movie form) and pixels must be finite.
    """
    image = np.asarray(image, np.float64)
    if floor is not None and not np.isfinite(image).all():
        raise ValueError("pixels must be finite")
    low, high = limits or np.percentile(image, [1, 99])
    span = high - low if floor is None else max(high - low, floor)
    gray = np.zeros(image.shape, np.uint8) if span <= 0 else (np.clip((image - low) / span, 0, 1) * 255).astype(np.uint8)
    return np.repeat(gray[..., None], 3, axis=2)


def _bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize by linear weights around pixel centres, the border repeated."""

    def weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, None)
        low = np.minimum(at.astype(int), n - 1)
        return low, np.minimum(low + 1, n - 1), at - low

    a, b, f = weights(image.shape[0], height)
    rows = image[a] * (1 - f)[:, None] + image[b] * f[:, None]
    a, b, f = weights(image.shape[1], width)
    return rows[:, a] * (1 - f) + rows[:, b] * f


def _triangle(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize with a triangle filter whose support widens when the image shrinks."""

    def matrix(n: int, m: int) -> np.ndarray:
        scale = max(n / m, 1.0)
        centre = (np.arange(m) + 0.5) * n / m
        w = np.maximum(1 - np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale, 0)
        return w / w.sum(1, keepdims=True)

    return matrix(image.shape[0], height) @ image @ matrix(image.shape[1], width).T


def model_input(image: np.ndarray, side: int = 128) -> np.ndarray:
    """Quantile contrast to 0..1, resized, repeated over three channels (channels first)."""
    image = np.asarray(image, np.float64)
    low, high = np.percentile(image, [1, 99])
    scaled = np.zeros(image.shape) if high <= low else np.clip((image - low) / (high - low), 0, 1)
    return np.repeat(_bilinear(scaled, side, side)[None], 3, axis=0).astype(np.float32)


def network_input(image: np.ndarray, side: int = 224) -> np.ndarray:
    """Full range to 8 bits, resized, standardised per colour channel (channels first); flat images are 0 before that."""
    image = np.asarray(image, np.float64)
    span = image.max() - image.min()
    gray = np.zeros(image.shape) if span <= 0 else np.floor((image - image.min()) / span * 255 + 0.5)
    small = np.floor(_triangle(gray, side, side) + 0.5) / 255
    return np.stack([(small - m) / s for m, s in zip(IMAGE_MEAN, IMAGE_STD, strict=True)]).astype(np.float32)
