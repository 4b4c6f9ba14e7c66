"""Array kernels on images (height, width, channels), boxes and outlines. No imaging library is needed."""

from __future__ import annotations

import math

import numpy as np


def resized_shape(h: int, w: int, longest: int) -> tuple[int, int]:
    """Shape with the longest side at most ``longest``; the division is Python's floor of floats,
    which is not the floor of the quotient."""
    ratio = max(h, w) / longest
    return (int(h // ratio), int(w // ratio)) if ratio > 1 else (h, w)


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float | None = None) -> np.ndarray:
    """Bilinear values at fractional positions; outside, the edge's or ``fill``."""
    h, w = image.shape[:2]
    inside = (y > -1) & (y < h) & (x > -1) & (x < w)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    src = image.astype(np.float64)
    out = (src[y0, x0] * (1 - fx) + src[y0, x1] * fx) * (1 - fy) + (src[y1, x0] * (1 - fx) + src[y1, x1] * fx) * fy
    if fill is not None:
        out = np.where(inside[..., None] if image.ndim == 3 else inside, out, fill)
    return out


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    if image.shape[:2] == (h, w):
        return image
    y = (np.arange(h) + 0.5) * image.shape[0] / h - 0.5
    x = (np.arange(w) + 0.5) * image.shape[1] / w - 0.5
    out = sample(image, *np.meshgrid(np.clip(y, 0, None), np.clip(x, 0, None), indexing="ij"))
    return np.rint(out).astype(image.dtype) if image.dtype == np.uint8 else out


def shrink(image: np.ndarray, longest: int) -> np.ndarray:
    """At most ``longest`` on the longer side, never larger."""
    return resize(image, *resized_shape(*image.shape[:2], longest))


def thumbnail(image: np.ndarray, width: int = 96) -> np.ndarray:
    """Means over areas, to a fixed width."""
    h, w = image.shape[:2]
    target = max(1, round(h * width / w))
    ys, xs = np.linspace(0, h, target + 1), np.linspace(0, w, width + 1)
    total = np.cumsum(np.cumsum(np.pad(image.astype(float), [(1, 0), (1, 0)] + [(0, 0)] * (image.ndim - 2)), axis=0), axis=1)
    corner = sample(total, *np.meshgrid(ys, xs, indexing="ij"))
    area = (np.diff(ys)[:, None] * np.diff(xs)[None, :])[..., *[None] * (image.ndim - 2)]
    mean = (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) / area
    return np.clip(np.rint(mean), 0, 255).astype(np.uint8)


def letterbox(image: np.ndarray, height: int, width: int, fill: int = 114) -> tuple[np.ndarray, float, int, int]:
    """The image fitted into a frame; also its ratio, and the left and top padding."""
    h, w = image.shape[:2]
    ratio = min(height / h, width / w)
    nh, nw = round(h * ratio), round(w * ratio)
    top, left = round((height - nh) / 2 - 0.1), round((width - nw) / 2 - 0.1)
    out = np.full((height, width, *image.shape[2:]), fill, image.dtype)
    out[top : top + nh, left : left + nw] = resize(image, nh, nw)
    return out, ratio, left, top


def square(image: np.ndarray, side: int, fill: int = 0) -> np.ndarray:
    """Letterbox into a square."""
    return letterbox(image, side, side, fill)[0]


def planes(image: np.ndarray) -> np.ndarray:
    """A batch of one, channels first, in 0 to 1."""
    return (image.astype(np.float32) / 255).transpose(2, 0, 1)[None]


def word_tensor(image: np.ndarray, height: int = 32, least: int = 16) -> np.ndarray:
    """A word for the reader: blue first, fixed height, its own width; an empty patch reads as a blank."""
    h, w = image.shape[:2]
    if h == 0 or w == 0:
        return planes(np.full((height, least, 3), 255, np.uint8))
    return planes(resize(image, height, max(least, round(w * height / h)))[..., ::-1])


def to_corners(centred: np.ndarray) -> np.ndarray:
    """(cx, cy, w, h) to corners."""
    half = centred[:, 2:4] / 2
    return np.concatenate([centred[:, :2] - half, centred[:, :2] + half], axis=1)


def rescale(boxes: np.ndarray, ratio: float, left: float, top: float) -> np.ndarray:
    """Out of a letterbox: whole pixels, rounded half-even, not below 0."""
    return np.rint(np.maximum((boxes - [left, top, left, top]) / ratio, 0)).astype(int)


def crop(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The box's part of the image, as far as it lies within."""
    x1, y1, x2, y2 = (max(0, int(v)) for v in box)
    return image[y1:y2, x1:x2]


def oriented_corners(box: np.ndarray) -> np.ndarray:
    """Corners of (cx, cy, w, h, angle), clockwise from the top left."""
    cx, cy, w, h, a = box[:5]
    c, s = math.cos(a), math.sin(a)
    d = np.array([(-w, -h), (w, -h), (w, h), (-w, h)]) / 2
    return np.stack([cx + d[:, 0] * c - d[:, 1] * s, cy + d[:, 0] * s + d[:, 1] * c], axis=1)


def oriented_crop(image: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The rotated box's content, upright."""
    cx, cy, w, h, a = box[:5]
    u, v = np.arange(max(1, round(w))) - (round(w) - 1) / 2, np.arange(max(1, round(h))) - (round(h) - 1) / 2
    x = cx + u[None, :] * math.cos(a) - v[:, None] * math.sin(a)
    y = cy + u[None, :] * math.sin(a) + v[:, None] * math.cos(a)
    return np.rint(sample(image, y, x)).astype(image.dtype)


def clip_polygon(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside another, both in the same turn."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        after, side2 = np.roll(out, -1, axis=0), np.roll(side, -1)
        kept = []
        for p, q, s, t in zip(out, after, side, side2, strict=True):
            if s >= 0:
                kept.append(p)
            if (s >= 0) != (t >= 0):
                kept.append(p + (q - p) * (s / (s - t)))
        out = np.array(kept).reshape(-1, 2)
    return out


def area(points: np.ndarray) -> float:
    """shoelace."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def oriented_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap of two rotated boxes over their union."""
    inter = area(clip_polygon(oriented_corners(a), oriented_corners(b)))
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else float("nan")


def suppress_oriented(boxes: np.ndarray, conf: np.ndarray, threshold: float) -> list[int]:
    """Greedy suppression of rotated boxes, the first of equals first."""
    left, kept = np.lexsort((np.arange(len(conf)), -conf)).tolist(), []
    while left:
        best, *left = left
        kept.append(best)
        left = [i for i in left if oriented_iou(boxes[best], boxes[i]) < threshold]
    return kept


def masks(coefficients: np.ndarray, prototypes: np.ndarray, boxes: np.ndarray, shape: tuple[int, int], ratio: float, left: int, top: int, threshold: float = 0.5) -> np.ndarray:
    """Masks of 0 and 255 in the image's pixels from prototypes of the letterboxed one, within each box."""
    c, ph, pw = prototypes.shape
    soft = 1 / (1 + np.exp(-(coefficients @ prototypes.reshape(c, -1)).reshape(-1, ph, pw)))
    h, w = shape
    scale_y, scale_x = ph / (h * ratio + 2 * top), pw / (w * ratio + 2 * left)
    y = ((np.arange(h) + 0.5) * ratio + top) * scale_y - 0.5
    x = ((np.arange(w) + 0.5) * ratio + left) * scale_x - 0.5
    out = np.zeros((len(soft), h, w), np.uint8)
    grid = np.meshgrid(y, x, indexing="ij")
    for i, (m, box) in enumerate(zip(soft, boxes, strict=True)):
        x1, y1, x2, y2 = (max(0, round(v)) for v in box)
        part = np.zeros((h, w), bool)
        part[y1:y2, x1:x2] = True
        out[i] = np.where(part & (sample(m, *grid) > threshold), 255, 0)
    return out


#: Steps around a pixel, clockwise in (y, x) from the right.
_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outline(mask: np.ndarray) -> np.ndarray:
    """Border pixels (x, y) of the region met first in reading order, by following its edge."""
    on = np.pad(mask > 0, 1)
    ys, xs = np.nonzero(on)
    if not len(ys):
        return np.zeros((0, 2), np.float32)
    start = (int(ys[0]), int(xs[0]))
    at, back, points = start, 4, []
    for _ in range(4 * len(ys) + 8):
        points.append((at[1] - 1, at[0] - 1))
        for turn in range(1, 9):
            d = (back + turn) % 8
            step = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if on[step]:
                at, back = step, (d + 4) % 8
                break
        else:
            break
        if at == start and len(points) > 1:
            break
    return np.array(points, np.float32)


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """Masks of the 8-connected regions."""
    left, out = mask > 0, []
    while left.any():
        y, x = (int(v[0]) for v in np.nonzero(left))
        region, front = np.zeros_like(left), [(y, x)]
        region[y, x] = True
        left[y, x] = False
        while front:
            y, x = front.pop()
            for dy, dx in _AROUND:
                p = (y + dy, x + dx)
                if 0 <= p[0] < left.shape[0] and 0 <= p[1] < left.shape[1] and left[p]:
                    left[p], region[p] = False, True
                    front.append(p)
        out.append(region)
    return out


def longest_outline(mask: np.ndarray) -> np.ndarray:
    """The outline with most points among the regions'."""
    found = [outline(r) for r in regions(mask)]
    return max(found, key=len, default=np.zeros((0, 2), np.float32))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise in a frame with y up."""
    p = np.unique(points.astype(float), axis=0)
    if len(p) < 3:
        return p

    def half(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed outline with points dropped that lie within a tolerance of a chord."""
    if len(points) < 4:
        return points
    far = int(np.hypot(*(points - points[0]).T).argmax())

    def line(a: int, b: int, p: np.ndarray) -> list[int]:
        if b - a < 2:
            return []
        u = p[b] - p[a]
        d = np.abs(u[0] * (p[a + 1 : b, 1] - p[a, 1]) - u[1] * (p[a + 1 : b, 0] - p[a, 0])) / max(1e-12, math.hypot(*u))
        k = int(d.argmax())
        return [] if d[k] <= tolerance else [*line(a, a + 1 + k, p), a + 1 + k, *line(a + 1 + k, b, p)]

    closed = np.concatenate([points, points[:1]])
    keep = [0, *line(0, far, closed), far, *line(far, len(points), closed)]
    return points[keep]


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around points: one of its sides lies on the hull."""
    h = hull(points)
    best = None
    for e in np.roll(h, -1, axis=0) - h:
        n = math.hypot(*e)
        if n == 0:
            continue
        turn = np.array([[e[0], e[1]], [-e[1], e[0]]]) / n
        q = h @ turn.T
        lo, hi = q.min(axis=0), q.max(axis=0)
        size = float(np.prod(hi - lo))
        if best is None or size < best[0]:
            best = (size, np.array([lo, (hi[0], lo[1]), hi, (lo[0], hi[1])]) @ turn)
    return best[1] if best else np.repeat(h[:1], 4, axis=0)


def quad(points: np.ndarray, tolerances: tuple[float, ...] = (0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1)) -> np.ndarray:
    """Four corners: the hull simplified at the first tolerance that leaves four, else the least rectangle."""
    h = hull(points)
    length = np.hypot(*(np.roll(h, -1, axis=0) - h).T).sum()
    for t in tolerances:
        q = simplified(h, t * length)
        if len(q) == 4:
            return ordered(q)
    return ordered(least_rectangle(points))


def ordered(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    total, diff = corners.sum(axis=1), corners[:, 1] - corners[:, 0]
    return corners[[total.argmin(), diff.argmin(), total.argmax(), diff.argmax()]]


def expanded(corners: np.ndarray, margin: float, h: int, w: int) -> np.ndarray:
    """Moved away from the centroid, kept within the image."""
    centre = corners.mean(axis=0)
    return np.clip(centre + (corners - centre) * (1 + 2 * margin), 0, [w - 1, h - 1])


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map of four points to four points."""
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, float), np.asarray(dst, float).ravel()), 1).reshape(3, 3)


def rectified(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """What lies within four corners, as a rectangle of the longer opposite sides."""
    tl, tr, br, bl = corners
    length = lambda p, q: math.hypot(*(p - q))
    w, h = max(1, int(max(length(tl, tr), length(bl, br)))), max(1, int(max(length(tl, bl), length(tr, br))))
    back = homography(np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]), corners)
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    p = back @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    out = sample(image, (p[1] / p[2]).reshape(h, w), (p[0] / p[2]).reshape(h, w))
    return np.rint(out).astype(image.dtype)


def stitched(pages: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
    """Pages side by side, or one above the other, whichever their centres are further apart in."""
    if len(pages) == 1:
        return pages[0]
    gap = np.abs(centres[0] - centres[1])
    axis = 1 if gap[0] >= gap[1] else 0
    order = np.argsort(centres[:, 0 if axis else 1], kind="stable")
    side = min(p.shape[1 - axis] for p in pages)

    def fitted(p: np.ndarray) -> np.ndarray:
        other = max(1, round(p.shape[axis] * side / p.shape[1 - axis]))
        return resize(p, side, other) if axis else resize(p, other, side)

    return np.concatenate([fitted(pages[i]) for i in order], axis=axis)


def tiles(h: int, w: int, across: int = 7, down: int = 4, size: int = 128) -> list[tuple[int, int]]:
    """Corners (x, y) of an even grid of windows, column by column."""
    xs = [round(i * max(0, w - size) / max(1, across - 1)) for i in range(across)]
    ys = [round(i * max(0, h - size) / max(1, down - 1)) for i in range(down)]
    return [(x, y) for x in xs for y in ys]


def rotated(image: np.ndarray, degrees: float, fill: float = 255.0) -> np.ndarray:
    """The image turned about its centre in its own frame."""
    h, w = image.shape[:2]
    a = math.radians(degrees)
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    sy, sx = y * math.cos(a) + x * math.sin(a) + (h - 1) / 2, x * math.cos(a) - y * math.sin(a) + (w - 1) / 2
    out = sample(image, sy, sx, fill)
    return np.rint(out).astype(image.dtype) if image.dtype == np.uint8 else out


def sharpness_of_rows(gray: np.ndarray, degrees: float) -> float:
    """variance of the row and column sums at an angle: text lines that run straight vary most."""
    turned = rotated(gray.astype(float), degrees, float(gray.mean()))
    return float(np.var(turned.sum(axis=1)) + np.var(turned.sum(axis=0)))


def skew(gray: np.ndarray, limit: float = 10.0, coarse: int = 21, fine: int = 101) -> float:
    """The angle whose projection varies most, first coarsely, then finely around the best; a peak
    at the limit is none. The first of equals wins."""

    def best(angles: np.ndarray) -> int:
        return int(np.argmax([sharpness_of_rows(gray, a) for a in angles]))

    rough = np.linspace(-limit, limit, coarse)
    at = best(rough)
    if at in (0, coarse - 1):
        return 0.0
    step = rough[1] - rough[0]
    near = np.linspace(rough[at] - step, rough[at] + step, max(3, fine // coarse))
    return float(near[best(near)])


def deskewed(image: np.ndarray, limit: float = 10.0, least: float = 2.0, scale: float = 0.4) -> tuple[np.ndarray, float]:
    """The image set straight if its skew is at least ``least``; and the skew."""
    gray = image.mean(axis=2) if image.ndim == 3 else image.astype(float)
    small = resize(gray, max(1, round(gray.shape[0] * scale)), max(1, round(gray.shape[1] * scale)))
    angle = skew(small, limit)
    return (rotated(image, angle), angle) if abs(angle) >= least else (image, angle)
