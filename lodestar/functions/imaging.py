"""Neighbourhood, geometric and spectral image operations in numpy, and texture and point features.

They run in Arrow-batched Python functions (``on_images``) because two-dimensional neighbourhoods cannot be expressed
by built-in functions. Images are float arrays (height, width) or (height, width, layers) in [0, 1].
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

# Neighbourhoods.


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size correlation with zeros outside the image."""
    h, w = kernel.shape
    padded = np.pad(image, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)))
    return np.einsum("yxhw,hw->yx", np.lib.stride_tricks.sliding_window_view(padded, (h, w)), kernel)


def fft_convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The same by the frequency domain."""
    h, w = kernel.shape
    size = (image.shape[0] + h - 1, image.shape[1] + w - 1)
    full = np.fft.irfft2(np.fft.rfft2(image, size) * np.fft.rfft2(kernel[::-1, ::-1], size), size)
    return full[h - 1 - h // 2 :, w - 1 - w // 2 :][: image.shape[0], : image.shape[1]]


SOBEL = {
    "vertical": np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float),
    "horizontal": np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]], float),
    "diagonal1": np.array([[-2, -1, 0], [-1, 0, 1], [0, 1, 2]], float),
    "diagonal2": np.array([[0, -1, -2], [1, 0, -1], [2, 1, 0]], float),
}
LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)


def sobel(image: np.ndarray, direction: str) -> np.ndarray:
    return convolve(image, SOBEL[direction])


def laplace(image: np.ndarray) -> np.ndarray:
    return convolve(image, LAPLACE)


def box_mean(image: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the window of ``radius``, clipped at the borders, by an integral image."""
    table = np.pad(image.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y, x = np.arange(image.shape[0]), np.arange(image.shape[1])
    y0, y1 = np.maximum(y - radius, 0), np.minimum(y + radius + 1, image.shape[0])
    x0, x1 = np.maximum(x - radius, 0), np.minimum(x + radius + 1, image.shape[1])
    sums = table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]
    return sums / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def local_variance(image: np.ndarray, radius: int = 1) -> np.ndarray:
    return np.maximum(box_mean(image * image, radius) - box_mean(image, radius) ** 2, 0)


def local_entropy(image: np.ndarray, radius: int = 2, bins: int = 16) -> np.ndarray:
    at = np.minimum((image * bins).astype(int), bins - 1)
    shares = np.stack([box_mean((at == b).astype(float), radius) for b in range(bins)])
    return -np.where(shares > 1e-12, shares * np.log(np.maximum(shares, 1e-12)), 0).sum(axis=0)


def windowed_equalize(image: np.ndarray, window: int, offset: int, blend: float = 1.0, bound: float = 0.0, bins: int = 256) -> np.ndarray:
    """Overlapping windows, each histogram-equalised; averages are blended with the image where it exceeds ``bound``."""
    total, times = np.zeros_like(image), np.zeros_like(image)
    for y in range(0, max(image.shape[0] - window, 0) + 1, offset):
        for x in range(0, max(image.shape[1] - window, 0) + 1, offset):
            part = np.minimum((image[y : y + window, x : x + window] * bins).astype(int), bins - 1)
            total[y : y + window, x : x + window] += (np.bincount(part.ravel(), minlength=bins).cumsum() / part.size)[part]
            times[y : y + window, x : x + window] += 1
    mixed = np.where(times > 0, blend * total / np.maximum(times, 1) + (1 - blend) * image, image)
    return np.where(image > bound, mixed, image)


# Geometry.


def rotate90(image: np.ndarray) -> np.ndarray:
    return np.rot90(image)


def flip(image: np.ndarray, axis: int = 1) -> np.ndarray:
    return np.flip(image, axis)


def zero_pad(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.pad(image, ((0, height - image.shape[0]), (0, width - image.shape[1])))


def bilinear(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Interpolated values; zeros outside."""
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    dy, dx, out = y - y0, x - x0, np.zeros(np.broadcast(y, x).shape)
    for oy, wy in ((0, 1 - dy), (1, dy)):
        for ox, wx in ((0, 1 - dx), (1, dx)):
            yy, xx = y0 + oy, x0 + ox
            inside = (yy >= 0) & (yy < image.shape[0]) & (xx >= 0) & (xx < image.shape[1])
            out += np.where(inside, image[np.clip(yy, 0, image.shape[0] - 1), np.clip(xx, 0, image.shape[1] - 1)], 0) * wy * wx
    return out


def scale(image: np.ndarray, height: int, width: int) -> np.ndarray:
    y, x = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5, (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    return bilinear(image, np.clip(y, 0, image.shape[0] - 1)[:, None], np.clip(x, 0, image.shape[1] - 1)[None, :])


def fft_scale(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Scaled by cutting or padding the spectrum."""
    spectrum = np.fft.fftshift(np.fft.fft2(image))
    out = np.zeros((height, width), complex)
    h, w = min(height, image.shape[0]), min(width, image.shape[1])
    sy, sx, ty, tx = image.shape[0] // 2 - h // 2, image.shape[1] // 2 - w // 2, height // 2 - h // 2, width // 2 - w // 2
    out[ty : ty + h, tx : tx + w] = spectrum[sy : sy + h, sx : sx + w]
    return np.fft.ifft2(np.fft.ifftshift(out)).real * height * width / image.size


def affine(image: np.ndarray, matrix: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Each output pixel (x, y) shows the input at matrix @ (x, y) + offset."""
    y, x = np.indices(image.shape[:2])
    at = np.einsum("ij,jyx->iyx", matrix, np.stack([x, y]).astype(float)) + np.asarray(offset, float)[:, None, None]
    return bilinear(image, at[1], at[0])


def patch(image: np.ndarray, y: int, x: int, radius: int) -> np.ndarray:
    """The square of side 2 radius + 1 around a pixel, zeros outside the image."""
    padded = np.pad(image, [(radius, radius), (radius, radius)] + [(0, 0)] * (image.ndim - 2))
    return padded[y : y + 2 * radius + 1, x : x + 2 * radius + 1]


def set_patch(image: np.ndarray, y: int, x: int, part: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def append(left: np.ndarray, right: np.ndarray, axis: int) -> np.ndarray:
    return np.concatenate([left, right], axis=axis)


def shave(image: np.ndarray, border: int) -> np.ndarray:
    return image[border : image.shape[0] - border, border : image.shape[1] - border]


# Transforms.


def fft_shifted(image: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(np.fft.fft2(image))


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.indices((n, n))
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def dct(image: np.ndarray) -> np.ndarray:
    return dct_matrix(image.shape[0]) @ image @ dct_matrix(image.shape[1]).T


def inverse_dct(coefficients: np.ndarray) -> np.ndarray:
    return dct_matrix(coefficients.shape[0]).T @ coefficients @ dct_matrix(coefficients.shape[1])


def unit(image: np.ndarray) -> np.ndarray:
    low, high = image.min(), image.max()
    return (image - low) / (high - low) if high > low else np.zeros_like(image)


def histogram(layers: list[np.ndarray], steps: int) -> np.ndarray:
    """Counts over the joint bins of layers in [0, 1], the first layer fastest."""
    at = np.zeros(layers[0].size, int)
    for i, x in enumerate(layers):
        at += np.minimum((x.ravel() * steps).astype(int), steps - 1) * steps**i
    return np.bincount(at, minlength=steps ** len(layers))


# Texture.


def tamura_layers(image: np.ndarray) -> np.ndarray:
    """Coarseness, contrast and directionality of each pixel of one layer."""
    m1 = box_mean(image, 5)
    centred2 = box_mean(image**2, 5) - m1**2
    m3, m4 = box_mean(image**3, 5), box_mean(image**4, 5)
    fourth = m4 - 4 * m1 * m3 + 6 * m1**2 * box_mean(image**2, 5) - 3 * m1**4
    contrast = np.where(fourth > 1e-12, np.maximum(centred2, 0) / np.sqrt(np.sqrt(np.maximum(fourth, 1e-12))), 0)
    v, h = sobel(image, "vertical"), sobel(image, "horizontal")
    direction = np.where(h != 0, np.arctan(v / np.where(h != 0, h, 1)) + math.pi / 2 + 0.001, 0)
    best, coarse = np.full(image.shape, -1.0), np.zeros(image.shape)
    for k in range(1, 6):
        half = 2 ** (k - 1)
        means = box_mean(image, half)
        gap = np.zeros(image.shape)
        if image.shape[0] > 2 * half and image.shape[1] > 2 * half:
            dx = np.abs(means[half:-half, 2 * half :] - means[half:-half, : -2 * half])
            dy = np.abs(means[2 * half :, half:-half] - means[: -2 * half, half:-half])
            gap[half:-half, half:-half] = np.maximum(dx, dy)
        better = gap > best
        best, coarse = np.where(better, gap, best), np.where(better & (gap > 0), k, coarse)
    return np.stack([coarse, contrast, direction])


def tamura(image: np.ndarray, steps: int = 8) -> np.ndarray:
    """Joint histogram of the three texture layers, averaged over channels and scaled to [0, 1]."""
    channels = [image] if image.ndim == 2 else [image[:, :, i] for i in range(image.shape[2])]
    layers = np.mean([tamura_layers(c) for c in channels], axis=0)
    return histogram([unit(x) for x in layers], steps)


def centre_windows(image: np.ndarray, sizes: list[float]) -> Iterator[np.ndarray]:
    """For each size below 1 the window around the centre that reaches half that share of each axis; else the image."""
    for s in sizes:
        if s >= 1:
            yield image
        else:
            cy, cx, ry, rx = image.shape[0] // 2, image.shape[1] // 2, int(image.shape[0] * s / 2), int(image.shape[1] * s / 2)
            yield image[cy - ry : cy + ry + 1, cx - rx : cx + rx + 1]


def histogram_pairs(image: np.ndarray, sizes: list[float], extract: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Histogram of the image and of each centre window; a background is the first minus the second."""
    return extract(image), np.stack([extract(w) for w in centre_windows(image, sizes)])


def gabor(image: np.ndarray, phases: int = 4, frequencies: int = 3) -> np.ndarray:
    """Mean and standard deviation of the response for each phase and frequency, by Gaussians in the frequency domain."""
    size = 1 << max(image.shape[0] - 1, image.shape[1] - 1, 1).bit_length()
    spectrum = np.fft.fft2(image, (size, size))
    fy, fx = np.fft.fftfreq(size)[:, None], np.fft.fftfreq(size)[None, :]
    out = []
    for p in range(phases):
        angle = math.pi * p / phases
        u, v = fx * math.cos(angle) + fy * math.sin(angle), -fx * math.sin(angle) + fy * math.cos(angle)
        for f in range(frequencies):
            centre = 0.25 / 2**f
            response = np.abs(np.fft.ifft2(spectrum * np.exp(-(((u - centre) ** 2) + v**2) / (2 * (centre / 2) ** 2))))[: image.shape[0], : image.shape[1]]
            out += [response.mean(), response.std()]
    return np.array(out)


# Invariant features.


def monomial(values: list[np.ndarray]) -> np.ndarray:
    """Geometric mean of pixel values."""
    return np.prod(values, axis=0) ** (1 / len(values))


def ramp(x: np.ndarray, y: np.ndarray, c: float = 25 / 255) -> np.ndarray:
    """1 where x is darker by c or more, 0 where brighter by c, linear between."""
    return np.clip((c - (x - y)) / (2 * c), 0, 1)


def rotated_reads(image: np.ndarray, point: tuple[float, float], rotations: int) -> Iterator[np.ndarray]:
    """The image read at every pixel plus a point rotated about it, periodic at the borders."""
    y, x = np.indices(image.shape)
    padded = np.pad(image, ((0, 1), (0, 1)), mode="wrap")
    for r in range(rotations):
        a = 2 * math.pi * r / rotations
        dx, dy = point[0] * math.cos(a) - point[1] * math.sin(a), point[0] * math.sin(a) + point[1] * math.cos(a)
        yield bilinear(padded, np.mod(y + dy, image.shape[0]), np.mod(x + dx, image.shape[1]))


def invariant(image: np.ndarray, points: list[tuple[float, float]] | None = None, rotations: int = 36, steps: int = 8, kernel: str = "monomial") -> np.ndarray:
    """Histogram of kernel values averaged over rotations around each pixel."""
    points = points or [(4, 0), (0, 8)]
    reads = [list(rotated_reads(image, p, rotations)) for p in points]
    each = [monomial([r[i] for r in reads]) if kernel == "monomial" else ramp(reads[0][i], reads[-1][i]) for i in range(rotations)]
    return histogram([np.clip(np.mean(each, axis=0), 0, 1)], steps)


# Local features.


def grid_points(shape: tuple[int, int], n: int) -> list[tuple[int, int]]:
    sy, sx = max(1, shape[0] // (n + 1)), max(1, shape[1] // (n + 1))
    return [(y, x) for y in range(sy, shape[0], sy) for x in range(sx, shape[1], sx)] or [(shape[0] // 2, shape[1] // 2)]


def random_points(shape: tuple[int, int], n: int, seed: int = 0) -> list[tuple[int, int]]:
    rng = np.random.default_rng(seed)
    return list(zip(rng.integers(0, shape[0], n).tolist(), rng.integers(0, shape[1], n).tolist(), strict=True))


def gaussian(sigma: float, most: int = 31) -> np.ndarray:
    side = min(1 + round(8 * sigma), most)
    x = np.arange(side + (side + 1) % 2) - (side + (side + 1) % 2) // 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    g = gaussian(sigma)
    return convolve(convolve(image, g[None, :]), g[:, None])


def dog_points(image: np.ndarray, n: int = 100, levels: int = 8, start: float = 0.6, step: float = 1.2) -> list[tuple[int, int, float, float]]:
    """(y, x, scale, saliency): extrema of differences of Gaussians over space and scale, the strongest first and not within 5 pixels of a stronger one of similar scale, then in raster order."""
    sigmas = [start * step**i for i in range(levels + 1)]
    stack = [blurred(image, s) for s in sigmas]
    dog = np.stack([b - a for a, b in zip(stack[:-1], stack[1:], strict=True)])
    found = []
    for k in range(1, len(dog) - 1):
        cube = np.lib.stride_tricks.sliding_window_view(dog[k - 1 : k + 2], (3, 3, 3))[0]
        flat = cube.reshape(*cube.shape[:2], 27)
        centre = flat[:, :, 13]
        others = np.delete(flat, 13, axis=2)
        for y, x in np.argwhere((centre > others.max(axis=2)) | (centre < others.min(axis=2))):
            found.append((int(y) + 1, int(x) + 1, 8 * sigmas[k], float(abs(centre[y, x]))))
    chosen: list[tuple[int, int, float, float]] = []
    for p in sorted(found, key=lambda p: (-p[3], p[0], p[1])):
        if len(chosen) < n and not any(abs(p[0] - q[0]) <= 5 and abs(p[1] - q[1]) <= 5 and abs(p[2] - q[2]) < 10 for q in chosen):
            chosen.append(p)
    return sorted(chosen)


def orientation_descriptor(image: np.ndarray, y: int, x: int, radius: int = 8) -> np.ndarray:
    """128 numbers: 8 gradient orientations in 4 x 4 cells around a point, relative to the main orientation, Gaussian-weighted, clipped at .2 and of norm 1."""
    dy, dx = np.gradient(np.pad(image, radius + 1))
    part = (slice(y + 1, y + 1 + 2 * radius), slice(x + 1, x + 1 + 2 * radius))
    gy, gx = dy[part], dx[part]
    yy, xx = np.mgrid[-radius:radius, -radius:radius] + 0.5
    size, angle = np.hypot(gy, gx) * np.exp(-(yy**2 + xx**2) / (2 * radius**2)), np.arctan2(gy, gx)
    main = np.argmax(np.bincount(((angle + np.pi) / (2 * np.pi) * 36).astype(int).ravel() % 36, weights=size.ravel(), minlength=36)) * 2 * np.pi / 36 - np.pi
    c, s = np.cos(-main), np.sin(-main)
    cy, cx = ((xx * s + yy * c + radius) // (radius / 2)).astype(int), ((xx * c - yy * s + radius) // (radius / 2)).astype(int)
    bins = (np.mod(angle - main, 2 * np.pi) / (2 * np.pi) * 8).astype(int) % 8
    inside = (cy >= 0) & (cy < 4) & (cx >= 0) & (cx < 4)
    out = np.bincount(((cy * 4 + cx) * 8 + bins)[inside], weights=size[inside], minlength=128)
    for _ in range(2):
        n = np.linalg.norm(out)
        out = np.minimum(out / n, 0.2) if n > 0 else out
    n = np.linalg.norm(out)
    return out / n if n > 0 else out


def local_features(image: np.ndarray, points: list[tuple[int, int]], radius: int = 2, descriptor: str = "patch") -> list[tuple[int, int, int, list[float]]]:
    """(x, y, scale, vector) for each point."""
    make = (lambda y, x: patch(image, y, x, radius).ravel()) if descriptor == "patch" else (lambda y, x: orientation_descriptor(image, y, x))
    return [(x, y, radius, make(y, x).tolist()) for y, x in points]


# Matching.


def image_distortion(query: np.ndarray, stored: np.ndarray, warp: int = 3, context: int = 1, cut: float = 0.05, gradients: bool = True) -> float:
    """For each query pixel the best match of its context within ``warp`` pixels, cut off at ``cut``; summed."""
    layers = [(query, stored)] if not gradients else [(sobel(query, d), sobel(stored, d)) for d in ("vertical", "horizontal")]
    best = np.full(query.shape, np.inf)
    for oy in range(-warp, warp + 1):
        for ox in range(-warp, warp + 1):
            cost = np.zeros(query.shape)
            for q, s in layers:
                moved = np.pad(s, warp)[warp + oy : warp + oy + s.shape[0], warp + ox : warp + ox + s.shape[1]]
                cost += box_mean((q - moved) ** 2, context) * (2 * context + 1) ** 2
            best = np.minimum(best, cost)
    return float(np.minimum(best, cut).sum())


def cross_correlation(query: np.ndarray, stored: np.ndarray, reach: int = 4) -> float:
    """1 - the largest normalised correlation over shifts of up to ``reach`` in both axes."""
    n = math.sqrt((query**2).sum() * (stored**2).sum())
    if n == 0:
        return 1.0
    padded = np.pad(stored, reach)
    windows = np.lib.stride_tricks.sliding_window_view(padded, query.shape)
    return float(1 - np.einsum("yxij,ij->yx", windows, query).max() / n)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of the shorter side to the longer (shortest augmenting paths with potentials)."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in assignment(cost.T)]
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def edge_cover(a: np.ndarray, b: np.ndarray) -> float:
    """Least total squared L2 of pairs such that every vector of both sets is in a pair."""
    if not len(a) or not len(b):
        return 0.0
    cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    row, column = cost.min(axis=1), cost.min(axis=0)
    # An edge cover is a matching that saves row + column - cost on its edges over every vertex's cheapest edge.
    gain = np.maximum(row[:, None] + column[None, :] - cost, 0)
    return float(row.sum() + column.sum() - sum(gain[i, j] for i, j in assignment(-gain)))


def earth_mover(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, empty: float = 2.0) -> float:
    """Cost of moving the weights of one signature to another of equal total over squared L2, both normalised; ``empty`` if one has none.

    Successive shortest paths on the transport graph.
    """
    if not len(a) or not len(b) or wa.sum() <= 0 or wb.sum() <= 0:
        return empty
    supply, demand = wa / wa.sum(), wb / wb.sum()
    cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    # Shorter by rounding alone is not shorter: predecessors would form a cycle.
    (n, m), slack = cost.shape, 1e-12 * cost.max()
    flow, left, need, total = np.zeros((n, m)), supply.copy(), demand.copy(), 0.0
    while left.max() > 1e-12 and need.max() > 1e-12:
        dist_a, dist_b = np.where(left > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        from_b, from_a = np.full(m, -1), np.full(n, -1)
        for _ in range(n + m):
            through = dist_a[:, None] + cost
            best = through.min(axis=0)
            moved = best < dist_b - slack
            dist_b[moved], from_b[moved] = best[moved], through.argmin(axis=0)[moved]
            back = np.where(flow > 1e-12, dist_b[None, :] - cost, np.inf)
            best = back.min(axis=1)
            again = best < dist_a - slack
            dist_a[again], from_a[again] = best[again], back.argmin(axis=1)[again]
            if not moved.any() and not again.any():
                break
        j = int(np.argmin(np.where(need > 1e-12, dist_b, np.inf)))
        path, end = [], j
        while True:
            i = int(from_b[end])
            path.append((i, end, 1))
            if from_a[i] < 0:
                break
            end = int(from_a[i])
            path.append((i, end, -1))
        amount = min(left[i], need[j], *[flow[p, q] for p, q, s in path if s < 0])
        for p, q, s in path:
            flow[p, q] += s * amount
            total += s * amount * cost[p, q]
        left[i] -= amount
        need[j] -= amount
    return float(total)
