"""Image distortions and full-reference measures in numpy, for Arrow batches.

Parameters follow the catalogue as functions of the intensity; there is no codec or vision library here, so
codecs are numpy ones of the same building blocks and quality range (``codecs``; JPEG is its block transform
alone), and results are not bit-equal to those of other libraries.  Images are uint8 (h, w, 3).

Distortions and measures take many images of one shape as one array (n, h, w, 3); an image's result doesn't depend
on those beside it, to the bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..dims import DISTORTIONS, INTENSITIES
from . import codecs

LUMA = np.array([0.299, 0.587, 0.114])


def to_uint8(x: np.ndarray) -> np.ndarray:
    """[0, 1] floats as bytes, clipped and truncated."""
    return (np.clip(x, 0, 1) * 255).astype(np.uint8)


@lru_cache(256)
def _padding(n: int, before: int, after: int, mode: str) -> np.ndarray:
    return np.pad(np.arange(n), (before, after), mode=mode)


def convolve(x: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Correlation of each channel of images (..., h, w, c) with a small kernel."""
    (kh, kw), (h, w) = kernel.shape, x.shape[-3:-1]
    p = x.take(_padding(h, kh // 2, kh - 1 - kh // 2, mode), -3) if kh > 1 else x
    p = p.take(_padding(w, kw // 2, kw - 1 - kw // 2, mode), -2) if kw > 1 else p
    p = p.copy() if p is x else p
    out, places = np.zeros_like(x), np.argwhere(kernel != 0).tolist()
    if len({kernel[i, j] for i, j in places}) == 1:
        p *= kernel[tuple(places[0])]
        for i, j in places:
            out += p[..., i : i + h, j : j + w, :]
    else:
        some = np.empty_like(x)
        for i, j in places:
            np.multiply(p[..., i : i + h, j : j + w, :], kernel[i, j], out=some)
            out += some
    return out


def gaussian(x: np.ndarray, size: int, sigma: float | None = None) -> np.ndarray:
    """Separable Gaussian of an odd size."""
    k = weights(size, sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8)
    return convolve(convolve(x, k[None, :]), k[:, None])


def weights(size: int, sigma: float) -> np.ndarray:
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def odd(n: float) -> int:
    return max(3, int(n)) | 1


def line_kernel(size: int, degrees: float) -> np.ndarray:
    """A line through the centre."""
    k, c = np.zeros((size, size)), size // 2
    t = np.deg2rad(degrees)
    down, across = np.sin(t), np.cos(t)
    for r in range(-c, c + 1):
        y, x = c + int(r * down), c + int(r * across)
        if 0 <= y < size and 0 <= x < size:
            k[y, x] = 1
    return k / k.sum()


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = axis(x.shape[-3], h)
    x0, x1, fx = axis(x.shape[-2], w)
    rows = x.take(y0, -3) * (1 - fy)[:, None, None] + x.take(y1, -3) * fy[:, None, None]
    return rows.take(x0, -2) * (1 - fx)[None, :, None] + rows.take(x1, -2) * fx[None, :, None]


def sample(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Values of images (n, h, w, 3) at fractional places, borders repeated; places (n or 1, h, w)."""
    y, z = np.clip(y, 0, x.shape[1] - 1), np.clip(z, 0, x.shape[2] - 1)
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    y1, z1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(z0 + 1, x.shape[2] - 1)
    fy, fz = (y - y0)[..., None], (z - z0)[..., None]
    return (picked(x, y0, z0) * (1 - fz) + picked(x, y0, z1) * fz) * (1 - fy) + (picked(x, y1, z0) * (1 - fz) + picked(x, y1, z1) * fz) * fy


def picked(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Pixels of images (n, h, w, 3) at whole places (n or 1, h, w)."""
    n, h, w = x.shape[:3]
    at = y * w + z
    if len(at) == 1:
        return x.reshape(n, h * w, -1).take(at[0].ravel(), 1).reshape(x.shape)
    return x.reshape(n * h * w, -1).take((at + np.arange(n)[:, None, None] * (h * w)).ravel(), 0).reshape(x.shape)


def gray(x: np.ndarray) -> np.ndarray:
    """Red, green and blue are added in this order, so that the sum is the same everywhere."""
    return x[..., 0] * LUMA[0] + x[..., 1] * LUMA[1] + x[..., 2] * LUMA[2]


def hue_turn(x: np.ndarray, degrees: float | list[float]) -> np.ndarray:
    """Turn of the colour around the gray axis, by one angle or one an image."""
    turns = []
    for a in np.atleast_1d(degrees):
        c, s = np.cos(np.deg2rad(a)), np.sin(np.deg2rad(a))
        turns.append(np.full((3, 3), (1 - c) / 3) + np.eye(3) * c + np.sqrt(1 / 3) * s * np.array([[0, -1, 1], [1, 0, -1], [-1, 1, 0]]))
    return x @ np.stack(turns).transpose(0, 2, 1)[:, None]


def dct_matrix(n: int = 8) -> np.ndarray:
    k = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(n)[:, None] / (2 * n))
    k[0] /= np.sqrt(2)
    return k


def block_codec(x: np.ndarray, qualities: list[int]) -> np.ndarray:
    """8 x 8 DCT, coefficients quantised more coarsely at higher frequencies and lower quality (one, or one an image)."""
    n, h, w = x.shape[:3]
    p = np.pad(x, ((0, 0), (0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") * 255 - 128
    y = p @ LUMA
    planes = [y, p[..., 2] - y, p[..., 0] - y]
    scale = np.array([(5000 / q if q < 50 else 200 - 2 * q) / 100 for q in qualities])[:, None, None, None, None]
    d, out = dct_matrix(), []
    for i, plane in enumerate(planes):
        step = np.maximum(1, scale * (10 + 6 * (np.arange(8)[:, None] + np.arange(8)[None, :])) * (1.6 if i else 1))
        b = plane.reshape(n, p.shape[1] // 8, 8, p.shape[2] // 8, 8).transpose(0, 1, 3, 2, 4)
        c = np.round(d @ b @ d.T / step) * step
        out.append((d.T @ c @ d).transpose(0, 1, 3, 2, 4).reshape(plane.shape))
    blue, red = out[0] + out[1], out[0] + out[2]
    green = (out[0] - LUMA[0] * red - LUMA[2] * blue) / LUMA[1]
    return ((np.stack([red, green, blue], -1) + 128) / 255)[:, :h, :w]


def blocks(shape: tuple, size: int = 16) -> list[tuple[slice, slice]]:
    return [(slice(y, min(y + size, shape[0])), slice(x, min(x + size, shape[1]))) for y in range(0, shape[0], size) for x in range(0, shape[1], size)]


#: Images (n, h, w, 3), intensity, and a generator for each image, in their order (views of a group have one in common), or
#: one alone: then all images get the same draws.  An image's draws are all taken before those of the next.
Kernel = Callable[[np.ndarray, float, Iterable[np.random.RandomState]], np.ndarray]
KERNELS: dict[str, Kernel] = {}
#: What a kernel makes of images whatever the intensity, which it takes as one more argument.
SHARED: dict[str, Callable[[np.ndarray], object]] = {}


def kernel(*names: str, shared: Callable[[np.ndarray], object] | None = None):
    def keep(f: Kernel) -> Kernel:
        KERNELS.update(dict.fromkeys(names, f))
        if shared:
            SHARED.update(dict.fromkeys(names, shared))
        return f

    return keep


def alike(draws: list[Hashable], n: int) -> dict[Hashable, slice | list[int]]:
    """Places of the images that have the same draw."""
    if len(draws) == 1:
        return {draws[0]: slice(0, n)}
    places: dict = {}
    for k, v in enumerate(draws):
        places.setdefault(v, []).append(k)
    return places


def lined(x: np.ndarray, draws: list[tuple[int, float]], mode: str = "reflect") -> np.ndarray:
    """Images blurred along lines of (size, degrees); those whose lines have the same pixels go together."""
    kernels = [line_kernel(*d) for d in draws]
    own = {(k.shape, k.tobytes()): k for k in kernels}
    out = np.empty_like(x)
    for key, at in alike([(k.shape, k.tobytes()) for k in kernels], len(x)).items():
        out[at] = convolve(x[at], own[key], mode)
    return out


def stacked(draws: list) -> np.ndarray:
    """Numbers by image, to be used with (n, h, w, 3)."""
    return np.array(draws)[:, None, None, None]


@kernel("propeller_vibration_blur")
def _(x, i, rngs):
    blurred = lined(x, [(int(3 + 12 * i), rng.uniform(0, 360)) for rng in rngs], "wrap")
    wave = 1 + 0.15 * (1 + 7 * i) * np.sin(2 * np.pi * (80 + 120 * i) * np.arange(x.shape[1]) / x.shape[1])
    return blurred * np.clip(wave, 0.7, 1.3)[:, None, None]


def depth_of(x: np.ndarray) -> np.ndarray:
    depth = gaussian(1 / np.maximum(gray(x), 1 / 255)[..., None], 15)
    least, most = (f((1, 2, 3), keepdims=True) for f in (depth.min, depth.max))
    return (depth - least) / np.maximum(most - least, 1e-8)


@kernel("atmospheric_scattering_haze", shared=depth_of)
def _(x, i, rngs, depth=None):
    t = np.exp(-(0.5 + 2.5 * i) * (depth_of(x) if depth is None else depth))
    return x * t + stacked([0.6 + rng.uniform(0, 0.3) for rng in rngs]) * (1 - t)


@kernel("six_dof_viewpoint_blur")
def _(x, i, rngs):
    return lined(x, [(int(np.clip(10 + 60 * i + rng.normal(0, 12.7), 3, 31)) | 1, rng.uniform(0, 360)) for rng in rngs])


def lost_blocks(x, i, rngs) -> tuple[list, list[np.ndarray]]:
    all_ = blocks(x.shape[1:])
    return all_, [rng.random_sample(len(all_)) < 0.01 + 0.29 * i for rng in rngs]


@kernel("communication_packet_loss")
def _(x, i, rngs):
    all_, draws = lost_blocks(x, i, rngs)
    out, wide = x.copy(), -(-x.shape[2] // 16)
    at = np.array([divmod(k, wide) for k in range(len(all_))])
    for key, own in alike([lost.tobytes() for lost in draws], len(x)).items():
        lost = np.frombuffer(key, bool)
        good = np.flatnonzero(~lost)
        for k in np.flatnonzero(lost):
            rows, cols = all_[k]
            out[own, rows, cols] = 0
            if len(good):
                near = all_[good[((at[good] - at[k]) ** 2).sum(1).argmin()]]
                piece = x[(own, *near)]
                h, w = min(piece.shape[1], rows.stop - rows.start), min(piece.shape[2], cols.stop - cols.start)
                out[own, rows.start : rows.start + h, cols.start : cols.start + w] = piece[:, :h, :w]
    return out


@kernel("low_res_super_resolution")
def _(x, i, rngs):
    h, w = x.shape[1:3]
    small = resize(x, max(1, int(h / (2 + 6 * i))), max(1, int(w / (2 + 6 * i))))
    up = gaussian(resize(small, h, w), 3)
    return up + 0.5 * (up - gaussian(up, 5))


@kernel("propeller_shadow")
def _(x, i, rngs):
    h, w = x.shape[1:3]
    y, z = np.mgrid[:h, :w]
    turns = [rng.uniform(0, np.pi) for rng in rngs]
    down, across = (np.array([f(t) for t in turns])[:, None, None] for f in (np.sin, np.cos))
    stripes = np.sign(np.sin(2 * np.pi * (y * down + z * across) / max(8, w / 8)))
    mask = np.exp(-(((y - h / 2) / (0.6 * h)) ** 2 + ((z - w / 2) / (0.6 * w)) ** 2))
    return x * np.clip(1 - (0.05 + 0.25 * i) * (stripes > 0) * mask, 0.6, 1)[..., None]


@kernel("gaussian_blur")
def _(x, i, rngs):
    return gaussian(x, odd(3 + 15 * i))


@kernel("lens_blur")
def _(x, i, rngs):
    r = 2 + int(8 * i)
    y, z = np.mgrid[-r : r + 1, -r : r + 1]
    disc = (y * y + z * z <= r * r).astype(float)
    return convolve(x, disc / disc.sum())


@kernel("motion_blur")
def _(x, i, rngs):
    return lined(x, [(odd(3 + int(15 * i)), rng.uniform(0, 360)) for rng in rngs])


@kernel("brighten_max", "brighten_avg")
def _(x, i, rngs):
    return x + 0.05 + 0.45 * i


@kernel("darken_max", "darken_min", "darken_avg")
def _(x, i, rngs):
    return x - 0.05 - 0.45 * i


@kernel("color_diffusion")
def _(x, i, rngs):
    return hue_turn(x, 2 * int(40 * i))


@kernel("color_shift")
def _(x, i, rngs):
    g = gray(x)[..., None]
    return g + (x - g) * (1 + int(60 * i) / 100)


@kernel("color_quantize")
def _(x, i, rngs):
    bits = int(np.floor(np.log2(max(2, int(256 - 200 * i)))))
    return (to_uint8(x) & (0xFF << (8 - bits) & 0xFF)) / 255


@kernel("white_noise")
def _(x, i, rngs):
    return x + np.stack([rng.normal(0, rng.uniform(0.05 * i, 0.15 * i + 1e-12), x.shape[1:]) for rng in rngs])


@kernel("color_noise")
def _(x, i, rngs):
    draws = [(rng.normal(0, 30 * i), rng.normal(0, 0.1 * i + 1e-12, x.shape[1:3])) for rng in rngs]
    return hue_turn(x, [d for d, _ in draws]) + np.stack([noise for _, noise in draws])[..., None]


@kernel("impulse_noise")
def _(x, i, rngs):
    draws = [(rng.uniform(0.1 * i, 0.1 * i + 0.02), rng.random_sample(x.shape[1:3])) for rng in rngs]
    amount, hit = stacked([a for a, _ in draws]), np.stack([hit for _, hit in draws])[..., None]
    return np.where(hit > 1 - amount / 2, 1.0, np.where(hit < amount / 2, 0.0, x))


@kernel("multiplicative_noise")
def _(x, i, rngs):
    return x * np.stack([rng.uniform(1 - 0.3 * i, 1 + 0.3 * i, x.shape[1:]) for rng in rngs])


@kernel("gaussian_denoise")
def _(x, i, rngs):
    sigma = 1 + 5 * i
    return gaussian(x, int(np.clip(int(6 * sigma) | 1, 3, 31)), sigma)


def non_local_means(x: np.ndarray, intensities: list[float]) -> list[np.ndarray]:
    """Non-local means over a 5 x 5 neighbourhood of 3 x 3 patches, whose distances all intensities have in common."""
    last = np.ascontiguousarray(x.transpose(3, 1, 2, 0))  # colours first and images last, for long runs
    height, width = last.shape[1:3]
    down, across = _padding(height, 1, 1, "reflect"), _padding(width, 1, 1, "reflect")
    sums = [(((3 + int(30 * i)) / 255) ** 2, np.zeros_like(last), np.zeros((height, width, len(x)))) for i in intensities]
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            moved = np.roll(last, (dy, dx), (1, 2))
            square = (last - moved) ** 2
            p = ((square[0] + square[1] + square[2]) / 3).take(down, 0).take(across, 1)
            p *= 1 / 9
            far = np.zeros((height, width, len(x)))
            for y in range(3):
                for z in range(3):
                    far -= p[y : y + height, z : z + width]
            for h2, total, weight in sums:
                w = np.exp(far / h2)
                total += np.multiply(w, moved, out=square)
                weight += w
    return [np.ascontiguousarray((total / weight).transpose(3, 1, 2, 0)) for _, total, weight in sums]


@kernel("cnn_denoise", shared=lambda x: dict(zip(INTENSITIES, non_local_means(x, INTENSITIES), strict=True)))
def _(x, i, rngs, found=None):
    return found[i] if found else non_local_means(x, [i])[0]


@kernel("jpeg_compression")
def _(x, i, rngs):
    return block_codec(x, [int(rng.randint(q := max(5, int(90 - 85 * i)), q + 11)) for rng in rngs])


@kernel("jp2k_compression")
def _(x, i, rngs):
    return codecs.wavelet_lossy(to_uint8(x), max(1, int(90 - 85 * i))) / 255


@kernel("webp_compression")
def _(x, i, rngs):
    return codecs.predicted_lossy(to_uint8(x), [int(rng.randint(q := max(5, int(90 - 85 * i)), q + 11)) for rng in rngs]) / 255


@kernel("spatial_warp")
def _(x, i, rngs):
    size = int(20 * i + 5) * 2 + 1
    size = min(size, (min(x.shape[1:3]) - 1) | 1)
    draws = [[rng.uniform(-1, 1, (*x.shape[1:3], 1)) for _ in range(2)] for rng in rngs]
    down, across = (gaussian(np.stack(d), size, 20 * i + 5)[..., 0] * 200 * i for d in zip(*draws, strict=True))
    y, z = np.mgrid[: x.shape[1], : x.shape[2]]
    return sample(x, y + down, z + across)


@kernel("spatial_scale")
def _(x, i, rngs):
    s, (h, w) = np.array([rng.uniform(1 - 0.3 * i, 1 + 0.3 * i) for rng in rngs])[:, None, None], x.shape[1:3]
    y, z = np.mgrid[:h, :w]
    return sample(x, (y - h / 2) / s + h / 2, (z - w / 2) / s + w / 2)


@kernel("clock_jittering")
def _(x, i, rngs):
    most = 1 + int(30 * i)
    shift = np.stack([rng.randint(-most, most + 1, x.shape[1]) for rng in rngs])
    at = np.clip(np.arange(x.shape[2]) - shift[..., None], 0, x.shape[2] - 1)
    return picked(x, np.arange(x.shape[1])[:, None], at)


@kernel("resolution_limit")
def _(x, i, rngs):
    h, w = x.shape[1:3]
    return resize(resize(x, max(4, int(h * (1 - 0.8 * i))), max(4, int(w * (1 - 0.8 * i)))), h, w)


@kernel("grayscale")
def _(x, i, rngs):
    return np.repeat(gray(x)[..., None], 3, -1)


@kernel("sharpness")
def _(x, i, rngs):
    sharp = convolve(x, np.array([[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]], float))
    return (1 - i) * x + i * sharp


@kernel("contrast")
def _(x, i, rngs):
    mean = stacked(x.reshape(len(x), -1).mean(1))
    return mean + (x - mean) * stacked([rng.uniform(1 - 0.5 * i, 1 + 0.5 * i) for rng in rngs])


@kernel("block_lost")
def _(x, i, rngs):
    all_, draws = lost_blocks(x, i, rngs)
    out = x.copy()
    for key, own in alike([lost.tobytes() for lost in draws], len(x)).items():
        for b, gone in zip(all_, np.frombuffer(key, bool), strict=True):
            if gone:
                out[(own, *b)] = 128 / 255
    return out


@kernel("block_interpolation")
def _(x, i, rngs):
    all_, draws = lost_blocks(x, i, rngs)
    out = x.copy()  # filled in place: later blocks see earlier fills
    for key, own in alike([lost.tobytes() for lost in draws], len(x)).items():
        for (rows, cols), gone in zip(all_, np.frombuffer(key, bool), strict=True):
            if gone:
                above = out[own, rows.start - 1 if rows.start else rows.start, cols]
                below = out[own, rows.stop, cols] if rows.stop < x.shape[1] else above
                t = (np.arange(rows.stop - rows.start) + 1)[:, None, None] / (rows.stop - rows.start + 1)
                out[own, rows, cols] = above[:, None] * (1 - t) + below[:, None] * t
    return out


@kernel("block_exchange")
def _(x, i, rngs):
    all_ = [b for b in blocks(x.shape[1:]) if b[0].stop - b[0].start == 16 == b[1].stop - b[1].start]
    out, swaps = x.copy(), max(1, int(len(all_) * (0.01 + 0.29 * i) / 2))
    draws = [tuple(rng.permutation(len(all_))[: 2 * swaps].tolist()) for rng in rngs]
    for order, own in alike(draws, len(x)).items():
        for a, b in zip(order[::2], order[1::2], strict=False):
            out[(own, *all_[a])], out[(own, *all_[b])] = x[(own, *all_[b])], x[(own, *all_[a])]
    return out


#: Bytes of an image array (as doubles) that a kernel works on at a time, so that its steps stay in the processor's cache.
BLOCK = 1 << 19


def at_a_time(shape: tuple) -> int:
    """Images of a shape that go together."""
    return max(1, BLOCK // max(1, 8 * int(np.prod(shape))))


def keep_freed_arrays() -> None:
    """An array as large as this that was freed once, untouched, makes the C library keep smaller ones that are freed after it
    instead of taking them anew, page by page."""
    np.empty(31 << 20, np.uint8)


def unit(images: np.ndarray) -> np.ndarray:
    return images.astype(np.float64) / 255 if images.dtype == np.uint8 else np.asarray(images, np.float64)


class Distorter:
    """One generator for each distortion; it advances with every image."""

    def __init__(self, name: str, seed: int | None = 42):
        if name not in KERNELS:
            raise ValueError(f"unknown distortion: {name}")
        self.kernel, self.rng = KERNELS[name], np.random.RandomState(seed)

    def apply(self, image: np.ndarray, intensity: float) -> np.ndarray:
        return to_uint8(self.kernel(unit(image)[None], float(np.clip(intensity, 0, 1)), [self.rng])[0])


def psnr(x: np.ndarray, y: np.ndarray) -> float:
    """Of a batch, with its small constant."""
    d = x.astype(np.float64) / 255 - y.astype(np.float64) / 255
    return float(10 * np.log10(1 / ((d * d).mean() + 1e-8)))


def _blurred(x: np.ndarray) -> np.ndarray:
    return gaussian(x, 11, 1.5)


def ssim(x: np.ndarray, y: np.ndarray) -> float:
    """11 x 11 Gaussian of 1.5, reflected borders, mean over the map."""
    a, b = x.astype(np.float64)[None] / 255, y.astype(np.float64)[None] / 255
    ma, mb = _blurred(a), _blurred(b)
    va, vb, cov = _blurred(a * a) - ma * ma, _blurred(b * b) - mb * mb, _blurred(a * b) - ma * mb
    c1, c2 = 0.01**2, 0.03**2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


@lru_cache(64)
def _blurring(n: int, start: int, stop: int) -> np.ndarray:
    """``_blurred`` along a side of n pixels: what pixels from start to stop take from the five before up to the five after them."""
    return convolve(np.eye(n)[..., None], weights(11, 1.5)[:, None])[start:stop, max(0, start - 5) : stop + 5, 0]


#: Pixels of a side whose blur is one product of matrices, which takes less time than to add up shifted images.
STRIP = 32


class Originals:
    """Images (n, h, w, 3) of bytes, to be compared with many versions of them.

    Images are kept last, as (h, w, 3 n), and bytes as whole numbers, whose sums of squares are exact.
    """

    C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2

    def __init__(self, images: np.ndarray):
        self.n, self.size = len(images), images[0].size
        self.x, self.half, self.done = np.empty((3, 3, *images.shape[1:3], 3 * self.n))
        self.a = self._last(images, np.empty_like(self.x[0]))
        self.x[0], self.x[1], self.x[2] = self.a, self.a * self.a, 0
        self.ones = np.ones(self.size)
        self.total = self._by_image(self.x[1])
        self.mean, self.variance, _ = self._blurred().copy()
        self.mean_square = self.mean * self.mean
        self.variance -= self.mean_square
        self.mean_square += self.C1
        self.variance += self.C2

    def _last(self, images: np.ndarray, out: np.ndarray) -> np.ndarray:
        out.reshape(*images.shape[1:], self.n)[:] = np.moveaxis(images, 0, -1)
        return out

    def _blurred(self) -> np.ndarray:
        k, h, w, _ = self.x.shape
        for y in range(0, h, STRIP):
            rows = slice(max(0, y - 5), y + STRIP + 5)
            np.matmul(_blurring(h, y, y + STRIP), self.x[:, rows].reshape(k, -1, w * 3 * self.n), out=self.half[:, y : y + STRIP].reshape(k, -1, w * 3 * self.n))
        for z in range(0, w, STRIP):
            np.matmul(_blurring(w, z, z + STRIP), self.half[:, :, max(0, z - 5) : z + STRIP + 5], out=self.done[:, :, z : z + STRIP])
        return self.done

    def _by_image(self, x: np.ndarray) -> np.ndarray:
        return self.ones @ x.reshape(-1, self.n)

    def against(self, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """PSNR and SSIM of each image."""
        b, square, both = self.x
        self._last(images, b)
        np.multiply(b, b, out=square)
        np.multiply(b, self.a, out=both)
        error = (self.total + self._by_image(square) - 2 * self._by_image(both)) / (self.size * 255**2)
        (mean, variance, cov), means = self._blurred(), b
        np.multiply(self.mean, mean, out=means)
        mean *= mean
        variance -= mean
        variance += self.variance
        mean += self.mean_square
        variance *= mean
        cov -= means
        cov += self.C2 / 2
        means += self.C1 / 2
        cov *= means
        cov /= variance
        return 10 * np.log10(1 / (error + 1e-8)), self._by_image(cov) * (4 / self.size)


def like(ref: np.ndarray, image: np.ndarray) -> np.ndarray:
    """A reference resized to an image, as bytes."""
    return ref if ref.shape == image.shape else np.round(np.clip(resize(ref.astype(np.float64), *image.shape[:2]), 0, 255)).astype(np.uint8)


def psnr_of_one(ref: np.ndarray | None, image: np.ndarray) -> float:
    """Of bytes, without a constant (infinite for equal images); 0 without a reference."""
    if ref is None:
        return 0.0
    d = like(ref, image).astype(np.float64) - image
    error = (d * d).mean()
    return float(10 * np.log10(255**2 / error)) if error else float("inf")


def ssim_of_one(ref: np.ndarray | None, image: np.ndarray, size: int = 7) -> float:
    """Uniform windows of size x size pixels within the image, sample covariance, mean over channels; 0 without a reference."""
    return ssim_of_many([image], [ref], size)[0]


def of_one_shape(images: list[np.ndarray], refs: list[np.ndarray | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Images that have a reference, by shape: their places, and both sides as arrays of doubles."""
    shapes: dict = {}
    for k, (x, r) in enumerate(zip(images, refs, strict=True)):
        if r is not None:
            shapes.setdefault(x.shape, []).append(k)
    for shape, all_ in shapes.items():
        step = at_a_time(shape)
        for i in range(0, len(all_), step):
            places = all_[i : i + step]
            yield places, np.stack([like(refs[k], images[k]) for k in places]).astype(np.float64), np.stack([images[k] for k in places]).astype(np.float64)


def windows(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums of ``size`` neighbours along an axis, by sums of 1, 2, 4 and so on of them."""
    n, at, length, out, part = max(0, x.shape[axis] - size + 1), 0, 1, 0, np.moveaxis(x, axis, 0)
    while True:
        if size & length:
            out, at = out + part[at : at + n], at + length
        if 2 * length > size:
            return np.moveaxis(out, 0, axis)
        part, length = part[:-length] + part[length:], 2 * length


def ssim_of_many(images: list[np.ndarray], refs: list[np.ndarray | None], size: int = 7) -> list[float]:
    """``ssim_of_one`` of a batch."""
    out = [0.0] * len(images)

    exact = np.float32 if 255**2 * size**2 <= 1 << 24 else np.float64  # sums of bytes and of their products are whole numbers
    n, c1, c2 = size**2 / (size**2 - 1), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    for places, a, b in of_one_shape(images, refs):
        sums = np.empty((5, *a.shape), exact)
        sums[0], sums[1] = a, b
        for k, (x, y) in enumerate(((0, 0), (1, 1), (0, 1)), 2):
            np.multiply(sums[x], sums[y], out=sums[k])
        ma, mb, maa, mbb, mab = windows(windows(sums, size, 2), size, 3).astype(np.float64) / size**2
        va, vb, cov = n * (maa - ma * ma), n * (mbb - mb * mb), n * (mab - ma * mb)
        map_ = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
        for k, value in zip(places, map_.reshape(len(places), -1).mean(1).tolist(), strict=True):
            out[k] = value
    return out


def psnr_of_many(images: list[np.ndarray], refs: list[np.ndarray | None]) -> list[float]:
    """``psnr_of_one`` of a batch: images of one shape are compared as one array."""
    out = [0.0] * len(images)
    for places, a, b in of_one_shape(images, refs):
        d = a - b
        for k, error in zip(places, (d * d).mean((1, 2, 3)), strict=True):
            out[k] = float(10 * np.log10(255**2 / error)) if error else float("inf")
    return out


class Method(NamedTuple):
    """A measure: ``score`` takes an image and its reference (or None); where ``batched``, lists of both, and gives a list."""

    score: Callable
    batched: bool = False


#: Methods that need no model, by name.
METHODS: dict[str, Method] = {"psnr": Method(psnr_of_many, True), "ssim": Method(ssim_of_many, True)}


def by_method(method: Method, images: list, refs: list) -> list[tuple[float | None, str | None]]:
    """(score, error) of each row; a batch that fails is tried row by row."""
    try:
        found = method.score(images, refs) if method.batched else [method.score(images[0], refs[0])]
        if len(found) != len(images):
            raise ValueError(f"{len(found)} scores for {len(images)} images")
        return [(float(v), None) for v in found]
    except Exception as e:  # noqa: BLE001  a method's failure is a row's error, not the job's
        if len(images) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [by_method(method, images[k : k + 1], refs[k : k + 1])[0] for k in range(len(images))]


def pixels(data: bytes, h: float, w: float) -> np.ndarray:
    """The image of RGB bytes; ValueError or TypeError where a size is missing or doesn't fit."""
    return np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)


def scored(pdf: pd.DataFrame, names: list[str], used: dict[str, Method], batch: int) -> pd.DataFrame:
    """``score_methods`` of some rows."""
    found = {n: [(None, None)] * len(pdf) for n in used}
    fine, images, refs = [], [], []
    for k, r in enumerate(pdf.itertuples(index=False)):
        try:
            image, ref = pixels(r.image, r.h, r.w), None if r.ref is None else pixels(r.ref, r.ref_h, r.ref_w)
        except (ValueError, TypeError, AttributeError) as e:
            for n in used:
                found[n][k] = (None, f"{type(e).__name__}: {e}")
            continue
        fine.append(k), images.append(image), refs.append(ref)
    for n, method in used.items():
        step = max(1, batch) if method.batched else 1
        for i in range(0, len(fine), step):
            for k, pair in zip(fine[i : i + step], by_method(method, images[i : i + step], refs[i : i + step]), strict=True):
                found[n][k] = pair
    return pd.concat([pdf[names].assign(method=n, score=[float("nan") if v is None else v for v, _ in got], error=[e for _, e in got]) for n, got in found.items()])


def methods_of(methods: dict[str, Method | Callable] | None) -> dict[str, Method]:
    return {n: m if isinstance(m, Method) else Method(m) for n, m in (METHODS if methods is None else methods).items()}


def score_methods(pairs: DataFrame, methods: dict[str, Method | Callable] | None = None, batch: int = 16) -> DataFrame:
    """Rows (image, ref, h, w, ref_h, ref_w) with a line for each method: method, score, error.

    A batched method gets ``batch`` rows at a time, any other one row.  A method that fails on a row, or a row
    without an image, leaves an error there, and the other methods and rows go on.
    """
    used, names = methods_of(methods), [c for c in pairs.columns if c not in ("image", "ref")]
    schema = StructType([pairs.schema[c] for c in names]).add("method", "string").add("score", "double").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield scored(pdf, names, used, batch)

    out = pairs.mapInPandas(run, schema)
    return out.withColumn("score", F.when(F.col("error").isNull(), F.col("score")))


def log_polar_feature(image: np.ndarray, patch: int = 32, stride: int = 16, radii: int = 32, angles: int = 16) -> np.ndarray:
    """Mean over patches of the shifted spectrum's magnitude in log-polar bins; negative angles go to bin 0."""
    x = gray(image.astype(np.float64) / 255)
    y, z = np.mgrid[:patch, :patch] - patch // 2
    r = np.log1p(np.hypot(y, z)) / np.log1p(np.hypot(patch // 2, patch // 2))
    at = np.clip((r * radii).astype(int), 0, radii - 1) * angles + np.clip((np.arctan2(y, z) / np.pi * angles).astype(int), 0, angles - 1)
    total, n = np.zeros(radii * angles), 0
    for i in range(0, x.shape[0] - patch + 1, stride):
        for j in range(0, x.shape[1] - patch + 1, stride):
            m = np.abs(np.fft.fftshift(np.fft.fft2(x[i : i + patch, j : j + patch])))
            total += np.bincount(at.ravel(), m.ravel(), radii * angles)
            n += 1
    return (total / max(n, 1)).reshape(radii, angles)


def log_polar_features(images: DataFrame) -> DataFrame:
    """Rows (image, h, w) with ``feature``, 32 x 16 numbers by radius and angle, and an ``error`` where there is no image."""
    schema = StructType([*images.schema.fields]).add("feature", ArrayType(DoubleType())).add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            features, errors = [], []
            for r in pdf.itertuples(index=False):
                try:
                    features.append(log_polar_feature(pixels(r.image, r.h, r.w)).ravel())
                    errors.append(None)
                except (ValueError, TypeError, AttributeError) as e:
                    features.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(feature=features, error=errors)

    return images.mapInPandas(run, schema)


def test_image(size: int = 64) -> np.ndarray:
    """Gradient with a disc and a rectangle."""
    y, z = np.mgrid[:size, :size]
    out = np.stack([y * 255 // size, z * 255 // size, (y + z) * 255 // (2 * size)], -1).astype(np.uint8)
    out[(y - size // 3) ** 2 + (z - size // 3) ** 2 < (size // 6) ** 2] = (220, 40, 40)
    out[size // 2 : size * 3 // 4, size // 2 : size * 7 // 8] = (40, 60, 200)
    return out


def seed_of(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest(), 16) % 2**31


#: Numbers drawn for all seeds together; a seed that none of them serves (3/8 to this power) gets a generator of its own.
DRAWS = 16
SHIFT = 397


def choices(seeds: np.ndarray) -> np.ndarray:
    """``RandomState(seed).choice(INTENSITIES)`` of many seeds: the generator's first numbers need the start of its state only."""
    with np.errstate(over="ignore"):
        state = np.empty((SHIFT + DRAWS, len(seeds)), np.uint32)
        state[0] = seeds
        for k in range(1, len(state)):
            state[k] = np.uint32(1812433253) * (state[k - 1] ^ (state[k - 1] >> np.uint32(30))) + np.uint32(k)
    y = (state[:DRAWS] & np.uint32(0x80000000)) | (state[1 : DRAWS + 1] & np.uint32(0x7FFFFFFF))
    y = state[SHIFT:] ^ (y >> np.uint32(1)) ^ ((y & np.uint32(1)) * np.uint32(0x9908B0DF))
    y ^= y >> np.uint32(11)
    y ^= (y << np.uint32(7)) & np.uint32(0x9D2C5680)
    y ^= (y << np.uint32(15)) & np.uint32(0xEFC60000)
    y ^= y >> np.uint32(18)
    drawn = y & np.uint32((1 << (len(INTENSITIES) - 1).bit_length()) - 1)
    fits = drawn < len(INTENSITIES)
    out = np.array(INTENSITIES, np.float64)[np.where(fits, drawn, 0)[fits.argmax(0), np.arange(len(seeds))]]
    for k in np.flatnonzero(~fits.any(0)):
        out[k] = np.random.RandomState(int(seeds[k])).choice(INTENSITIES)
    return out


@F.pandas_udf(DoubleType())
def pick_intensity(keys: pd.Series) -> pd.Series:
    """the level a Mersenne Twister seeded by the key's digest chooses."""
    return pd.Series(choices(np.fromiter(map(seed_of, keys), np.uint32, len(keys))))


#: Bytes of images that a task holds before it passes them on.
HELD = 4 << 20


def tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has: image work is long, so small tables are dealt to all of them, too."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Stream:
    """The generator of a group between its images: its seed, and its state once it was used."""

    def __init__(self, name: str, seed: int):
        if name not in KERNELS:
            raise ValueError(f"unknown distortion: {name}")
        if not 0 <= seed < 1 << 32:
            raise ValueError("Seed must be between 0 and 2**32 - 1")
        self.seed, self.state, self.waiting, self.ended = seed, None, 0, False

    def keep(self, rng: np.random.RandomState) -> None:
        """A copy of the state takes long, so it is made for further images only."""
        if self.waiting or not self.ended:
            self.state = rng.get_state()


def generators(streams: Iterable[Stream], rng: np.random.RandomState) -> Iterator[np.random.RandomState]:
    """The stream of each image in turn, all by one generator, as making one takes much longer than to seed it."""
    last = None
    for s in streams:
        if s is not last:
            if last is not None:
                last.keep(rng)
            if s.state is None:
                rng.seed(s.seed)
            else:
                rng.set_state(s.state)
            last = s
        s.waiting -= 1
        yield rng
    if last is not None:
        last.keep(rng)


class Waiting:
    """Images of a batch that wait for others of their distortion, intensity and shape, to be distorted as one array."""

    def __init__(self, rows: int, rng: np.random.RandomState):
        self.done, self.errors, self.rng = [None] * rows, [None] * rows, rng
        self.kinds: dict = {}
        self.kind_of: dict = {}

    def add(self, row: int, name: str, intensity: float, image: np.ndarray, stream: Stream) -> None:
        kind = (name, intensity, image.shape)
        if self.kind_of.setdefault(stream, kind) != kind:
            self.distort()  # the stream goes on to another kind after its images so far
            self.kind_of[stream] = kind
        self.kinds.setdefault(kind, []).append((row, image, stream))
        stream.waiting += 1

    def distort(self) -> None:
        for (name, intensity, shape), rows in self.kinds.items():
            step = at_a_time(shape)
            for i in range(0, len(rows), step):
                self._distort(name, intensity, rows[i : i + step])
        self.kinds, self.kind_of = {}, {}

    def _distort(self, name: str, intensity: float, rows: list[tuple]) -> None:
        places, images, streams = zip(*rows, strict=True)
        states = [(s, s.state, s.waiting) for s in dict.fromkeys(streams)]
        try:
            done = to_uint8(KERNELS[name](unit(np.stack(images)), intensity, generators(streams, self.rng)))
            for k, image in zip(places, done, strict=True):
                self.done[k] = image.tobytes()
        except (ValueError, TypeError, AttributeError) as e:
            if len(rows) == 1:
                self.errors[places[0]] = f"{type(e).__name__}: {e}"
                return
            for s, s.state, s.waiting in states:
                pass
            for row in rows:
                self._distort(name, intensity, [row])

    def finished(self, pdf: pd.DataFrame, first: int, end: int) -> pd.DataFrame:
        """Rows from first up to end with what was made of them."""
        self.distort()
        out = pdf.iloc[first:end].assign(distorted=self.done[first:end], error=self.errors[first:end])
        self.done[first:end] = [None] * (end - first)
        return out


def distorted(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """``distort_groups`` of rows by group, passed on when they have more than ``most`` bytes of images."""
    keep_freed_arrays()
    group, stream, fault, rng = (), None, None, np.random.RandomState()
    for pdf in batches:
        first, held, work = 0, 0, Waiting(len(pdf), rng)
        for k, r in enumerate(pdf.itertuples(index=False)):
            if (r.dataset, r.frame, r.distortion) != group:
                if stream:
                    stream.ended = True
                group, stream, fault = (r.dataset, r.frame, r.distortion), None, None
                try:
                    stream = Stream(r.distortion.split("@")[0], int(r.seed))
                except (ValueError, TypeError, AttributeError) as e:
                    fault = f"{type(e).__name__}: {e}"
            try:
                if stream:
                    if pd.isna(r.intensity):
                        raise ValueError("no intensity")
                    work.add(k, r.distortion.split("@")[0], min(max(float(r.intensity), 0.0), 1.0), pixels(r.image, r.h, r.w), stream)
                    held += len(r.image)
                else:
                    work.errors[k] = fault
            except (ValueError, TypeError, AttributeError) as e:
                work.errors[k] = f"{type(e).__name__}: {e}"
            if held > most:
                yield work.finished(pdf, first, k + 1)
                first, held = k + 1, 0
        if first < len(pdf):
            yield work.finished(pdf, first, len(pdf))


def by_group(views: DataFrame) -> DataFrame:
    """Groups as sorted streams, those of a distortion on end, as their images are distorted together."""
    return views.repartition(tasks(views), "dataset", "frame", "distortion").sortWithinPartitions("distortion", "dataset", "frame", "view", "image")


def distort_groups(views: DataFrame) -> DataFrame:
    """(dataset, frame, distortion, intensity, seed, view, image bytes, h, w) with ``distorted`` bytes.

    A group's views share one generator, made from the seed of the first, and pass it in order of view and bytes: groups
    come to a task as a sorted stream, and a task holds some MB of images, however many views a group has.  An image
    that fails, a null one too, has no ``distorted`` but an ``error`` (P13); null keys are a group like others.
    """
    most = HELD
    return by_group(views).mapInPandas(lambda batches: distorted(batches, most), StructType([*views.schema.fields]).add("distorted", "binary").add("error", "string"))


def enlarged(batches: Iterator[pd.DataFrame], scale: int, most: int) -> Iterator[pd.DataFrame]:
    """Rows whose pixels become squares of ``scale`` pixels a side, about ``most`` bytes at a time; an image that doesn't fit its size stays as it is."""
    for pdf in batches:
        first, held, images, sides = 0, 0, [], []
        for k, (data, h, w) in enumerate(zip(pdf["image"], pdf["h"], pdf["w"], strict=True)):
            try:
                images.append(pixels(data, h, w).repeat(scale, 0).repeat(scale, 1).tobytes())
                sides.append((h * scale, w * scale))
                held += len(images[-1])
            except (ValueError, TypeError):
                images.append(data), sides.append((h, w))
            if held > most or k == len(pdf) - 1:
                yield pdf.iloc[first : k + 1].assign(image=images, h=[h for h, _ in sides], w=[w for _, w in sides])
                first, held, images, sides = k + 1, 0, [], []


def score_groups(views: DataFrame, methods: dict[str, Method | Callable] | None = None, scale: int = 1, batch: int = 64) -> DataFrame:
    """``distort_groups`` and ``score_methods`` in one pass: rows without their image, with a line for each method:
    ``pixels_md5`` of the distorted image, method, score against the given image, error.

    No image leaves the task, and those that are made of squares of ``scale`` pixels a side are drawn there (``h`` and ``w``
    count squares), so that what is shuffled and sorted is a fraction of the pixels.
    """
    used, names = methods_of(methods), [c for c in views.columns if c not in ("image", "h", "w")]
    schema = StructType([views.schema[c] for c in names]).add("pixels_md5", "string").add("method", "string").add("score", "double").add("error", "string")

    most = HELD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in distorted(enlarged(batches, scale, most) if scale > 1 else batches, most):
            digests = [None if x is None else hashlib.md5(x).hexdigest() for x in pdf["distorted"]]
            pairs = pdf.assign(pixels_md5=digests, ref=pdf["image"], image=pdf["distorted"], ref_h=pdf["h"], ref_w=pdf["w"])
            yield scored(pairs, [*names, "pixels_md5"], used, batch)

    out = by_group(views).mapInPandas(run, schema)
    return out.withColumn("score", F.when(F.col("error").isNull(), F.col("score")))


#: Every distortion at every level.
CELLS = [(n, float(i)) for n in DISTORTIONS for i in INTENSITIES]


def catalogue_figures(images: np.ndarray, rng: np.random.RandomState) -> list[tuple[np.ndarray, np.ndarray]]:
    """PSNR and SSIM of images (n, h, w, 3) of bytes at each of ``CELLS``.

    What all levels of a distortion have in common is made once, and so is a distortion that is another one by a further name;
    a level that gives the bytes of the one before has its figures.
    """
    x, originals, shared, known, last, figures = unit(images), Originals(images), (None, ()), {}, None, ()
    for name, intensity in CELLS:
        if shared[0] != name:
            shared = name, (SHARED[name](x),) if name in SHARED else ()
        if (KERNELS[name], intensity) not in known:
            rng.seed(42)
            done = to_uint8(KERNELS[name](x, intensity, [rng], *shared[1]))
            if last is None or not np.array_equal(done, last):
                last, figures = done, originals.against(done)
            known[KERNELS[name], intensity] = figures
    return [known[KERNELS[name], intensity] for name, intensity in CELLS]


def catalogue_sweep(images: DataFrame) -> DataFrame:
    """Every distortion at every level on every row (name, image, h, w): name, distortion, intensity, psnr, ssim.

    Each cell has a generator of its own, with the same draws for every image of a size.  A row without an image gives no
    line.  The images are dealt once; their 180 versions come and go within a task, some images at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_freed_arrays()
        rng = np.random.RandomState()
        for pdf in batches:
            sizes: dict = {}
            for name, data, h, w in zip(pdf["name"], pdf["image"], pdf["h"], pdf["w"], strict=True):
                image = pixels(data, h, w)
                sizes.setdefault(image.shape, []).append((name, image))
            for shape, rows in sizes.items():
                step = at_a_time(shape)
                for i in range(0, len(rows), step):
                    names, found = zip(*rows[i : i + step], strict=True)
                    yield measured(pd.Series(names, dtype=pdf["name"].dtype), np.stack(found), rng)

    def measured(names: pd.Series, images: np.ndarray, rng: np.random.RandomState) -> pd.DataFrame:
        figures = catalogue_figures(images, rng)
        out = pd.DataFrame({"name": pd.concat([names] * len(CELLS), ignore_index=True)})
        kinds = {"distortion": np.repeat([n for n, _ in CELLS], len(images)), "intensity": np.repeat([i for _, i in CELLS], len(images))}
        return out.assign(**kinds, **{c: np.concatenate([f[k] for f in figures]) for k, c in enumerate(("psnr", "ssim"))})

    fine = images.select("name", "image", "h", "w").where("image IS NOT NULL AND h > 0 AND w > 0 AND octet_length(image) = 3 * h * w")
    return fine.repartition(tasks(fine), "name").mapInPandas(run, StructType([fine.schema["name"]]).add("distortion", "string").add("intensity", "double").add("psnr", "double").add("ssim", "double"))
