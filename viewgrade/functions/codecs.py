"""Two lossy image codecs in numpy, as whole encoders and decoders.

They follow the building blocks of the formats that they stand for, not the formats' files: a wavelet codec that keeps the
upper bit planes of its coefficients, and a codec that predicts blocks from what is decoded before them.  Images are
uint8 (h, w, 3) of at most 65,535 pixels a side; qualities go from 1 to 100.  ``wavelet_lossy`` and ``predicted_lossy`` take
many images (n, h, w, 3) to what their decoders give for what their encoders write, without the bytes between.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

LEVELS = 3


def padded(plane: np.ndarray, n: int) -> np.ndarray:
    return np.pad(plane, ((0, -plane.shape[0] % n), (0, -plane.shape[1] % n), *[(0, 0)] * (plane.ndim - 2)), mode="edge")


# ---- wavelets and bit planes ----------------------------------------------------------------------------


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to smooth and detail rows, by whole-number lifting over two and over four neighbours; reversible."""
    even, odd = x[::2], x[1::2]
    detail = odd - ((even + np.concatenate([even[1:], even[-1:]])) >> 1)
    return even + ((np.concatenate([detail[:1], detail[:-1]]) + detail + 2) >> 2), detail


def merge(smooth: np.ndarray, detail: np.ndarray) -> np.ndarray:
    even = smooth - ((np.concatenate([detail[:1], detail[:-1]]) + detail + 2) >> 2)
    out = np.empty((2 * len(even), *even.shape[1:]), even.dtype)
    out[::2], out[1::2] = even, detail + ((even + np.concatenate([even[1:], even[-1:]])) >> 1)
    return out


def cut_planes(quality: int, level: int, colour: bool) -> int:
    """Bit planes that a band loses: fewer at coarse levels, where a coefficient counts for more pixels; none at quality 100."""
    return max(0, round(7 * (100 - quality) / 100 - level + colour)) if quality < 100 else 0


def wavelet_encode(image: np.ndarray, quality: int) -> bytes:
    """Whole-number colour planes, a wavelet pyramid of three levels, and of each band its signs and bit planes from the top."""
    h, w = image.shape[:2]
    r, g, b = (padded(image[..., k].astype(np.int64), 1 << LEVELS) for k in range(3))
    out = bytearray()

    def keep(band: np.ndarray, cut: int) -> None:
        size, top = np.abs(band), int(np.abs(band).max(initial=0)).bit_length()
        out.append(top)
        if top > cut:
            out.extend(np.packbits(band < 0).tobytes())
            for plane in range(top - 1, cut - 1, -1):
                out.extend(np.packbits((size >> plane) & 1).tobytes())

    for k, low in enumerate(((r + 2 * g + b) >> 2, b - g, r - g)):
        for level in range(LEVELS):
            upper, lower = split(low)
            (low, across), (down, both) = ([x.T for x in split(y.T)] for y in (upper, lower))
            for band in (across, down, both):
                keep(band, cut_planes(quality, level, k > 0))
        keep(low, 0)
    return struct.pack("<HHB", h, w, quality) + zlib.compress(bytes(out), 6)


def wavelet_decode(data: bytes) -> np.ndarray:
    h, w, quality = struct.unpack_from("<HHB", data)
    raw, at = zlib.decompress(data[5:]), 0
    shape = (h + -h % (1 << LEVELS), w + -w % (1 << LEVELS))

    def take(shape: tuple[int, int], cut: int) -> np.ndarray:
        nonlocal at
        top, n = raw[at], shape[0] * shape[1]
        at += 1
        if top <= cut:
            return np.zeros(shape, np.int64)

        def bits() -> np.ndarray:
            nonlocal at
            at += -(-n // 8)
            return np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at - -(-n // 8)), count=n).astype(np.int64)

        sign, size = bits(), np.zeros(n, np.int64)
        for plane in range(top - 1, cut - 1, -1):
            size |= bits() << plane
        if cut:
            size += (size > 0) * (1 << (cut - 1))  # the middle of what the lost planes leave open
        return np.where(sign == 1, -size, size).reshape(shape)

    planes = []
    for k in range(3):
        details = []
        for level in range(LEVELS):
            part = (shape[0] >> (level + 1), shape[1] >> (level + 1))
            details.append([take(part, cut_planes(quality, level, k > 0)) for _ in range(3)])
        low = take((shape[0] >> LEVELS, shape[1] >> LEVELS), 0)
        for across, down, both in reversed(details):
            low = merge(merge(low.T, across.T).T, merge(down.T, both.T).T)
        planes.append(low)
    y, u, v = planes
    g = y - ((u + v) >> 2)
    return np.clip(np.stack([v + g, g, u + g], -1)[:h, :w], 0, 255).astype(np.uint8)


def wavelet_lossy(images: np.ndarray, quality: int) -> np.ndarray:
    """The last axis of a plane goes over the images."""
    h, w = images.shape[1:3]
    r, g, b = (padded(np.moveaxis(images[..., k], 0, -1).astype(np.int32), 1 << LEVELS) for k in range(3))
    turned = lambda x: x.swapaxes(0, 1)

    def lossy(band: np.ndarray, cut: int) -> np.ndarray:
        if not cut:
            return band
        size = np.abs(band) >> cut << cut
        size += (size > 0) * np.int32(1 << (cut - 1))
        return np.where(band < 0, -size, size)

    planes = []
    for k, low in enumerate(((r + 2 * g + b) >> 2, b - g, r - g)):
        details = []
        for level in range(LEVELS):
            upper, lower = split(low)
            (low, across), (down, both) = ([turned(x) for x in split(turned(y))] for y in (upper, lower))
            details.append([lossy(band, cut_planes(quality, level, k > 0)) for band in (across, down, both)])
        for across, down, both in reversed(details):
            low = merge(turned(merge(turned(low), turned(across))), turned(merge(turned(down), turned(both))))
        planes.append(low)
    y, u, v = planes
    g = y - ((u + v) >> 2)
    return np.moveaxis(np.clip(np.stack([v + g, g, u + g], 2)[:h, :w], 0, 255).astype(np.uint8), -1, 0)


# ---- prediction -----------------------------------------------------------------------------------------

TRANSFORM = np.sqrt(2 / 4) * np.cos(np.pi * (2 * np.arange(4)[None, :] + 1) * np.arange(4)[:, None] / 8)
TRANSFORM[0] /= np.sqrt(2)
FLAT, DOWN, ACROSS, MOTION = range(4)


def step_of(quality: int, colour: bool) -> float:
    return (2 + (100 - quality) * 0.9) * (1.2 if colour else 1)


def predictions(above: np.ndarray, left: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Four forecasts (4, n, size, size) of a block of n images: the mean of its borders, columns from above, rows from the left, and both less the corner."""
    out = np.empty((4, *above.shape, above.shape[1]))
    out[FLAT] = np.round((above.mean(1) + left.mean(1)) / 2)[:, None, None]
    out[DOWN], out[ACROSS] = above[:, None, :], left[:, :, None]
    out[MOTION] = np.clip(above[:, None, :] + left[:, :, None] - corner[:, None, None], 0, 255)
    return out


def by_blocks(shape: tuple[int, int], size: int, step: float, code: Callable[[int, int, np.ndarray], tuple[int, np.ndarray]]) -> np.ndarray:
    """``planes_by_blocks`` of one image: forecasts (4, size, size), one number for the one taken, coefficients (rows, columns, 4, 4)."""

    def one(y: int, x: int, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mode, whole = code(y, x, guess[:, 0])
        return np.array([mode]), whole[None]

    return planes_by_blocks(1, shape, size, np.array([step]), one)[0]


def planes_by_blocks(n: int, shape: tuple[int, int], size: int, step: np.ndarray, code: Callable[[int, int, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A plane of n images block by block, each predicted from those above and to the left as they are decoded.

    ``code``: row, column and forecasts to the forecasts taken (n) and the whole coefficients (n, rows, columns, 4, 4) of what
    is left.  ``step``: one number, or one an image.
    """
    done, step = np.full((n, shape[0] + 1, shape[1] + 1), 128.0), step[:, None, None, None, None]  # a border of gray
    for y in range(0, shape[0], size):
        for x in range(0, shape[1], size):
            guess = predictions(done[:, y, x + 1 : x + 1 + size], done[:, y + 1 : y + 1 + size, x], done[:, y, x])
            mode, whole = code(y, x, guess)
            rest = (TRANSFORM.T @ (whole * step) @ TRANSFORM).transpose(0, 1, 3, 2, 4).reshape(n, size, size)
            done[:, y + 1 : y + 1 + size, x + 1 : x + 1 + size] = np.clip(np.round(guess[mode, np.arange(n)] + rest), 0, 255)
    return done[:, 1:, 1:]


def _planes(h: int, w: int) -> list[tuple[tuple[int, int], int]]:
    """Shape and block size of brightness and of the two colours, which have half its pixels a side."""
    h16, w16 = h + -h % 16, w + -w % 16
    return [((h16, w16), 16), ((h16 // 2, w16 // 2), 8), ((h16 // 2, w16 // 2), 8)]


def _predicted(images: np.ndarray, qualities: list[int], keep: Callable[[np.ndarray, np.ndarray], None] | None = None) -> list[np.ndarray]:
    """The three planes as a decoder gets them; ``keep`` sees the forecasts taken and the coefficients of each block."""
    n, h, w = images.shape[:3]
    edge = ((0, 0), (0, -h % 16), (0, -w % 16))
    r, g, b = (np.pad(images[..., k].astype(np.float64), edge, mode="edge") for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    halved = lambda c: c.reshape(n, c.shape[1] // 2, 2, c.shape[2] // 2, 2).mean((2, 4))
    out = []
    for k, ((shape, size), plane) in enumerate(zip(_planes(h, w), (y, halved((b - y) * 0.564 + 128), halved((r - y) * 0.713 + 128)), strict=True)):
        step = np.array([step_of(q, k > 0) for q in qualities], np.float64)

        def code(i: int, j: int, guess: np.ndarray, plane=plane, size=size, step=step) -> tuple[np.ndarray, np.ndarray]:
            block = plane[:, i : i + size, j : j + size]
            mode = np.abs(block - guess).reshape(4, n, -1).sum(2).argmin(0)
            parts = (block - guess[mode, np.arange(n)]).reshape(n, size // 4, 4, size // 4, 4).transpose(0, 1, 3, 2, 4)
            whole = np.round(TRANSFORM @ parts @ TRANSFORM.T / step[:, None, None, None, None]).astype("<i2")
            if keep:
                keep(mode, whole)
            return mode, whole

        out.append(planes_by_blocks(n, shape, size, step, code))
    return out


def _coloured(planes: list[np.ndarray], h: int, w: int) -> np.ndarray:
    y, u, v = planes[0], *(c.repeat(2, 1).repeat(2, 2) - 128 for c in planes[1:])
    r, b = y + v / 0.713, y + u / 0.564
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    return np.clip(np.round(np.stack([r, g, b], -1)[:, :h, :w]), 0, 255).astype(np.uint8)


def predicted_lossy(images: np.ndarray, qualities: list[int]) -> np.ndarray:
    """One quality, or one an image."""
    return _coloured(_predicted(images, qualities), *images.shape[1:3])


def predicted_encode(image: np.ndarray, quality: int) -> bytes:
    """Blocks of 16 pixels (colours: 8) less their best forecast, as quantised 4 x 4 cosine coefficients."""
    modes, coefficients = bytearray(), []

    def keep(mode: np.ndarray, whole: np.ndarray) -> None:
        modes.append(int(mode[0]))
        coefficients.append(whole[0])

    _predicted(image[None], [quality], keep)
    body = b"".join(c.transpose(2, 3, 0, 1).tobytes() for c in coefficients)
    return struct.pack("<HHB", *image.shape[:2], quality) + zlib.compress(bytes(modes) + body, 6)


def predicted_decode(data: bytes) -> np.ndarray:
    h, w, quality = struct.unpack_from("<HHB", data)
    raw, layout = zlib.decompress(data[5:]), _planes(h, w)
    number = sum((shape[0] // size) * (shape[1] // size) for shape, size in layout)
    block, at, out = 0, number, []
    for k, (shape, size) in enumerate(layout):

        def code(_i: int, _j: int, _guess: np.ndarray, size=size) -> tuple[int, np.ndarray]:
            nonlocal block, at
            parts = size // 4
            whole = np.frombuffer(raw, "<i2", size * size, at).reshape(4, 4, parts, parts).transpose(2, 3, 0, 1)
            block, at = block + 1, at + 2 * size * size
            return raw[block - 1], whole

        out.append(by_blocks(shape, size, step_of(quality, k > 0), code)[None])
    return _coloured(out, h, w)[0]
