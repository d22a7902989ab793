"""Gray and color maps as arrays, row 0 at the bottom: files, runs, copies, filters, scaling."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# files

_WORDS = [b"%d" % x for x in range(256)]
_HEAD = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def _header(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError("the image header is cut off")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def read_pnm(data: bytes) -> tuple[np.ndarray, int]:
    """(map, gray levels) of PBM, PGM, PPM (text or raw) and R4 run-length files. Bitmaps and gray maps count ink: white is 0."""
    kind = data[:2]
    if kind == b"R4":
        (w, h), at = _header(data, 2, 2)
        return decode_runs(data[at + 1 :], w, h), 2
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no PNM file")
    (w, h), at = _header(data, 2, 2)
    top = 1
    if kind not in (b"P1", b"P4"):
        (top,), at = _header(data, at, 1)
    if kind == b"P4":
        stride = -(-w // 8)
        body = np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride)
        return np.unpackbits(body, axis=1)[:, :w][::-1].copy(), 2
    deep = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        body = np.frombuffer(data, np.uint8, offset=at)
        body = body[(body == 48) | (body == 49)][: w * h].astype(np.int64) - 48
    elif kind in (b"P2", b"P3"):
        words = re.sub(rb"#[^\n]*", b"", data[at:]).split() if b"#" in data else data[at:].split()
        body = np.array([int(v) for v in words[: w * h * deep]], np.int64)
    else:
        body = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * deep, at + 1).astype(np.int64)
    if len(body) < w * h * deep:
        raise ValueError("the image is cut off")
    if deep == 3:
        return (body.reshape(h, w, 3)[::-1] * 255 // top).astype(np.uint8), 256
    body = body.reshape(h, w)[::-1]
    return (body if kind == b"P1" else top - body).astype(np.uint8 if top < 256 else np.uint16), top + 1


def write_pnm(m: np.ndarray, grays: int = 2, raw: bool = True, runs: bool = False) -> bytes:
    """A PPM file of a color map; of others PBM (two levels), PGM, or with `runs` an R4 file."""
    h, w = m.shape[:2]
    rows = m[::-1]
    text = lambda v: b"\n".join(b" ".join([_WORDS[x] if 0 <= x < 256 else b"%d" % x for x in r]) for r in v.reshape(h, -1).tolist()) + b"\n"
    if m.ndim == 3:
        return b"P%d\n%d %d\n255\n" % (6 if raw else 3, w, h) + (rows.tobytes() if raw else text(rows))
    if runs:
        return b"R4\n%d %d\n" % (w, h) + encode_runs(m)
    if grays == 2:
        return b"P%d\n%d %d\n" % (4 if raw else 1, w, h) + (np.packbits(rows.astype(np.uint8), axis=1).tobytes() if raw else text(rows))
    return b"P%d\n%d %d\n%d\n" % (5 if raw else 2, w, h, grays - 1) + ((grays - 1 - rows).astype(np.uint8).tobytes() if raw else text(grays - 1 - rows.astype(np.int64)))


def encode_runs(m: np.ndarray) -> bytes:
    """Runs of white and black by turns, rows from the top: one byte below 192, two below 16384, longer ones in pieces."""
    h, w = m.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = m[::-1] > 0
    padded[:, -1] = 2
    row, edge = np.nonzero(np.diff(padded, axis=1))
    n = np.diff(edge, prepend=0)
    n[np.diff(row, prepend=-1) > 0] = edge[np.diff(row, prepend=-1) > 0]
    whole = np.maximum(n - 1, 0) // 0x3FFF
    n -= whole * 0x3FFF
    long = n >= 0xC0
    size = 3 * whole + 1 + long
    out = np.zeros(int(size.sum()), np.uint8)
    last = np.cumsum(size) - 1
    out[last] = n & 0xFF
    out[last[long] - 1] = 0xC0 | n[long] >> 8
    for k in np.flatnonzero(whole).tolist():
        lo = int(last[k] + 1 - size[k])
        out[lo : lo + 3 * int(whole[k])] = np.tile(np.array([0xFF, 0xFF, 0], np.uint8), int(whole[k]))
    return out.tobytes()


def decode_runs(data: bytes, width: int, height: int) -> np.ndarray:
    if not width * height:
        return np.zeros((height, width), np.uint8)
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    high = b >= 0xC0
    if high.any():  # of high bytes in a row every second one is the second byte of a run, and so is what follows an odd number of them
        at = np.arange(len(b))
        since = at - np.maximum.accumulate(np.where(high, -1, at))
        first = high & (since % 2 == 1)
        starts = ~np.concatenate([[False], first[:-1]])
        n = np.where(first, (b & 0x3F) << 8 | np.append(b[1:], 0), b)[starts]
        if first[-1]:
            n = n[:-1]
    else:
        n = b
    end = np.cumsum(n)
    row = (end - n) // width
    used = int(np.searchsorted(row, height))
    n, end, row = n[:used], end[:used], row[:used]
    if (end > (row + 1) * width).any():
        raise ValueError("a run goes beyond its row")
    if not used or end[-1] < width * height:
        raise IndexError("the runs are cut off")
    ink = (np.arange(used) - np.searchsorted(row, row)) % 2
    return np.repeat(ink.astype(np.uint8), n).reshape(height, width)[::-1].copy()


# copies and cuts


def crop(m: np.ndarray, xmin: int, ymin: int, xmax: int, ymax: int, fill: int = 0) -> np.ndarray:
    """The part of a map in a rectangle; beyond the map it is `fill`."""
    out = np.full((max(0, ymax - ymin), max(0, xmax - xmin), *m.shape[2:]), fill, m.dtype)
    x0, y0, x1, y1 = max(xmin, 0), max(ymin, 0), min(xmax, m.shape[1]), min(ymax, m.shape[0])
    if x0 < x1 and y0 < y1:
        out[y0 - ymin : y1 - ymin, x0 - xmin : x1 - xmin] = m[y0:y1, x0:x1]
    return out


def translate(m: np.ndarray, dx: int, dy: int, fill: int = 0) -> np.ndarray:
    return crop(m, -dx, -dy, m.shape[1] - dx, m.shape[0] - dy, fill)


def ink_box(m: np.ndarray) -> tuple[int, int, int, int]:
    """(xmin, ymin, xmax, ymax) of what is not 0, ends excluded; zeros for none."""
    rows, cols = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
    return (int(cols[0]), int(rows[0]), int(cols[-1]) + 1, int(rows[-1]) + 1) if len(rows) else (0, 0, 0, 0)


def blit(target: np.ndarray, bits: np.ndarray, left: int, bottom: int, subsample: int = 1, grays: int | None = None) -> None:
    """Add a bitmap at a place of the full-size plane to a gray map of 1 / subsample of it."""
    y, x = np.nonzero(bits)
    ty, tx = (y + bottom) // subsample, (x + left) // subsample
    ok = (ty >= 0) & (ty < target.shape[0]) & (tx >= 0) & (tx < target.shape[1])
    sums = target.astype(np.int32)
    np.add.at(sums, (ty[ok], tx[ok]), bits[y[ok], x[ok]].astype(np.int32))
    target[:] = np.minimum(sums, (grays or subsample * subsample + 1) - 1)


# color


@lru_cache(maxsize=32)
def gamma_table(correction: float, white: int = 255) -> np.ndarray:
    if not 0.1 <= correction <= 10:
        raise ValueError("a gamma correction is 0.1 to 10")
    x = np.arange(256) / 255
    return np.floor(white * x ** (1 / correction) + 0.5).astype(np.uint8)


def correct(m: np.ndarray, correction: float) -> np.ndarray:
    return m if abs(correction - 1) < 0.001 else gamma_table(round(correction, 4))[m]


def attenuate(m: np.ndarray, mask: np.ndarray, grays: int) -> np.ndarray:
    """A color map darkened by a mask of ink levels, black where the mask is full."""
    top = grays - 1
    keep = 0x10000 - (np.minimum(mask, top).astype(np.int64) << 16) // top
    return ((m.astype(np.int64) * keep[..., None]) >> 16).astype(np.uint8)


def stencil(m: np.ndarray, mask: np.ndarray, grays: int, ink: np.ndarray, correction: float = 1.0) -> np.ndarray:
    """A color map with ink blended over it by a mask; ink is one color or a map of colors, enlarged to the mask."""
    ink = correct(np.asarray(ink, np.uint8), correction)
    if ink.ndim == 3 and ink.shape[:2] != mask.shape:
        y, x = np.arange(mask.shape[0]) * ink.shape[0] // mask.shape[0], np.arange(mask.shape[1]) * ink.shape[1] // mask.shape[1]
        ink = ink[y][:, x]
    top = grays - 1
    level = (np.minimum(mask, top).astype(np.int64) << 16) // top
    base = m.astype(np.int64)
    return (base - ((base - ink.astype(np.int64)) * level[..., None] >> 16)).astype(np.uint8)


def composite(background: np.ndarray, foreground: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Foreground where the mask has ink, else background."""
    return np.where(mask[..., None] > 0, foreground, background)


def invert(m: np.ndarray) -> np.ndarray:
    return 255 - m


def recolor(m: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Each pixel (and a 1) times a 4 by 3 matrix."""
    out = np.concatenate([m.astype(float), np.full((*m.shape[:2], 1), 255.0)], axis=2) @ np.asarray(matrix, float)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# scaling


def downsample(m: np.ndarray, factor: int) -> np.ndarray:
    """Means of boxes of factor by factor pixels, cut off at the edge."""
    h, w = m.shape[:2]
    ys, xs = np.arange(0, h, factor), np.arange(0, w, factor)
    sums = np.add.reduceat(np.add.reduceat(m.astype(np.int64), ys, axis=0), xs, axis=1)
    count = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None]
    count = count[..., None] if m.ndim == 3 else count
    return ((2 * sums + count) // (2 * count)).astype(m.dtype)


def scale(m: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear scaling; where the map shrinks to less than half, halved by means first."""
    while m.shape[1] >= 2 * width and m.shape[0] >= 2 * height and min(m.shape[:2]) > 1:
        m = downsample(m, 2)

    def weights(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(((2 * np.arange(n) + 1) * size * 8 // n - 8) , 0, (size - 1) * 16)  # sixteenths of a pixel
        lo = at >> 4
        return lo, np.minimum(lo + 1, size - 1), at & 15

    (y0, y1, fy), (x0, x1, fx) = weights(height, m.shape[0]), weights(width, m.shape[1])
    a = m.astype(np.int64)
    fx, fy = (fx[None, :, None], fy[:, None, None]) if m.ndim == 3 else (fx[None], fy[:, None])
    row = lambda y: a[y][:, x0] * (16 - fx) + a[y][:, x1] * fx
    return ((row(y0) * (16 - fy) + row(y1) * fy + 128) >> 8).astype(m.dtype)


def downsample_43(m: np.ndarray) -> np.ndarray:
    """Three pixels for each four, in both directions."""
    return scale(m, -(-m.shape[1] * 3 // 4), -(-m.shape[0] * 3 // 4))
