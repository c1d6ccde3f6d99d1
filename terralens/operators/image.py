"""Image kernels in NumPy, and their application to rows of encoded or raw images.

Images are uint8 arrays of height x width (x 3 in blue, green, red order, as Spark's image source gives them).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# --- files ------------------------------------------------------------------------------------------------------


def png_encode(image: np.ndarray) -> bytes:
    """A gray or colour (BGR) image as PNG."""
    rgb = image if image.ndim == 2 else image[..., ::-1]
    h, w = rgb.shape[:2]

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb).reshape(h, -1)], 1)
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """An 8-bit gray, colour or colour-with-alpha PNG without interlacing; colour comes back as BGR."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("this kind of PNG is not supported")
    w, h, n = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.int64)
    above = np.zeros(w * n, np.int64)
    for y in range(h):
        how, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if how == 1:  # each channel adds up along the row
            line = np.cumsum(line.reshape(w, n), 0).ravel() & 255
        elif how == 2:
            line = (line + above) & 255
        elif how in (3, 4):
            for x in range(w * n):
                left, corner = (line[x - n], above[x - n]) if x >= n else (0, 0)
                if how == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    pixels = out.astype(np.uint8).reshape(h, w, n)
    return pixels[..., 0] if n == 1 else np.ascontiguousarray(pixels[..., 2::-1])


def to_struct(image: np.ndarray, origin: str | None = None) -> dict:
    n = 1 if image.ndim == 2 else image.shape[2]
    return {"origin": origin, "height": image.shape[0], "width": image.shape[1], "nChannels": n, "mode": 0 if n == 1 else 16, "data": np.ascontiguousarray(image).tobytes()}


def from_struct(x: dict) -> np.ndarray:
    a = np.frombuffer(x["data"], np.uint8)
    return a.reshape(x["height"], x["width"]) if x["nChannels"] == 1 else a.reshape(x["height"], x["width"], x["nChannels"])


# --- kernels ----------------------------------------------------------------------------------------------------


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def _along(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(weights, np.moveaxis(image, axis, 0), 1), 0, axis)


def _area(n: int, m: int) -> np.ndarray:
    """m x n shares of the source cells that each target cell covers."""
    edges = np.arange(m + 1) * n / m
    lo, hi = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(hi - lo, 0) * m / n


def _cubic(n: int, m: int, a: float = -0.75) -> np.ndarray:
    """m x n weights of cubic convolution, borders repeated."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((m, n))
    for k in range(-1, 3):
        x = np.abs(at - base - k)
        w = np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0))
        np.add.at(out, (np.arange(m), np.clip(base + k, 0, n - 1)), w)
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area where a side shrinks, else by cubic convolution."""
    out = image.astype(np.float64)
    for axis, m in ((0, height), (1, width)):
        n = image.shape[axis]
        if m != n:
            out = _along(out, _area(n, m) if m < n else _cubic(n, m), axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def wanted_size(height: int, width: int, factor: float = 1.0) -> tuple[int, int]:
    """Rows and columns of an image of which `factor` pixels stand for one along each side; one at least."""
    if factor <= 0:
        raise ValueError("a size factor is positive")
    return tuple(max(1, round(n * factor)) for n in (height, width))


def cap_long_side(image: np.ndarray, most: int = 1024) -> np.ndarray:
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image
    return resize(image, max(1, int(h * most / max(h, w))), max(1, int(w * most / max(h, w))))


def stretched(image: np.ndarray, low: float = 2, high: float = 98, flat: int = 128) -> np.ndarray:
    """Every band of a gray or many-banded image, of 8 or 16 bits, mapped so that the two percentiles of its pixels over 0 become 0 and 255.

    A band's histogram gives its percentiles (linear between neighbours) and its table of new values, in which all pixels
    are then looked up. A band whose percentiles are equal becomes `flat`, one without pixels over 0 becomes 0.
    """
    bands = image.reshape(*image.shape[:2], -1)
    levels = np.arange(np.iinfo(image.dtype).max + 1)
    out = np.empty(bands.shape, np.uint8)
    for k in range(bands.shape[2]):
        counts = np.bincount(bands[..., k].ravel(), minlength=len(levels))
        upto = np.cumsum(counts) - counts[0]
        if not upto[-1]:
            out[..., k] = 0
            continue
        place = np.array([low, high]) / 100 * (upto[-1] - 1)
        below, above = (np.searchsorted(upto, np.floor(p) + 1) for p in (place, np.ceil(place)))
        lo, hi = below + (above - below) * (place - np.floor(place))
        table = np.full(len(levels), flat, np.uint8) if hi <= lo else np.clip((levels - lo) / max(hi - lo, 1e-12) * 255, 0, 255).astype(np.uint8)
        out[..., k] = table[bands[..., k]]
    return out.reshape(image.shape)


def clahe(image: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalization: each tile's clipped histogram, blended bilinearly between tile centers."""
    h, w = image.shape
    th, tw = -(-h // grid), -(-w // grid)
    padded = np.pad(image, ((0, th * grid - h), (0, tw * grid - w)), "reflect" if min(h, w) > max(th * grid - h, tw * grid - w) else "edge")
    tiles = padded.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, -1)
    area = th * tw
    hist = np.stack([np.bincount(t, minlength=256) for t in tiles]).astype(np.int64)
    limit = max(1, int(clip * area / 256))
    over = np.maximum(hist - limit, 0).sum(1)
    hist = np.minimum(hist, limit) + (over // 256)[:, None]
    for i, rest in enumerate(over % 256):
        if rest:
            hist[i, np.arange(0, 256, max(1, 256 // rest))[:rest]] += 1
    luts = np.clip(np.rint(np.cumsum(hist, 1) * 255.0 / area), 0, 255).reshape(grid, grid, 256)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    dy, dx = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda y, x: luts[np.clip(y, 0, grid - 1)[:, None], np.clip(x, 0, grid - 1)[None], image]
    top = at(y0, x0) * (1 - dx) + at(y0, x0 + 1) * dx
    low = at(y0 + 1, x0) * (1 - dx) + at(y0 + 1, x0 + 1) * dx
    return np.clip(np.rint(top * (1 - dy) + low * dy), 0, 255).astype(np.uint8)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur with mirrored borders."""
    r = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.abs(np.arange(-r, n + r))
        at = np.where(at % (2 * max(1, n - 1)) >= n, 2 * (n - 1) - at % (2 * max(1, n - 1)), at % (2 * max(1, n - 1))) if n > 1 else np.zeros(n + 2 * r, int)
        padded = np.moveaxis(np.take(out, at, axis), axis, 0)
        out = np.moveaxis(sum(k[i] * padded[i : i + n] for i in range(2 * r + 1)), 0, axis)
    return out


def local_contrast(image: np.ndarray, sigma: float = 8.0, eps: float = 1e-3, clip: float = 3.0) -> np.ndarray:
    """(I - local mean) / (local deviation + eps), cut at `clip` deviations and mapped to 0..255."""
    f = image.astype(np.float64)
    mean = gaussian(f, sigma)
    z = (f - mean) / (np.sqrt(np.maximum(gaussian(f * f, sigma) - mean * mean, 0)) + eps)
    return np.clip(np.rint((np.clip(z, -clip, clip) + clip) / (2 * clip) * 255), 0, 255).astype(np.uint8)


def preprocess(image: np.ndarray, scale: float = 1.0, normalize: bool = False, use_clahe: bool = False, lcn: bool = False) -> np.ndarray:
    """Resize, stretch, gray, equalize, local contrast: in this order, each if asked; gray always."""
    image = resize(image, *wanted_size(*image.shape[:2], scale))
    image = gray(stretched(image) if normalize else image)
    image = clahe(image) if use_clahe else image
    return local_contrast(image) if lcn else image


def backbone_input(image: np.ndarray, size: int = 224) -> np.ndarray:
    """Channels x size x size in RGB, scaled by the usual mean and deviation of natural images."""
    rgb = resize(image if image.ndim == 3 else np.repeat(image[..., None], 3, 2), size, size)[..., 2::-1].astype(np.float32) / 255
    return ((rgb - np.array([0.485, 0.456, 0.406])) / np.array([0.229, 0.224, 0.225])).transpose(2, 0, 1).astype(np.float32)


def query_view(image: np.ndarray, crop: float = 0.7, degrees: float = 12.0) -> np.ndarray:
    """The center of an image, turned, on a canvas that holds all of it."""
    h, w = image.shape[:2]
    ch, cw = max(1, int(h * crop)), max(1, int(w * crop))
    part = image[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw]
    a = np.radians(degrees)
    oh, ow = int(np.ceil(cw * abs(np.sin(a)) + ch * abs(np.cos(a)))), int(np.ceil(cw * abs(np.cos(a)) + ch * abs(np.sin(a))))
    y, x = np.mgrid[:oh, :ow]
    dy, dx = y - (oh - 1) / 2, x - (ow - 1) / 2
    u, v = np.cos(a) * dx - np.sin(a) * dy + (cw - 1) / 2, np.sin(a) * dx + np.cos(a) * dy + (ch - 1) / 2
    i, j = np.rint(v).astype(int), np.rint(u).astype(int)
    ok = (i >= 0) & (i < ch) & (j >= 0) & (j < cw)
    out = np.zeros((oh, ow, *image.shape[2:]), np.uint8)
    out[ok] = part[i[ok], j[ok]]
    return out


def valid_fraction(image: np.ndarray) -> float:
    """The share of pixels that are not black in all channels."""
    return float((image if image.ndim == 2 else image.any(2)).astype(bool).mean()) if image.size else 0.0


# --- GeoTIFF ----------------------------------------------------------------------------------------------------

#: Fixed values of the format: tag numbers, and bytes of each field type.
_TIFF_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_PIXEL_SCALE, _TIE_POINT, _GEO_KEYS = 33550, 33922, 34735


def geotiff_encode(image: np.ndarray, west: float, north: float, pixel: tuple[float, float], epsg: int = 4326) -> bytes:
    """An uint8 raster as a deflated GeoTIFF: its upper left corner, the pixel's size, and the coordinate system's code."""
    pixels = np.ascontiguousarray(image if image.ndim == 3 else image[..., None], np.uint8)
    h, w, channels = pixels.shape
    data = zlib.compress(pixels.tobytes(), 6)
    projected = not 4000 <= epsg < 5000
    fields = [
        (_WIDTH, 4, [w]), (_HEIGHT, 4, [h]), (_BITS, 3, [8] * channels), (_COMPRESSION, 3, [8]), (_PHOTOMETRIC, 3, [2 if channels >= 3 else 1]), (_STRIPS, 4, [8]), (_SAMPLES, 3, [channels]),
        (_STRIP_ROWS, 4, [h]), (_STRIP_BYTES, 4, [len(data)]), (_PLANAR, 3, [1]), (_PIXEL_SCALE, 12, [*pixel, 0.0]), (_TIE_POINT, 12, [0.0, 0.0, 0.0, west, north, 0.0]),
        (_GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, 3072 if projected else 2048, 0, 1, epsg]),
    ]
    at = 8 + len(data) + len(data) % 2
    beyond = at + 2 + 12 * len(fields) + 4
    entries, extra = b"", b""
    for tag, kind, values in fields:
        letter, size = _TIFF_TYPES[kind]
        packed = struct.pack(f"<{len(values)}{letter}", *values)
        if len(packed) > 4:
            place = struct.pack("<I", beyond + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            place = packed.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + place
    return b"II*\0" + struct.pack("<I", at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra


def geotiff_decode(data: bytes) -> tuple[np.ndarray, dict]:
    """(raster, {west, north, pixel, epsg}) of a TIFF in strips of 8 or 16 bits, plain or deflated; other kinds raise ValueError.

    What a file does not say is None.
    """
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind in _TIFF_TYPES:
            letter, size = _TIFF_TYPES[kind]
            place = at + 10 + 12 * k
            if size * count > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
    bits, packing = tags.get(_BITS, (1,)), tags.get(_COMPRESSION, (1,))[0]
    if len(set(bits)) != 1 or bits[0] not in (8, 16) or packing not in (1, 8, 32946) or tags.get(_PLANAR, (1,))[0] != 1 or tags.get(_PREDICTOR, (1,))[0] != 1 or _STRIPS not in tags:
        raise ValueError("a kind of TIFF that is not read here")
    parts = [data[a : a + size] for a, size in zip(tags[_STRIPS], tags[_STRIP_BYTES], strict=True)]
    raw = b"".join(parts if packing == 1 else map(zlib.decompress, parts))
    shape = (tags[_HEIGHT][0], tags[_WIDTH][0], tags.get(_SAMPLES, (1,))[0])
    pixels = np.frombuffer(raw, np.dtype(f"{order}u{bits[0] // 8}")).reshape(shape)
    keys = tags.get(_GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    tie, scale = tags.get(_TIE_POINT), tags.get(_PIXEL_SCALE)
    where = {"west": tie[3] if tie else None, "north": tie[4] if tie else None, "pixel": scale[:2] if scale else None, "epsg": codes.get(3072) or codes.get(2048)}
    return (pixels[..., 0] if shape[2] == 1 else pixels).astype(pixels.dtype.newbyteorder("=")), where


# --- local features ---------------------------------------------------------------------------------------------


def sift(image: np.ndarray, most: int = 2000, contrast: float = 0.04, edge: float = 10.0, sigma: float = 1.6, scales: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints (x, y, size, angle, response) and 128-number descriptors, the strongest first; none for flat images."""
    base = gaussian(gray(image).astype(np.float64) / 255, max(0.01, np.sqrt(sigma**2 - 0.25)))
    points, descs, octave, step = [], [], base, 2 ** (1 / scales)
    for o in range(max(1, int(np.log2(max(2, min(base.shape)))) - 3)):
        levels = [octave]
        for s in range(1, scales + 3):
            last = sigma * step ** (s - 1)
            levels.append(gaussian(levels[-1], last * np.sqrt(step**2 - 1)))
        dog = np.stack([b - a for a, b in zip(levels, levels[1:], strict=False)])
        for s in range(1, scales + 1):
            for y, x in _extrema(dog, s, contrast / scales, edge):
                size = sigma * step**s
                for angle in _angles(levels[s], y, x, size):
                    points.append((x * 2**o, y * 2**o, 2 * size * 2**o, np.degrees(angle) % 360, abs(dog[s, y, x])))
                    descs.append(_descriptor(levels[s], y, x, size, angle))
        octave = levels[scales][::2, ::2]
        if min(octave.shape) < 16:
            break
    if not points:
        return np.zeros((0, 5), np.float32), np.zeros((0, 128), np.float32)
    p, d = np.array(points, np.float32), np.array(descs, np.float32)
    best = np.argsort(-p[:, 4], kind="stable")[:most]
    return p[best], d[best]


def _extrema(dog: np.ndarray, s: int, least: float, edge: float) -> list[tuple[int, int]]:
    mid = dog[s, 1:-1, 1:-1]
    around = [dog[k, 1 + i : dog.shape[1] - 1 + i, 1 + j : dog.shape[2] - 1 + j] for k in (s - 1, s, s + 1) for i in (-1, 0, 1) for j in (-1, 0, 1) if (k, i, j) != (s, 0, 0)]
    peak = (np.abs(mid) > least) & (np.all([mid > a for a in around], 0) | np.all([mid < a for a in around], 0))
    d = dog[s]
    out = []
    for y, x in np.argwhere(peak) + 1:
        xx, yy = d[y, x + 1] + d[y, x - 1] - 2 * d[y, x], d[y + 1, x] + d[y - 1, x] - 2 * d[y, x]
        xy = (d[y + 1, x + 1] - d[y + 1, x - 1] - d[y - 1, x + 1] + d[y - 1, x - 1]) / 4
        det = xx * yy - xy * xy
        if det > 0 and (xx + yy) ** 2 * edge < (edge + 1) ** 2 * det:
            out.append((int(y), int(x)))
    return out


def _gradients(level: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, w = level.shape
    ok = (ys > 0) & (ys < h - 1) & (xs > 0) & (xs < w - 1)
    y, x = np.clip(ys, 1, h - 2), np.clip(xs, 1, w - 2)
    gx, gy = level[y, x + 1] - level[y, x - 1], level[y + 1, x] - level[y - 1, x]
    return np.hypot(gx, gy) * ok, np.arctan2(gy, gx), ok


def _angles(level: np.ndarray, y: int, x: int, size: float) -> list[float]:
    r = max(1, round(4.5 * size))
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    power, angle, _ = _gradients(level, y + dy, x + dx)
    weight = power * np.exp(-(dy**2 + dx**2) / (2 * (1.5 * size) ** 2))
    hist = np.bincount((np.floor(angle / (2 * np.pi) * 36).astype(int) % 36).ravel(), weight.ravel(), 36)
    for _ in range(2):
        hist = (np.roll(hist, 1) + hist * 2 + np.roll(hist, -1)) / 4
    top = hist.max()
    if top <= 0:
        return []
    peaks = np.flatnonzero((hist > np.roll(hist, 1)) & (hist > np.roll(hist, -1)) & (hist >= 0.8 * top))
    out = []
    for k in peaks:
        left, mid, right = hist[k - 1], hist[k], hist[(k + 1) % 36]
        out.append((k + 0.5 + 0.5 * (left - right) / (left - 2 * mid + right)) / 36 * 2 * np.pi)
    return out


def _descriptor(level: np.ndarray, y: int, x: int, size: float, angle: float) -> np.ndarray:
    cell = 3 * size
    r = max(1, round(cell * np.sqrt(2) * 2.5))
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    c, s = np.cos(angle), np.sin(angle)
    u, v = (c * dx + s * dy) / cell + 1.5, (-s * dx + c * dy) / cell + 1.5
    power, turn, _ = _gradients(level, y + dy, x + dx)
    weight = power * np.exp(-((u - 1.5) ** 2 + (v - 1.5) ** 2) / 8)
    t = ((turn - angle) / (2 * np.pi) * 8) % 8
    out = np.zeros((4, 4, 8))
    u0, v0, t0 = np.floor(u).astype(int), np.floor(v).astype(int), np.floor(t).astype(int)
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                share = weight * np.abs(1 - i - (u - u0)) * np.abs(1 - j - (v - v0)) * np.abs(1 - k - (t - t0))
                ok = (u0 + i >= 0) & (u0 + i < 4) & (v0 + j >= 0) & (v0 + j < 4)
                np.add.at(out, ((v0 + j)[ok], (u0 + i)[ok], ((t0 + k) % 8)[ok]), share[ok])
    d = out.ravel()
    d = np.minimum(d / (np.linalg.norm(d) + 1e-12), 0.2)
    return np.clip(np.rint(d / (np.linalg.norm(d) + 1e-12) * 512), 0, 255)


# --- over tables ------------------------------------------------------------------------------------------------


#: How many images of a batch are Python objects at once.
PIECE = 64


def map_images(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], column: str = "image", err: str = "err") -> DataFrame:
    """df with the kernel applied to an image struct column; a failing row has a null image and its message in `err`."""
    names = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
        for b in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            out, errors = [], []
            for x in b.column(column).to_pylist():
                try:
                    out.append(to_struct(kernel(from_struct(x)), x["origin"]))
                    errors.append(None)
                except Exception as e:  # reported in the row
                    out.append(None)
                    errors.append(str(e)[:200] or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, kind), pa.array(errors, pa.string())], [*names, column, err])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)
    return df.select(*names, column).mapInArrow(run, f"{kinds}`{column}` {IMAGE}, `{err}` string")


def _nested(rows: list[np.ndarray]) -> pa.Array:
    """Matrices as lists of lists of floats, from one flat array."""
    many, width = [len(r) for r in rows], [r.shape[1] if r.ndim == 2 and len(r) else 0 for r in rows]
    outer = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
    inner = np.concatenate([[0], np.cumsum(np.repeat(width, many))]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.float32), *(r.astype(np.float32).ravel() for r in rows)])
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(flat)))


def describe(df: DataFrame, key: str = "patch_id", column: str = "image", **params) -> DataFrame:
    """(key, xy, descs, err): local features of each image; a flat image has none, a broken one its message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            xy, descs, errors = [], [], []
            for x in b.column(column).to_pylist():
                try:
                    p, d = sift(from_struct(x), **params)
                    xy.append(p[:, :2])
                    descs.append(d)
                    errors.append(None)
                except Exception as e:  # reported in the row
                    xy.append(np.zeros((0, 2)))
                    descs.append(np.zeros((0, 0)))
                    errors.append(str(e)[:200] or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(key), _nested(xy), _nested(descs), pa.array(errors, pa.string())], [key, "xy", "descs", "err"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, xy array<array<float>>, descs array<array<float>>, err string")


def decode_png(df: DataFrame, data: str = "content", origin: str = "path") -> DataFrame:
    """df with `image` and `err` for a column of PNG bytes."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
        for b in batches:
            out, errors = [], []
            for x, o in zip(b.column(data).to_pylist(), b.column(origin).to_pylist(), strict=True):
                try:
                    out.append(to_struct(png_decode(x), o))
                    errors.append(None)
                except Exception as e:  # reported in the row
                    out.append(None)
                    errors.append(str(e)[:200] or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind), pa.array(errors, pa.string())], [*names, "image", "err"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)
    return df.mapInArrow(run, f"{kinds}image {IMAGE}, err string")


def encode_png(df: DataFrame, column: str = "image") -> DataFrame:
    """df with `png`, the column's images as PNG bytes."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("binary")
    def encoded(height, width, channels, data):
        return height.index.to_series().map(lambda i: png_encode(from_struct({"height": height[i], "width": width[i], "nChannels": channels[i], "data": data[i]})))

    return df.withColumn("png", encoded(F.col(f"{column}.height"), F.col(f"{column}.width"), F.col(f"{column}.nChannels"), F.col(f"{column}.data")))
