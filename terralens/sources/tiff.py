"""Tiled TIFF (plain and big, in tiles or strips, with overviews), written whole and read piece by piece.

A file's directories make an index: for each level its size, its tiles' places and lengths, and how samples are packed.
With it, a window needs the byte ranges of the tiles that it touches and nothing else.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: letters and bytes of field types, tag numbers, geographic keys.
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8)}
_SUBFILE, _WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES, _PLANAR, _PREDICTOR = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT, _PIXEL_SCALE, _TIE_POINT, _GEO_KEYS = 322, 323, 324, 325, 339, 33550, 33922, 34735
_PROJECTED, _GEOGRAPHIC = 3072, 2048
_PLAIN, _DEFLATE, _OLD_DEFLATE = 1, 8, 32946


@dataclass(frozen=True)
class Level:
    """One directory. Tiles are numbered along rows; with planes of their own, the second plane's follow the first's."""

    width: int
    height: int
    tile_w: int
    tile_h: int
    samples: int
    kind: str  # NumPy's name of the sample type, with its byte order
    packing: int
    predictor: int
    apart: bool  # each sample in a plane of its own
    offsets: np.ndarray = field(repr=False)
    sizes: np.ndarray = field(repr=False)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_h)


def unpacked(data: bytes, tile_w: int, tile_h: int, samples: int, kind: str, packing: int, predictor: int) -> np.ndarray:
    """The tile_h x tile_w x samples pixels of one tile's bytes; no bytes are a tile of zeros, a last strip may have fewer rows."""
    if not len(data):
        return np.zeros((tile_h, tile_w, samples), np.dtype(kind).newbyteorder("="))
    raw = data if packing == _PLAIN else zlib.decompress(data)
    out = np.frombuffer(raw, kind)
    out = out[: len(out) // (tile_w * samples) * tile_w * samples].reshape(-1, tile_w, samples).astype(np.dtype(kind).newbyteorder("="))
    return np.cumsum(out, 1, dtype=out.dtype) if predictor == 2 else out


def index(get: Callable[[int, int], bytes], first: int = 16384) -> tuple[list[Level], dict]:
    """The levels, the largest first, and {west, north, pixel, epsg} (None where the file doesn't say) of a TIFF.

    get(offset, length) gives bytes, fewer at the file's end. Masks and kinds that are not read here (samples of other
    widths than 8 and 16 bits, other packings than none and deflate) raise ValueError, but for masks, which are left out.
    """
    held = get(0, first)

    def at(offset: int, n: int) -> bytes:
        data = held[offset : offset + n] if offset + n <= len(held) else get(offset, n)
        if len(data) < n:
            raise ValueError("a TIFF that ends too early")
        return data

    head = at(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    big = version == 43
    count_kind, count_size, entry, inline, word = ("Q", 8, 20, 8, "Q") if big else ("H", 2, 12, 4, "I")
    (place,) = struct.unpack(f"{order}{word}", at(8, 8) if big else head[4:])
    levels, where = [], {"west": None, "north": None, "pixel": None, "epsg": None}
    seen = set()
    while place and place not in seen:
        seen.add(place)
        (n,) = struct.unpack(f"{order}{count_kind}", at(place, count_size))
        body, tags = at(place + count_size, n * entry + inline), {}
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", body, k * entry)
            (count,) = struct.unpack_from(f"{order}{word}", body, k * entry + 4)
            if kind in _TYPES:
                letter, size = _TYPES[kind]
                value = body[k * entry + 4 + inline : k * entry + 4 + 2 * inline]
                if size * count > inline:
                    value = at(struct.unpack(f"{order}{word}", value)[0], size * count)
                tags[tag] = struct.unpack(f"{order}{count}{letter}", value[: size * count])
        (place,) = struct.unpack(f"{order}{word}", body[n * entry :])
        one = lambda tag, default=None: tags.get(tag, (default,))[0]  # noqa: B023, E731
        if one(_SUBFILE, 0) & 4:
            continue
        bits, packing, samples = tags.get(_BITS, (1,)), one(_COMPRESSION, 1), one(_SAMPLES, 1)
        if len(set(bits)) != 1 or bits[0] not in (8, 16) or packing not in (_PLAIN, _DEFLATE, _OLD_DEFLATE) or one(_PREDICTOR, 1) not in (1, 2) or one(_FORMAT, 1) not in (1, 2):
            raise ValueError("a kind of TIFF that is not read here")
        tiled = _TILES in tags
        if not tiled and _STRIPS not in tags:
            raise ValueError("a TIFF without tiles or strips")
        width, height = one(_WIDTH), one(_HEIGHT)
        tile = (one(_TILE_WIDTH), one(_TILE_HEIGHT)) if tiled else (width, min(height, one(_STRIP_ROWS, height)))
        kind = f"{order}{'i' if one(_FORMAT, 1) == 2 else 'u'}{bits[0] // 8}"
        places = (tags[_TILES], tags[_TILE_BYTES]) if tiled else (tags[_STRIPS], tags[_STRIP_BYTES])
        levels.append(Level(width, height, *tile, samples, kind, packing, one(_PREDICTOR, 1), one(_PLANAR, 1) == 2 and samples > 1, *(np.array(p, np.int64) for p in places)))
        if _TIE_POINT in tags and where["west"] is None:
            keys = tags.get(_GEO_KEYS, ())
            codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
            tie, scale = tags[_TIE_POINT], tags.get(_PIXEL_SCALE, (1.0, 1.0))
            where = {"west": tie[3] - tie[0] * scale[0], "north": tie[4] + tie[1] * scale[1], "pixel": scale[:2], "epsg": codes.get(_PROJECTED) or codes.get(_GEOGRAPHIC)}
    if not levels:
        raise ValueError("a TIFF without an image")
    return sorted(levels, key=lambda x: -x.width * x.height), where


def whole(data: bytes, level: int = 0) -> np.ndarray:
    """All pixels of a level; one sample gives a plane."""
    x = index(lambda offset, n: data[offset : offset + n])[0][level]
    out = np.zeros((x.down * x.tile_h, x.across * x.tile_w, x.samples), np.dtype(x.kind).newbyteorder("="))
    each = 1 if x.apart else x.samples
    for k, (offset, size) in enumerate(zip(x.offsets, x.sizes, strict=True)):
        plane, t = divmod(k, x.across * x.down)
        part = unpacked(data[offset : offset + size], x.tile_w, x.tile_h, each, x.kind, x.packing, x.predictor)
        r, c = t // x.across * x.tile_h, t % x.across * x.tile_w
        out[r : r + part.shape[0], c : c + x.tile_w, plane : plane + each] = part
    out = out[: x.height, : x.width]
    return out[..., 0] if x.samples == 1 else out


def halved(image: np.ndarray) -> np.ndarray:
    """Means of two by two pixels, the last row and column once more where they are odd; halves go to even."""
    wide = np.pad(image, [(0, image.shape[0] % 2), (0, image.shape[1] % 2), (0, 0)], "edge").astype(np.float64)
    return np.rint((wide[::2, ::2] + wide[1::2, ::2] + wide[::2, 1::2] + wide[1::2, 1::2]) / 4).astype(image.dtype)


def tiled(image: np.ndarray, tile: int = 256, overviews: int = 0, west: float = 0.0, north: float = 0.0, pixel: tuple[float, float] = (1.0, 1.0), epsg: int = 4326, deflate: bool = True, predictor: int = 1, big: bool = False) -> bytes:
    """An 8 or 16 bit raster as a tiled TIFF: directories first, then the tiles of each level; overviews halve the one before."""
    levels = [np.ascontiguousarray(image if image.ndim == 3 else image[..., None])]
    for _ in range(overviews):
        levels.append(halved(levels[-1]))
    bits = levels[0].dtype.itemsize * 8
    if bits not in (8, 16) or levels[0].dtype.kind != "u":
        raise ValueError("samples are unsigned, of 8 or 16 bits")
    parts, shapes = [], []
    for x in levels:
        h, w, n = x.shape
        down, across = -(-h // tile), -(-w // tile)
        full = np.zeros((down * tile, across * tile, n), x.dtype.newbyteorder("<"))
        full[:h, :w] = x
        rows = []
        for r in range(down):
            for c in range(across):
                part = full[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros((tile, 1, n), part.dtype)).astype(part.dtype)
                rows.append(zlib.compress(part.tobytes(), 6) if deflate else part.tobytes())
        parts.append(rows)
        shapes.append((w, h, n))
    entry, inline, word, head = (20, 8, "Q", 16) if big else (12, 4, "I", 8)

    def fields(k: int, places: list[int]) -> list[tuple[int, int, list]]:
        w, h, n = shapes[k]
        out = [
            (_SUBFILE, 4, [int(k > 0)]), (_WIDTH, 4, [w]), (_HEIGHT, 4, [h]), (_BITS, 3, [bits] * n), (_COMPRESSION, 3, [_DEFLATE if deflate else _PLAIN]), (_PHOTOMETRIC, 3, [2 if n >= 3 else 1]), (_SAMPLES, 3, [n]),
            (_PLANAR, 3, [1]), (_PREDICTOR, 3, [predictor]), (_TILE_WIDTH, 3, [tile]), (_TILE_HEIGHT, 3, [tile]), (_TILES, 16 if big else 4, places), (_TILE_BYTES, 4, [len(p) for p in parts[k]]),
        ]
        if k == 0:
            projected = not 4000 <= epsg < 5000
            keys = [1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, _PROJECTED if projected else _GEOGRAPHIC, 0, 1, epsg]
            out += [(_PIXEL_SCALE, 12, [*pixel, 0.0]), (_TIE_POINT, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (_GEO_KEYS, 3, keys)]
        return out

    def directory(k: int, at: int, places: list[int], last: bool) -> bytes:
        rows = fields(k, places)
        size = (8 if big else 2) + entry * len(rows) + inline
        body, extra = struct.pack("<Q" if big else "<H", len(rows)), b""
        for tag, kind, values in rows:
            packed = struct.pack(f"<{len(values)}{_TYPES[kind][0]}", *values)
            value = packed.ljust(inline, b"\0")
            if len(packed) > inline:
                value = struct.pack(f"<{word}", at + size + len(extra))
                extra += packed + b"\0" * (-len(packed) % 8)
            body += struct.pack(f"<HH{word}", tag, kind, len(values)) + value
        end = at + size + len(extra)
        return body + struct.pack(f"<{word}", 0 if last else end + end % 2) + extra + b"\0" * (end % 2)

    def size_of(k: int) -> int:
        rows = fields(k, [0] * len(parts[k]))
        beyond = [len(v) * _TYPES[kind][1] for _, kind, v in rows]
        n = (8 if big else 2) + entry * len(rows) + inline + sum(x + -x % 8 for x in beyond if x > inline)
        return n + n % 2

    sizes = [size_of(k) for k in range(len(parts))]
    starts = [head + sum(sizes[:k]) for k in range(len(parts))]
    at, places = head + sum(sizes), []
    for p in parts:
        places.append([at + sum(map(len, p[:i])) for i in range(len(p))] if len(p) < 64 else (at + np.cumsum([0, *map(len, p[:-1])])).tolist())
        at += sum(map(len, p))
    out = struct.pack("<2sHHHQ", b"II", 43, 8, 0, head) if big else struct.pack("<2sHI", b"II", 42, head)
    for k in range(len(parts)):
        part = directory(k, starts[k], places[k], k == len(parts) - 1)
        assert len(part) <= sizes[k]
        out += part.ljust(sizes[k], b"\0")
    return out + b"".join(b"".join(p) for p in parts)
