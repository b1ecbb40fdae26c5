"""PNG files and thumbnails without an imaging library: what the image audit and the corpus need where Pillow is not installed."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in grey, of 65,536. Fixed values.
GREY = (19_595, 38_470, 7_471)
#: Pixels of an image at most; larger ones are refused.
MAX_PIXELS = 100_000_000


def _chunks(content: bytes):
    at = len(_MAGIC)
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += size + 12


def read_png(content: bytes) -> np.ndarray:
    """Height x width x 3 bytes of an RGB, grey or palette PNG with 1 to 16 bits a channel; transparency is dropped.

    Interlaced files are refused.
    """
    if not content.startswith(_MAGIC):
        raise ValueError("no PNG")
    data, palette, head = b"", None, None
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
    if head is None:
        raise ValueError("no header")
    width, height, depth, kind, _, _, interlaced = head
    if interlaced or kind not in _CHANNELS or width * height > MAX_PIXELS:
        raise ValueError("this kind of PNG is not read")
    bits = depth * _CHANNELS[kind]
    row, step = -(-width * bits // 8), max(1, bits // 8)
    flat = np.frombuffer(zlib.decompress(data), np.uint8)[: height * (row + 1)].reshape(height, row + 1)
    lines = _unfilter(flat, step)
    if depth < 8:
        each = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        values = (each * (1 << np.arange(depth - 1, -1, -1))).sum(2)[:, :width].astype(np.uint8)
        values = values if kind == 3 else (values.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        pixels = values.reshape(height, width, 1)
    else:
        pixels = lines.reshape(height, width, _CHANNELS[kind], depth // 8)[..., 0]
    if kind == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if kind in (0, 4) else np.ascontiguousarray(pixels[..., :3])


def _unfilter(flat: np.ndarray, step: int) -> np.ndarray:
    """The lines without the filters that make them smaller: none, left, up, average, nearest of left, up and corner."""
    height, row = flat.shape[0], flat.shape[1] - 1
    out, before = np.zeros((height, row), np.uint8), np.zeros(row, np.uint8)
    for y in range(height):
        how, line = flat[y, 0], flat[y, 1:].copy()
        if how == 1:  # sums along each channel
            padded = np.zeros(-(-row // step) * step, np.uint8)
            padded[:row] = line
            line = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:row]
        elif how == 2:
            line = line + before
        elif how in (3, 4):
            got, above, now = line.tolist(), before.tolist(), [0] * row
            for x in range(row):
                a, b, c = (now[x - step], above[x], above[x - step]) if x >= step else (0, above[x], 0)
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                now[x] = (got[x] + guess) & 255
            line = np.array(now, np.uint8)
        out[y] = before = line
    return out


def write_png(pixels: np.ndarray) -> bytes:
    """An RGB PNG of height x width x 3 bytes."""
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def grey(pixels: np.ndarray) -> np.ndarray:
    """Height x width grey bytes by the usual luma weights."""
    return ((pixels.astype(np.int64) @ np.array(GREY) + 32_768) >> 16).astype(np.uint8)


def _weights(size: int, target: int) -> np.ndarray:
    """target x size weights of a Lanczos kernel of three lobes, widened where the image shrinks."""
    scale = size / target
    reach = 3.0 * max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / max(scale, 1.0)
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    w[np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) >= reach] = 0.0
    return w / w.sum(1, keepdims=True)


def resize(values: np.ndarray, width: int, height: int) -> np.ndarray:
    """Grey bytes at another size, first along the lines, then across them, rounded to bytes each time."""
    round_ = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = round_(values.astype(float) @ _weights(values.shape[1], width).T)
    return round_(_weights(values.shape[0], height) @ across).astype(np.uint8)


def thumbnails(content: bytes, sizes: list[tuple[int, int]]) -> list[list[float]]:
    """The grey thumbnails of a PNG, row by row."""
    values = grey(read_png(content))
    return [resize(values, *size).ravel().astype(float).tolist() for size in sizes]


def rgb_png(content: bytes) -> bytes:
    """A PNG as an RGB one."""
    return write_png(read_png(content))
