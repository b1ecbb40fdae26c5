import struct
import zlib

import numpy as np
import pytest

from caselens.sources import png


def filtered(pixels, how):
    """A PNG with one filter for every line, written by the rules of the format."""
    height, width, channels = pixels.shape
    flat, before, out = pixels.reshape(height, -1).astype(int), np.zeros(width * channels, int), b""
    for line in flat:
        left, corner = np.concatenate([np.zeros(channels, int), line[:-channels]]), np.concatenate([np.zeros(channels, int), before[:-channels]])
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0, left, before, (left + before) // 2, near][how]
        out += bytes([how]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in ((b"IHDR", head), (b"IDAT", zlib.compress(out)), (b"IEND", b"")))


@pytest.mark.parametrize("how", range(5))
@pytest.mark.parametrize("channels", [1, 3, 4])
def test_filters(how, channels):
    pixels = np.random.default_rng(how).integers(0, 256, (7, 11, channels)).astype(np.uint8)
    got = png.read_png(filtered(pixels, how))
    assert np.array_equal(got, np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., :3])


def test_round_trip_and_rgb():
    pixels = np.random.default_rng(0).integers(0, 256, (20, 31, 3)).astype(np.uint8)
    assert np.array_equal(png.read_png(png.write_png(pixels)), pixels)
    assert np.array_equal(png.read_png(png.rgb_png(filtered(pixels[..., :1], 2))), np.repeat(pixels[..., :1], 3, axis=2))
    with pytest.raises(ValueError):
        png.read_png(b"no image")


def test_thumbnails():
    flat = np.full((40, 50, 3), 77, np.uint8)
    assert set(png.thumbnails(png.write_png(flat), [(8, 8)])[0]) == {77.0}
    ramp = np.repeat(np.linspace(0, 255, 90).astype(np.uint8)[None, :, None], 40, axis=0).repeat(3, axis=2)
    nine = np.array(png.thumbnails(png.write_png(ramp), [(9, 8)])[0]).reshape(8, 9)
    assert (np.diff(nine, axis=1) > 0).all() and (nine == nine[0]).all()
    same = np.random.default_rng(1).integers(0, 256, (8, 8)).astype(np.uint8)
    assert np.array_equal(png.resize(same, 8, 8), same)


def test_near_copies_have_near_hashes(spark, tmp_path):
    from pyspark.sql import functions as F

    from caselens.functions import vectors as V
    from caselens.sources import readers

    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (6, 6)).repeat(16, 0).repeat(16, 1)
    pictures = {"a": base, "b": base + rng.integers(-3, 4, base.shape), "c": rng.integers(0, 256, (6, 6)).repeat(16, 0).repeat(16, 1)}
    for name, x in pictures.items():
        (tmp_path / f"{name}.png").write_bytes(png.write_png(np.clip(x, 0, 255).astype(np.uint8)[..., None].repeat(3, 2)))
    (tmp_path / "d.png").write_bytes(b"broken")
    got = readers.decoded(readers.read_images(spark, str(tmp_path)), [(8, 8), (9, 8)], png.thumbnails)
    hashes = got.select("path", "error", V.bits_to_long(V.average_hash(F.col("pixels")[0])).alias("a"), V.bits_to_long(V.difference_hash(F.col("pixels")[1], 9)).alias("d")).collect()
    h = {r.path[-5]: r for r in hashes}
    apart = lambda x, y: (h[x].a ^ h[y].a).bit_count() + (h[x].d ^ h[y].d).bit_count()
    assert apart("a", "b") <= 10 < apart("a", "c") and h["d"].error == "ValueError"
