"""Picture files, read back from our own writers, from Java's and from bytes written out by hand."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from tessera.sources import images, png
from tessera.sources.jpeg import encode_jpeg


def picture(h=37, w=51):
    y, x = np.mgrid[0:h, 0:w]
    out = np.stack([x * 3 % 256, y * 4 % 256, (x + y) % 256], 2).astype(np.uint8)
    out[10:20, 15:30] = [200, 30, 30]
    return out


@pytest.mark.parametrize("name", ["a.png", "a.BMP", "a.tif", "a.tiff"])
def test_own_files_read_back(name):
    assert (images.decode_as(png.encode_as(picture(), name), name) == picture()).all()


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (17, 9), (64, 3)])
def test_own_jpeg_reads_back(shape):
    image = picture(64, 64)[: shape[0], : shape[1]]
    back = images.decode_as(encode_jpeg(image), "a.jpeg")
    assert back.shape == image.shape and abs(back.astype(int) - image).max() <= 12


class Java:
    """The writers and readers that come with the JVM."""

    def __init__(self, spark):
        self.awt, self.imageio, self.io = spark._jvm.java.awt.image, spark._jvm.javax.imageio, spark._jvm.java.io

    def image(self, pixels, kind=1):
        h, w = pixels.shape[:2]
        out = self.awt.BufferedImage(w, h, kind)
        for y in range(h):
            for x in range(w):
                r, g, b = map(int, pixels[y, x])
                out.setRGB(x, y, r << 16 | g << 8 | b)
        return out

    def write(self, image, kind, packing=None, progressive=False):
        writer, out = self.imageio.ImageIO.getImageWritersByFormatName(kind).next(), self.io.ByteArrayOutputStream()
        writer.setOutput(self.imageio.ImageIO.createImageOutputStream(out))
        options = writer.getDefaultWriteParam()
        if packing:
            options.setCompressionMode(2)
            options.setCompressionType(packing)
        if progressive:
            options.setProgressiveMode(1)
        writer.write(None, self.imageio.IIOImage(image, None, None), options)
        writer.getOutput().flush()
        return bytes(out.toByteArray())

    def read(self, data):
        found = self.imageio.ImageIO.read(self.io.ByteArrayInputStream(data))
        values = np.array([[found.getRGB(x, y) for x in range(found.getWidth())] for y in range(found.getHeight())])
        return np.stack([values >> 16 & 255, values >> 8 & 255, values & 255], 2)


@pytest.mark.parametrize(("kind", "packing"), [("bmp", None), ("tiff", None), ("tiff", "LZW"), ("tiff", "Deflate"), ("tiff", "PackBits")])
def test_files_of_another_writer(spark, kind, packing):
    java = Java(spark)
    assert (images.decode_as(java.write(java.image(picture()), kind, packing), f"a.{kind}") == picture()).all()


@pytest.mark.parametrize(("kind", "packing", "colors"), [("bmp", None, 13), ("bmp", "BI_RLE8", 13), ("tiff", "LZW", 13), ("bmp", None, 12), ("tiff", "PackBits", 12)])
def test_palettes_of_another_writer(spark, kind, packing, colors):
    java = Java(spark)
    data = java.write(java.image(picture(), colors), kind, packing)
    assert (images.decode_as(data, f"a.{kind}") == java.read(data)).all()


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_of_another_writer(spark, progressive):
    """With half the colour samples each way; values differ by rounding only."""
    java = Java(spark)
    data = java.write(java.image(picture()), "jpeg", None, progressive)
    assert abs(images.decode_as(data, "a.jpg").astype(int) - java.read(data)).max() <= 2


def test_gray_jpeg_of_another_writer(spark):
    java = Java(spark)
    image = java.image(np.zeros((20, 20, 3), np.uint8), 10)
    for i in range(20):
        image.getRaster().setSample(i, i, 0, 200)
    data = java.write(image, "jpeg")
    found = java.imageio.ImageIO.read(java.io.ByteArrayInputStream(data)).getRaster()
    back = images.decode_as(data, "a.jpg").astype(int)
    assert all(abs(back[y, x] - found.getSample(x, y, 0)).max() <= 1 for y in range(20) for x in range(20))


def test_bmp_by_hand():
    head = lambda w, h, bits, packing, more=b"", n=0: struct.pack("<2sIIIIiiHHIIiiII", b"BM", 0, 0, 54 + len(more), 40, w, h, 1, bits, packing, 0, 0, 0, n, 0) + more
    # 5, 6 and 5 bits; rows from the top
    data = head(2, -1, 16, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F)) + struct.pack("<HH", 0xF800, 0x07FF)
    assert images.decode_bmp(data).tolist() == [[[255, 0, 0], [0, 255, 255]]]
    colors = bytes([0, 0, 0, 0, 1, 2, 3, 0, 4, 5, 6, 0])
    # half-byte runs: three of places 1 and 2 in turn, end of row, then two places as they are, end of picture
    data = head(3, 2, 4, 2, colors, 3) + bytes([3, 0x12, 0, 0, 0, 3, 0x21, 0x20, 0, 1])
    assert images.decode_bmp(data).tolist() == [[[6, 5, 4], [3, 2, 1], [6, 5, 4]], [[3, 2, 1], [6, 5, 4], [3, 2, 1]]]


def tiff(w, h, pixels, **tags):
    """Big-endian, one strip; tags by name t<number>."""
    found = {256: w, 257: h, 258: 8, 259: 1, 262: 1, 273: 8, 277: 1, 278: h, 279: len(pixels)} | {int(k[1:]): v for k, v in tags.items()}
    body = b"".join(struct.pack(">HHIHH", k, 3, 1, v, 0) for k, v in sorted(found.items()))
    return struct.pack(">2sHI", b"MM", 42, 8 + len(pixels)) + pixels + struct.pack(">H", len(found)) + body + bytes(4)


def test_tiff_by_hand():
    gray = lambda data: images.decode_tiff(data)[:, :, 0].tolist()
    assert gray(tiff(3, 1, bytes([1, 2, 3]))) == [[1, 2, 3]]
    assert gray(tiff(3, 1, bytes([1, 2, 3]), t262=0)) == [[254, 253, 252]]
    assert gray(tiff(3, 1, bytes([10, 1, 255]), t317=2)) == [[10, 11, 10]]
    assert gray(tiff(3, 1, bytes([0b10100000]), t258=1)) == [[255, 0, 255]]
    assert gray(tiff(5, 1, bytes([0xFE, 7, 1, 8, 9]), t259=32773)) == [[7, 7, 7, 8, 9]]
    # sixteen bits are rounded
    assert gray(tiff(3, 1, struct.pack(">3H", 128, 129, 65535), t258=16)) == [[0, 1, 255]]
    assert gray(tiff(2, 1, zlib.compress(bytes([4, 5])), t259=8)) == [[4, 5]]
    # codes of nine bits: clear, 5, the word that is just being made, end
    bits = "".join(f"{c:09b}" for c in (256, 5, 258, 257))
    assert gray(tiff(3, 1, int(bits.ljust(40, "0"), 2).to_bytes(5, "big"), t259=5)) == [[5, 5, 5]]


def test_wide_png_is_rounded():
    rows = b"\0" + struct.pack(">3H", 128, 129, 65535)
    data = png._SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 16, 2, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(rows)) + png._chunk(b"IEND", b"")
    assert png.decode(data).tolist() == [[[0, 1, 255]]]


@pytest.mark.parametrize("name", ["a.png", "a.bmp", "a.tif", "a.jpg", "a.gif", "a"])
def test_bad_files_are_told(name):
    whole = png.encode_as(picture(), name) if name not in ("a.gif", "a") else b"GIF89a"
    for data in (b"", b"BM", whole[:20], whole[: len(whole) // 2]):
        with pytest.raises(ValueError):
            images.decode_as(data, name)
