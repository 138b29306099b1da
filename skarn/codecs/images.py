"""BMP and TGA in, PNG out, and the small repairs that textures need."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from skarn.codecs.cursor import Cursor
from skarn.codecs.sprites import FormatError


def key_magenta(rgba: np.ndarray) -> np.ndarray:
    """Magenta pixels become transparent black."""
    out = rgba.copy()
    out[(rgba[..., 0] > 250) & (rgba[..., 1] < 5) & (rgba[..., 2] > 250)] = 0
    return out


def bmp(data: bytes) -> np.ndarray:
    """uint8 [h, w, 4] of an uncompressed BMP of 1, 4, 8, 24 or 32 bits."""
    c = Cursor(data)
    if c.raw(2) != b"BM":
        raise FormatError("not a BMP")
    c.skip(8)
    start, header, w, h, _, bits, packing, _, _, _, used = c.take("IIiiHHIIiiI")
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise FormatError(f"BMP of {bits} bits, compression {packing}")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    body = Cursor(data[start : start + stride * rows]).raw(stride * rows)
    lines = np.frombuffer(body, np.uint8).reshape(rows, stride)
    if h > 0:
        lines = lines[::-1]
    out = np.full((rows, w, 4), 255, np.uint8)
    if bits <= 8:
        n = used or 1 << bits
        table = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(n, 4)[:, 2::-1]
        index = lines[:, :w] if bits == 8 else np.unpackbits(lines, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
        out[..., :3] = table[np.minimum(index[:, :w], n - 1)]
    else:
        k = bits // 8
        pixels = lines[:, : w * k].reshape(rows, w, k)
        out[..., :3] = pixels[..., 2::-1]
        if k == 4 and pixels[..., 3].any():
            out[..., 3] = pixels[..., 3]
    return key_magenta(out)


def tga(data: bytes) -> np.ndarray:
    """uint8 [h, w, 4] of a truecolour TGA (types 2 and 10, 24 or 32 bits)."""
    c = Cursor(data)
    skip, _, kind = c.take("BBB")
    c.skip(9)
    w, h, bits, flags = c.take("HHBB")
    c.skip(skip)
    k = bits // 8
    if kind not in (2, 10) or k not in (3, 4):
        raise FormatError(f"TGA of type {kind}, {bits} bits")
    if kind == 2:
        flat = np.frombuffer(c.raw(w * h * k), np.uint8).reshape(-1, k)
    else:
        parts, n = [], 0
        while n < w * h:
            head = c.one("B")
            run = (head & 127) + 1
            part = np.frombuffer(c.raw(k if head & 128 else run * k), np.uint8).reshape(-1, k)
            parts.append(np.repeat(part, run, 0) if head & 128 else part)
            n += run
        flat = np.concatenate(parts)[: w * h]
    pixels = flat.reshape(h, w, k)
    if not flags & 0x20:
        pixels = pixels[::-1]
    if flags & 0x10:
        pixels = pixels[:, ::-1]
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = pixels[..., 2::-1]
    if k == 4:
        out[..., 3] = pixels[..., 3]
    return out


def png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgba).reshape(h, w * 4)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def bleed(rgba: np.ndarray) -> np.ndarray:
    """Transparent pixels take the colour of the nearest opaque ones, grown ring
    by ring, so that filtering does not darken edges; alpha stays."""
    out = rgba.astype(np.int32)
    known = rgba[..., 3] > 0
    if not known.any():
        return rgba.copy()
    while not known.all():
        total, count = np.zeros((*known.shape, 3), np.int32), np.zeros(known.shape, np.int32)
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            there, color = np.zeros_like(known), np.zeros((*known.shape, 3), np.int32)
            y, x = slice(max(dy, 0), known.shape[0] + min(dy, 0)), slice(max(dx, 0), known.shape[1] + min(dx, 0))
            v, u = slice(max(-dy, 0), known.shape[0] + min(-dy, 0)), slice(max(-dx, 0), known.shape[1] + min(-dx, 0))
            there[y, x], color[y, x] = known[v, u], out[v, u, :3]
            total += color * there[..., None]
            count += there
        ring = ~known & (count > 0)
        out[ring, :3] = total[ring] // count[ring, None]
        known |= ring
    return out.astype(np.uint8)


def key_corner(rgba: np.ndarray, tolerance: int = 24) -> np.ndarray:
    """The area of about the corners' colour that touches the border becomes
    transparent; an image of which half or more would go is left alone."""
    h, w = rgba.shape[:2]
    near = np.abs(rgba[..., :3].astype(int) - rgba[0, 0, :3].astype(int)).max(-1) <= tolerance
    gone = np.zeros((h, w), bool)
    for y, x in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)):
        gone[y, x] = near[y, x]
    while True:
        grown = gone.copy()
        grown[1:] |= gone[:-1]
        grown[:-1] |= gone[1:]
        grown[:, 1:] |= gone[:, :-1]
        grown[:, :-1] |= gone[:, 1:]
        grown &= near
        if (grown == gone).all():
            break
        gone = grown
    if 2 * gone.sum() >= h * w:
        return rgba.copy()
    out = rgba.copy()
    out[gone, 3] = 0
    return out
