"""Sprites, animations, palettes, draw-order cubes and keyframe effects."""

from __future__ import annotations

import numpy as np

from skarn.codecs.cursor import Cursor, Truncated

PALETTED, TRUECOLOR = 0, 1


class FormatError(ValueError):
    pass


def unpack_runs(data: bytes, size: int) -> np.ndarray:
    """Run lengths of zero: 0 n stands for n zeros, all else for itself. A run of
    length 0 is none. Too short or too long data is padded or cut to ``size``."""
    src = np.frombuffer(data, np.uint8)
    out = np.zeros(size, np.uint8)
    at = place = 0
    while at < len(src) and place < size:
        zero = np.flatnonzero(src[at:] == 0)
        n = min(int(zero[0]) if len(zero) else len(src) - at, size - place)
        out[place : place + n] = src[at : at + n]
        at, place = at + n, place + n
        if at + 1 < len(src) and src[at] == 0:
            place += int(src[at + 1])
        at += 2
    return out


def sprite(data: bytes) -> dict:
    """{version, indexed: [(w, h, uint8 [h, w])], rgba: [uint8 [h, w, 4]], palette: uint8 [256, 4] or None}."""
    c = Cursor(data)
    if c.raw(2) != b"SP":
        raise FormatError("not a sprite")
    minor, major, n = c.take("BBH")
    version = major + minor / 10
    deep = c.one("H") if major >= 2 else 0
    indexed = []
    for _ in range(n):
        w, h = c.take("HH")
        pixels = unpack_runs(c.raw(c.one("H")), w * h) if version >= 2.1 else np.frombuffer(c.raw(w * h), np.uint8)
        indexed.append((w, h, pixels.reshape(h, w)))
    rgba = []
    for _ in range(deep):
        w, h = c.take("HH")
        abgr = np.frombuffer(c.raw(4 * w * h), np.uint8).reshape(h, w, 4)
        rgba.append(abgr[::-1, :, ::-1].copy())  # stored from the bottom row up
    return {"version": version, "indexed": indexed, "rgba": rgba, "palette": palette(data[-1024:]) if version >= 1.1 and c.rest() >= 1024 else None}


def palette(data: bytes) -> np.ndarray:
    if len(data) < 1024:
        raise Truncated("a palette has 1024 bytes")
    return np.frombuffer(data[:1024], np.uint8).reshape(256, 4).copy()


def colored(image: np.ndarray, colors: np.ndarray) -> np.ndarray:
    """RGBA of an indexed image; place 0 is transparent, all else opaque."""
    out = colors[image]
    out[..., 3] = np.where(image == 0, 0, 255)
    return out


def animation(data: bytes) -> dict:
    """{version, actions: [{interval_ms, frames: [{layers, attach, event}]}], events}."""
    c = Cursor(data)
    if c.raw(2) != b"AC":
        raise FormatError("not an animation")
    (version,) = c.take("H")
    actions = [{"interval_ms": 100.0, "frames": []} for _ in range(c.one("H"))]
    c.skip(10)
    for action in actions:
        for _ in range(c.one("I")):
            c.skip(32)
            layers = [_layer(c, version) for _ in range(c.one("I"))]
            event = c.one("i") if version >= 0x200 else -1
            attach = [{"x": x, "y": y, "attr": k} for _, x, y, k in c.records(c.one("I"), "4siii")] if version >= 0x203 else []
            action["frames"].append({"layers": layers, "attach": attach, "event": event})
    events = []
    if version >= 0x201:
        events = [c.text(40) for _ in range(c.one("I"))]
    if version >= 0x202:
        for action in actions:
            action["interval_ms"] = c.one("f") * 25
    return {"version": version, "actions": actions, "events": events}


def _layer(c: Cursor, version: int) -> dict:
    x, y, index, mirror = c.take("iiiI")
    out = {"x": x, "y": y, "index": index, "mirror": bool(mirror), "color": (255, 255, 255, 255), "scale": (1.0, 1.0), "rotation": 0, "kind": PALETTED, "size": (0, 0)}
    if version >= 0x200:
        out["color"] = c.take("BBBB")
        sx = c.one("f")
        out["scale"] = (sx, c.one("f") if version >= 0x204 else sx)
        out["rotation"], out["kind"] = c.take("ii")
        if version >= 0x205:
            out["size"] = c.take("ii")
    return out


def draw_order(data: bytes) -> list[tuple[int, int, int, int]]:
    """(layer, action, frame, priority) rows of a cube."""
    c = Cursor(data)
    c.take("fI")
    rows = []
    for layer in range(c.one("I") + 1):
        for action in range(c.one("I")):
            rows += [(layer, action, frame, r[0]) for frame, r in enumerate(c.records(c.one("I"), "iii"))]
    return rows


KEY = ("frame", "type", "x", "y", "uv", "xy", "texture", "texture_mode", "delay", "angle", "color", "source", "target", "preset")


def keyframes(data: bytes) -> dict:
    """{version, fps, last, layers: [{textures, keys}]} of a keyframe effect."""
    c = Cursor(data)
    if c.raw(4) != b"STRM":
        raise FormatError("not a keyframe effect")
    version, fps, last, count = c.take("IIII")
    c.skip(16)
    layers = []
    for _ in range(count):
        textures = [c.text(128) for _ in range(c.one("I"))]
        keys = []
        for r in c.records(c.one("I"), "iI2f8f8ffIff4fIII"):
            v = (*r[:4], list(r[4:12]), list(r[12:20]), *r[20:24], list(r[24:28]), *r[28:])
            keys.append(dict(zip(KEY, v, strict=True)))
        layers.append({"textures": textures, "keys": keys})
    return {"version": version, "fps": fps, "last": last, "layers": layers}


def last_key(effect: dict) -> int:
    """The header's last frame if it is sane, else the greatest keyframe."""
    if 0 < effect["last"] <= 10_000:
        return effect["last"]
    return max((k["frame"] for layer in effect["layers"] for k in layer["keys"]), default=0)
