"""Compositing of animation frames in exact integer arithmetic.

Layers are drawn by an affine map from the layer's image to the canvas:
translate, rotate, scale, centre. Every canvas pixel is mapped back (float32)
and takes the nearest source pixel; tints and blends truncate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.codecs import images, sprites


def tint(pixels: np.ndarray, color: tuple[int, int, int, int]) -> np.ndarray:
    return (pixels.astype(np.int32) * np.array(color, np.int32) // 255).astype(np.uint8)


def blend(under: np.ndarray, over: np.ndarray) -> np.ndarray:
    """``over`` onto ``under``, straight alpha, integer division throughout."""
    d, s = under.astype(np.int64), over.astype(np.int64)
    sa, da = s[..., 3:], d[..., 3:]
    alpha = sa + da * (255 - sa) // 255
    safe = np.maximum(alpha, 1)
    rgb = (s[..., :3] * sa // 255 + d[..., :3] * da * (255 - sa) // 65_025) * 255 // safe
    out = np.where(alpha == 0, 0, np.concatenate([rgb & 255, alpha], -1))
    return np.where((da == 0) | (sa == 255), s, out).astype(np.uint8)


def transform(layer: dict, size: tuple[int, int]) -> np.ndarray:
    """3 x 3 float32 matrix from image to canvas places."""
    turn = math.radians(layer["rotation"])
    sx, sy = layer["scale"]
    cos, sin = np.float32(math.cos(turn)), np.float32(math.sin(turn))
    flip = -1 if layer["mirror"] else 1
    linear = np.array([[cos * sx * flip, -sin * sy], [sin * sx * flip, cos * sy]], np.float32)
    out = np.eye(3, dtype=np.float32)
    out[:2, :2] = linear
    out[:2, 2] = np.array([layer["x"], layer["y"]], np.float32) - linear @ np.array([size[0] / 2, size[1] / 2], np.float32)
    return out


def box(matrix: np.ndarray, size: tuple[int, int]) -> tuple[int, int, int, int]:
    """Bounds of the mapped image, truncated toward zero."""
    w, h = size
    corners = matrix @ np.array([[0, w, 0, w], [0, 0, h, h], [1, 1, 1, 1]], np.float32)
    x, y = corners[0], corners[1]
    return int(x.min()), int(y.min()), int(x.max()), int(y.max())


def union(boxes: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int] | None:
    if not boxes:
        return None
    a = np.array(boxes)
    return int(a[:, 0].min()), int(a[:, 1].min()), int(a[:, 2].max()), int(a[:, 3].max())


def draw(canvas: np.ndarray, origin: tuple[int, int], image: np.ndarray, matrix: np.ndarray, color: tuple[int, int, int, int]) -> None:
    """Draw onto ``canvas``, whose place (0, 0) is ``origin``."""
    if color[3] == 0 or not image.size:
        return
    h, w = image.shape[:2]
    x0, y0, x1, y1 = box(matrix, (w, h))
    left, top = max(x0, origin[0]), max(y0, origin[1])
    right, bottom = min(x1, origin[0] + canvas.shape[1]), min(y1, origin[1] + canvas.shape[0])
    if left >= right or top >= bottom or abs(np.linalg.det(matrix)) < 1e-12:
        return
    back = np.linalg.inv(matrix.astype(np.float32))
    xs, ys = np.meshgrid(np.arange(left, right, dtype=np.float32), np.arange(top, bottom, dtype=np.float32))
    at = back @ np.stack([xs.ravel(), ys.ravel(), np.ones(xs.size, np.float32)])
    sx, sy = (np.trunc(v + np.copysign(np.float32(0.5), v)).astype(np.int64) for v in at[:2])
    ok = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
    source = np.zeros((xs.size, 4), np.uint8)
    source[ok] = image[sy[ok], sx[ok]]
    ok &= source[:, 3] > 0
    view = canvas[top - origin[1] : bottom - origin[1], left - origin[0] : right - origin[0]].reshape(-1, 4).copy()
    view[ok] = blend(view[ok], tint(source[ok], color))
    canvas[top - origin[1] : bottom - origin[1], left - origin[0] : right - origin[0]] = view.reshape(bottom - top, right - left, 4)


def layer_image(sprite: dict, layer: dict) -> np.ndarray | None:
    """RGBA of what a layer shows, None if there is no such image."""
    if layer["index"] < 0:
        return None
    if layer["kind"] == sprites.TRUECOLOR:
        return sprite["rgba"][layer["index"]] if layer["index"] < len(sprite["rgba"]) else None
    if layer["index"] >= len(sprite["indexed"]) or sprite["palette"] is None:
        return None
    return sprites.colored(sprite["indexed"][layer["index"]][2], sprite["palette"])


def frame(sprite: dict, frame_: dict) -> tuple[np.ndarray, tuple[int, int]] | None:
    """(image, its upper left place) of a frame, None if it shows nothing."""
    todo = []
    for layer in frame_["layers"]:
        image = layer_image(sprite, layer)
        if image is not None and image.size and layer["color"][3]:
            matrix = transform(layer, (image.shape[1], image.shape[0]))
            todo.append((image, matrix, layer["color"]))
    bounds = union([box(m, (i.shape[1], i.shape[0])) for i, m, _ in todo])
    if bounds is None or bounds[0] >= bounds[2] or bounds[1] >= bounds[3]:
        return None
    canvas = np.zeros((bounds[3] - bounds[1], bounds[2] - bounds[0], 4), np.uint8)
    for image, matrix, color in todo:
        draw(canvas, bounds[:2], image, matrix, color)
    return canvas, bounds[:2]


def render(requests: DataFrame) -> DataFrame:
    """PNG of each request row (id, sprite binary, animation binary, action int,
    frame int): (id, png, width, height, error). A bad request has an error and
    no image; the others are not touched by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    act = sprites.animation(r["animation"])
                    actions = act["actions"]
                    frames = actions[r["action"] % len(actions)]["frames"]
                    got = frame(sprites.sprite(r["sprite"]), frames[r["frame"] % len(frames)])
                    rows.append((r["id"], None, 0, 0, None) if got is None else (r["id"], images.png(got[0]), got[0].shape[1], got[0].shape[0], None))
                except (ValueError, ZeroDivisionError, TypeError) as e:
                    rows.append((r["id"], None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "png", "width", "height", "error"])

    return requests.select("id", "sprite", "animation", "action", "frame").mapInArrow(run, "id long, png binary, width int, height int, error string")


#: Places in the drawing order by kind of layer: facing away, and all else (fixed values).
FACING_AWAY = {"body": 15, "head": 20, "headgear": 25, "weapon": 30, "shield": 10}
FACING = {"body": 10, "head": 15, "headgear": 20, "weapon": 25, "shield": 30}


def z_index(kind: Column, slot: Column, direction: Column, behind: Column, head_first: Column) -> Column:
    """The drawing order of a layer. ``slot`` numbers layers of one kind;
    headgear and weapons count up to their place; a head that its body puts
    first stands just below the body."""
    base = {n: F.when(direction.between(2, 5), FACING_AWAY[n]).otherwise(FACING[n]) for n in FACING}
    return (
        F.when(kind == "shadow", F.lit(-1))
        .when((kind == "headgear") & behind, slot + 1)
        .when(kind == "hat_effect", slot + 35)
        .when(kind == "head", F.when(head_first, base["body"] - 1).otherwise(base["head"]))
        .when(kind == "headgear", base["headgear"] - 3 + slot)
        .when(kind == "weapon", base["weapon"] - 2 + slot)
        .when(kind == "body", base["body"])
        .when(kind == "shield", base["shield"])
        .otherwise(0)
    )
