"""Map scenes: what they place, and the textures that ground and models name."""

from __future__ import annotations

from skarn.codecs.cursor import Cursor
from skarn.codecs.sprites import FormatError

#: Units of a stored position in one of the published ones.
SCALE = 5


def _version(c: Cursor, *magic: bytes) -> float:
    if c.raw(4) not in magic:
        raise FormatError(f"not one of {magic}")
    major, minor = c.take("bb")
    return major + minor / 10


def _distinct(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


#: (first version, version that no longer has it, struct format) of a scene's
#: header before and after its file names (fixed values of the format).
_BEFORE = ((2.5, 9, "i"), (2.2, 9, "B"))
_AFTER = (
    (1.3, 2.6, "f"), (1.8, 2.6, "ifff"), (1.9, 2.6, "i"), (1.5, 9, "ii6f"), (1.7, 9, "f"), (1.6, 9, "4i"),
)


def scene(data: bytes) -> dict:
    """{models, water, effects: [{id, pos, delay, param}]}; the list of objects
    ends at a type that is not known."""
    c = Cursor(data)
    version = _version(c, b"GRSW")
    for first, last, fmt in _BEFORE:
        if first <= version < last:
            c.take(fmt)
    c.skip(160 if version >= 1.4 else 120)
    water = 0
    for first, last, fmt in _AFTER:
        if first <= version < last:
            values = c.take(fmt)
            water = values[0] if fmt == "ifff" else water
    if version >= 2.7:
        c.skip(4 * c.one("i"))
    models, effects = [], []
    for _ in range(c.one("i")):
        kind = c.one("i")
        if kind == 1:
            c.skip((52 if version >= 1.3 else 0) + (version >= 2.6) + 4 * (version >= 2.7))
            models.append(c.text(80))
            c.skip(80 + 36)
        elif kind == 2:
            c.skip(80 + 28)
        elif kind == 3:
            c.skip(160 + 28 + 4 * (version >= 2.0))
        elif kind == 4:
            c.skip(80)
            x, y, z, number, delay, *param = c.take("3fif4f")
            effects.append({"id": number, "pos": [v / SCALE for v in (x, y, z)], "delay": delay, "param": param})
        else:
            break
    return {"models": _distinct(models), "water": water, "effects": effects}


def ground_textures(data: bytes) -> list[str]:
    c = Cursor(data)
    _version(c, b"GRGN")
    _, _, _, count, width = c.take("IIfII")
    return _distinct([c.text(width) for _ in range(count)])


def model_textures(data: bytes) -> list[str]:
    """Names of all textures, also those that the nodes of later versions carry."""
    c = Cursor(data)
    version = _version(c, b"GRSM", b"GRSX")
    c.take("ii")
    if version >= 1.4:
        c.one("B")
    if version < 2.2:
        c.skip(16)
        return _distinct([c.text(40) for _ in range(c.one("I"))])
    c.one("f")
    names = [c.counted() for _ in range(c.one("I"))]
    if version < 2.3:
        names += [c.counted() for _ in range(c.one("I"))]
    for _ in range(c.one("I")):
        c.counted(), c.counted()
        held = range(c.one("I"))
        if version >= 2.3:
            names += [c.counted() for _ in held]
        else:
            c.skip(4 * len(held))
        c.skip(48)
        for width in (12, 12):
            c.skip(width * c.one("I"))
        for _ in range(c.one("I")):
            c.skip(c.one("i"))
        for width in (20, 20, 20):
            c.skip(width * c.one("I"))
        if version >= 2.3:
            for _ in range(c.one("I")):
                c.one("i")
                for _ in range(c.one("I")):
                    c.one("i")
                    c.skip(8 * c.one("I"))
    return _distinct(names)
