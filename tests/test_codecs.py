import struct
import zlib

import numpy as np
import pytest

from skarn.codecs import audio, images, lua, luatext, scenes, sprites
from skarn.codecs.cursor import Truncated
from skarn.render import compose


def string(s):
    return struct.pack("<I", len(s) + 1) + s.encode("latin-1") + b"\0" if s is not None else struct.pack("<I", 0)


def chunk(code, constants, nested=()):
    def proto(code, constants, nested):
        out = string("@x") + struct.pack("<II", 0, 0) + bytes(4) + struct.pack("<I", len(code)) + b"".join(struct.pack("<I", w) for w in code)
        out += struct.pack("<I", len(constants))
        for v in constants:
            out += b"\0" if v is None else b"\1" + bytes([v]) if isinstance(v, bool) else b"\3" + struct.pack("<d", v) if isinstance(v, (int, float)) else b"\4" + string(v)
        out += struct.pack("<I", len(nested)) + b"".join(proto(*p) for p in nested)
        return out + struct.pack("<III", 0, 0, 0)

    return b"\x1bLua\x51\0\1\4\4\4\x08\0" + proto(code, constants, nested)


def op(name, a=0, b=0, c=0, bx=None):
    n = lua.OPERATIONS.index(name)
    return n | a << 6 | (bx << 14 if bx is not None else b << 23 | c << 14)


K = 256


def test_tables_are_built():
    code = [op("NEWTABLE", 0), op("SETTABLE", 0, K + 1, K + 2), op("SETTABLE", 0, K + 1, K + 3), op("SETTABLE", 0, K + 4, K + 2), op("SETGLOBAL", 0, bx=0), op("RETURN", 0, 1)]
    g = lua.run(chunk(code, ["t", 1, "x", None, 2]))
    assert g["t"] == {2: "x"}


def test_setlist_and_plain():
    code = [op("NEWTABLE", 0), op("LOADK", 1, bx=1), op("LOADK", 2, bx=2), op("SETLIST", 0, 2, 1), op("SETGLOBAL", 0, bx=0), op("RETURN", 0, 1)]
    assert lua.plain(lua.run(chunk(code, ["t", 1.00004, 7]))["t"]) == [1, 7]


def test_tests_jump_on_lua_truth():
    def guarded(value):
        code = [op("LOADK", 0, bx=1), op("TEST", 0, 0, 0), op("JMP", bx=131_071 + 2), op("LOADK", 1, bx=2), op("SETGLOBAL", 1, bx=0), op("RETURN", 0, 1)]
        return lua.run(chunk(code, ["g", value, "set"])).get("g")

    assert guarded(0) == "set" and guarded("") == "set" and guarded(None) is None and guarded(False) is None


def test_modes_differ():
    code = [op("LOADK", 0, bx=1), op("ADD", 0, 0, K + 1), op("SETGLOBAL", 0, bx=0), op("RETURN", 0, 1)]
    assert lua.run(chunk(code, ["g", 2]), mode=lua.LENIENT)["g"] == 4
    with pytest.raises(lua.LuaError):
        lua.run(chunk(code, ["g", 2]))


def test_constants_outer_first():
    got = lua.constants(chunk([], ["a", 1], [([], ["b"], []), ([], [None, True], [])]))
    assert [c["type"] for c in got] == ["string", "number", "string", "nil", "bool"]
    assert lua.constants(b"junk") is None


def test_text_tables():
    got = luatext.parse('-- c\n_list = { [1] = "a", [2] = { x = 1.5, y = true, "z" } } --[[ b ]] _n = 3')
    assert got == {"_list": ["a", {"x": 1.5, "y": True, 1: "z"}], "_n": 3}


def sprite_file(rgba):
    h, w = rgba.shape[:2]
    return b"SP\0\2" + struct.pack("<HH", 0, 1) + struct.pack("<HH", w, h) + rgba[::-1, :, ::-1].tobytes() + bytes(1024)


def action_file(layers):
    body = b"AC" + struct.pack("<HH", 0x203, 1) + bytes(10) + struct.pack("<I", 1) + bytes(32) + struct.pack("<I", len(layers))
    for x, y, index in layers:
        body += struct.pack("<iiiI", x, y, index, 0) + b"\xff\xff\xff\xff" + struct.pack("<fii", 1.0, 0, 1)
    return body + struct.pack("<iI", -1, 0) + struct.pack("<I", 0) + struct.pack("<f", 4.0)


def test_sprites_and_frames():
    solid = np.full((2, 2, 4), 255, np.uint8)
    s, a = sprites.sprite(sprite_file(solid)), sprites.animation(action_file([(0, -10, 0), (0, 10, 0)]))
    assert (s["rgba"][0] == solid).all() and a["actions"][0]["interval_ms"] == 100
    image, at = compose.frame(s, a["actions"][0]["frames"][0])
    assert image.shape == (22, 2, 4) and at == (-1, -11) and image[0, 0, 3] == 255 and image[10, 0, 3] == 0
    with pytest.raises(Truncated):
        sprites.animation(action_file([(0, 0, 0)])[:-9])


def test_runs():
    assert sprites.unpack_runs(bytes([1, 0, 3, 2, 0, 0, 5]), 6).tolist() == [1, 0, 0, 0, 2, 5]


def test_blend_is_integer():
    under, over = np.array([[10, 20, 30, 128]], np.uint8), np.array([[200, 100, 50, 64]], np.uint8)
    alpha = 64 + 128 * 191 // 255
    want = [(s * 64 // 255 + d * 128 * 191 // 65025) * 255 // alpha for s, d in ((200, 10), (100, 20), (50, 30))]
    assert compose.blend(under, over)[0].tolist() == [*want, alpha]
    assert compose.blend(under * 0, over)[0].tolist() == [200, 100, 50, 64]


def test_effects_and_cubes():
    key = struct.pack("<iI2f8f8ffIff4fIII", 5, 0, *[0.0] * 18, 0.0, 0, 1.0, 2.0, *[1.0] * 4, 1, 2, 3)
    data = b"STRM" + struct.pack("<IIII", 0x94, 60, 0, 1) + bytes(16) + struct.pack("<I", 1) + b"a.bmp".ljust(128, b"\0") + struct.pack("<I", 1) + key
    got = sprites.keyframes(data)
    assert got["layers"][0]["textures"] == ["a.bmp"] and got["layers"][0]["keys"][0]["angle"] == 2.0 and sprites.last_key(got) == 5
    cube = struct.pack("<fI", 1.0, 0) + struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", 1) + struct.pack("<iii", 7, 0, 0)
    assert sprites.draw_order(cube) == [(0, 0, 0, 7)]


def test_scene_effects():
    data = b"GRSW" + bytes([2, 1]) + bytes(160) + struct.pack("<f", 0) + struct.pack("<ifff", 3, 0, 0, 0) + struct.pack("<i", 0) + struct.pack("<ii6f", *[0] * 8) + struct.pack("<f", 0) + struct.pack("<4i", *[0] * 4)
    effect = struct.pack("<i", 4) + bytes(80) + struct.pack("<3fif4f", 5, 10, 15, 109, 2, 1, 2, 3, 4)
    got = scenes.scene(data + struct.pack("<i", 2) + effect + struct.pack("<i", 9))
    assert got["water"] == 3 and got["effects"] == [{"id": 109, "pos": [1.0, 2.0, 3.0], "delay": 2.0, "param": [1.0, 2.0, 3.0, 4.0]}]


def test_images():
    bmp = b"BM" + bytes(8) + struct.pack("<I", 54) + struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([255, 0, 255, 0]) + bytes([1, 2, 3, 0])
    got = images.bmp(bmp)
    assert got[0, 0].tolist() == [3, 2, 1, 255] and got[1, 0].tolist() == [0, 0, 0, 0]
    tga = bytes([0, 0, 10]) + bytes(9) + struct.pack("<HHBB", 2, 1, 32, 0x20) + bytes([0x81, 1, 2, 3, 4])
    assert images.tga(tga)[0].tolist() == [[3, 2, 1, 4]] * 2
    png = images.png(got)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(png[41 : 41 + struct.unpack(">I", png[33:37])[0]])[0] == 0
    spread = images.bleed(np.array([[[9, 8, 7, 255], [0, 0, 0, 0], [0, 0, 0, 0]]], np.uint8))
    assert spread[0, 2].tolist() == [9, 8, 7, 0]


def test_audio():
    pcm = audio.wave(np.zeros((4, 1), np.int16), 8000)
    assert audio.to_pcm(pcm) == (pcm, 1)
    block = struct.pack("<hBB", 100, 0, 0) + bytes([0x77, 0, 0, 0])
    head = struct.pack("<HHIIHHHH", 0x11, 1, 8000, 0, len(block), 4, 2, 9)
    data = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(block)) + block
    out, tag = audio.to_pcm(data)
    samples = np.frombuffer(audio.chunks(out)["data"], np.int16)
    assert tag == 0x11 and len(samples) == 9 and samples[:3].tolist() == [100, 111, 141]
