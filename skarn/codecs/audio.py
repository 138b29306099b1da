"""RIFF WAVE: chunks, and IMA and Microsoft ADPCM to 16-bit PCM."""

from __future__ import annotations

import struct

import numpy as np

from skarn.codecs.cursor import Cursor
from skarn.codecs.sprites import FormatError

PCM, MS_ADPCM, FLOAT, IMA_ADPCM, EXTENSIBLE = 1, 2, 3, 0x11, 0xFFFE
#: Fixed values of the codecs.
IMA_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
MS_ADAPT = (230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230)
MS_PAIRS = ((256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232))
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


def chunks(data: bytes) -> dict:
    """{tag, channels, rate, block, bits, extra, data}; chunks are padded to even sizes."""
    c = Cursor(data)
    if c.raw(4) != b"RIFF" or (c.skip(4), c.raw(4))[1] != b"WAVE":
        raise FormatError("not a WAVE file")
    out: dict = {}
    while c.rest() >= 8:
        name, size = c.take("4sI")
        body = c.raw(min(size, c.rest()))
        c.skip(min(size & 1, c.rest()))
        if name == b"fmt ":
            tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", body)
            out |= {"tag": tag, "channels": channels, "rate": rate, "block": block, "bits": bits, "extra": body[16:]}
        elif name == b"data" and "data" not in out:
            out["data"] = body
    if "tag" not in out or "data" not in out:
        raise FormatError("WAVE file without format or data")
    return out


def _clamp(v: int) -> int:
    return max(-32768, min(32767, v))


class _Ima:
    def __init__(self, predictor: int, index: int):
        self.value, self.index = predictor, min(max(index, 0), 88)

    def next(self, nibble: int) -> int:
        step = IMA_STEPS[self.index]
        delta = (step >> 3) + sum(step >> k for k, bit in ((0, 4), (1, 2), (2, 1)) if nibble & bit)
        self.value = _clamp(self.value - delta if nibble & 8 else self.value + delta)
        self.index = min(max(self.index + IMA_INDEX[nibble & 7], 0), 88)
        return self.value


def _whole_blocks(data: bytes, block: int, head: int) -> list[bytes]:
    if block < head:
        raise FormatError(f"blocks of {block} bytes cannot hold their heads of {head}")
    return [data[at : at + block] for at in range(0, len(data) - block + 1, block)]


def ima(data: bytes, channels: int, block: int) -> np.ndarray:
    """int16 [samples, channels] of the whole blocks; a short last one is left out."""
    out = []
    for part in _whole_blocks(data, block, 4 * channels):
        state, lanes = [], []
        for k in range(channels):
            predictor, index = struct.unpack_from("<hB", part, 4 * k)
            state.append(_Ima(predictor, index))
            lanes.append([predictor])
        words = np.frombuffer(part[4 * channels : len(part) // (4 * channels) * 4 * channels], np.uint8).reshape(-1, channels, 4)
        for group in words:
            for k in range(channels):
                for byte in group[k].tolist():
                    lanes[k] += [state[k].next(byte & 15), state[k].next(byte >> 4)]
        out.append(np.array(lanes, np.int16).T)
    return np.concatenate(out) if out else np.zeros((0, channels), np.int16)


def microsoft(data: bytes, channels: int, block: int, pairs: tuple = MS_PAIRS) -> np.ndarray:
    """The same; a block whose predictor is not in the table is left out."""
    out = []
    for part in _whole_blocks(data, block, 7 * channels):
        which = part[:channels]
        if max(which) >= len(pairs):
            continue
        delta, first, second = (list(struct.unpack_from(f"<{channels}h", part, channels + 2 * channels * k)) for k in range(3))
        lanes = [[second[k], first[k]] for k in range(channels)]
        turn = 0
        for byte in part[7 * channels :]:
            for nibble in (byte >> 4, byte & 15):
                k = turn % channels
                turn += 1
                a, b = pairs[which[k]]
                guess = (lanes[k][-1] * a + lanes[k][-2] * b) >> 8
                lanes[k].append(_clamp(guess + (nibble - 16 if nibble & 8 else nibble) * delta[k]))
                delta[k] = max(16, delta[k] * MS_ADAPT[nibble] >> 8)
        n = min(map(len, lanes))
        out.append(np.array([lane[:n] for lane in lanes], np.int16).T)
    return np.concatenate(out) if out else np.zeros((0, channels), np.int16)


def wave(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit PCM WAVE file of int16 [samples, channels]."""
    body, channels = np.ascontiguousarray(samples, "<i2").tobytes(), samples.shape[1]
    head = struct.pack("<HHIIHH", PCM, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def to_pcm(data: bytes) -> tuple[bytes, int]:
    """(file, format tag before): ADPCM becomes PCM, PCM and float pass."""
    w = chunks(data)
    tag = w["tag"]
    if tag == EXTENSIBLE and len(w["extra"]) >= 10:
        (tag,) = struct.unpack_from("<H", w["extra"], 8)
    if tag in (PCM, FLOAT):
        return data, tag
    if tag == IMA_ADPCM:
        return wave(ima(w["data"], w["channels"], w["block"]), w["rate"]), tag
    if tag == MS_ADPCM:
        pairs = MS_PAIRS
        if len(w["extra"]) >= 6:
            (n,) = struct.unpack_from("<H", w["extra"], 4)
            if n and len(w["extra"]) >= 6 + 4 * n:
                pairs = tuple(struct.iter_unpack("<hh", w["extra"][6 : 6 + 4 * n]))
        return wave(microsoft(w["data"], w["channels"], w["block"], pairs), w["rate"]), tag
    raise FormatError(f"WAVE format {tag:#x}")
