"""Little-endian reading of byte strings by struct formats."""

from __future__ import annotations

import struct
from functools import lru_cache


class Truncated(ValueError):
    """The bytes end before the format does."""


@lru_cache(maxsize=256)
def _compiled(fmt: str) -> struct.Struct:
    return struct.Struct("<" + fmt)


class Cursor:
    """``take('IhB')`` gives the next fields; reading past the end raises Truncated."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, fmt: str) -> tuple:
        s = _compiled(fmt)
        self._need(s.size)
        out = s.unpack_from(self.data, self.at)
        self.at += s.size
        return out

    def one(self, fmt: str):
        return self.take(fmt)[0]

    def raw(self, n: int) -> bytes:
        self._need(n)
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def skip(self, n: int) -> None:
        self._need(n)
        self.at += n

    def text(self, n: int) -> str:
        """A fixed field up to its first NUL, bytes kept one to one."""
        return self.raw(n).split(b"\0", 1)[0].decode("latin-1")

    def counted(self) -> str:
        return self.text(self.one("I"))

    def records(self, n: int, fmt: str) -> list[tuple]:
        """n records; the size is checked before anything is made."""
        s = _compiled(fmt)
        self._need(s.size * n)
        out = list(s.iter_unpack(self.data[self.at : self.at + s.size * n]))
        self.at += s.size * n
        return out

    def rest(self) -> int:
        return len(self.data) - self.at

    def _need(self, n: int) -> None:
        if n < 0 or n > self.rest():
            raise Truncated(f"{n} bytes asked for at {self.at}, {self.rest()} left")
