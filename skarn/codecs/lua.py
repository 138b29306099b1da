"""Compiled Lua 5.1 data scripts: constants, and the tables that they build.

``run`` has two modes. STRICT runs straight-line table builders: calls do
nothing, jumps and tests are real, a generic for ends at once, and an operation
that is not known raises. LENIENT adds arithmetic and treats all control flow
as nothing. Scripts that depend on each other share one ``globals``.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from skarn.codecs.cursor import Cursor

STRICT, LENIENT = "strict", "lenient"
SIGNATURE = b"\x1bLua\x51"
#: Array elements that one SETLIST stores (a fixed value of the bytecode).
FLUSH = 50
#: Operand bit that tells constants from registers, and the jump bias (fixed values of the bytecode).
CONSTANT_BIT, JUMP_BIAS = 256, 131_071

#: Names of the operations by number (fixed values of the bytecode).
OPERATIONS = (
    "MOVE LOADK LOADBOOL LOADNIL GETUPVAL GETGLOBAL GETTABLE SETGLOBAL SETUPVAL SETTABLE NEWTABLE SELF ADD SUB MUL DIV MOD POW UNM NOT LEN CONCAT JMP EQ LT LE TEST TESTSET CALL TAILCALL RETURN FORLOOP FORPREP TFORLOOP SETLIST CLOSE CLOSURE VARARG"
).split()


class LuaError(ValueError):
    pass


class Table(dict):
    """A Lua table: storing nil removes the key; whole floats are whole keys."""

    @staticmethod
    def key(k: Any) -> Any:
        return int(k) if isinstance(k, float) and k.is_integer() else k

    def put(self, k: Any, v: Any) -> None:
        k = self.key(k)
        if v is None:
            self.pop(k, None)
        elif k is not None:
            self[k] = v

    def find(self, k: Any) -> Any:
        return self.get(self.key(k))

    __hash__ = object.__hash__  # tables are keys by identity


@dataclass
class Proto:
    code: list[int] = field(default_factory=list)
    constants: list[Any] = field(default_factory=list)
    nested: list[Proto] = field(default_factory=list)


def load(data: bytes) -> Proto:
    if data[:5] != SIGNATURE:
        raise LuaError("not a Lua 5.1 chunk")
    if data[6] != 1 or data[9] != 4:
        raise LuaError("only little-endian chunks of 4-byte instructions")
    widths = {1: "B", 2: "H", 4: "I", 8: "Q"}
    c = Cursor(data)
    c.skip(12)
    return _proto(c, widths[data[7]], widths[data[8]])


def _string(c: Cursor, size: str) -> str | None:
    n = c.one(size)
    return c.raw(n)[:-1].decode("latin-1") if n else None


def _proto(c: Cursor, whole: str, size: str) -> Proto:
    _string(c, size)
    c.take(whole * 2 + "BBBB")
    code = [w for (w,) in c.records(c.one(whole), "I")]
    read: dict[int, Callable[[], Any]] = {0: lambda: None, 1: lambda: c.one("B") != 0, 3: lambda: c.one("d"), 4: lambda: _string(c, size) or ""}
    constants = []
    for _ in range(c.one(whole)):
        kind = c.one("B")
        if kind not in read:
            raise LuaError(f"constant of type {kind}")
        constants.append(read[kind]())
    nested = [_proto(c, whole, size) for _ in range(c.one(whole))]
    c.records(c.one(whole), whole)
    for _ in range(c.one(whole)):
        _string(c, size)
        c.take(whole * 2)
    for _ in range(c.one(whole)):
        _string(c, size)
    return Proto(code, constants, nested)


def constants(data: bytes) -> list[dict] | None:
    """All constants in order, outer function first: {type, s, n, b}. None if
    the bytes are no chunk that can be read."""
    try:
        todo, out = [load(data)], []
    except (LuaError, ValueError, IndexError, KeyError):
        return None
    while todo:
        p = todo.pop()
        for v in p.constants:
            kind = "nil" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, float) else "string"
            out.append({"type": kind, "s": v if kind == "string" else None, "n": v if kind == "number" else None, "b": v if kind == "bool" else None})
        todo += reversed(p.nested)
    return out


class _Frame:
    def __init__(self, proto: Proto, globals_: Table, mode: str):
        self.p, self.g, self.mode, self.pc, self.r = proto, globals_, mode, 0, {}

    def value(self, operand: int) -> Any:
        return self.p.constants[operand - CONSTANT_BIT] if operand & CONSTANT_BIT else self.r.get(operand)

    def step(self) -> bool:
        word = self.p.code[self.pc]
        self.pc += 1
        number = word & 63
        name = OPERATIONS[number] if number < len(OPERATIONS) else str(number)
        if name == "RETURN":
            return False
        act = _ACTIONS.get(name) or (_LENIENT.get(name, _nothing) if self.mode == LENIENT else _STRICT.get(name))
        if act is None:
            raise LuaError(f"operation {name} at {self.pc - 1}")
        act(self, word >> 6 & 255, word >> 23 & 511, word >> 14 & 511, word >> 14 & 262_143)
        return True


def _nothing(f: _Frame, a: int, b: int, c: int, x: int) -> None:
    return None


def _move(f, a, b, c, x):
    f.r[a] = f.r.get(b)


def _loadk(f, a, b, c, x):
    f.r[a] = f.p.constants[x]


def _loadbool(f, a, b, c, x):
    f.r[a] = bool(b)
    f.pc += bool(c)


def _loadnil(f, a, b, c, x):
    f.r.update(dict.fromkeys(range(a, b + 1)))


def _getglobal(f, a, b, c, x):
    f.r[a] = f.g.find(f.p.constants[x])


def _setglobal(f, a, b, c, x):
    f.g.put(f.p.constants[x], f.r.get(a))


def _newtable(f, a, b, c, x):
    f.r[a] = Table()


def _gettable(f, a, b, c, x):
    t = f.r.get(b)
    f.r[a] = t.find(f.value(c)) if isinstance(t, Table) else None


def _settable(f, a, b, c, x):
    if isinstance(t := f.r.get(a), Table):
        t.put(f.value(b), f.value(c))


def _setlist(f, a, b, c, x):
    if not c:
        c = f.p.code[f.pc]
        f.pc += 1
    if not b:
        if f.mode == STRICT:
            raise LuaError("SETLIST without a count")
        while f.r.get(a + b + 1) is not None:
            b += 1
    if isinstance(t := f.r.get(a), Table):
        for k in range(1, b + 1):
            t.put((c - 1) * FLUSH + k, f.r.get(a + k))


def _closure(f, a, b, c, x):
    f.r[a] = f.p.nested[x]


def _jump(f, a, b, c, x):
    f.pc += x - JUMP_BIAS


def _test(f, a, b, c, x):
    v = f.r.get(a)
    f.pc += (v is None or v is False) == bool(c)


def _end_loop(f, a, b, c, x):
    f.pc += 1


def _arithmetic(op: Callable[[float, float], float]):
    def act(f, a, b, c, x):
        u, v = f.value(b), f.value(c)
        try:
            f.r[a] = op(u, v) if isinstance(u, (int, float)) and isinstance(v, (int, float)) else math.nan
        except ZeroDivisionError:
            f.r[a] = math.nan if not u or op is operator.mod else math.copysign(math.inf, u)

    return act


def _negate(f, a, b, c, x):
    v = f.r.get(b)
    f.r[a] = -v if isinstance(v, (int, float)) else math.nan


_ACTIONS = {
    "MOVE": _move, "LOADK": _loadk, "LOADBOOL": _loadbool, "LOADNIL": _loadnil, "GETGLOBAL": _getglobal, "SETGLOBAL": _setglobal,
    "NEWTABLE": _newtable, "GETTABLE": _gettable, "SETTABLE": _settable, "SETLIST": _setlist, "CLOSURE": _closure,
}
_STRICT = {"CALL": _nothing, "TAILCALL": _nothing, "JMP": _jump, "TEST": _test, "TFORLOOP": _end_loop}
_LENIENT = {
    "ADD": _arithmetic(operator.add), "SUB": _arithmetic(operator.sub), "MUL": _arithmetic(operator.mul), "DIV": _arithmetic(operator.truediv),
    "MOD": _arithmetic(operator.mod), "POW": _arithmetic(operator.pow), "UNM": _negate,
}


def run(data: bytes, globals_: Table | None = None, mode: str = STRICT) -> Table:
    """Run a chunk over ``globals_`` (a new table by default) and return it."""
    frame = _Frame(load(data), Table() if globals_ is None else globals_, mode)
    while frame.pc < len(frame.p.code) and frame.step():
        pass
    return frame.g


def plain(v: Any, _above: frozenset = frozenset()) -> Any:
    """A value as lists, dicts and rounded numbers: a table of whole keys is the
    list from its least to its greatest key, cycles are cut, numbers keep four
    decimals."""
    if isinstance(v, Table):
        if id(v) in _above:
            return None
        above = _above | {id(v)}
        if v and all(isinstance(k, int) and not isinstance(k, bool) for k in v):
            return [plain(v.get(k), above) for k in range(min(v), max(v) + 1)]
        return {str(k): plain(x, above) for k, x in v.items()}
    if isinstance(v, float):
        n = 0.0 if abs(v) < 1e-9 else math.floor(v * 1e4 + 0.5) / 1e4
        return int(n) if n.is_integer() else n
    return v
