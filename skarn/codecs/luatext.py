"""Table literals of uncompiled data scripts: ``name = { ... }`` at top level."""

from __future__ import annotations

import re
from typing import Any

_COMMENT = re.compile(r"--\[\[.*?\]\]|--[^\n]*", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<long>\[\[.*?\]\])|(?P<text>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<mark>[{}\[\]=,;])|(?P<word>[^\s{}\[\]=,;\"']+))", re.S
)
_TOP = re.compile(r"(_?[A-Za-z][A-Za-z0-9_]*|_[A-Za-z0-9_]+)\s*=\s*(?=[{\"'\[\d.-]|true|false|nil)")
_WORDS = {"true": True, "false": False, "nil": None}


class _Tokens:
    def __init__(self, text: str, at: int):
        self.text, self.at = text, at
        self.next()

    def next(self) -> tuple[str, str]:
        said = getattr(self, "head", ("", ""))
        self.before = self.at
        m = _TOKEN.match(self.text, self.at)
        self.head = (m.lastgroup, m[m.lastgroup]) if m else ("end", "")
        self.at = m.end() if m else self.at
        return said

    def accept(self, mark: str) -> bool:
        if self.head == ("mark", mark):
            self.next()
            return True
        return False


def _scalar(kind: str, raw: str) -> Any:
    if kind == "long":
        return raw[2:-2]
    if kind == "text":
        return re.sub(r"\\(.)", r"\1", raw[1:-1], flags=re.S)
    if raw in _WORDS:
        return _WORDS[raw]
    try:
        number = float(raw) if not raw.lower().startswith("0x") else float(int(raw, 16))
    except ValueError:
        return raw
    return int(number) if number.is_integer() else number


def _value(t: _Tokens) -> Any:
    if t.accept("{"):
        return _table(t)
    return _scalar(*t.next())


def _table(t: _Tokens) -> Any:
    keyed: dict[Any, Any] = {}
    listed: list[Any] = []
    while not t.accept("}"):
        if t.head[0] == "end":
            break
        if t.accept("["):
            key = _value(t)
            t.accept("]")
            t.accept("=")
            keyed[key] = _value(t)
        else:
            kind, raw = t.head
            item = _value(t)
            if kind == "word" and t.accept("="):
                keyed[raw] = _value(t)
            else:
                listed.append(item)
        if not t.accept(","):
            t.accept(";")
    keyed.update(enumerate(listed, 1))
    if all(isinstance(k, int) for k in keyed):
        return [keyed[k] for k in sorted(keyed)]
    return keyed


def parse(source: str) -> dict[str, Any]:
    """The top-level assignments of a script; tables of whole keys are lists."""
    text = _COMMENT.sub("", source)
    out: dict[str, Any] = {}
    at = 0
    while m := _TOP.search(text, at):
        t = _Tokens(text, m.end())
        out[m[1]] = _value(t)
        at = t.before
    return out
