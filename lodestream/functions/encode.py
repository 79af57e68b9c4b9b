"""Writes values and located documents as JSON text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from lodestream.functions.lexer import Node, Reader
from lodestream.functions.values import Number
from lodestream.plans.model import MAX_NESTING, Document, JsonError

_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ESCAPE = re.compile(r'[\x00-\x1f"\\]')
_ESCAPE_ASCII = re.compile(r'[\x00-\x1f"\\]|[^\x00-\x7f]')
#: Items of a top-level array in one part of a parallel write, at least.
LEAST_ITEMS = 512


@dataclass(frozen=True)
class Options:
    """indent: None for compact text, a number of spaces, or a tab; framing: none, ndjson or jsonseq."""

    indent: int | str | None = None
    sort_keys: bool = False
    ascii: bool = False
    dialect: str = "rfc8259"
    framing: str = "none"


def _escaped(m: re.Match) -> str:
    c = m.group()
    if c in _SHORT:
        return _SHORT[c]
    code = ord(c)
    if code > 0xFFFF:
        code -= 0x10000
        return f"\\u{0xD800 + (code >> 10):04x}\\u{0xDC00 + (code & 0x3FF):04x}"
    return f"\\u{code:04x}"


def quoted(text: str, ascii: bool = False) -> str:
    return '"' + (_ESCAPE_ASCII if ascii else _ESCAPE).sub(_escaped, text) + '"'


class _Writer:
    def __init__(self, options: Options):
        self.o = options
        unit = options.indent
        self.unit = None if unit is None else unit if isinstance(unit, str) else " " * unit

    def line(self, depth: int) -> str:
        return "" if self.unit is None else "\n" + self.unit * depth

    def value(self, v: Any, depth: int = 0) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, Number):
            if not v.finite and self.o.dialect != "json5":
                raise JsonError("Write", "write", 0, "this dialect has no infinities")
            return v.spelling
        if isinstance(v, str):
            return quoted(v, self.o.ascii)
        if depth >= MAX_NESTING:
            raise JsonError("Limit", "nesting", 0)
        if isinstance(v, list):
            parts, ends = [self.value(x, depth + 1) for x in v], "[]"
        else:
            members = sorted(v.items(), key=lambda kv: kv[0].encode()) if self.o.sort_keys else v.items()
            colon = ":" if self.unit is None else ": "
            parts, ends = [quoted(k, self.o.ascii) + colon + self.value(x, depth + 1) for k, x in members], "{}"
        return self.container(parts, ends, depth)

    def container(self, parts: list[str], ends: str, depth: int) -> str:
        if not parts:
            return ends
        inner = self.line(depth + 1)
        return ends[0] + inner + ("," + inner).join(parts) + self.line(depth) + ends[1]

    def node(self, src: bytes, n: Node, depth: int = 0) -> str:
        """Tokens as authored, without white space of their own; comments are written again where they stand."""
        if n.kind not in ("array", "object"):
            return src[n.start : n.end].decode()
        if depth >= MAX_NESTING:
            raise JsonError("Limit", "nesting", 0)
        comments: dict[int, list[str]] = {}
        children = n.children()
        for s, e, _ in n.comments:
            text = src[s:e].decode()
            comments.setdefault(sum(c.start < s for c in children), []).append(text + "\n" if text.startswith("//") else text)
        lead = lambda i: "".join(comments.get(i, []))
        colon = ":" if self.unit is None else ": "
        if n.kind == "array":
            parts = [lead(i) + self.node(src, x, depth + 1) for i, x in enumerate(n.items)]
        else:
            parts = []
            for i, (_, key, x) in enumerate(n.members):
                reader = Reader(src, "json5" if self.o.dialect == "json5" else "rfc8259")
                reader.at = key
                reader._name()
                parts.append(lead(i) + src[key : reader.at].decode() + colon + self.node(src, x, depth + 1))
        tail = lead(len(children))
        if not parts and not tail:
            return "[]" if n.kind == "array" else "{}"
        ends = "[]" if n.kind == "array" else "{}"
        if not parts:
            return ends[0] + tail + ends[1]
        body = self.container(parts, ends, depth)
        return body[:-1] + tail + body[-1] if tail else body


def _framed(text: str, framing: str) -> bytes:
    if framing == "ndjson":
        return (text + "\n").encode()
    if framing == "jsonseq":
        return ("\x1e" + text + "\n").encode()
    return text.encode()


def encode_value(v: Any, options: Options = Options()) -> bytes:
    """The value's text; spellings of numbers are kept."""
    return _framed(_Writer(options).value(v), options.framing)


def encode_document(src: bytes, doc: Document, options: Options = Options(), verbatim: bool = True) -> bytes:
    """The text of a document that a strict reading located.

    Verbatim without an indent: its bytes as they are. Else token by token, comments included.
    """
    if not doc.validated:
        raise JsonError("Write", "write", doc.start, "only strictly read documents can be written")
    if doc.grammar != options.dialect:
        raise JsonError("Write", "dialect-mismatch", doc.start)
    if verbatim and options.indent is None:
        return _framed(src[doc.start : doc.end].decode(), options.framing)
    reader = Reader(src[: doc.end], doc.grammar)
    reader.at = doc.start
    return _framed(_Writer(options).node(src, reader.value()), options.framing)


class _Repeated(Exception):
    """An object has a name twice."""


def _names(pairs: list[tuple[str, Any]]) -> None:
    if len({k for k, _ in pairs}) != len(pairs):
        raise _Repeated


_GAPS = re.compile(rb'("[^"]*+")|[ \t\n\r]++')


def compacted(text: bytes, options: Options = Options()) -> bytes | None:
    """What encode_value() gives for the value of a checked text, without making the value; None where that is needed.

    Without escapes and repeated names the compact text is the text without its gaps.
    """
    if options.indent is not None or options.sort_keys or options.ascii or options.dialect != "rfc8259" or b"\\" in text:
        return None
    try:
        json.loads(text, object_pairs_hook=_names, parse_int=str, parse_float=str)
    except _Repeated:
        return None
    return _framed(_GAPS.sub(rb"\1", text).decode(), options.framing)


def plan_parts(v: Any, least: int = LEAST_ITEMS) -> list[range]:
    """Ranges of a top-level array's items that can be written apart; one empty plan for other values."""
    if not isinstance(v, list) or len(v) < 2 * least:
        return []
    return [range(i, min(i + least, len(v))) if len(v) - i >= 2 * least else range(i, len(v)) for i in range(0, len(v) - least + 1, least) if i == 0 or len(v) - i >= least]


def encode_part(v: list, part: range, options: Options = Options()) -> str:
    """The items of one part, with what stands between them."""
    w = _Writer(options)
    inner = w.line(1)
    return ("," + inner).join(w.value(v[i], 1) for i in part)


def stitch_parts(parts: list[str], options: Options = Options()) -> bytes:
    """The parts as one array: the same bytes as encode_value() gives."""
    return _framed(_Writer(options).container(parts, "[]", 0), options.framing)
