"""Frames of records in a byte stream: newline-delimited, back to back, or led by record separators."""

from __future__ import annotations

import re

from lodestream.functions.lexer import BOM, Reader
from lodestream.plans.model import MAX_NESTING, JsonError

_LINE_END = re.compile(rb"\r\n|\n|\r")
RS = b"\x1e"


def _blank(part: bytes, dialect: str) -> bool:
    if not part.strip(b" \t\r\n"):
        return True
    if dialect == "rfc8259":
        return False
    reader = Reader(part, dialect)
    try:
        reader.trivia()
    except JsonError:
        return False
    return reader.at == len(part)


def ndjson_frames(src: bytes, dialect: str = "rfc8259") -> list[tuple[int, int]]:
    """(start, end) of the lines that hold something; lines end with LF, CRLF or CR."""
    out, at = [], 0
    for m in _LINE_END.finditer(src):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(src)))
    return [(s, e) for s, e in out if not _blank(src[s:e], dialect)]


def jsonseq_frames(src: bytes, dialect: str = "rfc8259") -> list[tuple[int, int]]:
    """(start, end) of the payloads between record separators; the first separator may be left out."""
    out, at = [], 0
    while at <= len(src):
        end = src.find(RS, at)
        end = len(src) if end < 0 else end
        if not _blank(src[at:end], dialect):
            out.append((at, end))
        at = end + 1
    return out


def adjacent_frames(src: bytes, dialect: str = "rfc8259", max_nesting: int = MAX_NESTING) -> list[tuple[int, int]]:
    """(start, end) of values one after another; what can't be read becomes the last frame."""
    reader = Reader(src, dialect, max_nesting)
    reader.at = 3 if src[:3] == BOM else 0
    out = []
    while True:
        start = reader.at
        try:
            reader.trivia()
            if reader.at == len(src):
                return out
            start = reader.at
            reader.take(None)
        except JsonError:
            return [*out, (start, len(src))]
        out.append((start, reader.at))


def frames(src: bytes, framing: str, dialect: str = "rfc8259", max_nesting: int = MAX_NESTING) -> list[tuple[int, int]]:
    if framing == "ndjson":
        return ndjson_frames(src, dialect)
    if framing == "jsonseq":
        return jsonseq_frames(src, dialect)
    return adjacent_frames(src, dialect, max_nesting)


def partition(src: bytes, framing: str, target: int) -> list[tuple[int, int]]:
    """Ranges of whole records that hold about target bytes each."""
    out: list[list[int]] = []
    for s, e in frames(src, framing):
        if out and out[-1][1] - out[-1][0] < target:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def complete_prefix(buffer: bytes, framing: str) -> int:
    """Bytes of a growing buffer that hold complete records: what follows is held back for more input."""
    if framing == "ndjson":
        # A final CR may be half of a CRLF.
        ends = [m.end() for m in _LINE_END.finditer(buffer) if m.group() != b"\r" or m.end() < len(buffer)]
        return ends[-1] if ends else 0
    if framing == "jsonseq":
        return max(buffer.rfind(RS), 0)
    return adjacent_prefix(buffer) if framing == "adjacent" else 0


def adjacent_prefix(buffer: bytes, dialect: str = "rfc8259", max_nesting: int = MAX_NESTING) -> int:
    """Bytes up to the start of the first value that may go on: one that touches the end, or is cut."""
    reader = Reader(buffer, dialect, max_nesting)
    while True:
        try:
            reader.trivia()
            start = reader.at
            if start == len(buffer):
                return start
            reader.take(None)
        except JsonError:
            return start
        if reader.at == len(buffer):
            return start
