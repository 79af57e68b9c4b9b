"""Reads JSON text into located nodes, with separate checks of values.

Reading enforces structure alone: brackets, commas, colons, closed strings, literals, nesting. Whether a number or a
string is well formed inside is checked on demand, so that a query can leave unread values unchecked. Offsets are bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from lodestream.functions.values import Number
from lodestream.plans.model import MAX_NESTING, JsonError

BOM = b"\xef\xbb\xbf"
_WS = re.compile(rb"[ \t\n\r]*")
_STRING = {'"': re.compile(rb'"(?:[^"\\]|\\.)*+"', re.DOTALL), "'": re.compile(rb"'(?:[^'\\]|\\.)*+'", re.DOTALL)}
_NUMBER = re.compile(rb"-?[0-9][0-9+\-.eE]*")
_NUMBER5 = re.compile(rb"[+-]?(?:Infinity|NaN|0[xX][0-9a-fA-F]*|[0-9.][0-9+\-.eE]*)")
_RFC_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_FIVE_NUMBER = re.compile(rb"[+-]?(?:Infinity|NaN|0[xX][0-9a-fA-F]+|(?:(?:0|[1-9][0-9]*)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
_INTEGER = re.compile(rb"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?")
_NAME = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$]*")
_LITERALS = {b"t": (b"true", "bool"), b"f": (b"false", "bool"), b"n": (b"null", "null")}
_PLAIN = re.compile(rb"[^\x00-\x1f\\\x80-\xff]*")
# A whole member or element of RFC 8259 text whose value is a scalar, up to what follows the comma: most of a document.
_SCALAR = rb'("(?:[^"\\]|\\.)*+"|-?[0-9][0-9+\-.eE]*+|true|false|null)[ \t\n\r]*+'
_MEMBER = re.compile(rb'"([ !#-\[\]-~]*+)"[ \t\n\r]*+:[ \t\n\r]*+' + _SCALAR + rb"(?:,[ \t\n\r]*+|(}))", re.DOTALL)
_ELEMENT = re.compile(_SCALAR + rb"(?:,[ \t\n\r]*+|(\]))", re.DOTALL)
# A value of at most _SKIP_DEPTH levels of containers, by structure alone; what is deeper is entered level by level.
_TOKEN = rb'(?:"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9+\-.eE]*+|true|false|null)'
_GAP = rb"[ \t\n\r]*+"
_SKIP_DEPTH = 3


def _nested(levels: int, string: bytes = rb'"(?:[^"\\]++|\\.)*+"', token: bytes = _TOKEN) -> bytes:
    if not levels:
        return token
    v = _nested(levels - 1, string, token)
    pair = string + _GAP + rb":" + _GAP + v + _GAP
    many = lambda one: _GAP + rb"(?:" + one + rb"(?:," + _GAP + one + rb")*+)?+"
    return rb"(?:" + token + rb"|\{" + many(pair) + rb"\}|\[" + many(v + _GAP) + rb"\])"


_SKIP = re.compile(_nested(_SKIP_DEPTH), re.DOTALL)
# The same of values that need no check: well-formed strings and numbers.
_GOOD_STRING = rb'"(?:[ !#-\[\]-~]++|\\["\\/bfnrt]|\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf])*+"'
_GOOD_NUMBER = rb"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+(?![0-9+\-.eE])"
_GOOD_TOKEN = rb"(?:" + _GOOD_STRING + rb"|" + _GOOD_NUMBER + rb"|true|false|null)"
_GOOD = re.compile(_nested(_SKIP_DEPTH, _GOOD_STRING, _GOOD_TOKEN), re.DOTALL)
# A name without escapes, which is what it spells.
_RAW_NAME = rb'"(?:[ !#-\[\]-~]++|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf])*+"'
_ANY_STRING = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
# Names that a text can spell without escapes.
_RAW = re.compile(r'[^\x00-\x1f"\\\ud800-\udfff]*')
_KINDS = {0x7B: "object", 0x5B: "array", 0x22: "string", 0x2D: "number", 0x74: "bool", 0x66: "bool", 0x6E: "null", **dict.fromkeys(range(0x30, 0x3A), "number")}
_SIMPLE = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/"}
_FIVE = {"v": "\v", "0": "\0", "'": "'"}
_HIGH = re.compile(rb"[\x80-\xff]+")
_COMMENT_END = re.compile(rb"[\n\r]")


class Node:
    """A located value. items: an array's elements; members: an object's (name, name's start, node), authored order."""

    __slots__ = ("kind", "start", "end", "items", "members", "named", "comments")

    def __init__(self, kind: str, start: int, end: int = -1):
        self.kind, self.start, self.end = kind, start, end
        self.named: dict[str, Node] | None = None
        if kind == "array" or kind == "object":
            self.items: list[Node] = []
            self.members: list[tuple[str, int, Node]] = []
            #: Comments inside a container, as (start, end, how many values stand before).
            self.comments: list[tuple[int, int, int]] = []
        else:
            self.items = self.members = self.comments = ()

    def by_name(self) -> dict[str, Node]:
        """Last value of each name, in the order of first occurrence."""
        if self.named is None:
            self.named = {}
            for name, _, node in self.members:
                self.named[name] = node
        return self.named

    def children(self) -> list[Node]:
        return self.items if self.kind == "array" else [n for _, _, n in self.members]


class Plain(Node):
    """A value that was seen to need no check, a container's nodes among them: nobody asked for these."""

    __slots__ = ()

    def __init__(self, kind: str, start: int, end: int):
        self.kind, self.start, self.end, self.named = kind, start, end, None
        self.items = self.members = self.comments = ()


class Want:
    """What is asked of a value: all of it, or some members of an object and the elements of an array.

    keys: wanted members; names: whether all other members' names count, too. arrays: whether elements count; items: what
    is asked of those in the window; rest: what is asked of other names' values. A want of None asks for nothing but kind
    and span.
    """

    __slots__ = ("full", "keys", "names", "arrays", "items", "window", "rest", "_run", "_row")

    def __init__(self, full: bool = False, keys: dict[str, Want | None] | None = None, names: bool = False, arrays: bool = False, items: Want | None = None, window: range | None = None, rest: Want | None = None):
        self.full, self.keys, self.names, self.arrays, self.items, self.window, self.rest = full, keys or {}, names, arrays, items, window, rest
        self._run = self._row = None

    def row(self):
        """A pattern of a whole object that captures plain scalars of the wanted members, the last of each name, up to what
        follows the comma; None where more is asked than members."""
        if self._row is None:
            self._row = (None,)
            leaves = all(w is None or w.full for w in self.keys.values())
            if self.keys and leaves and not self.names and all(_RAW.fullmatch(k) for k in self.keys):
                no = b"|".join(re.escape(k.encode()) for k in self.keys)
                other = rb'(?!"(?:' + no + rb')")' + _RAW_NAME + _GAP + rb":" + _GAP + _nested(1)
                own = [rb'"' + re.escape(k.encode()) + rb'"' + _GAP + rb":" + _GAP + rb"(" + _nested(1, _GOOD_STRING, _GOOD_TOKEN) + rb")" for k in self.keys]
                member = rb"(?:" + b"|".join([*own, other]) + rb")" + _GAP + rb'(?:,' + _GAP + rb'(?=")|(?=\}))'
                self._row = (_run_pattern(rb"(\{" + _GAP + rb"(?:" + member + rb")*+\})" + _GAP + rb"(?:," + _GAP + rb"|(\]))").match,)
        return self._row[0]

    def run(self):
        """A pattern of members that aren't wanted, each with the comma after it; it may match nothing."""
        if self._run is None:
            # A name without escapes that isn't wanted; names with escapes are read one by one.
            no = b"|".join(re.escape(k.encode()) for k in self.keys if _RAW.fullmatch(k))
            name = (rb'(?!"(?:' + no + rb')")' if no else b"") + _RAW_NAME
            member = name + _GAP + rb":" + _GAP + _nested(_SKIP_DEPTH - 1) + _GAP + rb"," + _GAP + rb'(?=")'
            self._run = _run_pattern(rb"(?:" + member + rb")*+")
        return self._run

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Want) and all(getattr(self, k) == getattr(other, k) for k in self.__slots__[:-2])

    __hash__ = None


@lru_cache(maxsize=64)
def _run_pattern(pattern: bytes):
    return re.compile(pattern, re.DOTALL)


#: All of a value's nodes; and a value of which only the span is asked, but whose values are checked.
FULL, CHECKED = Want(full=True), Want(full=True)
_EACH = Want(names=True, arrays=True, items=CHECKED, rest=CHECKED)


def merged(a: Want | None, b: Want | None) -> Want | None:
    """What is asked by a or b."""
    if a is None or b is None or a is b:
        return a or b
    if a is CHECKED and b.rest is CHECKED or b is CHECKED and a.rest is CHECKED:
        # All that isn't wanted there is checked, too.
        return b if a is CHECKED else a
    if a.full or b.full:
        return FULL
    keys = {k: merged(a.keys.get(k), b.keys.get(k)) for k in {**a.keys, **b.keys}}
    if not (a.arrays and b.arrays):
        w = a if a.arrays else b
        return Want(False, keys, a.names or b.names, w.arrays, w.items, w.window, a.rest or b.rest)
    window = range(min(a.window.start, b.window.start), max(a.window.stop, b.window.stop)) if a.window is not None and b.window is not None else None
    return Want(False, keys, a.names or b.names, True, merged(a.items, b.items), window, a.rest or b.rest)


class Reader:
    def __init__(self, src: bytes, dialect: str = "rfc8259", max_nesting: int = MAX_NESTING, watch: Callable[[str, int, int], None] | None = None):
        self.src, self.dialect, self.max_nesting = src, dialect, max_nesting
        #: Told of each step through a container ("poll") and of each region that was only located ("skip").
        self.watch = watch
        self.lax = dialect != "rfc8259"
        self.five = dialect == "json5"
        self.at = 0
        #: Comments outside the root.
        self.outer: list[tuple[int, int]] = []

    def trivia(self, holder: Node | None = None) -> None:
        src = self.src
        self.at = _WS.match(src, self.at).end()
        while self.lax and src[self.at : self.at + 1] == b"/":
            start, two = self.at, src[self.at : self.at + 2]
            if two == b"//":
                m = _COMMENT_END.search(src, start)
                end = m.start() if m else len(src)
            elif two == b"/*":
                end = src.find(b"*/", start + 2) + 2
                if end < 2:
                    raise JsonError("Syntax", "unterminated-comment", start)
            else:
                raise JsonError("Syntax", "invalid-comment", start)
            try:
                src[start:end].decode()
            except UnicodeDecodeError as e:
                raise JsonError("Utf8", "invalid-utf8", start + e.start) from None
            if holder is None:
                self.outer.append((start, end))
            else:
                holder.comments.append((start, end, len(holder.children())))
            self.at = _WS.match(src, end).end()

    def take(self, want: Want | None, depth: int = 0) -> Node:
        """The value here as far as it is wanted; what isn't is located by structure alone."""
        c = self.src[self.at : self.at + 1]
        if want is CHECKED and not self.lax and c in (b"{", b"["):
            if depth + _SKIP_DEPTH <= self.max_nesting and (m := _GOOD.match(self.src, self.at)):
                node = Plain("object" if c == b"{" else "array", self.at, m.end())
                self.at = m.end()
                return node
            # Deeper, or something in it isn't good: level by level.
            want = _EACH
        if self.lax or (want is not None and want.full) or c not in (b"{", b"["):
            return self.value(depth)
        if depth >= self.max_nesting:
            raise JsonError("Limit", "nesting", self.at)
        inside = want is not None and (bool(want.keys) or want.names if c == b"{" else want.arrays)
        if not inside and depth + _SKIP_DEPTH <= self.max_nesting and (m := _SKIP.match(self.src, self.at)):
            node = Node("object" if c == b"{" else "array", self.at, m.end())
            self.at = m.end()
            if self.watch is not None:
                self.watch("skip", node.start, node.end)
            return node
        want = want if inside else Want()
        if c == b"{":
            return self._object(depth, want)
        node = Node("array", self.at)
        for _ in self.elements(node, depth, want):
            pass
        return node

    def value(self, depth: int = 0) -> Node:
        src, at = self.src, self.at
        c = src[at : at + 1]
        if c == b'"' or (c == b"'" and self.five):
            m = _STRING[c.decode()].match(src, at)
            if not m:
                raise JsonError("Syntax", "unterminated-string", at)
            self.at = m.end()
            return Node("string", at, self.at)
        if c in (b"{", b"["):
            if depth >= self.max_nesting:
                raise JsonError("Limit", "nesting", at)
            return self._object(depth) if c == b"{" else self._array(depth)
        if c in _LITERALS:
            word, kind = _LITERALS[c]
            if src[at : at + len(word)] != word or src[at + len(word) : at + len(word) + 1].isalnum():
                raise JsonError("Syntax", "invalid-literal", at)
            self.at = at + len(word)
            return Node(kind, at, self.at)
        m = (_NUMBER5 if self.five else _NUMBER).match(src, at)
        if m:
            self.at = m.end()
            return Node("number", at, self.at)
        raise JsonError("Syntax", "expected-value" if c != b"-" else "invalid-number", at)

    def _closes(self, node: Node, mark: bytes, seen: int) -> bool:
        """After a value: whether the container closes; else a comma was read and a value follows."""
        src = self.src
        self.trivia(node)
        c = src[self.at : self.at + 1]
        if c == mark:
            self.at += 1
            return True
        if c != b",":
            raise JsonError("Syntax", "expected-comma", self.at)
        comma = self.at
        self.at += 1
        self.trivia(node)
        if src[self.at : self.at + 1] == mark:
            if not self.lax:
                raise JsonError("Syntax", "trailing-comma", comma)
            self.at += 1
            return True
        return False

    def _array(self, depth: int) -> Node:
        node = Node("array", self.at)
        for _ in self.elements(node, depth):
            pass
        return node

    def elements(self, node: Node, depth: int, want: Want = FULL) -> Iterator[Node]:
        """Reads an array's elements one by one; node is complete when the iterator ends."""
        watch, window, items = self.watch, want.window, want.items
        self.at += 1
        self.trivia(node)
        src, quick = self.src, _ELEMENT.match if not self.lax else None
        if src[self.at : self.at + 1] == b"]":
            self.at += 1
        else:
            row = items.row() if not want.full and items is not None and quick else None
            if row is not None:
                places, last, kinds, add = list(enumerate(items.keys, 2)), len(items.keys) + 2, _KINDS, node.items.append
            while True:
                while row is not None and (window is None or len(node.items) in window) and (m := row(src, self.at)):
                    start, end = m.span(1)
                    if m[last] is None and src[m.end() : m.end() + 1] == b"]":
                        break
                    if watch is not None:
                        watch("poll", start, end)
                    item = Node("object", start, end)
                    item.named = named = {}
                    span = m.span
                    for i, name in places:
                        a, b = span(i)
                        if a >= 0:
                            named[name] = Plain(kinds[src[a]], a, b)
                    add(item)
                    self.at = m.end()
                    if m[last]:
                        node.end = self.at
                        yield item
                        return
                    yield item
                while quick and (m := quick(src, self.at)):
                    start, end = m.span(1)
                    if m[2] is None and src[m.end() : m.end() + 1] == b"]":
                        break
                    item = Node(_KINDS[src[start]], start, end)
                    node.items.append(item)
                    self.at = m.end()
                    if m[2]:
                        # The node is complete before its last element is handed out, so early ends see it.
                        node.end = self.at
                        yield item
                        return
                    yield item
                if watch is not None:
                    watch("poll", self.at, self.at)
                if want.full:
                    item = self.value(depth + 1)
                else:
                    item = self.take(items if window is None or len(node.items) in window else want.rest, depth + 1)
                node.items.append(item)
                yield item
                if self._closes(node, b"]", len(node.items)):
                    break
        node.end = self.at

    def _object(self, depth: int, want: Want = FULL) -> Node:
        node = Node("object", self.at)
        full, keys, names, watch = want.full, want.keys, want.names, self.watch
        run = want.run().match if not (full or names or self.lax) else None
        self.at += 1
        self.trivia(node)
        src, members, quick = self.src, node.members, _MEMBER.match if not self.lax else None
        if src[self.at : self.at + 1] == b"}":
            self.at += 1
        else:
            while True:
                if run is not None and (end := run(src, self.at).end()) > self.at:
                    if watch is not None:
                        watch("skip", self.at, end)
                    self.at = end
                while quick and (m := quick(src, self.at)):
                    at, (start, end) = self.at, m.span(2)
                    if m[3] is None and src[m.end() : m.end() + 1] == b"}":
                        break
                    name = m[1].decode()
                    if full or names or name in keys:
                        members.append((name, at, Node(_KINDS[src[start]], start, end)))
                    self.at = m.end()
                    if m[3]:
                        node.end = self.at
                        return node
                start = self.at
                name = self._name()
                self.trivia(node)
                if self.src[self.at : self.at + 1] != b":":
                    raise JsonError("Syntax", "expected-colon", self.at)
                self.at += 1
                self.trivia(node)
                if watch is not None:
                    watch("poll", self.at, self.at)
                child = self.value(depth + 1) if full else self.take(keys.get(name, want.rest), depth + 1)
                if full or names or name in keys:
                    node.members.append((name, start, child))
                if self._closes(node, b"}", len(node.members)):
                    break
        node.end = self.at
        return node

    def _name(self) -> str:
        src, at = self.src, self.at
        c = src[at : at + 1]
        if c == b'"' or (c == b"'" and self.five):
            m = _STRING[c.decode()].match(src, at)
            if not m:
                raise JsonError("Syntax", "unterminated-string", at)
            self.at = m.end()
            raw = src[at : self.at]
            return decoded(src, at, self.at, self.dialect) if b"\\" in raw else utf8(src, at + 1, self.at - 1)
        m = _NAME.match(src, at) if self.five else None
        if not m:
            raise JsonError("Syntax", "expected-key", at)
        self.at = m.end()
        return m.group().decode()

    def document(self, want: Want | None = FULL) -> Node:
        """One value with only trivia around it, as far as it is wanted; a leading byte order mark is skipped."""
        if self.src[:3] == BOM:
            self.at = 3
        self.trivia()
        root = self.take(want)
        self.finish()
        return root

    def finish(self) -> None:
        self.trivia()
        if self.at != len(self.src):
            raise JsonError("Syntax", "trailing-content", self.at)


def utf8(src: bytes, start: int, end: int) -> str:
    try:
        return src[start:end].decode()
    except UnicodeDecodeError as e:
        raise JsonError("Utf8", "invalid-utf8", start + e.start) from None


def _hex(src: bytes, at: int, n: int, offset: int) -> int:
    text = src[at : at + n]
    if len(text) != n or not re.fullmatch(rb"[0-9a-fA-F]+", text):
        raise JsonError("Escape", "invalid-unicode-escape", offset)
    return int(text, 16)


def decoded(src: bytes, start: int, end: int, dialect: str = "rfc8259") -> str:
    """The text of the string literal at start..end; raises where it isn't well formed."""
    m = _PLAIN.fullmatch(src, start + 1, end - 1)
    if m:
        return m.group().decode()
    out, at, stop, five = [], start + 1, end - 1, dialect == "json5"
    while at < stop:
        m = _PLAIN.match(src, at, stop)
        if m.end() > at:
            out.append(m.group().decode())
            at = m.end()
            continue
        c = src[at]
        if c == 0x5C:
            e = chr(src[at + 1])
            if e in _SIMPLE or (five and e in _FIVE):
                if e == "0" and at + 2 < stop and 0x30 <= src[at + 2] <= 0x39:
                    raise JsonError("Escape", "invalid-escape", at)
                out.append(_SIMPLE.get(e) or _FIVE[e])
                at += 2
            elif e == "u":
                code = _hex(src, at + 2, 4, at)
                at += 6
                if 0xD800 <= code < 0xDC00:
                    if src[at : at + 2] != b"\\u" or at + 6 > stop:
                        raise JsonError("Escape", "missing-low-surrogate", at - 6)
                    low = _hex(src, at + 2, 4, at)
                    if not 0xDC00 <= low < 0xE000:
                        raise JsonError("Escape", "invalid-surrogate-pair", at - 6)
                    code = 0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00)
                    at += 6
                elif 0xDC00 <= code < 0xE000:
                    raise JsonError("Escape", "invalid-surrogate-pair", at - 6)
                out.append(chr(code))
            elif five and e == "x":
                out.append(chr(_hex(src, at + 2, 2, at)))
                at += 4
            elif five and e in "\n\r":
                at += 3 if src[at + 1 : at + 3] == b"\r\n" else 2
            elif five and src[at + 1 : at + 4] in (b"\xe2\x80\xa8", b"\xe2\x80\xa9"):
                at += 4
            else:
                raise JsonError("Escape", "invalid-escape", at)
        elif c < 0x20:
            raise JsonError("Syntax", "control-in-string", at)
        else:
            m = _HIGH.match(src, at, stop)
            out.append(utf8(src, at, m.end()))
            at = m.end()
    return "".join(out)


def number_at(src: bytes, start: int, end: int, dialect: str = "rfc8259") -> Number:
    """The number at start..end; JSON5 spellings lose a leading plus, and hexadecimal becomes decimal."""
    text = src[start:end]
    if not (_FIVE_NUMBER if dialect == "json5" else _RFC_NUMBER).fullmatch(text):
        raise JsonError("Number", "invalid-number", start)
    spelling = text.decode().removeprefix("+")
    bare = spelling.lstrip("-")
    if bare in ("Infinity", "NaN"):
        return Number(spelling, special=True)
    if bare[:2] in ("0x", "0X"):
        return Number(("-" if spelling[0] == "-" else "") + str(int(bare, 16)))
    return Number(spelling)


def check(src: bytes, node: Node, dialect: str) -> None:
    """Checks all values below and at node, in document order."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.kind == "string":
            if not _PLAIN.fullmatch(src, n.start + 1, n.end - 1):
                decoded(src, n.start, n.end, dialect)
        elif n.kind == "number":
            if not _INTEGER.fullmatch(src, n.start, n.end):
                try:
                    number_at(src, n.start, n.end, dialect)
                except JsonError as e:
                    raise JsonError(e.cls, e.code, n.start) from None
        elif n.kind == "array":
            todo.extend(reversed(n.items))
        elif n.kind == "object":
            for _, key, _ in n.members:
                if src[key : key + 1] in (b'"', b"'"):
                    decoded(src, key, _STRING[chr(src[key])].match(src, key).end(), dialect)
            todo.extend(x for _, _, x in reversed(n.members))


def value_of(src: bytes, node: Node, dialect: str = "rfc8259"):
    """The value of a node; checks as it goes."""
    if node.kind == "null":
        return None
    if node.kind == "bool":
        return src[node.start : node.start + 1] == b"t"
    if node.kind == "number":
        return number_at(src, node.start, node.end, dialect)
    if node.kind == "string":
        return decoded(src, node.start, node.end, dialect)
    if node.kind == "array":
        return [value_of(src, n, dialect) for n in node.items]
    return {name: value_of(src, n, dialect) for name, n in [(m[0], m[2]) for m in node.members]}


def _no_constant(text: str):
    raise AssertionError(text)


def checked_value(src: bytes, at: int, dialect: str = "rfc8259", max_nesting: int = MAX_NESTING):
    """The value that begins at `at`, and where it ends: checked first, then parsed by the standard library's scanner."""
    reader = Reader(src, dialect, max_nesting)
    reader.at = at
    if dialect != "rfc8259":
        return value_of(src, reader.value(), dialect), reader.at
    node = reader.take(CHECKED)
    if type(node) is not Plain:
        check(src, node, dialect)
    return json.loads(src[at : reader.at], parse_int=Number, parse_float=Number, parse_constant=_no_constant), reader.at


def parse(src: bytes | str, dialect: str = "rfc8259", max_nesting: int = MAX_NESTING):
    """The value of one JSON text."""
    src = src.encode() if isinstance(src, str) else src
    reader = Reader(src, dialect, max_nesting)
    reader.at = 3 if src[:3] == BOM else 0
    reader.trivia()
    value, reader.at = checked_value(src, reader.at, dialect, max_nesting)
    reader.finish()
    return value
