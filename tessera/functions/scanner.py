"""The byte scanner: one document's bytes to flat rows for each JSON value, or the first failure and its place.

Spark's JSON readers lose what is asked for here (offsets, number spelling, member order, duplicate names), so this is
one of two places where Python runs. Tokens come from one regular expression; where it doesn't match, the exact kind
and place of the failure are worked out apart. Besides the tree, a row says where its value stands in the graph:

* ``owner``: the nearest object that may be a node (the root, or one under ``@graph`` or ``@included``), by value id
* ``level``: levels below the owner; ``slot``: the owner's member the value is or lies in
* ``objects``: objects crossed from the slot down to the value
* ``post``: for such an object, its place when inner ones go first; ``binding``: a member of the root's context
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from tessera.options import ReadOptions

UTF8, SYNTAX, DUPLICATE, NESTING, MEMBERS, VALUES, NAME_BYTES = (
    "InvalidUtf8", "Syntax", "DuplicateMember", "NestingLimit", "ObjectMemberLimit", "ValueLimit", "DecodedMemberNameBytesLimit",
)

#: Columns of a value row, in order, with their Spark types.
COLUMNS = [
    ("value_id", "int"), ("parent_id", "int"), ("parent_kind", "string"), ("ordinal", "int"), ("depth", "int"), ("kind", "string"),
    ("name", "string"), ("name_start", "long"), ("name_end", "long"), ("text", "string"), ("flag", "boolean"),
    ("tok_start", "long"), ("tok_end", "long"), ("owner", "int"), ("level", "int"), ("slot", "int"), ("objects", "int"), ("post", "int"), ("binding", "boolean"),
]

_SPACE = re.compile(rb"[ \t\r\n]*")
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"')
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+")
_EXPONENT = re.compile(rb"[eE][+-]?")
_WORDS = {0x74: (b"true", "boolean", True), 0x66: (b"false", "boolean", False), 0x6E: (b"null", "null", None)}
_STARTS = frozenset(b'"{[tfn-0123456789')
_AFTER_NUMBER = frozenset(b".eE0123456789")


class Failure(Exception):
    def __init__(self, kind: str, offset: int, why: str | None = None):
        super().__init__(kind)
        self.kind, self.offset, self.why = kind, offset, why


@dataclass
class Scan:
    """Rows and structure metrics of a document, or its failure."""

    rows: list[list] = field(default_factory=list)
    max_nesting_depth: int = 0
    max_object_members: int = 0
    total_values: int = 0
    decoded_member_name_bytes: int = 0
    failure: str | None = None
    why: str | None = None
    position: tuple[int, int, int] | None = None


def position(content: bytes, offset: int) -> tuple[int, int, int]:
    """Offset, line and column, all from zero and in bytes."""
    offset = min(offset, len(content))
    line_start = content.rfind(b"\n", 0, offset) + 1
    return offset, content.count(b"\n", 0, line_start), offset - line_start


def _bad_string(content: bytes, at: int) -> Failure:
    """Why and where the string that begins at ``at`` isn't one."""
    i, n = at + 1, len(content)

    def unit(u: int) -> tuple[int, int]:
        """Code unit of an escape whose ``u`` is at ``u``, and where it ends."""
        for j in range(u + 1, u + 5):
            if j >= n:
                raise Failure(SYNTAX, n, "invalid Unicode escape")
            if content[j] not in b"0123456789abcdefABCDEF":
                raise Failure(SYNTAX, j, "invalid Unicode escape")
        return int(content[u + 1 : u + 5], 16), u + 5

    try:
        while i < n:
            c = content[i]
            if c < 0x20:
                return Failure(SYNTAX, i, "control character in string")
            if c == 0x22:
                break
            if c != 0x5C:
                i += 1
                continue
            escape = i
            if i + 1 >= n or content[i + 1] not in b'"\\/bfnrtu':
                return Failure(SYNTAX, i + 1, "invalid string escape")
            if content[i + 1] != 0x75:
                i += 2
                continue
            code, i = unit(i + 1)
            if 0xDC00 <= code <= 0xDFFF:
                return Failure(SYNTAX, escape, "lone leading surrogate in hex escape")
            if 0xD800 <= code <= 0xDBFF:
                if content[i : i + 2] != b"\\u":
                    return Failure(SYNTAX, escape, "unexpected end of hex escape")
                pair = i
                code, i = unit(i + 1)
                if not 0xDC00 <= code <= 0xDFFF:
                    return Failure(SYNTAX, pair, "lone leading surrogate in hex escape")
    except Failure as found:
        return found
    return Failure(SYNTAX, n, "unterminated string")


def _bad_number(content: bytes, at: int) -> Failure:
    """Where the number that begins at ``at`` goes wrong: after its longest good part and what promises more."""
    m = _NUMBER.match(content, at)
    if not m:
        return Failure(SYNTAX, at + 1, "expected a digit")
    end, c = m.end(), content[m.end() : m.end() + 1]
    has_exponent = b"e" in m[0].lower()
    if c == b"." and b"." not in m[0] and not has_exponent:
        return Failure(SYNTAX, end + 1, "expected a digit after decimal point")
    if c in b"eE" and not has_exponent:
        return Failure(SYNTAX, _EXPONENT.match(content, end).end(), "expected an exponent digit")
    return Failure(SYNTAX, end, "leading zero in number" if c.isdigit() else None)  # None: a whole number, then something else


def _string(content: bytes, at: int) -> tuple[str, int]:
    m = _STRING.match(content, at)
    if not m:
        raise _bad_string(content, at)
    raw = m[0]
    if b"\\" not in raw:
        return raw[1:-1].decode(), m.end()
    text = json.loads(raw)
    if any("\ud800" <= c <= "\udfff" for c in text):
        raise _bad_string(content, at)
    return text, m.end()


def _quoted(name: str) -> str:
    """A name in quotes, with what can't be printed escaped."""
    known = {'"': '\\"', "\\": "\\\\", "\t": "\\t", "\r": "\\r", "\n": "\\n", "\0": "\\0"}
    return '"' + "".join(known.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in name) + '"'


def _after(top: _Frame | None) -> str:
    """What is said of something that can't follow a value."""
    return "trailing characters" if top is None else "expected ',' or ']'" if top.names is None else "expected ',' or '}'"


class _Frame:
    __slots__ = ("binds", "count", "id", "level", "names", "node", "objects", "owner", "row", "slot", "spot")

    def __init__(self, row: list, is_object: bool):
        self.row, self.id, self.count = row, row[0], 0
        self.names: set[str] | None = set() if is_object else None


def _walk(content: bytes, limits: ReadOptions, out: Scan) -> None:
    n, at, rows = len(content), 0, out.rows
    stack: list[_Frame] = []
    posts, first = 0, True
    name, name_start, name_end, ordinal = None, None, None, 0
    closed = False  # a value has just ended
    while True:
        at = _SPACE.match(content, at).end()
        if closed or not first and not stack:
            if not stack:
                if at != n:
                    raise Failure(SYNTAX, at, _after(None))
                return
            top = stack[-1]
            c = content[at] if at < n else -1
            if c == 0x2C:
                at, closed = _SPACE.match(content, at + 1).end(), False
            elif c == (0x5D if top.names is None else 0x7D):
                at += 1
                top.row[12] = at
                if top.node:
                    top.row[17] = posts
                    posts += 1
                stack.pop()
                continue
            else:
                raise Failure(SYNTAX, at, _after(top))
        top = stack[-1] if stack else None
        if top is not None and top.names is not None:
            key = at
            if at >= n or content[at] != 0x22:
                raise Failure(SYNTAX, at, "expected an object member name")
            if top.count + 1 > limits.max_json_object_members:
                raise Failure(MEMBERS, key)
            name, at = _string(content, at)
            name_start, name_end = key, at
            size = out.decoded_member_name_bytes + len(name.encode())
            if size > limits.max_decoded_member_name_bytes:
                raise Failure(NAME_BYTES, key)
            if name in top.names:
                raise Failure(DUPLICATE, key, f"duplicate object member {_quoted(name)}")
            top.names.add(name)
            out.decoded_member_name_bytes = size
            at = _SPACE.match(content, at).end()
            if at >= n or content[at] != 0x3A:
                raise Failure(SYNTAX, at, "expected ':'")
            at = _SPACE.match(content, at + 1).end()
        else:
            name = name_start = name_end = None
        if top is not None:
            top.count += 1
            ordinal = top.count - 1
            if top.names is not None and top.count > out.max_object_members:
                out.max_object_members = top.count
        # a value begins here
        if at >= n or content[at] not in _STARTS:
            raise Failure(SYNTAX, at, "expected a JSON value")
        if out.total_values + 1 > limits.max_json_values:
            raise Failure(VALUES, at)
        out.total_values += 1
        c, start, first = content[at], at, False
        is_object, is_container = c == 0x7B, c in b"{["
        text = flag = None
        if is_container:
            if len(stack) + 1 > limits.max_json_nesting_depth:
                raise Failure(NESTING, at)
            kind, at = "object" if is_object else "array", at + 1
            out.max_nesting_depth = max(out.max_nesting_depth, len(stack) + 1)
        elif c == 0x22:
            kind = "string"
            text, at = _string(content, at)
        elif c in _WORDS:
            word, kind, flag = _WORDS[c]
            if not content.startswith(word, at):
                raise Failure(SYNTAX, at, "invalid JSON literal")
            at += len(word)
        else:
            m = _NUMBER.match(content, at)
            if not m or m.end() < n and content[m.end()] in _AFTER_NUMBER:
                wrong = _bad_number(content, at)
                wrong.why = wrong.why or _after(top)
                raise wrong
            kind, at = "number", m.end()
            text = m[0].decode()
        # its place in the tree and in the graph
        vid = len(rows)
        owner = level = slot = None
        objects, node, spot, binds, binding = 0, False, 0, False, False
        if top is None:
            node = is_object
            if is_object:
                owner, level = 0, 0
        elif top.owner is not None:
            binding = top.binds and top.names is not None
            if top.node:
                slot, level = vid, 1
                spot = 1 if name in ("@graph", "@included") else 2 if name == "@context" and top.id == 0 else 0
            else:
                slot, level, objects = top.slot, top.level + 1, top.objects + (top.names is not None)
                spot = top.spot if top.names is None else 0
            owner = top.owner
            if spot == 1 and is_object:
                node, owner, level, slot, objects = True, vid, 0, None, 0
            binds = spot == 2
        row = [vid, top.id if top else None, None if top is None else "array" if top.names is None else "object", ordinal if top else 0, len(stack), kind, name, name_start, name_end, text, flag, start, at, owner, level, slot, objects, None, binding]
        rows.append(row)
        closed = not is_container
        if is_container:
            frame = _Frame(row, is_object)
            frame.owner, frame.level, frame.slot, frame.objects, frame.node, frame.spot, frame.binds = owner, level, slot, objects, node, spot, binds
            stack.append(frame)
            at = _SPACE.match(content, at).end()
            if at < n and content[at] == (0x7D if is_object else 0x5D):
                at += 1
                row[12] = at
                if node:
                    row[17] = posts
                    posts += 1
                stack.pop()
                closed = True


def scan(content: bytes, limits: ReadOptions) -> Scan:
    """Rows and metrics of a document. Never recurses, so depth is bounded by the limit alone."""
    out = Scan()
    try:
        content.decode()
    except UnicodeDecodeError as wrong:
        out.failure, out.position, out.why = UTF8, position(content, wrong.start), f"invalid UTF-8 at byte offset {wrong.start}"
        return out
    try:
        _walk(content, limits, out)
    except Failure as found:
        out.failure, out.position, out.why = found.kind, position(content, found.offset), found.why
        out.rows = []
    return out
