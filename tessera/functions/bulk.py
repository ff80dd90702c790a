"""Scanning many documents at once, as array operations over their bytes laid end to end.

Only what is plainly good is decided here: strings without escapes, tokens in a legal order, names that differ, nothing
over a limit. A document with anything else is named for the exact scanner, which says what is wrong and where. What
both accept, both describe alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.options import ReadOptions

_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY, _COMMA, _COLON, _STRING, _SCALAR = range(8)
_TYPE = np.full(256, _SCALAR, np.int8)
for _i, _c in enumerate(b"{}[],:"):
    _TYPE[_c] = _i
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_KINDS = ["null", "boolean", "boolean", "number", "string", "array", "object"]
_NULL, _TRUE, _FALSE, _NUMBER, _TEXT, _ARRAY, _OBJECT = range(7)
_NUMBER_FORM = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {b"null": _NULL, b"true": _TRUE, b"false": _FALSE}

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, at least ``n``."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    return _powers[0], _powers[1]


def _name_hash(name: bytes) -> int:
    return sum((c + 1) * pow(_BASE, i, 1 << 64) for i, c in enumerate(name)) % (1 << 64)


_STRUCTURE = [_name_hash(n) for n in (b"@graph", b"@included")]
_CONTEXT = _name_hash(b"@context")


@dataclass
class Bulk:
    """Documents scanned well (by place in the input), their metrics, how many values each has, and all values in order."""

    good: np.ndarray
    metrics: list[np.ndarray]
    counts: np.ndarray
    columns: list[pa.Array]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, valid: np.ndarray) -> pa.Array:
    """An Arrow string for each span, null where not valid."""
    size = np.where(valid, end - start, 0)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.repeat(np.where(valid, start, 0) - offsets[:-1], size) + np.arange(offsets[-1])
    bitmap = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(size), [bitmap, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[index]))])


def _ints(values: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=~valid)


def _plain(content: bytes) -> bool:
    if not content or b"\\" in content:
        return False
    try:
        content.decode()
    except UnicodeDecodeError:
        return False
    return True


def scan_many(contents: list[bytes], limits: ReadOptions, with_values: bool = True) -> Bulk:
    """All documents that are plainly good, without their values if only metrics are asked for. Others are for the exact scanner."""
    chosen = np.array([i for i, c in enumerate(contents) if _plain(c)], np.int64)
    while True:
        found, bad = _scan([contents[i] for i in chosen], limits, with_values)
        if not bad.any():
            found.good = chosen
            return found
        chosen = chosen[~bad]


def _scan(docs: list[bytes], limits: ReadOptions, with_values: bool) -> tuple[Bulk, np.ndarray]:
    """The scan of some documents, or (with it empty) which of them aren't plainly good."""
    nothing = Bulk(np.zeros(0, np.int64), [], np.zeros(0, np.int64), [])
    n_docs, bad = len(docs), np.zeros(len(docs), bool)
    data = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    if not n_docs:
        data = np.zeros(0, np.uint8)

    def refuse(places: np.ndarray) -> None:
        bad[np.searchsorted(starts, places, "right") - 1] = True

    quote = data == 0x22
    inside = (np.cumsum(quote) & 1).astype(bool)  # from an opening quote up to its closing one
    if n_docs:
        bad |= np.add.reduceat(quote, starts, dtype=np.int64) % 2 == 1
    if bad.any():
        return nothing, bad
    refuse(np.flatnonzero(inside & (data < 0x20)))
    opening, closing = np.flatnonzero(quote & inside), np.flatnonzero(quote & ~inside)
    kind_at = _TYPE[data]
    outside = ~inside & ~quote & ~_SPACE[data]
    scalar = outside & (kind_at == _SCALAR)
    edge = np.diff(np.r_[False, scalar, False].astype(np.int8))
    scalar_start, scalar_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    mark = outside & (kind_at != _SCALAR)
    mark[opening] = True
    mark[scalar_start] = True
    at = np.flatnonzero(mark)
    kind = kind_at[at].copy()
    kind[quote[at]] = _STRING
    end = at + 1
    end[kind == _STRING] = closing + 1
    end[kind == _SCALAR] = scalar_end
    doc = np.searchsorted(starts, at, "right") - 1
    n = len(at)

    is_open, is_close = (kind == _OPEN_OBJECT) | (kind == _OPEN_ARRAY), (kind == _CLOSE_OBJECT) | (kind == _CLOSE_ARRAY)
    step = is_open.astype(np.int64) - is_close
    after = np.cumsum(step)
    first = np.searchsorted(at, starts)  # a document's first token
    empty = np.r_[first[1:], n] == first if n_docs else np.zeros(0, bool)
    bad |= empty
    if bad.any():
        return nothing, bad
    if n_docs:
        rest = after - (after - step)[first][doc]  # an unbalanced document isn't held against later ones
        bad |= (np.add.reduceat(step, first) != 0) | (np.minimum.reduceat(rest, first) < 0)
    if bad.any():
        return nothing, bad
    level = after - step  # containers around a token; a closing one's own counts
    parent = np.full(n, -1, np.int64)
    deepest = int(after.max(initial=0))
    for d in range(1, deepest + 1):
        opens, here = np.flatnonzero(is_open & (after == d)), np.flatnonzero(level == d)
        parent[here] = opens[np.searchsorted(opens, here) - 1]

    previous = np.r_[-1, kind[:-1]] if n else kind
    previous[first] = -1
    around = np.where(parent >= 0, kind[parent], -1)
    is_value_start = is_open | (kind == _STRING) | (kind == _SCALAR)
    in_object, in_array, on_top = around == _OPEN_OBJECT, around == _OPEN_ARRAY, around == -1
    begins = (previous == _OPEN_OBJECT) | (previous == _COMMA)
    is_key = (kind == _STRING) & in_object & begins
    before = np.r_[False, is_key[:-1]] if n else is_key
    before[first] = False  # whether the token before is a name
    ends = ((previous == _STRING) & ~before) | (previous == _SCALAR) | (previous == _CLOSE_OBJECT) | (previous == _CLOSE_ARRAY)
    legal = np.select(
        [on_top, in_array & is_value_start, in_array & (kind == _COMMA), in_array & (kind == _CLOSE_ARRAY), in_object & (kind == _STRING), in_object & is_value_start, in_object & (kind == _COLON), in_object & (kind == _COMMA), in_object & (kind == _CLOSE_OBJECT)],
        [is_value_start & (previous == -1), (previous == _OPEN_ARRAY) | (previous == _COMMA), ends, (previous == _OPEN_ARRAY) | ends, is_key | (previous == _COLON), previous == _COLON, (previous == _STRING) & before, ends, (previous == _OPEN_OBJECT) | ends],
        False,
    )
    bad[doc[~legal]] = True

    code = np.full(n, _TEXT, np.int8)
    code[kind == _OPEN_OBJECT], code[kind == _OPEN_ARRAY] = _OBJECT, _ARRAY
    scalars = np.flatnonzero(kind == _SCALAR)
    known, raw = dict(_WORDS), data.tobytes()
    forms = np.zeros(len(scalars), np.int8)
    for i, (s, e) in enumerate(zip(at[scalars].tolist(), end[scalars].tolist())):
        word = raw[s:e]
        form = known.get(word)
        if form is None:
            form = known[word] = _NUMBER if _NUMBER_FORM.fullmatch(word) else -1
        forms[i] = form
    code[scalars] = forms
    bad[doc[scalars[forms < 0]]] = True
    if bad.any():
        return nothing, bad

    # names: hashed to find repeats; whatever looks repeated is looked at exactly
    keys = np.flatnonzero(is_key)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashed = (sums[end[keys] - 1] - sums[at[keys] + 1]) * down[at[keys] + 1]
    order = np.lexsort((hashed, parent[keys]))
    twice = (hashed[order][1:] == hashed[order][:-1]) & (parent[keys][order][1:] == parent[keys][order][:-1])
    bad[doc[keys[order[1:][twice]]]] = True

    values = np.flatnonzero(is_value_start & ~is_key)
    v_doc = doc[values]
    counts = np.bincount(v_doc, minlength=n_docs)
    name_bytes = np.bincount(doc[keys], (end - at - 2)[keys], n_docs).astype(np.int64)
    members = np.bincount(parent[keys], minlength=n) if n else np.zeros(0, np.int64)
    most = np.maximum.reduceat(members, first) if n_docs else members
    depth = np.maximum.reduceat(after, first) if n_docs else after
    bad |= (counts > limits.max_json_values) | (name_bytes > limits.max_decoded_member_name_bytes) | (most > limits.max_json_object_members) | (depth > limits.max_json_nesting_depth)
    if bad.any():
        return nothing, bad

    if not with_values:
        return Bulk(np.zeros(0, np.int64), [depth, most, counts, name_bytes], counts, []), bad

    # rows: a value's number in its document, its parent's, its place among siblings
    number = np.full(n, -1, np.int64)
    first_value = np.cumsum(counts) - counts
    number[values] = np.arange(len(values)) - first_value[v_doc]
    place = np.full(n, -1, np.int64)
    place[values] = np.arange(len(values))
    above = np.where(parent[values] >= 0, place[parent[values]], -1)  # the parent among all values
    has_parent, from_object = above >= 0, in_object[values]
    by_parent = np.argsort(above, kind="stable")
    sorted_above = above[by_parent]
    begin = np.flatnonzero(np.r_[True, sorted_above[1:] != sorted_above[:-1]]) if len(above) else np.zeros(0, np.int64)
    ordinal = np.empty(len(values), np.int64)
    ordinal[by_parent] = np.arange(len(values)) - np.repeat(begin, np.diff(np.r_[begin, len(values)]))
    ordinal[~has_parent] = 0
    closes = np.flatnonzero(is_close)
    end[parent[closes]] = at[closes] + 1
    v_level, v_code, v_id = level[values], code[values], number[values]
    key = np.where(from_object, values - 2, 0)
    key_hash = np.zeros(n, np.uint64)
    key_hash[keys] = hashed

    # place in the graph, level by level from the roots
    size = len(values)
    owner, below, slot = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    objects, spot = np.zeros(size, np.int64), np.zeros(size, np.int8)
    node, binding = np.zeros(size, bool), np.zeros(size, bool)
    roots = (v_level == 0) & (v_code == _OBJECT)
    owner[roots], below[roots], node[roots] = 0, 0, True
    own_hash = key_hash[key]
    structural = from_object & np.isin(own_hash, np.array(_STRUCTURE, np.uint64))
    contextual = from_object & (own_hash == np.uint64(_CONTEXT))
    for d in range(1, deepest + 1):
        here = np.flatnonzero(v_level == d)
        up_ = above[here]
        here, up_ = here[owner[up_] >= 0], up_[owner[up_] >= 0]
        of_object, of_node = from_object[here], node[up_]
        binding[here] = (spot[up_] == 2) & of_object
        slot[here] = np.where(of_node, v_id[here], slot[up_])
        below[here] = np.where(of_node, 1, below[up_] + 1)
        objects[here] = np.where(of_node, 0, objects[up_] + of_object)
        spot[here] = np.where(of_node, np.where(structural[here], 1, np.where(contextual[here] & (v_id[up_] == 0), 2, 0)), np.where(of_object, 0, spot[up_]))
        owner[here] = owner[up_]
        fresh = here[(spot[here] == 1) & (v_code[here] == _OBJECT)]
        node[fresh], owner[fresh], below[fresh], slot[fresh], objects[fresh] = True, v_id[fresh], 0, -1, 0
    nodes = np.flatnonzero(node)
    nodes = nodes[np.argsort(end[values[nodes]], kind="stable")]
    nodes = nodes[np.argsort(v_doc[nodes], kind="stable")]
    per_doc = np.bincount(v_doc[nodes], minlength=n_docs)
    post = np.full(size, -1, np.int64)
    post[nodes] = np.arange(len(nodes)) - (np.cumsum(per_doc) - per_doc)[v_doc[nodes]]

    base = starts[v_doc]
    is_text, is_flag = (v_code == _TEXT) | (v_code == _NUMBER), (v_code == _TRUE) | (v_code == _FALSE)
    trim = (v_code == _TEXT).astype(np.int64)
    named, name_from, name_to = from_object, at[key], end[key]
    kinds = pa.array(_KINDS)
    columns = [
        pa.array(v_id, pa.int32()), _ints(np.where(has_parent, v_id[above], 0), has_parent, pa.int32()),
        pa.array(["array", "object"]).take(pa.array(from_object.astype(np.int8), mask=~has_parent)), pa.array(ordinal, pa.int32()), pa.array(v_level, pa.int32()), kinds.take(pa.array(v_code)),
        _strings(data, name_from + 1, name_to - 1, named), _ints(name_from - base, named, pa.int64()), _ints(name_to - base, named, pa.int64()),
        _strings(data, at[values] + trim, end[values] - trim, is_text), pa.array(v_code == _TRUE, pa.bool_(), mask=~is_flag), pa.array(at[values] - base, pa.int64()), pa.array(end[values] - base, pa.int64()),
        _ints(owner, owner >= 0, pa.int32()), _ints(below, below >= 0, pa.int32()), _ints(slot, slot >= 0, pa.int32()), pa.array(objects, pa.int32()), _ints(post, post >= 0, pa.int32()), pa.array(binding),
    ]
    return Bulk(np.zeros(0, np.int64), [depth, most, counts, name_bytes], counts, columns), bad
