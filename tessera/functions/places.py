"""What the neighbours of a JSON value say of it, for many documents at once as array operations.

The scanner knows where each value stands; this adds what its children, its parent, the member it lies in and the context
of its document make of it, so that no value has to be joined with another one later:

* ``kid_id``, ``kid_value``, ``kid_type``: the texts of its children of those names; ``up_kid_id``: its parent's
* ``kid_has_value``: it has a child ``@value``; ``kid_other``: it has a child that is no object
* ``slot_name``, ``slot_kind``: of the owner's member that it is or lies in
* ``slot_term``, ``text_term``: the number of the registered term that the member's name, and a type's text, stand for;
  ``kid_ns``: what the document's context binds the prefix of the id of a reference to
* ``malformed``: a structural member that is no object and no list of objects
* ``node``: the number of its owner among the document's nodes, inner ones first; null where the owner is no node
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tessera.functions import names
from tessera.functions.scanner import COLUMNS

SUMMARY = [
    ("kid_id", "string"), ("kid_value", "string"), ("kid_type", "string"), ("up_kid_id", "string"), ("kid_has_value", "boolean"), ("kid_other", "boolean"),
    ("slot_name", "string"), ("slot_kind", "string"), ("slot_term", "int"), ("text_term", "int"), ("kid_ns", "string"), ("malformed", "boolean"), ("node", "int"),
]


def _codes(strings: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for each string (-1 for null) and the strings by number."""
    coded = strings.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _picked(values: pa.Array, at: np.ndarray) -> pa.Array:
    """The values at these places, null for places below 0."""
    return values.take(pa.array(at, pa.int64(), mask=at < 0))


def _bound(columns: dict[str, pa.Array], doc: np.ndarray, n_docs: int, name_code: np.ndarray, names: list[str], is_text: np.ndarray) -> Callable:
    """A function from spellings of some documents to the namespaces that their contexts bind the prefixes to."""
    usable = np.array([not x.startswith("@") for x in names] + [False])
    rows = np.flatnonzero(columns["binding"].to_numpy(zero_copy_only=False) & is_text & usable[name_code])
    known, code = np.unique(name_code[rows], return_inverse=True)
    last = np.full((n_docs, len(known) + 1), -1, np.int64)
    last[doc[rows], code] = rows  # rows are in document order, so the last binding stays
    place = {names[k]: i for i, k in enumerate(known.tolist())}

    def of(spellings: pa.Array, of_doc: np.ndarray) -> np.ndarray:
        index, distinct = _codes(spellings)
        prefix = np.array([place.get(x.partition(":")[0], len(known)) if ":" in x else len(known) for x in distinct] + [len(known)], np.int64)
        return last[of_doc, prefix[index]]

    return of


#: Numbers of the registered terms by namespace and local name.
_TERMS = {(row[0], row[1]): i for i, row in enumerate(names.term_rows())}


def _term(spelling: str, bound: str | None) -> int:
    """The term that a full IRI, or a name whose prefix is bound to a namespace, stands for; -1 for none."""
    for _, iri in names.VOCABULARIES:
        if spelling.startswith(iri):
            return _TERMS.get((iri, spelling[len(iri) :]), -1)
    prefix, _, local = spelling.partition(":")
    return _TERMS.get((bound, local), -1) if prefix and local else -1


def _terms(spellings: pa.Array, bound: np.ndarray, text: pa.Array) -> np.ndarray:
    """The term of each spelling; each pair of a spelling and a binding (a place in ``text``, or -1) is looked at once."""
    index, distinct = _codes(spellings)
    pairs, which = np.unique(np.stack([index, bound]), axis=1, return_inverse=True) if len(index) else (np.zeros((2, 0), np.int64), index)
    iris = _picked(text, pairs[1]).to_pylist()
    found = np.array([_term(distinct[i], iri) if i >= 0 else -1 for i, iri in zip(pairs[0].tolist(), iris)], np.int64)
    return found[which.ravel()] if len(found) else index


def summaries(listed: list[pa.Array], counts: np.ndarray) -> list[pa.Array]:
    """The columns of ``SUMMARY`` for values in the columns of the scanner; ``counts`` values belong to each document."""
    columns = {name: x for (name, _), x in zip(COLUMNS, listed)}
    n, n_docs = len(listed[0]), len(counts)
    doc = np.repeat(np.arange(n_docs), counts)
    base = np.repeat(np.cumsum(counts) - counts, counts)

    def number(name: str) -> np.ndarray:
        return columns[name].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def row_of(name: str) -> np.ndarray:
        found = number(name)
        return np.where(found >= 0, found + base, -1)

    up, slot, owner, level, post = row_of("parent_id"), row_of("slot"), row_of("owner"), number("level"), number("post")
    name_code, names = _codes(columns["name"])
    kind_code, kinds = _codes(columns["kind"])
    named = lambda *wanted: np.isin(name_code, [i for i, x in enumerate(names) if x in wanted])
    kind_is = lambda wanted: kind_code == (kinds.index(wanted) if wanted in kinds else -2)
    is_text, is_object, is_array = kind_is("string"), kind_is("object"), kind_is("array")
    structural, is_id = named("@graph", "@included"), named("@id")

    def child(which: np.ndarray) -> np.ndarray:
        at, rows = np.full(n, -1, np.int64), np.flatnonzero(which & (up >= 0))
        at[up[rows]] = rows
        return at

    def has_child(which: np.ndarray) -> np.ndarray:
        return child(which) >= 0

    kid_id = child(is_id & is_text)
    kid_other = has_child(~is_object)
    malformed = (level == 1) & structural & ~(is_object | is_array & ~kid_other)

    # owners that are nodes: all that look like one, and all that hold more than structure; the root only if it looks like one
    spoiled = np.zeros(n, bool)
    spoiled[owner[malformed]] = True
    looks = has_child(is_id | named("@type"))
    kept = looks | (number("value_id") != 0) & (~has_child(structural) | has_child((name_code >= 0) & ~structural) | spoiled)
    nodes = np.flatnonzero((post >= 0) & kept)
    nodes = nodes[np.lexsort((post[nodes], doc[nodes]))]
    numbered = np.full(n + 1, -1, np.int64)
    per_doc = np.bincount(doc[nodes], minlength=n_docs)
    numbered[nodes] = np.arange(len(nodes)) - (np.cumsum(per_doc) - per_doc)[doc[nodes]]
    node = numbered[owner]

    bound = _bound(columns, doc, n_docs, name_code, names, is_text)
    slot_name = _picked(columns["name"], slot)
    text = columns["text"]
    typed = np.flatnonzero(is_text & (slot >= 0) & named("@type")[slot])
    text_term = np.full(n, -1, np.int64)
    spelled = text.take(pa.array(typed))
    text_term[typed] = _terms(spelled, bound(spelled, doc[typed]), text)
    slot_term = _terms(slot_name, bound(slot_name, doc), text)
    refers = np.flatnonzero((kid_id >= 0) & (level >= 1))
    kid_ns = np.full(n, -1, np.int64)
    kid_ns[refers] = bound(text.take(pa.array(kid_id[refers])), doc[refers])
    return [
        _picked(text, kid_id), _picked(text, child(named("@value") & is_text)), _picked(text, child(named("@type") & is_text)), _picked(text, np.where(up >= 0, kid_id[up], -1)),
        pa.array(has_child(named("@value"))), pa.array(kid_other), slot_name, _picked(columns["kind"], slot),
        *(pa.array(x.astype(np.int32), mask=x < 0) for x in (slot_term, text_term)), _picked(text, kid_ns), pa.array(malformed), pa.array(node.astype(np.int32), mask=node < 0),
    ]
