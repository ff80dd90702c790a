"""The bulk scanner describes what it takes exactly as the exact scanner does, and takes nothing else."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.bulk import scan_many
from tessera.functions.scanner import scan
from tessera.options import ReadOptions
from tessera.sources.documents import stress_cases

OPTIONS = ReadOptions()


def same(docs, options=OPTIONS):
    """Compare, and return how many documents the bulk scanner took."""
    bulk, at = scan_many(docs, options), 0
    columns = [c.to_pylist() for c in bulk.columns]
    for j, i in enumerate(bulk.good.tolist()):
        exact, n = scan(docs[i], options), int(bulk.counts[j])
        assert exact.failure is None
        assert [list(r) for r in zip(*[c[at : at + n] for c in columns])] == exact.rows
        assert [int(m[j]) for m in bulk.metrics] == [exact.max_nesting_depth, exact.max_object_members, exact.total_values, exact.decoded_member_name_bytes]
        at += n
    for i in set(range(len(docs))) - set(bulk.good.tolist()):
        assert b"\\" in docs[i] or scan(docs[i], options).failure is not None
    return len(bulk.good)


def test_nothing_and_empty():
    assert same([]) == 0 and same([b"", b" ", b"\xff"]) == 0
    assert same([b"1", b"", b'"a"', b"{", b"[]", b'{"a":1,"a":2}', b'{"a":{"a":2}}']) == 4


def test_stress_workload():
    assert same([c[2] for c in stress_cases()]) == 15


TOKENS = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', "1", "-2.5e3", "true", "null", " ", "0", '"', "x", "1.", "\n", '"@graph":', '"@id":1', '{"@context":', "\\", "\t", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(TOKENS), max_size=9).map(lambda t: "".join(t).encode()), max_size=8))
def test_any_tokens(docs):
    same(docs)


NAMES = st.sampled_from(["@id", "@graph", "@included", "@context", "@type", "a", "b", "ü"])
LEAVES = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.sampled_from(["", "x", "é"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.recursive(LEAVES, lambda x: st.lists(x, max_size=4) | st.dictionaries(NAMES, x, max_size=4), max_leaves=25), max_size=5), st.sampled_from([None, 1]), st.sampled_from([4, 12, 1000]), st.sampled_from([1, 3, 64]))
def test_any_trees(values, indent, most, depth):
    docs = [json.dumps(v, ensure_ascii=False, indent=indent).encode() for v in values]
    same(docs, OPTIONS.with_(max_json_values=most, max_json_nesting_depth=depth, max_json_object_members=3))
