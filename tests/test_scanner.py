"""The byte scanner: kinds and places of failures, inclusive limits, and agreement with another JSON reader."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.scanner import scan
from tessera.operators.ingest import diagnostics
from tessera.options import ReadOptions
from tessera.plans.cases import DESCRIBED

OPTIONS = ReadOptions()


def failure(content, **limits):
    found = scan(content, OPTIONS.with_(**limits))
    return found.failure, found.position and found.position[0]


@pytest.mark.parametrize(
    ("content", "kind", "offset"),
    [
        (b"", "Syntax", 0), (b"{", "Syntax", 1), (b"[1,]", "Syntax", 3), (b"01", "Syntax", 1), (b"1.", "Syntax", 2), (b"-", "Syntax", 1), (b"1e", "Syntax", 2), (b"1.5e+", "Syntax", 5),
        (b"tru", "Syntax", 0), (b'"\\ud800x"', "Syntax", 1), (b'"\\ud800\\u0041"', "Syntax", 7), (b'"\\u12', "Syntax", 5), (b'"a\nb"', "Syntax", 2), (b'"unterminated', "Syntax", 13),
        (b"{} x", "Syntax", 3), (b"[1 2]", "Syntax", 3), (b'{"a" 1}', "Syntax", 5), (b'{"\x80":0}', "InvalidUtf8", 2), (b'{"a":0,"a":1}', "DuplicateMember", 7), (b'{"a":0,"\\u0061":1}', "DuplicateMember", 7),
        (b"NaN", "Syntax", 0), (b"\xef\xbb\xbf{}", "Syntax", 0),
    ],
)
def test_failures_have_kind_and_place(content, kind, offset):
    assert failure(content) == (kind, offset)


@pytest.mark.parametrize(
    ("content", "limit", "most", "kind"),
    [
        (b"[[]]", "max_json_nesting_depth", 2, "NestingLimit"), (b'{"a":0,"b":1}', "max_json_object_members", 2, "ObjectMemberLimit"),
        (b"[1,2]", "max_json_values", 3, "ValueLimit"), ('{"é":0}'.encode(), "max_decoded_member_name_bytes", 2, "DecodedMemberNameBytesLimit"),
    ],
)
def test_limits_are_inclusive(content, limit, most, kind):
    assert failure(content, **{limit: most})[0] is None
    assert failure(content, **{limit: most - 1})[0] == kind


def test_order_of_checks():
    assert failure(b"[", max_json_values=0) == ("ValueLimit", 0)
    assert failure(b"[", max_json_nesting_depth=0) == ("NestingLimit", 0)
    assert failure(b"x", max_json_values=0) == ("Syntax", 0)
    assert failure(b'{"a', max_json_object_members=0) == ("ObjectMemberLimit", 1)
    assert failure(b'{"a":0,"a":1}', max_decoded_member_name_bytes=1) == ("DecodedMemberNameBytesLimit", 7)


def test_metrics_and_places():
    found = scan(b'{"a":[1,{"b":true}],"c":null}', OPTIONS)
    assert (found.max_nesting_depth, found.max_object_members, found.total_values, found.decoded_member_name_bytes) == (3, 2, 6, 3)
    assert [(r[5], r[11], r[12]) for r in found.rows] == [("object", 0, 29), ("array", 5, 19), ("number", 6, 7), ("object", 8, 18), ("boolean", 13, 17), ("null", 24, 28)]
    assert scan(b"[1,\n 2,\n  x]", OPTIONS).position == (10, 2, 2)
    assert [r[9] for r in scan(b"[1.0, 1e+02, -0, 1e400]", OPTIONS).rows[1:]] == ["1.0", "1e+02", "-0", "1e400"]


def test_depth_needs_no_recursion():
    deep = b"[" * 50_000 + b"]" * 50_000
    assert scan(deep, OPTIONS.with_(max_json_nesting_depth=50_000, max_json_values=50_000)).failure is None


def _unique(pairs):
    made = dict(pairs)
    if len(made) != len(pairs):
        raise ValueError
    return made


def _no_constant(name):
    raise ValueError(name)


TOKENS = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', "1", "-2.5e3", "true", "null", " ", '"\\u0041"', "0", '"', "\\", "x", "1.", "\n", '"\\ud83d\\ude00"', '"\\ud83d"']


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=10).map("".join))
def test_accepts_what_a_strict_reader_accepts(text):
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
        json.dumps(value, ensure_ascii=False).encode()
        good = True
    except (ValueError, UnicodeEncodeError):
        good = False
    found = scan(text.encode(), OPTIONS)
    assert (found.failure is None) == good
    if found.position:
        assert 0 <= found.position[0] <= len(text.encode())


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=15))
def test_tokens_are_the_source(value):
    content = json.dumps(value, ensure_ascii=False).encode()
    rows = scan(content, OPTIONS).rows
    assert json.loads(content[rows[0][11] : rows[0][12]]) == value
    for r in rows:
        if r[5] == "string":
            assert json.loads(content[r[11] : r[12]]) == r[9]
        if r[6] is not None:
            assert json.loads(content[r[7] : r[8]]) == r[6]


def test_faults_are_described():
    for content, *told in DESCRIBED:
        found = scan(content, ReadOptions())
        assert [found.why, *(found.position or (None,) * 3)] == told, content
    assert scan(b'{"a\\"\\n\\u0001":0,"a\\"\\n\\u0001":0}', ReadOptions()).why == r'duplicate object member "a\"\n\u{1}"'


def test_diagnostics_know_no_limits(spark):
    deep = b"[" * 5000 + b"]" * 5000
    rows = spark.createDataFrame([(0, bytearray(deep)), (1, bytearray(deep[:-1])), (2, None)], "doc_id long, content binary")
    found = {r["doc_id"]: (r["message"], r["err_offset"]) for r in diagnostics(rows).collect()}
    assert found == {1: ("expected ',' or ']'", 9999), 2: ("expected a JSON value", 0)}
    assert diagnostics(rows.limit(0)).count() == 0
