"""Quads of small documents, budgets, and the stress workload's counts."""

import pytest

from tessera.functions.iri import is_absolute_iri, resolve
from tessera.functions.jsonld import to_quads
from tessera.sources.documents import stress_cases

BASE = "https://example.test/dir/input"


def quads(text, most=10**6, size=10**9):
    return to_quads(text if isinstance(text, bytes) else text.encode(), BASE, most, size)


def lines(text):
    return sorted(f"{q.subject.value} {q.predicate} {q.object.value}" + (f" @{q.object.language}" if q.object.language else "") + (f" [{q.graph.value}]" if q.graph else "") for q in quads(text)[3])


def test_numbers_are_canonical():
    found = quads('{"@id":"https://e.test/s","https://e.test/v":[1, 1.0, 1e+02, -0, 1e400, 1.5, -2.50e-3]}')[3]
    assert [q.object.value for q in found] == ["1", "1", "100", "0", "1.0E400", "1.5E0", "-2.5E-3"]


def test_ids_resolve_against_the_document():
    assert lines('{"@id":"a/../b","https://e.test/p":{"@id":"#x"}}') == ["https://example.test/dir/b https://e.test/p https://example.test/dir/input#x"]


def test_terms_types_languages_and_containers():
    text = """{"@context":[{"ex":"https://obsolete.test/"},{"ex":"https://e.test/","n":{"@id":"ex:n","@type":"http://www.w3.org/2001/XMLSchema#integer"},"l":{"@id":"ex:l","@type":"@id"},
      "t":{"@id":"ex:t","@language":"en"},"list":{"@id":"ex:list","@container":"@list"},"back":{"@reverse":"ex:back"}}],
      "@id":"ex:s","n":7,"l":"ex:o","t":"word","ex:plain":"p","list":[],"back":{"@id":"ex:b"}}"""
    assert lines(text) == sorted([
        "https://e.test/s https://e.test/n 7", "https://e.test/s https://e.test/l https://e.test/o", "https://e.test/s https://e.test/t word @en", "https://e.test/s https://e.test/plain p",
        "https://e.test/s https://e.test/list http://www.w3.org/1999/02/22-rdf-syntax-ns#nil", "https://e.test/b https://e.test/back https://e.test/s",
    ])


def test_named_and_nested_graphs():
    assert lines('{"@id":"https://e.test/g","@graph":{"@id":"https://e.test/s","https://e.test/p":"v"}}') == ["https://e.test/s https://e.test/p v [https://e.test/g]"]
    assert lines('{"@graph":[{"@id":"https://e.test/s","https://e.test/p":"v"}]}') == ["https://e.test/s https://e.test/p v"]


@pytest.mark.parametrize("text", ['{"@context":"https://e.test/remote"}', '{"@context":42}', '{"@id":1}', '{"@context":{"a":"@id","b":"@id"},"a":"https://e.test/1","b":"https://e.test/2"}', '{"@context":{"a":"b:x","b":"a:y"}}', '{"https://e.test/p":{"@value":"x","@type":"https://e.test/t","@language":"en"}}', '{"@type":1}'])
def test_errors_fail_the_document(text):
    assert quads(text) == ("JsonLd", 0, 0, [])


def test_budgets_cut_in_order():
    two = '[{"@id":"https://e.test/s","https://e.test/p":"ok"},{"@id":1}]'
    assert quads(two, most=0)[:2] == ("RdfQuadLimit", 1)
    assert quads(two)[:2] == ("JsonLd", 1)
    one = '{"@id":"https://e.test/s","https://e.test/p":["v","v"]}'
    size = quads(one)[2]
    assert quads(one, size=size)[0] is None
    assert quads(one, size=size - 1)[:3] == ("RetainedRdfTermBytesLimit", 2, size // 2)
    assert quads(one, most=1, size=0)[0] == "RetainedRdfTermBytesLimit"
    assert quads(one, most=0, size=0)[0] == "RdfQuadLimit"


@pytest.mark.parametrize("case", stress_cases(), ids=lambda c: c[0])
def test_stress_workload(case):
    from tessera.functions.scanner import scan
    from tessera.options import ReadOptions

    name, _, content, expected, stage = case
    scanned = scan(content, ReadOptions())
    assert (scanned.failure is not None) == (stage == "Json")
    if stage != "Json":
        failed, emitted, *_ = quads(content)
        assert (failed, emitted) == (("JsonLd", 0) if stage else (None, expected))


def test_total_bytes_of_the_stress_workload():
    assert sum(len(c[2]) for c in stress_cases()) == 1_133_933


@pytest.mark.parametrize(("iri", "good"), [("https://e.test/a%20b", True), ("urn:x", True), ("a", False), ("//e.test/", False), ("http://[::1]/", True), ("http://[::g]/", False), ("http://e.test/a b", False), ("http://e.test/%zz", False), ("1a:b", False), ("http://e.test/é", True), ("http://e.test:x/", False), ("http://e.test/a\\b", False), ("http://e.test/^", False), ("http://e.test/`", False)])
def test_absolute_iris(iri, good):
    assert is_absolute_iri(iri) == good


# the reference examples of RFC 3986, section 5.4
@pytest.mark.parametrize(("reference", "target"), [("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("#s", "http://a/b/c/d;p?q#s"), ("", "http://a/b/c/d;p?q"), ("..", "http://a/b/"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("g.", "http://a/b/c/g."), ("./../g", "http://a/b/g"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/./x", "http://a/b/c/g?y/./x")])
def test_resolution(reference, target):
    assert resolve("http://a/b/c/d;p?q", reference) == target


DEEP = 60_000


def test_depth_is_not_bounded():
    nodes = b"".join(b'{"@id":"https://e.test/%d","https://e.test/p":' % i for i in range(DEEP)) + b'{"@id":"https://e.test/end"}' + b"}" * DEEP
    failure, emitted, _, _ = to_quads(nodes, "https://e.test/d", 1 << 40, 1 << 40, False)
    assert (failure, emitted) == (None, DEEP)
    sets = b'{"@id":"https://e.test/s","https://e.test/p":' + b"[" * DEEP + b"7" + b"]" * DEEP + b"}"
    assert to_quads(sets, "https://e.test/d", 9, 1 << 40)[3][0].object.value == "7"
    lists = b'{"@id":"https://e.test/s","https://e.test/p":{"@list":' + b"[" * DEEP + b"]" * DEEP + b"}}"
    assert to_quads(lists, "https://e.test/d", 1 << 40, 1 << 40, False)[:2] == (None, 1 + 2 * (DEEP - 1))
    literal = b'{"@id":"https://e.test/s","https://e.test/p":{"@type":"@json","@value":' + b"[" * DEEP + b'{"b":1.50,"a":-0}' + b"]" * DEEP + b"}}"
    assert to_quads(literal, "https://e.test/d", 9, 1 << 40)[3][0].object.value == "[" * DEEP + '{"a":0,"b":1.5}' + "]" * DEEP


def test_terms_may_rest_on_many_others():
    terms = ",".join(f'"t{i}":{{"@id":"t{i + 1}:x","@prefix":true}}' for i in range(5000))
    content = f'{{"@context":{{{terms},"t5000":"https://e.test/"}},"@id":"https://e.test/s","t0:y":1}}'.encode()
    assert to_quads(content, "https://e.test/d", 9, 1 << 40)[3][0].predicate == "https://e.test/" + "x" * 5000 + "y"


@pytest.mark.parametrize(
    "spelling, value, kind",
    [
        ("1e99999999999999999999", "1.0E99999999999999999999", "double"), ("0e99999999999999999999", "0", "integer"), ("1e400", "1.0E400", "double"), ("-0.0", "0", "integer"),
        ("1.50e3", "1500", "integer"), ("12.50", "1.25E1", "double"), ("1e20", "1" + "0" * 20, "integer"), ("1e21", "1.0E21", "double"), ("-120", "-120", "integer"), ("0.012", "1.2E-2", "double"),
    ],
)
def test_numbers_by_their_spelling(spelling, value, kind):
    quads = to_quads(f'{{"@id":"https://e.test/s","https://e.test/p":{spelling}}}'.encode(), "https://e.test/d", 9, 1 << 40)[3]
    assert (quads[0].object.value, quads[0].object.datatype.split("#")[1]) == (value, kind)
