"""JSON-LD 1.1 to RDF quads for one document, from the W3C recommendation; no context is ever loaded.

Quads come one by one in document order, so a budget can stop the reading before a later error is met. Supported:
inline contexts (objects and lists of them, at any node), term definitions with ``@id @type @language @container @prefix
@reverse @context``, ``@base @vocab @language``, keyword aliases, value objects, lists, sets, named graphs, ``@included``,
``@reverse``, ``@nest``, language and index maps. Not supported: ``@direction`` and framing.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from tessera.functions.iri import is_absolute_iri, resolve
from tessera.functions.scanner import COLUMNS, scan
from tessera.options import ReadOptions

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_ROW = [name for name, _ in COLUMNS]
_LANG_STRING, _STRING = RDF + "langString", XSD + "string"
# The keywords of JSON-LD 1.1.
KEYWORDS = frozenset(
    "@base @container @context @default @direction @graph @id @import @included @index @json @language @list @nest @none @prefix @propagate @protected @reverse @set @type @value @version @vocab".split()
)


class JsonLdError(Exception):
    pass


class Number(str):
    """A number's spelling."""


class Members(list):
    """An object's members in order; names are unique."""

    def get(self, name: str) -> Any:
        return next((v for n, v in self if n == name), None)


class Term(NamedTuple):
    kind: str  # iri, blank or literal
    value: str
    datatype: str | None = None
    language: str | None = None


class Quad(NamedTuple):
    subject: Term
    predicate: str
    object: Term
    graph: Term | None


@dataclass
class Definition:
    iri: str | None
    type: str | None = None
    language: str | None = None
    has_language: bool = False
    containers: tuple = ()
    prefix: bool = False
    reverse: bool = False
    context: Any = None
    has_context: bool = False


@dataclass
class Context:
    base: str | None
    original: str
    vocab: str | None = None
    language: str | None = None
    terms: dict[str, Definition | None] = field(default_factory=dict)
    known: dict[tuple, str | None] = field(default_factory=dict)  # what names have expanded to, once the context is whole

    def copy(self) -> Context:
        return Context(self.base, self.original, self.vocab, self.language, dict(self.terms))


def read(content: bytes) -> Any:
    """The document with numbers as spelled and objects as ordered members; any depth."""
    try:
        return json.loads(content, object_pairs_hook=Members, parse_int=Number, parse_float=Number)
    except RecursionError:
        return _read_deep(content)


def _read_deep(content: bytes) -> Any:
    """The same from the rows of a scan, which come parents first."""
    most = len(content) + 1
    limits = ReadOptions(max_json_nesting_depth=most, max_json_object_members=most, max_json_values=most, max_decoded_member_name_bytes=most)
    made: list[Any] = []
    for row in scan(content, limits).rows:
        at = dict(zip(_ROW, row))
        kind, text = at["kind"], at["text"]
        value = Members() if kind == "object" else [] if kind == "array" else Number(text) if kind == "number" else text if kind == "string" else at["flag"]
        made.append(value)
        if at["parent_id"] is not None:
            made[at["parent_id"]].append((at["name"], value) if at["parent_kind"] == "object" else value)
    return made[0]


def _keyword_like(name: str) -> bool:
    return len(name) > 1 and name[0] == "@" and name[1:].isascii() and name[1:].isalpha()


def expand_iri(value: str, ctx: Context, relative: bool = False, vocab: bool = False, local: Members | None = None, done: dict | None = None) -> str | None:
    """The IRI or keyword a name stands for; ``local`` is a context that is being made."""
    if local is not None:
        return _expand(value, ctx, relative, vocab, local, done)
    key = (value, relative, vocab)
    if key not in ctx.known:
        ctx.known[key] = _expand(value, ctx, relative, vocab, None, None)
    return ctx.known[key]


def _expand(value: str, ctx: Context, relative: bool, vocab: bool, local: Members | None, done: dict | None) -> str | None:
    if value in KEYWORDS:
        return value
    if _keyword_like(value):
        return None
    if local is not None and done.get(value) is not True and any(n == value for n, _ in local):
        define(ctx, local, value, done)
    if vocab and value in ctx.terms:
        return ctx.terms[value].iri if ctx.terms[value] else None
    if ctx.terms.get(value) and ctx.terms[value].iri in KEYWORDS:
        return ctx.terms[value].iri
    if ":" in value[1:]:
        prefix, _, suffix = value.partition(":")
        if prefix == "_" or suffix.startswith("//"):
            return value
        if local is not None and done.get(prefix) is not True and any(n == prefix for n, _ in local):
            define(ctx, local, prefix, done)
        known = ctx.terms.get(prefix)
        if known and known.iri is not None and known.prefix:
            return known.iri + suffix
        if is_absolute_iri(value):
            return value
    if vocab and ctx.vocab is not None:
        return ctx.vocab + value
    if relative and ctx.base is not None:
        return resolve(ctx.base, value)
    return value


def define(ctx: Context, local: Members, term: str, done: dict) -> None:
    """Make the definition of one term of a local context; ``done`` is False while a term is being made."""
    if term in done:
        if done[term]:
            return
        raise JsonLdError("cyclic IRI mapping")
    if not term:
        raise JsonLdError("invalid term definition")
    done[term] = False
    value = local.get(term)
    if term in KEYWORDS and term != "@type":
        raise JsonLdError("keyword redefinition")
    if _keyword_like(term) and term != "@type":
        done[term] = True
        return
    simple = isinstance(value, str) and not isinstance(value, Number)
    if value is None:
        value = Members([("@id", None)])
    elif simple:
        value = Members([("@id", value)])
    if not isinstance(value, Members):
        raise JsonLdError("invalid term definition")
    made = Definition(None)
    names = {n for n, _ in value}
    if names - {"@id", "@reverse", "@container", "@context", "@language", "@nest", "@prefix", "@propagate", "@protected", "@type", "@index", "@direction"}:
        raise JsonLdError("invalid term definition")

    def text(name: str) -> str:
        found = value.get(name)
        if not isinstance(found, str) or isinstance(found, Number):
            raise JsonLdError(f"invalid {name}")
        return found

    if "@type" in names:
        made.type = expand_iri(text("@type"), ctx, vocab=True, local=local, done=done)
        if made.type not in ("@id", "@vocab", "@json", "@none") and not (made.type and is_absolute_iri(made.type)):
            raise JsonLdError("invalid type mapping")
    if "@reverse" in names:
        if "@id" in names:
            raise JsonLdError("invalid reverse property")
        made.iri, made.reverse = expand_iri(text("@reverse"), ctx, vocab=True, local=local, done=done), True
        if made.iri is None or ":" not in made.iri:
            raise JsonLdError("invalid IRI mapping")
    elif "@id" in names and value.get("@id") != term:
        if value.get("@id") is None:
            ctx.terms[term], done[term] = None, True
            return
        made.iri = expand_iri(text("@id"), ctx, vocab=True, local=local, done=done)
        if made.iri is None:
            done[term] = True
            return
        if made.iri == "@context" or made.iri not in KEYWORDS and ":" not in made.iri:
            raise JsonLdError("invalid IRI mapping")
        if ":" not in term and "/" not in term and simple and (made.iri[-1:] in ":/?#[]@" or made.iri.startswith("_:")):
            made.prefix = True
    elif ":" in term[1:]:
        prefix, _, suffix = term.partition(":")
        if any(n == prefix for n, _ in local):
            define(ctx, local, prefix, done)
        known = ctx.terms.get(prefix)
        made.iri = known.iri + suffix if known and known.iri else term
    elif "/" in term:
        made.iri = _expand(term, ctx, False, True, None, None)
    elif term == "@type":
        made.iri = "@type"
    elif ctx.vocab is not None:
        made.iri = ctx.vocab + term
    else:
        raise JsonLdError("invalid IRI mapping")
    if "@container" in names:
        given = value.get("@container")
        made.containers = tuple(given) if isinstance(given, list) and not isinstance(given, Members) else (given,)
        if any(c not in ("@list", "@set", "@index", "@language", "@graph", "@id", "@type") for c in made.containers):
            raise JsonLdError("invalid container mapping")
    if "@context" in names:
        made.context, made.has_context = value.get("@context"), True
    if "@language" in names and "@type" not in names:
        made.language, made.has_language = (None if value.get("@language") is None else text("@language").lower()), True
    if "@prefix" in names:
        if value.get("@prefix") not in (True, False) or ":" in term or "/" in term:
            raise JsonLdError("invalid @prefix value")
        made.prefix = value.get("@prefix")
    ctx.terms[term], done[term] = made, True


def process(active: Context, local: Any) -> Context:
    """The active context after a local one."""
    ctx = active.copy()
    for part in local if isinstance(local, list) and not isinstance(local, Members) else [local]:
        if part is None:
            ctx = Context(ctx.original, ctx.original)
            continue
        if not isinstance(part, Members):
            raise JsonLdError("loading remote context failed" if isinstance(part, str) else "invalid local context")
        ctx = ctx.copy()
        for name, value in part:
            is_text = isinstance(value, str) and not isinstance(value, Number)
            if name == "@import":
                raise JsonLdError("loading remote context failed")
            if name == "@version" and value not in ("1.1",):
                raise JsonLdError("invalid @version value")
            if name == "@base":
                if value is not None and not is_text:
                    raise JsonLdError("invalid base IRI")
                ctx.base = None if value is None else resolve(ctx.base or ctx.original, value)
            if name == "@vocab":
                if value is not None and not is_text:
                    raise JsonLdError("invalid vocab mapping")
                ctx.vocab = None if value is None else _expand(value, ctx, True, True, None, None)
            if name == "@language":
                if value is not None and not is_text:
                    raise JsonLdError("invalid default language")
                ctx.language = None if value is None else value.lower()
        done: dict[str, bool] = {}
        for name, _ in part:
            if name not in ("@base", "@direction", "@import", "@language", "@propagate", "@protected", "@version", "@vocab"):
                define(ctx, part, name, done)
    return ctx


_SPELLING = re.compile(r"(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?")


def number_term(spelling: str, datatype: str | None) -> Term:
    """The literal of a number, worked out on its digits: a whole one below 10^21 is an integer, others are doubles."""
    sign, whole, part, power = _SPELLING.fullmatch(spelling).groups(default="")
    digits = (whole + part).lstrip("0")
    kept = digits.rstrip("0")
    exponent = int(power or 0) - len(part) + len(digits) - len(kept) if kept else 0
    leading = exponent + len(kept) - 1 if kept else 0
    if exponent >= 0 and leading < 21 and datatype != XSD + "double":
        return Term("literal", f"{sign}{kept}{'0' * exponent}" if kept else "0", datatype or XSD + "integer")
    return Term("literal", f"{sign}{kept[:1] or '0'}.{kept[1:] or '0'}E{leading}", datatype or XSD + "double")


#: What a part of a document gives: quads, and parts below it.
Parts = Iterator["Quad | Parts"]


class Reader:
    """Quads of one document. Blank nodes are numbered in the order they are met.

    The parts of a document give quads and the parts below them, which ``quads`` runs on a stack of its own, so depth isn't
    bounded and a quad is handed on once, however deep it lies.
    """

    def __init__(self, base: str):
        self.base, self.blanks, self.names = base, 0, {}

    def blank(self, label: str | None = None) -> Term:
        if label is not None and label in self.names:
            return self.names[label]
        made = Term("blank", f"b{self.blanks}")
        self.blanks += 1
        if label is not None:
            self.names[label] = made
        return made

    def resource(self, iri: str | None) -> Term | None:
        """The term of an expanded id, or None for what is no IRI."""
        if iri is None or iri in KEYWORDS:
            return None
        if iri.startswith("_:"):
            return self.blank(iri)
        return Term("iri", iri) if is_absolute_iri(iri) else None

    def quads(self, document: Any) -> Iterator[Quad]:
        running: list[Parts] = [self.whole(document)]
        while running:
            for made in running[-1]:
                if type(made) is Quad:
                    yield made
                else:
                    running.append(made)
                    break
            else:
                running.pop()

    def whole(self, document: Any) -> Parts:
        ctx = Context(self.base, self.base)
        for item in document if isinstance(document, list) and not isinstance(document, Members) else [document]:
            yield self.top(item, ctx, None)

    def top(self, item: Any, ctx: Context, graph: Term | None) -> Parts:
        if isinstance(item, Members):
            inner, keys = self.keys(item, ctx, None)
            if any(k == "@value" for k, _, _ in keys):
                return
            if any(k in ("@set", "@list") for k, _, _ in keys):
                for k, _, value in keys:
                    if k in ("@set", "@list"):
                        yield self.top(value, inner, graph)
                return
            if {k for k, _, _ in keys} <= {"@graph", "@context", None} and any(k == "@graph" for k, _, _ in keys):
                for k, _, value in keys:
                    if k == "@graph":
                        yield self.top(value, inner, graph)
                return
            subject = self.subject(keys, inner)
            yield self.node(subject, keys, inner, graph)
        elif isinstance(item, list):
            for each in item:
                yield self.top(each, ctx, graph)

    def keys(self, item: Members, ctx: Context, scoped: Definition | None) -> tuple[Context, list[tuple[str | None, str, Any]]]:
        """The node's own context, and its members with expanded names."""
        if scoped is not None and scoped.has_context:
            ctx = process(ctx, scoped.context)
        for name, value in item:
            if name == "@context":
                ctx = process(ctx, value)
        for name, value in item:  # contexts of types, in order of their names
            if expand_iri(name, ctx, vocab=True) == "@type":
                given = value if isinstance(value, list) and not isinstance(value, Members) else [value]
                for t in sorted(x for x in given if isinstance(x, str)):
                    known = ctx.terms.get(t)
                    if known and known.has_context:
                        ctx = process(ctx, known.context)
        found, seen = [], set()
        for name, value in item:
            if name == "@context":
                continue
            key = expand_iri(name, ctx, vocab=True)
            if key in KEYWORDS:
                if key in seen and key not in ("@type", "@included", "@nest"):
                    raise JsonLdError("colliding keywords")
                seen.add(key)
            elif key is None or ":" not in key:
                continue
            found.append((key, name, value))
        return ctx, found

    def subject(self, keys: list, ctx: Context) -> Term | None:
        for key, _, value in keys:
            if key == "@id":
                if not isinstance(value, str) or isinstance(value, Number):
                    raise JsonLdError("invalid @id value")
                return self.resource(expand_iri(value, ctx, relative=True))
        return self.blank()

    def node(self, subject: Term | None, keys: list, ctx: Context, graph: Term | None) -> Parts:
        for key, name, value in keys:
            definition = ctx.terms.get(name)
            many = value if isinstance(value, list) and not isinstance(value, Members) else [value]
            if key == "@type":
                for t in many:
                    if not isinstance(t, str) or isinstance(t, Number):
                        raise JsonLdError("invalid type value")
                    kind = self.resource(expand_iri(t, ctx, relative=True, vocab=True))
                    if subject and kind:
                        yield Quad(subject, RDF + "type", kind, graph)
            elif key == "@graph":
                for each in many:
                    yield self.top(each, ctx, subject)
            elif key == "@included":
                for each in many:
                    if not isinstance(each, Members):
                        raise JsonLdError("invalid @included value")
                    yield self.top(each, ctx, graph)
            elif key == "@nest":
                for each in many:
                    if not isinstance(each, Members):
                        raise JsonLdError("invalid @nest value")
                    inner, more = self.keys(each, ctx, definition)
                    yield self.node(subject, more, inner, graph)
            elif key == "@reverse":
                if not isinstance(value, Members):
                    raise JsonLdError("invalid @reverse value")
                _, more = self.keys(value, ctx, None)
                for k, n, v in more:
                    if k in KEYWORDS:
                        raise JsonLdError("invalid reverse property map")
                    yield self.links(subject, k, ctx.terms.get(n), v, ctx, graph, True)
            elif key in ("@value", "@list", "@set", "@language"):
                raise JsonLdError(f"misplaced {key}")
            elif key not in KEYWORDS:
                yield self.links(subject, key, definition, value, ctx, graph, bool(definition and definition.reverse))

    def links(self, subject: Term | None, predicate: str, definition: Definition | None, value: Any, ctx: Context, graph: Term | None, back: bool) -> Parts:
        containers = definition.containers if definition else ()
        usable = subject is not None and is_absolute_iri(predicate)
        if "@list" in containers and not (isinstance(value, Members) and value.get("@list") is not None):
            many = value if isinstance(value, list) and not isinstance(value, Members) else [value]
            value = Members([("@list", many)])
        elif "@language" in containers and isinstance(value, Members):
            out = []
            for tag, texts in value:
                for text in texts if isinstance(texts, list) else [texts]:
                    if text is not None:
                        out.append(Members([("@value", text)] + ([("@language", tag)] if tag != "@none" else [])))
            value = out
        elif "@index" in containers and isinstance(value, Members):
            value = [v for _, vs in value for v in (vs if isinstance(vs, list) and not isinstance(vs, Members) else [vs])]
        yield self.values(subject, predicate, definition, value, ctx, graph, back, usable)

    def values(self, subject, predicate, definition, value, ctx, graph, back, usable) -> Parts:
        if isinstance(value, list) and not isinstance(value, Members):
            plain = usable and not back and not (definition and definition.type == "@json")
            datatype, language = self.text_kind(definition, ctx)
            simple, new = plain and datatype is not None, tuple.__new__  # the tuples of many strings, made directly
            for each in value:
                if simple and type(each) is str:
                    yield new(Quad, (subject, predicate, new(Term, ("literal", each, datatype, language)), graph))
                elif plain and isinstance(each, (str, bool)):
                    term = self.scalar(definition, each, ctx)
                    if term is not None:
                        yield Quad(subject, predicate, term, graph)
                else:
                    yield self.values(subject, predicate, definition, each, ctx, graph, back, usable)
            return
        if isinstance(value, Members):
            inner, keys = self.keys(value, ctx, definition)
            if any(k == "@set" for k, _, _ in keys):
                for k, _, v in keys:
                    if k == "@set":
                        yield self.values(subject, predicate, definition, v, inner, graph, back, usable)
                return
        term, rest = self.term(definition, value, ctx, graph)
        if term is not None and usable:
            if back:
                if term.kind == "literal":
                    raise JsonLdError("invalid reverse property value")
                yield Quad(term, predicate, subject, graph)
            else:
                yield Quad(subject, predicate, term, graph)
        if rest is not None:
            yield rest

    def term(self, definition: Definition | None, value: Any, ctx: Context, graph: Term | None) -> tuple[Term | None, Parts | None]:
        """The object a value stands for, and the quads below it."""
        if value is None:
            return None, None
        kind = definition.type if definition else None
        if kind == "@json":
            return Term("literal", _json_text(value), RDF + "JSON"), None
        if not isinstance(value, Members):
            return self.scalar(definition, value, ctx), None
        inner, keys = self.keys(value, ctx, definition)
        names = {k for k, _, _ in keys}
        if "@value" in names:
            return self.value_object(keys, inner), None
        if "@list" in names:
            if names - {"@list", "@index"}:
                raise JsonLdError("invalid set or list object")
            items = next(v for k, _, v in keys if k == "@list")
            return self.collection(items if isinstance(items, list) and not isinstance(items, Members) else [items], definition, inner, graph)
        subject = self.subject(keys, inner)
        return subject, self.node(subject, keys, inner, graph)

    def collection(self, items: list, definition: Definition | None, ctx: Context, graph: Term | None) -> tuple[Term, Parts | None]:
        flat: list = []
        for item in items:  # a list inside is a list of its own; a set inside is flattened by its reader
            if item is not None:
                flat.append(Members([("@list", item)]) if isinstance(item, list) and not isinstance(item, Members) else item)
        if not flat:
            return Term("iri", RDF + "nil"), None
        cells = [self.blank() for _ in flat]

        def body() -> Parts:
            for i, item in enumerate(flat):
                term, rest = self.term(definition, item, ctx, graph)
                if term is not None:
                    yield Quad(cells[i], RDF + "first", term, graph)
                if rest is not None:
                    yield rest
                yield Quad(cells[i], RDF + "rest", cells[i + 1] if i + 1 < len(cells) else Term("iri", RDF + "nil"), graph)

        return cells[0], body()

    def scalar(self, definition: Definition | None, value: Any, ctx: Context) -> Term | None:
        kind = definition.type if definition else None
        datatype = kind if kind not in (None, "@id", "@vocab", "@none") else None
        if isinstance(value, bool):
            return Term("literal", "true" if value else "false", datatype or XSD + "boolean")
        if isinstance(value, Number):
            return number_term(value, datatype)
        if kind == "@id":
            return self.resource(expand_iri(value, ctx, relative=True))
        if kind == "@vocab":
            return self.resource(expand_iri(value, ctx, relative=True, vocab=True))
        return Term("literal", value, *self.text_kind(definition, ctx))

    def text_kind(self, definition: Definition | None, ctx: Context) -> tuple[str | None, str | None]:
        """Data type and language of a string under a definition; no type where it stands for a resource."""
        kind = definition.type if definition else None
        if kind in ("@id", "@vocab"):
            return None, None
        if kind not in (None, "@none"):
            return kind, None
        language = definition.language if definition and definition.has_language else ctx.language
        return (_LANG_STRING, language) if language else (_STRING, None)

    def value_object(self, keys: list, ctx: Context) -> Term | None:
        given = {k: v for k, _, v in keys}
        if set(given) - {"@value", "@type", "@language", "@index", "@direction"} or "@type" in given and "@language" in given:
            raise JsonLdError("invalid value object")
        value, language = given["@value"], given.get("@language")
        if given.get("@type") == "@json":
            return Term("literal", _json_text(value), RDF + "JSON")
        if isinstance(value, list):
            raise JsonLdError("invalid value object value")
        if value is None:
            return None
        if language is not None:
            if not isinstance(value, str) or isinstance(value, Number) or not isinstance(language, str):
                raise JsonLdError("invalid language-tagged value")
            return Term("literal", value, RDF + "langString", language.lower())
        datatype = given.get("@type")
        if datatype is not None:
            datatype = expand_iri(datatype, ctx, relative=True, vocab=True) if isinstance(datatype, str) else None
            if datatype is None or not is_absolute_iri(datatype):
                raise JsonLdError("invalid typed value")
        if isinstance(value, bool):
            return Term("literal", "true" if value else "false", datatype or XSD + "boolean")
        if isinstance(value, Number):
            return number_term(value, datatype)
        return Term("literal", value, datatype or XSD + "string")


def _json_text(value: Any) -> str:
    """JSON text of a value, members by name; any depth."""
    out: list[str] = []
    waiting: list[tuple[bool, Any]] = [(False, value)]
    while waiting:
        is_text, v = waiting.pop()
        if is_text:
            out.append(v)
        elif isinstance(v, list):
            pairs = [(json.dumps(n, ensure_ascii=False) + ":", x) for n, x in sorted(v, key=lambda m: m[0])] if isinstance(v, Members) else [("", x) for x in v]
            start, end = "{}" if isinstance(v, Members) else "[]"
            out.append(start)
            waiting.append((True, end))
            for i in range(len(pairs) - 1, -1, -1):
                waiting += [(False, pairs[i][1]), (True, ("," if i else "") + pairs[i][0])]
        elif isinstance(v, Number):
            out.append(json.dumps(float(v)) if any(c in v for c in ".eE") else "0" if v == "-0" else str(v))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def term_bytes(quad: Quad) -> int:
    """UTF-8 bytes of a quad's terms, as they would be kept."""
    subject, predicate, (kind, value, datatype, language), graph = quad
    total = _size(subject.value) + _size(predicate) + _size(value)
    if kind == "literal":
        total += _size(datatype) + (_size(language) if language else 0)
    return total + (_size(graph.value) if graph else 0)


def to_quads(content: bytes, base: str, most_quads: int, most_bytes: int, with_quads: bool = True) -> tuple[str | None, int, int, list[Quad]]:
    """Failure, quads emitted, bytes of terms kept, and the quads (none if it failed, or they aren't asked for).

    The quad that breaks a budget counts as emitted; its bytes do not. The number of quads is looked at first.
    """
    emitted = kept = base_size = 0
    quads: list[Quad] = []
    keep = quads.append if with_quads else None
    sizes: dict[str | None, int] = {None: 0}
    subject_then = predicate_then = graph_then = None
    limit, most_digits = sys.getrecursionlimit(), sys.get_int_max_str_digits()
    sys.setrecursionlimit(max(limit, 20_000 + len(content)))  # terms that rest on each other; calls between Python functions take no C stack
    sys.set_int_max_str_digits(0)
    try:
        for quad in Reader(base).quads(read(content)):
            emitted += 1
            if emitted > most_quads:
                return "RdfQuadLimit", emitted, kept, []
            subject, predicate, (kind, value, datatype, language), graph = quad
            if subject is not subject_then or predicate is not predicate_then or graph is not graph_then:  # mostly the same as before
                base_size = _size(subject.value) + _size(predicate) + (_size(graph.value) if graph else 0)
                subject_then, predicate_then, graph_then = subject, predicate, graph
            size = base_size + (len(value) if value.isascii() else len(value.encode()))
            if kind == "literal":
                if datatype not in sizes:
                    sizes[datatype] = _size(datatype)
                size += sizes[datatype] + (_size(language) if language else 0)
            if kept + size > most_bytes:
                return "RetainedRdfTermBytesLimit", emitted, kept, []
            kept += size
            if keep:
                keep(quad)
    except JsonLdError:
        return "JsonLd", emitted, kept, []
    finally:
        sys.setrecursionlimit(limit)
        sys.set_int_max_str_digits(most_digits)
    return None, emitted, kept, quads
