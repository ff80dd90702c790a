"""IRIs after RFC 3987: validation, and resolution after RFC 3986 section 5.2 with spelling kept."""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

_PARTS = re.compile(r"(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.DOTALL)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*")
# Character ranges of RFC 3987: ucschar, and iprivate, which only a query may have.
_UCS = "\xa0-\ud7ff\uf900-\ufdcf\ufdf0-\uffef" + "".join(f"{chr(p << 16)}-{chr((p << 16) + 0xFFFD)}" for p in range(1, 14)) + "\U000e1000-\U000efffd"
_PRIVATE = "\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd"
_PLAIN = r"A-Za-z0-9._~!$&'()*+,;=\-" + _UCS
_ESCAPE = "%[0-9A-Fa-f]{2}"
_USER = re.compile(f"(?:[{_PLAIN}:]|{_ESCAPE})*")
_HOST = re.compile(f"(?:[{_PLAIN}]|{_ESCAPE})*")
_PATH = re.compile(f"(?:[{_PLAIN}:@/]|{_ESCAPE})*")
_QUERY = re.compile(f"(?:[{_PLAIN}:@/?{_PRIVATE}]|{_ESCAPE})*")
_FRAGMENT = re.compile(f"(?:[{_PLAIN}:@/?]|{_ESCAPE})*")
_FUTURE = re.compile(r"[vV][0-9A-Fa-f]+\.[A-Za-z0-9._~!$&'()*+,;=:-]+")


def split(iri: str) -> tuple[str | None, str | None, str, str | None, str | None]:
    """Scheme, authority, path, query and fragment."""
    m = _PARTS.fullmatch(iri)
    return m[1], m[2], m[3], m[4], m[5]


def _authority_ok(authority: str) -> bool:
    user, at, rest = authority.rpartition("@")
    if at and not _USER.fullmatch(user):
        return False
    if rest.startswith("["):
        inside, end, port = rest[1:].partition("]")
        if not end or (port and not re.fullmatch(":[0-9]*", port)):
            return False
        if _FUTURE.fullmatch(inside):
            return True
        try:
            ipaddress.IPv6Address(inside)
        except ValueError:
            return False
        return "%" not in inside
    host, _, port = rest.partition(":")
    return bool(_HOST.fullmatch(host)) and (not port or port.isascii() and port.isdigit())


def is_iri_reference(iri: str) -> bool:
    scheme, authority, path, query, fragment = split(iri)
    if scheme is not None and not _SCHEME.fullmatch(scheme):
        return False
    if authority is not None and not _authority_ok(authority):
        return False
    if authority is None and path.startswith("//"):
        return False
    if scheme is None and authority is None and ":" in path.split("/", 1)[0]:
        return False
    return bool(_PATH.fullmatch(path)) and (query is None or bool(_QUERY.fullmatch(query))) and (fragment is None or bool(_FRAGMENT.fullmatch(fragment)))


@lru_cache(maxsize=1 << 14)
def is_absolute_iri(iri: str) -> bool:
    """An IRI with a scheme; any part after it is allowed as the grammar says."""
    return split(iri)[0] is not None and is_iri_reference(iri)


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "..":
            if len(out) > 1 or (out and out[0] != ""):
                out.pop()
            if last:
                out.append("")
        elif part == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def _join(scheme: str | None, authority: str | None, path: str, query: str | None, fragment: str | None) -> str:
    return "".join([f"{scheme}:" if scheme is not None else "", f"//{authority}" if authority is not None else "", path, f"?{query}" if query is not None else "", f"#{fragment}" if fragment is not None else ""])


def resolve(base: str, reference: str) -> str:
    """The reference against an absolute base."""
    scheme, authority, path, query, fragment = split(reference)
    if scheme is not None:
        return _join(scheme, authority, _without_dots(path) if path.startswith("/") else path, query, fragment)
    b_scheme, b_authority, b_path, b_query, _ = split(base)
    if authority is not None:
        return _join(b_scheme, authority, _without_dots(path), query, fragment)
    if not path:
        return _join(b_scheme, b_authority, b_path, query if query is not None else b_query, fragment)
    if not path.startswith("/"):
        path = f"/{path}" if b_authority is not None and not b_path else b_path[: b_path.rfind("/") + 1] + path
    return _join(b_scheme, b_authority, _without_dots(path), query, fragment)
