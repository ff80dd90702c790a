"""Limits and the document IRI under which documents are read. Limits are inclusive and zero is a limit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tessera.functions.iri import is_absolute_iri


@dataclass(frozen=True)
class ReadOptions:
    """Options of one reading; ``with_`` gives a changed copy. The IRI isn't shown, as it may name a customer."""

    document_iri: str | None = None
    max_input_bytes: int = 1_048_576
    max_json_nesting_depth: int = 64
    max_json_object_members: int = 4_096
    max_json_values: int = 65_536
    max_decoded_member_name_bytes: int = 262_144
    max_rdf_quads: int = 65_536
    max_retained_rdf_term_bytes: int = 8_388_608

    def __post_init__(self) -> None:
        if self.document_iri is not None and not is_absolute_iri(self.document_iri):
            raise ValueError("the document IRI is not an absolute IRI")
        for name in LIMITS:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")

    def with_(self, **changes) -> ReadOptions:
        return replace(self, **changes)

    def __repr__(self) -> str:
        limits = ", ".join(f"{n}={getattr(self, n)}" for n in LIMITS)
        return f"ReadOptions(document_iri={'<redacted>' if self.document_iri else None}, {limits})"


LIMITS = [
    "max_input_bytes", "max_json_nesting_depth", "max_json_object_members", "max_json_values",
    "max_decoded_member_name_bytes", "max_rdf_quads", "max_retained_rdf_term_bytes",
]
