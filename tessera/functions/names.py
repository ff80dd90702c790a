"""The closed vocabulary of control documents, as plain tables. All of these are fixed values."""

from __future__ import annotations

# Term vocabularies (name, namespace IRI), in order of precedence.
VOCABULARIES = [
    ("S231", "http://data.ashrae.org/S231#"),
    ("S231P", "http://data.ashrae.org/S231P#"),
    ("S231PLegacyHttps", "https://data.ashrae.org/S231P#"),
    ("QudtSchema", "http://qudt.org/schema/qudt#"),
]
GENERATIONS = ["S231", "S231P", "S231PLegacyHttps"]
# Namespaces of unit targets (class of the namespace, IRI, class of a target in it).
UNIT_NAMESPACES = [
    ("QudtUnitVocab", "http://qudt.org/vocab/unit#", "QudtUnitIri"),
    ("QudtQuantityKindVocab", "http://qudt.org/vocab/quantitykind#", "QudtQuantityKindIri"),
]
# Hosts of the known families, and the namespaces a known prefix may stand for.
FAMILY_HOSTS = ["http://data.ashrae.org/", "https://data.ashrae.org/", "http://qudt.org/", "https://qudt.org/"]
EXPECTED_PREFIXES = {
    "S231": ["S231", "S231P", "S231PLegacyHttps"],
    "S231P": ["S231P", "S231PLegacyHttps"],
    "qudt": ["QudtSchema"],
    "unit": ["QudtUnitVocab"],
    "q": ["QudtQuantityKindVocab"],
}
# Class terms with class, detail (block kind or connector type), direction, family and rank.
CLASSES = [
    ("Package", "Package", None, None, 0, 0),
    ("Block", "Block", "Abstract", None, 1, 0),
    ("ElementaryBlock", "Block", "Elementary", None, 1, 1),
    ("CompositeBlock", "Block", "Composite", None, 1, 1),
    ("ExtensionBlock", "Block", "Extension", None, 1, 1),
    ("InputConnector", "Connector", None, True, 2, 0),
    ("OutputConnector", "Connector", None, False, 3, 0),
    ("BooleanInput", "Connector", "Boolean", True, 2, 1),
    ("BooleanOutput", "Connector", "Boolean", False, 3, 1),
    ("IntegerInput", "Connector", "Integer", True, 2, 1),
    ("IntegerOutput", "Connector", "Integer", False, 3, 1),
    ("RealInput", "Connector", "Real", True, 2, 1),
    ("RealOutput", "Connector", "Real", False, 3, 1),
    ("Parameter", "Parameter", None, None, 4, 0),
    ("Constant", "Constant", None, None, 5, 0),
    ("EnumerationType", "EnumerationType", None, None, 6, 0),
    ("DataType", "DataType", None, None, 7, 0),
    ("String", "Text", None, None, 8, 0),
]
# Link terms with the kind of edge each makes.
LINKS = {
    "hasInput": "Input", "hasOutput": "Output", "hasParameter": "Parameter", "hasConstant": "Constant", "hasInstance": "Containment",
    "containsBlock": "Containment", "connectedTo": "Connection", "isConnectedTo": "Connection", "isOfDataType": "DataType",
}
# Literal terms by the payload each takes.
PAYLOADS = {
    "Text": ["hasFmuPath", "label", "description", "documentation", "accessSpecifier", "graphics", "sizeOfDimensions", "translationSoftware", "translationSoftwareVersion", "controlledDevice", "conditionalExpression"],
    "Boolean": ["isFinal", "isArray", "fixed", "generatePointlist"],
    "Unsigned": ["numberDimensions"],
    "Value": ["value", "start", "nominal", "instantiate", "min", "max", "defaultValue"],
    "Unit": ["hasDisplayUnit", "hasUnit", "hasQuantityKind"],
}
UNIT_ROLES = {"hasUnit": "Unit", "hasDisplayUnit": "DisplayUnit", "hasQuantityKind": "QuantityKind"}
# The terms of the unit schema; all others belong to the three generations.
SCHEMA_TERMS = ["hasUnit", "hasQuantityKind"]
# Data types by local name.
DATA_TYPES = {"Real": "Real", "Integer": "Integer", "Boolean": "Boolean", "String": "Text"}
# Fixed value: the text an emitter leaves where it lost a value.
LOST_VALUE = "{ terms: [Array] }"

# Finding codes with severity, in the order that breaks ties.
PROJECTION_CODES = ["CXF-P-000", "CXF-P-001", "CXF-P-002", "CXF-P-003", "CXF-P-004", "CXF-P-005", "CXF-P-006"]
RULES = [
    ("CXF-V-001", "Error"), ("CXF-V-002", "Error"), ("CXF-V-003", "Error"), ("CXF-V-004", "Error"),
    ("CXF-V-005", "Warning"), ("CXF-C-001", "Warning"), ("CXF-C-002", "Warning"), ("CXF-C-003", "Warning"),
]
NOT_CONNECTOR = ["Package", "Block", "Parameter", "Constant", "EnumerationType", "DataType", "Text"]
NO_DATA_TYPE = ["Package", "Block", "EnumerationType", "DataType", "Text"]
NOT_BLOCK = ["Package", "Connector", "Parameter", "Constant", "EnumerationType", "DataType", "Text"]


def term_rows() -> list[tuple]:
    """(namespace, local, role, edge kind, payload, class, detail, direction, family, rank) of every registered term."""
    classes = {c[0]: c[1:] for c in CLASSES}
    payload = {t: p for p, terms in PAYLOADS.items() for t in terms}
    rows = []
    for vocabulary, namespace in VOCABULARIES:
        for term in [*classes, *LINKS, *payload]:
            if (term in SCHEMA_TERMS) == (vocabulary == "QudtSchema"):
                role = "class" if term in classes else "link" if term in LINKS else "literal"
                rows.append((namespace, term, role, LINKS.get(term), payload.get(term), *classes.get(term, (None,) * 5)))
    return rows


TERM_SCHEMA = "t_ns string, t_local string, t_role string, t_edge string, t_payload string, t_class string, t_detail string, t_input boolean, t_family int, t_rank int"
