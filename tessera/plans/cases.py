"""Queries over documents made to fail or to be odd in one way each, and over plain tables for the reports.

Each has the SQL that must give the same rows. What a case must give is written beside it, by the rules of JSON and of the
limits, not taken from the scanner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import projection, quads, reports
from tessera.operators.ingest import MESSAGES, REDACTED, diagnostics, redacted_diagnostics
from tessera.options import ReadOptions
from tessera.plans.corpus import Corpus
from tessera.sources.shared import scratch


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Limits under which each of the cases is at or just over one.
LIMITS = ReadOptions(max_input_bytes=48, max_json_nesting_depth=4, max_json_object_members=3, max_json_values=9, max_decoded_member_name_bytes=12)
#: (document, outcome, offset, line, column), all from zero and in bytes; documents of the parts take turns.
FAILURES = [
    (b"{}", "Success", None, None, None),
    (b"[1,2,3,4,5,6,7,8]", "Success", None, None, None),
    (b"[[[[1]]]]", "Success", None, None, None),
    (b'{"a":0,"b":1,"c":2}', "Success", None, None, None),
    (b'{"abcdefghijkl":0}', "Success", None, None, None),
    (b'"\xc3\xa9\\u00e9\\ud83d\\ude00"', "Success", None, None, None),
    (b'"' + b"x" * 46 + b'"', "Success", None, None, None),
    (b'"' + b"x" * 47 + b'"', "Admission", None, None, None),
    (b'{"\x80":0}', "InvalidUtf8", 2, 0, 2),
    (b"{", "Syntax", 1, 0, 1),
    (b"", "Syntax", 0, 0, 0),
    (b"  \n x", "Syntax", 4, 1, 1),
    (b"[1,]", "Syntax", 3, 0, 3),
    (b'{"a":1,}', "Syntax", 7, 0, 7),
    (b'{"a" 1}', "Syntax", 5, 0, 5),
    (b"1 2", "Syntax", 2, 0, 2),
    (b"[[[[[1]]]]]", "NestingLimit", 4, 0, 4),
    (b'{"a":0,"b":1,"c":2,"d":3}', "ObjectMemberLimit", 19, 0, 19),
    (b"[1,2,3,4,5,6,7,8,9]", "ValueLimit", 17, 0, 17),
    (b'{"abcdefghijklm":0}', "DecodedMemberNameBytesLimit", 1, 0, 1),
    (b'{"a":0,"a":1}', "DuplicateMember", 7, 0, 7),
    (b'{"a":0,\n "\\u0061":1}', "DuplicateMember", 9, 1, 1),
    (b'{"a":{"a":0},"b":{"a":0}}', "Success", None, None, None),
]


def _failing(spark, sf_dir: str) -> Corpus:
    number = F.pmod("p_partkey", F.lit(len(FAILURES))).cast("int")
    content = F.element_at(F.array(*[F.unhex(F.lit(c.hex())) for c, *_ in FAILURES]), number + 1)
    return Corpus(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), content.alias("content")), LIMITS)


def _text(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _failure_rows() -> str:
    rows = []
    for i, (content, outcome, *place) in enumerate(FAILURES):
        stage = None if outcome == "Success" else "Input" if outcome == "Admission" else "Json"
        rows.append("(" + ", ".join(map(_text, (i, outcome, stage, MESSAGES.get(outcome), *place, len(content)))) + ")")
    return f"""
WITH f AS (SELECT * FROM (VALUES {", ".join(rows)}) t(i, outcome, stage, message, err_offset, err_line, err_column, length)),
d AS (SELECT p_partkey AS doc_id, f.* FROM part JOIN f ON i = p_partkey % {len(FAILURES)})"""


def q35_failures(spark, sf_dir):
    """Every kind of refusal, with its message and exact place, at the limits and just over them."""
    return _failing(spark, sf_dir).outcomes.select("doc_id", "outcome", "stage", "message", "err_offset", "err_line", "err_column", "length", "source_retained")


Q35 = f"""{_failure_rows()}
SELECT doc_id, outcome, stage, message, CAST(err_offset AS BIGINT) AS err_offset, CAST(err_line AS BIGINT) AS err_line, CAST(err_column AS BIGINT) AS err_column,
  CAST(length AS BIGINT) AS length, outcome <> 'Admission' AS source_retained FROM d
"""


def q36_expected_failures(spark, sf_dir):
    """The report where some failures are expected by their message, some by another one, and some passes aren't."""
    made = _failing(spark, sf_dir)
    said = F.when(F.col("doc_id") % 2 == 0, MESSAGES["Syntax"]).when(F.col("doc_id") % 3 == 0, MESSAGES["DuplicateMember"])
    expected = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id")).select("doc_id", said.alias("expected_message"))
    counted = ["documents", "passed", "expected_failures", "unexpected_failures", "unexpected_passes", "read_failures", "input_bytes", "max_input_bytes"]
    return reports.corpus_report(made.outcomes, expected.where("expected_message IS NOT NULL")).select(*counted)


Q36 = f"""{_failure_rows()},
e AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '{MESSAGES["Syntax"]}' WHEN doc_id % 3 = 0 THEN '{MESSAGES["DuplicateMember"]}' END AS said FROM d)
SELECT count(*) AS documents, count(*) FILTER (outcome = 'Success' AND said IS NULL) AS passed, count(*) FILTER (outcome <> 'Success' AND coalesce(message = said, false)) AS expected_failures,
  count(*) FILTER (outcome <> 'Success' AND NOT coalesce(message = said, false)) AS unexpected_failures, count(*) FILTER (outcome = 'Success' AND said IS NOT NULL) AS unexpected_passes,
  count(*) FILTER (outcome = 'Admission') AS read_failures, CAST(sum(length) AS BIGINT) AS input_bytes, CAST(max(length) AS BIGINT) AS max_input_bytes FROM e
"""

#: (types of a node, its class, block kind, connection type, conflict) under the plain vocabulary.
TYPES = [
    ('["S231:Block","S231:CompositeBlock"]', "Block", "Composite", None, False),
    ('["S231:CompositeBlock","S231:Block"]', "Block", "Composite", None, False),
    ('["S231:Parameter","S231:Constant"]', "Parameter", None, None, True),
    ('[["S231:RealInput"],{"@id":"S231:InputConnector"}]', "Connector", None, "Real", False),
    ('"S231:Unknown"', "LibraryInstance", None, None, False),
    ('["x:Library","S231:Parameter"]', "Parameter", None, None, False),
    ('[]', "WeakUntyped", None, None, False),
]


def _typed(spark, sf_dir: str) -> Corpus:
    part, name = _table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    kind = F.element_at(F.array(*[F.lit(t) for t, *_ in TYPES]), F.pmod("p_partkey", F.lit(len(TYPES))).cast("int") + 1)
    head = F.lit('{"@context":{"S231":"http://data.ashrae.org/S231#"},"@graph":[{"@id":"n')
    other = F.concat(F.lit('"},{"@id":"n'), F.when(F.col("p_size") % 2 == 0, name).otherwise("other"), F.lit('"}]}'))
    text = F.concat(head, name, F.lit('","@type":'), kind, F.lit(',"S231:isConnectedTo":{"@id":"gone"},"S231:label":"'), F.col("p_name"), other)
    return Corpus(part.select(F.col("p_partkey").alias("doc_id"), text.cast("binary").alias("content")))


def q37_merged_types(spark, sf_dir):
    """Nodes of several types: the class they merge to, or the first of those that don't."""
    return _typed(spark, sf_dir).nodes.where("node = 0").select("doc_id", "class", "block_kind", "conn_type", F.size("type_spellings").cast("long").alias("n_types"))


_TYPE_ROWS = ", ".join("(" + ", ".join(map(_text, (i, c, b, t, x, k.count("S231:") + k.count("x:")))) + ")" for i, (k, c, b, t, x) in enumerate(TYPES)).replace("True", "true").replace("False", "false")
_TYPED = f"WITH t AS (SELECT * FROM (VALUES {_TYPE_ROWS}) t(i, class, block_kind, conn_type, conflict, n_types)), d AS (SELECT p_partkey AS doc_id, p_size, t.* FROM part JOIN t ON i = p_partkey % {len(TYPES)})"
Q37 = f"{_TYPED} SELECT doc_id, class, block_kind, conn_type, CAST(n_types AS BIGINT) AS n_types FROM d"


def q38_projection_findings(spark, sf_dir):
    """Findings of a projection in order: a node's types, emptiness and id, then references that end nowhere."""
    return _typed(spark, sf_dir).projection_findings.select("doc_id", "seq", "code", "node", "context")


Q38 = f"""{_TYPED},
f AS (SELECT doc_id, 1 AS r, 'CXF-P-002' AS code, 0 AS node, CAST(NULL AS VARCHAR) AS context FROM d WHERE conflict UNION ALL SELECT doc_id, 2, 'CXF-P-001', 0, NULL FROM d WHERE n_types = 0
  UNION ALL SELECT doc_id, 3, 'CXF-P-001', 1, NULL FROM d UNION ALL SELECT doc_id, 4, 'CXF-P-006', 1, NULL FROM d WHERE p_size % 2 = 0 UNION ALL SELECT doc_id, 5, 'CXF-P-005', 0, 'gone' FROM d)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INT) AS seq, code, CAST(node AS INT) AS node, context FROM f
"""

_TERMS = 250
_XSD = "http://www.w3.org/2001/XMLSchema#"


def _valued(spark, sf_dir: str) -> Corpus:
    """A subject with its part's brand as often as its size modulo 4 says, and its type once."""
    part, name = _table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    brands = F.array_join(F.array_repeat(F.concat(F.lit('"'), F.col("p_brand"), F.lit('",')), (F.col("p_size") % 4).cast("int")), "")
    text = F.concat(F.lit('{"@id":"https://e.test/'), name, F.lit('","https://e.test/p":['), brands, F.lit('"'), F.col("p_type"), F.lit('"]}'))
    return Corpus(part.select(F.col("p_partkey").alias("doc_id"), text.cast("binary").alias("content")), ReadOptions(document_iri="https://e.test/d", max_retained_rdf_term_bytes=_TERMS))


# Bytes of a quad's terms: subject, predicate, value and its type.
_VALUED = f"""WITH v AS (SELECT p_partkey AS doc_id, p_brand, p_type, p_size % 4 AS k, 15 + len(CAST(p_partkey AS VARCHAR)) + {len("https://e.test/p") + len(_XSD + "string")} AS base FROM part),
b AS (SELECT *, k * (base + strlen(p_brand)) + base + strlen(p_type) AS bytes, k + 1 AS n_quads, 43 + len(CAST(doc_id AS VARCHAR)) + k * (strlen(p_brand) + 3) + strlen(p_type) + 5 AS length FROM v)"""


def q39_term_bytes(spark, sf_dir):
    """The whole report under a budget of term bytes: sums are of what passed, as a document over the budget keeps nothing."""
    made = _valued(spark, sf_dir).composed_outcomes
    return made.groupBy("outcome", "stage", "message").agg(F.count("*").alias("n"), F.sum(F.when(F.col("outcome") == "Success", F.col("retained_rdf_term_bytes"))).alias("bytes"), F.sum(F.when(F.col("outcome") == "Success", F.col("emitted_rdf_quads"))).alias("n_quads"))


Q39 = f"""{_VALUED}, o AS (SELECT *, bytes > {_TERMS} AS over FROM b)
SELECT CASE WHEN over THEN 'RetainedRdfTermBytesLimit' ELSE 'Success' END AS outcome, CASE WHEN over THEN 'JsonLd' END AS stage, CASE WHEN over THEN '{MESSAGES["RetainedRdfTermBytesLimit"]}' END AS message,
  count(*) AS n, CAST(sum(CASE WHEN NOT over THEN bytes END) AS BIGINT) AS bytes, CAST(sum(CASE WHEN NOT over THEN n_quads END) AS BIGINT) AS n_quads FROM o GROUP BY over
"""


def q40_quad_multiset(spark, sf_dir):
    """Quads with how often each occurs."""
    return quads.summary(_valued(spark, sf_dir).quads).select("doc_id", "o", F.col("n").alias("n_times"))


Q40 = f"""{_VALUED}, p AS (SELECT * FROM b WHERE bytes <= {_TERMS}),
a AS (SELECT doc_id, p_type AS o, 1 AS n FROM p UNION ALL SELECT doc_id, p_brand, k FROM p WHERE k > 0)
SELECT doc_id, o, CAST(sum(n) AS BIGINT) AS n_times FROM a GROUP BY doc_id, o
"""


def q41_canonical_quads(spark, sf_dir):
    """Quads of a document in canonical order, repeated ones kept."""
    return quads.canonical(_valued(spark, sf_dir).quads).select("doc_id", "position", "o")


Q41 = f"""{_VALUED}, p AS (SELECT * FROM b WHERE bytes <= {_TERMS}),
a AS (SELECT doc_id, p_type AS o FROM p UNION ALL SELECT doc_id, unnest(list_transform(generate_series(1, k), lambda i: p_brand)) FROM p WHERE k > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INT) AS position, o FROM a
"""


def q42_first_property(spark, sf_dir):
    """The first value of a literal term of each node."""
    text = F.concat(F.lit('{"@context":{"S231":"http://data.ashrae.org/S231#"},"@id":"p","@type":"S231:Parameter","S231:numberDimensions":'), F.col("p_size").cast("string"), F.lit(',"S231:label":"'), F.col("p_name"), F.lit('"}'))
    made = Corpus(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.cast("binary").alias("content")))
    size = projection.first_property(made.projection, "numberDimensions", "Unsigned").select("doc_id", F.col("unsigned").cast("long").alias("size"))
    return size.join(projection.first_property(made.projection, "label", "Text").select("doc_id", F.col("text").alias("label")), "doc_id")


Q42 = "SELECT p_partkey AS doc_id, CAST(p_size AS BIGINT) AS size, p_name AS label FROM part"


def q43_run_stability(spark, sf_dir):
    """For each group of runs, whether a value is the same in all and whether there are as many runs as asked for."""
    lines = _table(spark, sf_dir, "lineitem")
    stable = reports.stability(lines, ["l_orderkey"], "l_linestatus")
    return stable.join(reports.run_check(lines, ["l_orderkey"], "l_linenumber", 4), "l_orderkey")


Q43 = "SELECT l_orderkey, count(DISTINCT l_linestatus) = 1 AS is_stable, count(*) = 4 AND count(DISTINCT l_linenumber) = count(*) AS is_valid FROM lineitem GROUP BY 1"


def q44_derived_runs(spark, sf_dir):
    """A measure worked out for each run, then distributed."""
    lines = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_quantity")
    return reports.derived(lines, ["l_returnflag", "l_linestatus"], "l_orderkey", (F.col("l_quantity") * 100 + F.col("l_linenumber")).cast("long"))


Q44 = """SELECT l_returnflag, l_linestatus, median(CAST(l_quantity * 100 + l_linenumber AS BIGINT)) AS median, min(CAST(l_quantity * 100 + l_linenumber AS BIGINT)) AS minimum,
  max(CAST(l_quantity * 100 + l_linenumber AS BIGINT)) AS maximum FROM lineitem GROUP BY 1, 2"""


def q45_zipped_runs(spark, sf_dir):
    """Cases of all runs side by side, and the numbers that a pattern finds in a log."""
    runs = _table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 7).alias("cases"))
    side = reports.zipped(runs, "s_suppkey", "cases").select(F.col("position").cast("long").alias("position"), F.array_join("values", ",").alias("found"))
    logs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), F.concat(F.lit("run "), F.col("s_suppkey").cast("string"), F.lit(" took "), F.col("s_nationkey").cast("string"), F.lit(" s")).alias("text"))
    found = reports.extracted(logs, "text", "([0-9]+)").select(F.col("position") + 100, F.array_join("found", ",").alias("found"))
    return side.unionAll(found)


Q45 = """
SELECT CAST(0 AS BIGINT) AS position, string_agg(CAST(s_nationkey AS VARCHAR), ',' ORDER BY s_suppkey) AS found FROM supplier
UNION ALL SELECT 1, string_agg(CAST(s_suppkey % 7 AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier
UNION ALL SELECT s_suppkey + 100, s_suppkey || ',' || s_nationkey FROM supplier
"""


def q46_checksums(spark, sf_dir):
    """Texts held against a list of digests that lacks some, has some too many, and has some wrong."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")
    digest = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    listed = docs.where("doc_id % 7 <> 0").select(F.when(F.col("doc_id") % 11 == 0, F.concat("path", F.lit("-gone"))).otherwise(F.col("path")).alias("path"), digest.alias("sha256"))
    return reports.checksum_problems(docs.select("path", "content"), listed)


Q46 = """
WITH l AS (SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id || '-gone' ELSE CAST(doc_id AS VARCHAR) END AS path, CASE WHEN doc_id % 5 = 0 THEN sha256('other') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 7 <> 0),
d AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha FROM documents)
SELECT coalesce(d.path, l.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'unlisted' ELSE 'mismatch' END AS problem
FROM d FULL JOIN l ON l.path = d.path WHERE d.path IS NULL OR l.path IS NULL OR d.sha <> l.sha
"""


def q47_closure(spark, sf_dir):
    """All that can be reached from some parts over links to the half and the third of a key, with the fewest steps."""
    part = _table(spark, sf_dir, "part").select("p_partkey")
    links = part.select(F.col("p_partkey").alias("child"), F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3))).alias("parent")).where("parent > 0")
    return reports.closure(links, part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("node")))


Q47 = """
WITH RECURSIVE r(node, steps) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 100 = 0
  UNION SELECT unnest([node // 2, node // 3]), steps + 1 FROM r WHERE node > 1)
SELECT CAST(node AS BIGINT) AS node, CAST(min(steps) AS BIGINT) AS steps FROM r WHERE node > 0 OR steps = 0 GROUP BY node
"""


# Fixed values: (document, message, offset, line, column) of what is wrong with a document, without limits.
DESCRIBED = [
    (b'[[[[[[1]]]]],{"a":[1,2.50e3,-0]}]', None, None, None, None),
    (b'{"\x80":0}', "invalid UTF-8 at byte offset 2", 2, 0, 2),
    (b"", "expected a JSON value", 0, 0, 0),
    (b"[1,]", "expected a JSON value", 3, 0, 3),
    (b"[1 2]", "expected ',' or ']'", 3, 0, 3),
    (b"[1.5.2]", "expected ',' or ']'", 4, 0, 4),
    (b'{"a":1 "b":2}', "expected ',' or '}'", 7, 0, 7),
    (b'{"a":1,}', "expected an object member name", 7, 0, 7),
    (b'{"a"\n 1}', "expected ':'", 6, 1, 1),
    (b"{}\n\n{}", "trailing characters", 4, 2, 0),
    (b"1.5.2", "trailing characters", 3, 0, 3),
    (b"[tru]", "invalid JSON literal", 1, 0, 1),
    (b"[01]", "leading zero in number", 2, 0, 2),
    (b"[-]", "expected a digit", 2, 0, 2),
    (b"[1.]", "expected a digit after decimal point", 3, 0, 3),
    (b"[1e+]", "expected an exponent digit", 4, 0, 4),
    (b'["a', "unterminated string", 3, 0, 3),
    (b'["\\x"]', "invalid string escape", 3, 0, 3),
    (b'["\\u00g0"]', "invalid Unicode escape", 6, 0, 6),
    (b'["a\tb"]', "control character in string", 3, 0, 3),
    (b'{"x":0,"\\u0078":1}', 'duplicate object member "x"', 7, 0, 7),
]


def _described(spark, sf_dir: str) -> DataFrame:
    number = F.pmod("p_partkey", F.lit(len(DESCRIBED))).cast("int")
    content = F.element_at(F.array(*[F.unhex(F.lit(c.hex())) for c, *_ in DESCRIBED]), number + 1)
    return diagnostics(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), content.alias("content")))


def _quote(x: object) -> str:
    return _text(x.replace("'", "''") if isinstance(x, str) else x)


_DESCRIBED = f"""WITH f AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_quote, (i, *told))) + ")" for i, (_, *told) in enumerate(DESCRIBED))}) t(i, message, err_offset, err_line, err_column)),
d AS (SELECT p_partkey AS doc_id, message, CAST(err_offset AS BIGINT) AS err_offset, CAST(err_line AS BIGINT) AS err_line, CAST(err_column AS BIGINT) AS err_column FROM part JOIN f ON i = p_partkey % {len(DESCRIBED)} WHERE message IS NOT NULL)"""


def q48_descriptions(spark, sf_dir):
    """What is wrong with each document, in words, and where."""
    return _described(spark, sf_dir).select("doc_id", "message", "err_offset", "err_line", "err_column")


Q48 = f"{_DESCRIBED} SELECT * FROM d"


def q49_redacted_descriptions(spark, sf_dir):
    """The same, where every third document belongs to others."""
    return redacted_diagnostics(_described(spark, sf_dir), F.col("doc_id") % 3 == 0).select("doc_id", "message", "err_offset", "err_line", "err_column")


Q49 = f"""{_DESCRIBED} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{REDACTED}' ELSE message END AS message, CASE WHEN doc_id % 3 <> 0 THEN err_offset END AS err_offset,
  CASE WHEN doc_id % 3 <> 0 THEN err_line END AS err_line, CASE WHEN doc_id % 3 <> 0 THEN err_column END AS err_column FROM d"""


def q50_optional_sums(spark, sf_dir):
    """Sums of times that some groups of runs haven't taken."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).cast("long").alias("scan"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).cast("long").alias("json_ld"))
    return reports.optional_sums(lines, ["l_orderkey"], ["scan", "json_ld"])


Q50 = """SELECT l_orderkey, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS BIGINT) AS scan, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS BIGINT) AS json_ld FROM lineitem GROUP BY 1"""


def q51_report_file(spark, sf_dir):
    """The report of expected failures, written as JSON and read again."""
    report, path = q36_expected_failures(spark, sf_dir), scratch(spark, "report")
    reports.write_json(report, path)
    return reports.read_json(spark, path, report.schema)


Q51 = Q36
