"""Queries over the documents of the workload, each with the SQL over the tables that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import projection, quads, reports
from tessera.options import ReadOptions
from tessera.plans import cases, workload
from tessera.plans.corpus import Corpus
from tessera.sources.documents import from_text, stress_documents
from tessera.sources.shared import small_batches

_KEPT: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The workload's corpus; one is kept for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = Corpus(workload.documents(spark, sf_dir))
    return _KEPT[key]


def forget() -> None:
    """Drop what is kept, so that the next query begins from the tables."""
    _KEPT.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_document(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias(name))


# What the tables say of the documents: d (documents), o (orders) and l (lines), in the order of their nodes.
_BASE_SQL = """
WITH d AS (SELECT c_custkey AS doc_id, c_mktsegment AS seg, (c_mktsegment <> 'FURNITURE') AS known FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
o AS (SELECT d.doc_id, d.seg, d.known, o_orderkey, o_orderstatus,
        lead(o_orderkey) OVER (PARTITION BY d.doc_id ORDER BY o_orderkey, o_orderstatus) AS following,
        lead(o_orderstatus) OVER (PARTITION BY d.doc_id ORDER BY o_orderkey, o_orderstatus) AS following_status,
        row_number() OVER (PARTITION BY d.doc_id ORDER BY o_orderkey, o_orderstatus) AS node FROM d JOIN orders ON o_custkey = d.doc_id),
n AS (SELECT doc_id, count(*) AS n_orders FROM o GROUP BY doc_id),
l AS (SELECT d.doc_id, d.seg, d.known, lineitem.*, CAST(round(l_discount * 100) AS INT) AS disc,
        n.n_orders + row_number() OVER (PARTITION BY d.doc_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS node,
        row_number() OVER (PARTITION BY d.doc_id, l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS copy
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN d ON d.doc_id = o_custkey JOIN n ON n.doc_id = d.doc_id),
c AS (SELECT d.*, n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(n_values, 0) AS n_values, coalesce(n_typed, 0) AS n_typed FROM d JOIN n USING (doc_id) LEFT JOIN
        (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (disc <> 0) AS n_values, count(*) FILTER (l_returnflag <> 'R') AS n_typed FROM l GROUP BY doc_id) USING (doc_id))
"""


def q01_corpus_report(spark, sf_dir):
    return reports.corpus_report(corpus(spark, sf_dir).outcomes).drop("input_bytes", "max_input_bytes", "quad_count", "rdf_term_bytes")


# Values of a document: root, context and its strings, graph, the customer (object, id, type, two lists and their
# references with ids), orders (object, id, type, reference, its id), lines (object, id, dimensions, final, unit, its id, note, type, value).
_STRUCTURE = """
s AS (SELECT doc_id, seg, n_orders, n_lines, n_values, n_typed,
        3 + 4 + (CASE WHEN seg = 'MACHINERY' THEN 1 ELSE 0 END) + 5 + 2 * n_orders + 2 * n_lines + 5 * n_orders + 7 * n_lines + n_typed + n_values AS total_values,
        5 AS max_nesting_depth,
        greatest(5 + (CASE WHEN seg = 'MACHINERY' THEN 1 ELSE 0 END) - 1, 4, coalesce((SELECT max(5 + (CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) + (CASE WHEN disc <> 0 THEN 1 ELSE 0 END)) FROM l WHERE l.doc_id = c.doc_id), 0)) AS max_object_members,
        8 + 6 + 4 + 2 + 4 + 4 + (CASE WHEN seg = 'MACHINERY' THEN 3 ELSE 0 END) + 3 + 5 + 16 + 17 + 3 * n_orders + 3 * n_lines
          + n_orders * (3 + 5 + 18 + 3) + n_lines * (3 + 21 + 12 + 12 + 3 + 7) + 5 * n_typed + 10 * n_values AS decoded_member_name_bytes FROM c)
"""

Q01 = f"""{_BASE_SQL}, {_STRUCTURE}
SELECT count(*) AS documents, count(*) AS passed, CAST(0 AS BIGINT) AS expected_failures, CAST(0 AS BIGINT) AS unexpected_failures, CAST(0 AS BIGINT) AS unexpected_passes, CAST(0 AS BIGINT) AS read_failures,
  CAST(max(max_nesting_depth) AS BIGINT) AS max_nesting_depth, CAST(max(max_object_members) AS BIGINT) AS max_object_members, CAST(sum(total_values) AS BIGINT) AS total_json_values,
  CAST(sum(decoded_member_name_bytes) AS BIGINT) AS decoded_member_name_bytes, true AS is_complete FROM s
"""


def q02_outcomes_by_limit(spark, sf_dir):
    options = ReadOptions().with_(max_json_values=300)
    made = Corpus(workload.documents(spark, sf_dir), options)
    return made.outcomes.groupBy("outcome", "stage", "message").agg(F.count("*").alias("n"), F.count("total_values").alias("n_measured"))


Q02 = f"""{_BASE_SQL}, {_STRUCTURE}
SELECT CASE WHEN total_values > 300 THEN 'ValueLimit' ELSE 'Success' END AS outcome, CASE WHEN total_values > 300 THEN 'Json' END AS stage,
  CASE WHEN total_values > 300 THEN 'JSON values exceed the configured limit' END AS message, count(*) AS n, count(*) FILTER (total_values <= 300) AS n_measured FROM s GROUP BY ALL
"""


def q03_json_structure(spark, sf_dir):
    return reports.structure_metrics(corpus(spark, sf_dir).json_values)


Q03 = f"""{_BASE_SQL}, {_STRUCTURE}
SELECT doc_id, CAST(max_nesting_depth AS BIGINT) AS max_nesting_depth, CAST(total_values AS BIGINT) AS total_values, CAST(decoded_member_name_bytes AS BIGINT) AS decoded_member_name_bytes, CAST(max_object_members AS BIGINT) AS max_object_members FROM s
"""


def q04_namespace_policy(spark, sf_dir):
    found = corpus(spark, sf_dir).validation_findings
    return found.where(F.col("code").startswith("CXF-C")).select("doc_id", "code", "severity")


Q04 = f"""{_BASE_SQL}
SELECT doc_id, CASE seg WHEN 'AUTOMOBILE' THEN 'CXF-C-001' WHEN 'FURNITURE' THEN 'CXF-C-003' ELSE 'CXF-C-002' END AS code, 'Warning' AS severity FROM d WHERE seg IN ('AUTOMOBILE', 'FURNITURE', 'MACHINERY')
"""


def q05_nodes_by_class(spark, sf_dir):
    return corpus(spark, sf_dir).nodes.groupBy("class", "block_kind", "is_input", "conn_type").agg(F.count("*").alias("n"))


Q05 = f"""{_BASE_SQL},
k AS (SELECT CASE WHEN known THEN 'Block' ELSE 'LibraryInstance' END AS class, CASE WHEN known THEN 'Composite' END AS block_kind, CAST(NULL AS BOOLEAN) AS is_input, CAST(NULL AS VARCHAR) AS conn_type FROM d
  UNION ALL SELECT CASE WHEN known THEN 'Connector' ELSE 'LibraryInstance' END, NULL, CASE WHEN known THEN o_orderstatus <> 'F' END, CASE WHEN known THEN CASE o_orderstatus WHEN 'P' THEN 'Integer' ELSE 'Real' END END FROM o
  UNION ALL SELECT CASE l_returnflag WHEN 'R' THEN 'WeakUntyped' WHEN 'A' THEN CASE WHEN known THEN 'Parameter' ELSE 'LibraryInstance' END ELSE CASE WHEN known THEN 'Constant' ELSE 'LibraryInstance' END END, NULL, NULL, NULL FROM l)
SELECT class, block_kind, is_input, conn_type, count(*) AS n FROM k GROUP BY ALL
"""


def q06_duplicate_ids(spark, sf_dir):
    return per_document(corpus(spark, sf_dir).projection_findings.where("code = 'CXF-P-006'"), "n_duplicates")


Q06 = f"{_BASE_SQL} SELECT doc_id, count(*) AS n_duplicates FROM l WHERE copy > 1 GROUP BY doc_id"


def q07_edges(spark, sf_dir):
    return corpus(spark, sf_dir).edges.groupBy("doc_id", "kind").agg(F.count("*").alias("n_edges"), F.count("target").alias("n_resolved"), F.sum("target").cast("long").alias("target_sum"))


Q07 = f"""{_BASE_SQL},
e AS (SELECT doc_id, 'Containment' AS kind, node AS target FROM o WHERE known UNION ALL SELECT doc_id, 'Connection', CASE WHEN following IS NOT NULL THEN node + 1 END FROM o WHERE known
  UNION ALL SELECT l.doc_id, 'Parameter', f.node FROM l JOIN l f ON f.doc_id = l.doc_id AND f.l_orderkey = l.l_orderkey AND f.l_linenumber = l.l_linenumber AND f.copy = 1 WHERE l.known)
SELECT doc_id, kind, count(*) AS n_edges, count(target) AS n_resolved, CAST(sum(target) AS BIGINT) AS target_sum FROM e GROUP BY ALL
"""


def q08_unresolved(spark, sf_dir):
    return corpus(spark, sf_dir).projection_findings.where("code = 'CXF-P-005'").select("doc_id", "node", F.col("context").alias("target_spelling"))


Q08 = f"{_BASE_SQL} SELECT doc_id, CAST(node AS INT) AS node, 'o:' || (o_orderkey + 1) AS target_spelling FROM o WHERE known AND following IS NULL"


def q09_properties(spark, sf_dir):
    return corpus(spark, sf_dir).properties.groupBy("doc_id", "payload_kind", "value_kind").agg(F.count("*").alias("n"), F.count_if("flag").alias("n_true"))


Q09 = f"""{_BASE_SQL},
p AS (SELECT doc_id, 'Value' AS payload_kind, 'Literal' AS value_kind, false AS flag FROM l WHERE known AND disc <> 0
  UNION ALL SELECT doc_id, 'Unsigned', NULL, false FROM l WHERE known UNION ALL SELECT doc_id, 'Boolean', NULL, l_linenumber % 2 = 0 FROM l WHERE known UNION ALL SELECT doc_id, 'Unit', NULL, false FROM l)
SELECT doc_id, payload_kind, value_kind, count(*) AS n, count(*) FILTER (flag) AS n_true FROM p GROUP BY ALL
"""


def q10_unsigned(spark, sf_dir):
    return corpus(spark, sf_dir).properties.where("payload_kind = 'Unsigned'").groupBy("doc_id").agg(F.sum("unsigned").cast("long").alias("total"), F.max("unsigned").cast("long").alias("most"))


Q10 = f"{_BASE_SQL} SELECT doc_id, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(max(l_linenumber) AS BIGINT) AS most FROM l WHERE known GROUP BY doc_id"


def q11_units(spark, sf_dir):
    return corpus(spark, sf_dir).properties.where("payload_kind = 'Unit'").groupBy("unit_role", "unit_target_class", F.col("text").alias("spelling")).agg(F.count("*").alias("n"))


Q11 = f"""{_BASE_SQL}
SELECT 'Unit' AS unit_role, CASE WHEN l_linestatus = 'O' THEN 'QudtUnitIri' WHEN known THEN 'S231Fallback' ELSE 'Other' END AS unit_target_class, CASE WHEN l_linestatus = 'O' THEN 'unit:PA' ELSE 'S231:raw' END AS spelling, count(*) AS n FROM l GROUP BY ALL
"""


def q12_extensions(spark, sf_dir):
    return corpus(spark, sf_dir).extensions.groupBy("predicate", "kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


Q12 = f"""{_BASE_SQL},
x AS (SELECT doc_id, 'ex:note' AS predicate, 'string' AS kind FROM l
  UNION ALL SELECT doc_id, unnest(['S231:hasInstance', 'S231:hasParameter']), 'array' FROM d WHERE NOT known UNION ALL SELECT doc_id, 'S231:isConnectedTo', 'object' FROM o WHERE NOT known
  UNION ALL SELECT doc_id, 'S231:numberDimensions', 'number' FROM l WHERE NOT known UNION ALL SELECT doc_id, 'S231:isFinal', 'boolean' FROM l WHERE NOT known
  UNION ALL SELECT doc_id, 'S231:value', CASE disc WHEN 5 THEN 'string' ELSE 'number' END FROM l WHERE NOT known AND disc <> 0)
SELECT predicate, kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM x GROUP BY ALL
"""


def q13_lost_values(spark, sf_dir):
    return corpus(spark, sf_dir).projection_findings.where("code = 'CXF-P-003'").select("doc_id", "node")


Q13 = f"{_BASE_SQL} SELECT doc_id, CAST(node AS INT) AS node FROM l WHERE known AND disc = 5"


def _rule(code: str) -> Callable:
    def run(spark, sf_dir):
        return corpus(spark, sf_dir).validation_findings.where(F.col("code") == code).select("doc_id", "node", "severity")

    return run


# Findings of the rules. A parameter's edge ends at the first of equal ids; a customer is a block, so no rule on it fires.
_RULES = """
v2 AS (SELECT doc_id, CAST(node AS INT) AS node, 'Error' AS severity FROM o WHERE known AND following IS NOT NULL AND (o_orderstatus = 'P') <> (following_status = 'P')),
v5 AS (SELECT doc_id, CAST(node AS INT) AS node, 'Warning' AS severity FROM l WHERE known AND disc = 0 AND l_returnflag <> 'R')
"""


def q14_connection_types(spark, sf_dir):
    return _rule("CXF-V-002")(spark, sf_dir)


def q15_absent_values(spark, sf_dir):
    return _rule("CXF-V-005")(spark, sf_dir)


Q14, Q15 = (f"{_BASE_SQL}, {_RULES} SELECT * FROM {v}" for v in ("v2", "v5"))


def _broken(spark, sf_dir) -> Corpus:
    """Documents that break the other rules: for each part a parameter joined to a block, typed and grouped where it can't be."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    name = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_size") % 3 == 0, "Parameter").when(F.col("p_size") % 3 == 1, "Text").otherwise("CompositeBlock")
    kind = F.when(kind == "Text", "String").otherwise(kind)
    text = F.concat(
        F.lit('{"@context":{"S231":"http://data.ashrae.org/S231#"},"@graph":[{"@id":"a:'), name, F.lit('","@type":"S231:'), kind, F.lit('","S231:value":1,"S231:connectedTo":{"@id":"b:'), name,
        F.lit('"},"S231:isOfDataType":{"@id":"S231:Real"},"S231:hasInput":[{"@id":"b:'), name, F.lit('"}]},{"@id":"b:'), name, F.lit('","@type":"S231:RealInput"}]}'),
    )
    return Corpus(part.select(F.col("p_partkey").alias("doc_id"), text.cast("binary").alias("content")))


def q16_broken_rules(spark, sf_dir):
    return _broken(spark, sf_dir).validation_findings.select("doc_id", "seq", "code", "severity", "node")


Q16 = """
WITH k AS (SELECT p_partkey AS doc_id, p_size % 3 AS k FROM part),
f AS (SELECT doc_id, 1 AS r, 'CXF-V-001' AS code FROM k UNION ALL SELECT doc_id, 2, 'CXF-V-003' FROM k WHERE k <> 0 UNION ALL SELECT doc_id, 3, 'CXF-V-004' FROM k WHERE k <> 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INT) AS seq, code, 'Error' AS severity, CAST(0 AS INT) AS node FROM f
"""


def q19_findings_ordered(spark, sf_dir):
    return corpus(spark, sf_dir).validation_findings.select("doc_id", "seq", "code", "node")


Q19 = f"""{_BASE_SQL}, {_RULES},
f AS (SELECT doc_id, -1 AS node, CASE seg WHEN 'AUTOMOBILE' THEN 'CXF-C-001' WHEN 'FURNITURE' THEN 'CXF-C-003' ELSE 'CXF-C-002' END AS code FROM d WHERE seg IN ('AUTOMOBILE', 'FURNITURE', 'MACHINERY')
  UNION ALL SELECT doc_id, node, 'CXF-V-002' FROM v2 UNION ALL SELECT doc_id, node, 'CXF-V-005' FROM v5)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY node) - 1 AS INT) AS seq, code, CAST(nullif(node, -1) AS INT) AS node FROM f
"""


def q20_projection_metrics(spark, sf_dir):
    return corpus(spark, sf_dir).metrics


Q20 = f"""{_BASE_SQL},
w AS (SELECT doc_id, count(*) FILTER (l_returnflag = 'R') AS weak, count(*) FILTER (copy > 1) AS copies, count(*) FILTER (disc = 5) AS lost FROM l GROUP BY doc_id)
SELECT c.doc_id, 1 + n_orders + n_lines AS nodes, CASE WHEN known THEN 2 * n_orders + n_lines ELSE 0 END AS edges, CASE WHEN known THEN 2 * n_orders - 1 + n_lines ELSE 0 END AS resolved_edges,
  CASE WHEN known THEN 1 + (CASE WHEN n_lines > 0 THEN 1 ELSE 0 END) + n_orders + n_values + 3 * n_lines ELSE n_lines END AS recognized_members, CASE WHEN known THEN n_lines ELSE n_lines + 2 + n_orders + 2 * n_lines + n_values END AS extension_members,
  coalesce(weak, 0) + coalesce(copies, 0) + (CASE WHEN known THEN coalesce(lost, 0) + 1 ELSE 0 END) AS diagnostics FROM c LEFT JOIN w ON w.doc_id = c.doc_id
"""


def q21_quad_counts(spark, sf_dir):
    return corpus(spark, sf_dir).composed_outcomes.select("doc_id", "outcome", "emitted_rdf_quads")


Q21 = f"{_BASE_SQL} SELECT doc_id, 'Success' AS outcome, CAST(1 + 2 * n_orders + 2 * n_orders - n_orders + n_lines + 4 * n_lines + n_typed + n_values AS BIGINT) AS emitted_rdf_quads FROM c"


def q22_budget_cut(spark, sf_dir):
    return quads.budget_cut(corpus(spark, sf_dir).quads, 200, 1 << 40).select("doc_id", "outcome", "emitted")


Q22 = f"{_BASE_SQL} SELECT doc_id, 'RdfQuadLimit' AS outcome, CAST(201 AS BIGINT) AS emitted FROM c WHERE 1 + 3 * n_orders + 5 * n_lines + n_typed + n_values > 200"


def q23_degrees(spark, sf_dir):
    near = projection.adjacency(corpus(spark, sf_dir).projection)
    return near.groupBy("doc_id").agg(F.sum(F.size("outbound")).cast("long").alias("n_out"), F.sum(F.size("inbound")).cast("long").alias("n_in"), F.max(F.size("inbound")).cast("long").alias("most_in"))


Q23 = f"""{_BASE_SQL},
i AS (SELECT doc_id, node, 1 + (CASE WHEN node > 1 THEN 1 ELSE 0 END) AS n FROM o WHERE known UNION ALL SELECT doc_id, 0, count(*) FROM l WHERE known GROUP BY doc_id, l_orderkey, l_linenumber),
x AS (SELECT doc_id, max(n) AS most FROM i GROUP BY doc_id)
SELECT c.doc_id, CAST(CASE WHEN known THEN 2 * n_orders + n_lines ELSE 0 END AS BIGINT) AS n_out, CAST(CASE WHEN known THEN 2 * n_orders - 1 + n_lines ELSE 0 END AS BIGINT) AS n_in, CAST(coalesce(most, 0) AS BIGINT) AS most_in FROM c LEFT JOIN x USING (doc_id)
"""


def q24_identifier_forms(spark, sf_dir):
    return corpus(spark, sf_dir).nodes.groupBy("id_form", "id_container", "id_steps").agg(F.count("*").alias("n")).select("id_form", "id_container", F.array_join("id_steps", "/").alias("steps"), "n")


Q24 = f"""{_BASE_SQL},
i AS (SELECT CASE WHEN seg = 'BUILDING' THEN 'Customer' || doc_id END AS container FROM d UNION ALL SELECT NULL FROM o UNION ALL SELECT NULL FROM l)
SELECT CASE WHEN container IS NULL THEN 'Other' ELSE 'SpecInstance' END AS id_form, container AS id_container, CASE WHEN container IS NOT NULL THEN 'main/block' END AS steps, count(*) AS n FROM i GROUP BY ALL
"""


def q25_run_distribution(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("workload"), F.col("l_quantity").cast("long").alias("value"))
    return reports.distribution(runs, ["workload"])


Q25 = "SELECT l_returnflag AS workload, median(CAST(l_quantity AS BIGINT)) AS median, min(CAST(l_quantity AS BIGINT)) AS minimum, max(CAST(l_quantity AS BIGINT)) AS maximum FROM lineitem GROUP BY 1"


def q26_event_structure(spark, sf_dir):
    made = Corpus(from_text(table(spark, sf_dir, "events"), "event_id", "props"))
    return made.outcomes.select("doc_id", "outcome", "max_nesting_depth", "max_object_members", "total_values", "decoded_member_name_bytes")


Q26 = """
SELECT event_id AS doc_id, 'Success' AS outcome, CAST(1 AS BIGINT) AS max_nesting_depth, CAST(len(json_keys(props)) AS BIGINT) AS max_object_members,
  CAST((SELECT count(*) FROM json_tree(props)) AS BIGINT) AS total_values, CAST(list_sum(list_transform(json_keys(props), lambda x: strlen(x))) AS BIGINT) AS decoded_member_name_bytes FROM events
"""


def q27_text_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").cast("binary").alias("content"))
    return docs.groupBy("source").agg(F.count_if(reports.is_binary(F.col("content"))).alias("n_binary"), F.count_if(F.is_valid_utf8(F.col("content").cast("string"))).alias("n_valid"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


Q27 = "SELECT source, CAST(count(*) FILTER (contains(substr(text, 1, 8192), chr(0))) AS BIGINT) AS n_binary, count(*) AS n_valid, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY source"


def q28_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


Q28 = "SELECT doc_id, sha256(text) AS sha256 FROM documents"


# Each text with a line after it that holds a secret of one kind, or something just short of one. Spark and DuckDB read it alike.
_HASH = "md5(CAST(doc_id AS VARCHAR(20)))"
_SEEDED = f"""concat(text, chr(10), CASE doc_id % 8 WHEN 0 THEN concat('AKIA', upper(substr({_HASH}, 1, 16)), ' ASIA', upper(substr({_HASH}, 3, 16)))
  WHEN 1 THEN concat('ASIA', upper(substr({_HASH}, 1, 16)), 'X') WHEN 2 THEN concat('ghp_', {_HASH}, {_HASH}, chr(10), 'gho_', {_HASH}, 'abcdef') WHEN 3 THEN concat('github_pat_', {_HASH})
  WHEN 4 THEN concat('xoxb-', {_HASH}, ' xoxs-123') WHEN 5 THEN concat('Password : "', {_HASH}, '"', chr(10), 'api-key', chr(10), '=', {_HASH}, ' client_secret=', {_HASH})
  WHEN 6 THEN '-----BEGIN RSA PRIVATE KEY-----' ELSE concat('xghp_', {_HASH}, {_HASH}, ' passwd=short') END)"""


def _seeded(spark, sf_dir) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_SEEDED).alias("text"))


def q29_secrets(spark, sf_dir):
    return reports.secrets(_seeded(spark, sf_dir), most=None).select("doc_id", "kind", "line")


# The same patterns without looking around: a key is a whole run of its letters, a token may take the character before it.
_RUN = "[A-Z0-9]+"
_KEY = "(AKIA|ASIA)[A-Z0-9]{16}"
_TOKEN = "(^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,255}"
_PLAIN = {
    "private-key-header": "-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "github-fine-grained-token": "github_pat_[A-Za-z0-9_]{20,255}",
    "slack-token": "xox[baprs]-[A-Za-z0-9-]{10,}",
    "assigned-secret": "(?i)(api[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token|password|passwd)[\\x09-\\x0D ]*[:=][\\x09-\\x0D ]*[''\"]?[A-Za-z0-9_./+=-]{8,}",
}
_MARK = "chr(1) || chr(2)"


def _secrets_sql() -> str:
    """Matches and what lies between them, for each pattern; a match's line follows from the line ends before it."""
    parts = [
        f"SELECT doc_id, '{name}' AS kind, regexp_extract_all(text, '{pattern}') AS m, string_split(regexp_replace(text, '{pattern}', {_MARK}, 'g'), {_MARK}) AS s FROM docs"
        for name, pattern in [("aws-access-key", _RUN), ("github-token", _TOKEN), *_PLAIN.items()]
    ]
    ends = "coalesce(list_sum(list_transform({}, lambda x: len(x) - len(replace(x, chr(10), '')))), 0)"
    return f"""
WITH docs AS (SELECT doc_id, {_SEEDED} AS text FROM documents),
h AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, kind, m, s, unnest(generate_series(1, len(m))) AS i FROM h WHERE len(m) > 0)
SELECT doc_id, kind, CAST(1 + {ends.format("s[1:i]")} + {ends.format("m[1:i-1]")} + (CASE WHEN starts_with(m[i], chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS line
FROM e WHERE kind <> 'aws-access-key' OR regexp_full_match(m[i], '{_KEY}')
"""


Q29 = _secrets_sql()


def q30_redacted_texts(spark, sf_dir):
    docs = _seeded(spark, sf_dir)
    return docs.select("doc_id", F.sha2(reports.redacted(F.col("text")).cast("binary"), 256).alias("sha256"))


def _redacted_sql() -> str:
    def plain(text: str, name: str) -> str:
        return f"regexp_replace({text}, '{_PLAIN[name]}', '[REDACTED:{name}]', 'g')"

    token = f"regexp_replace(t, '{_TOKEN}', '\\1[REDACTED:github-token]', 'g')"
    rest = plain(plain(plain(token, "github-fine-grained-token"), "slack-token"), "assigned-secret")
    key = f"CASE WHEN regexp_full_match(m[i], '{_KEY}') THEN '[REDACTED:aws-access-key]' ELSE m[i] END"
    return f"""
WITH docs AS (SELECT doc_id, {_SEEDED} AS text FROM documents),
a AS (SELECT doc_id, {plain("text", "private-key-header")} AS t FROM docs),
r AS (SELECT doc_id, t, regexp_extract_all(t, '{_RUN}') AS m, string_split(regexp_replace(t, '{_RUN}', {_MARK}, 'g'), {_MARK}) AS s FROM a),
k AS (SELECT doc_id, array_to_string(list_transform(generate_series(1, len(m)), lambda i: s[i] || {key}), '') || s[len(m) + 1] AS t FROM r)
SELECT doc_id, sha256({rest}) AS sha256 FROM k
"""


Q30 = _redacted_sql()


def q31_pointer_and_source(spark, sf_dir):
    made = corpus(spark, sf_dir)
    found = reports.pointer(made.json_values, "/@graph/0/S231:hasInstance/0/@id")
    return made.source_text(found.select("doc_id", "tok_start", "tok_end")).select("doc_id", "source")


Q31 = f"""{_BASE_SQL} SELECT doc_id, '"o:' || o_orderkey || '"' AS source FROM o WHERE node = 1"""


def q32_quad_predicates(spark, sf_dir):
    found = corpus(spark, sf_dir).quads
    return found.groupBy("p", "o_kind", "o_datatype").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_subjects"))


Q32 = f"""{_BASE_SQL},
ns AS (SELECT doc_id, CASE seg WHEN 'AUTOMOBILE' THEN 'https://data.ashrae.org/S231P#' WHEN 'BUILDING' THEN 'http://data.ashrae.org/S231P#' WHEN 'FURNITURE' THEN 'https://example.test/other#' ELSE 'http://data.ashrae.org/S231#' END AS ns FROM d),
cs AS (SELECT doc_id, CASE WHEN seg = 'BUILDING' THEN 'b' || doc_id ELSE 'c:' || doc_id END AS s FROM d),
rdf AS (SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS t, 'http://www.w3.org/2001/XMLSchema#' AS x),
q AS (SELECT t AS p, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype, s FROM cs, rdf UNION ALL SELECT t, 'iri', NULL, 'o:' || o_orderkey FROM o, rdf UNION ALL SELECT t, 'iri', NULL, 'l:' || l_orderkey || '.' || l_linenumber FROM l, rdf WHERE l_returnflag <> 'R'
  UNION ALL SELECT ns || 'hasInstance', 'iri', NULL, s FROM o JOIN ns USING (doc_id) JOIN cs USING (doc_id) UNION ALL SELECT ns || 'isConnectedTo', 'iri', NULL, 'o:' || o_orderkey FROM o JOIN ns USING (doc_id)
  UNION ALL SELECT ns || 'hasParameter', 'iri', NULL, s FROM l JOIN ns USING (doc_id) JOIN cs USING (doc_id)
  UNION ALL SELECT ns || 'value', 'literal', x || CASE disc WHEN 5 THEN 'string' ELSE 'integer' END, 'l:' || l_orderkey || '.' || l_linenumber FROM rdf, l JOIN ns USING (doc_id) WHERE disc <> 0
  UNION ALL SELECT ns || 'numberDimensions', 'literal', x || 'integer', 'l:' || l_orderkey || '.' || l_linenumber FROM rdf, l JOIN ns USING (doc_id)
  UNION ALL SELECT ns || 'isFinal', 'literal', x || 'boolean', 'l:' || l_orderkey || '.' || l_linenumber FROM rdf, l JOIN ns USING (doc_id)
  UNION ALL SELECT 'http://qudt.org/schema/qudt#hasUnit', 'iri', NULL, 'l:' || l_orderkey || '.' || l_linenumber FROM l
  UNION ALL SELECT 'https://example.test/note', 'literal', x || 'string', 'l:' || l_orderkey || '.' || l_linenumber FROM l, rdf)
SELECT p, o_kind, o_datatype, count(*) AS n, count(DISTINCT s) AS n_subjects FROM q GROUP BY ALL
"""


def q33_composed(spark, sf_dir):
    """Under a budget of quads: outcomes, and the nodes of the documents that pass; those that fail have none."""
    made = Corpus(workload.documents(spark, sf_dir), ReadOptions().with_(max_rdf_quads=200))
    nodes = made.composed_nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    return made.composed_outcomes.join(nodes, "doc_id", "left").groupBy("outcome").agg(F.count("*").alias("n"), F.sum("n_nodes").alias("n_nodes"), F.max("emitted_rdf_quads").alias("most_quads"))


Q33 = f"""{_BASE_SQL}, e AS (SELECT *, 1 + 3 * n_orders + 5 * n_lines + n_typed + n_values AS quads FROM c)
SELECT CASE WHEN quads > 200 THEN 'RdfQuadLimit' ELSE 'Success' END AS outcome, count(*) AS n, CAST(sum(CASE WHEN quads <= 200 THEN 1 + n_orders + n_lines END) AS BIGINT) AS n_nodes, CAST(max(least(quads, 201)) AS BIGINT) AS most_quads FROM e GROUP BY 1
"""


def q34_stress(spark, sf_dir):
    """The generated stress workload: its outcomes beside those expected. It reads no table."""
    cases = stress_documents(spark)
    made = Corpus(cases, ReadOptions(document_iri=workload.BASE)).composed_outcomes
    return cases.select("doc_id", "name", "family", "expected_quads", "expected_stage").join(made.select("doc_id", "outcome", "stage", "emitted_rdf_quads", "total_values", "max_nesting_depth"), "doc_id")


# The published structure and results of the stress documents: quads, stage and kind of the failure, values, depth.
_STRESS = """
(0, 'scalar-string-262144', 'raw-scalar', 1, NULL, 'Success', 3, 1), (1, 'semantic-depth-16', 'nesting', 15, NULL, 'Success', 32, 16), (2, 'semantic-depth-32', 'nesting', 31, NULL, 'Success', 64, 32),
(3, 'semantic-depth-64', 'nesting', 63, NULL, 'Success', 128, 64), (4, 'object-width-4096', 'width', 0, NULL, 'Success', 4097, 1), (5, 'value-density-32768-null', 'value-density', 0, NULL, 'Success', 32771, 2),
(6, 'value-density-32768-retained', 'value-density', 32768, NULL, 'Success', 32771, 2), (7, 'member-name-bytes-512x256', 'member-name-bytes', 0, NULL, 'Success', 513, 1),
(8, 'decoded-duplicate-65536', 'duplicate-names', NULL, 'Json', 'DuplicateMember', NULL, NULL), (9, 'context-terms-512', 'context-pressure', 512, NULL, 'Success', 1027, 2),
(10, 'repeated-local-contexts-256x512', 'context-pressure', 256, NULL, 'Success', 1795, 4), (11, 'ordered-id-early-128x16', 'object-order', 2048, NULL, 'Success', 2305, 2),
(12, 'ordered-id-late-128x16', 'object-order', 2048, NULL, 'Success', 2305, 2), (13, 'rdf-list-1024', 'rdf-expansion', 2049, NULL, 'Success', 1028, 3),
(14, 'compact-iri-properties-2048', 'rdf-expansion', 2048, NULL, 'Success', 2054, 3), (15, 'keyword-alias-collision-512', 'keyword-alias-collision', NULL, 'JsonLd', 'JsonLd', 1026, 2)"""
Q34 = f"""
SELECT CAST(i AS BIGINT) AS doc_id, name, family, CAST(quads AS BIGINT) AS expected_quads, stage AS expected_stage, outcome, stage,
  CAST(CASE WHEN stage = 'JsonLd' THEN 0 ELSE quads END AS BIGINT) AS emitted_rdf_quads, CAST(vals AS BIGINT) AS total_values, CAST(depth AS BIGINT) AS max_nesting_depth
FROM (VALUES {_STRESS}) t(i, name, family, quads, stage, outcome, vals, depth)
"""


def _named(first: str) -> dict:
    return {n: x for n, x in {**globals(), **vars(cases)}.items() if n[0] == first and n[1:3].isdigit()}


def queries() -> dict[str, Callable]:
    return _named("q")


def oracle_sql() -> dict[str, str]:
    sql = _named("Q")
    return {name: sql["Q" + name[1:3]] for name in queries() if "Q" + name[1:3] in sql}
