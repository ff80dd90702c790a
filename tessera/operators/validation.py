"""Validation rules over a projection. What isn't known (a weak or library type) never breaks a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import names
from tessera.operators.projection import Projection

_SEVERITY = dict(names.RULES)
_ORDER = [code for code, _ in names.RULES]


def _finding(rows: DataFrame, code: Column | str, node: Column) -> DataFrame:
    return rows.select("doc_id", (F.lit(code) if isinstance(code, str) else code).alias("code"), node.cast("int").alias("node"), "tok_start", "tok_end")


def connection_findings(p: Projection) -> DataFrame:
    """Connections that end at something that is no connector, or join connectors of different types."""
    facts = p.nodes.select("doc_id", "node", "class", F.coalesce("conn_type", "data_type").alias("type"))
    side = lambda key, name: facts.select("doc_id", F.col("node").alias(key), F.struct("class", "type").alias(name))
    edges = p.edges.where("kind = 'Connection' AND target IS NOT NULL")
    both = edges.join(side("subject", "a"), ["doc_id", "subject"]).join(side("target", "b"), ["doc_id", "target"])
    ends = both.select("doc_id", "tok_start", "tok_end", F.explode(F.array(F.struct(F.col("subject").alias("node"), "a.class"), F.struct(F.col("target").alias("node"), "b.class"))).alias("end"))
    wrong = _finding(ends.where(F.col("end.class").isin(names.NOT_CONNECTOR)), "CXF-V-001", F.col("end.node"))
    differ = (F.col("a.class") == "Connector") & (F.col("b.class") == "Connector") & (F.col("a.type") != F.col("b.type"))
    return wrong.unionByName(_finding(both.where(differ), "CXF-V-002", F.col("subject")))


def domain_findings(p: Projection) -> DataFrame:
    """Edges whose subject's class can't have them."""
    facts = p.nodes.select("doc_id", F.col("node").alias("subject"), "class")
    edges = p.edges.join(facts, ["doc_id", "subject"])
    typed = edges.where((F.col("kind") == "DataType") & F.col("class").isin(names.NO_DATA_TYPE))
    grouped = edges.where(F.col("kind").isin("Input", "Output", "Parameter", "Constant") & F.col("class").isin(names.NOT_BLOCK))
    return _finding(typed, "CXF-V-003", F.col("subject")).unionByName(_finding(grouped, "CXF-V-004", F.col("subject")))


def absent_values(p: Projection) -> DataFrame:
    """Parameters and constants without a value."""
    held = p.properties.where("term_local = 'value' AND payload_kind = 'Value'").select("doc_id", "node")
    return _finding(p.nodes.where("class IN ('Parameter', 'Constant')").join(held, ["doc_id", "node"], "left_anti"), "CXF-V-005", F.col("node"))


def namespace_findings(namespaces: DataFrame) -> DataFrame:
    """Prefixes bound to what they don't stand for; else legacy namespaces, and unknown ones of known families."""
    prefix, cls, shadowed = F.col("prefix"), F.col("class"), F.lit(False)
    for name, expected in names.EXPECTED_PREFIXES.items():
        shadowed |= (prefix == name) & ~cls.isin(expected)
    family = F.lit(False)
    for host in names.FAMILY_HOSTS:
        family |= F.col("iri").startswith(host)
    code = F.when(shadowed, "CXF-C-003").when(cls == "S231PLegacyHttps", "CXF-C-001").when((cls == "Unregistered") & family, "CXF-C-002")
    return _finding(namespaces.withColumn("code", code).where("code IS NOT NULL"), F.col("code"), F.lit(None))


def validate(p: Projection) -> DataFrame:
    """All findings of a projection: ``doc_id, seq, code, severity, node, tok_start, tok_end``, in order of place,
    node (none first) and rule."""
    found = connection_findings(p).unionByName(domain_findings(p)).unionByName(absent_values(p)).unionByName(namespace_findings(p.namespaces))
    severity = F.when(F.col("code").isin([c for c, s in names.RULES if s == "Error"]), "Error").otherwise("Warning")
    rank = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("code"))
    order = Window.partitionBy("doc_id").orderBy("tok_start", F.asc_nulls_first("node"), rank)
    return found.withColumn("severity", severity).withColumn("seq", F.row_number().over(order) - 1).select("doc_id", "seq", "code", "severity", "node", "tok_start", "tok_end")
