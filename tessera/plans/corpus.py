"""A corpus of documents and the tables that can be asked of it.

Nothing runs before a table is asked for. What several tables are made from (scans, quads, members of nodes) is written once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ingest, projection, quads, validation
from tessera.options import ReadOptions
from tessera.sources.shared import materialize

_TABLES = ["outcomes", "json_values", "namespaces", "nodes", "edges", "properties", "extensions", "projection_findings", "findings", "metrics", "adjacency"]
_SEMANTIC = ["quads", "composed_outcomes", "composed_nodes", "composed_edges", "composed_findings"]


class Corpus:
    """Documents ``(doc_id, content)`` and options. ``document_iri`` may be a column, for each document its own.

    The tables of the projection are of all documents that scan well; the ``composed_`` ones of those that also pass
    JSON-LD and its budgets, as a document that fails there has no projection either.
    """

    def __init__(self, documents: DataFrame, options: ReadOptions | None = None):
        self.options = options or ReadOptions()
        self.admitted = ingest.admitted(documents, self.options)

    def __repr__(self) -> str:
        return f"Corpus({self.options!r})"

    @cached_property
    def scans(self) -> DataFrame:
        return materialize(ingest.scanned(self.admitted, self.options), "scans")

    @cached_property
    def outcomes(self) -> DataFrame:
        return ingest.outcomes(self.admitted, self.scans)

    @cached_property
    def json_values(self) -> DataFrame:
        return materialize(ingest.json_values(self.admitted, self.options), "values")

    @cached_property
    def projection(self) -> projection.Projection:
        return projection.project(self.json_values)

    namespaces = property(lambda self: self.projection.namespaces)
    nodes = property(lambda self: self.projection.nodes)
    edges = property(lambda self: self.projection.edges)
    properties = property(lambda self: self.projection.properties)
    extensions = property(lambda self: self.projection.extensions)
    projection_findings = property(lambda self: self.projection.findings)
    metrics = property(lambda self: self.projection.metrics)

    @cached_property
    def adjacency(self) -> DataFrame:
        return projection.adjacency(self.projection)

    @cached_property
    def validation_findings(self) -> DataFrame:
        return validation.validate(self.projection)

    @cached_property
    def findings(self) -> DataFrame:
        """Findings of both families: ``P`` of the projection, ``V`` of the rules (``C`` among them by code)."""
        none = F.lit(None).cast("string")
        p = self.projection.findings.select("doc_id", F.lit("P").alias("family"), "code", none.alias("severity"), "node", "context", "tok_start", "tok_end", "seq")
        v = self.validation_findings.select("doc_id", F.substring("code", 5, 1).alias("family"), "code", "severity", "node", none.alias("context"), "tok_start", "tok_end", "seq")
        return p.unionByName(v)

    @cached_property
    def semantic(self) -> DataFrame:
        return materialize(quads.semantic(self.admitted, self.scans, self.options), "semantic")

    @cached_property
    def _judged(self) -> DataFrame:
        """Scan and semantic outcome of each document; quads are emitted and counted, but not handed on."""
        return self._kept if "_kept" in self.__dict__ else materialize(quads.judged(self.admitted, self.options), "judged")

    @cached_property
    def _kept(self) -> DataFrame:
        """The same with the bytes of the documents that pass."""
        return materialize(quads.judged(self.admitted, self.options, with_content=True), "kept")

    @cached_property
    def quads(self) -> DataFrame:
        return quads.quad_rows(self.semantic)

    @cached_property
    def composed_outcomes(self) -> DataFrame:
        if "semantic" in self.__dict__:
            return ingest.outcomes(self.admitted, self.scans, self.semantic)
        return ingest.judged_outcomes(self._judged).withColumn("doc_id", F.col("doc_id").cast(self.admitted.schema["doc_id"].dataType))

    @cached_property
    def _passing(self) -> Corpus:
        """The documents that pass, which alone are projected. Their bytes were kept as they were judged."""
        made = Corpus.__new__(Corpus)
        made.options, made.admitted = self.options, self._kept.where("content IS NOT NULL").select(*self.admitted.columns)
        return made

    def _composed(self, name: str) -> DataFrame:
        if "json_values" not in self.__dict__:
            return getattr(self._passing, name)
        passed = self.semantic.where("failure IS NULL") if "semantic" in self.__dict__ else self._judged.where("emitted_rdf_quads IS NOT NULL AND semantic_failure IS NULL")
        return getattr(self, name).join(passed.select("doc_id"), "doc_id", "left_semi")

    composed_nodes = property(lambda self: self._composed("nodes"))
    composed_edges = property(lambda self: self._composed("edges"))
    composed_findings = property(lambda self: self._composed("findings"))

    def source_text(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``source``: the exact bytes from ``tok_start`` to ``tok_end``, as text."""
        content = self.admitted.select(F.col("doc_id").alias("source_id"), "content")
        piece = F.substring("content", (F.col("tok_start") + 1).cast("int"), (F.col("tok_end") - F.col("tok_start")).cast("int"))
        return rows.join(content, F.col("doc_id") == F.col("source_id")).withColumn("source", piece.cast("string")).drop("content", "source_id")

    def register(self, spark: SparkSession, prefix: str = "") -> list[str]:
        """Temporary views of all tables, for SQL."""
        made = []
        for name in [*_TABLES, *_SEMANTIC]:
            getattr(self, name).createOrReplaceTempView(prefix + name)
            made.append(prefix + name)
        return made
