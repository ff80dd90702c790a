"""RDF quads of documents, and the budgets that cut them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.jsonld import to_quads
from tessera.operators import ingest
from tessera.options import ReadOptions

_PARTS = ["s_kind", "s", "p", "o_kind", "o", "o_datatype", "o_lang", "g_kind", "g"]
_QUAD = pa.struct([("seq", pa.int32()), *[(p, pa.string()) for p in _PARTS]])
SCHEMA = "doc_id long, failure string, emitted_rdf_quads long, retained_rdf_term_bytes long"
QUADS_SCHEMA = SCHEMA + ", quads array<struct<seq: int, " + ", ".join(f"{p}: string" for p in _PARTS) + ">>"
_NAMES = ["doc_id", "failure", "emitted_rdf_quads", "retained_rdf_term_bytes"]


def _reader(settings: dict, with_quads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = ReadOptions(**settings)
        limits = (options.max_rdf_quads, options.max_retained_rdf_term_bytes, with_quads)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                done = [to_quads(c.as_py(), i.as_py(), *limits) for c, i in zip(part["content"], part["document_iri"])]
                told = [part["doc_id"], *[pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]]
                if not with_quads:
                    yield pa.RecordBatch.from_arrays(told, _NAMES)
                    continue
                ends, cells = [0], []
                for *_, quads in done:
                    ends.append(ends[-1] + len(quads))
                    cells += [(n, s[0], s[1], p, *o, "default", None) if g is None else (n, s[0], s[1], p, *o, g[0], g[1]) for n, (s, p, o, g) in enumerate(quads)]
                columns = list(zip(*cells)) or [()] * 10
                rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _QUAD)], fields=list(_QUAD))
                yield pa.RecordBatch.from_arrays([*told, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], [*_NAMES, "quads"])

    return run


def semantic(admitted: DataFrame, scans: DataFrame, options: ReadOptions, with_quads: bool = True) -> DataFrame:
    """One row for each document that scanned well and has an IRI: its failure, progress, and (``with_quads``) all quads as one array."""
    good = scans.where("failure IS NULL").select(F.col("doc_id").alias("good_id"))
    ready = admitted.where("document_iri IS NOT NULL AND content IS NOT NULL").join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    return ready.select(F.col("doc_id").cast("long").alias("doc_id"), "content", "document_iri").mapInArrow(_reader(asdict(options), with_quads), QUADS_SCHEMA if with_quads else SCHEMA)


_SCAN = [f.split() for f in ingest.SCAN_SCHEMA.split(", ")[1:]]
_ADMITTED = "doc_id long, length long, admitted boolean, document_iri string"
_JUDGED = f"{_ADMITTED}, {', '.join(map(' '.join, _SCAN))}, semantic_failure string, emitted_rdf_quads long, retained_rdf_term_bytes long"
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _judge(settings: dict, with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options, scan = ReadOptions(**settings), ingest.scanner(settings, False)
        limits = (options.max_rdf_quads, options.max_retained_rdf_term_bytes, False)
        for batch in batches:
            for start in range(0, batch.num_rows, ingest.GROUP):
                part = batch.slice(start, ingest.GROUP)
                n, contents, iris = part.num_rows, part["content"].to_pylist(), part["document_iri"].to_pylist()
                there = [i for i, c in enumerate(contents) if c is not None]
                told = {c: [None] * n for c, _ in _SCAN}
                scanned = [False] * n
                for rows in scan([pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), part["content"].take(pa.array(there, pa.int64()))], ["doc_id", "content"])]):
                    at = rows["doc_id"].to_pylist()
                    for c, _ in _SCAN:
                        for i, v in zip(at, rows[c].to_pylist()):
                            told[c][i] = v
                    for i in at:
                        scanned[i] = told["failure"][i] is None
                done = [to_quads(contents[i], iris[i], *limits) if scanned[i] and iris[i] is not None else None for i in range(n)]
                columns = [pa.array(told[c], _ARROW[t]) for c, t in _SCAN]
                columns += [pa.array([d and d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                names = [c for c, _ in _SCAN] + ["semantic_failure", *_NAMES[2:]]
                if with_content:
                    columns.append(pa.array([contents[i] if d and d[0] is None else None for i, d in enumerate(done)], pa.binary()))
                    names.append("content")
                own = ["doc_id", "length", "admitted", "document_iri"]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in own], *columns], [*own, *names])

    return run


def judged(admitted: DataFrame, options: ReadOptions, with_content: bool = False) -> DataFrame:
    """One row for each document, with what its scan and its semantic reading came to, from one reading of its bytes.

    Quads are emitted and counted, but not handed on. ``with_content`` keeps the bytes of the documents that pass.
    """
    taken = admitted.select(F.col("doc_id").cast("long").alias("doc_id"), "length", "admitted", "document_iri", "content")
    return taken.mapInArrow(_judge(asdict(options), with_content), _JUDGED + (", content binary" if with_content else ""))


def quad_rows(done: DataFrame) -> DataFrame:
    """One row for each quad of the documents that passed, in order by ``seq``; repeated quads stay."""
    return done.where("failure IS NULL").select("doc_id", F.explode("quads").alias("q")).select("doc_id", "q.*")


def summary(quads: DataFrame) -> DataFrame:
    """The multiset of quads: each with its number of occurrences."""
    return quads.groupBy("doc_id", *_PARTS).agg(F.count("*").alias("n"))


def canonical(quads: DataFrame) -> DataFrame:
    """Quads with ``position`` in the canonical order of their document: by subject, predicate, object and graph, repeated ones kept."""
    order = Window.partitionBy("doc_id").orderBy("s_kind", "s", "p", "o_kind", "o", "o_datatype", "o_lang", "g_kind", "g")
    return quads.withColumn("position", F.row_number().over(order) - 1)


def with_progress(quads: DataFrame) -> DataFrame:
    """Quads with the running totals that budgets look at: ``emitted`` and ``kept_bytes`` up to each."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("s", "p", "o", "o_datatype", "o_lang", "g")), F.lit(0))
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return quads.withColumn("emitted", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).cast("long")).withColumn("kept_bytes", F.sum(size).over(upto).cast("long"))


def budget_cut(quads: DataFrame, most_quads: int, most_bytes: int) -> DataFrame:
    """The first quad of each document that breaks a budget, and which; the number is looked at first."""
    broken = F.when(F.col("emitted") > most_quads, "RdfQuadLimit").when(F.col("kept_bytes") > most_bytes, "RetainedRdfTermBytesLimit")
    over = with_progress(quads).withColumn("outcome", broken).where("outcome IS NOT NULL")
    return over.groupBy("doc_id").agg(F.min_by("outcome", "seq").alias("outcome"), F.min("emitted").alias("emitted"))


def same_set(a: DataFrame, b: DataFrame, multiset: bool = False) -> bool:
    """Whether two quad tables hold the same quads, each once or (``multiset``) as often."""
    a, b = a.select(*_PARTS), b.select(*_PARTS)
    if not multiset:
        a, b = a.distinct(), b.distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
