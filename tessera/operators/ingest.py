"""Admission and scanning: raw bytes to one outcome for each document, and its values."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bulk import scan_many
from tessera.functions.places import SUMMARY, summaries
from tessera.functions.scanner import COLUMNS, scan
from tessera.options import ReadOptions

_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_METRICS = ["max_nesting_depth", "max_object_members", "total_values", "decoded_member_name_bytes"]
PLACES = ["err_offset", "err_line", "err_column"]
SCAN_SCHEMA = "doc_id long, failure string, err_offset long, err_line long, err_column long, " + ", ".join(f"{m} long" for m in _METRICS)
VALUE_SCHEMA = "doc_id long, " + ", ".join(f"{n} {t}" for n, t in [*COLUMNS, *SUMMARY])

#: Messages of the failures; fixed texts.
MESSAGES = {
    "InvalidUtf8": "input is not valid UTF-8",
    "Syntax": "invalid JSON syntax",
    "DuplicateMember": "duplicate object member name",
    "NestingLimit": "JSON nesting depth exceeds the configured limit",
    "ObjectMemberLimit": "JSON object members exceed the configured limit",
    "ValueLimit": "JSON values exceed the configured limit",
    "DecodedMemberNameBytesLimit": "decoded JSON member-name bytes exceed the configured limit",
    "MissingDocumentIri": "private semantic ingestion requires a document IRI",
    "JsonLd": "JSON-LD processing failed",
    "RdfQuadLimit": "emitted RDF quads exceed the configured limit",
    "RetainedRdfTermBytesLimit": "retained RDF term bytes exceed the configured limit",
}

#: What is said of a failure in a document of others; a fixed text.
REDACTED = "external parse failure (diagnostic redacted)"


def admitted(documents: DataFrame, options: ReadOptions) -> DataFrame:
    """``doc_id, content, document_iri, length, admitted``: content is null where the input is too long.

    A document that isn't admitted keeps its row, as its outcome must be reported.
    """
    length = F.octet_length("content").cast("long")
    fits = F.coalesce(length, F.lit(0)) <= options.max_input_bytes
    iri = F.col("document_iri") if "document_iri" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", F.when(fits, F.coalesce("content", F.lit(b""))).alias("content"), F.coalesce(iri, F.lit(options.document_iri).cast("string")).alias("document_iri"), F.coalesce(length, F.lit(0)).alias("length"), fits.alias("admitted"))


#: Documents and bytes scanned at once.
GROUP, GROUP_BYTES = 256, 2 << 20


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Cuts of a batch into (first, number) of at most ``GROUP`` documents and, but for single ones, ``GROUP_BYTES``."""
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and (i - first >= GROUP or total + size > GROUP_BYTES):
            yield first, i - first
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes) - first


def _scan_batch(ids: pa.Array, failures: list, places: list[list], metrics: list) -> pa.RecordBatch:
    told = [ids, pa.array(failures, pa.string()), *[pa.array(p, pa.int64()) for p in places], *[pa.array(m, pa.int64()) for m in metrics]]
    return pa.RecordBatch.from_arrays(told, ["doc_id", "failure", "err_offset", "err_line", "err_column", *_METRICS])


def _value_batch(ids: pa.Array, counts: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
    of = ids.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
    return pa.RecordBatch.from_arrays([of, *columns, *summaries(columns, counts)], ["doc_id", *(n for n, _ in [*COLUMNS, *SUMMARY])])


def scanner(settings: dict, with_values: bool):
    """Rows of the documents' scans, or (``with_values``) of the values of those that scanned well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = ReadOptions(**settings)
        for batch in batches:
            contents = batch["content"].to_pylist()
            for first, n in _groups([len(c) for c in contents]):
                part, ids = contents[first : first + n], batch["doc_id"].slice(first, n)
                bulk = scan_many(part, options, with_values)
                if len(bulk.good):
                    good, none = ids.take(pa.array(bulk.good)), [None] * len(bulk.good)
                    yield _value_batch(good, bulk.counts, bulk.columns) if with_values else _scan_batch(good, none, [none] * 3, bulk.metrics)
                for i in sorted(set(range(n)) - set(bulk.good.tolist())):  # what isn't plainly good is looked at exactly
                    done = scan(part[i], options)
                    if not with_values:
                        yield _scan_batch(ids.slice(i, 1), [done.failure], [[p] for p in done.position or (None, None, None)], [[None if done.failure else getattr(done, m)] for m in _METRICS])
                    elif not done.failure:
                        columns = [pa.array(c, _ARROW[t]) for c, (_, t) in zip(list(zip(*done.rows)), COLUMNS)]
                        yield _value_batch(ids.slice(i, 1), np.array([len(done.rows)]), columns)

    return run


DIAGNOSTIC_SCHEMA = "doc_id long, message string, err_offset long, err_line long, err_column long, pointer string, term string"


def _describer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = batch["content"].to_pylist()
        for first, n in _groups([len(c) for c in contents]):
            part, ids = contents[first : first + n], batch["doc_id"].slice(first, n)
            most = max(map(len, part)) + 1
            free = ReadOptions(max_json_nesting_depth=most, max_json_object_members=most, max_json_values=most, max_decoded_member_name_bytes=most)
            rows = []
            for i in sorted(set(range(n)) - set(scan_many(part, free, False).good.tolist())):
                done = scan(part[i], free)
                if done.failure:
                    rows.append((ids[i].as_py(), done.why, *done.position))
            told = list(zip(*rows)) or [()] * 5
            columns = [pa.array(told[0], pa.int64()), pa.array(told[1], pa.string()), *[pa.array(c, pa.int64()) for c in told[2:]]]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(rows), pa.string())] * 2], ["doc_id", "message", "err_offset", "err_line", "err_column", "pointer", "term"])


def diagnostics(documents: DataFrame) -> DataFrame:
    """``message`` and place of what is wrong with each document that isn't JSON with unique members; no limits hold here.

    The message describes what was expected or found; a string's first fault is named. Null contents are empty ones.
    ``pointer`` and ``term`` are for diagnostics of later stages and null here.
    """
    content = F.coalesce("content", F.lit(b"")).alias("content")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), content).mapInArrow(_describer, DIAGNOSTIC_SCHEMA)


def redacted_diagnostics(found: DataFrame, external: Column) -> DataFrame:
    """Diagnostics that say nothing of documents which belong to others: one message, no place, pointer or term."""
    hide = F.coalesce(external, F.lit(True))
    places = {c: F.when(~hide, F.col(c)) for c in ("err_offset", "err_line", "err_column", "pointer", "term")}
    return found.withColumns({"message": F.when(hide, REDACTED).otherwise(F.col("message")), **places})


def _ready(taken: DataFrame) -> DataFrame:
    return taken.where("admitted").select(F.col("doc_id").cast("long").alias("doc_id"), "content")


def scanned(taken: DataFrame, options: ReadOptions) -> DataFrame:
    """One row for each admitted document: its failure and place, or its metrics."""
    return _ready(taken).mapInArrow(scanner(asdict(options), False), SCAN_SCHEMA)


def json_values(taken: DataFrame, options: ReadOptions) -> DataFrame:
    """One row for each JSON value of the documents that scan well, in pre-order by ``value_id``."""
    return _ready(taken).mapInArrow(scanner(asdict(options), True), VALUE_SCHEMA)


def _told(rows: DataFrame, failed: Column, extra: list[Column]) -> DataFrame:
    """The outcome of each row, whose first failure is ``failed``, with its stage and message."""
    outcome = F.coalesce(failed, F.lit("Success"))
    stage, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in MESSAGES.items():
        message = F.when(outcome == kind, text).otherwise(message)
    json_kinds = list(MESSAGES)[:7]
    stage = F.when(outcome == "Admission", "Input").when(outcome.isin(json_kinds), "Json").when(outcome != "Success", "JsonLd")
    return rows.select("doc_id", "length", outcome.alias("outcome"), stage.alias("stage"), message.alias("message"), *PLACES, F.col("admitted").alias("source_retained"), *_METRICS, *extra)


def _first_failure(with_semantic: bool) -> Column:
    failed = F.when(~F.col("admitted"), "Admission").otherwise(F.col("failure"))
    return F.coalesce(failed, F.when(F.col("document_iri").isNull(), "MissingDocumentIri"), F.col("semantic_failure")) if with_semantic else failed


def outcomes(taken: DataFrame, scans: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """One row for each document, with the first stage that failed.

    Stages go in order: admission, UTF-8, JSON, the document IRI, then JSON-LD and its budgets. Without ``semantic`` (the
    last two aren't asked for) the outcome is that of the scan alone.
    """
    all_rows = taken.join(scans.select(F.col("doc_id").alias("scan_id"), "failure", *PLACES, *_METRICS), F.col("doc_id") == F.col("scan_id"), "left")
    extra: list[Column] = [F.lit(None).cast("long").alias("emitted_rdf_quads"), F.lit(None).cast("long").alias("retained_rdf_term_bytes")]
    if semantic is not None:
        all_rows = all_rows.join(semantic.select(F.col("doc_id").alias("semantic_id"), F.col("failure").alias("semantic_failure"), "emitted_rdf_quads", "retained_rdf_term_bytes"), F.col("doc_id") == F.col("semantic_id"), "left")
        extra = [F.col("emitted_rdf_quads"), F.col("retained_rdf_term_bytes")]
    return _told(all_rows, _first_failure(semantic is not None), extra)


def judged_outcomes(judged: DataFrame) -> DataFrame:
    """The same of documents whose scan and semantic outcome are in one row (``quads.judged``)."""
    return _told(judged, _first_failure(True), [F.col("emitted_rdf_quads"), F.col("retained_rdf_term_bytes")])
