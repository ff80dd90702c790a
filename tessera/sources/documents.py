"""Sources of documents: folders of files, rows of tables, and generated workloads."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names that are documents.
PATTERN = "{*.jsonld,*.cxf.json}"


def reject_links(path: str) -> None:
    """Raise for a local path of which any part is a symbolic link."""
    at = os.path.abspath(path)
    while at != os.path.dirname(at):
        if os.path.islink(at):
            raise ValueError("a part of the path is a symbolic link")
        at = os.path.dirname(at)


def require_unique(documents: DataFrame) -> DataFrame:
    """The documents, unless two have one ``doc_id``, which would mix their values in every join: that raises.

    Only the ids are read and dealt out.
    """
    shared = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if shared:
        raise ValueError(f"{shared[0]['n']} documents have the doc_id {shared[0]['doc_id']}")
    return documents


def read_folder(spark: SparkSession, path: str, reject_symlinks: bool = False, check_ids: bool = True) -> DataFrame:
    """``doc_id, path, content, length`` of all documents below a folder, each path once, numbered by path's hash.

    Two paths of one hash (to be expected from some 10^9 files on) raise; ``check_ids`` looks for them, from the listing
    alone. ``path`` is whatever Spark's readers open. Links can be told apart on a local file system only, so
    ``reject_symlinks`` looks at that.
    """
    if reject_symlinks:
        reject_links(path.removeprefix("file://"))
        for folder, _, files in os.walk(path.removeprefix("file://")):
            if any(os.path.islink(os.path.join(folder, f)) for f in files):
                raise ValueError("a document is a symbolic link")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).load(path)
    documents = files.select(F.xxhash64("path").alias("doc_id"), "path", "content", "length")  # a listing has each path once
    return require_unique(documents) if check_ids else documents


def from_text(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, content`` from a text column."""
    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("content"))


def from_values(spark: SparkSession, documents: list[bytes]) -> DataFrame:
    """``doc_id, content`` for a few documents at hand, numbered in order."""
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(documents)], "doc_id long, content binary")


def _numbered(n: Column, of: str) -> Column:
    """A JSON list body of ``n`` copies of a value."""
    return F.array_join(F.array_repeat(F.lit(of), n), ",")


def retained_values(spark: SparkSession, documents: int, values: int) -> DataFrame:
    """``documents`` documents of one subject with ``values`` string values each; the semantic workload."""
    body = F.concat(F.lit('{"@id":"https://e.test/s","https://e.test/p":['), _numbered(F.lit(values), '"v"'), F.lit("]}"))
    return spark.range(documents).select(F.col("id").alias("doc_id"), body.cast("binary").alias("content"))


def stress_cases() -> list[tuple[str, str, bytes, int | None, str | None]]:
    """(name, family, document, quads expected, stage of the failure expected) of the stress workload.

    Each puts pressure on one limit: length of a string, depth, width, number of values, length of names, duplicates,
    contexts, order of ids, lists, compact IRIs, and aliases of keywords.
    """

    def joined(parts) -> str:
        return ",".join(parts)

    def depth(n: int) -> str:
        return "".join(f'{{"@id":"https://e.test/n/{i}","https://e.test/p":' for i in range(n - 1)) + f'{{"@id":"https://e.test/n/{n - 1}"}}' + "}" * (n - 1)

    def ids(nodes: int, properties: int, late: bool) -> str:
        out = []
        for n in range(nodes):
            members = [f'"https://e.test/p/{p:04x}":{n}' for p in range(properties)]
            name = f'"@id":"https://e.test/n/{n:04x}"'
            out.append("{" + (joined(members) + ", " + name if late else joined([name, *members])) + "}")
        return f"[{joined(out)}]"

    head = '{"@id":"https://e.test/s","https://e.test/p":'
    terms = joined(f'"t{i:04x}":"https://e.test/predicate/very/long/path/{i:04x}"' for i in range(512))
    parents = joined(f'"p{i:04x}":"https://e.test/p/{i:04x}"' for i in range(512))
    nodes = joined(f'{{"@context":{{"v":"https://e.test/value"}},"@id":"https://e.test/n/{i:04x}","v":0}}' for i in range(256))
    long_name = "x" * 65_536
    cases = [
        ("scalar-string-262144", "raw-scalar", head + '"' + "a" * 262_144 + '"}', 1, None),
        *[(f"semantic-depth-{n}", "nesting", depth(n), n - 1, None) for n in (16, 32, 64)],
        ("object-width-4096", "width", "{" + joined(f'"https://e.test/p/{i:04x}":null' for i in range(4096)) + "}", 0, None),
        ("value-density-32768-null", "value-density", head + "[" + joined(["null"] * 32_768) + "]}", 0, None),
        ("value-density-32768-retained", "value-density", head + "[" + joined(["0"] * 32_768) + "]}", 32_768, None),
        ("member-name-bytes-512x256", "member-name-bytes", "{" + joined(f'"https://e.test/{i:04x}{"a" * 237}":null' for i in range(512)) + "}", 0, None),
        ("decoded-duplicate-65536", "duplicate-names", "{" + "".join(f'"p{i:04x}":null,' for i in range(512)) + f'"{long_name}":0,"\\u0078{long_name[1:]}":1}}', None, "Json"),
        ("context-terms-512", "context-pressure", f'{{"@context":{{{terms}}},"@id":"https://e.test/s"' + "".join(f', "t{i:04x}":0' for i in range(512)) + "}", 512, None),
        ("repeated-local-contexts-256x512", "context-pressure", f'{{"@context":{{{parents}}},"@graph":[{nodes}]}}', 256, None),
        ("ordered-id-early-128x16", "object-order", ids(128, 16, False), 2048, None),
        ("ordered-id-late-128x16", "object-order", ids(128, 16, True), 2048, None),
        ("rdf-list-1024", "rdf-expansion", head + '{"@list":[' + joined(["0"] * 1024) + "]}}", 2049, None),
        ("compact-iri-properties-2048", "rdf-expansion", '{"@context":{"ex":{"@id":"https://e.test/predicate/very/long/path/","@prefix":true}},"@id":"https://e.test/s"' + "".join(f', "ex:p{i:04x}":0' for i in range(2048)) + "}", 2048, None),
        ("keyword-alias-collision-512", "keyword-alias-collision", '{"@context":{' + joined(f'"i{i:04x}":"@id"' for i in range(512)) + "}" + "".join(f', "i{i:04x}":"https://e.test/id/{i:04x}"' for i in range(512)) + "}", None, "JsonLd"),
    ]
    return [(name, family, text.encode(), quads, stage) for name, family, text, quads, stage in cases]


def stress_documents(spark: SparkSession) -> DataFrame:
    """The stress workload as ``doc_id, name, family, content, expected_quads, expected_stage``."""
    rows = [(i, n, f, bytearray(c), q, s) for i, (n, f, c, q, s) in enumerate(stress_cases())]
    return spark.createDataFrame(rows, "doc_id long, name string, family string, content binary, expected_quads long, expected_stage string")
