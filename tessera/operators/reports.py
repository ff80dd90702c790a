"""Reports: structure of a corpus, distributions of measured runs, and byte-level facts of texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import materialize


def corpus_report(outcomes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row for a corpus: outcomes counted by expectation, and sums and maxima of sizes and structure.

    ``expected(doc_id, expected_message)`` names documents that are to fail, with the exact message. Sums and maxima of
    nothing are 0. ``is_complete`` says whether every document that could be read was measured.
    """
    if expected is None:
        rows = outcomes.withColumn("expected_message", F.lit(None).cast("string"))
    else:
        rows = outcomes.join(expected.select("doc_id", "expected_message"), "doc_id", "left")
    ok, asked = F.col("outcome") == "Success", F.col("expected_message").isNotNull()
    as_said = F.coalesce(F.col("message") == F.col("expected_message"), F.lit(False))
    n = lambda c: F.count_if(c).alias
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    most = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("documents"), n(ok & ~asked)("passed"), n(~ok & as_said)("expected_failures"), n(~ok & ~as_said)("unexpected_failures"), n(ok & asked)("unexpected_passes"), n(~F.col("source_retained"))("read_failures"),
        total("length").alias("input_bytes"), most("length").alias("max_input_bytes"), most("max_nesting_depth").alias("max_nesting_depth"), most("max_object_members").alias("max_object_members"),
        total("total_values").alias("total_json_values"), total("decoded_member_name_bytes").alias("decoded_member_name_bytes"), total("emitted_rdf_quads").alias("quad_count"), total("retained_rdf_term_bytes").alias("rdf_term_bytes"),
        (F.count("total_values") == F.count_if(F.col("source_retained"))).alias("is_complete"),
    )


def optional_sums(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Sums of measures that may not have been taken, by group: null where none was, which differs from 0."""
    return rows.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def write_json(report: DataFrame, path: str) -> None:
    """Write each row of a report as indented JSON and a newline; null columns are written, so that a report has all its names."""
    lines = report.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    lines.write.text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reports that ``write_json`` wrote, under the schema they had."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?<=\n\})\n")).alias("value")).where("trim(value) <> ''")
    return text.select(F.from_json("value", schema).alias("r")).select("r.*")


def distribution(runs: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Median, minimum and maximum of a measure for each group."""
    return runs.groupBy(*by).agg(F.median(value).alias("median"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))


def derived(runs: DataFrame, by: list[str], run: str, formula: Column) -> DataFrame:
    """A measure worked out for each run from its pivoted metrics, then distributed; never from other distributions."""
    return distribution(runs.withColumn("value", formula).select(*by, run, "value"), by)


def stability(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Whether a value is the same in all runs of a group."""
    return runs.groupBy(*by).agg((F.count_distinct(F.to_json(F.struct(value))) == 1).alias("is_stable"))


def run_check(runs: DataFrame, by: list[str], run: str = "run_id", arity: int = 5) -> DataFrame:
    """Whether a group has as many runs as asked for, each its own."""
    return runs.groupBy(*by).agg(((F.count("*") == arity) & (F.count_distinct(run) == F.count("*"))).alias("is_valid"))


def zipped(runs: DataFrame, run: str, cases: str) -> DataFrame:
    """Cases of several runs side by side: ``position`` and the list of values by run."""
    each = runs.select(run, F.posexplode(cases).alias("position", "value"))
    return each.groupBy("position").agg(F.transform(F.sort_array(F.collect_list(F.struct(run, "value"))), lambda x: x["value"]).alias("values"))


def extracted(logs: DataFrame, text: str, pattern: str) -> DataFrame:
    """All matches of a pattern's first group in a text column, as ``found``."""
    return logs.withColumn("found", F.regexp_extract_all(text, F.lit(pattern), 1))


def is_binary(content: Column) -> Column:
    """A NUL in the first 8,192 bytes, or invalid UTF-8."""
    head = F.substring(content, 1, 8192)
    return (F.position(F.lit("\x00"), head.cast("string")) > 0) | ~F.is_valid_utf8(content.cast("string"))


# Patterns of secrets, by name; byte patterns, so classes and cases are ASCII's.
SECRETS = {
    "private-key-header": rb"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "aws-access-key": rb"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "github-token": rb"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,255}",
    "github-fine-grained-token": rb"github_pat_[A-Za-z0-9_]{20,255}",
    "slack-token": rb"xox[baprs]-[A-Za-z0-9-]{10,}",
    "assigned-secret": rb"(?i)(?:api[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token|password|passwd)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{8,}",
}
#: Findings that a document reports at most, unless all are asked for.
MOST_SECRETS = 1000


def find_secrets(data: bytes, most: int | None = None) -> tuple[list[tuple[str, int]], bool]:
    """Name and line of every match by place, and whether there were more than ``most``; the first are kept by pattern."""
    found = [(m.start(), name) for name, pattern in SECRETS.items() for m in re.finditer(pattern, data)]
    rows, line, before = [], 1, 0
    for at, name in sorted(found[:most]):
        line += data.count(b"\n", before, at)
        before = at
        rows.append((name, line))
    return rows, most is not None and len(found) > most


@F.arrow_udf(T.BinaryType())
def _redact(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        data = t.as_py()
        for name, pattern in SECRETS.items() if data is not None else ():
            data = re.sub(pattern, f"[REDACTED:{name}]".encode(), data)
        out.append(data)
    return pa.array(out, pa.binary())


def secrets(rows: DataFrame, text: str = "text", most: int | None = MOST_SECRETS) -> DataFrame:
    """``rows`` with ``kind`` and ``line`` of every match of each pattern, lines counted from 1.

    A document reports at most ``most`` findings (None: all); ``truncated`` says whether it had more.
    """
    hits = T.ArrayType(T.StructType().add("kind", T.StringType()).add("line", T.LongType()).add("truncated", T.BooleanType()))

    @F.arrow_udf(hits)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found, cut = find_secrets(t.as_py() or b"", most)
            out.append([{"kind": k, "line": n, "truncated": cut} for k, n in found])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("line", pa.int64()), ("truncated", pa.bool_())])))

    each = rows.withColumn("hit", F.explode(scan(F.col(text).cast("binary"))))
    return each.withColumns({c: F.col(f"hit.{c}") for c in ("kind", "line", "truncated")}).drop("hit")


def redacted(text: Column) -> Column:
    """The text with every secret replaced by its name, pattern by pattern."""
    return _redact(text.cast("binary")).cast("string")


def checksum_problems(files: DataFrame, listed: DataFrame) -> DataFrame:
    """``path, problem`` where ``files(path, content)`` and the digests ``listed(path, sha256)`` differ.

    ``missing`` is listed only, ``unlisted`` isn't, ``mismatch`` has another digest, ``repeated`` is listed more than once.
    Contents aren't moved: their digests are.
    """
    own = files.select("path", F.sha2("content", 256).alias("own"))
    told = listed.groupBy("path").agg(F.min("sha256").alias("sha256"), F.count("*").alias("n"))
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("n") > 1, "repeated").when(F.col("own") != F.col("sha256"), "mismatch")
    return own.join(told, "path", "full").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def closure(links: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """``node, steps``: what can be reached from ``roots(node)`` over ``links(child, parent)``, with the fewest steps.

    A round follows the links of what the round before found first, so cycles end. More than ``most`` nodes are an error.
    """
    found = materialize(roots.select(F.col("node").cast("long").alias("node")).distinct().withColumn("steps", F.lit(0).cast("long")), "closure")
    last, steps = found, 0
    while not last.isEmpty():
        if most is not None and found.count() > most:
            raise ValueError(f"more than {most} nodes are reached")
        steps += 1
        ahead = links.join(last, F.col("child") == F.col("node")).select(F.col("parent").cast("long").alias("node")).distinct()
        last = materialize(ahead.join(found, "node", "left_anti").withColumn("steps", F.lit(steps).cast("long")), "closure")
        found = found.unionAll(last)
    return found


def pointer(values: DataFrame, path: str) -> DataFrame:
    """The values a JSON Pointer names, one for each document that has it: a join for each step."""
    at = values.where("value_id = 0")
    for step in path.split("/")[1:]:
        name = step.replace("~1", "/").replace("~0", "~")
        by_index = (F.col("parent_kind") == "array") & F.lit(name.isdigit() and (name == "0" or name[0] != "0")) & (F.col("ordinal").cast("string") == name)
        here = values.where((F.col("parent_kind") == "object") & (F.col("name") == name) | by_index)
        at = here.join(at.select("doc_id", F.col("value_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
    return at


def structure_metrics(values: DataFrame) -> DataFrame:
    """Structure metrics of each document, from its values alone."""
    members = values.where("parent_kind = 'object'").groupBy("doc_id", "parent_id").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("most"))
    own = values.groupBy("doc_id").agg(
        F.max(F.when(F.col("kind").isin("object", "array"), F.col("depth") + 1).otherwise(0)).cast("long").alias("max_nesting_depth"), F.count("*").alias("total_values"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).cast("long").alias("decoded_member_name_bytes")
    )
    return own.join(members, "doc_id", "left").select("doc_id", "max_nesting_depth", F.coalesce("most", F.lit(0)).cast("long").alias("max_object_members"), "total_values", "decoded_member_name_bytes")
