"""Quality rules as a bitmask ledger: every rule runs once, policies and ablations only read bits.

All of it is built-in DataFrame functions. ``ledger`` stores a document's measurements and one failure bit
for each rule; ``judge`` applies a versioned policy (a mask of the rules that count); ``ablations`` says,
from counts of bit patterns, what each rule of a policy removes and what it alone removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACES, table

_GAP = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
SPAN = 5

#: Rule names in the order of their bits, with the measurement test that fails a document. New rules go last.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version. A published version never changes; a new one is added.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines", "long_words"],
}
LATEST = "v1"


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once: a lambda's variable is never expanded by the optimizer."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside spans of five words that occur twice or more."""

    def covered(starts: Column) -> Column:
        size = F.transform(starts, lambda s, k: F.least(F.lit(SPAN), F.coalesce(F.get(starts, k + 1) - s, F.lit(SPAN))))
        return F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x)

    def again(sorted_spans: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(sorted_spans, k)["h"] == x["h"], F.lit(False))
        hits = F.filter(sorted_spans, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return _let(F.sort_array(F.transform(hits, lambda x: x["i"])), covered)

    def spans(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), again)
        )

    last = F.size(words) - SPAN
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SPAN)]))
    return F.when(last < 1, F.lit(0).cast("long")).otherwise(_let(hashes, spans))


def measure(text: Column) -> Column:
    """All measurements of a text as one struct of longs; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, _GAP), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = _let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), F.regexp_count(whole, F.lit(_SYMBOL)).cast("long").alias("n_symbols"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits``, one row for each input row.

    Null and empty texts have no words and fail ``few_words``. Repeated rows stay repeated; other columns
    are not read; an empty table gives an empty result.
    """
    taken = docs.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col)).alias("m")).select(
        "doc_id", "m.words.n_words", "m.words.word_chars", "m.n_symbols", "m.lines.n_lines", "m.lines.n_dup_lines", "m.words.n_repeat_words"
    )
    bits = [F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, test in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return taken.withColumn("fail_bits", total)


def judge(book: DataFrame, policy: str = LATEST) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(book: DataFrame, policy: str = LATEST) -> DataFrame:
    """For each rule of a policy: ``n_failed``, ``n_only`` (removed by no other rule) and ``n_kept_without``.

    The ledger is summed once into counts of bit patterns, at most 2 to the number of rules.
    """
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy]]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    when = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("rule").agg(
        when(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        when(F.col("bits") == F.col("bit")).alias("n_only"),
        when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    book = judge(ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "n_lines", "fail_bits")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
s AS (SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
k AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS span FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, span) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & 3) <> 0 AS base_failed, (bits & 31) = 0 AS kept, n_lines, CAST(bits AS BIGINT) AS fail_bits FROM b
"""
