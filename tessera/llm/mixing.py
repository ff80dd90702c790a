"""Mixing sources to target weights over a domain-language-source tree, in seeded epochs.

A budget of tokens runs down the tree. At each node it is shared among the children by weight, but none gets more than
its subtree holds in ``max_epochs`` passes: what a short child can't take goes to its siblings by weight, and only what
all of them can't take leaves the node, to the siblings above. The level at which the siblings' shares stand has a closed
form over the children ordered by capacity for each unit of weight, so windows over the table of leaves solve it.

A leaf then takes whole passes over its documents and, of the last pass, the prefix in the seeded order that fills
its target. Running sums go by buckets of the order, and those by groups of buckets, so no group grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import fresh, materialize, table

SEED = 20240
#: Buckets of a leaf's order (as a power of two) at least, and rows of the largest leaf's buckets on average.
BUCKET_BITS, BUCKET_ROWS = 12, 4096
LEVELS = ["domain", "lang", "source"]

#: Production weights (whole numbers); a node that isn't named weighs 1. Sources of a language weigh alike.
DOMAIN_WEIGHTS = {"web": 40, "books": 20, "news": 25, "reference": 15}
LANGUAGE_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
BUDGET_PERCENT, MAX_EPOCHS = 60, 2

_WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _WORD_GAP), lambda w: w != "")).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source, by its number modulo 4; sources without a number are ``web``."""
    number = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 4
    return F.element_at(F.array(*map(F.lit, DOMAIN_WEIGHTS)), (number + 1).cast("int"))


def _weight(name: Column, weights: dict[str, int]) -> Column:
    found = F.lit(1)
    for key, value in weights.items():
        found = F.when(name == key, F.lit(value)).otherwise(found)
    return found.cast("long")


def _share(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """``nodes`` with ``share``, from their ``weight`` and ``cap`` and the budget of their parent."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *LEVELS[: len(parent) + 1])
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.withColumn("level", (budget - before) / rest)
    full = F.max("level").over(Window.partitionBy(*parent))
    return level.withColumn("share", F.least(F.col("cap").cast("double"), F.col("weight") * full)).drop("level")


def targets(leaves: DataFrame, percent: int, max_epochs: int) -> DataFrame:
    """Tokens to take of each leaf of ``(domain, lang, source, supply)``: ``target, passes, rest``."""
    caps = leaves.withColumn("cap", F.col("supply") * max_epochs)
    budget = F.lit(float((leaves.agg(F.sum("supply").alias("n")).first()["n"] or 0) * percent / 100))  # one number
    top = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("domain"), DOMAIN_WEIGHTS))
    top = _share(top, [], budget).select("domain", F.col("share").alias("domain_share"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("lang"), LANGUAGE_WEIGHTS))
    mid = _share(mid.join(top, "domain"), ["domain"], F.col("domain_share")).select("domain", "lang", F.col("share").alias("lang_share"))
    low = _share(caps.withColumn("weight", F.lit(1).cast("long")).join(mid, ["domain", "lang"]), ["domain", "lang"], F.col("lang_share"))
    target = F.floor("share").cast("long")
    passes = F.when(F.col("supply") > 0, F.floor(target / F.col("supply"))).otherwise(0).cast("long")
    return low.select(*LEVELS, "supply", target.alias("target"), passes.alias("passes"), (target - passes * F.col("supply")).alias("rest"))


def _key(seed: int, passes: Column, name: Column) -> Column:
    """A document's place in the seeded order of a pass: 60 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), passes.cast("string"), name).cast("binary")), 1, 15), 16, 10).cast("long")


def _text_name(text: Column) -> Column:
    """What a document without an id is known by."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _leaf(docs: DataFrame) -> list[Column]:
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return [domain_of(docs["source"]), unknown(docs["lang"]), unknown(docs["source"])]


def _placed(docs: DataFrame, percent: int, max_epochs: int, seed: int) -> DataFrame:
    """``doc_id``, leaf, ``tokens``, ``passes``, ``key``, and ``left``: what of the last pass's tokens is left before the document."""
    nameless = F.when(F.col("doc_id").isNull(), _text_name(F.col("text")))
    own = docs.select("doc_id", *[c.alias(n) for c, n in zip(_leaf(docs), LEVELS)], words(F.col("text")).alias("tokens"), nameless.alias("text_md5"))
    own = materialize(own, "tokens")
    supply = materialize(own.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count("*").alias("n")), "supply")
    most = supply.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]  # one number
    bits = min(32, max(BUCKET_BITS, (most // BUCKET_ROWS).bit_length()))
    leaves = materialize(targets(supply.drop("n"), percent, max_epochs), "targets")
    # Leaves are few beside documents; Spark broadcasts them where their size is below its limit.
    place = _key(seed, F.col("passes"), F.coalesce(F.col("doc_id").cast("string"), F.col("text_md5")))
    dealt = own.join(leaves.where("target > 0"), LEVELS).withColumn("key", place).withColumn("bucket", F.shiftright("key", 60 - bits)).drop("text_md5")
    before = lambda *by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("n")).withColumn("group", F.shiftright("bucket", bits // 2))
    sums = materialize(sums, "buckets")
    groups = sums.groupBy(*LEVELS, "group").agg(F.sum("n").alias("n"))
    groups = groups.select(*LEVELS, "group", F.coalesce(F.sum("n").over(before(*LEVELS, order=["group"])), F.lit(0)).alias("groups_ahead"))
    sums = sums.withColumn("ahead", F.coalesce(F.sum("n").over(before(*LEVELS, "group", order=["bucket"])), F.lit(0)))
    sums = sums.join(groups, [*LEVELS, "group"]).select(*LEVELS, "bucket", (F.col("ahead") + F.col("groups_ahead")).alias("ahead"))
    inside = F.coalesce(F.sum("tokens").over(before(*LEVELS, "bucket", order=["key", "doc_id", "tokens"])), F.lit(0))
    placed = dealt.withColumn("inside", inside).join(sums, [*LEVELS, "bucket"])
    return placed.select("doc_id", *LEVELS, "tokens", "passes", "key", (F.col("rest") - F.col("ahead") - F.col("inside")).alias("left"))


def mix(docs: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, domain, lang, source, epoch, tokens, taken``: one row for each pass that takes of a document.

    ``percent`` of all tokens (words) is the budget. ``taken`` is less than ``tokens`` for the one document of a leaf in
    which its target ends. Null languages and sources are the leaf ``unknown``; null and empty texts have no tokens and
    come with whole passes, or where the prefix goes on after them. Repeated rows are documents of their own; ties of the
    seeded order go by id and length. Documents without an id are ordered by their text. Other columns aren't read. An
    empty table gives an empty result.
    """
    placed = _placed(docs, percent, max_epochs, seed).drop("key")
    each = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    whole = F.col("epoch") < F.col("passes")
    return each.where(whole | (F.col("left") > 0)).select(
        "doc_id", *LEVELS, F.col("epoch").cast("int").alias("epoch"), "tokens", F.when(whole, F.col("tokens")).otherwise(F.least("tokens", "left")).cast("long").alias("taken")
    )


def selected(docs: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mixture takes of, all columns kept, a row as often as it has passes.

    The text of the document in which a leaf's target ends is cut to the words that are taken (and ``n_chars`` counted
    again if there is one). A leaf's prefix ends at a place of its order, so a document is judged where it lies, by its
    leaf's row; texts aren't moved. Rows that tie at that place (repeated rows) are taken as many as the target needs.
    """
    placed = materialize(_placed(docs, percent, max_epochs, seed), "placed")
    at = F.struct("key", "doc_id", "tokens")
    ends = placed.where("left > 0").groupBy(*LEVELS).agg(F.max(at).alias("end"), F.max("passes").alias("p"))
    tied = placed.join(ends.drop("p"), LEVELS).where(at.eqNullSafe(F.col("end"))).groupBy(*LEVELS)
    tied = tied.agg(F.count_if(F.col("left") > 0).alias("ties"), F.count("*").alias("all_ties"), F.min(F.when(F.col("left") > 0, F.col("left"))).alias("end_left"))
    ends = ends.drop("p").join(tied, LEVELS)
    leaves = placed.groupBy(*LEVELS).agg(F.max("passes").alias("passes")).join(ends, LEVELS, "left")
    key, now, row = fresh(docs, "taken_key"), fresh(docs, "taken_now"), fresh(docs, "taken_leaf")
    leaves = materialize(leaves.select(F.struct(*LEVELS).alias("of"), F.struct("passes", "end", "ties", "all_ties", "end_left").alias(row)), "ends")
    held = docs.join(leaves, F.struct(*[c.alias(n) for c, n in zip(_leaf(docs), LEVELS)]) == leaves["of"]).drop("of")
    held = held.withColumn(key, _key(seed, F.col(row)["passes"], F.coalesce(docs["doc_id"].cast("string"), _text_name(docs["text"]))))
    end = F.col(row)["end"]
    # the words are counted only where ids tie as well
    own = F.struct(F.col(key).alias("key"), docs["doc_id"].alias("doc_id"), F.when(F.col(key) == end["key"], words(docs["text"])).otherwise(F.lit(0).cast("long")).alias("tokens"))
    held = held.withColumn(now, F.when(end.isNull(), F.lit(1)).when(own < end, F.lit(-1)).when(own.eqNullSafe(end), F.lit(0)).otherwise(F.lit(1)))

    def taken(rows: DataFrame, place: Column) -> DataFrame:
        """``place`` is -1 before the end of the prefix, 0 at it, 1 after."""
        copies = F.col(row)["passes"] + F.when(F.col(now) <= 0, 1).otherwise(0)
        rows = rows.withColumn(now, place).withColumn(key, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))))
        first = F.array_join(F.slice(F.filter(F.split("text", _WORD_GAP), lambda w: w != ""), 1, F.col(row)["end_left"].cast("int")), " ")
        is_cut = (F.col(now) == 0) & (F.col(key) > F.col(row)["passes"]) & (F.col(row)["end_left"] < end["tokens"])
        text = F.when(is_cut, first).otherwise(F.col("text")).alias("text")
        size = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
        return rows.select(*[text if c == "text" else F.when(is_cut, size[c]).otherwise(F.col(c)).alias(c) if c in size else F.col(c) for c in docs.columns])

    several = F.coalesce(F.col(row)["all_ties"] > 1, F.lit(False)) & (F.col(now) == 0)
    alone = taken(held.where(~several), F.col(now))
    if leaves.where(F.col(row)["all_ties"] > 1).isEmpty():
        return alone
    turn = F.row_number().over(Window.partitionBy(F.col(row)["end"]).orderBy(F.lit(1)))
    place = F.when(F.col(now) < F.col(row)["ties"], -1).when(F.col(now) == F.col(row)["ties"], 0).otherwise(1)
    ties = held.where(several).withColumn(now, turn)
    return alone.unionAll(taken(ties, place))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _share_sql(parent: str, names: str, budget: str) -> str:
    by = f"PARTITION BY {parent} " if parent else ""
    return f"""({budget} - coalesce(sum(cap) OVER ({by}ORDER BY cap / weight, {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER ({by}ORDER BY cap / weight, {names} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level"""


SQL = f"""
WITH own AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name, list_extract([{', '.join(f"'{d}'" for d in DOMAIN_WEIGHTS)}],
         CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 4 + 1 AS INT)) AS domain,
       coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
caps AS (SELECT domain, lang, source, sum(tokens) AS supply, CAST(sum(tokens) * {MAX_EPOCHS} AS DOUBLE) AS cap FROM own GROUP BY ALL),
b AS (SELECT CAST(sum(supply) * {BUDGET_PERCENT} AS DOUBLE) / 100 AS budget FROM caps),
t1 AS (SELECT domain, sum(cap) AS cap, CAST({_case('domain', DOMAIN_WEIGHTS)} AS DOUBLE) AS weight FROM caps GROUP BY domain),
t2 AS (SELECT t1.*, {_share_sql('', 'domain', 'budget')} FROM t1, b),
t3 AS (SELECT domain, least(cap, weight * max(level) OVER ()) AS domain_share FROM t2),
m1 AS (SELECT domain, lang, sum(cap) AS cap, CAST({_case('lang', LANGUAGE_WEIGHTS)} AS DOUBLE) AS weight FROM caps GROUP BY domain, lang),
m2 AS (SELECT m1.*, {_share_sql('domain', 'lang', 'domain_share')} FROM m1 JOIN t3 USING (domain)),
m3 AS (SELECT domain, lang, least(cap, weight * max(level) OVER (PARTITION BY domain)) AS lang_share FROM m2),
s1 AS (SELECT caps.*, CAST(1 AS DOUBLE) AS weight, lang_share FROM caps JOIN m3 USING (domain, lang)),
s2 AS (SELECT s1.*, {_share_sql('domain, lang', 'source', 'lang_share')} FROM s1),
s3 AS (SELECT domain, lang, source, supply, CAST(floor(least(cap, weight * max(level) OVER (PARTITION BY domain, lang))) AS BIGINT) AS target FROM s2),
leaf AS (SELECT *, CASE WHEN supply > 0 THEN CAST(target // supply AS BIGINT) ELSE 0 END AS passes FROM s3 WHERE target > 0),
keyed AS (SELECT own.*, passes, target - passes * supply AS rest,
         CAST('0x' || substr(md5('{SEED}:' || passes || ':' || name), 1, 15) AS BIGINT) AS key FROM own JOIN leaf USING (domain, lang, source)),
placed AS (SELECT *, rest - coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain FROM keyed),
each AS (SELECT *, unnest(generate_series(0, passes)) AS epoch FROM placed)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, tokens,
       CAST(CASE WHEN epoch < passes THEN tokens ELSE least(tokens, remain) END AS BIGINT) AS taken
FROM each WHERE epoch < passes OR remain > 0
"""
