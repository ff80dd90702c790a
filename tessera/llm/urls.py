"""URL filtering by a tree of path templates, below fixed host rules.

For each host the paths form a tree of segments. A segment that looks like a number, a hash or a date is generalised by
its look; a node with many children of few pages each has all of them generalised, level by level, as long as a node has
pages enough for that. Then, from the deepest level up, sibling branches that go on alike and whose labelled purity is
statistically alike merge into one template. A template is rejected when its labelled purity, smoothed
towards the whole table's, is mostly bad. Everything is sums by key, so a host with most pages is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, table

#: (rule, verdict); a rule is a host and a path joined.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

#: Levels that the SQL goes down and merges; the operator has no such limit.
SQL_LEVELS = 8
#: A node with more children than this, of at most so many pages each on average, has them generalised.
MOST_CHILDREN, FEW_PAGES = 16, 4
#: Branches merge when their bad share is within so many standard errors of what they share.
ALIKE = 2
#: Weight of the whole table's bad share in a template's, in labelled pages; and the share that rejects.
SMOOTHING, REJECT_PERCENT = 4, 50

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Looks of a segment, the first that fits; the name stands in the template.
LOOKS = [("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"), ("^[0-9]+$", "{number}"), ("^[0-9]+[.][a-z]{1,5}$", "{number}.ext"), ("^[0-9a-f]{8,}(-[0-9a-f]{4,})*$", "{hash}")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    begin = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null: its host is the page's or a parent of it, its path a prefix."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _look(segment: Column) -> Column:
    found = segment
    for pattern, name in reversed(LOOKS):
        found = F.when(segment.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, host, path, template, bad`` for ``pages(page_id, host, path)`` and ``labels(label_id, bad)`` by page.

    ``bad`` is 1, 0 or null; a page with several labels is bad if any is. Templates are those of the tree, before merging.
    """
    label = labels.where("label_id IS NOT NULL").groupBy("label_id").agg(F.max("bad").alias("bad"))
    tree = pages.join(label, pages["page_id"] == F.col("label_id"), "left").drop("label_id")
    tree = tree.withColumn("cut", F.transform(F.split(F.substring("path", 2, 1 << 30), "/"), _look)).withColumn("template", F.lit(""))
    tree = materialize(tree, "segments")
    level = 0
    while True:
        here = tree.where(F.size("cut") > level)
        children = here.groupBy("host", "template", F.get("cut", F.lit(level)).alias("segment")).agg(F.count("*").alias("n"))
        nodes = materialize(children.groupBy("host", "template").agg(F.count("*").alias("c"), F.sum("n").alias("n")), "nodes")
        largest = nodes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]  # one number
        if largest <= MOST_CHILDREN:  # from here on no node can have too many children
            break
        wide = nodes.where((F.col("c") > MOST_CHILDREN) & (F.col("n") <= FEW_PAGES * F.col("c")))
        wide = wide.select(F.col("host").alias("wide_host"), F.col("template").alias("wide_template"))
        at_wide = (tree["host"] == F.col("wide_host")) & (tree["template"] == F.col("wide_template"))
        segment = F.when(F.col("wide_host").isNotNull(), F.lit("*")).otherwise(F.get("cut", F.lit(level)))
        step = F.when(F.size("cut") > level, F.concat(F.lit("/"), segment)).otherwise("")
        tree = materialize(tree.join(wide, at_wide, "left").withColumn("template", F.concat("template", step)).drop("wide_host", "wide_template"), "tree")
        level += 1
    rest = F.when(F.size("cut") > level, F.concat(F.lit("/"), F.array_join(F.slice("cut", level + 1, F.size("cut")), "/"))).otherwise("")
    return materialize(tree.select("page_id", "host", "path", F.concat("template", rest).alias("template"), "bad"), "templates")


def merged(tree: DataFrame) -> DataFrame:
    """``host, template, branch, n_labelled, n_bad`` for each template of a host.

    From the deepest level up: siblings have the same host and the same segments but that of the level. Their labels are
    pooled; one whose bad share lies within ``ALIKE`` standard errors of the pooled one is alike, and those alike become
    one branch (``*`` at the level), which goes up with the labels of all. A branch without labels is like its siblings;
    one without siblings stays as it is.
    """
    own = tree.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    own = materialize(own.withColumn("branch", F.col("template")), "branches")
    deepest = own.agg(F.coalesce(F.max(F.size(F.split("template", "/"))), F.lit(0)).alias("n")).first()["n"]  # one number
    for at in range(deepest, 1, -1):  # the first part of a template is empty
        part = F.split("branch", "/")
        starred = F.array_join(F.concat(F.slice(part, 1, at - 1), F.array(F.lit("*")), F.slice(part, at + 1, F.size(part))), "/")
        sums = own.groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        sums = sums.withColumn("star", F.when(F.size(part) >= at, starred).otherwise(F.col("branch")))
        pool = sums.groupBy("host", "star").agg(F.sum("n").alias("pool_n"), F.sum("b").alias("pool_b"), F.count("*").alias("members"))
        # (b/n - B/N)^2 <= ALIKE^2 * (B/N) * (1 - B/N) / n, in whole numbers
        n, b, of_n, of_b = (F.col(c).cast("double") for c in ("n", "b", "pool_n", "pool_b"))  # no overflow in a large table
        alike = F.pow(b * of_n - of_b * n, F.lit(2)) <= ALIKE * ALIKE * of_b * (of_n - of_b) * n
        moved = sums.join(pool, ["host", "star"]).where((F.col("members") > 1) & alike & (F.col("star") != F.col("branch"))).select("host", "branch", "star")
        own = materialize(own.join(moved, ["host", "branch"], "left").select("host", "template", "n", "b", F.coalesce("star", "branch").alias("branch")), "branches")
    both = own.groupBy("host", "branch").agg(F.sum("n").cast("long").alias("n_labelled"), F.sum("b").cast("long").alias("n_bad"))
    return own.select("host", "template", "branch").join(both, ["host", "branch"]).select("host", "template", "branch", "n_labelled", "n_bad")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, n_labelled, n_bad`` for each row of ``pages(page_id, url)``.

    The longest rule that fits decides; where none does, the page's template does. A null URL or one without
    ``://`` has an empty host and path, and the empty template. Null page ids have no labels. Repeated rows stay
    repeated (and their label counts for each). Other columns aren't read; an empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    tree = templates(pages.select("page_id", host.alias("host"), path.alias("path")), labels)
    branch = merged(tree).withColumnsRenamed({"host": "branch_host", "template": "branch_template"})
    whole = tree.agg(F.count("bad").alias("n"), F.sum("bad").alias("b")).first()  # two numbers: pages labelled, and bad
    joined = tree.join(branch, (tree["host"] == F.col("branch_host")) & (tree["template"] == F.col("branch_template")))
    # 100 * (bad + SMOOTHING * share) >= REJECT_PERCENT * (labelled + SMOOTHING), in whole numbers
    n, of = F.lit(max(1, whole["n"])).cast("decimal(19,0)"), F.col("n_labelled") + SMOOTHING
    reject = 100 * (F.col("n_bad") * n + SMOOTHING * (whole["b"] or 0)) >= REJECT_PERCENT * of * n
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(reject, "block").otherwise("allow")
    for name, said in rules:
        verdict = F.when(F.col("rule") == name, F.lit(said)).otherwise(verdict)
    return joined.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("branch").alias("template"), "n_labelled", "n_bad")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages: those of the document whose number ends the path. Bad is of low quality, or toxic."""
    _, path = parts(F.col("url"))
    number = F.regexp_extract(path, "/([0-9]{1,19})(?:[.][a-z]+)?/?$", 1).try_cast("long")
    shown = pages.select("page_id", number.alias("shown")).where("shown IS NOT NULL")
    marks = labels.select(F.col("doc_id").alias("shown"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return shown.join(marks, "shown").select(F.col("page_id").alias("label_id"), "bad")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, page_labels(pages, table(spark, sf_dir, "labels")))


def _level_sql(i: int) -> str:
    last = f"t{i}"
    return f"""
k{i} AS (SELECT host, tpl, count(*) AS c, sum(n) AS n FROM (SELECT host, tpl, s[{i + 1}] AS seg, count(*) AS n FROM {last} WHERE len(s) > {i} GROUP BY ALL) GROUP BY ALL),
t{i + 1} AS (SELECT t.* REPLACE (t.tpl || CASE WHEN len(s) <= {i} THEN '' WHEN k.c > {MOST_CHILDREN} AND k.n <= {FEW_PAGES} * k.c THEN '/*' ELSE '/' || s[{i + 1}] END AS tpl)
     FROM {last} t LEFT JOIN k{i} k ON k.host = t.host AND k.tpl = t.tpl),"""


def _merge_sql(at: int) -> str:
    last = f"m{at + 1}"
    return f"""
s{at} AS (SELECT host, branch, sum(n) AS n, sum(b) AS b, string_split(branch, '/') AS part FROM {last} GROUP BY host, branch),
x{at} AS (SELECT *, CASE WHEN len(part) >= {at} THEN array_to_string(list_concat(part[1:{at - 1}], ['*'], part[{at + 1}:]), '/') ELSE branch END AS star FROM s{at}),
p{at} AS (SELECT host, star, sum(n) AS pn, sum(b) AS pb, count(*) AS members FROM x{at} GROUP BY host, star),
v{at} AS (SELECT host, branch, star FROM x{at} JOIN p{at} USING (host, star) WHERE members > 1 AND (b * pn - pb * n) * (b * pn - pb * n) <= {ALIKE * ALIKE} * pb * (pn - pb) * n),
m{at} AS (SELECT m.* REPLACE (coalesce(star, m.branch) AS branch) FROM {last} m LEFT JOIN v{at} v ON v.host = m.host AND v.branch = m.branch),"""


def _sql() -> str:
    look = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for p, n in LOOKS)
    fits = []
    for rule, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{rule}'")
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    return f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM p),
lab AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM h JOIN labels l
        ON l.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,19}})(?:[.][a-z]+)?/?$', 1) AS BIGINT) GROUP BY page_id),
t0 AS (SELECT h.page_id, host, path, bad, '' AS tpl, list_transform(string_split(substr(path, 2), '/'), lambda x: CASE {look} ELSE x END) AS s FROM h LEFT JOIN lab ON lab.page_id = h.page_id),
{''.join(_level_sql(i) for i in range(SQL_LEVELS))}
t AS (SELECT page_id, host, path, bad, CASE {' '.join(fits)} END AS rule, tpl FROM t{SQL_LEVELS}),
m{SQL_LEVELS + 2} AS (SELECT host, tpl, tpl AS branch, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM t GROUP BY host, tpl),
{''.join(_merge_sql(at) for at in range(SQL_LEVELS + 1, 1, -1))}
m AS (SELECT host, branch, sum(n) AS n_labelled, sum(b) AS n_bad FROM m2 GROUP BY host, branch),
w AS (SELECT greatest(count(bad), 1) AS aln, coalesce(sum(bad), 0) AS alb FROM t),
o AS (SELECT page_id, t.host, path, rule, m.branch AS template, n_labelled, n_bad,
        100 * (n_bad * aln + {SMOOTHING} * alb) >= {REJECT_PERCENT} * (n_labelled + {SMOOTHING}) * aln AS reject
      FROM t JOIN m2 ON m2.host = t.host AND m2.tpl = t.tpl JOIN m ON m.host = m2.host AND m.branch = m2.branch, w)
SELECT page_id, host, path, rule, CASE rule {said} ELSE CASE WHEN reject THEN 'block' ELSE 'allow' END END AS verdict, template,
       CAST(n_labelled AS BIGINT) AS n_labelled, CAST(n_bad AS BIGINT) AS n_bad FROM o
"""


SQL = _sql()
