"""URL filters by a path-template tree, with fixed rules first; DataFrame functions only.

Rules. A rule (verdict, host + path) fits a url whose host is the rule's or one of its subdomains and whose path starts
with the rule's; of several the longest wins (of equal rules the first given).

Tree. Path segments are generalised by shape: hexadecimal keys of 16 and more become ``<h>``, runs of digits ``<n>``,
segments over 40 characters ``<x>``; a path has ``DEPTH`` levels, deeper segments, generalised alike, are one. Counts of pages, labelled
pages and bad ones are summed by host and shape first (partial sums before the shuffle, so a hot host costs each task
a row per shape); the tree is built from those. Level by level, a branch keeps its own place only if its bad share
differs from its pooled siblings' by a two-proportion test; similar and thin branches merge into ``*`` and have their
parent's bad share. (Rows of a hot host or branch that meet its one row in a join are split by adaptive execution.)
A branch of its own has its share smoothed towards its parent's, a host towards the overall one. A template is blocked when its
smoothed purity (share of good pages) is under ``PURITY``.

A page's label is found by the last number in its url's path. Null urls and urls without ``://`` have an empty host and
path, and a template like any other. Repeated rows count as often as they occur and get the same verdict. Without any
label nothing but rules blocks. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
DEPTH = 4
#: Labelled pages that a branch needs to stand alone; the square of the test's z; labelled pages that a parent's share weighs.
LEAST, Z2, WEIGHT = 20, 6.635, 10.0
PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of the longest fitting rule and its verdict, or null."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return functools.reduce(lambda a, b: F.coalesce(a, b), [*found, none])


def shape(path: Column) -> Column:
    """The generalised segments of a path; those from the last level on are one."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")
    general = lambda s: F.when(s.rlike("^[0-9a-f]{16,}$"), F.lit("<h>")).when(F.length(s) > 40, F.lit("<x>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))
    parts = F.transform(parts, general)
    tail = F.array(F.array_join(F.slice(parts, DEPTH, F.size(parts)), "/"))
    return F.when(F.size(parts) < DEPTH, parts).otherwise(F.concat(F.slice(parts, 1, DEPTH - 1), tail))


def templates(counted: DataFrame) -> DataFrame:
    """host, shape, template, bad_share of every row of ``counted`` (host, shape, labelled, bad; one row for a host and shape)."""
    whole = counted.agg(F.sum("bad"), F.sum("labelled")).first()  # one row
    overall = whole[0] / whole[1] if whole[1] else 0.0
    hosts = counted.groupBy("host").agg(F.sum("labelled").alias("l0"), F.sum("bad").alias("b0"))
    share = lambda b, n, p: (F.col(b) + F.lit(WEIGHT) * p) / (F.col(n) + F.lit(WEIGHT))
    hosts = hosts.select("host", share("b0", "l0", F.lit(overall)).alias("share"))
    now = counted.join(hosts, "host").withColumn("template", F.lit(""))
    for level in range(DEPTH):
        now = now.withColumn("seg", F.coalesce(F.get("shape", F.lit(level)), F.lit("$")))
        node = ["host", "template", "seg"]
        kids = now.groupBy(*node).agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"), F.max("share").alias("share"))
        parents = kids.groupBy("host", "template").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
        kids = kids.join(parents, ["host", "template"])
        rest_n, rest_b = F.col("pn") - F.col("n"), F.col("pb") - F.col("b")
        difference = F.col("b") / F.col("n") - rest_b / rest_n
        pooled = F.col("pb") / F.col("pn")
        own = (F.col("n") >= LEAST) & (rest_n >= LEAST)
        own = F.when(own, difference * difference >= F.lit(Z2) * pooled * (1 - pooled) * (1 / F.col("n") + 1 / rest_n)).otherwise(False)
        kids = kids.withColumn("label", F.when(F.col("seg") == "$", "$").when(own, F.col("seg")).otherwise("*"))
        nodes = kids.groupBy("host", "template", "label").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("share").alias("up"))
        nodes = nodes.select("host", "template", "label", F.when(F.col("label").isin("*", "$"), F.col("up")).otherwise(share("b", "n", F.col("up"))).alias("new_share"))
        known = kids.select(*node, "label").join(nodes, ["host", "template", "label"])
        now = now.join(known, node).select("host", "shape", "labelled", "bad", F.col("new_share").alias("share"), F.when(F.col("label") == "$", F.col("template")).otherwise(F.concat("template", F.lit("/"), "label")).alias("template"))
        if level < DEPTH - 1:
            now = written(now, "templates")
    return now.select("host", "shape", "template", F.col("share").alias("bad_share"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict and template, which replace columns of those names.

    labels: key long, bad int (0 or 1); of repeated keys the worst counts.
    """
    outputs = ("host", "path", "rule", "verdict", "template")
    kept = [c for c in pages.columns if c.lower() not in outputs]
    host, path = parsed(F.col(f"`{url_col}`"))
    read = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row_"), host.alias("host"), path.alias("path"))
    read = read.withColumn("shape", shape(F.col("path")))
    key = F.regexp_extract("path", "([0-9]+)[^0-9]*$", 1).try_cast("long")
    keyed = read.select("host", "shape", key.alias("key")).groupBy("host", "shape", "key").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("key is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    counted = keyed.join(marks, "key", "left").groupBy("host", "shape").agg(F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("n"))), F.lit(0)).alias("labelled"), F.coalesce(F.sum(F.col("n") * F.col("bad")), F.lit(0)).alias("bad"))
    found = written(templates(written(counted, "shapes")), "templates")
    fit = rule_of(F.col("host"), F.col("path"), rules)
    judged = read.join(found, ["host", "shape"], "left").withColumn("fit", fit)
    own = F.when(1 - F.col("bad_share") < PURITY, "block").otherwise("allow")
    return judged.select("row_.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "template")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge(pages, labels).select("page_id", "host", "path", "rule", "verdict", "template")


def oracle_sql() -> str:
    """The same in SQL, one common table expression for each level of the tree."""
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')", rule, verdict))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts, TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS key FROM p),
e AS (SELECT * EXCLUDE (parts), list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^[0-9a-f]{{16,}}$') THEN '<h>' WHEN length(x) > 40 THEN '<x>' ELSE regexp_replace(x, '[0-9]+', '<n>', 'g') END) AS parts FROM s),
g AS (SELECT *, list_concat(parts[1:{DEPTH - 1}], CASE WHEN len(parts) >= {DEPTH} THEN [array_to_string(parts[{DEPTH}:], '/')] ELSE [] END) AS shape FROM e),
m AS (SELECT doc_id AS key, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, shape, count(m.bad) AS labelled, coalesce(sum(m.bad), 0) AS bad FROM g LEFT JOIN m ON g.key = m.key GROUP BY host, shape),
o AS (SELECT CASE WHEN sum(labelled) > 0 THEN CAST(sum(bad) AS DOUBLE) / sum(labelled) ELSE 0 END AS overall FROM c),
t0 AS (SELECT c.*, (b0 + {WEIGHT}::DOUBLE * overall) / (l0 + {WEIGHT}::DOUBLE) AS share, '' AS template FROM c JOIN (SELECT host, sum(labelled) AS l0, sum(bad) AS b0 FROM c GROUP BY host) h USING (host), o)"""
    for i in range(DEPTH):
        sql += f""",
a{i} AS (SELECT *, coalesce(shape[{i + 1}], '$') AS seg FROM t{i}),
k{i} AS (SELECT host, template, seg, sum(labelled)::DOUBLE AS n, sum(bad)::DOUBLE AS b, max(share) AS share FROM a{i} GROUP BY host, template, seg),
q{i} AS (SELECT *, sum(n) OVER w AS pn, sum(b) OVER w AS pb FROM k{i} WINDOW w AS (PARTITION BY host, template)),
l{i} AS (SELECT *, CASE WHEN seg = '$' THEN '$' WHEN n >= {LEAST} AND pn - n >= {LEAST} AND (b / n - (pb - b) / (pn - n)) * (b / n - (pb - b) / (pn - n)) >= {Z2}::DOUBLE * (pb / pn) * (1 - pb / pn) * (1 / n + 1 / (pn - n)) THEN seg ELSE '*' END AS label FROM q{i}),
n{i} AS (SELECT host, template, label, CASE WHEN label IN ('*', '$') THEN max(share) ELSE (sum(b) + {WEIGHT}::DOUBLE * max(share)) / (sum(n) + {WEIGHT}::DOUBLE) END AS new_share FROM l{i} GROUP BY host, template, label),
t{i + 1} AS (SELECT a{i}.host, shape, labelled, bad, new_share AS share, CASE WHEN label = '$' THEN template ELSE template || '/' || label END AS template FROM a{i} JOIN (SELECT host, template, seg, label FROM l{i}) USING (host, template, seg) JOIN n{i} USING (host, template, label))"""
    return sql + f"""
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN 1 - share < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM g JOIN t{DEPTH} USING (host, shape)"""
