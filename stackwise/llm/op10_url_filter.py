"""URL filtering by fixed rules and a path-template tree per host, in DataFrame operations only.

A url is split into host and path.  A fixed rule (host suffix and path prefix) decides where one fits; the longest
one wins.  All other urls are judged by the template of their path: per host, each path segment descends one level.
Segments of digits are variable at once; so is every other segment value that has under ``MIN_SHARE`` of its branch,
in a branch with more than ``MAX_CHILDREN`` values.  Variable values become ``*``.  Sibling branches whose rate of bad
labels does not differ from the pooled rest of their parent (two-proportion z of ``MERGE_Z`` at most; equal rates never
differ, those of 0 and 1 included) are merged into ``*`` as well.  A template is rejected if its smoothed purity ``(bad + PRIOR * base) / (labelled + PRIOR)`` reaches ``REJECT``.

The tree is built from counts only: one aggregation by (host, path prefix) for each level, so a hot host is summed up
before its counts move, and no url is ever gathered with others of its host: what a hot branch, template or path gets to
know is broadcast to its rows (``common.spread_join``).  It goes as deep as the paths do.  A path
takes part until it ends or is alone in its branch, where nothing can change any more, so one long url costs no rounds.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the verdict of the empty
template.  A null page_id or a repeated row is judged like any other.  Labels are pairs (page_id, bad); unlabelled
pages count in no purity.  Without labels nothing is rejected.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, spread_join

#: Fixed rules: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Levels that the SQL writes out.  The operator has no such limit; the two agree where no path has more segments.
DEPTH = 4
MAX_CHILDREN, MIN_SHARE = 8, 0.05
MERGE_Z = 1.96
PRIOR, REJECT, LEAST_LABELLED = 10.0, 0.7, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased.  Path: then up to ``? #`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host, path, rules=RULES):
    """``(rule, verdict)`` of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, suffix, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(suffix + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _segments(path):
    """All segments; digits are variable at once, a suffix like ``.html`` stays."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "*"))


def _generalise(paths: DataFrame, level: int, rows: int) -> DataFrame:
    """Replace the segment of one level by ``*`` where it is variable or its branch is like its siblings.

    ``paths``: distinct ``(host, raw, segments, n, labelled, bad)`` with more than ``level`` segments; the prefix above
    ``level`` is already a template.  ``rows``: how many paths there are at most.  ``settled`` in the result: the path has no further level, or no other path shares
    its branch.
    """
    here = paths.withColumn("parent", F.expr(f"slice(segments, 1, {level})")).withColumn(
        "value", F.expr(f"get(segments, {level})")
    )
    counts = (
        here.groupBy("host", "parent", "value")
        .agg(F.count(F.lit(1)).alias("paths"), F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    )
    totals = counts.groupBy(F.col("host").alias("h"), F.col("parent").alias("p")).agg(
        F.count(F.lit(1)).alias("children"),
        F.sum("paths").alias("all_paths"),
        F.sum("n").alias("all_n"),
        F.sum("labelled").alias("all_labelled"),
        F.sum("bad").alias("all_bad"),
    )
    joined = spread_join(counts, totals, {"host": "h", "parent": "p"}, "children", rows)
    rest = F.col("all_labelled") - F.col("labelled")
    share = F.try_divide
    pooled = share(F.col("all_bad"), F.col("all_labelled"))
    spread = F.sqrt(pooled * (1 - pooled) * (share(F.lit(1.0), F.col("labelled")) + share(F.lit(1.0), rest)))
    apart = F.abs(share(F.col("bad"), F.col("labelled")) - share(F.col("all_bad") - F.col("bad"), rest))
    alike = (F.col("labelled") >= LEAST_LABELLED) & (rest >= LEAST_LABELLED) & (apart <= MERGE_Z * spread)
    rare = (F.col("children") > MAX_CHILDREN) & (F.col("n") < MIN_SHARE * F.col("all_n"))
    wild = joined.select(
        F.col("h").alias("_h"),
        F.col("p").alias("_p"),
        F.col("value").alias("_v"),
        F.when((F.col("children") > 1) & (rare | F.coalesce(alike, F.lit(False))), F.lit("*"))
        .otherwise(F.col("value"))
        .alias("_to"),
        (F.col("all_paths") == 1).alias("_alone"),
        F.col("paths").alias("_paths"),
    )
    out = spread_join(here, wild, {"host": "_h", "parent": "_p", "value": "_v"}, "_paths", rows)
    changed = F.concat(F.col("parent"), F.array("_to"), F.expr(f"slice(segments, {level + 2}, size(segments))"))
    settled = F.col("_alone") | (F.size("segments") <= level + 1)
    return out.select("host", "raw", changed.alias("segments"), "n", "labelled", "bad", settled.alias("settled"))


def template_verdicts(urls: DataFrame) -> DataFrame:
    """``(host, raw, template, verdict, n)`` for each distinct host and segment list of ``urls`` (host, raw, bad), ``n`` times there."""
    scratch = Scratch(urls.sparkSession, "url")
    label = F.col("bad").isNotNull().cast("long")
    paths = urls.groupBy("host", "raw").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad")
    )
    settled = (F.size("raw") == 0).alias("settled")
    paths = scratch.table(paths.select("host", "raw", F.col("raw").alias("segments"), "n", "labelled", "bad", settled))
    rows = paths.count()
    done, level = paths.filter("settled"), 0
    while not (paths := paths.filter("NOT settled")).isEmpty():
        paths = scratch.table(_generalise(paths.drop("settled"), level, rows))
        done, level = done.unionByName(paths.filter("settled")), level + 1
    paths = scratch.table(done.drop("settled"))
    base = paths.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("base"))
    purity = (F.col("bad") + PRIOR * F.col("base")) / (F.col("labelled") + PRIOR)
    leaves = (
        paths.groupBy(F.col("host").alias("_host"), F.col("segments").alias("_template"))
        .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("_paths"))
        .join(F.broadcast(base))  # one row
        .select("_host", "_template", F.when(purity >= REJECT, "block").otherwise("allow").alias("verdict"), "_paths")
    )
    return spread_join(paths, leaves, {"host": "_host", "segments": "_template"}, "_paths", rows).select(
        "host", "raw", F.concat(F.lit("/"), F.array_join("segments", "/")).alias("template"), "verdict", "n"
    )


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` for every row of ``pages``; ``labels``: ``(page_id, bad)``."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("raw", _segments(F.col("path")))
    known = labels.groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").cast("int").alias("bad"))
    marked = urls.join(known, F.col("page_id") == F.col("_id"), "left").select("host", "raw", "bad")
    found = Scratch(pages.sparkSession, "url").table(template_verdicts(marked))
    found = found.select(F.col("host").alias("_h"), F.col("raw").alias("_r"), "template", F.col("verdict").alias("_method"), F.col("n").alias("_n"))
    rule, ruled = rule_of(F.col("host"), F.col("path"))
    return spread_join(urls, found, {"host": "_h", "raw": "_r"}, "_n", pages.count()).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, F.col("_method")).alias("verdict"), "template"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page is bad if the label with its id says toxic or low quality."""
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad")
    )
    return judge(read_table(spark, sf_dir, "pages"), labels)


def _oracle() -> str:
    """The same tree in SQL, one pair of CTEs for each level."""
    rule = verdict = "NULL"
    for kind, suffix, prefix in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = f"(host = '{suffix}' OR ends_with(host, '.{suffix}')) AND starts_with(path, '{prefix}')"
        rule = f"CASE WHEN {fits} THEN '{suffix}{prefix}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    levels = ""
    for k in range(DEPTH):
        t = "p0" if k == 0 else f"p{k}"
        levels += f"""
, h{k} AS (SELECT *, segments[1:{k}] AS parent, segments[{k + 1}] AS value FROM {t})
, c{k} AS (SELECT host, parent, value, sum(n) n, sum(labelled) labelled, sum(bad) bad FROM h{k} WHERE value IS NOT NULL GROUP BY ALL)
, t{k} AS (SELECT host, parent, count(*) children, sum(n) all_n, sum(labelled) all_labelled, sum(bad) all_bad FROM c{k} GROUP BY ALL)
, s{k} AS (SELECT c.host, c.parent, c.value, children, n, all_n, labelled, all_labelled - labelled AS rest, bad, all_bad,
    CASE WHEN all_labelled > 0 THEN all_bad / all_labelled END AS pooled FROM c{k} c JOIN t{k} t ON c.host = t.host AND c.parent = t.parent)
, z{k} AS (SELECT *, CASE WHEN labelled >= {LEAST_LABELLED} AND rest >= {LEAST_LABELLED}
    THEN sqrt(pooled * (1 - pooled) * (1.0 / labelled + 1.0 / rest)) END AS spread FROM s{k})
, w{k} AS (SELECT host, parent, value, CASE WHEN children > 1 AND ((children > {MAX_CHILDREN} AND n < {MIN_SHARE} * all_n)
    OR coalesce(abs(bad / labelled - (all_bad - bad) / rest) <= {MERGE_Z} * spread, false)) THEN '*' ELSE value END AS goes FROM z{k})
, p{k + 1} AS (SELECT h.host, h.raw, CASE WHEN goes IS NULL THEN segments ELSE list_concat(list_concat(h.parent, [goes]), segments[{k + 2}:]) END AS segments,
    n, labelled, bad FROM h{k} h LEFT JOIN w{k} w ON h.host = w.host AND h.parent = w.parent AND h.value = w.value)"""
    last = f"p{DEPTH}"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)
, u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r)
, v AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> '')[1:{DEPTH}], lambda x: regexp_replace(x, '[0-9]+', '*', 'g')) AS raw FROM u)
, l AS (SELECT doc_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels GROUP BY 1)
, m AS (SELECT host, raw, l.bad FROM v LEFT JOIN l ON page_id = doc_id)
, p0 AS (SELECT host, raw, raw AS segments, count(*)::DOUBLE n, count(bad)::DOUBLE labelled, sum(coalesce(bad, 0))::DOUBLE bad FROM m GROUP BY host, raw){levels}
, b AS (SELECT sum(bad) / nullif(sum(labelled), 0) AS base FROM {last})
, f AS (SELECT host, segments, sum(bad) bad, sum(labelled) labelled FROM {last} GROUP BY ALL)
, g AS (SELECT host, segments, CASE WHEN (bad + {PRIOR} * base) / (labelled + {PRIOR}) >= {REJECT} THEN 'block' ELSE 'allow' END AS method FROM f, b)
SELECT v.page_id, v.host, v.path, {rule.replace("host", "v.host").replace("path", "v.path")} AS rule,
  coalesce({verdict.replace("host", "v.host").replace("path", "v.path")}, method) AS verdict, '/' || array_to_string(q.segments, '/') AS template
FROM v LEFT JOIN {last} q ON v.host = q.host AND v.raw = q.raw LEFT JOIN g ON q.host = g.host AND q.segments = g.segments
"""


ORACLE = _oracle()
