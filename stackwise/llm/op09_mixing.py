"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The corpus is a tree: domain, language, source.  A token budget flows down from the root in proportion to the weights.
A branch can take at most ``max_epochs`` times the tokens below it.  What it cannot take goes to its siblings, again in
proportion to their weights, and only what all siblings together cannot take is missing one level up (water filling
with the capacity of each subtree, one window per level).  Each leaf then takes whole epochs of its documents and a
prefix of one more epoch, whose order is the SHA-256 of seed, epoch and id.

A leaf is never ordered as a whole: its documents fall into buckets of that hash, sums of tokens per bucket tell which
bucket holds the end of the prefix, and only the documents of this one bucket are ordered.

Defined results: tokens of a document are its words (runs of other than 0x20 and 0x09 to 0x0D) plus one for its end, so
null and empty texts count one token.  Null language or source is the branch ``unknown``.  Unlisted weights are
``OTHER_WEIGHT``.  Null ids take part under the name ``null``; repeated rows are separate documents.  An empty table
gives an empty result.  Columns of the input keep their values whatever their names; only one named like the epoch column is replaced.  A document that would pass the budget's end is left out, and the prefix ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, read_table, text_or_empty

DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
OTHER_WEIGHT = 0.1
SHARE, MAX_EPOCHS, SEED = 0.8, 2, 17
#: Rows that one bucket of a leaf should hold, and leaves or cells up to which a small table is broadcast.
BUCKET_ROWS, SMALL_ROWS = 2_000, 100_000
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """Sources whose names end in a number form four domains; all others are the domain ``other``."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.substr(number, F.lit(-9)).try_cast("long") % 4).cast("string"))).otherwise("other")


def token_count(text_col: str = "text") -> Column:
    return (F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _weight(column: str, weights: dict[str, float]) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``got``: the part of the parent's ``budget`` for each node with ``weight`` and capacity ``cap``."""
    up = W.partitionBy(*parent).orderBy("ratio", name)
    nodes = (
        nodes.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("r", F.row_number().over(up))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_from"))
        .withColumn("sated", F.col("ratio") <= F.col("level"))
    )
    level = F.min(F.when(~F.col("sated"), F.struct("r", "level"))).over(W.partitionBy(*parent))
    got = F.when(F.col("sated"), F.col("cap")).otherwise(F.col("weight") * level["level"])
    return nodes.withColumn("got", got).drop("ratio", "r", "full_before", "weight_from", "level", "sated")


def leaf_targets(leaves: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with whole epochs ``full`` and tokens ``rest`` of one more."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    budget = leaves.agg((F.sum("tokens") * F.lit(share)).alias("budget"))
    above, keys = budget, []
    for level, weights in zip(LEVELS, (DOMAIN_WEIGHTS, LANG_WEIGHTS, {}), strict=True):
        nodes = leaves.groupBy(*keys, level).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(above, keys) if keys else nodes.crossJoin(F.broadcast(above))  # the root is one row
        nodes = nodes.withColumn("weight", _weight(level, weights))
        # The window of the top level is over the domains only, one row each.
        filled = water_fill(nodes.withColumn("top", F.lit(0)), ["top", *keys], level)
        keys = [*keys, level]
        above = filled.select(*keys, F.col("got").alias("budget"))
    target = F.floor(F.col("budget") + 1e-6)
    return leaves.join(above, list(LEVELS)).select(
        *LEVELS,
        F.floor(target / F.col("tokens")).alias("full"),
        (target % F.col("tokens")).alias("rest"),
    )


def _key(seed: int, id_col: str) -> Column:
    """The place of a document in the last epoch of its leaf."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), (F.col("_full") + 1).cast("string"), name), 256)


def _placed(docs: DataFrame, id_col: str) -> DataFrame:
    """``_row, _id, _text`` of ``docs`` with its leaf: ``_domain, _lang, _source``."""
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    leaf = [domain_of(source).alias("_domain"), F.coalesce(F.col("lang"), F.lit("unknown")).alias("_lang"), source.alias("_source")]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col("text").alias("_text"), *leaf)


def leaf_cuts(docs: DataFrame, share: float, max_epochs: int, seed: int, id_col: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """``_domain, _lang, _source, _full, _cut`` and the number of leaves.

    A document is in the epochs 1 to ``_full`` of its leaf, and in one more if its key there is at most ``_cut``.
    """
    base = scratch.table(
        _placed(docs, id_col).select(
            F.col("_id").alias("doc_id"),
            *[F.col(f"_{level}").alias(level) for level in LEVELS],
            token_count("_text").alias("tokens"),
        )
    )
    leaves = base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = scratch.table(leaves)
    n_leaves, most = leaves.agg(F.count(F.lit(1)), F.max("rows")).first()
    digits = 0
    while (most or 0) / 16**digits > BUCKET_ROWS:
        digits += 1
    targets = scratch.table(leaf_targets(leaves.drop("rows"), share, max_epochs))
    part = base.join(checked_broadcast(targets, n_leaves, SMALL_ROWS), list(LEVELS)).filter("rest > 0")
    part = part.withColumnRenamed("full", "_full").withColumn("key", _key(seed, "doc_id"))
    part = part.withColumn("bucket", F.substring("key", 1, digits))
    cells = part.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("held"))
    below = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("held").over(below), F.lit(0)))
    cells = cells.join(targets.select(*LEVELS, "rest"), list(LEVELS))
    edges = scratch.table(cells.filter("before <= rest AND before + held > rest").select(*LEVELS, "bucket", "before"))  # one per leaf
    edge = part.join(checked_broadcast(edges, n_leaves, SMALL_ROWS), [*LEVELS, "bucket"])
    # Equal keys are rows of one id: they are in or out together.
    order = W.partitionBy(*LEVELS, "bucket").orderBy("key").rangeBetween(W.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("tokens").over(order)
    last = edge.withColumn("upto", upto).filter("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    # Where no document of the edge bucket fits, the bucket's prefix is the cut: it is below all keys in the bucket.
    cuts = targets.join(edges, list(LEVELS), "left").join(last, list(LEVELS), "left")
    cuts = cuts.select(*[F.col(level).alias(f"_{level}") for level in LEVELS], F.col("full").alias("_full"), F.coalesce("last", "bucket").alias("_cut"))
    return scratch.table(cuts), n_leaves


def _chosen(docs: DataFrame, share: float, max_epochs: int, seed: int, id_col: str) -> DataFrame:
    """The selected rows of ``docs`` as ``_placed`` has them, with ``_epoch``: one row for each epoch it is in.

    Texts don't shuffle: a row's fate follows from its leaf and its own key.
    """
    cuts, n_leaves = leaf_cuts(docs, share, max_epochs, seed, id_col, Scratch(docs.sparkSession, "mix"))
    names = [f"_{level}" for level in LEVELS]
    rows = _placed(docs, id_col).join(checked_broadcast(cuts, n_leaves, SMALL_ROWS), names)
    whole = F.when(F.col("_full") > 0, F.sequence(F.lit(1), F.col("_full").cast("int"))).otherwise(F.array().cast("array<int>"))
    more = F.when(_key(seed, "_id") <= F.col("_cut"), F.array((F.col("_full") + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("_epoch", F.explode(F.concat(whole, more)))


def select_epochs(
    docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", epoch_col: str | None = "epoch"
) -> DataFrame:
    """The selected rows of ``docs``, all columns as they were, and the epoch in ``epoch_col`` (none if that is None).

    A column of ``docs`` that has the name ``epoch_col`` is replaced.
    """
    out = _chosen(docs, share, max_epochs, seed, id_col)
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c != epoch_col]
    return out.select(*kept, *([F.col("_epoch").alias(epoch_col)] if epoch_col else []))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """One row per selected document and epoch: ``doc_id, domain, lang, source, tokens, epoch``."""
    return _chosen(docs, share, max_epochs, seed, id_col).select(
        F.col("_id").alias("doc_id"),
        *[F.col(f"_{level}").alias(level) for level in LEVELS],
        token_count("_text").alias("tokens"),
        F.col("_epoch").alias("epoch"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def oracle(table: str = "documents", share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The same selection in SQL over the view ``table``."""

    def case(column: str, weights: dict[str, float]) -> str:
        return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {OTHER_WEIGHT} END" if weights else f"{OTHER_WEIGHT}"

    ctes, keys, above = "", [], "root"
    for level, weights in zip(LEVELS, (DOMAIN_WEIGHTS, LANG_WEIGHTS, {}), strict=True):
        on = " AND ".join(f"n.{k} = u.{k}" for k in keys) or "true"
        parts = f"PARTITION BY {', '.join(keys)}" if keys else ""
        group = ", ".join([*keys, level])
        ctes += f"""
, n_{level} AS (SELECT {group}, sum(cap) AS cap, ({case(level, weights)})::DOUBLE AS weight FROM leaves GROUP BY {group})
, b_{level} AS (SELECT n.*, u.budget, cap / weight AS ratio FROM n_{level} n JOIN {above} u ON {on})
, l_{level} AS (SELECT *, row_number() OVER w AS r,
    (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM b_{level} WINDOW w AS ({parts} ORDER BY ratio, {level}))
, s_{level} AS (SELECT *, ratio <= level AS sated FROM l_{level})
, g_{level} AS (SELECT {group}, CASE WHEN sated THEN cap ELSE weight * min_by(level, r) FILTER (NOT sated) OVER ({parts}) END AS budget FROM s_{level})"""
        keys, above = [*keys, level], f"g_{level}"
    by = ", ".join(LEVELS)
    return f"""
WITH base AS (SELECT doc_id, lang0 AS lang, source0 AS source, tokens,
    CASE WHEN num <> '' THEN 'd' || (right(num, 9)::BIGINT % 4) ELSE 'other' END AS domain
  FROM (SELECT doc_id, coalesce(lang, 'unknown') AS lang0, coalesce(source, 'unknown') AS source0,
    regexp_extract(coalesce(source, 'unknown'), '([0-9]+)$', 1) AS num,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens FROM {table}))
, leaves AS (SELECT {by}, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {max_epochs})::DOUBLE AS cap FROM base GROUP BY {by})
, root AS (SELECT sum(tokens) * {share}::DOUBLE AS budget FROM leaves){ctes}
, goal AS (SELECT l.*, floor(budget + 1e-6)::BIGINT AS target FROM leaves l JOIN {above} USING ({by}))
, aim AS (SELECT {by}, target // tokens AS full_epochs, target % tokens AS rest FROM goal)
, d AS (SELECT base.*, full_epochs, rest, sha256('{seed}:' || (full_epochs + 1) || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM base JOIN aim USING ({by}))
, c AS (SELECT *, sum(tokens) OVER (PARTITION BY {by} ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM d)
SELECT doc_id, {by}, tokens, unnest(range(1, full_epochs + 1))::INT AS epoch FROM d
UNION ALL SELECT doc_id, {by}, tokens, (full_epochs + 1)::INT AS epoch FROM c WHERE upto <= rest
"""


ORACLE = oracle()
