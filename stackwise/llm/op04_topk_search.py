"""Exact top-k search over binary codes by incremental multi-index hashing, in DataFrame operations.

A vector's code has one bit per dimension: whether it is above zero.  Codes are words of ``BITS`` bits, as many as the
longest vector of the table needs: a long if one does, else an array of longs.  Each word is cut into ``SEGMENTS``
substrings, and a code is posted under all of its ``s``.  Round ``r`` probes all substrings that differ from the query's
in exactly ``r`` bits.  A code at distance ``s * (r + 1) - 1`` or less agrees with the query up to ``r`` bits in some
segment, so after round ``r`` all such codes were met: a query whose kth verified distance is covered by that is done,
the others go on.

Equal codes are indexed once, with their ``k`` smallest ids, so a vector that repeats without end is one posting.  A
pair is taken in the first segment and round where it is met, and only if it is not beyond the kth distance so far.

Order: distance, then id; each row is its own neighbour at distance 0.  Defined results: rows with null id or null
vector do not take part.  NaN, null and missing components count as not above zero.  Repeated ids are separate rows.
With fewer than ``k`` rows all are returned.
"""

from __future__ import annotations

from functools import reduce
from math import comb
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read_table

BITS, SEGMENTS, K, EVERY = 64, 4, 10, 50
WIDTH = BITS // SEGMENTS
#: Probes that one task makes, about, and tasks that make them, at most.
PROBES, MOST_TASKS = 500_000, 10_000


def sign_code(vector: Column, words: int = 1) -> Column:
    """The code in ``words`` words; a vector that needs more is an error."""
    code = _word_code(vector, 0)
    if words > 1:
        code = F.when(vector.isNotNull(), F.array(*[_word_code(vector, w) for w in range(words)]))
    return F.when(F.size(vector) > BITS * words, F.raise_error(F.lit(f"vector of more than {BITS * words} components"))).otherwise(code)


def words_for(vectors: DataFrame, column: str) -> int:
    """Words that the longest vector needs."""
    return max(1, -(-(vectors.agg(F.max(F.size(column))).first()[0] or 0) // BITS))


def _word_code(vector: Column, word: int) -> Column:
    bits = F.transform(
        F.slice(vector, word * BITS + 1, BITS),
        lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.coalesce(b, F.lit(0).cast("long"))))


def _words(code: Column, words: int) -> list[Column]:
    return [code] if words == 1 else [code[w] for w in range(words)]


def _segments(words: list[Column]) -> list[Column]:
    low = F.lit((1 << WIDTH) - 1)
    return [F.shiftrightunsigned(x, j * WIDTH).bitwiseAND(low).cast("int") for x in words for j in range(SEGMENTS)]


def _postings(codes: DataFrame, name: str, words: int) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(j).alias("j"), v.alias("v")) for j, v in enumerate(_segments(_words(F.col(name), words)))])
    return codes.select("*", F.explode(parts).alias("_s")).select(*codes.columns, "_s.j", "_s.v")


def _masks(radius: int) -> Column:
    """All substrings of ``radius`` set bits: a constant that is folded once, when the plan is made."""
    masks = (str(x) for x in range(1 << WIDTH) if x.bit_count() == radius)
    return F.split(F.lit(",".join(masks)), ",").cast("array<int>")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best codes of each query: all that its k best rows can come from."""
    order = W.partitionBy("q").orderBy("distance", "first_id", "code")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def topk(base: DataFrame, queries: DataFrame, k: int = K, words: int = 1) -> DataFrame:
    """``query_id, neighbor_id, distance, rank`` for ``queries`` against ``base``, both ``(id, code)`` of ``words`` words."""
    segments = words * SEGMENTS
    scratch = Scratch(base.sparkSession, "topk")
    base = base.filter("id IS NOT NULL AND code IS NOT NULL")
    small = W.partitionBy("code").orderBy("id")
    index = scratch.table(
        base.withColumn("n", F.row_number().over(small))
        .filter(F.col("n") <= k)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    posted = scratch.table(_postings(index.select("code", F.col("ids")[0].alias("first_id"), F.size("ids").alias("held")), "code", words))
    wanted = scratch.table(queries.filter("id IS NOT NULL AND code IS NOT NULL").select("id", F.col("code").alias("q")))
    active = scratch.table(wanted.select("q").distinct().withColumn("bound", F.lit(BITS * words)))
    best, done, left = None, [], active.count()
    for radius in range(WIDTH + 1):
        # A query makes up to 12,870 probes for each segment: they are made in tasks of about PROBES each.
        parts = max(1, min(MOST_TASKS, left * segments * comb(WIDTH, radius) // PROBES))
        probes = _postings(active.repartition(parts, "q"), "q", words).withColumn("mask", F.explode(_masks(radius)))
        probes = probes.select("q", "bound", "j", F.col("v").bitwiseXOR(F.col("mask")).alias("v"))
        side = posted.select("code", "first_id", "held", F.col("j").alias("pj"), F.col("v").alias("pv"))
        unlike = [a.bitwiseXOR(b) for a, b in zip(_words(F.col("q"), words), _words(F.col("code"), words), strict=True)]
        apart = [F.bit_count(x) for x in _segments(unlike)]
        first = (F.least(*apart) == radius) & (F.col("j") == F.coalesce(*[F.when(x == radius, j) for j, x in enumerate(apart)]))
        distance = reduce(add, [F.bit_count(x) for x in unlike])
        # Exploded probes are larger than any estimate of them: a sort-merge join, which neither side must fit for.
        met = probes.hint("merge").join(
            side, (F.col("j") == F.col("pj")) & (F.col("v") == F.col("pv")) & first & (distance <= F.col("bound"))
        ).select("q", "code", "first_id", "held", distance.cast("int").alias("distance"))
        best = scratch.table(_best(met if best is None else best.unionByName(met), k))
        upto = W.partitionBy("q").orderBy("distance", "first_id", "code").rowsBetween(W.unboundedPreceding, 0)
        reach = best.withColumn("rows", F.sum("held").over(upto)).filter(F.col("rows") >= k)
        kth = reach.groupBy("q").agg(F.min("distance").alias("kth"))
        state = scratch.table(active.select("q").join(kth, "q", "left").select("q", F.coalesce("kth", F.lit(BITS * words)).alias("bound")))
        covered = (F.col("bound") <= segments * (radius + 1) - 1) | F.lit(radius == WIDTH)
        done.append(best.join(state.filter(covered), "q", "left_semi"))
        active = scratch.table(state.filter(~covered))
        best, left = scratch.table(best.join(active, "q", "left_semi")), active.count()
        if not left:
            break
    all_best = done[0]
    for x in done[1:]:
        all_best = all_best.unionByName(x)
    rows = all_best.join(index.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    order = W.partitionBy("q").orderBy("distance", "neighbor_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return wanted.join(rows, "q").select(F.col("id").alias("query_id"), "neighbor_id", "distance", "rank")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    words = words_for(vectors, "embedding")
    coded = vectors.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding"), words).alias("code"))
    return topk(coded, coded.filter(F.col("id") % EVERY == 0), words=words)


ORACLE = f"""
WITH c AS (SELECT vec_id, list_sum(list_transform(range(1, {BITS} + 1), lambda i: CASE WHEN embedding[i] > 0 AND NOT isnan(embedding[i]) THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
, p AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, bit_count(xor(q.code, b.code))::INT AS distance
  FROM c q, c b WHERE q.vec_id % {EVERY} = 0)
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
SELECT query_id, neighbor_id, distance, rank FROM r WHERE rank <= {K}
"""
