"""Tables of the benchmark data seen as stacks of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.schema import COLD, HOT, MISSING, SATURATED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position: part; frame: line; value: price in whole cents.  Tax 0.08 is NaN, discounts 0.10 and 0.09 are flagged."""
    li = table(spark, sf_dir, "lineitem")
    flags = F.when(F.col("l_discount") == 0.10, SATURATED).when(F.col("l_discount") == 0.09, HOT).otherwise(0)
    return li.select(
        F.lit(0).alias("stack_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame_id"),
        F.lit(0).alias("plane"),
        F.floor(F.col("l_partkey") / 100).cast("int").alias("y"),
        (F.col("l_partkey") % 100).cast("int").alias("x"),
        F.when(F.col("l_tax") == 0.08, float("nan")).otherwise(F.round(F.col("l_extendedprice") * 100)).alias("value"),
        flags.cast("short").alias("flags"),
    )


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is an 8 x 8 frame of whole thousandths, each label a stack; a few samples are flagged or missing."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    bad = (F.col("vec_id") * 7 + F.col("i")) % 97
    return e.select(
        F.col("label").alias("stack_id"),
        F.col("vec_id").alias("frame_id"),
        F.lit(0).alias("plane"),
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.col("i") % 8).cast("int").alias("x"),
        F.when(bad == 3, float("nan")).otherwise(F.round(F.col("v").cast("double") * 1000) + 0.0).alias("value"),
        F.when(bad == 1, SATURATED).when(bad == 2, MISSING | COLD).otherwise(0).cast("short").alias("flags"),
    )


LINEITEM_SQL = f"""
SELECT 0 AS stack_id, l_orderkey * 8 + l_linenumber AS frame_id, 0 AS plane, (l_partkey // 100)::INT AS y, (l_partkey % 100)::INT AS x,
  CASE WHEN l_tax = 0.08::DOUBLE THEN 'NaN'::DOUBLE ELSE round(l_extendedprice * 100) END AS value,
  CASE WHEN l_discount = 0.10::DOUBLE THEN {SATURATED} WHEN l_discount = 0.09::DOUBLE THEN {HOT} ELSE 0 END AS flags FROM lineitem"""

EMBEDDING_SQL = f"""
SELECT label AS stack_id, vec_id AS frame_id, 0 AS plane, (i // 8)::INT AS y, (i % 8)::INT AS x,
  CASE WHEN (vec_id * 7 + i) % 97 = 3 THEN 'NaN'::DOUBLE ELSE round(embedding[i + 1]::DOUBLE * 1000) + 0.0::DOUBLE END AS value,
  CASE WHEN (vec_id * 7 + i) % 97 = 1 THEN {SATURATED} WHEN (vec_id * 7 + i) % 97 = 2 THEN {MISSING | COLD} ELSE 0 END AS flags
FROM (SELECT vec_id, label, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)"""
