"""Exact deduplication by two passes over Bloom filters, in DataFrame operations only.

Pass 1 hashes each text to one position of a bit space so wide (``2**64``) that distinct texts practically never meet
there.  It is not held as bits: the positions that rows hit are counted, in each partition before they move, so that a
text with a third of all rows moves as one number from each partition.  The positions that were hit more than once, the
possibly repeated texts, enter a second Bloom filter with ``PROBES`` bits each.  Its size follows from their number,
not from the number of rows, and it lives as a table of 4 KB bitmaps.  Pass 2 tests every row against that filter: a row
that misses a bit is the only one of its text and passes straight through; the others shuffle by the SHA-256 of their
text, where copies are told from mere collisions.  The filters therefore never decide a result, they only spare rows
the shuffle.

A text with more than one row in 20,000 is hot; there can't be more of them than that, so their groups are broadcast and
their rows don't meet in one task (``common.spread_join``).

Defined results: null text counts as empty, and all empty texts are copies of each other.  Rows with a null id sort
after all others.  Rows that repeat both id and text are the same document: ``decisions`` marks all of them alike,
``exact_dedup`` keeps one.  An empty table gives an empty result.  Other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, spread_join, text_or_empty

#: Bits of the second filter for each possibly repeated text, and the bounds of its size.  2**30 bits are 128 MB, the most
#: that is broadcast: 67 million repeated texts have 16 bits each, ten times as many have 1.6 and half of the unique
#: rows shuffle with them, while results stay the same.
BITS_PER_TEXT, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 30
PROBES = 2
BITMAP_BITS = 8 * 4096


def text_digest(column: str = "text") -> Column:
    """SHA-256 of the text with each run of 0x20 and 0x09 to 0x0D replaced by one space."""
    return F.sha2(F.regexp_replace(text_or_empty(column), r"[\x20\x09-\x0D]+", " "), 256)


def _position() -> Column:
    return F.xxhash64("text_sha256")


def _probes(position: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(j), position), F.lit(bits)) for j in range(PROBES)]


def filter_bits(texts: int) -> int:
    wanted = max(LEAST_BITS, min(MOST_BITS, texts * BITS_PER_TEXT))
    return 1 << (wanted - 1).bit_length()


def repeated_positions(digests: DataFrame) -> DataFrame:
    """Pass 1: ``position`` of the texts that possibly occur more than once."""
    return digests.select(_position().alias("position")).groupBy("position").count().filter("count > 1").select("position")


def bloom_filter(positions: DataFrame, bits: int) -> DataFrame:
    """``(bucket, bitmap)`` of the probes of all ``positions``."""
    probe = positions.select(F.explode(F.array(*_probes(F.col("position"), bits))).alias("probe"))
    return probe.groupBy(F.floor(F.col("probe") / BITMAP_BITS).alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(probe % {BITMAP_BITS})").alias("bitmap")
    )


def with_maybe(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Pass 2: adds ``_maybe``, false only where the row's text is certainly the only one."""
    names, held = rows.columns, []
    for j, probe in enumerate(_probes(_position(), bits)):
        side = bitmaps.select(F.col("bucket").alias(f"_b{j}"), F.col("bitmap").alias(f"_m{j}"))
        rows = rows.withColumn(f"_p{j}", probe).join(
            F.broadcast(side), F.floor(F.col(f"_p{j}") / BITMAP_BITS) == F.col(f"_b{j}"), "left"
        )
        byte = F.expr(
            f"cast(conv(hex(substring(_m{j}, cast((_p{j} % {BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
        )
        bit = F.expr(f"cast(_p{j} % 8 as int)")
        held.append(F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    test = held[0]
    for x in held[1:]:
        test = test & x
    return rows.select(*names, test.alias("_maybe"))


def _filtered(digests: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Both filters' work: the bitmaps of the second one and its size in bits."""
    positions = scratch.table(repeated_positions(digests))
    bits = filter_bits(positions.count())
    bitmaps = scratch.table(bloom_filter(positions, bits))
    scratch.drop(positions)
    return bitmaps, bits


def _groups(maybe: DataFrame, id_col: str) -> DataFrame:
    return maybe.groupBy(F.col("text_sha256").alias("_sha")).agg(
        F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``; all rows, dropped ones too."""
    scratch = Scratch(docs.sparkSession, "exact")
    digests = scratch.table(docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("text_sha256")))
    bitmaps, bits = _filtered(digests, scratch)
    flagged = with_maybe(digests, bitmaps, bits)
    alone = flagged.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    maybe = flagged.filter("_maybe")
    groups = scratch.table(_groups(maybe, "doc_id"))
    grouped = spread_join(maybe, groups, {"text_sha256": "_sha"}, "group_size", digests.count())
    out = alone.unionByName(grouped.select(*alone.columns))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without copies, all columns as they were; only rows that may have copies shuffle."""
    spark, columns = docs.sparkSession, docs.columns
    scratch = Scratch(spark, "exact")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        F.col(id_col).alias("_id"),
        text_digest(text_col).alias("text_sha256"),
    )
    digests = scratch.table(rows.select("_id", "text_sha256"))
    bitmaps, bits = _filtered(digests, scratch)
    groups = scratch.table(_groups(with_maybe(digests, bitmaps, bits).filter("_maybe"), "_id"))
    scratch.drop(digests)
    flagged = with_maybe(rows, bitmaps, bits)
    alone = flagged.filter(~F.col("_maybe")).select("_row")
    # Joined on text and id, so that the copies of one text spread over all tasks.
    first = (
        flagged.filter("_maybe")
        .join(groups, (F.col("text_sha256") == F.col("_sha")) & F.col("_id").eqNullSafe(F.col("keep_id")))
        .dropDuplicates(["text_sha256", "_id"])
        .select("_row")
    )
    return alone.unionByName(first).select(*[F.col(f"_row.`{c}`") for c in columns])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
