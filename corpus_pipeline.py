"""The corpus pipeline: each stage works on all that its predecessor kept, through files in the shared folder.

Defined results: null texts count as empty.  Empty texts are scored like others, all but one of them are exact copies, and
the one that stays packs as its end mark alone.  Rows with null id are scored, deduplicated by their text and packed
like others; near duplicates leave them alone.  Of rows that repeat id and text one stays.  Without labels nothing is
rejected.  Extra columns are carried through every stage but the last, whatever their names.  Empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackwise.llm.common import Scratch, free_name, read_table
from stackwise.llm.op01_minhash_dedup import near_dedup
from stackwise.llm.op02_exact_dedup import exact_dedup
from stackwise.llm.op03_packing import pack
from stackwise.llm.op08_quality import ratings_of, score, train
from stackwise.llm.op09_mixing import select_epochs

#: Part of the tokens that the mixture takes.  No document is repeated, so that ids stay unique.
SHARE, MAX_EPOCHS = 0.9, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = train(docs, ratings_of(read_table(spark, sf_dir, "labels")))
    added = tuple(free_name(docs, x) for x in ("_expected", "_top", "_keep"))
    return score(docs, model, added=added).filter(added[2]).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are selected to the target weights of domains, languages and sources."""
    return select_epochs(docs, share=SHARE, max_epochs=MAX_EPOCHS, epoch_col=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixture),
    ("packing", packing),
]

#: The classifier and the sketches have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
