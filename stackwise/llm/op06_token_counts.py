"""Token counts by byte-pair merging with a heap over a linked list.

A text is cut into words by the tokenizer's pattern.  The symbols of a word are its bytes, in a doubly linked list; a
heap holds each adjacent pair that has a merge, by rank and position.  The lowest is popped again and again, stale
entries are skipped, and a merge adds at most two new pairs: ``O(n log n)`` for a word of ``n`` bytes, however long.
The count is the initial symbols minus the merges.  No token identifier is ever made.  Counts of short words are kept
in a bounded table of the task.

Defined results: null counts as the empty text, with no token.  Strings of special tokens inside a text count as one
token each, as the library does by default.  Null ids and repeated rows are carried through.  An empty table gives an
empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, utf8

#: Words whose counts a task keeps, and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 300_000, 48
LIMIT = 1024


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that are left when no adjacent pair has a merge any more."""
    n = left = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = (symbols[i], symbols[i + 1])
        rank = ranks.get(pair)
        if rank is not None:
            heap.append((rank, i, pair))
    heapify(heap)
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue
        symbols[i] = pair[0] + pair[1]
        symbols[j] = ""
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pair = (symbols[i], symbols[k])
            rank = ranks.get(pair)
            if rank is not None:
                heappush(heap, (rank, i, pair))
        h = before[i]
        if h >= 0:
            pair = (symbols[h], symbols[i])
            rank = ranks.get(pair)
            if rank is not None:
                heappush(heap, (rank, h, pair))
    return left


class Counter:
    """Counts the tokens of texts for a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        alphabet = byte_alphabet()

        class Kept(dict):
            def __missing__(self, word: str) -> int:
                n = merge_count([alphabet[b] for b in word.encode()], ranks)
                if len(word) <= KEPT_LENGTH:
                    if len(self) >= KEPT_WORDS:
                        self.clear()
                    self[word] = n
                return n

        self.kept = Kept()

    def count(self, text: str) -> int:
        if self.special is None or "<" not in text and not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def _plain(self, text: str) -> int:
        if len(text) > 1 << 22:  # the words of a very long text aren't listed at once
            return sum(self.kept[m[0]] for m in self.words.finditer(text))
        return sum(map(self.kept.__getitem__, self.words.findall(text)))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; ``tokenizer`` is the path of the vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            texts = batch.column(1)
            n = [counter.count(texts[i].as_py() or "") for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
