"""Token counts, packing, sharding and the classifier."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import DATA
from tokenizers import Tokenizer as Library

from stackwise.llm import op03_packing as packing
from stackwise.llm import op05_sharding as sharding
from stackwise.llm import op06_token_counts as counts
from stackwise.llm import op08_quality as quality
from stackwise.llm.common import read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in read_table(spark, DATA, "documents").select("doc_id", "text").collect()]


ODD = ["", " ", "\n\n  a", "don't  we'll 12345 \u00e9\u00fc\u4e2d\u6587 \U0001f600\u200d\U0001f600", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 5000, "ab" * 3000, "\x1c\x1d\u00a0\u2003z", "\u0130 \u01c5 \ufb01"]


def test_counts_equal_the_library(spark, library, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts.op6_token_counts(spark, DATA).collect()}
    for (i, t), e in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        assert got[i] == (len(t.encode()), len(e.ids), len(e.ids) > 1024)


def test_odd_texts(library):
    counter, tokens = counts.Counter(PATH), packing.Tokenizer(PATH)
    assert tokens.fast is not None
    for t in ODD + [chr(c) + "a " + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert counter.count(t) == len(ids)
        assert tokens.ids(t).tolist() == ids


def test_joins_that_are_no_merges_are_found(tmp_path):
    """A vocabulary where the join of two neighbours is a token that no merge makes of them must not take the fast encoder."""
    import json

    def written(name, tokens, merges):
        path = tmp_path / name
        spec = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": [], "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}}
        path.write_text(json.dumps(spec))
        return str(path)

    assert packing.joins_are_merges(written("good.json", ["a", "b", "c", "ab", "abc"], ["a b", "ab c"]))
    assert not packing.joins_are_merges(written("bad.json", ["a", "b", "c", "ab", "bc", "abc"], ["a b", "b c", "a bc"]))
    assert not packing.joins_are_merges(written("order.json", ["a", "b", "abab", "ab"], ["a b", "ab ab"]))
    assert packing.joins_are_merges(PATH)


def test_merging_is_by_rank():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert counts.merge_count(list("abc"), ranks) == 1
    assert counts.merge_count(list("ab"), ranks) == 1 and counts.merge_count(list("ba"), ranks) == 2 and counts.merge_count([], ranks) == 0
    assert counts.merge_count(list("aaaa"), {("a", "a"): 0}) == 2


def test_counts_nasty(nasty, empty):
    got = counts.token_counts(nasty, PATH).collect()
    assert len(got) == 12 and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert counts.token_counts(empty, PATH).count() == 0


def check_packed(rows, ids, window=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[i][at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes()) and r["doc_tokens"] == len(ids[i])
            at += r["length"]
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return 1 - sum(r["length"] for r in rows) / (window * len(by_sequence))


def test_packing(spark, library, texts):
    ids = {i: np.array([*e.ids, 0]) for (i, _), e in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True)}
    rows = packing.op3_packing(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    assert check_packed(rows, ids) < 0.02
    kept = packing.pack(read_table(spark, DATA, "documents"), PATH, keep_ids=True).limit(20).collect()
    for r in kept:
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist()


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for window, high in ((64, 64), (1024, 300), (1024, 1024)):
        histogram = np.zeros(window + 1, np.int64)
        np.add.at(histogram, rng.integers(1, high + 1, 5000), 1)
        used, padding, sequences = np.zeros_like(histogram), 0, 0
        for lengths, times in packing.plan(histogram, window):
            assert sum(lengths) <= window
            np.add.at(used, list(lengths), times)
            padding += (window - sum(lengths)) * times
            sequences += times
        assert (used == histogram).all()
        assert padding / (window * sequences) < 0.02
    assert packing.plan(np.zeros(65, np.int64), 64) == []


def test_least_squares_solves_what_is_solvable():
    histogram = np.zeros(11, np.int64)
    histogram[[3, 7, 4, 6]] = 5, 5, 8, 8
    patterns = packing.combinations(10, histogram > 0)
    x = packing.repeat_counts(patterns, histogram)
    got = {tuple(p): v for p, v in zip(patterns.tolist(), x.tolist(), strict=True)}
    assert got[0, 3, 7] + got.get((3, 3, 4), 0) >= 3 and (x >= 0).all()


def test_packing_nasty(nasty, empty):
    rows = packing.pack(nasty, PATH).collect()
    assert sum(r["doc_tokens"] == 1 for r in rows) == 2
    assert packing.pack(empty, PATH).count() == 0


def test_packing_long_blanks(spark, library):
    """Runs of blanks that the fast encoder refuses, between words, alone and around a special token."""
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 1_000_000, " " * 1_000_000 + "<|endoftext|>c", "a  b"]
    tokens = packing.Tokenizer(PATH)
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0]) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        assert tokens.ids(t).tolist() == ids[i][:-1].tolist()
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    check_packed(rows, ids)
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(x) for i, x in ids.items()}


def check_shards(rows, shards=40):
    size, slots = {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(0 <= s < shards for s in size)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return size


def test_sharding(spark, texts):
    rows = sharding.op5_sharding(spark, DATA).collect()
    want = {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    size, most = check_shards(rows), max(s for s, _ in want.values())
    mean = sum(s for s, _ in want.values()) / 40
    assert max(size.values()) - mean <= most and mean - min(size.get(k, 0) for k in range(40)) <= most


def test_boundaries_by_hand(spark):
    """Shards are runs of the order by hash and id, and each boundary is as near its share as one row or the tolerance allows."""
    import xxhash

    rng = np.random.default_rng(4)
    docs = [(i, "one text" if i % 3 == 0 else "x" * int(rng.integers(0, 300)) + str(i)) for i in range(900)]
    out = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()}
    hashed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), seed=42), "big", signed=False)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(docs, key=lambda r: (signed(hashed(r[1])), r[0]))
    assert [out[i] for i, _ in order] == sorted(out.values())
    upto = np.cumsum([len(t.encode()) + 16 for _, t in order])
    ends = [int(upto[max(k for k, (i, _) in enumerate(order) if out[i] < s)]) for s in range(1, 10)]
    largest = max(len(t.encode()) + 16 for _, t in docs)
    assert all(abs(e - upto[-1] * s / 10) <= max(largest, sharding.TOLERANCE * upto[-1] / 10) for s, e in enumerate(ends, 1))


def test_sharding_splits_a_huge_group(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    size = check_shards(out, 10)
    assert max(size.values()) - min(size.values()) <= 3 * 25


def test_sharding_nasty(nasty, empty, spark):
    out = sharding.shard(nasty, 4)
    assert len(out.collect()) == 12 and check_shards(out.collect(), 4)
    assert sharding.shard(empty, 4).count() == 0


def test_classifier_held_out(spark):
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").collect()}
    labels = read_table(spark, "/root/testdata/sf0.1", "labels").collect()
    import pyarrow as pa

    labels = [r for r in labels if r["doc_id"] in docs]
    grades = np.array([0 if r["toxic"] else 1 if not r["quality"] else 2 for r in labels])
    rows = list(quality.features(*quality.utf8(pa.array([docs[r["doc_id"]] for r in labels])), quality.PolyHash()))
    n = len(rows) * 3 // 4
    model = quality.OrdinalModel.fit(rows[:n], grades[:n])
    assert model.thresholds[0] < model.thresholds[1]
    expected, top = model.predict(rows[n:])
    held = grades[n:]
    keep = top >= quality.KEEP_AT
    assert keep[held == 2].mean() > 0.97 and keep[held == 0].mean() < 0.25
    assert expected[held == 2].mean() > expected[held == 0].mean()


def test_ordinal_gradient():
    """The gradient against central differences; the fit, which stops when a step gains 1e-7, near that of a plain gradient descent."""
    rng = np.random.default_rng(1)
    row, column, grades = np.repeat(np.arange(60), 4), rng.integers(0, 9, 240), rng.integers(0, 3, 60)
    loss, x = quality.ordinal_loss(row, column, grades, 9), rng.normal(0, 0.5, 11)
    numeric = np.array([(loss(x + h)[0] - loss(x - h)[0]) / 2e-6 for h in np.eye(11) * 1e-6])
    assert np.allclose(loss(x)[1], numeric, atol=1e-7)
    best, slow = quality.minimise(loss, np.zeros(11), 300), np.zeros(11)
    for _ in range(20_000):
        slow -= 0.3 * loss(slow)[1]
    assert loss(best)[0] == pytest.approx(loss(slow)[0], abs=1e-4) and loss(best)[0] < loss(x)[0]


def test_ordinal_grades():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(400)]
    grades = np.array([0 if 3 in r else 1 if 7 in r else 2 for r in rows])
    model = quality.OrdinalModel.fit(rows, grades)
    _, top = model.predict(rows)
    assert ((top > 0.5) == (grades == 2)).mean() > 0.97
    assert quality.OrdinalModel.fit(rows, np.zeros(400, int)) is None and quality.OrdinalModel.fit([], np.zeros(0, int)) is None


def test_scores_nasty(spark, nasty, empty):
    ratings = spark.createDataFrame([(3, 0), (5, 2), (9, 1), (None, 2), (77, 2)], "doc_id long, grade int")
    model = quality.train(nasty, ratings)
    out = quality.score(nasty, model)
    assert out.count() == 12 and out.columns == [*nasty.columns, "expected_grade", "p_top", "keep"]
    assert quality.score(empty, model).count() == 0
    none = quality.score(nasty, quality.train(nasty, ratings.limit(0)))
    assert none.filter("keep").count() == 12
