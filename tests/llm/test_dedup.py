"""Exact and near deduplication and repeat removal against brute force."""

import hashlib
import random
import re

import numpy as np
from helpers import DATA, rows

from stackwise.llm import common
from stackwise.llm import op01_minhash_dedup as near
from stackwise.llm import op02_exact_dedup as exact
from stackwise.llm import op07_repeat_removal as repeats
from stackwise.llm.common import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_near(df, docs):
    want = components(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df).collect()}
    assert got == want


def test_near_duplicates_of_the_table(spark):
    docs = read_table(spark, DATA, "documents")
    check_near(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def varied(rng, n_groups, copies, words, edits):
    out = []
    for g in range(n_groups):
        base = [f"w{g}x{rng.randrange(10_000)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(words)] = f"n{rng.randrange(10**9)}"
            out.append(" ".join(w))
    return out


def test_large_star_of_copies(spark):
    """Many copies of one text, about half of them too far from it and from each other."""
    texts = varied(random.Random(1), 1, 150, 120, 12) + varied(random.Random(2), 20, 3, 60, 2)
    docs = list(enumerate(texts))
    check_near(spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_common_passage_links_nothing(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(i, " ".join([f"a{rng.random()}" for _ in range(12)]) + " " + passage + " " + " ".join(f"b{rng.random()}" for _ in range(rng.randrange(15, 30)))) for i in range(80)]
    docs += [(100 + i, docs[i][1] + " tail") for i in range(10)]
    check_near(spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_refined_lists(spark, monkeypatch):
    """With every list of three refined, positions and sizes lose no link; copies here also gain and lose words."""
    monkeypatch.setattr(near, "SHORT", 2)
    rng = random.Random(5)
    texts = varied(rng, 4, 14, 80, 8)
    for t in varied(rng, 2, 20, 100, 6):
        w = t.split()
        a, b = rng.randrange(25), rng.randrange(25)
        texts.append(" ".join(w[a : len(w) - b] + [f"t{rng.randrange(3)}" for _ in range(rng.randrange(12))]))
    docs = list(enumerate(texts))
    check_near(spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_few_edits_from_a_small_vocabulary(spark, monkeypatch):
    """Copies share their edits too, so that no list is left to one node."""
    monkeypatch.setattr(near, "SHORT", 4)
    rng, texts = random.Random(6), []
    base = [f"w{k}" for k in range(90)]
    for _ in range(200):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(12) * 7] = rng.choice("xyz")
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    check_near(spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_long_sets_meet_in_sketches(spark):
    """Sets much larger than a sketch, with links near the threshold."""
    docs = list(enumerate(varied(random.Random(7), 6, 15, 700, 45)))
    check_near(spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_links_of_a_repeated_id(spark):
    """Rows that repeat an id with another text keep their own sets and links."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " one"), (3, b + " two"), (0, b + " three")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near.near_duplicates(df).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 0)]
    kept = sorted((r["doc_id"], r["text"]) for r in near.near_dedup(df).collect())
    assert kept == [(0, b + " three"), (1, a)]


def test_near_nasty(nasty, empty):
    got = near.near_duplicates(nasty).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[0]["n_shingles"] == 0 and by[2]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[4]["component_id"] == 3
    assert by[6]["component_id"] == 5 and by[None]["kept"] and by[9]["n_shingles"] == 1
    assert near.near_duplicates(empty).count() == 0
    assert near.near_dedup(nasty).columns == nasty.columns


def test_components(spark):
    from stackwise.llm.common import Scratch

    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in near.connected_components(spark.createDataFrame(edges, "u long, w long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[200] == got[150] == got[100] == 100


def test_exact_equals_sql(spark, duck):
    assert rows(exact.op2_exact_dedup(spark, DATA)) == rows(duck.sql(exact.ORACLE).df())


def test_exact_keeps_rows_and_columns(spark, nasty, empty):
    kept = exact.exact_dedup(nasty)
    assert kept.columns == nasty.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == 9  # "" with null, blank, "one" three times
    got = exact.decisions(nasty).collect()
    assert len(got) == 12 and {r["keep_id"] for r in got if r["group_size"] == 3} == {3}
    assert exact.decisions(empty).count() == 0 and exact.exact_dedup(empty).count() == 0


def test_filter_only_spares_work(spark, monkeypatch):
    """A filter that is far too small lets everything through and changes nothing."""
    docs = read_table(spark, DATA, "documents")
    want = rows(exact.decisions(docs))
    monkeypatch.setattr(exact, "LEAST_BITS", 64)
    monkeypatch.setattr(exact, "BITS_PER_TEXT", 1)
    assert rows(exact.decisions(docs)) == want


def test_no_text_is_hot_or_all_are(spark, monkeypatch):
    docs = read_table(spark, DATA, "documents")
    want = rows(exact.decisions(docs))
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    assert rows(exact.decisions(docs)) == want


def brute_repeats(texts):
    seen, marked = {}, [np.zeros(len(t) + 1, int) for t in texts]
    for i, t in enumerate(texts):
        for j in range(len(t) - 199):
            seen.setdefault(t[j : j + 200], []).append((i, j))
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                marked[i][j] += 1
                marked[i][j + 200] -= 1
    out = []
    for t, m in zip(texts, marked, strict=True):
        gone = np.cumsum(m)[:-1] > 0
        n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), n, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check_repeats(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts])


def planted(rng):
    letters = "abcdefgh \u00e9\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, long_one = text(300), text(900)
    out = [text(rng.randrange(0, 700)) for _ in range(20)]
    out += [text(50) + passage[: rng.randrange(150, 300)] + text(80) for _ in range(8)]
    out += [text(30) + long_one[rng.randrange(0, 300) : rng.randrange(500, 900)] + text(10) for _ in range(8)]
    out += ["a" * 450, "ab" * 300, long_one + long_one, "", passage[:199], passage[:200]]
    copy = list(long_one)
    for k in range(0, 900, 90):
        copy[k] = "Z"
    return [*out, "".join(copy)]


def test_repeats_brute_force(spark):
    for seed in range(3):
        check_repeats(spark, planted(random.Random(seed)))


def test_many_segments_of_one_anchor(spark, monkeypatch):
    """The distributed way for anchors with very many segments gives the same as the construction."""
    monkeypatch.setattr(repeats, "MOST_ALIGNED", 1)
    check_repeats(spark, planted(random.Random(9)))


def test_external_columns(spark, monkeypatch):
    monkeypatch.setattr(repeats, "COLUMN_BYTES", 1)
    check_repeats(spark, planted(random.Random(11)))


def test_repeats_nasty(nasty, empty):
    got = {(r["doc_id"], r["n_bytes"]): r for r in repeats.remove_repeats(nasty).collect()}
    assert got[1, 0]["n_removed"] == 0 and got[8, 30_000]["n_removed"] == 30_000 and got[9, 40_000]["n_spans"] == 1
    assert repeats.remove_repeats(empty).count() == 0
