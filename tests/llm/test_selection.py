"""Search, mixing, URL filtering and the pipeline."""

import random

import pytest
from helpers import DATA, rows

from stackwise.llm import common
from stackwise.llm import op04_topk_search as search
from stackwise.llm import op09_mixing as mixing
from stackwise.llm import op10_url_filter as urls
from stackwise.llm.common import read_table


def test_search_equals_sql(spark, duck):
    assert rows(search.op4_topk_search(spark, DATA)) == rows(duck.sql(search.ORACLE).df())


def test_search_with_ties_and_outliers(spark):
    base = [(i, 5) for i in range(40)] + [(100 + i, 5 ^ (1 << i)) for i in range(30)] + [(200, -1), (201, 0), (None, 3), (7, None), (3, 5)]
    df = spark.createDataFrame(base, "id long, code long")
    got = search.topk(df, df.filter("id IN (0, 200) OR id IS NULL"), 12).collect()
    known = [(i, c) for i, c in base if i is not None and c is not None]
    for q, code in ((0, 5), (200, -1)):
        want = sorted((((c ^ code) & (2**64 - 1)).bit_count(), i) for i, c in known)[:12]
        assert [(r["distance"], r["neighbor_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_search_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan"), None, -2.0]), (2, None), (3, [])], "vec_id long, embedding array<float>")
    codes = [r[0] for r in df.select(search.sign_code(df["embedding"])).collect()]
    assert codes == [1, None, 0]
    none = spark.createDataFrame([], "id long, code long")
    assert search.topk(none, none).count() == 0


def test_search_beyond_64_components(spark, tmp_path):
    """Vectors of 130 components that differ from the 65th on only, one that is far from all, a short one and a null."""
    rng, vectors = random.Random(4), {}
    centres = [[rng.choice((-1.0, 1.0)) for _ in range(66)] for _ in range(3)]
    for i in range(90):
        tail = list(centres[i % 3])
        for k in rng.sample(range(66), i % 7):
            tail[k] = -tail[k]
        vectors[i] = [1.0] * 64 + tail
    vectors[100], vectors[7], vectors[8] = [rng.choice((-1.0, 1.0)) for _ in range(130)], [1.0] * 70, None
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    codes = {i: sum((x > 0) << k for k, x in enumerate(v)) for i, v in vectors.items() if v is not None}
    got = search.op4_topk_search(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == {0, 50, 100}
    for q in (0, 50, 100):
        want = sorted(((c ^ codes[q]).bit_count(), i) for i, c in codes.items())[: search.K]
        assert [(r["distance"], r["neighbor_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_mixing_equals_sql(spark, duck, monkeypatch):
    want = rows(duck.sql(mixing.ORACLE).df())
    assert rows(mixing.op9_mixing(spark, DATA)) == want
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert rows(mixing.op9_mixing(spark, DATA)) == want


def test_shortages_go_to_siblings_first(spark):
    """One small source: its language's other source takes the rest, the other language keeps its share."""
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r for r in mixing.leaf_targets(df, 0.5, 1).collect()}
    total = {s: got[s]["full"] * t + got[s]["rest"] for _, _, s, t in leaves}
    budget = 2010 * 0.5
    assert total["a"] == 10 and total["c"] == pytest.approx(budget * 0.2 / 0.7, abs=1) and total["a"] + total["b"] == pytest.approx(budget * 0.5 / 0.7, abs=1)


def test_mixing_keeps_budgets(spark):
    docs = read_table(spark, DATA, "documents")
    out = mixing.select_epochs(docs, share=0.9, max_epochs=1)
    assert out.drop("epoch").columns == docs.columns and out.groupBy("doc_id").count().filter("count > 1").count() == 0
    tokens = lambda df: df.agg({"n": "sum"}).first()[0]
    all_, some = (tokens(x.select(mixing.token_count().alias("n"))) for x in (docs, out))
    assert 0.5 * all_ < some <= 0.9 * all_


def test_mixing_nasty(nasty, empty):
    out = mixing.mix(nasty, share=1.0, max_epochs=2)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "domain", "lang", "source", "tokens", "epoch"}
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    clashing = "doc_id long, text string, lang string, source string, epoch string, _domain string, _full long"
    df = spark.createDataFrame([(i, "a b c", "en", f"src{i % 2}", "old", "mine", -i) for i in range(20)], clashing)
    out = mixing.select_epochs(df, share=0.5, max_epochs=1, epoch_col=None)
    assert out.columns == df.columns and 0 < out.count() < 20
    assert all(r["epoch"] == "old" and r["_domain"] == "mine" and r["_full"] == -r["doc_id"] for r in out.collect())
    replaced = mixing.select_epochs(df, share=0.5, max_epochs=1)
    assert sorted(replaced.columns) == sorted(df.columns) and {r["epoch"] for r in replaced.collect()} == {1}


def test_urls_equal_sql(spark, duck):
    assert rows(urls.op10_url_filter(spark, DATA)) == rows(duck.sql(urls.ORACLE).df())


CASES = [
    ("http://EXAMPLE.com/en/7?x=1", "example.com", "/en/7", "example.com/en/7", "allow"), ("http://a.com/en/8#t", "a.com", "/en/8", "com/en/", "block"), ("https://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
    ("https://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"), ("ftp://notcom/en/1", "notcom", "/en/1", None, "allow"), ("http://q.org?a=/es/1", "q.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://com/en/", "com", "/en/", "com/en/", "block"), ("x://h/p://q", "h", "/p://q", None, "allow"), ("://H\u00c9.org/es/", "h\u00c9.org", "/es/", "org/es/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_bad_templates_are_rejected(spark):
    pages = [(i, f"http://h.xyz/shop/{i}") for i in range(40)] + [(100 + i, f"http://h.xyz/news/{i}") for i in range(40)]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"))
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in out.collect()}
    assert got[35] == ("block", "/shop/*") and got[135] == ("allow", "/news/*")


def test_branches_of_equal_rate_merge(spark):
    """Branches that are all bad, and those that are all good, are alike; one that differs from its siblings stays."""
    pages, labels = [], []
    for k, (branch, bad) in enumerate({"shop/a/z": 1, "shop/b/z": 1, "news/a/z": 0, "news/b/z": 0, "news/c/z": 0}.items()):
        pages += [(1_000 * k + i, f"http://h.xyz/{branch}") for i in range(30)]
        labels += [(1_000 * k + i, bad) for i in range(20)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"))
    got = {(r["template"], r["verdict"]) for r in out.collect()}
    assert got == {("/shop/*/z", "block"), ("/news/*/z", "allow")}


def test_no_branch_is_hot_or_all_are(spark, duck, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    assert rows(urls.op10_url_filter(spark, DATA)) == rows(duck.sql(urls.ORACLE).df())


def test_branches_below_the_fourth_segment(spark):
    """Paths that part at segment 5, and at 7 where the labels agree before; a path of 300 segments costs no rounds."""
    branches = {"a/b/c/d/spam": 1, "a/b/c/d/news": 0, "e/f/g/h/i/j/spam": 1, "e/f/g/h/i/j/news": 0}
    pages, labels = [(9_000, "http://h.xyz/" + "a/" * 300)], []
    for k, (branch, bad) in enumerate(branches.items()):
        pages += [(1_000 * k + i, f"http://h.xyz/{branch}/{i}") for i in range(40)]
        labels += [(1_000 * k + i, bad) for i in range(30)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"))
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in out.collect()}
    for k, (branch, bad) in enumerate(branches.items()):
        assert all(got[1_000 * k + i][0] == ("block" if bad else "allow") for i in range(40))
        assert got[1_000 * k][1].endswith(branch[-5:] + "/*") and got[1_000 * k][1].count("/") == branch.count("/") + 2
    assert got[9_000][1].endswith("/a" * 298) and got[9_000][1].count("/") == 300


def run_pipeline(spark, docs, labels, folder):
    """All stages on small tables; the rows that each stage returns, by its name."""
    import corpus_pipeline

    labels.write.parquet(f"{folder}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder))
        out.write.parquet(f"{folder}/{name}")
        if name != "packing":
            assert out.columns == docs.columns, name
            docs = spark.read.parquet(f"{folder}/{name}")
            kept[name] = docs.collect()
        else:
            kept[name] = spark.read.parquet(f"{folder}/{name}").collect()
    return kept


def test_pipeline_brute_force(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ties and clashing columns, each stage against its definition."""
    import re

    shape = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, epoch int, component_id long, position long"
    base = " ".join(f"w{k}" for k in range(60))
    texts = {1: base, 2: base, 3: base + " more", 4: "", 5: None, 6: "  ", 7: "x" * 20_000, 8: base.replace(" ", "\n"), 10: "one two", 11: " ".join(f"v{k}" for k in range(30))}
    docs = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, None, False, -1, -2, -3) for i, t in texts.items()]
    docs += [(10, "one two", "en", "src1", None, False, -1, -2, -3)] * 2 + [(None, "no id at all here", None, None, None, False, -1, -2, -3)]
    df = spark.createDataFrame(docs, shape)
    kept = run_pipeline(spark, df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path)
    assert len(kept["quality"]) == len(docs)  # no labels: nothing goes
    same = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(same(r[1]), r[0])
    assert sorted(map(str, first.values())) == sorted(str(r["doc_id"]) for r in kept["exact_dedup"])
    assert {r["doc_id"] for r in kept["near_dedup"]} == set(first.values()) - {3}
    mixed = {r["doc_id"] for r in kept["mixing"]}
    assert mixed <= {r["doc_id"] for r in kept["near_dedup"]} and len(mixed) == len(kept["mixing"])
    assert all((r["keep"], r["epoch"], r["component_id"], r["position"]) == (False, -1, -2, -3) for r in kept["mixing"])
    assert {r["doc_id"] for r in kept["packing"]} == mixed


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    kept = run_pipeline(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path)
    assert all(not x for x in kept.values()) and len(kept) == 5


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = read_table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before.count()
        assert docs.join(before, docs.columns).count() >= docs.count()
    from stackwise.llm import op01_minhash_dedup as near

    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    assert near.near_duplicates(docs).filter("NOT kept").count() == 0
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() == docs.count()
