import random
from collections import Counter

import numpy as np
import pyarrow as pa

from islet.llm import near_duplicates as nd
from islet.llm.queries import op3_near_duplicates

from .samples import ODD, none, odd


def bag(text):
    words = (text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def alike(a, b):
    common, union = sum((a & b).values()), sum((a | b).values())
    plain, all_ = len(a.keys() & b.keys()), len(a.keys() | b.keys())
    return max(common / union if union else 0, plain / all_ if all_ else 0)


def brute(texts):
    """Class of each text by comparing every pair."""
    ids, bags = sorted(texts), {d: bag(t) for d, t in texts.items()}
    head = {d: d for d in ids}

    def root(d):
        while head[d] != d:
            d = head[d]
        return d

    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if bags[x] and bags[y] and root(x) != root(y) and alike(bags[x], bags[y]) >= 0.8:
                a, b = sorted((root(x), root(y)))
                head[b] = a
    return {d: root(d) for d in ids}


def test_classes_match_all_pairs(spark):
    for sf in ("sf0.001", "sf0.01"):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
        got = {r["doc_id"]: r["class_id"] for r in op3_near_duplicates(spark, f"/root/testdata/{sf}").collect()}
        assert got == brute(texts)


def test_planted_copies(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, at = {}, 0
    passage = " ".join(rng.choices(vocabulary, k=60))
    for g in range(30):
        base = rng.choices(vocabulary, k=rng.choice([40, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, len(words) // 60])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[at] = " ".join(words)
            at += 1
        texts[at] = passage + " " + " ".join(rng.choices(vocabulary, k=30 + g))
        at += 1
    chain = rng.choices(vocabulary, k=100)  # each like the next, the ends unlike
    for i in range(0, 40, 2):
        texts[at] = " ".join(rng.choices(vocabulary, k=0) + chain[i:] + [f"c{j}" for j in range(i)])
        at += 1
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(table).collect()}
    assert got == brute(texts)
    assert nd.keep(table).count() == len(set(got.values()))


def test_repeated_passages_are_found(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = {}
    for g in range(20):  # alike by plain similarity alone
        words = rng.choices(vocabulary, k=200)
        texts[2 * g], texts[2 * g + 1] = " ".join(words), " ".join(words + words[100:] * 4)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in nd.classes(table).collect()} == {d: d - d % 2 for d in texts} == brute(texts)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(7)
    for _ in range(4):
        e = rng.integers(1, 2**63, 300).astype(np.uint64)
        x, y = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
        y[:200] = x[:200]
        doc = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
        s = nd.dart_signatures(doc, np.concatenate([e[x > 0], e[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, 1024)
        true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert abs((s[0] == s[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 1024)
        assert (s != 0).all()


def test_small_and_large_sets_are_filled():
    one = nd.dart_signatures(np.zeros(1, int), np.array([5], np.uint64), np.ones(1, int), 3)
    assert (one[0] != 0).all() and (one[1:] == 0).all()
    again = nd.dart_signatures(np.array([0, 1] * 1), np.array([5, 5], np.uint64), np.ones(2, int), 2)
    assert np.array_equal(again[0], one[0]) and np.array_equal(again[1], one[0])
    doc, h, n = nd.shingles(pa.array(["a b c", None, "", "x " * 50, "a b c"]))
    assert doc.tolist() == [0, 3, 4] and n.tolist() == [1, 46, 1] and h[0] == h[2]


def test_block_links_are_exact(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i % 90}" for i in range(150)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(150)] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(words)
    bags = {i: bag(t) for i, t in texts.items()}
    table = spark.createDataFrame([(7, i, i, t) for i, t in texts.items()], "band long, key long, a long, text string")
    none_tied = spark.createDataFrame([], "key long, comp long")
    for block in (1024, 16):
        monkeypatch.setattr(nd, "BLOCK", block)
        even = next(b for b in range(100) if spark.range(1).selectExpr(f"pmod(xxhash64({b}L), 2) = 0").first()[0])
        shared = table.selectExpr(f"{even}L as band", "key", "-1L as a")
        links = nd._links_across(shared, none_tied, table.select("key", "text"), 0.8).collect()
        assert links and all(alike(bags[r["a"]], bags[r["b"]]) >= 0.8 for r in links)
        head = list(range(60))

        def top(x):
            while head[x] != x:
                x = head[x]
            return x

        for r in links:
            head[max(top(r["a"]), top(r["b"]))] = min(top(r["a"]), top(r["b"]))
        assert {i: top(i) for i in range(60)} == brute(texts)


def test_every_mixed_bucket_is_compared(spark):
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join([*words, f"x{i}"]) for i in range(2)}
    bands = 24  # each holds a pair of its own that only this step can link
    rows = [(b, 2 * b + i, -1, t + f" b{b}") for b in range(bands) for i, t in texts.items()]
    table = spark.createDataFrame(rows, "band long, key long, a long, text string")
    links = nd._links_across(table.select("band", "key", "a"), spark.createDataFrame([], "key long, comp long"), table.select("key", "text"), 0.8).collect()
    assert {b for b in range(bands) if any(r["a"] // 2 == b and r["b"] // 2 == b for r in links)} == set(range(bands))


def test_odd_rows(spark):
    rows = nd.classes(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(r["class_size"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    assert sorted(r["class_size"] for r in rows if r["doc_id"] == 5) == [1, 2, 2]
    assert nd.keep(odd(spark)).count() == len(ODD) - 1
    assert nd.keep(odd(spark)).columns == odd(spark).columns
    assert nd.classes(none(spark)).count() == 0


def test_forest_joins_what_its_links_join():
    from islet.operators.components import least_labels

    rng = np.random.default_rng(2)
    for many in (0, 1, 30, 400):
        x, y = rng.integers(0, 60, many), rng.integers(0, 60, many)
        x, y = x[x != y], y[x != y]
        kept = nd._forest(x, y)
        ids, least = least_labels(x, y)
        assert len(kept) == len(ids) - len(set(least.tolist()))
        assert all(map(np.array_equal, least_labels(x[kept], y[kept]), (ids, least)))


def test_long_runs_of_one_word(spark):
    """Multiplicities cost by their number of different values, not by their height."""
    own = [" ".join(f"a{i}x{j}" for j in range(40)) for i in range(3)]
    rows = [(i, own[i % 3] + " w" * (200_000 + 1000 * i)) for i in range(6)]
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert set(got.values()) == {0}
    shared = spark.createDataFrame([(1, i, -1) for i, _ in rows], "band long, key long, a long")
    texts = spark.createDataFrame(rows, "key long, text string")
    links = nd._links_across(shared, spark.createDataFrame([], "key long, comp long"), texts, 0.8)
    assert links.count() == 5


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 100)
    texts = {i: " ".join([f"w{j}" for j in range(60)] + [f"x{i}"]) for i in range(12)}
    table = spark.createDataFrame([(3, i, -1, t) for i, t in texts.items()], "band long, key long, a long, text string")
    links = nd._links_across(table.select("band", "key", "a"), spark.createDataFrame([], "key long, comp long"), table.select("key", "text"), 0.8).collect()
    ids, least = components_of([(r["a"], r["b"]) for r in links])
    assert len(ids) == 12 and set(least) == {0}


def components_of(links):
    from islet.operators.components import least_labels

    return [x.tolist() for x in least_labels(*(np.array(c, np.int64) for c in zip(*links)))]


def test_clashing_names(spark):
    import pytest

    with pytest.raises(ValueError, match="first"):
        nd.classes(odd(spark).withColumnRenamed("f", "First"), ("doc_id", "First"))
    docs = odd(spark).withColumnRenamed("f", "first").withColumnRenamed("size", "key")
    assert nd.keep(docs).columns == docs.columns
