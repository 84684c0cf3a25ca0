"""Hand-made graphs with exact answers, engines against each other, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from islet.operators import census, components, edges, generators, merging, search

PATH = [(i, i + 1) for i in range(1, 8)]
STAR = [(0, i) for i in range(1, 6)]
FULL = [(i, j) for i in range(4) for j in range(i + 1, 4)]
#: edges, components, least/mean/largest/variance, phases, rounds, roots
GRAPHS = {
    "empty": ([], {}, (2147483648, 0, 0, 0), 0, 0, {}),
    "mixed": ([(1, 2), (2, 3), (1, 3), (4, 5), (6, 6)], {1: 3, 4: 2, 6: 1}, (1, 2, 3, 2 / 3), 2, 9, {1: 1, 4: 4, 6: 6}),
    "path": (PATH, {1: 8}, (8, 8, 8, 0), 2, 16, {1: 1}),
    "repeated": ([(1, 2), (2, 1), (1, 2), (3, 3)], {1: 2, 3: 1}, (1, 1.5, 2, 0.25), 2, 5, {1: 1, 3: 3}),
    "root": ([(1, 10), (5, 20), (10, 20)], {1: 4}, (4, 4, 4, 0), 3, 8, {1: 10}),
    "star": (STAR, {0: 6}, (6, 6, 6, 0), 2, 4, {0: 0}),
    "full": (FULL, {0: 4}, (4, 4, 4, 0), 2, 4, {0: 0}),
    "declared": ([(7, 7), (8, 8)], {7: 1, 8: 1}, (1, 1, 1, 0), 0, 2, {7: 7, 8: 8}),
}


def table(spark, rows):
    return spark.createDataFrame(rows, "u long, v long")


@pytest.mark.parametrize("name", GRAPHS)
def test_hand_made_graphs(spark, name):
    rows, listing, moments, phases, rounds, roots = GRAPHS[name]
    e = table(spark, rows)
    labels = components.labels(e, 0)
    assert sorted(map(tuple, components.labels(e).collect())) == sorted(map(tuple, labels.collect()))
    assert {r["iC"]: r["nC"] for r in census.sizes(labels).collect()} == listing
    got = census.stats(census.sizes(labels)).first()
    assert (got["n"], got["f"]) == (sum(listing.values()), len(listing))
    assert all(abs(a - b) < 1e-12 for a, b in zip((got["cl"], got["cm"], got["cu"], got["cv"]), moments))
    merged = merging.merge(e)
    assert merged.phases == phases
    assert sorted(map(tuple, merged.labels.select("id", "comp").collect())) == sorted(map(tuple, labels.collect()))
    assert {r["comp"]: r["root"] for r in merged.labels.collect()} == roots
    assert merged.forest.count() == got["n"] - got["f"]
    spread = merging.merge(e, 0)
    assert spread.phases == phases and sorted(map(tuple, spread.labels.collect())) == sorted(map(tuple, merged.labels.collect()))
    tree = search.levels(e)
    assert search.rounds(tree).first()["r"] == rounds
    assert sorted(map(tuple, tree.select("id", "root").collect())) == sorted(map(tuple, labels.collect()))
    census.checked(labels, e)


def kruskal(rows):
    """Minimum spanning forest in the order of (smaller, larger) endpoint."""
    head = {}

    def top(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    out = []
    for a, b in sorted({(min(r), max(r)) for r in rows if r[0] != r[1]}):
        if top(a) != top(b):
            head[top(a)] = top(b)
            out.append((a, b))
    return out


@pytest.mark.parametrize("p", [0.8, 1.2, 3.0])
def test_engines_agree_on_random_graphs(spark, p):
    e = generators.exact(spark, 400, p / 400, 5).cache()
    rows = [tuple(r) for r in e.collect()]
    labels = sorted(map(tuple, components.labels(e).collect()))
    assert sorted(map(tuple, components.labels(e, 0).collect())) == labels
    merged = merging.merge(e)
    assert sorted(map(tuple, merged.labels.select("id", "comp").collect())) == labels
    assert sorted((r["lo"], r["hi"]) for r in merged.forest.collect()) == kruskal(rows)
    assert sorted(map(tuple, search.levels(e).select("id", "root").collect())) == labels
    assert sorted(map(tuple, components.labels(e.repartition(7)).collect())) == labels
    got = census.stats(census.sizes(components.labels(e))).first()
    assert got["n"] == 400 and abs(got["f"] * got["cm"] - got["n"]) < 1e-6


def test_long_path_needs_few_rounds(spark):
    e = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components.labels(e, 0).where("comp <> 0").isEmpty() and components.labels(e).where("comp <> 0").isEmpty()


def test_search_from_chosen_roots(spark):
    tree = search.levels(table(spark, PATH), spark.createDataFrame([(4,)], "id long"))
    assert {r["id"]: r["level"] for r in tree.collect()} == {i: abs(i - 4) for i in range(1, 9)}
    below = {r["id"]: r["subtree"] for r in search.subtrees(tree).collect()}
    assert below == {1: 1, 2: 2, 3: 3, 4: 8, 5: 4, 6: 3, 7: 2, 8: 1}
    assert search.subtrees(tree.limit(0)).count() == 0


def test_search_says_when_it_is_too_deep(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_LEVELS", 3)
    with pytest.raises(RuntimeError):
        search.levels(table(spark, PATH), spark.createDataFrame([(1,)], "id long"), 0)


def test_edge_algebra(spark):
    e = table(spark, [(1, 2), (2, 1), (2, 3), (5, 5), (2, 2)])
    assert sorted(map(tuple, edges.symmetrized(e).collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert {r["id"]: r["degree"] for r in edges.degree(e).collect()} == {1: 1, 2: 2, 3: 1, 5: 0}
    assert {r["id"]: r["neighbors"] for r in edges.adjacency(e).collect()} == {1: [2], 2: [1, 3], 3: [2], 5: []}
    assert [r["id"] for r in edges.singletons(e).collect()] == [5]
    assert sorted(map(tuple, edges.self_edges(e).collect())) == [(2, 2), (5, 5)]


def test_checks_find_wrong_labels(spark):
    with pytest.raises(AssertionError):
        census.checked(spark.createDataFrame([(1, 1), (2, 2)], "id long, comp long"), table(spark, [(1, 2)]))


@pytest.mark.parametrize("engine", ["stars", "merging", "search"])
def test_summary(spark, engine):
    row = census.summary(table(spark, GRAPHS["mixed"][0]), engine).first()
    assert (row["n"], row["f"], row["cl"], row["cu"], row["M"]) == (6, 3, 1, 3, None)
    assert (row["p"], row["r"]) == {"stars": (None, None), "merging": (2, None), "search": (None, 9)}[engine]
    with pytest.raises(ValueError):
        census.summary(table(spark, []), "other")


@pytest.mark.parametrize("make", [generators.exact, generators.monte_carlo, lambda *a: generators.monte_carlo(*a, distinct=True)])
def test_generators(spark, make):
    n, p = 600, 0.02
    rows = [tuple(r) for r in make(spark, n, p, 3).collect()]
    assert sorted(map(tuple, make(spark, n, p, 3).collect())) == sorted(rows)
    pairs = [r for r in rows if r[0] != r[1]]
    assert sorted(r for r in rows if r[0] == r[1]) == [(i, i) for i in range(n)]
    assert all(0 <= u < v < n for u, v in pairs)
    mean = p * n * (n - 1) / 2
    assert abs(len(pairs) - mean) < 5 * math.sqrt(mean)
    if make is not generators.monte_carlo:
        assert len(set(pairs)) == len(pairs)
        full = [tuple(r) for r in make(spark, 40, 1.0, 1).where("u <> v").collect()]
        assert len(set(full)) == len(full) == 780
    assert make(spark, 5, 0.0, 1).where("u <> v").isEmpty()
    with pytest.raises(ValueError):
        make(spark, 5, 1.5, 1)


@pytest.mark.parametrize("make", [generators.exact, generators.monte_carlo])
def test_graphs_do_not_depend_on_partitions(spark, make, monkeypatch):
    monkeypatch.setattr(generators, "PER_BLOCK", 50)
    want = sorted(map(tuple, make(spark, 300, 0.02, 9, 1).collect()))
    assert len(want) > 300 + 600
    for parts in (4, 7):
        assert sorted(map(tuple, make(spark, 300, 0.02, 9, parts).collect())) == want


def test_tiny_odds_and_pairs_of_many_vertices(spark):
    import numpy as np

    for n, p in ((1 << 32, 1e-18), (1 << 32, 1e-19), (3, 1e-300)):
        block = generators._exact(n, p, 1, n * (n - 1) // 2)
        import pandas as pd

        for rows in block(iter([pd.DataFrame({"id": [0]})])):
            assert ((rows["u"] >= 0) & (rows["u"] < rows["v"]) & (rows["v"] < n)).all()
    for n in (2, 3, 10, 101):
        u, v = generators._pair(np.arange(n * (n - 1) // 2), n)
        assert list(zip(u.tolist(), v.tolist())) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    n = 1 << 32
    ends = [(0, 1), (0, n - 1), (1, 2), (n // 2, n - 1), (n - 3, n - 2), (n - 2, n - 1)]
    u, v = generators._pair(np.array([a * (2 * n - a - 1) // 2 + b - a - 1 for a, b in ends]), n)
    assert list(zip(u.tolist(), v.tolist())) == ends


def boruvka(rows):
    """Root of each vertex, edges picked by phase, and phases, one merge after the other."""
    edges = sorted({(min(r), max(r)) for r in rows if r[0] != r[1]})
    root, picked = {x: x for r in rows for x in r}, []
    while True:
        least = {}
        for a, b in edges:
            if root[a] != root[b]:
                for c in (root[a], root[b]):
                    least.setdefault(c, (a, b))
        if not least:
            return root, picked, len(picked) + 1 if picked else 0
        picked.append(sorted(set(least.values())))
        to = {}
        for c, (a, b) in least.items():
            other = root[b] if root[a] == c else root[a]
            to[c] = c if least[other] == (a, b) else other
        new = {}
        for c in least:
            top = c
            while to[top] != top:
                top = to[top]
            new[c] = least[top][0]
        root = {x: new.get(c, c) for x, c in root.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_roots_and_phases_match_a_plain_computation(spark, seed):
    rows = [tuple(r) for r in generators.exact(spark, 120, (0.8, 1.5, 4.0)[seed - 1] / 120, seed).collect()]
    root, picked, phases = boruvka(rows)
    for local in (merging.LOCAL_EDGES, 0) if seed == 2 else (merging.LOCAL_EDGES,):
        got = merging.merge(table(spark, rows), local)
        assert got.phases == phases and {r["id"]: r["root"] for r in got.labels.collect()} == root
        assert sorted(map(tuple, got.forest.collect())) == [(k + 1, a, b) for k, own in enumerate(picked) for a, b in own]
    metrics = sorted(map(tuple, merging.phase_metrics(got).collect()))
    left = len({x for own in picked for e in own for x in e})
    for k, own in enumerate(picked):
        left -= len(own)
        assert metrics[k] == (k + 1, len(own), left)


def test_search_in_one_task_and_spread_agree(spark):
    e = generators.exact(spark, 200, 0.9 / 200, 4).cache()
    want = sorted(map(tuple, search.levels(e, local=0).collect()))
    assert sorted(map(tuple, search.levels(e).collect())) == want
    counts = {r["id"]: r["children"] for r in search.children(search.levels(e)).collect()}
    assert all(counts[i] == sum(1 for w in want if w[2] == i != w[0]) for i in counts) and len(counts) == 200
