from collections import defaultdict

import pytest

from islet.llm import mixing
from islet.llm.queries import op9_mixing

from .samples import ODD, none, odd


def test_targets_share_the_excess():
    got = mixing.targets([100, 1000, 10], [5, 2, 1])
    assert got[0] == 300 and got[2] == 30 and abs(sum(got) - 1110) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [5, 2]) == [0, 5.0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_reach_their_targets(spark, sf):
    rows = op9_mixing(spark, f"/root/testdata/{sf}").collect()
    taken, goal, own, most = defaultdict(int), {}, {}, defaultdict(int)
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        goal[s], own[s] = r["target"], r["source_size"]
        most[s] = max(most[s], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(goal.values()) - sum(own.values())) < 1e-6 * sum(own.values())
    assert list(goal) and goal == dict(zip(sorted(own), mixing.targets([own[s] for s in sorted(own)], [(5, 2, 1)[i % 3] for i in range(len(own))])))
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.5 * most[s] + 1, s


def test_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))
    b = sorted(map(tuple, mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()))
    assert a == b


def test_odd_rows(spark):
    assert mixing.mix(odd(spark)).count() == len(ODD)
    assert mixing.mix(none(spark)).count() == 0
    assert mixing.mixture(none(spark)).count() == 0
    assert mixing.mixture(odd(spark)).columns == odd(spark).columns
    empty = [r for r in mixing.mix(odd(spark)).collect() if r["size"] == 0]
    assert len(empty) == 3 and all(r["copies"] == 1 and r["taken"] == 0 for r in empty)


def test_a_source_of_one_size_is_spread(spark):
    docs = spark.createDataFrame([(i, "a b c", "hot" if i % 3 else "x") for i in range(3000)], "doc_id long, text string, source string")
    taken = {r["source"]: r["t"] for r in mixing.mix(docs, ("doc_id", "source")).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    goal = dict(zip(("hot", "x"), mixing.targets([6000, 3000], [5, 2])))
    assert all(abs(taken[s] - goal[s]) <= 6 for s in goal)


def test_rates_solve_the_balance(spark):
    """Rates against bisection of each source's own equation in plain Python."""
    import math

    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ("doc_id", "source")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) and r["copies"] <= 3
    for own in by.values():
        goal, low, high = own[0]["target"], -1.0, math.log(3) / min(r["size"] for r in own if r["size"])
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if sum(r["size"] * min(3.0, math.exp(tilt * r["size"])) for r in own) < goal else (low, tilt)
        assert all(abs(r["rate"] - min(3.0, math.exp(tilt * r["size"]))) < 1e-5 for r in own)


def test_names_that_clash(spark):
    with pytest.raises(ValueError, match="size"):
        mixing.mix(odd(spark), ("doc_id", "Size"))


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(spark.createDataFrame([(i, "a", str(i)) for i in range(3)], "doc_id long, text string, source string"))


def test_a_great_share_of_one_text(spark):
    docs = spark.createDataFrame([(i, "a b c d" if i % 3 else "w " * (i % 40), "s" if i % 5 else None) for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs.repartition(6), ("doc_id", "source")).collect()
    for s in ("s", None):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20
