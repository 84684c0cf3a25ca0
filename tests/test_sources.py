import pytest

from islet.functions.scalars import machine_hash, regime_probability
from islet.operators import census, edges
from islet.plans import reports
from islet.sources import edge_files, results
from islet.storage import new_path


def local(path):
    return path.removeprefix("file://")


def test_text_lines(spark):
    lines = ["# comment", "1 2", "2\t3", "  4   5 trailing", "7", "a b", "", "4294967295 0", "4294967296 1", "99999999999999999999999999999999999999999 1", "-1 2"]
    got = edge_files.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in got.collect()] == [(1, 2), (2, 3), (4, 5), (4294967295, 0)]


def test_text_round_trip(spark):
    path, e = new_path(spark, "text"), spark.createDataFrame([(1, 2), (3, 3)], "u long, v long")
    edge_files.write_text(e, path)
    assert sorted(map(tuple, edge_files.read_text(spark, path).collect())) == [(1, 2), (3, 3)]


def test_packed_bytes(spark, tmp_path):
    edge_files.register(spark)
    rows = [(0, 0), (1, 1), (0, 1), (5, 4294967295)]
    raw = b"".join(edge_files.pack_record(*r) for r in rows)
    assert raw.hex() == "0000000000000000010000000100000000000000010000000" + "5000000ffffffff"
    (tmp_path / "g.ecg").write_bytes(raw + b"abc")
    assert [tuple(r) for r in spark.read.format("ecg").load(str(tmp_path / "g.ecg")).collect()] == rows
    split = spark.read.format("ecg").option("split_bytes", 8).load(str(tmp_path))
    assert split.rdd.getNumPartitions() == 4 and sorted(map(tuple, split.collect())) == sorted(rows)
    assert sorted(map(tuple, edge_files.read_packed(spark, str(tmp_path / "g.ecg")).collect())) == sorted(rows)
    (tmp_path / "e.ecg").write_bytes(b"")
    assert spark.read.format("ecg").load(str(tmp_path / "e.ecg")).count() == 0


def test_packed_writer(spark, tmp_path):
    edge_files.register(spark)
    path = str(tmp_path / "out")
    spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long").repartition(3).write.format("ecg").mode("append").save(path)
    spark.createDataFrame([(7, 7)], "u long, v long").write.format("ecg").mode("append").save(path)
    assert spark.read.format("ecg").load(path).count() == 101
    spark.createDataFrame([(1, 4294967295)], "u long, v long").write.format("ecg").mode("overwrite").save(path)
    assert [tuple(r) for r in spark.read.format("ecg").load(path).collect()] == [(1, 4294967295)]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(-1, 2)], "u long, v long").write.format("ecg").mode("append").save(path)
    assert spark.read.format("ecg").load(path).count() == 1


def test_summaries_and_roll_up(spark):
    e = spark.createDataFrame([(1, 2), (3, 3)], "u long, v long")
    top = new_path(spark, "runs")
    for engine in ("merging", "search"):
        results.write_summary(census.summary(e, engine), f"{top}/{engine}")
    got = results.read_summaries(spark, top, "*.csv")
    rows = {r["p"]: r for r in got.collect()}
    assert set(rows) == {None, 2} and all((r["n"], r["f"], r["cm"], r["cv"]) == (2 + 1, 2, 1.5, 0.25) for r in rows.values())
    assert rows[None]["r"] == 5 and rows[2]["r"] is None
    results.write_roll_up(got.unionByName(got), f"{top}-all")
    assert results.read_summaries(spark, f"{top}-all").count() == 2
    results.write_listing(spark.createDataFrame([(3, 1), (1, 2)], "iC long, nC long"), f"{top}-listing")
    assert [r["iC"] for r in spark.read.csv(f"{top}-listing", header=True, inferSchema=True).collect()] == [1, 3]
    edge_files.write_adjacency(edges.adjacency(e), f"{top}-graph")
    assert sorted(r["value"] for r in spark.read.text(f"{top}-graph").collect()) == ["1: 2", "2: 1", "3: "]


def test_machine_hash(spark):
    from pyspark.sql import functions as F

    a, b = 2**61 - 3, 2**60 + 12345
    ids = [0, 1, 77, 2**31, 4294967295]
    got = spark.createDataFrame([(i,) for i in ids], "v long").select("v", machine_hash(F.col("v"), a, b, 7).alias("m")).collect()
    assert {r["v"]: r["m"] for r in got} == {i: (a * i + b) % (2**61 - 1) % 7 for i in ids}
    with pytest.raises(ValueError):
        machine_hash(F.col("v"), 2**61, 0, 2)


def test_regimes_and_reports(spark):
    assert regime_probability("1", 1024) == 1 / 1024 and abs(regime_probability("1-", 10) - 0.08) < 1e-12
    with pytest.raises(ValueError):
        regime_probability("2", 10)
    assert reports.sweep(spark, range(10, 12)).count() == 2 * 6 * 2 * 3
    points = spark.createDataFrame([("a", float(x), 3.0 * x * x) for x in range(1, 9)], "g string, n double, t double")
    fit = reports.regressions(points, ["g"], "n", "t").first()
    assert abs(fit["log_slope"] - 2) < 1e-9 and abs(fit["log_r2"] - 1) < 1e-9
    runs = spark.createDataFrame([(8, 1, 100), (8, 2, 50), (8, 4, 20)], "n long, k int, Tc long")
    assert {r["k"]: r["speedup"] for r in reports.speedups(runs).collect()} == {1: 1.0, 2: 2.0, 4: 5.0}
    moments = reports.running_moments(spark.createDataFrame([(1, 2), (2, 4)], "iC long, nC long")).orderBy("iC").collect()
    assert [(r["mean"], r["variance"]) for r in moments] == [(2.0, 0.0), (3.0, 1.0)]


def test_experiments(spark):
    from islet.plans import experiments

    sweep = reports.sweep(spark, range(5, 6), 1).where("regime in ('1', 'L')")
    rows = experiments.run(spark, sweep, ("stars", "merging"), (1, 3))
    assert rows.count() == 2 * 2 * 2 * 2
    assert rows.selectExpr("sampler", "regime", "n", "f", "cl", "round(cm, 9)", "cu", "round(cv, 9)").distinct().count() == 4
    path = new_path(spark, "sweep")
    experiments.write(rows, path)
    back = experiments.rolled(spark, path, engine="merging", regime="L")
    assert back.count() == 4 and {r["sampler"] for r in back.collect()} == {"exact", "monte_carlo"}


def test_sampled_edges(spark):
    e = spark.range(20000).selectExpr("id as u", "id + 1 as v")
    a, b = edges.sampled(e, 0.3, 1), edges.sampled(e.repartition(5), 0.3, 1)
    assert abs(a.count() - 6000) < 5 * 65 and a.exceptAll(b).isEmpty()
    assert edges.sampled(e, 0.0, 1).isEmpty() and edges.sampled(e, 1.0, 1).count() == 20000
