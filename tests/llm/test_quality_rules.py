import ast
import os
import re
import subprocess
import sys

import pytest

from islet.llm import quality_rules as q
from islet.llm.queries import op2_quality_rules

from .samples import ODD, none, odd


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rows = op2_quality_rules(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("text", ["a b c a b c a b c", "x y\nx y\n\n \nx y", "a a a a", "a b", "p q r s p q r", "\x0ba\x0cb c d"])
def test_counts_of_small_texts(spark, text):
    f = q.features(spark.createDataFrame([(text,)], "text string")).first()["f"]
    assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == brute(text)


def test_odd_rows(spark):
    scored = q.score(odd(spark).select("doc_id", "text")).collect()
    assert len(scored) == len(ODD)
    assert [r["f"]["n_words"] for r in scored if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert "text" not in scored[0].asDict()
    assert q.keep(odd(spark)).columns == odd(spark).columns
    assert q.keep(none(spark)).count() == 0
    assert q.score(none(spark).select("doc_id", "text")).count() == 0


LONG = [
    "a b c a b c a b c", "x y\nx y\n\n \nx y", "a a a a", "a b", "p q r s p q r", "\x0ba\x0cb c d", " \n\t \n" * 9, "w" * 50, "  a" + " " * 40 + "b c a b c  ",
    "Who?! Me... \U0001d400\U0001d401 \u00c9t\u00e9! # $$ a.b\n" * 5 + "\n\n", "one two\nthree four five one two\nthree four\nthree four", "\U0001f600x\U0001f600 " * 20,
]


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_pieces_count_what_whole_texts_do(spark, monkeypatch, piece):
    monkeypatch.setattr(q, "PIECE", piece)
    texts = spark.createDataFrame(list(enumerate(LONG)), "_n long, _long string")
    assert {r["_n"]: r["f"] for r in q.long_features(texts).collect()} == {r["_n"]: r["f"] for r in q.features(texts, "_long").collect()}


def test_long_texts_are_judged_like_short_ones(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    ways = []
    for longest, piece in ((1 << 20, 1 << 16), (2000, 300), (0, 300)):
        monkeypatch.setattr(q, "LONGEST", longest), monkeypatch.setattr(q, "PIECE", piece)
        scored, kept = q.score(docs), q.keep(docs)
        ways.append((scored.columns, sorted(map(str, scored.collect())), kept.columns, sorted(map(str, kept.collect()))))
    assert ways[0] == ways[1] == ways[2]


def test_text_of_many_megabytes_fits_a_small_heap(tmp_path):
    """6 million words in one row took over 1.8 GB of heap as arrays."""
    code = """if True:
        import sys
        from pyspark.sql import SparkSession, functions as F
        from islet.llm import quality_rules as q
        spark = SparkSession.builder.master("local[1]").config(map={"spark.ui.enabled": "false", "spark.checkpoint.dir": sys.argv[1], "spark.sql.shuffle.partitions": "8"}).getOrCreate()
        spark.range(1).select("id", F.expr("repeat('The cat sat on the old mat again. ', 880000)").alias("text")).write.parquet(sys.argv[1] + "/in")
        print(q.score(spark.read.parquet(sys.argv[1] + "/in")).first()["f"].asDict())
    """
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 1200m pyspark-shell", "PYTHONPATH": repo}
    ran = subprocess.run([sys.executable, "-c", code, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0, ran.stderr[-2000:]
    f = ast.literal_eval(ran.stdout.strip().splitlines()[-1])
    n = 8 * 880000
    assert (f["n_words"], f["word_chars"], f["n_repeat_words"], f["n_distinct"], f["n_lines"], f["n_ends"]) == (n, 26 * 880000, n, 8, 1, 880000)


def test_junk_goes_and_prose_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    kept = {(r["quality"], r["kept"]): r["n"] for r in q.score(docs.select("doc_id", "text", "quality")).where("not base_failed").groupBy("quality", "kept").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert kept.get((1, False), 0) <= 0.005 * kept[(1, True)]
    assert kept.get((0, True), 0) <= 0.05 * kept[(0, False)]


def test_fit_recovers_accuracies(spark):
    import random

    rng, names = random.Random(1), ("a", "b", "c", "d")
    rules = tuple(q.Rule(n, "0", "", "") for n in names)
    true = {"a": (0.95, 0.9), "b": (0.9, 0.8), "c": (0.99, 0.6), "d": (0.9, 0.7)}
    rows = []
    for _ in range(20000):
        good = rng.random() < 0.8
        rows.append(tuple(None if rng.random() < 0.2 else int(good == (rng.random() < true[n][0 if good else 1])) for n in names))
    table = spark.createDataFrame(rows, "a int, b int, c int, d int").groupBy(*names).count().withColumnRenamed("count", "n").cache()
    w = q.fit(table, rules)
    assert abs(w.good - 0.8) < 0.05
    for n, a, b in zip(names, w.on_good, w.on_bad):
        assert abs(a - true[n][0]) < 0.06 and abs(b - true[n][1]) < 0.12


def test_estimates_match_a_plain_computation(spark):
    """The verdicts of op2 against expectation-maximisation over single texts, written out with numpy."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scored = {r["doc_id"]: r for r in q.score(docs).collect()}
    votes = np.array([[-1 if r[x.name] is None else r[x.name] for x in q.RULES] for r in scored.values()])
    good, on_good, on_bad = 0.85, np.full(len(q.RULES), 0.99), np.full(len(q.RULES), 0.4)

    def posterior():
        like_good = np.where(votes == 1, on_good, np.where(votes == 0, 1 - on_good, 1)).prod(axis=1) * good
        like_bad = np.where(votes == 0, on_bad, np.where(votes == 1, 1 - on_bad, 1)).prod(axis=1) * (1 - good)
        return like_good / (like_good + like_bad)

    for _ in range(3000):
        p = posterior()
        share = [[(w * (votes == v).T).sum(axis=1) for v in (1, 0)] for w in (p, 1 - p)]
        on_good = np.clip((share[0][0] + 9.5) / (share[0][0] + share[0][1] + 10), 0.5, 0.9999)
        on_bad = np.clip((share[1][1] + 1) / (share[1][0] + share[1][1] + 2), 1 - on_good, 0.9999)
        good = (p.sum() + 8.5) / (len(p) + 10)
    for p, r in zip(posterior(), scored.values(), strict=True):
        assert abs(p - r["posterior"]) < 1e-3
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_a_rare_kind_of_junk_goes(spark):
    """Rules are weighed alike however few texts each kind of junk has."""
    good, noisy, doubled = (1,) * 8, (0, 0, 1, 1, 1, 1, 1, 1), (1, 1, 0, 0, 1, 1, 1, 1)
    w = q.estimated([(good, 100_000), (noisy, 2000), (doubled, 300), ((1, 1, 1, None, 1, 1, 1, 1), 3000)], 8)
    assert w.log_odds(good) > 5 and w.log_odds(noisy) < 0 and w.log_odds(doubled) < 0


def test_clashing_names(spark):
    docs = odd(spark).withColumnRenamed("size", "repeats")
    with pytest.raises(ValueError, match="'f'"):
        q.score(docs)
    assert q.keep(docs).columns == docs.columns
