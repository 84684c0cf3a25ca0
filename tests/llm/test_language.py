import math
import random
import zlib

import numpy as np
import pytest
import regex as re

from islet.llm import language
from islet.llm.queries import op4_language

from .samples import ODD, none, odd


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "n_chars").collect()}
    rows = op4_language(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(docs)
    right, tried = 0, 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"]:
            tried += 1
            right += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert tried > 2000 and right >= 0.985 * tried


def grams(text):
    """Sets of n-grams by their definition: lower case, anything but letters and marks is one blank."""
    word = re.sub(r"[^\p{L}\p{M}]+", " ", " " + text.lower() + " ")
    return {word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1)}


SCRIPTS = {
    "en": ["the cat sat on the mat", "a dog ran off with the hat", "this and that are things"],
    "de": ["der hund und die katze", "das haus ist nicht groß", "über straßen gehen füße"],
    "zh": ["我们今天去学校学习中文", "他喜欢吃苹果和香蕉水果", "天气很好我们出去玩吧"],
    "ja": ["私は学校に行きました", "猫がとても好きですよね", "今日はいい天気ですね"],
    "hi": ["मैं आज स्कूल जा रहा हूँ", "बिल्ली दूध पीती है और सोती है", "यह किताब बहुत अच्छी है"],
}


def test_kernel_ridge_against_plain_sets():
    """Kernel, whitening, ridge regression and scores by the definitions, over scripts of thousands of letters."""
    texts, labels = [t for own in SCRIPTS.values() for t in own], [k for k in SCRIPTS for _ in range(3)]
    m = language.train(texts, labels, landmarks=10, ridge=1e-3)
    turn = [3 * k + i for i in range(2) for k in sorted(range(5), key=list(SCRIPTS).__getitem__)]
    cosine = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    new = [*texts, "the 猫 sat!", "ελληνικά", "好 (2) the"]
    k = np.array([[cosine(grams(t), grams(texts[j])) for j in turn] for t in new])
    assert np.abs(m.kernel(new) - k).max() < 1e-9
    values, vectors = np.linalg.eigh(k[turn])
    x = k @ (vectors / np.sqrt(values))
    mean = x[: len(texts)].mean(axis=0)
    for at, name in enumerate(m.languages):
        y = np.where(np.array(labels) == name, 1.0, -1.0)
        z = x[: len(texts)] - mean
        w = np.linalg.solve(z.T @ z + 1e-3 * len(texts) * np.eye(len(turn)), z.T @ (y - y.mean()))
        want = (x - mean) @ w + y.mean()
        assert np.abs(m.kernel(new) @ m.weights[:, at] + m.offset[at] - want).max() < 1e-6
    assert m.predict(texts)[0] == labels
    assert m.predict(["the cat", "und der", "学校学习", None, "", "12 -- 3"])[0] == ["en", "de", "zh", "und", "und", "und"]


def test_every_label_is_learned(spark):
    rng = random.Random(3)
    rows = [(" ".join("".join(chr(0x4E00 + 40 * i + rng.randrange(12)) for _ in range(4)) for _ in range(12)) + " text", f"l{i:03}") for i in range(90) for _ in range(6)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), landmarks=20)
    assert len(model.languages) == 90 and len(model.sizes) == 180
    assert model.predict([t for t, _ in rows])[0] == [name for _, name in rows]


def test_long_and_clashing(spark):
    model = language.train([t for own in SCRIPTS.values() for t in own], [k for k in SCRIPTS for _ in range(3)])
    assert model.predict(["das haus und der hund " * 40_000, "x"])[0][0] == "de"
    docs = odd(spark).withColumnRenamed("f", "score")
    with pytest.raises(ValueError, match="score"):
        language.predict(docs, model, carry=("doc_id", "score"))
    assert language.keep(docs.withColumnRenamed("size", "lang_pred")).columns == docs.withColumnRenamed("size", "lang_pred").columns


def test_copies_leave_the_quota_to_other_texts(spark, monkeypatch):
    rows = [("hot copy", "en")] * 20000 + [(f"text number {i}", "en") for i in range(30)]
    monkeypatch.setattr(language, "train", lambda texts, labels: texts)
    assert len(set(language.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=5))) == 5


def test_odd_rows(spark):
    docs = odd(spark)
    model = language.fit(docs.select("text", "lang"))
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert language.fit(none(spark).select("text", "lang")) is None
    assert [r["lang_pred"] for r in language.predict(docs, None).select("lang_pred").distinct().collect()] == ["und"]
    assert language.keep(docs).columns == docs.columns
    assert language.keep(none(spark)).count() == 0
