from collections import Counter

import corpus_pipeline as p
from islet.llm import mixing
from islet.storage import stage

from .samples import none, odd
from .test_near_duplicates import brute
from .test_quality_rules import brute as counts
from .test_tokens import ids_of


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, step in p.STAGES:
        docs.append(stage(step(spark, docs[-1], sf), name.replace(" ", "-")))
    for df in docs[1:-1]:
        assert df.columns == docs[0].columns
    raw, good, told, once, mixed, packed = ([r.asDict() for r in df.collect()] for df in docs)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    for r in raw:
        n, _, _, _, repeated = counts(r["text"])
        base = n >= 50 and 2 * repeated <= n
        assert base or r["doc_id"] not in kept
        if base and quality.get(r["doc_id"]) == 1:
            assert r["doc_id"] in kept
        if quality.get(r["doc_id"]) == 0:
            assert r["doc_id"] not in kept
    assert {r["doc_id"] for r in told} == kept
    classes = brute({r["doc_id"]: r["text"] for r in told})
    assert {r["doc_id"] for r in once} == set(classes.values()) and len(once) == len(set(classes.values()))
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs[3]).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: n for d, n in want.items() if n})
    tokens = {r["doc_id"]: len(ids_of(r["text"], 1)) for r in once}
    assert sum(r["length"] for r in packed) == sum(tokens[r["doc_id"]] for r in mixed)
    ends = Counter()
    for r in packed:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi").where("n_chars > 400")
    assert p.languages(spark, clean, "").count() == clean.count()


def test_odd_tables_pass(spark):
    for docs in (odd(spark), none(spark)):
        for _, step in p.STAGES:
            step(spark, docs, "").count()
