import math
from collections import Counter

import pytest

from islet.llm import licenses
from islet.llm.queries import op6_licenses

SCHEMA = "path string, text string, key string, n int"


def brute(texts, least=0.6):
    """Best template of each text, every line against every template."""
    n, df = len(texts), Counter(t for x in texts for t in set(licenses.terms(x or "")))
    every = {t for _, x in licenses.TEMPLATES for t in licenses.terms(x)}
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in every else math.log(1 + n) + 1
    out = []
    for text in texts:
        best = None
        for line in (text or "").split("\n"):
            x = {t: f * idf(t) for t, f in Counter(licenses.terms(line)).items()}
            for k, (name, template) in enumerate(licenses.TEMPLATES):
                y = {t: f * idf(t) for t, f in Counter(licenses.terms(template)).items()}
                dot = sum(v * y.get(t, 0) for t, v in x.items())
                if dot:
                    c = round(dot / math.sqrt(sum(v * v for v in x.values())) / math.sqrt(sum(v * v for v in y.values())), 6)
                    if c >= least:
                        best = max(best or (0, 0, ""), (c, -k, name))
        out.append(best)
    return out


def test_matches_every_line_against_every_template(spark):
    rows = op6_licenses(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = sorted(texts)
    want = dict(zip(ids, brute([texts[i] for i in ids])))
    assert len(rows) == len(ids) and sum(w is not None for w in want.values()) > 20
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["origin"] == "own") == (w is not None)
        if w:
            assert r["license"] == w[2] and abs(r["score"] - w[0]) < 2e-6


def test_nearest_directory_above_counts(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("LICENSE", mit, "a", 1),
        ("src/main.c", "int main", "a", 1),
        ("lib/COPYING.txt", apache, "a", 1),
        ("lib/x/y/z.c", "code here", "a", 1),
        ("lib/x/own.c", mit + "\n" + "many words of code " * 30, "a", 1),
        ("lib/x/deep.c", "", "a", 1),
        (None, "code", "a", 1),
        (None, mit, "a", 1),
        ("lib/x/deep.c", None, None, None),
        ("library/x.c", "prose", "a", 1),
    ]
    got = licenses.scan(spark.createDataFrame(files, SCHEMA)).collect()
    assert len(got) == len(files)
    text = {i: f[1] for i, f in enumerate(files)}
    got = licenses.scan(spark.createDataFrame([(*f[:3], i) for i, f in enumerate(files)], SCHEMA)).collect()
    found = {(r["path"], text[r["n"]]): (r["license"], r["origin"], r["license_path"]) for r in got}
    assert found["src/main.c", "int main"] == ("MIT", "inherited", "LICENSE")
    assert found["lib/x/y/z.c", "code here"] == ("Apache-2.0", "inherited", "lib/COPYING.txt")
    assert found["lib/x/deep.c", ""][0] == found["lib/x/deep.c", None][0] == "Apache-2.0"
    assert found["library/x.c", "prose"][0] == "MIT"
    assert found[None, "code"] == (None, "none", None) and found[None, mit][:2] == ("MIT", "own")
    assert next(r for r in got if r["path"] == "lib/x/own.c")["license"] == "MIT"


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_needed_terms_lose_no_passage(least):
    counts = {"the": 900, "under": 300, "license": 40, "is": 800, "of": 900, "to": 900, "a": 900, "this": 700, "work": 50}
    s = licenses.space(licenses.TEMPLATES, counts, 1000, least)
    for k, _ in enumerate(licenses.TEMPLATES):
        rest = math.sqrt(sum(p * p for t, _, w, p in s.vectors if t == k and w not in s.needed))
        assert rest < least


def test_statements_inside_lines_and_across_them(spark):
    mit = licenses.TEMPLATES[1][1]
    prose = "Some words of prose that say nothing of it but go on for a while and then"
    want = {
        "Copyright 2020 Jane Roe. Released under the MIT License. All rights reserved.": "MIT",
        f"{prose} licensed under the Apache License, Version 2.0. {prose}": "Apache-2.0",
        f"{prose} {mit}, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge": "MIT",
        prose + " " + mit.replace(" ", "\n", 12): "MIT",
        "GNU General Public License, version 2": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under CC BY-NC 7.0.": None,
        prose: None,
    }
    files = spark.createDataFrame([(None, text, None, i) for i, text in enumerate(want)], SCHEMA)
    assert {list(want)[r["n"]]: r["license"] for r in licenses.scan(files).collect()} == want


def test_licence_files_and_headers_are_compared_whole(spark):
    mit, isc, apache = (dict(licenses.TEXTS)[k] for k in ("MIT", "ISC", "Apache-2.0"))
    wrapped = lambda text, mark: "\n".join(f"{mark} " + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    body = "\nint main() { return 0; }\n" * 40
    want = {
        ("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + mit): "MIT",
        ("b/COPYING", "Copyright 2020 Jane Roe\n\n" + isc): "ISC",
        ("c/x.py", "#!/usr/bin/env python\n" + wrapped(apache, "#") + body): "Apache-2.0",
        ("d/x.c", "/*\n" + wrapped(mit, " *") + "\n */" + body): "MIT",
        ("e/x.c", "/* Just a program\n * that says hello */" + body): None,
        ("f/LICENSE", "All rights reserved."): None,
    }
    rows = [(path, text, None, i) for i, (path, text) in enumerate(want)]
    got = {r["n"]: (r["license"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i][0] for i in range(len(rows))] == list(want.values())
    assert got[0][1] > 0.9 and got[1][1] > 0.9


def test_rows_without_an_id_give_nothing(spark):
    """op6's tree, and its SQL, on rows without doc_id."""
    import duckdb

    from islet.llm import oracle
    from islet.llm.queries import _tree

    rows = [(None, "Released under the MIT License.", "web"), (7, "prose and prose", "web"), (8, None, "books"), (9, "Licensed under CC BY-NC 4.0.", None), (10, "x", None), (9, "same id", None)]
    got = licenses.scan(_tree(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    found = sorted(map(str, (tuple(r) for r in got.select("doc_id", "path", "license", "origin", "license_path").collect())))
    assert len(found) == 6 and sum("'MIT'" in r for r in found) == 1 and sum("CC-BY-NC" in r for r in found) >= 2
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows[:-1])
    got = licenses.scan(_tree(spark.createDataFrame(rows[:-1], "doc_id long, text string, source string")))
    columns = ["doc_id", "path", "license", "score", "origin", "license_path"]
    want = c.sql(oracle.licenses()).project(", ".join(columns)).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


def test_one_directory_of_most_files_long_texts_and_names(spark):
    mit = licenses.TEMPLATES[0][1]
    files = [("hot/LICENSE", mit, "a", 0)] + [(f"hot/{i}.txt", "prose " * (50_000 if i == 1 else 3), "a", i) for i in range(1, 400)]
    table = spark.createDataFrame(files, SCHEMA).withColumnRenamed("key", "_dir")
    got = licenses.scan(table.repartition(3))
    assert got.columns == ["path", "_dir", "n", "license", "score", "origin", "license_path"]
    assert got.where("license = 'MIT' and license_path = 'hot/LICENSE'").count() == 400
    with pytest.raises(ValueError, match="score"):
        licenses.scan(table.withColumnRenamed("n", "Score"))


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
