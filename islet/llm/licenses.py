"""Licence scans: sparse TF-IDF cosine of passages to templates, inherited from the nearest directory above."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from islet.storage import drop, stage

#: Licences and the wordings by which files state them. Licence names and their usual headers.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *(
        (f"{short}-{version}", wording.format(name, number))
        for short, name, versions in (("GPL", "General", "1.0 2.0 3.0"), ("LGPL", "Lesser General", "2.1 3.0"), ("AGPL", "Affero General", "3.0"))
        for version in versions.split()
        for number in [version.removesuffix(".0")]
        for wording in (
            "This work is licensed under the GNU {} Public License, version {}.",
            "under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License",
        )
        if (short, version, wording[:4]) != ("GPL", "3.0", "This")
    ),
    *(
        (f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.")
        for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
        for version in ("2.0", "2.5", "3.0", "4.0")
        if (kind, version) != ("BY-NC", "4.0")
    ),
)
#: Whole texts of short licences, for licence files and headers. The licences' own words.
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
)
_TERM = r"[\p{L}\p{N}]+"
#: Files that hold a licence by their name, and lines of a header: comments in the usual languages, at the top of a file.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$"
HEADER = r"^\s*(?:/\*+|\*+/?|//+|#+|--|;+|%+|<!--|\"{3})(?:\s|$)"


def terms(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return re.findall(r"[^\W_]+", text.lower())


@dataclass(frozen=True)
class Space:
    """Template vectors by template and term, the weight of each term, and of a term of no template."""

    vectors: list[tuple[int, str, str, float]]  # template, licence, term, part of the unit vector
    idf: dict[str, float]
    other: float
    needed: list[str]  # a passage without any of these reaches no template


def space(templates, counts: dict[str, int], n: int, least: float) -> Space:
    """Weigh the templates by document frequencies of their terms.

    ``needed`` is exact: leave out of each template its commonest terms as long as they make up less
    than ``least`` of its length; a passage that shares only those has a smaller cosine (Cauchy-Schwarz).
    """
    idf = {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for _, text in templates for t in terms(text)}
    vectors, needed = [], set()
    for k, (name, text) in enumerate(templates):
        tf = {t: terms(text).count(t) for t in terms(text)}
        size = math.sqrt(sum((f * idf[t]) ** 2 for t, f in tf.items()))
        vectors += [(k, name, t, f * idf[t] / size) for t, f in sorted(tf.items())]
        common = 0.0
        for t in sorted(tf, key=lambda t: (idf[t], t)):
            common += (tf[t] * idf[t] / size) ** 2
            if common >= (least * 0.999) ** 2:
                needed.add(t)
    return Space(vectors, idf, math.log(1 + n) + 1, sorted(needed))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _windows(files: DataFrame, templates, s: Space, least: float) -> DataFrame:
    """``key, line, own, run``: windows of template ``own``'s length that may reach it; ``line`` is the first word's number.

    Rows are made from their own text alone. A window's cosine is at most the length of the
    template's part on the terms that it holds (exact, Cauchy-Schwarz).
    """
    longest = max(len(terms(text)) for _, text in templates)
    needed = F.array(*(F.lit(t) for t in s.needed))
    heads_ = sorted({t for _, text in templates for t in terms(text)})

    def cut(words: Column) -> Column:
        from_here = F.transform(words, lambda w, i: F.struct(i.alias("line"), w.alias("head"), F.when(w.isin(*heads_), F.slice(words, i + 1, longest)).alias("run")))
        return F.filter(from_here, lambda x: x["run"].isNotNull() & F.arrays_overlap(x["run"], needed))

    # an array of one, so that the words are listed once
    cuts = files.select("key", F.explode(F.flatten(F.transform(F.array(_words(F.col("text"))), cut))).alias("x")).select("key", "x.*")
    heads = []
    for k, (_, text) in enumerate(templates):
        own = [(t, p * p) for j, _, t, p in s.vectors if j == k]
        heads += [(k, t, len(terms(text)), own) for t, _ in own]
    shapes = F.broadcast(files.sparkSession.createDataFrame(heads, "own int, head string, many int, parts array<struct<t: string, p: double>>"))
    runs = cuts.join(shapes, "head").withColumn("run", F.slice("run", F.lit(1), F.col("many")))
    bound = F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.when(F.array_contains(F.col("run"), x["t"]), x["p"]).otherwise(0.0))
    return runs.where(bound >= (least * 0.999) ** 2).select("key", "line", "own", "run")


def _able(s: Space, version: list[str | None], least: float) -> Column:
    """Whether the terms ``seen`` in a text could make up a passage that reaches a template (exact, Cauchy-Schwarz)."""
    shapes: list[dict] = [{"version": v, "parts": []} for v in version]
    for k, _, t, p in s.vectors:
        shapes[k]["parts"].append({"t": t, "p": p * p})
    every = F.from_json(F.lit(json.dumps(shapes)), "array<struct<version: string, parts: array<struct<t: string, p: double>>>>")

    def reached(x: Column) -> Column:
        held = F.aggregate(x["parts"], F.lit(0.0), lambda a, y: a + F.when(F.array_contains("seen", y["t"]), y["p"]).otherwise(0.0))
        return (x["version"].isNull() | F.array_contains("seen", x["version"])) & (held >= (least * 0.999) ** 2)

    return F.arrays_overlap("seen", F.array(*(F.lit(t) for t in s.needed))) & F.exists(every, reached)


def _whole(files: DataFrame) -> DataFrame:
    """``key, line, own, run``: the words of each licence file, and of each header (the comment lines at the top, two at least)."""
    text = F.col("text")
    lines = F.split(text, "\n")
    body = F.array_position(F.transform(lines, lambda x: x.rlike(HEADER) | (F.trim(x) == "")), F.lit(False))
    top = F.slice(lines, F.lit(1), F.when(body == 0, F.size(lines)).otherwise(body - 1).cast("int"))
    header = F.when(F.size(F.filter(top, lambda x: x.rlike(HEADER))) >= 2, F.array_join(top, "\n"))
    found = files.select("key", F.when(F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)), text).otherwise(header).alias("text"))
    return found.where("text is not null").select("key", F.lit(0).alias("line"), F.lit(-2).alias("own"), _words(F.col("text")).alias("run"))


def passages(files: DataFrame, templates=TEMPLATES, least: float = 0.6, texts=TEXTS) -> DataFrame:
    """``key, license, score, words``: the best template of each file's passages, where it reaches ``least``.

    ``files(key, path, text, seen)`` with the template terms ``seen`` in each text. Licence files and headers are compared whole with the templates and
    the whole ``texts``. Statements stand in other places too: document frequencies of all template terms are counted over all files;
    terms of no template share one weight, that of a term of one file. Each line of the whole text
    is compared with each template, and each template with the windows of as many words, across
    lines, that begin with a term of it. What can't reach ``least`` is seen by its terms and left out
    before its vector is made, whole texts first, by the terms that they hold anywhere. A passage without the first number of a template, its version, doesn't
    state it. ``words``: words on lines that reach ``least``, or in windows or whole files and headers
    that do if these are more.
    """
    spark = files.sparkSession
    short, every = len(templates), (*templates, *texts)
    counts = {r["t"]: r["count"] for r in files.select(F.explode("seen").alias("t")).groupBy("t").count().collect()}
    s = space(every, counts, files.count(), least)
    version = [next((t for t in terms(text) if t.isdigit()), None) for _, text in every]
    able = stage(files.where(_able(s, version, least)).select("key", "path", "text"), "able")
    cue = r"(?<![\p{L}\p{N}])(?:" + "|".join(s.needed) + r")(?![\p{L}\p{N}])"
    lines = F.filter(F.split(F.lower("text"), "\n"), lambda x: x.rlike(cue))
    some = able.select("key", F.posexplode(lines).alias("line", "raw")).select("key", "line", F.lit(-1).alias("own"), _words(F.col("raw")).alias("run"))
    some = some.unionByName(_windows(able, templates, s, least)).unionByName(_whole(able))
    word = some.select("key", "line", "own", F.explode("run").alias("term")).groupBy("key", "line", "own", "term").agg(F.count("*").alias("tf"))
    marked = [(*v, int(v[2] == version[v[0]]), int(version[v[0]] is not None)) for v in s.vectors]
    vectors = F.broadcast(spark.createDataFrame(marked, "template int, license string, term string, part double, is_version int, versions int"))
    weights = F.broadcast(spark.createDataFrame(sorted(s.idf.items()), "term string, idf double"))
    weighed = word.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(s.other)))
    sizes = weighed.groupBy("key", "line", "own").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.sum("tf").alias("words"))
    # the whole texts are for whole files and headers
    met = weighed.join(vectors, "term").where(f"own = -2 or (own in (-1, template) and template < {short})").groupBy("key", "line", "own", "template", "license")
    dots = met.agg(F.sum(F.col("w") * F.col("part")).alias("dot"), F.sum("is_version").alias("met"), F.max("versions").alias("versions")).where("met = versions")
    scored = dots.join(sizes, ["key", "line", "own"]).withColumn("score", F.round(F.col("dot") / F.col("size"), 6)).where(F.col("score") >= least)
    by_line = scored.groupBy("key", "line", "own", "words").agg(F.max(F.struct("score", (-F.col("template")).alias("t"), "license")).alias("best"))
    best = F.max(F.struct(F.col("best.score").alias("score"), F.col("best.t").alias("t"), F.col("best.license").alias("license")))
    on_lines = F.coalesce(F.sum(F.when(F.col("own") == -1, F.col("words"))), F.lit(0))
    places = F.collect_list(F.when(F.col("own") >= 0, F.sequence(F.col("line"), (F.col("line") + F.col("words") - 1).cast("int"))))
    in_windows = F.size(F.array_distinct(F.flatten(places)))
    in_whole = F.coalesce(F.max(F.when(F.col("own") == -2, F.col("words"))), F.lit(0))
    return by_line.groupBy("key").agg(best.alias("best"), F.greatest(on_lines, in_windows, in_whole).alias("words")).select("key", "best.license", "best.score", "words")


def directory(path: Column) -> Column:
    """The directory of a path, without a slash at its end; the root is empty."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


#: Parts into which the files of one directory are dealt when they look it up.
SALTS = 32


def scan(files: DataFrame, templates=TEMPLATES, least: float = 0.6, file_share: float = 0.2) -> DataFrame:
    """Licence of every row of ``files(path, text, ...)``: its columns but the text, with license, score, origin, license_path.

    ``origin``: ``own`` (a passage of the file states it), ``inherited`` (the nearest directory above
    the file, its own first, that holds a licence file) or ``none``. A licence file is one named
    LICENSE, LICENCE, COPYING or NOTICE, or one of whose words a ``file_share`` is in such passages; of
    several in a directory the best score counts, then the first path.

    Directories are looked up once each, not once a file: distinct directories meet licensed ones
    at each of their ancestors, and files meet their directory, dealt out in ``SALTS`` parts so that
    one directory may hold most files. Texts are written once and move no more. Null text: states
    nothing. Null path: inherits nothing, and its file gives nothing to others. Very long texts are
    read whole. Rows of one path are rows of their own. No rows: an empty table. ValueError if a
    column is named like an added one.
    """
    clash = {c.lower() for c in files.columns} & {"license", "score", "origin", "license_path"}
    if clash:
        raise ValueError(f"columns are named like added ones: {sorted(clash)}")
    light = F.struct(*(F.col(f"`{c}`") for c in files.columns if c.lower() != "text")).alias("_row")
    whole = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    made = files.select(light, F.col("path").cast("string").alias("path"), whole, F.monotonically_increasing_id().alias("key")).withColumn("_words", _words(F.col("text")))
    marks = F.array(*(F.lit(t) for t in sorted({t for _, text in (*templates, *TEXTS) for t in terms(text)})))
    kept = stage(made.select("_row", "path", "text", "key", F.array_intersect("_words", marks).alias("seen"), F.size("_words").alias("_n")), "files")
    found = stage(passages(kept.select("key", "path", "text", "seen"), templates, least), "stated")
    rows = kept.select("_row", "path", "key", directory(F.col("path")).alias("_dir"), "_n").join(found, "key", "left")
    rows = stage(rows, "licensed")
    drop(kept, found)
    givers = rows.where(F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("words") >= file_share * F.col("_n"))))
    best = F.min(F.struct((-F.col("score")).alias("score"), "path", "license")).alias("g")
    give = givers.groupBy("_dir").agg(best).select(F.col("_dir").alias("_above"), (-F.col("g.score")).alias("_score"), F.col("g.path").alias("_path"), F.col("g.license").alias("_license"))
    dirs = rows.where(F.col("path").isNotNull()).select("_dir").distinct()
    steps = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    near = dirs.select("_dir", F.posexplode(F.array_distinct(above)).alias("_depth", "_above")).join(give, "_above")
    near = near.groupBy("_dir").agg(F.max(F.struct("_depth", "_license", "_score", "_path")).alias("near"))
    near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(near, ["_dir", "_salt"], "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    pick = lambda a, b: F.when(F.col("license").isNotNull(), F.col(a)).otherwise(F.col(f"near.{b}"))
    return out.select("_row.*", pick("license", "_license").alias("license"), pick("score", "_score").alias("score"), origin.alias("origin"), pick("path", "_path").alias("license_path"))
