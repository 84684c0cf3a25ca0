from islet.llm import quotations

SCHEMA = "conv_id long, turn long, role string, text string, key string, line int"


def rows(spark, *items):
    return spark.createDataFrame([(*i, "k", 1) for i in items], SCHEMA)


def by_turn(df):
    return {(r["conv_id"], r["turn"]): r for r in df.collect()}


def test_quotes_link_to_their_origin(spark):
    got = by_turn(quotations.link(rows(
        spark,
        (1, 0, "user", "How do I sort?\nI have a list."),
        (1, 1, "assistant", "Use sorted."),
        (1, 2, "user", "> How do  I SORT?\n\nAnd backwards?"),
        (1, 5, "assistant", ">> I have a list.\n> Use sorted.\n> Unknown words\nReversed too."),
        (2, 0, "user", "> Use sorted.\nNo origin here"),
        (2, 1, "user", "fine"),
    )))
    assert got[1, 2]["reply_to"] == 0 and got[1, 2]["text"] == "And backwards?"
    assert got[1, 5]["reply_to"] == 1 and got[1, 5]["n_quoted"] == 3 and got[1, 5]["n_linked"] == 2 and got[1, 5]["max_level"] == 2
    assert got[1, 5]["text"] == "Reversed too."
    assert got[1, 1]["reply_to"] == 0 and got[1, 0]["reply_to"] is None
    assert got[2, 0]["reply_to"] is None and got[2, 0]["n_linked"] == 0 and got[2, 1]["reply_to"] == 0
    order = [t for _, t in sorted((r["position"], k[1]) for k, r in got.items() if k[0] == 1)]
    assert order == [0, 1, 2, 5]


LONG = "The first thing to do is to look at the list and see whether it is sorted already, and if it is then nothing is left to do."


def test_rewrapped_quotes_and_attributions(spark):
    words = LONG.split()
    wrapped = "\n".join("> " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    nested = "\n".join(">> " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    got = by_turn(quotations.link(rows(
        spark,
        (1, 0, "u", LONG),
        (1, 1, "v", "Something else."),
        (1, 2, "w", f"On Monday u wrote:\n\n{wrapped}\n\nThat is right."),
        (1, 3, "x", f"On Tuesday, w wrote:\n> On Monday u wrote:\n>\n{nested}\n>\n> That is right.\nI wrote: no"),
        (1, 4, "y", "> " + " ".join(words[4:]) + "\n> and more of my own\nHm"),
        (1, 5, "z", "> " + " ".join(reversed(words)) + "\nWhat?"),
        (1, 6, "z", "He wrote:\nnothing"),
    )))
    assert (got[1, 2]["reply_to"], got[1, 2]["n_linked"], got[1, 2]["text"]) == (0, 1, "That is right.")
    assert (got[1, 3]["reply_to"], got[1, 3]["n_quoted"], got[1, 3]["n_linked"], got[1, 3]["max_level"]) == (2, 2, 2, 2)
    assert got[1, 3]["text"] == "I wrote: no"
    assert (got[1, 4]["reply_to"], got[1, 4]["n_linked"]) == (0, 1)
    assert (got[1, 5]["reply_to"], got[1, 5]["n_quoted"], got[1, 5]["n_linked"]) == (4, 1, 0)
    assert got[1, 6]["text"] == "He wrote:\nnothing"


def test_matches_sql_on_nested_quotes(spark):
    """The query's SQL on conversations that quote each other at random, over several levels and line breaks."""
    import random

    import duckdb

    from islet.llm import oracle

    rng, items = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(30)]
    for conv in range(12):
        said = []
        for turn in range(14):
            lines = []
            for _ in range(rng.randrange(0, 3)):
                if said:
                    source = rng.choice(said)
                    if rng.random() < 0.3:
                        lines.append(rng.choice(["On Monday u wrote:", "u schrieb am Montag:", "He wrote: yes"]))
                        lines += [""] * rng.randrange(2)
                    own = " ".join(source).split()
                    step, level = rng.randrange(2, 9), rng.choice([">", "> >", ">>", "> "])
                    lines += [f"{level} " + " ".join(own[i : i + step]) for i in range(0, len(own), step)]
                lines += rng.choice([[], [""], ["and"]])
            new = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 12))) for _ in range(rng.randrange(0, 4))]
            said.append(new)
            items.append((conv, rng.choice([turn, turn, max(turn - 1, 0)]), rng.choice("ab"), rng.choice(["\n", "\r\n"]).join(lines + new)))
    items += [(1, 3, None, None), (1, 3, "a", "> w1"), (1, 3, "a", "> w1")]
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", items)
    got, want = quotations.link(rows(spark, *items)), c.sql(oracle.QUOTATIONS)
    columns = sorted(got.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert a == sorted(want.project(", ".join(columns)).fetchall(), key=key)
    assert sum(r["n_linked"] for r in got.collect()) > 20 and max(r["max_level"] for r in got.collect()) == 2


def test_many_answers_to_one_message(spark, monkeypatch):
    monkeypatch.setattr(quotations, "PART", 8)
    items = [(1, 0, "u", "one two three four five six")] + [(1, t, "v", "> one two three four five six\nanswer" if t % 3 else "plain words") for t in range(1, 60)]
    got = by_turn(quotations.link(rows(spark, *items)))
    order = sorted(got.values(), key=lambda r: (r["reply_to"] is not None, r["reply_to"] or 0, r["turn"]))
    assert [r["position"] for r in order] == list(range(60))


def test_long_texts_and_clashing_names(spark):
    long = "many words that are said once and then again " * 20_000
    docs = rows(spark, (1, 0, "u", long), (1, 1, "v", "> " + long + "\nyes")).withColumnRenamed("key", "position").withColumnRenamed("line", "passages")
    got = by_turn(quotations.link(docs))
    assert got[1, 1]["n_linked"] == 1 and got[1, 1]["text"] == "yes"


def test_ties_go_to_the_later_turn_and_answers_follow(spark):
    got = by_turn(quotations.link(rows(spark, (1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "c", "z"), (1, 3, "d", "> x\n> y"), (1, 4, "e", "> x\nq"))))
    assert got[1, 3]["reply_to"] == 1 and got[1, 4]["reply_to"] == 0
    where = {t: r["position"] for (_, t), r in got.items()}
    assert sorted(where.values()) == list(range(5))
    assert all(where[t] > where[r["reply_to"]] for (_, t), r in got.items() if r["reply_to"] is not None)


def test_odd_rows(spark):
    got = quotations.link(rows(spark, (None, 1, "a", "x"), (1, None, "a", "> x"), (3, 1, None, None), (3, 1, None, None), (4, 0, "u", "")))
    assert got.count() == 5
    assert quotations.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation_in_parts(spark):
    items = [(1, i, "u", f"line {i}" if i % 7 else f"> line {i - 3}\nmore") for i in range(0, 9000, 2)]
    got = by_turn(quotations.link(rows(spark, *items)))
    turns = sorted(t for _, t in got)
    for before, t in zip(turns, turns[1:]):
        want = t - 3 if t % 7 == 0 and (t - 3) in turns and (t - 3) % 7 else before
        assert got[1, t]["reply_to"] == want
    assert sorted(r["position"] for r in got.values()) == list(range(len(items)))
