import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from islet.llm import packing, token_counts, token_files
from islet.llm.bpe import Encoder
from islet.llm.queries import op5_token_files, op7_packing, op8_token_counts
from islet.storage import new_path

from .samples import ODD, none, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab cd\n\t .,'tsé1²“—日\x01\0"), max_size=30), max_size=5))
def test_ids_are_the_librarys(texts):
    encoder = Encoder(PATH, memo=40)
    for _ in range(2):
        ids, ends = encoder.flat([*texts, None, "", "the <|endoftext|> x"], 7)
        for t, a, b in zip([*texts, None, "", "the <|endoftext|> x"], ends, ends[1:]):
            assert ids[a:b].tolist() == ids_of(t, 7)


def documents(spark, sf="sf0.001"):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}


def test_token_files(spark):
    texts, at = documents(spark), 0
    rows = {r["doc_id"]: r for r in op5_token_files(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(rows) == sorted(texts)
    for d in sorted(texts):
        ids = ids_of(texts[d], 2)
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_come_back_whole(spark, encoding):
    import glob

    import pyarrow.parquet as pq

    path = new_path(spark, "t")
    token_files.write(odd(spark), path, PATH, 2, encoding)
    back = token_files.read(spark, path).orderBy("file", "row").collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in back) == sorted((d[0] or 0, ids_of(d[1], 2)) for d in ODD)
    assert [r["doc_id"] for r in back] == sorted((d[0] for d in ODD), key=lambda d: (d is not None, d))
    seen = set()
    for f in glob.glob(path.removeprefix("file://") + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            ids = meta.row_group(g).column(2)
            seen.update(ids.encodings)
            assert ids.has_column_index and ids.has_offset_index
    assert ("DELTA_BINARY_PACKED" in seen) == (encoding == "delta")
    empty = new_path(spark, "t")
    token_files.write(none(spark), empty, PATH, 2, encoding)
    assert token_files.digests(spark, empty).count() == 0


def check_packing(rows, texts, capacity):
    """Rows against documents: pieces cover the ids, sequences are gapless. Returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == sorted(texts)
    for d, pieces in by_doc.items():
        ids, at = ids_of(texts[d], 1), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return 1 - sum(r["length"] for r in rows) / (capacity * len(by_sequence))


def test_packing(spark):
    assert check_packing(op7_packing(spark, "/root/testdata/sf0.01").collect(), documents(spark, "sf0.01"), 2048) < 0.01


def test_plan_is_shortest_pack_first():
    assert packing.plan({5: 2, 3: 3, 2: 1}, 10) and sum(n * sum(x) for n, x in packing.plan({5: 2, 3: 3, 2: 1}, 10)) == 21
    rng = np.random.default_rng(3)
    for _ in range(30):
        h = {int(k): int(v) for k, v in zip(rng.integers(1, 41, 12), rng.integers(1, 50, 12))}
        got = packing.plan(h, 40)
        back = {}
        for n, lengths in got:
            assert sum(lengths) <= 40 and list(lengths) == sorted(lengths, reverse=True)
            for x in lengths:
                back[x] = back.get(x, 0) + n
        assert back == h
        packs = []  # one piece after the other into the emptiest pack
        for x in sorted((x for x, n in h.items() for _ in range(n)), reverse=True):
            k = min(range(len(packs)), key=packs.__getitem__, default=None)
            if k is None or packs[k] + x > 40:
                packs.append(x)
            else:
                packs[k] += x
        assert sorted(packs) == sorted(sum(lengths) for n, lengths in got for _ in range(n))


def test_packing_odd_rows(spark):
    rows = packing.pack(odd(spark), PATH, 1, 64, keep_ids=True).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(d[1], 1)) for d in ODD)
    assert all(len(r["ids"]) == r["length"] and crc(r["ids"]) == r["ids_crc32"] for r in rows)
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 64
    assert packing.pack(none(spark), PATH, 1).count() == 0


def greedy(pieces, word):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), None)
        if k is None:
            return -1
        word, n = word[k:], n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=14), st.text("abcd", max_size=16))
def test_automaton_is_greedy(pieces, word):
    assert token_counts.Automaton(p.encode() for p in pieces).count(word.encode()) == greedy(pieces, word)


def test_token_counts(spark):
    pieces = set(token_counts.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rows, texts = op8_token_counts(spark, "/root/testdata/sf0.001").collect(), documents(spark)
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r["doc_id"]].split()
        assert (r["n_words"], r["n_unknown"]) == (len(words), 0)
        assert r["n_pieces"] == sum(greedy(pieces, b" " + w.encode()) for w in words)


def test_token_counts_odd_rows(spark):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = token_counts.count_pieces(odd(spark), vocabulary).collect()
    assert len(rows) == len(ODD)
    assert all((r["n_words"], r["n_pieces"]) == (0, 0) for r in rows if r["doc_id"] in (1, 2, 3))
    assert token_counts.count_pieces(none(spark), vocabulary).count() == 0


@pytest.mark.parametrize("histogram", [{1025: 1000}, {1100: 300, 700: 900}, {1366: 50, 683: 10, 40: 3}, {5: 1}, {2047: 7, 1: 7}, {1500: 100, 1499: 37, 3: 5}])
def test_poured_plans_leave_little_padding(histogram):
    """Every piece has its place, sequences are gapless, and padding keeps its bound."""
    capacity, patterns = 2048, packing.plan(histogram, 2048)
    where, spans = packing.places(patterns, capacity), {}
    for length, many in histogram.items():
        sequence, offset = where.find(np.full(many, length), np.arange(many))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            if s >= 0:
                spans.setdefault(s, []).append((o, o + length))
            else:
                parts = list(where.chunks(o, length))
                assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == length
                for a, b, own, to in parts:
                    spans.setdefault(own, []).append((to, to + b - a))
    assert sorted(spans) == list(range(len(spans)))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    padding = len(spans) * capacity - sum(k * n for k, n in histogram.items())
    assert padding < 2 * packing.BLOCK * len(spans) + 2 * capacity


def test_documents_of_one_length_are_cut_to_fill(spark):
    texts = {i: "a b" * 30 + f" {i % 10}" for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    capacity = int(len(ids_of(texts[0], 1)) * 1.9)
    for keep_ids in (False, True):
        rows = packing.pack(docs, PATH, 1, capacity, keep_ids).collect()
        assert check_packing(rows, texts, capacity) < 2 * packing.BLOCK / capacity + 2 / 150
        if keep_ids:
            assert all(r["ids"] == ids_of(texts[r["doc_id"]], 1)[r["start"] : r["start"] + r["length"]] for r in rows)


def test_files_follow_by_number(spark, tmp_path):
    """Beyond 99,999 files their numbers outgrow their digits."""
    import pyarrow.parquet as pq

    for number, doc in ((99_999, 1), (100_000, 2), (5, 0)):
        table = pa.table({"doc_id": pa.array([doc], pa.int64()), "n_tokens": pa.array([doc + 1], pa.int32()), "ids": pa.array([[2] * (doc + 1)], pa.list_(pa.int32()))})
        pq.write_table(table, tmp_path / f"part-{number:05}-x.parquet")
    assert {r["doc_id"]: r["start"] for r in token_files.digests(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 3}


def test_pages_are_indexed(spark):
    """Ids and doc_ids have an entry a page, by which a reader of one document finds it."""
    import glob

    import pyarrow.parquet as pq

    path = new_path(spark, "t")
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text number ', id, ' ', repeat('word ', 40)) as text")
    token_files.write(docs.coalesce(1), path, PATH, 2, page_rows=100)
    assert token_files.read(spark, path).where("doc_id = 1234").select("doc_id", "n_tokens").count() == 1
    for f in glob.glob(path.removeprefix("file://") + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).column(0).has_offset_index and meta.row_group(g).column(2).has_offset_index


def test_very_long_texts(spark):
    long = "some words to go on with, " * 60_000
    docs = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    rows = packing.pack(docs, PATH, 1).collect()
    assert check_packing(rows, {1: long, 2: None}, 2048) < 1
    assert [r["n_words"] for r in token_counts.count_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).orderBy("doc_id").collect()] == [360_000, 0]
