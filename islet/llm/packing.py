"""Shortest-pack-first packing of token pieces, planned on the histogram of their lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from islet.llm.batches import text_slices
from islet.llm.bpe import WORK_BYTES, Encoder
from islet.storage import stage

#: Tokens at whose multiples a rest may be cut once more; less room is not worth a cut.
BLOCK = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, end: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text", WORK_BYTES):
                ids, ends = encoder.flat(part.column(1), end)
                sizes = np.diff(ends)
                many = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                at, raw = ends[doc] + start, ids.astype("<u4", copy=False)
                sums = [zlib.crc32(raw[a : a + n]) for a, n in zip(at, length, strict=True)]
                # checksums of a rest's blocks; a full piece is cut no more
                blocks = [b"".join(zlib.crc32(raw[k : min(k + BLOCK, a + n)]).to_bytes(4, "little") for k in range(a, a + n, BLOCK)) if n < capacity else None for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                # the rank of a piece among this task's pieces of its length
                by = np.argsort(length, kind="stable")
                firsts = np.searchsorted(length[by], length[by])
                rank = np.empty(len(by), np.int64)
                rank[by] = seen[length[by]] + np.arange(len(by)) - firsts
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [part.column(0).take(pa.array(doc)), *map(pa.array, (start.astype(np.int64), length.astype(np.int64)))]
                columns += [pa.array(sums, pa.int64()), pa.array(sizes[doc].astype(np.int64)), pa.array(np.full(len(doc), task, np.int64)), pa.array(rank)]
                names = [*PIECES.replace(" long", "").split(", "), "blocks"]
                columns.append(pa.array(blocks, pa.binary()))
                if keep_ids:  # pieces lie in a row, so their ends cut the ids of the slice
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]).astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (how many sequences, lengths in them) for pieces of the given lengths.

    Lengths are placed longest first. Each joins the open pattern with the most room, the shortest
    pack, and opens a new one where none has room. A pattern stands for all sequences filled alike,
    so the work follows the number of lengths and patterns and not the number of pieces.
    """
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    most = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not room[most]:
                most -= 1
            if most < length:  # a new pack is the shortest until it is full
                fit = capacity // length
                for many, k in ((left // fit, fit), (1, left % fit)):
                    if many and k:
                        room[capacity - k * length].append((many, (length,) * k))
                        most = max(most, capacity - k * length)
                break
            many, lengths = room[most].pop()
            taken = min(many, left)
            if many > taken:
                room[most].append((many - taken, lengths))
            room[most - length].append((taken, (*lengths, length)))
            left -= taken
    return [p for group in room for p in group]


def _blocks(length: int) -> int:
    """Tokens of the blocks that hold ``length``."""
    return -(-length // BLOCK) * BLOCK


def poured(patterns: list[tuple[int, tuple[int, ...]]], capacity: int) -> tuple[list, list]:
    """Patterns parted into those that stay, fullest first, and those whose pieces fill the room that they leave.

    As many of the emptiest sequences are given up as the rooms of the others can hold; their pieces
    are cut where a room ends, at multiples of ``BLOCK``. What is left as padding is less than two
    blocks a sequence and two sequences in all.
    """
    order = sorted(patterns, key=lambda p: (-sum(p[1]), p[1]))

    def split(keep: int) -> tuple[list, list]:
        stay, go = [], []
        for many, lengths in order:
            here = min(keep, many)
            keep -= here
            stay += [(here, lengths)] * (here > 0)
            go += [(many - here, lengths)] * (many > here)
        return stay, go

    def fits(keep: int) -> bool:
        stay, go = split(keep)
        rooms = sum(many * ((capacity - sum(x)) // BLOCK * BLOCK) for many, x in stay)
        return rooms >= sum(many * sum(map(_blocks, x)) for many, x in go)

    low, high = 0, sum(many for many, _ in order)  # fewer sequences have less room and more to take
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return split(low)


@dataclass(frozen=True)
class Places:
    """Where pieces go, by length and rank: ``sequence`` counts up with the rank, and ``offset`` is fixed; or, for
    pieces that are poured, ``sequence`` is -1 and ``offset`` the place on a line of rooms, one piece after the other
    in whole blocks.

    ``rooms``: where rooms of one size begin on that line, the size, the first sequence that has one, and what is in
    it before. ``lines``: where pieces of one length begin there, the tokens of their blocks, those that lack in the
    last one, and all that lack before.
    """

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    rooms: np.ndarray
    lines: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence (-1: poured) and offset of each piece."""
        keys = (self.length.astype(np.uint64) << np.uint64(48)) + self.rank.astype(np.uint64)
        at = np.searchsorted(keys, (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), "right") - 1
        first, more = self.sequence[at], rank - self.rank[at]
        return np.where(first < 0, -1, first + more), self.offset[at] + np.where(first < 0, more * _blocks(length), 0)

    def _lacking(self, place: int) -> int:
        base, size, lack, before = map(int, self.lines[np.searchsorted(self.lines[:, 0], place, "right") - 1])
        return before + (place - base) // size * lack

    def chunks(self, begin: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """The rooms that a piece on the line runs through: from and to (in the piece), sequence, offset."""
        at, end = begin, begin + length
        while at < end:
            base, size, first, used = map(int, self.rooms[np.searchsorted(self.rooms[:, 0], at, "right") - 1])
            which = (at - base) // size
            room = base + which * size
            to = min(end, room + size)
            yield at - begin, to - begin, first + which, used + at - room - (self._lacking(at) - self._lacking(room))
            at = to


def places(patterns: list[tuple[int, tuple[int, ...]]], capacity: int) -> Places:
    """The places of all pieces; each slot of a pattern takes the next ranks of its length."""
    stay, go = poured(patterns, capacity)
    rows, rooms, lines, first, line, lack, taken = [], [], [], 0, 0, 0, {}
    for many, lengths in stay:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), first, offset))
            taken[length] = taken.get(length, 0) + many
            offset += length
        if capacity - offset >= BLOCK:
            rooms.append(((capacity - offset) // BLOCK * BLOCK, many, first, offset))
        first += many
    for many, lengths in go:
        for length in lengths:
            rows.append((length, taken.get(length, 0), -1, line))
            taken[length] = taken.get(length, 0) + many
            lines.append((line, _blocks(length), _blocks(length) - length, lack))
            line, lack = line + many * _blocks(length), lack + many * (_blocks(length) - length)
    ordered, at = [], 0
    for size, many, sequence, used in sorted(rooms, key=lambda r: (-r[0], r[2])):  # large rooms first: few cuts
        ordered.append((at, size, sequence, used))
        at += size * many
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Places(*table.T, *(np.array(x, np.int64).reshape(-1, 4) for x in (ordered, lines)))


def _joined(sums: np.ndarray, tokens: int) -> int:
    """Checksum of the tokens of which these are the checksums of blocks."""
    out = 0
    for k, own in enumerate(sums.tolist()):
        # a checksum is linear: what comes before counts as if zeros followed it
        zeros = bytes(4 * min(BLOCK, tokens - k * BLOCK))
        out = (zlib.crc32(zeros, out ^ 0xFFFFFFFF) ^ 0xFFFFFFFF) ^ own
    return out


def _placed(where, keep_ids: bool, cut: bool):
    """Rows of whole pieces, or with ``cut`` those of the pieces that are poured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PLACED.split(", ")]
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(k)).to_numpy() for k in ("length", "rank"))
            sequence, offset = where.value.find(length, rank)
            some = np.flatnonzero((sequence < 0) == cut)
            if not len(some):
                continue
            part = batch.take(pa.array(some))
            column = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            if not cut:
                columns = [*(column[k] for k in names), *([column["ids"]] if keep_ids else []), pa.array(sequence[some]), pa.array(offset[some])]
                yield pa.RecordBatch.from_arrays(columns, [*names, *["ids"] * keep_ids, "sequence_id", "offset"])
                continue
            rows, blocks = [], column["blocks"].to_pylist()
            ids = column["ids"].to_pylist() if keep_ids else None
            for i, (at, n, start) in enumerate(zip(offset[some].tolist(), length[some].tolist(), column["start"].to_pylist(), strict=True)):
                sums = np.frombuffer(blocks[i], "<u4")
                for a, b, own, to in where.value.chunks(at, n):
                    rows.append((i, start + a, b - a, _joined(sums[a // BLOCK : -(-b // BLOCK)], b - a), own, to, ids[i][a:b] if keep_ids else None))
            row, start, size, sums, own, to, ids = zip(*rows, strict=True)
            whole = {k: column[k].take(pa.array(row)) for k in names}
            whole |= {k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", size), ("ids_crc32", sums))}
            more = [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([*whole.values(), *more, pa.array(own, pa.int64()), pa.array(to, pa.int64())], [*names, *["ids"] * keep_ids, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Place all tokens of ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    A document's ids and ``end`` are cut into pieces of ``capacity`` and a rest; full pieces fill a
    sequence each, rests are packed shortest pack first. The emptiest sequences are then given up
    and their pieces cut once more, to fill the room of the others (see ``poured``), so padding is
    little whatever the lengths. Returns a row a piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and the piece's ``ids`` on request.

    The pieces are written once with their rank among their task's pieces of the same length.
    Counts by task and length turn it into a rank over all; only the histogram (``capacity`` rows
    at most) reaches the driver, only the patterns' places go back. No length is sorted, so one
    very common length is no hot spot. Checksums of pieces that are cut once more come from those of
    their blocks, so no ids are kept for them.

    Null or empty text: one piece that holds ``end``. Very long texts are cut like any other. Null,
    repeated doc_ids and equal rows are documents of their own. Other columns are not read. No
    rows: no pieces.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stage(texts.mapInArrow(_cut(tokenizer, end, capacity, keep_ids), PIECES + ", blocks binary" + ", ids array<int>" * keep_ids), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = places(plan(histogram, capacity), capacity)
    where = spark.sparkContext.broadcast(found)
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    schema = PLACED + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"

    def placed(rows: DataFrame, cut: bool) -> DataFrame:
        ranked = rows.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
        needed = [*(x.split()[0] for x in PLACED.split(", ")), "rank", *["blocks"] * cut, *["ids"] * keep_ids]
        return ranked.select(*needed).mapInArrow(_placed(where, keep_ids, cut), schema)

    out = placed(pieces, False)
    some = sorted(set(found.length[found.sequence < 0].tolist()))
    return out.unionByName(placed(pieces.where(F.col("length").isin(some)), True)) if some else out
