"""Chat formatting: quoted passages are linked to the messages they come from, and taken out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from islet.llm.batches import text_slices
from islet.storage import stage

#: A quoted line: marks, each with a blank after it or not, then what is quoted.
MARKS = r"^((?:[ \t]*>)+)"
#: The line by which mail programs announce a quote; it counts only with a deeper line after it.
ATTRIBUTION = r"(?i)\b(?:wrote|writes|said|schrieb|écrit|escribió|ha scritto)\b[^:]*:\s*$"
#: Words of a passage that are compared together, and the share of them that must come from earlier turns.
SHINGLE, LEAST = 5, 0.8
#: Turns that are ordered together; longer conversations are ordered in parts.
PART = 4096

_MARKS, _ATTRIBUTION, _BREAK = regex.compile(MARKS), regex.compile(ATTRIBUTION), regex.compile(r"\r\n|\n|\r")


def parsed(text: str) -> list[tuple[int, str, str]]:
    """Level of quotation, what is said, and the line as it stands, of each line that is no attribution."""
    lines = []
    for line in _BREAK.split(text):
        found = _MARKS.match(line)
        lines.append((found.group(1).count(">"), line[found.end() :], line) if found else (0, line, line))
    out = []
    for i, (level, said, line) in enumerate(lines):
        if _ATTRIBUTION.search(said):
            below = next((x for x in lines[i + 1 : i + 3] if x[1].strip() or x[0] > level), None)
            if below and below[0] == level + 1:
                continue
        out.append((level, said, line))
    return out


def passages(lines: list[tuple[int, str, str]]) -> list[tuple[int, list[str]]]:
    """Runs of lines of one level: the level and the words, in lower case, wherever lines were broken.

    A quoted run too short for a run of ``SHINGLE`` words is as many passages as it has lines.
    """
    runs: list[tuple[int, list[list[str]]]] = []
    for k, (level, said, _) in enumerate(lines):
        if not k or lines[k - 1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(said.lower().split())
    out = []
    for level, parts in runs:
        words = [w for part in parts for w in part]
        out += [(level, part) for part in parts] if level and len(words) < SHINGLE else [(level, words)]
    return [p for p in out if p[1]]


def shingles(words: list[str]) -> set[int]:
    """Hashes of the runs of ``SHINGLE`` words; fewer words are one."""
    runs = (" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1)))
    return {xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in runs}


def unquoted(lines: list[tuple[int, str, str]]) -> str:
    """A text without its quoted lines and attributions; blank lines at its ends go too."""
    return regex.sub(r"\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\z", "", "\n".join(line for level, _, line in lines if not level))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("keys", pa.list_(pa.int64()))]))
    for batch in batches:
        for part in text_slices(batch, "text"):
            texts, found = [], []
            for text in part.column(part.schema.names.index("text")).to_pylist():
                lines = parsed(text or "")
                said, quoted = set(), []
                for level, words in passages(lines):
                    if level:
                        quoted.append({"level": level, "keys": sorted(shingles(words))})
                    else:
                        said |= shingles(words)
                # a line of few words can be quoted alone
                said |= {k for level, line, _ in lines if not level and 0 < len(w := line.lower().split()) < SHINGLE for k in shingles(w)}
                texts.append(unquoted(lines)), found.append([{"level": 0, "keys": sorted(said)}, *quoted])
            kept = [part.column(part.schema.names.index(c)) for c in ("conv_id", "turn", "role")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(found, kind)], ["conv_id", "turn", "role", "text", "passages"])


def _before(rows: DataFrame) -> DataFrame:
    """``conv_id, turn`` of every turn with the turn ``before`` it, in parts of a conversation."""
    turns = rows.select("conv_id", "turn").distinct().withColumn("_part", F.floor(F.col("turn") / PART))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "_part").orderBy("turn"))
    ends = turns.groupBy("conv_id", "_part").agg(F.max("turn").alias("_last"))
    ends = ends.select("conv_id", "_part", F.lag("_last").over(Window.partitionBy("conv_id").orderBy("_part")).alias("_last"))
    return turns.withColumn("_in", inside).join(ends, ["conv_id", "_part"]).select("conv_id", "turn", F.coalesce("_in", "_last").alias("before"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position`` from 0 in the order of reply_to (none first), turn and text.

    Counted in parts of a conversation, then by message answered and part of the answers, so neither
    a long conversation nor a message with very many answers is ordered in one place.
    """
    to = F.coalesce("reply_to", F.lit(-1))
    parted = rows.withColumns({"_part": F.floor(to / PART), "_to": to, "_turns": F.floor(F.col("turn") / PART)})
    groups = parted.groupBy("conv_id", "_part", "_to", "_turns").agg(F.count("*").alias("_n"))
    before = lambda n, by, order: F.sum(n).over(Window.partitionBy(*by).orderBy(*order)) - F.col(n)
    parts = groups.groupBy("conv_id", "_part").agg(F.sum("_n").alias("_m"))
    parts = parts.select("conv_id", "_part", before("_m", ["conv_id"], ["_part"]).alias("_first"))
    starts = groups.withColumn("_ahead", before("_n", ["conv_id", "_part"], ["_to", "_turns"])).join(parts, ["conv_id", "_part"])
    starts = starts.select("conv_id", "_to", "_turns", (F.col("_first") + F.col("_ahead")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_to", "_turns").orderBy("turn", "role", "text", "n_quoted"))
    return parted.withColumn("_in", inside).join(starts, ["conv_id", "_to", "_turns"]).withColumn("position", F.col("_start") + F.col("_in") - 1).drop("_part", "_to", "_turns", "_in", "_start")


def link(messages: DataFrame) -> DataFrame:
    """Messages of ``messages(conv_id, turn, role, text)`` without quotes, in reply order.

    A quoted passage is a run of lines with the same number of marks before them, nested as deep as
    the marks, wherever its lines were broken; lines that announce a quote ("... wrote:") belong to
    none. Its words are hashed in runs of five and joined to the first earlier turn of its
    conversation that says them unquoted. A passage is linked if 80 % of its runs are, to the turn
    that has most of them; a quoted run of fewer than five words is taken line by line. ``reply_to``: the turn with most runs among the linked passages of the
    first level, the later one if two tie; deeper levels are that message's own quotes. A message
    that links to none answers the turn before it. ``position`` orders a conversation: by the
    message answered, then by turn, so answers to one message stand together and after it. Returned:
    conv_id, turn, role, text, reply_to, n_quoted, n_linked (passages of all levels), max_level, position.

    A run of words is kept once a conversation before the join, so a very common passage adds a row
    a run and conversation, and never pairs. Null text: empty. Very long texts are parsed whole. Null
    conv_id or turn: the message is alone, with no reply_to and position 0. Rows of one turn share
    its passages, equal ones once; equal rows are all returned. Other columns are not read. No rows:
    an empty table.
    """
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    schema = "conv_id long, turn long, role string, text string, passages array<struct<level: int, keys: array<bigint>>>"
    whole = stage(rows.mapInArrow(_parsed, schema), "messages")
    placed = whole.where("conv_id is not null and turn is not null")
    parts = placed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.keys")
    said = parts.where("level = 0").select("conv_id", "turn", F.explode("keys").alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    quoted = parts.where("level > 0").select("conv_id", "turn", "level", "keys").distinct()
    quoted = quoted.select("conv_id", "turn", "level", F.xxhash64("keys").alias("passage"), F.explode("keys").alias("key"))
    found = quoted.join(said, ["conv_id", "key"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    by = ["conv_id", "turn", "level", "passage"]
    each = found.groupBy(*by, "origin").agg(F.count("*").alias("n"))
    known = F.when(F.col("origin").isNotNull(), F.struct("n", "origin"))
    each = each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n"))).alias("met"), F.max(known).alias("best"))
    linked = F.col("met") >= LEAST * F.col("n")
    each = each.withColumns({"linked": F.coalesce(linked, F.lit(False)), "origin": F.when(linked, F.col("best.origin")), "met": F.when(F.col("level") == 1, F.col("best.n"))})
    votes = each.groupBy("conv_id", "turn", "origin").agg(F.sum("met").alias("direct"), F.count("*").alias("n"), F.max("level").alias("level"))
    best = F.max(F.when(F.col("origin").isNotNull() & (F.col("direct") > 0), F.struct("direct", "origin")))["origin"]
    links = votes.groupBy("conv_id", "turn").agg(best.alias("linked"), F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"), F.max("level").alias("max_level"))
    joined = placed.drop("passages").join(_before(placed), ["conv_id", "turn"]).join(links, ["conv_id", "turn"], "left")
    none = F.lit(0).cast("long")
    counts = ("n_quoted", "n_linked", "max_level")
    out = joined.select("conv_id", "turn", "role", "text", F.coalesce("linked", "before").alias("reply_to"), *(F.coalesce(c, none).cast("long").alias(c) for c in counts))
    alone = whole.where("conv_id is null or turn is null")
    # a lone message's passages are counted, and linked to none
    own = F.filter("passages", lambda p: p["level"] > 0)
    alone = alone.select("conv_id", "turn", "role", "text", F.lit(None).cast("long").alias("reply_to"), F.size(own).cast("long").alias("n_quoted"), none.alias("n_linked"), F.coalesce(F.array_max(own["level"]), F.lit(0)).cast("long").alias("max_level"), none.alias("position"))
    return _ranked(out).select(alone.columns).unionByName(alone)
