"""Near-duplicate classes: DartMinHash signatures of shingles, a banded join, exact checks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islet.llm.batches import text_slices
from islet.operators import components
from islet.storage import drop, stage

SHINGLE, LEAST = 5, 0.8
#: Coordinates of a signature, and of a band. Two texts of similarity 0.8 share a band but for 5 in 10**8:
#: texts are signed by multiplicity and, where shingles repeat, by their sets too.
COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts: number of the text, 64-bit hash, multiplicity; sorted.

    Words lie between ASCII blanks. A text of fewer than ``n`` words, but one at least, is one shingle.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    at = coded.indices.to_numpy()
    real = np.array([w != "" for w in names], bool)[at] if len(names) else np.zeros(0, bool)
    doc, words = doc[real], hashes[at[real]]
    counts = np.bincount(doc, minlength=len(lists))
    first = np.cumsum(counts) - counts
    h = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    place = np.arange(len(words)) - first[doc]
    for k in range(n):
        h = _mixed(h + np.where(place + k < counts[doc], padded[k : k + len(words)], np.uint64(0)) * _ODD[k % 5] + np.uint64(k + 1))
    whole = (place + n <= counts[doc]) | ((place == 0) & (counts[doc] < n))
    doc, h = doc[whole], h[whole]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], h[starts], np.diff(np.append(starts, len(h)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, many: int, k: int = COORDINATES) -> np.ndarray:
    """Weighted signatures (many, k): equal coordinates of two sets have the odds of their weighted Jaccard similarity.

    Darts fall evenly on the plane of weight and time above each element, the same for every set
    that has it: by strips of weight [0, 1), [1, 2), [2, 4) ..., in each at hashed intervals of time.
    A dart counts if its weight is under the element's, and goes to a hashed coordinate; the earliest
    dart of a coordinate is its value. About k ln k + 2 k darts a set are thrown, by a time bound of
    that over its total weight; a set with an empty coordinate left gets twice the time. So the work
    is one look at each element and a number of darts that doesn't depend on the set.
    Sets without elements get zeros.
    """
    out = np.zeros((many, k), np.uint64)
    total = np.bincount(doc, weight, many)
    time = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = np.ones(len(doc), bool)
    while todo.any():
        d, e, w = doc[todo], element[todo], weight[todo].astype(np.float64)
        strips = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64) + 1, 1)
        at = np.repeat(np.arange(len(d)), strips)
        strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
        d, w = d[at], w[at]
        low = np.where(strip > 0, 2.0 ** (strip - 1), 0.0)
        wide = np.maximum(low, 1.0)
        seed = _mixed(e[at] + strip.astype(np.uint64) * _ODD[0])
        now, thrown = np.zeros(len(d)), 0
        keys, times, names = [], [], []
        while len(d):
            thrown += 1
            name = _mixed(seed + np.uint64(thrown * int(_ODD[1]) % 2**64))
            now = now - np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / wide
            live = now < time[d]
            if not live.all():
                d, w, low, wide, seed, now, name = (x[live] for x in (d, w, low, wide, seed, now, name))
            height = low + wide * ((_mixed(name) >> np.uint64(11)).astype(np.float64) / 2.0**53)
            hit = height < w
            keys.append(d[hit] * k + (name[hit] & np.uint64(0x7FF)).astype(np.int64) % k)
            times.append(now[hit]), names.append(name[hit])
        key, when, name = map(np.concatenate, (keys, times, names))
        best = np.full(many * k, np.inf)
        np.minimum.at(best, key, when)
        won = when == best[key]
        out.reshape(-1)[key[won]] = name[won]
        short = np.isinf(best.reshape(many, k)).any(axis=1)
        time = np.where(short, time * 2, time)
        todo &= short[doc]
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band of ``rows`` coordinates."""
    bands = signatures.reshape(len(signatures), -1, rows)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None, :] * _ODD[2] + np.uint64(1)
    for i in range(rows):
        key = _mixed(key * _ODD[3] + bands[:, :, i])
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text", 1 << 20):
            doc, element, weight = shingles(part.column(1))
            many = len(part.column(1))
            keys = band_keys(dart_signatures(doc, element, weight, many))
            # plain similarity: the sets alone; a text without repeats has the same bands either way
            again = np.unique(doc[weight > 1])
            plain = keys.copy()
            if len(again):
                some = np.isin(doc, again)
                plain[again] = band_keys(dart_signatures(np.searchsorted(again, doc[some]), element[some], np.ones(int(some.sum()), np.int64), len(again)))
            ends = np.searchsorted(doc, np.arange(many + 1))
            pairs = np.stack([element, weight.astype(np.uint64)], axis=1)
            bags = [xxhash.xxh128_digest(pairs[a:b].tobytes()) if b > a else None for a, b in zip(ends, ends[1:], strict=False)]
            both = np.concatenate([keys, plain], axis=1)
            wanted = np.concatenate([np.ones(keys.shape, bool), plain != keys], axis=1) & (np.diff(ends) > 0)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wanted.sum(axis=1))]).astype(np.int32)), pa.array(both[wanted]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bags, pa.binary()), pa.array(np.bincount(doc, weight, many).astype(np.int64)), lists], ["key", "bag", "n", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the weighted and the plain Jaccard similarity of two sets of (sorted hashes, multiplicities)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - common
    plain = len(a[0]) + len(b[0]) - len(i)
    return max(common / union if union else 0.0, len(i) / plain if plain else 0.0)


def _checked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            for part in text_slices(batch, "text_b", 1 << 20):
                a, texts_a = part.column(0).to_numpy(), part.column(2)
                doc, element, weight = shingles(part.column(3))
                cuts, good = np.searchsorted(doc, np.arange(len(a) + 1)), np.zeros(len(a), bool)
                for i in range(len(a)):
                    if a[i] != last:
                        _, *known = shingles(texts_a.slice(i, 1))
                        last = a[i]
                    s = slice(cuts[i], cuts[i + 1])
                    good[i] = similarity(known, (element[s], weight[s])) >= least
                yield part.select(["a", "b"]).filter(pa.array(good))

    return run


def _links(pairs: DataFrame, texts: DataFrame, least: float, name: str) -> DataFrame:
    """The pairs ``a, b`` of keys whose texts are similar, written."""
    left, right = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = right.join(pairs.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return stage(both.mapInArrow(_checked(least), "a long, b long"), name)


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text", 1 << 20):
            doc, element, weight = shingles(part.column(1))
            ends = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (element.view(np.int64), weight.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["key", "elements", "weights"])


def _block_links(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Links between the components of a block, as few as join what is alike."""
        keys, comps, sides = (table.column(c).to_numpy() for c in ("key", "comp", "side"))
        lists, weights = table.column("elements").combine_chunks(), table.column("weights").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        at = np.repeat(np.arange(len(keys)), sizes)
        names, column, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        weight = weights.flatten().to_numpy().astype(np.float32)
        total = np.bincount(at, weight, len(keys))
        common = [np.zeros((len(keys), len(keys)), np.float32) for _ in range(2)]
        often = seen > 1
        place = np.cumsum(often) - 1
        keep = often[column]
        at, column, weight = at[keep], place[column[keep]], weight[keep]
        order = np.argsort(column, kind="stable")
        at, column, weight = at[order], column[order], weight[order]
        for low in range(0, int(often.sum()), 2048):
            i, j = np.searchsorted(column, (low, low + 2048))
            before = 0
            # the lesser of two multiplicities is the sum over the steps between multiplicities that both reach
            for level in np.unique(weight[i:j]):
                y = weight[i:j] >= level
                rows, inverse = np.unique(at[i:j][y], return_inverse=True)
                x = np.zeros((len(rows), 2048), np.float32)
                x[inverse, column[i:j][y] - low] = 1
                both = x @ x.T
                if not before:
                    common[0][np.ix_(rows, rows)] += both
                common[1][np.ix_(rows, rows)] += (level - before) * both
                before = level
        alike = np.zeros(common[0].shape, bool)
        for both, own in zip(common, (sizes.astype(np.float64), total), strict=True):
            alike |= both >= least * (own[:, None] + own[None, :] - both) - 1e-6
        alike &= (comps[:, None] != comps[None, :]) & ((sides[:, None] != sides[None, :]) | (len(np.unique(sides)) == 1))
        i, j = np.nonzero(np.triu(alike))
        kept = _forest(*(np.searchsorted(np.unique(comps), comps[x]) for x in (i, j)))
        a, b = keys[i[kept]], keys[j[kept]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links x - y suffice to join all that they join: each group hooks to a smaller one, until none is left to join."""
    head, left, out = np.arange(max(x.max(initial=0), y.max(initial=0)) + 1), np.arange(len(x)), [np.zeros(0, np.int64)]
    while len(left):
        a, b = head[x[left]], head[y[left]]
        left, a, b = (k[a != b] for k in (left, a, b))
        high, first = np.unique(np.maximum(a, b), return_index=True)
        out.append(left[first])
        head[high] = np.minimum(a, b)[first]
        while not np.array_equal(up := head[head], head):
            head = up
    return np.concatenate(out)


#: Members of a block, and their shingles: two blocks at most are compared in a task.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000


def _links_across(shared: DataFrame, tied: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links between components that buckets still hold after their pivots have been compared with all.

    Texts whose shingles are by more than 1 - ``least`` their own can have no partner and leave
    (exact). The others are compared exactly, block by block, by products of their shingle matrices;
    a large bucket is cut into blocks and each pair of blocks is a task. Only links that join
    components come out, fewer than a block has members. A bucket of many texts that share most of
    their shingles and are still unlike costs the square of its blocks; nothing is left out.
    """
    parted = shared.where("key <> a").join(tied, "key", "left").select("band", "key", F.coalesce("comp", "key").alias("comp"))
    # a bucket whose members lie in one component has no link to add
    mixed = parted.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band")
    kept = stage(parted.join(mixed, "band", "left_semi"), "mixed-buckets")
    some = texts.join(kept.select("key").distinct(), "key", "left_semi")
    sets = stage(some.mapInArrow(_parted, "key long, elements array<bigint>, weights array<int>"), "sets")
    each = sets.select("key", F.explode(F.arrays_zip("elements", "weights")).alias("e")).select("key", "e.elements", "e.weights")
    alone = each.groupBy("elements").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("weights").alias("w")).where("n = 1")
    alone = alone.groupBy("key").agg(F.count("*").alias("u"), F.sum("w").alias("uw"))
    total = F.aggregate("weights", F.lit(0).cast("long"), lambda x, y: x + y)
    shares = sets.withColumn("_n", F.size("elements")).withColumn("_w", total).join(alone, "key", "left").na.fill(0, ["u", "uw"])
    able = shares.where((F.col("_n") - F.col("u") >= least * F.col("_n")) | (F.col("_w") - F.col("uw") >= least * F.col("_w"))).select("key", "elements", "weights", "_n")
    able = stage(able, "able")
    left = kept.join(able.select("key", "_n"), "key")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("_n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    counts = left.groupBy("band").agg(blocks, F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    put = left.join(counts.select("band", "blocks"), "band").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # a block meets every other block once, and itself where it is alone or first
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    sent = put.withColumn("p", F.explode(F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)))
    sent = sent.select("band", "p.i", "p.j", "key", "comp", (F.col("own") == F.col("p.j")).cast("int").alias("side")).join(able.drop("_n"), "key")
    links = stage(sent.groupBy("band", "i", "j").applyInArrow(_block_links(least), "a long, b long").distinct(), "more-links")
    drop(kept, sets, able)
    return links


def classes(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """The columns ``carry`` of every row with ``class_id``, ``class_size`` and ``first``.

    Two texts are linked if their shingles of five words have a Jaccard similarity of at least
    ``least``, by multiplicity or plain; classes are the connected texts. ``class_id``: the least
    ``key`` in the class; ``first``: true on one row a class, that of the least key.

    Steps, none of which emits the pairs of a group: (1) texts of equal shingles collapse to one.
    (2) Each bucket of a band is tied to its pivot, the member that shares buckets with most texts,
    so that copies meet the text they were made from; such pairs are checked exactly and give
    components. (3) Buckets that still hold several components: see ``_links_across``. (4)
    Components of all links.

    Null, empty and blank texts are a class each. Null keys: a class of such rows alone has a null
    class_id. Repeated keys and equal rows are all returned. Very long texts are compared whole. No
    rows: an empty table. ValueError if ``carry`` has a name of the added columns.
    """
    clash = {c.lower() for c in carry} & {"class_id", "class_size", "first"}
    if clash:
        raise ValueError(f"carried columns are named like added ones: {sorted(clash)}")
    found = _classes(docs, tuple(carry), key, text, least)
    return found.select("_row.*", "class_id", "class_size", "first")


def _classes(docs: DataFrame, carry: tuple[str, ...], key: str, text: str, least: float) -> DataFrame:
    """``_row`` (a struct of the columns ``carry``), class_id, class_size and first; see ``classes``."""
    needed = list(dict.fromkeys((*carry, key, text)))  # a text is written once, however often it is named
    whole = F.struct(*(F.col(f"`{c}`") for c in needed)).alias("_all")
    staged = stage(docs.select(whole, F.monotonically_increasing_id().alias("key")), "rows")
    field = F.col("_all").getField
    rows = staged.select(F.struct(*(field(c).alias(c) for c in carry)).alias("_row"), field(key).cast("long").alias("id"), field(text).cast("string").alias("text"), "key")
    signed = stage(rows.select("key", "text").mapInArrow(_signed, "key long, bag binary, n long, bands array<bigint>"), "signatures")
    firsts = signed.where("bag is not null").groupBy("bag").agg(F.min("key").alias("rep"))
    members = stage(signed.select("key", "bag").join(firsts, "bag", "left").select("key", F.coalesce("rep", "key").alias("rep")), "members")
    own = members.where("key = rep").select("key")
    bands = stage(signed.join(own, "key", "left_semi").select(F.explode("bands").alias("band"), "key"), "bands")
    buckets = bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    multiple = stage(bands.join(buckets, "band"), "multiple")
    drop(bands, signed)
    central = multiple.groupBy("key").agg(F.sum("m").alias("score"))
    pivots = multiple.join(central, "key").groupBy("band").agg(F.max(F.struct("score", (-F.col("key")).alias("k"))).alias("p"))
    shared = stage(multiple.select("band", "key").join(pivots.select("band", (-F.col("p.k")).alias("a")), "band"), "buckets")
    drop(multiple)
    ties = stage(shared.where("key <> a").select("a", F.col("key").alias("b")).distinct(), "ties")
    wanted = ties.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = stage(rows.select("key", "text").join(wanted.hint("merge"), "key", "left_semi"), "candidates")  # other texts move no more
    links = _links(ties, texts, least, "links")
    tied = components.stars(links.select(F.col("a").alias("u"), F.col("b").alias("v")), 0).select(F.col("u").alias("key"), F.col("v").alias("comp"))
    more = _links_across(shared, tied, texts, least)
    drop(ties, shared, texts)
    # the links found last join components: those, seen as vertices, are contracted in turn
    ends = more
    for c in "ab":
        ends = ends.join(tied.select(F.col("key").alias(c), F.col("comp").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    joined = components.stars(ends.select(F.col("a").alias("u"), F.col("b").alias("v")), 0)
    first = members.join(tied.withColumnRenamed("key", "rep"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("u"))
    comps = first.join(joined, "u", "left").select("key", F.coalesce("v", "u").alias("comp"))
    light = stage(comps.join(rows.select("key", "id"), "key"), "classes")
    drop(links, more, members)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    heads = light.groupBy("comp").agg(F.min(order).alias("head"), F.count("*").alias("class_size")).select("comp", F.col("head.id").alias("class_id"), F.col("head.key").alias("_head"), "class_size")
    named = light.select("key", "comp").join(heads, "comp").select("key", "class_id", "class_size", (F.col("key") == F.col("_head")).alias("first"))
    # texts move as they would at any size: the other side is broadcast only while it is small
    return rows.select("_row", "key").join(named.hint("merge"), "key").select("_row", "class_id", "class_size", "first")


def keep(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each class of near-duplicates, that of the least doc_id, with its own columns, whatever their names.

    Nulls, ties, repeated rows, long texts and empty tables: as in ``classes``; blank texts are kept.
    """
    return _classes(docs, tuple(docs.columns), "doc_id", "text", least).where("first").select("_row.*")
