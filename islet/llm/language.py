"""Language of texts by a blended-spectrum presence kernel, Nyström landmarks and one-versus-rest ridge regression."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from islet.llm.batches import text_slices

UNKNOWN = "und"


#: Texts whose kernel is counted together, by n-grams that meet a landmark.
MEETINGS = 1_000_000


def letters() -> np.ndarray:
    """Whether each code point belongs to a word: letters and the marks on them."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


@dataclass
class Model:
    """Scores = kernel(texts, landmarks) @ weights + offset.

    A text's n-grams are sets of code points with runs of other characters as one blank, kept as
    63-bit numbers, so no letter of any script is left out. Landmarks are listed by n-gram.
    """

    languages: list[str]
    longest: int
    grams: list[np.ndarray]  # by n: the landmarks' n-grams, sorted
    starts: list[np.ndarray]  # by n: where an n-gram's landmarks begin in ``marks``
    marks: list[np.ndarray]
    sizes: np.ndarray  # root of the number of n-grams of each landmark
    weights: np.ndarray  # (landmarks, languages)
    offset: np.ndarray

    _letters: ClassVar[np.ndarray | None] = None

    @classmethod
    def sets(cls, text: str, longest: int) -> list[np.ndarray]:
        """The different n-grams of a text, for each n."""
        if cls._letters is None:
            cls._letters = letters()
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        ids = np.concatenate([[0], np.where(cls._letters[points], points, 0), [0]])
        ids = ids[(ids > 0) | np.concatenate([[True], ids[:-1] > 0])]
        out, code = [], ids
        for n in range(longest):
            if n:
                code = code[:-1] << 21 | ids[n:]
            out.append(np.unique(code))
        return out

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Cosines between the texts' and the landmarks' sets of n-grams, all n-grams of a text counted."""
        many = len(self.sizes)
        out = np.zeros((len(texts), many), np.float64)
        sizes, waiting, met = np.zeros(len(texts)), [], 0

        def count() -> None:
            keys = np.concatenate(waiting)
            first = int(keys.min()) // many
            own = np.bincount(keys - first * many)
            out.reshape(-1)[first * many : first * many + len(own)] += own

        for i, text in enumerate(texts):
            sets = self.sets(text, self.longest)
            sizes[i] = sum(map(len, sets))
            for own, grams, starts, marks in zip(sets, self.grams, self.starts, self.marks, strict=True):
                at = np.searchsorted(grams, own)
                at = at[grams[np.minimum(at, len(grams) - 1)] == own] if len(grams) else at[:0]
                long = starts[at + 1] - starts[at]
                take = np.repeat(starts[at] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
                waiting.append(i * many + marks[take])
                met += len(take)
            if met > MEETINGS:
                count()
                waiting, met = [], 0
        if met:
            count()
        return out / np.sqrt(np.maximum(sizes, 1))[:, None] / self.sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for at in range(0, len(known), 256):
            part = known[at : at + 256]
            values = self.kernel([texts[i] for i in part]) @ self.weights + self.offset
            for i, k, v in zip(part, values.argmax(axis=1), values.max(axis=1), strict=True):
                names[i], scores[i] = self.languages[k], float(min(max((v + 1) / 2, 0.0), 1.0))
        return names, scores


def train(texts: list[str], labels: list[str], landmarks: int = 192, longest: int = 3, ridge: float = 1e-3) -> Model:
    """Fit on texts in hand, with ``landmarks`` of them as landmarks, or two of each language if these are more."""
    languages = sorted(set(labels))
    # landmarks in turn from each language, in the order given
    by = [[i for i, x in enumerate(labels) if x == name] for name in languages]
    turn = [own[k] for k in range(max(map(len, by))) for own in by if k < len(own)][: max(landmarks, 2 * len(languages))]
    found = [Model.sets(texts[i], longest) for i in turn]
    grams, starts, marks = [], [], []
    for n in range(longest):
        every, owner = np.concatenate([f[n] for f in found]), np.repeat(np.arange(len(found)), [len(f[n]) for f in found])
        order = np.argsort(every, kind="stable")
        names, counts = np.unique(every, return_counts=True)
        grams.append(names), starts.append(np.concatenate([[0], np.cumsum(counts)])), marks.append(owner[order])
    sizes = np.sqrt([sum(map(len, f)) for f in found])
    model = Model(languages, longest, grams, starts, marks, sizes, np.zeros((0, 0)), np.zeros(0))
    # Nyström features: the kernel with the landmarks, whitened by their own kernel
    kernel = model.kernel(texts)
    values, vectors = np.linalg.eigh(kernel[turn])
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    x = kernel @ whiten
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    mean, level = x.mean(axis=0), y.mean(axis=0)
    x, y = x - mean, y - level
    solved = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ y)
    model.weights, model.offset = whiten @ solved, level - mean @ solved
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the id as text leaves 2 when divided by 4. Null id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Labels that the driver holds a row of; beyond, ``fit`` raises.
MOST_LANGUAGES = 1000


def fit(docs: DataFrame, per_language: int = 500, most_texts: int = 20_000, longest_text: int = 100_000, **options) -> Model | None:
    """Fit on a bounded sample of ``docs(text, lang)``, every label in it: null if no row has both.

    At most ``per_language`` different texts of up to ``longest_text`` characters of each label, and
    fewer where that would be more than ``most_texts`` in all, but one at least. Those of least hash
    are taken, so reruns agree and copies count once.
    """
    usable = docs.where("lang is not null and length(text) between 1 and " + str(longest_text)).select("text", "lang", F.xxhash64("text").alias("h"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    span, quota = 1 << 30, max(1, min(per_language, most_texts // len(counts)))
    # several times the quota of different texts is expected below a language's bound
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(span, (4 * quota + 40) * span // max(r["texts"], 1))) for r in counts], "lang string, share long")
    few = usable.withColumn("k", F.pmod("h", F.lit(span))).join(F.broadcast(shares), "lang").where("k < share")
    few = few.groupBy("lang", "k", "h").agg(F.min("text").alias("text")).orderBy("k", "h", "lang").limit((8 * quota + 80) * len(counts))
    texts, labels, taken = [], [], Counter()
    for r in few.select("text", "lang").toLocalIterator():
        if taken[r["lang"]] < quota:
            taken[r["lang"]] += 1
            texts.append(r["text"]), labels.append(r["lang"])
    return train(texts, labels, **options) if texts else None


def _predicted(model, inside: bool):
    """Predictions for the last column; ``inside``: for the field ``text`` of that column, a struct that comes back too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            for part in text_slices(batch, last.field("text") if inside else last, 2 << 20):
                last = part.column(part.num_columns - 1)
                texts = (last.field("text") if inside else last).to_pylist()
                names, scores = model.value.predict(texts) if model.value else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                back = part.num_columns - (not inside)
                yield pa.RecordBatch.from_arrays([*part.columns[:back], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:back], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with ``lang_pred`` (a learned language, ``und`` without letters) and ``score`` from 0 to 1.

    Only the text is looked at, and all of it, however long. Null, empty and letterless texts:
    ``und``, 0. Letters of no learned alphabet get the nearest language and its low score. Without a
    model all is ``und``. Rows stand for themselves; no rows give no rows. ValueError if ``carry``
    has a name of the added columns.
    """
    if clash := {c.lower() for c in carry} & {"lang_pred", "score"}:
        raise ValueError(f"carried columns are named like added ones: {sorted(clash)}")
    chosen = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model), False), f"{schema}, lang_pred string, score double")


def keep(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``, with their own columns, whatever their names.

    Null, empty and letterless texts go. Ties, repeated rows, very long texts and empty tables: as
    in ``predict``; the model is fitted on rows that ``held_out`` leaves.
    """
    model = fit(docs.where(~held_out()))
    whole = docs.select(F.struct(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")).alias("_row"))
    kind = whole.schema.fields[0].dataType.simpleString()
    found = whole.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model), True), f"_row {kind}, lang_pred string, score double")
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col("_row.text") if c == "text" else F.col(f"_row.rest.`{c}`") for c in docs.columns))
