"""Word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islet.llm.batches import text_slices

#: Distinct words remembered by a worker before it starts anew.
MEMO = 300_000


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a vocabulary file with a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Greedy longest-match piece counts of a word in one pass over its bytes.

    A trie of the pieces, where each node also knows what happens when its path can't go on: the
    pieces that greedy matching takes off the front (only their number, ``popped``) and the node of
    what is left (``fail``). Each byte of a word is then read once, and no piece is built.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.step: dict[int, int] = {}
        ends, depth = {}, [0]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(depth)
                    depth.append(depth[node] + 1)
                node = self.step[key]
            if piece:
                ends[node] = True
        self.fail, self.popped = [-1] * len(depth), [0] * len(depth)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.step.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in below.get(parent, ()):
                queue.append(node)
                if node in ends:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and (at << 8 | byte) not in self.step:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.step[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if greedy matching can't cover it."""
        step, fail, popped, node, pieces = self.step, self.fail, self.popped, 0, 0
        for byte in word:
            to = step.get(node << 8 | byte)
            while to is None:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                to = step.get(node << 8 | byte)
            node = to
        while node > 0:
            pieces += popped[node]
            node = fail[node]
        return pieces if node == 0 else -1


_made: dict[str, tuple[Automaton, dict[str, int]]] = {}


def _counted(path: str, prefix: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _made:
            _made[path] = Automaton(vocabulary(path)), {}
        automaton, memo = _made[path]

        def learn(words: list[str]) -> list[int]:
            for w in dict.fromkeys(words):
                if w not in memo:
                    memo[w] = automaton.count(prefix + w.encode())
            out = list(map(memo.__getitem__, words))
            if len(memo) > MEMO:
                memo.clear()
            return out

        for batch in batches:
            for part in text_slices(batch, "text"):
                words, pieces, unknown = [], [], []
                for text in part.column(1).to_pylist():
                    counts = learn(text.split()) if text else []
                    lost = counts.count(-1)
                    words.append(len(counts)), unknown.append(lost), pieces.append(sum(counts) + 2 * lost)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (words, pieces, unknown))], ["doc_id", "n_words", "n_pieces", "n_unknown"])

    return run


def count_pieces(docs: DataFrame, vocabulary_path: str, prefix: bytes = b" ") -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_pieces, n_unknown.

    Words are what ``str.split`` yields of the whole text; each is matched greedily, longest piece
    first, with ``prefix`` before it (vocabularies that mark word starts with a space). A word that
    the pieces can't cover counts as one unknown piece. A worker remembers ``MEMO`` words.

    Null, empty and blank texts: zeros. Every row stands for itself, whatever its doc_id; other
    columns are not read; no rows give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_counted(vocabulary_path, prefix), "doc_id long, n_words long, n_pieces long, n_unknown long")
