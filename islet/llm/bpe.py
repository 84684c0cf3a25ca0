"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

A byte-level BPE splits a text into pre-tokens and encodes each alone, and a pre-token reaches over
a space only if it starts with it. So the ids of a text are the ids of its space-separated words,
each with the space before it, in a row. Words come back often; the memo asks the library for each
once. Where spaces meet other white space the text is split into the pre-tokens themselves. The
split is redone here only for texts made of characters that every Unicode version classes alike
(Latin letters, ASCII, common punctuation); any other text, any text that holds the name of a
special token, and any tokenizer of another kind goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the split that byte-level BPE tokenizers of this kind are defined by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that Unicode versions may class differently, or that are beyond the rule below.
ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
#: Words to which the memo doesn't apply: odd characters, or white space next to the space or line break before or after.
UNUSUAL = re.compile(r"[^\0\x01\t\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]|\A[\0\x01]?\s|\s\Z|\A[\0\x01]?\Z")
#: Words that the memo may hold before those seen once are forgotten, and pre-tokens of a long text handled at a time.
MEMO, AT_ONCE = 400_000, 400_000


#: Bytes of text encoded together.
WORK_BYTES = 3 << 20


class Encoder:
    """Token ids of texts; one per Python worker and tokenizer file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.splits = (
            (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
            and not spec.get("normalizer")
            and (model.get("type"), model.get("dropout"), model.get("ignore_merges", False)) == ("BPE", None, False)
        )
        self.pattern = regex.compile(BYTE_LEVEL)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        # byte-level models write a byte as a character: itself if it is visible, else the next one from 256 on
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in visible]
        self.mapped = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(hidden)}
        self.space = chr(self.mapped[32])
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the memo does its work
        alone = {x: ids for x, ids in zip("\n.,", self.direct(list("\n.,")), strict=True)}
        self.splits &= all(len(x) == 1 for x in alone.values())
        self.newline, *marks = (int(x[0]) for x in alone.values())
        self.marks = {"": [], ".": marks[:1], ",": marks[1:]}
        #: what a word's first character says of what stood before it, if not a space: nothing, or a line break
        self.lead = {"\0": "", "\x01": "\n"}
        self.leads = {"": (self.space, []), "\0": ("", []), "\x01": ("", [self.newline])}
        self._restart()

    def _restart(self) -> None:
        self.known, self.count = pa.array([], pa.large_string()), 0
        self.seen = np.zeros(1 << 14, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[str]:
        """Take words into the memo and return them in its order; letters, with a mark after them or not, go straight to the library's model."""
        plain, rest = [], []
        marked: dict[tuple[str, str], tuple[list[str], list[str]]] = {(lead, mark): ([], []) for lead in self.leads for mark in self.marks}
        for w in new:
            if w.isalpha():
                plain.append(w)
                continue
            lead = w[0] if w[:1] in self.lead else ""
            mark = w[-1] if w[-1:] in self.marks else ""
            body = w[len(lead) : len(w) - len(mark)]
            if body.isalpha():
                words, bodies = marked[lead, mark]
                words.append(w), bodies.append(body)
            else:
                rest.append(w)
        order = list(plain)
        self._add_letters(plain, plain, self.space, [], [])
        for (lead, mark), (words, bodies) in marked.items():
            if words:
                self._add_letters(words, bodies, *self.leads[lead], self.marks[mark])
                order += words
        ids = self.direct([self.lead.get(w[:1], " ") + w[w[:1] in self.lead :] for w in rest])
        self._append(rest, np.concatenate([np.zeros(0, np.int32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids)))
        order += rest
        self.known = pa.concat_arrays([self.known, pa.array(order, pa.large_string())])
        return order

    def _add_letters(self, words: list[str], bodies: list[str], first: str, before: list[int], after: list[int]) -> None:
        """Words whose ids are ``before``, those of ``first`` and the letters of the body, and ``after``."""
        tokenize, mapped = self.model.tokenize, self.mapped
        found = [tokenize(first + (w if w.isascii() else w.encode().decode("latin-1").translate(mapped))) for w in bodies]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.array([t.id for tokens in found for t in tokens], np.int32)
        for extra, at_end in ((before, False), (after, True)):
            for x in extra:
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends if at_end else ends - sizes, x)
                sizes = sizes + 1
        self._append(words, ids, sizes)

    def _append(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, total = self.count, len(ids)
        self.count += len(new)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(new) > len(self.sizes):
            self.sizes, self.starts, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.starts, self.seen))
        self.pool[self.used : self.used + total] = ids
        self.sizes[first : first + len(new)] = sizes
        self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def _forget(self) -> None:
        """Keep the words seen more than once since the last time, at most half of the memo."""
        at = np.flatnonzero(self.seen[: len(self.known)] > 1)[: self.memo // 2]
        kept = self.known.take(pa.array(at))
        sizes, starts, pool = self.sizes[at], self.starts[at], self.pool
        self._restart()
        ends = np.cumsum(sizes)
        ids = pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.known, self.count = kept, len(kept)
        self.pool, self.used = np.concatenate([ids, np.zeros(1 << 16, np.int32)]), len(ids)
        self.sizes, self.starts = (np.concatenate([x, np.zeros(1 << 14, np.int64)]) for x in (sizes, ends - sizes))
        self.seen = np.zeros(len(self.sizes), np.int32)

    def _places(self, words: pa.Array, pieces: bool = False) -> np.ndarray:
        """Where the memo has these different words, after learning those that it lacks; -1 for a word beyond its rule.

        ``pieces``: they are pre-tokens, to which the rule on white space does not apply.
        """
        if len(self.known) > self.memo:
            self._forget()
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            new = words.take(pa.array(lacking)).to_pylist()
            beyond = set() if pieces else {w for w in new if UNUSUAL.search(w)}
            first = len(self.known)
            order = self._learn([w for w in new if w not in beyond] if beyond else new)
            place = dict(zip(order, range(first, first + len(order)), strict=True))
            at[lacking] = np.fromiter((place.get(w, -1) for w in new), np.int64, len(new))
        return at

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        self.seen += np.bincount(at, minlength=len(self.seen)).astype(np.int32)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        take = np.repeat(self.starts[at] - (ends - sizes), sizes)
        take += np.arange(len(take))
        return self.pool[take], sizes

    def _split(self, text: str) -> np.ndarray:
        """Ids of a text that is split into pre-tokens bit by bit."""
        found, out = ("\0" + m.group() for m in self.pattern.finditer(text)), [np.zeros(0, np.int32)]
        while part := list(islice(found, AT_ONCE)):
            coded = pa.array(part, pa.large_string()).dictionary_encode()
            out.append(self._gather(self._places(coded.dictionary, True)[coded.indices.to_numpy()])[0])
        return np.concatenate(out)

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``end`` after it, and the offsets of the texts. Null is empty."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        own = np.array(pc.greater(pc.binary_length(texts), 0), bool) & self.splits
        for name in [*self.special, "\0", "\x01"]:
            own &= ~np.array(pc.match_substring(texts, name), bool)
        # no space before the first word of a text
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.replace_substring(texts.filter(pa.array(own)), "\n", " \x01"), pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(marked, " ")
        firsts, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        firsts -= firsts[0]
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        if (at < 0).any():  # texts that hold a word beyond the rule
            hit = np.add.reduceat(at < 0, firsts[:-1]) > 0
            own[np.flatnonzero(own)[hit]] = False
            at, firsts = at[np.repeat(~hit, np.diff(firsts))], np.concatenate([[0], np.cumsum(np.diff(firsts)[~hit])])
        got, sizes = self._gather(at)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[firsts]
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for k, i in enumerate(np.flatnonzero(own)):
            ids[i] = got[cuts[k] : cuts[k + 1]]
        for i in np.flatnonzero(~own):
            if text := texts[int(i)].as_py():
                plain = self.splits and not any(x in text for x in self.special) and not ODD.search(text)
                ids[i] = self._split(text) if plain else self.direct([text])[0]
        if end is not None:
            tail = np.array([end], np.int32)
            ids = [x for own_ids in ids for x in (own_ids, tail)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)).reshape(-1, 2).sum(axis=1)
        else:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(sizes)])
