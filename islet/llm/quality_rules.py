"""Weak supervision of document quality: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from islet.storage import stage

#: White space between words, and the characters that count as symbols. Fixed values of the result's definition.
BLANK, WORD, SYMBOLS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", "#*$%&|<>"
#: Bytes of a text that is counted inside its row. Longer ones are cut into pieces of so many characters and the rest of their last word or line.
LONGEST, PIECE = 1 << 20, 1 << 16


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def _sums(text: Column, words: Column) -> dict[str, Column]:
    """Counts of a text that add up over pieces of whole words."""
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(text, BLANK + "+", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
        "n_ends": F.regexp_count(text, F.lit(rf"[.!?](?!{WORD})")),
        "n_marks": F.regexp_count(text, F.lit(rf"(?:[!?]{{2,}}|[#*$%&|<>])(?!{WORD})")),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_ends", "n_marks", "n_distinct")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and a struct column ``f`` of counts over the whole text (null: empty).

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters,
    n_ends (words that end a sentence), n_marks (words that end in two marks or a symbol) and
    n_distinct (different words). A window of three words is known by its 64-bit hash; a text's
    windows are sorted inside its row, so the cost is n log n and no row leaves its task. That takes
    some hundred bytes of memory a word; ``long_features`` has the same counts for very long texts.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    first = docs.withColumns({"_t": t, "_w": _words(t), "_l": lines})
    hashes = F.expr("case when size(_w) >= 3 then transform(sequence(1, size(_w) - 2), i -> xxhash64(_w[i - 1], _w[i], _w[i + 1])) else cast(array() as array<bigint>) end")
    second = first.withColumn("_h", hashes)
    # most short texts repeat nothing: their windows aren't sorted
    some = F.expr("case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (h, i) -> struct(h as h, i as i))) else cast(array() as array<struct<h:bigint,i:int>>) end")
    third = second.withColumn("_s", some)
    again = F.expr("transform(filter(_s, (x, k) -> (k > 0 and x.h = _s[k - 1].h) or (k + 1 < size(_s) and x.h = _s[k + 1].h)), x -> x.i)")
    last = third.withColumn("_r", again)
    counts = _sums(F.col("_t"), F.col("_w")) | {
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform("_r", lambda i: F.array(i, i + 1, i + 2))))),
        "n_distinct": F.size(F.array_distinct("_w")),
    }
    out = last.withColumn("f", F.struct(*(counts[k].cast("long").alias(k) for k in COUNTS)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "f")


def long_features(texts: DataFrame) -> DataFrame:
    """``_n`` and the struct ``f`` of ``features``, for ``texts(_n, _long)`` of different ``_n``, whatever their length.

    A text is cut into pieces that end with a word (for lines: with a line), each beside the two
    words that follow it, and words, lines and windows are grouped as rows, which may spill.
    """
    cut = F.lit(rf"(?s)(.{{1,{PIECE}}}+{WORD}*+)(?=({BLANK}*+{WORD}*+{BLANK}*+{WORD}*+))")
    both = texts.select("_n", F.regexp_extract_all("_long", cut, F.lit(1)).alias("own"), F.regexp_extract_all("_long", cut, F.lit(2)).alias("after"))
    pieces = both.select("_n", F.posexplode(F.arrays_zip("own", "after")).alias("c", "p")).select("_n", "c", F.col("p.own").alias("t"), _words(F.col("p.own")).alias("w"), _words(F.col("p.after")).alias("next"))
    sums = pieces.groupBy("_n").agg(*(F.sum(c).alias(k) for k, c in _sums(F.col("t"), F.col("w")).items()))
    distinct = pieces.select("_n", F.explode("w").alias("w")).distinct().groupBy("_n").agg(F.count("*").alias("n_distinct"))
    blocks = texts.select("_n", F.explode(F.regexp_extract_all("_long", F.lit(rf"(?s).{{1,{PIECE}}}+[^\n]*+"), F.lit(0))).alias("t"))
    lines = blocks.select("_n", F.explode(F.split("t", "\n")).alias("line")).where(F.col("line").rlike(WORD)).groupBy("_n", "line").agg(F.count("*").alias("k"))
    lines = lines.groupBy("_n").agg(F.sum("k").alias("n_lines"), F.sum(F.col("k") - 1).alias("n_dup_lines"))
    before = Window.partitionBy("_n").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select("_n", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)).alias("start"), F.concat("w", "next").alias("w"), F.least(F.size("w"), F.size("w") + F.size("next") - 2).alias("many"))
    windows = placed.where("many > 0").select("_n", F.explode(F.expr("transform(sequence(0, many - 1), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, start + i as at))")).alias("x")).select("_n", "x.h", "x.at")
    again = windows.groupBy("_n", "h").agg(F.count("*").alias("k")).where("k > 1")
    repeated = windows.join(again, ["_n", "h"], "left_semi").select("_n", F.explode(F.expr("array(at, at + 1, at + 2)")).alias("at"))
    repeated = repeated.distinct().groupBy("_n").agg(F.count("*").alias("n_repeat_words"))
    found = sums.join(distinct, "_n", "left").join(lines, "_n", "left").join(repeated, "_n", "left")
    return found.select("_n", F.struct(*(F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in COUNTS)).alias("f"))


@dataclass(frozen=True)
class Rule:
    """A vote on a text: good (1) above or below one bound, bad (0) beyond the other, else none."""

    name: str
    share: str
    good: str
    bad: str

    def vote(self) -> Column:
        share = f"(case when f.n_words > 0 then {self.share} end)"
        return F.expr(f"case when {share} {self.bad} then 0 when {share} {self.good} then 1 end").alias(self.name)


RULES = (
    Rule("symbols", "f.n_symbols / f.word_chars", "< 0.005", "> 0.02"),
    Rule("marks", "f.n_marks / f.n_words", "< 0.05", "> 0.2"),
    Rule("repeats", "f.n_repeat_words / f.n_words", "< 0.2", "> 0.4"),
    Rule("variety", "f.n_distinct / sqrt(f.n_words)", "> 4", "< 2.5"),
    Rule("capitals", "f.n_upper / f.n_letters", "< 0.15", "> 0.4"),
    Rule("sentences", "f.n_ends / f.n_words", "between 0.01 and 0.35", "not between 0.002 and 0.6"),
    Rule("lines", "f.n_dup_lines / f.n_lines", "< 0.1", "> 0.3"),
    Rule("word_length", "f.word_chars / f.n_words", "between 3 and 9", "not between 2 and 15"),
)


@dataclass(frozen=True)
class Weights:
    """Share of good texts, and how often each rule is right on good and on bad ones when it votes."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def steps(self) -> list[tuple[float, float]]:
        """What a vote of each rule adds to the log odds of a good text: (against, for)."""
        return [(math.log((1 - a) / b), math.log(a / (1 - b))) for a, b in zip(self.on_good, self.on_bad, strict=True)]

    def posterior(self, rules: tuple[Rule, ...]) -> Column:
        """Probability that a text is good, from the columns of votes."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for rule, (against, for_) in zip(rules, self.steps(), strict=True):
            # looked up by vote, so that all weights make the same generated code
            odds = odds + F.element_at(F.array(F.lit(0.0), F.lit(against), F.lit(for_)), F.coalesce(F.col(rule.name), F.lit(-1)) + 2)
        return 1 / (1 + F.exp(-odds))

    def log_odds(self, votes: tuple[int | None, ...]) -> float:
        """The same on one pattern of votes, as log odds."""
        return math.log(self.good / (1 - self.good)) + sum(step[v] for v, step in zip(votes, self.steps(), strict=True) if v is not None)


#: Vote patterns that the driver may hold: those of eight rules.
MOST_PATTERNS = 3**8
#: A rule is never trusted beyond this rate of errors, nor taken for worse than chance on good texts.
LEAST_ERROR, CHANCE = 1e-4, 0.5


def estimated(patterns: list[tuple[tuple[int | None, ...], int]], rules: int, close: float = 1e-9) -> Weights:
    """Expectation-maximisation over counted vote patterns, until a round adds less than ``close`` to the mean log likelihood.

    Both accuracies of every rule and the share of good texts are estimated, with a few
    pseudo-counts. To tell the classes apart, no rule is worse than chance on good texts, and a vote
    for good is more frequent on good texts than on bad ones. Each round adds to a sum that is
    bounded, so the rounds end.
    """
    now, last, total = Weights(0.85, (0.99,) * rules, (0.4,) * rules), -math.inf, sum(n for _, n in patterns)
    while True:
        good, fit, sums = 0.0, 0.0, [[0.0] * 4 for _ in range(rules)]
        rare = math.log(1 - now.good)
        by_rule = [(math.log(b), math.log(1 - b)) for b in now.on_bad]
        for votes, n in patterns:
            odds = now.log_odds(votes)
            p = 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0
            # likelihood: that under bad texts, times 1 + odds
            fit += n * (rare + sum(by_rule[i][v] for i, v in enumerate(votes) if v is not None) + max(odds, 0.0) + math.log1p(math.exp(-abs(odds))))
            good += n * p
            for own, v in zip(sums, votes, strict=True):
                if v is not None:
                    own[v] += n * p
                    own[2 + v] += n * (1 - p)
        if fit - last <= close * max(total, 1):
            return now
        on_good = [min(max((right + 9.5) / (right + wrong + 10), CHANCE), 1 - LEAST_ERROR) for wrong, right, _, _ in sums]
        on_bad = [min(max((caught + 1) / (caught + missed + 2), 1 - a), 1 - LEAST_ERROR) for a, (_, _, caught, missed) in zip(on_good, sums, strict=True)]
        now, last = Weights((good + 8.5) / (total + 10), tuple(on_good), tuple(on_bad)), fit


def fit(patterns: DataFrame, rules: tuple[Rule, ...]) -> Weights:
    """Weights from the table of vote patterns and their counts ``n``: three to the number of rules at most, which is checked."""
    if 3 ** len(rules) > MOST_PATTERNS:
        raise ValueError("too many rules for one table of vote patterns")
    rows = patterns.select(*(r.name for r in rules), "n").collect()
    return estimated(sorted(((tuple(r)[:-1], r["n"]) for r in rows), key=str), len(rules))


def _cast(counted: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``counted`` with the votes on its ``f`` and ``base_failed``."""
    failed = (F.col("f.n_words") < 50) | (100 * F.col("f.n_repeat_words") > 50 * F.col("f.n_words"))
    return counted.withColumns({r.name: r.vote() for r in rules} | {"base_failed": failed})


def votes(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``f``, a column of votes for each rule, and ``base_failed``."""
    return _cast(features(docs, text), rules)


def _voted(docs: DataFrame, text: str, rules: tuple[Rule, ...], name: str, *unused: str) -> DataFrame:
    """``votes`` without the columns ``text`` and ``unused``, written once; texts of any length.

    Texts beyond ``LONGEST`` are written beside the others, and counted from there.
    """
    long = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")) > LONGEST, F.lit(False))
    whole = docs.withColumns({"_long": F.when(long, F.col(f"`{text}`").cast("string")), "_n": F.when(long, F.monotonically_increasing_id()), text: F.when(~long, F.col(f"`{text}`"))})
    # long rows fill a row group before Parquet's first look at its size, by default after 100 rows
    table = stage(votes(whole, text, rules).drop(text, *unused), name, **{"parquet.block.size.row.check.min": "1"})
    out = table.drop("_long", "_n")
    some = table.where("_n is not null")
    if some.isEmpty():
        return out
    counts = stage(long_features(some.select("_n", "_long")), f"{name}-long")
    kept = [c for c in out.columns if c not in {"f", "base_failed", *(r.name for r in rules)}]
    fixed = _cast(some.select("_n", *(F.col(f"`{c}`") for c in kept)).join(counts, "_n"), rules)
    return table.where("_n is null").drop("_long", "_n").union(fixed.select(*(F.col(f"`{c}`") for c in out.columns)))


def weigh(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Weights:
    """Weights of the rules from the vote patterns of all rows."""
    return fit(voted.groupBy(*(r.name for r in rules)).agg(F.count("*").alias("n")), rules)


def judge(voted: DataFrame, weights: Weights, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``voted`` with ``posterior`` and ``kept``."""
    scored = voted.withColumn("posterior", weights.posterior(rules))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def _free(docs: DataFrame, added: list[str]) -> None:
    clash = {c.lower() for c in docs.columns} & {c.lower() for c in added}
    if clash:
        raise ValueError(f"columns are named like added ones: {sorted(clash)}")


def score(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the text, with ``f`` (counts), a vote column per rule, ``base_failed``, ``posterior`` and ``kept``.

    The counts are written once; vote patterns are counted from them, the rules are weighed on the
    pattern counts of all documents, and each row's posterior follows from its votes.
    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.
    ``kept``: not ``base_failed`` and a posterior of at least ``threshold``.

    Null or empty text has no words: every rule abstains and the base fails it. A very long text is
    counted whole, by its pieces. Rows stand for themselves, so ties, null or repeated ids change
    nothing. No rows: an empty table. ValueError if a column of ``docs`` is named like an added one
    (``keep`` takes any).
    """
    _free(docs, ["f", "_long", "_n", "base_failed", "posterior", "kept", *(r.name for r in rules)])
    voted = _voted(docs, text, rules, "quality")
    return judge(voted, weigh(voted, rules), rules, threshold)


def keep(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` would keep, with their own columns whatever the names.

    Null, empty and very long texts, ties, repeated rows and empty tables: as in ``score``. Rows are
    written once with their votes, so that each text is counted once.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text}`").alias("_text"))
    voted = _voted(whole, "_text", RULES, "voted", "f")
    return judge(voted, weigh(voted), threshold=threshold).where("kept").select("_row.*")
