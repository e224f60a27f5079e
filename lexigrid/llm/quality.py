"""Quality rules by weak supervision, native: all in DataFrame operations.

Each rule votes good, votes bad or abstains. Expectation-maximisation over the votes estimates, without
labels, how often each rule gives each answer to good and to bad documents, and how many documents are
good; a document is kept if its posterior probability of being good reaches the threshold. Nothing has to
pass every rule. What is thought of the rules beforehand is where EM starts, and weighs as much as
PRIOR documents; the rest is what the corpus says.

Defined cases. Null text: no words, and so base_failed. Empty text likewise. Very long texts stay in their
row. Repeated rows count each. An empty table gives no rows. Other columns pass through if named in
`keep`, whatever their names; those of the signals and of base_failed, quality, good_share and kept are
replaced by the operator's.

Scale: one scan computes all signals within the row, without exploding words. They are written for
their second use. EM then runs on counts of vote patterns: rules have three votes, so there are at most 3^rules
patterns however large the corpus, and only two numbers per rule go to the driver in each round.
Windows of words are compared by 64-bit hashes; within a text of a million words, two different
windows share one with a probability below 1e-7.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.llm.common import SPACES, boxed, written

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Documents that the rules' first estimates weigh in EM.
PRIOR = 20.0


@dataclass(frozen=True)
class Rule:
    """SQL over the signals. Good where `good` holds, else bad where `bad` holds, else it abstains.

    Most rules look for one defect and abstain where it is missing. `accuracy` is how often a vote of the
    rule is thought to be right before any is counted. Variety is of distinct words to the root of all words,
    which holds for texts of any length; prose has more than 4.
    """

    name: str
    good: str
    bad: str
    accuracy: float


RULES = (
    Rule("length", "n_words >= 40", "n_words < 12", 0.7),
    Rule("prose", "50 * n_symbols <= n_words AND n_distinct * n_distinct >= 9 * n_words", "10 * n_symbols > n_words", 0.8),
    Rule("symbols", "false", "10 * n_symbols > n_words", 0.95),
    Rule("dense_symbols", "false", "n_symbols > n_words", 0.95),
    Rule("word_length", "false", "word_chars > 12 * n_words OR word_chars < 2 * n_words", 0.85),
    Rule("repeated_lines", "false", "2 * n_dup_lines > n_lines AND n_lines >= 4", 0.75),
    Rule("repeated_words", "false", "5 * n_repeat_words > n_words", 0.75),
    Rule("shouting", "false", "2 * n_upper > word_chars", 0.85),
    Rule("exclamations", "false", "5 * n_exclaim > n_words", 0.85),
    Rule("digits", "false", "3 * n_digits > word_chars", 0.8),
    Rule("variety", "false", "n_distinct * n_distinct < 9 * n_words", 0.9),
    Rule("monotony", "false", "n_distinct * n_distinct < 4 * n_words", 0.95),
)


def signals(text: Column, words: Column) -> dict[str, Column]:
    """The counts that rules look at, but for repeated windows."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"[A-Z]")).cast("long"),
        "n_exclaim": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
        "n_distinct": F.size(F.array_distinct(words)).cast("long"),
    }


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """A hash for each window of `size` words; none for shorter texts."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))


def covered_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words within windows whose hash occurs twice or more; overlapping windows count words once."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        same = lambda p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"]))

    starts = F.element_at(F.transform(F.array(pairs), repeated), 1)
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")), step)["n"].cast("long")


def with_signals(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """__in, a struct of the columns in `keep` (all by default), and the signals, each with __s_ before its name."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    worded = docs.select(boxed(docs, keep), text.alias("__text"), words_of(text).alias("__words"))
    hashed = worded.withColumn("__windows", window_hashes(F.col("__words")))
    found = signals(F.col("__text"), F.col("__words"))
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    found["n_repeat_words"] = F.when(some, covered_words(F.col("__windows"))).otherwise(F.lit(0).cast("long"))
    return hashed.select("__in", *(c.alias(f"__s_{k}") for k, c in found.items()))


def vote(rule: Rule, names: list[str]) -> Column:
    """1 good, 0 bad, null abstains; over signals of these names."""
    on = lambda sql: re.sub(rf"\b({'|'.join(names)})\b", r"__s_\1", sql)
    return F.when(F.expr(on(rule.good)), 1).when(F.expr(on(rule.bad)), 0)


@dataclass(frozen=True)
class Fitted:
    """The share of good documents, and how often rules vote (bad, good, abstain) on good and on bad ones."""

    good: float
    on_good: tuple[tuple[float, float, float], ...]
    on_bad: tuple[tuple[float, float, float], ...]

    def accuracy(self, j: int) -> float:
        """How often rule j's votes are right."""
        right = self.good * self.on_good[j][1] + (1 - self.good) * self.on_bad[j][0]
        wrong = self.good * self.on_good[j][0] + (1 - self.good) * self.on_bad[j][1]
        return right / (right + wrong) if right + wrong else 0.5


def _shares(counts: tuple[float, float, float], prior: tuple[float, float, float]) -> tuple[float, float, float]:
    """Shares of the three answers, with PRIOR more documents that answer as before, and a hundredth of each."""
    sums = [c + PRIOR * p + 0.01 for c, p in zip(counts, prior, strict=True)]
    return tuple(x / sum(sums) for x in sums)


def start(totals: list[tuple[float, float]], n: float, rules: tuple[Rule, ...], good: float) -> Fitted:
    """Before EM: answers as often as all documents get them, weighed by what is thought of the rule."""
    sides = ([], [])
    for (bad, fine), rule in zip(totals, rules, strict=True):
        rest, a = max(n - bad - fine, 0.0), rule.accuracy
        for side, (x, y) in zip(sides, ((1 - a, a), (a, 1 - a)), strict=True):
            side.append(_shares((bad * x, fine * y, rest / 2), (0.0, 0.0, 0.0)))
    return Fitted(good, tuple(sides[0]), tuple(sides[1]))


def fit(patterns: DataFrame, rules: tuple[Rule, ...], good: float, *, rounds: int = 60) -> Fitted:
    """EM over (v0, v1, ..., n) counts of vote patterns; `good` is the share of good ones it starts from."""
    sums = lambda weight: [F.sum(F.when(F.col(f"v{j}") == v, weight)) for j in range(len(rules)) for v in (0, 1)]
    first = [float(x or 0) for x in patterns.agg(F.sum("n"), *sums(F.col("n"))).first()]
    n, totals = first[0], list(zip(first[1::2], first[2::2], strict=True))
    begin = now = start(totals, n, rules, good)
    for _ in range(rounds):
        weight = F.col("n") * posterior([F.col(f"v{j}") for j in range(len(rules))], now)
        row = [float(x or 0) for x in patterns.withColumn("w", weight).agg(F.sum("w"), *sums(F.col("w"))).first()]
        fine, votes = row[0], list(zip(row[1::2], row[2::2], strict=True))
        side = lambda all_of, counted, prior: tuple(_shares((b, g, all_of - b - g), p) for (b, g), p in zip(counted, prior, strict=True))
        others = [(t[0] - v[0], t[1] - v[1]) for t, v in zip(totals, votes, strict=True)]
        before, now = now, Fitted((fine + PRIOR * good) / (n + PRIOR), side(fine, votes, begin.on_good), side(n - fine, others, begin.on_bad))
        flat = lambda f: [f.good, *(x for s in (f.on_good, f.on_bad) for r in s for x in r)]
        if max(abs(a - b) for a, b in zip(flat(before), flat(now), strict=True)) < 1e-6:
            break
    return now


def posterior(votes: list[Column], fitted: Fitted) -> Column:
    """The probability of good, of votes that are independent within good and within bad documents."""
    odds = F.lit(math.log(fitted.good / (1 - fitted.good)))
    for v, fine, bad in zip(votes, fitted.on_good, fitted.on_bad, strict=True):
        says = [math.log(x / y) for x, y in zip(fine, bad, strict=True)]
        odds = odds + F.when(v == 0, says[0]).when(v == 1, says[1]).otherwise(says[2])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, good: float = 0.6, threshold: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """The columns in `keep` (all by default), the signals, base_failed, quality (the posterior), good_share and kept."""
    keep = docs.columns if keep is None else keep
    scored = written(with_signals(docs, text_col=text_col, keep=keep), "quality-signals")
    names = [c.removeprefix("__s_") for c in scored.columns if c.startswith("__s_")]
    votes = [vote(r, names) for r in rules]
    counted = scored.select(*(v.alias(f"v{j}") for j, v in enumerate(votes))).groupBy(*(f"v{j}" for j in range(len(rules)))).agg(F.count("*").alias("n"))
    fitted = fit(written(counted.coalesce(1), "quality-votes"), rules, good)
    base_failed = F.expr(f"__s_n_words < {min_words} OR 100 * __s_n_repeat_words > {max_repeat_percent} * __s_n_words")
    taken = {*names, "base_failed", "quality", "good_share", "kept"}
    return scored.withColumn("__p", posterior(votes, fitted)).select(
        *(F.col(f"__in.`{c}`") for c in keep if c not in taken),
        *(F.col(f"__s_{n}").alias(n) for n in names),
        base_failed.alias("base_failed"),
        F.col("__p").alias("quality"),
        F.lit(fitted.good).alias("good_share"),
        (~base_failed & (F.col("__p") >= threshold)).alias("kept"),
    )
