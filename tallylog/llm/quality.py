"""Quality of documents by weak supervision: rules vote or abstain, and a model weighs the votes.

Each rule reads a measure of the text and votes good, bad or nothing. No single vote decides.
How often a rule votes each way on good and on bad documents is estimated without labels, by
expectation-maximisation over the counts of vote patterns, taking rules as independent given the
class. The posterior probability of "good" then decides. There are at most 3 ** len(RULES) vote
patterns whatever the number of documents, so the counts are all that reaches the driver.

Everything that touches documents is built from DataFrame functions. Words are runs of characters
other than space and tab to carriage return.

Null or empty text has no words: its counts are 0, every rule abstains or votes on zeros, and it
fails the base rule. Null ids, repeated ids and equal rows are judged row by row; other columns
stay as they are in `add_measures` and `keep_good`. A table without rows gives the prior model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.binding import computed_once
from tallylog.llm.shared import cut, row_key, split_join, whole_text

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
#: A document fails if more than this share of its words is repeated, in percent.
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_distinct_words")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _number(text: Column, characters: str) -> Column:
    """Number of a text's characters that are among the given ones, taken one by one."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the text.

    Windows are compared by a 64-bit hash. Sorted by hash and place, equal ones are neighbours;
    each of their places covers three words less what the next place covers too.
    """
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(pairs: Column) -> Column:
            same = F.filter(
                pairs,
                lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]),
            )
            return F.sort_array(F.transform(same, lambda p: p["i"]))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(_let(ordered, places), total)

    def unless_distinct(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    return F.when(n < 4, 0).otherwise(_let(windows, unless_distinct)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def add_measures(docs: DataFrame) -> DataFrame:
    """The documents with the columns of MEASURES (long), replacing columns of these names.

    Words, lines and the few characters that are counted are made once each, and no later filter
    moves below the measures.
    """
    text = whole_text()
    own = [F.col(c) for c in docs.columns if c not in MEASURES]
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    marks = F.regexp_replace(text, f"[^{SYMBOLS}!A-Z]+", "")
    split = computed_once(
        docs.select(
            F.struct(*own).alias("_own"), marks.alias("_marks"), _words(text).alias("_words"), lines.alias("_lines")
        )
    )
    marks, n = F.col("_marks"), F.size("_words")
    return computed_once(
        split.select(
            "_own.*",
            n.cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            _number(marks, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("_words"), n).alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            _number(marks, CAPITALS).cast("long").alias("n_upper"),
            _number(marks, "!").cast("long").alias("n_exclaims"),
            F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        )
    )


def base_failed() -> Column:
    """Too few words, or too many of them repeated."""
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def _vote(bad: Column, good: Column) -> Column:
    """-1, 1, or 0 for neither."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules' votes by name, over the columns of MEASURES."""
    n = F.col("n_words")
    mean = F.try_divide("word_chars", n)  # null without words, in ANSI mode, too: the rule abstains
    return {
        "word_length": _vote((mean < 2) | (mean > 9), mean.between(3, 7)),
        "symbols": _vote(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= n),
        "exclaims": _vote(5 * F.col("n_exclaims") > n, 50 * F.col("n_exclaims") <= n),
        "capitals": _vote(3 * F.col("n_upper") > F.col("word_chars"), 8 * F.col("n_upper") < F.col("word_chars")),
        "repeats": _vote(
            100 * F.col("n_repeat_words") > 30 * n, 100 * F.col("n_repeat_words") <= 10 * n
        ),
        "same_lines": _vote(3 * F.col("n_dup_lines") > F.col("n_lines"), F.col("n_dup_lines") == 0),
        "variety": _vote(20 * F.col("n_distinct_words") < n, 5 * F.col("n_distinct_words") >= n),
    }


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and for each rule how often it votes bad, nothing and good on bad
    and on good documents: rates[rule][0 bad or 1 good][vote + 1]."""

    prior: float
    rates: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def weight(self, rule: int, vote: int) -> float:
        """What a vote adds to the log odds of good."""
        bad, good = self.rates[rule]
        return math.log(good[vote + 1] / bad[vote + 1])

    def log_odds(self, votes: tuple[int, ...]) -> float:
        start = math.log(self.prior / (1 - self.prior))
        return start + math.fsum(self.weight(j, v) for j, v in enumerate(votes))


def estimate(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 50) -> VoteModel:
    """Fit a VoteModel to counts of vote patterns.

    It starts from "no bad vote: good; one: likely bad; more: bad", and every rate has a small
    part of a vote added, so none is 0.
    """
    items = sorted(patterns.items())
    good = {votes: (0.98, 0.3, 0.05)[min(2, votes.count(-1))] for votes, _ in items}
    model = VoteModel(0.9, (((0.3, 0.3, 0.4), (0.02, 0.08, 0.9)),) * n_rules)
    for _ in range(rounds if items else 0):
        total = math.fsum(c for _, c in items)
        n_good = math.fsum(c * good[v] for v, c in items)
        classes = ((total - n_good, lambda v: 1 - good[v]), (n_good, lambda v: good[v]))
        rates = tuple(
            tuple(
                tuple(
                    (math.fsum(c * part(v) for v, c in items if v[j] == vote) + 0.01) / (size + 0.03)
                    for vote in (-1, 0, 1)
                )
                for size, part in classes
            )
            for j in range(n_rules)
        )
        prior = min(0.995, max(0.05, n_good / total))
        following = VoteModel(prior, rates)
        if model is not None and all(
            abs(a - b) < 1e-9 for x, y in zip(model.rates, rates) for p, q in zip(x, y) for a, b in zip(p, q)
        ):
            break
        model = following
        good = {v: 1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(v))))) for v, _ in items}
    return model


def fit(measured: DataFrame) -> VoteModel:
    """The model for documents with measures: all that pass the base rule, as the others are
    decided already."""
    votes = rules()
    counts = measured.where(~base_failed()).groupBy(*[v.alias(name) for name, v in votes.items()]).count().collect()
    return estimate({tuple(r[name] for name in votes): r["count"] for r in counts}, len(votes))


def posterior(model: VoteModel) -> Column:
    """Probability that a document with measures is good."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for j, vote in enumerate(rules().values()):
        weights = [F.lit(model.weight(j, v)) for v in (-1, 0, 1)]
        odds = odds + F.when(vote == -1, weights[0]).when(vote == 1, weights[2]).otherwise(weights[1])
    return 1 / (1 + F.exp(-odds))


def judge(measured: DataFrame, model: VoteModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """Documents with measures, with base_failed, p_good and kept."""
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("p_good", posterior(model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))
    )


def keep_good(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that are kept, with their own columns. The measures are made once and held, as
    numbers, by the rows' keys; rows of one key have one text and so one verdict."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), *row_key())
    held = cut(add_measures(docs.select(*row_key(), "text")).drop("text"))
    kept = judge(held, fit(held), keep_from).where("kept").select("k_id", "k_th").distinct()
    found = split_join(rows, kept, ["k_id", "k_th"], "left_semi")
    return found.select(*[F.col("_row")[c].alias(c) for c in names])
