"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (-1). Expectation-maximisation
over the counts of vote patterns of all documents estimates each rule's
accuracy and the share of good documents; a document's posterior probability
of being good decides instead of an all-must-pass filter.

Null text has no words. A document on which every rule abstains gets the prior.
Empty table: no rows. Repeated rows are each judged. Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import checkpointed

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Where a rule's rates of bad votes start, on bad and on good documents, and
#: how many votes the start counts for. Neither bounds what is learned.
START, START_VOTES = (0.4, 0.05), (6.0, 20.0)
#: Rates stay this far from 0 and 1.
EDGE = 1e-4


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, first ones included.

    Windows are sorted with their positions, so that equal ones are neighbours;
    sorted positions p then cover sum(min(3, p - previous p)) words. Nothing
    here grows faster than n log n.
    """
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n")), lambda a: a["n"])

    def equal_neighbours(s: Column) -> Column:
        same = lambda x, i, d: F.coalesce(F.get(s, i + d)["w"] == x["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

    def of(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(_let(pairs, equal_neighbours)))

    return F.when(last < 0, F.lit(0)).otherwise(_let(windows, of)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: words, characters in words, symbols, repeats."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col), text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    counted = split.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        without("!?").alias("n_shouts"),
        without(".").alias("n_stops"),
        without("|").alias("n_bars"),
    )
    return counted.select(
        id_col, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "n_distinct", "n_upper", "n_shouts", "n_stops", "n_bars",
        F.size("lines").cast("long").alias("n_lines"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(-1))


def votes() -> dict[str, Column]:
    """The rules. Where neither bound is met, or there are too few words, a rule abstains.

    Most defects have a strict and a mild rule or are seen by several, so that
    votes overlap and say how far each rule can be trusted.
    """
    per_word = lambda name: F.col(name) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda name: F.col(name) / F.greatest(F.col("word_chars"), F.lit(1))
    enough = F.col("n_words") >= 20

    def above(value: Column, bad: float, good: float) -> Column:
        return _vote(enough & (value > bad), enough & (value <= good))

    mean, stops = per_word("word_chars"), per_word("n_stops")
    variety = F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    return {
        "word_length": _vote(enough & ((mean < 2.5) | (mean > 12)), enough & mean.between(3.5, 9)),
        "word_length_narrow": _vote(enough & ((mean < 3.5) | (mean > 7)), enough & mean.between(4, 6.5)),
        "symbols": above(per_word("n_symbols"), 0.15, 0.03),
        "symbols_mild": above(per_word("n_symbols"), 0.04, 0.01),
        "symbol_chars": above(per_char("n_symbols"), 0.05, 0.005),
        "dup_lines": _vote((F.col("n_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines")), (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)),
        "repeats": above(per_word("n_repeat_words"), 0.25, 0.1),
        "repeats_mild": above(per_word("n_repeat_words"), 0.08, 0.02),
        "variety": _vote(enough & (variety < 3), enough & (variety >= 6)),
        "upper": above(per_char("n_upper"), 0.3, 0.1),
        "upper_mild": above(per_char("n_upper"), 0.12, 0.06),
        "shouts": above(per_word("n_shouts"), 0.1, 0.02),
        "shouts_mild": above(per_word("n_shouts"), 0.03, 0.005),
        "sentences": _vote((F.col("n_words") >= 60) & (stops < 0.004), enough & stops.between(0.02, 0.3)),
        "sentences_mild": _vote(enough & (stops < 0.03), enough & stops.between(0.04, 0.2)),
        "bars": above(per_word("n_bars"), 0.05, 0.0),
        "bars_mild": above(per_word("n_bars"), 0.01, 0.0),
    }


Rates = list[tuple[float, float]]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300, tolerance: float = 1e-7) -> tuple[float, Rates]:
    """Share of good documents and, for each rule, its accuracies.

    A rule's accuracies are how often a vote that it casts is "bad" on bad and
    on good documents; abstentions say nothing. Both are learned from the votes
    of the other rules: a rule that calls documents bad which the others call
    good gets a high rate on good ones and little weight. A few votes at the
    starting rates (``START_VOTES``) hold a rule that hardly votes near them.
    What "good" means is fixed by one condition alone, that no rule is worse
    than chance. With no patterns the starting values return.
    """
    rules = len(patterns[0][0]) if patterns else len(votes())
    prior, rates = 0.8, [START] * rules
    for _ in range(rounds):
        total = good = 0.0
        hit = [[rate * n for rate, n in zip(START, START_VOTES)] for _ in range(rules)]
        cast = [list(START_VOTES) for _ in range(rules)]
        for pattern, n in patterns:
            p = posterior(pattern, prior, rates)
            total += n
            good += n * p
            for j, v in enumerate(pattern):
                if v >= 0:
                    cast[j][0] += n * (1 - p)
                    cast[j][1] += n * p
                    if v == 0:
                        hit[j][0] += n * (1 - p)
                        hit[j][1] += n * p
        if not total:
            break
        new_prior = min(max(good / total, 0.02), 0.98)
        new = []
        for h, c in zip(hit, cast):
            on_good = min(max(h[1] / c[1], EDGE), 1 - EDGE)
            new.append((min(max(h[0] / c[0], on_good), 1 - EDGE), on_good))
        moved = abs(new_prior - prior) + sum(abs(x - y) for u, v in zip(new, rates) for x, y in zip(u, v))
        prior, rates = new_prior, new
        if moved < tolerance:
            break
    return prior, rates


def weights(rate: tuple[float, float]) -> tuple[float, float]:
    """What a bad and a good vote add to the log-odds of a good document."""
    on_bad, on_good = rate
    return math.log(on_good / on_bad), math.log((1 - on_good) / (1 - on_bad))


def posterior(pattern: tuple[int, ...], prior: float, rates: Rates) -> float:
    odds = math.log(prior / (1 - prior)) + sum(weights(r)[v] for v, r in zip(pattern, rates) if v >= 0)
    return 1 / (1 + math.exp(-max(min(odds, 700), -700)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, votes, posterior quality probability and verdict of every row.

    The statistics and votes of all rows are computed once and checkpointed in the folder
    of ``spark.checkpoint.dir``; only the counts of vote patterns reach the
    driver. The rules read nine statistics at few levels each, so patterns are
    some hundreds, however many documents there are.
    """
    rules = votes()
    voted = checkpointed(statistics(docs, id_col, text_col).select("*", *(c.cast("tinyint").alias(f"vote_{k}") for k, c in rules.items())))
    names = [f"vote_{k}" for k in rules]
    seen = [(tuple(row[:-1]), row[-1]) for row in voted.groupBy(*names).count().collect()]
    prior, rates = fit(sorted(seen))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, rate in zip(names, rates):
        bad, good = weights(rate)
        odds = odds + F.when(F.col(name) == 1, F.lit(good)).when(F.col(name) == 0, F.lit(bad)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= 0.5))
