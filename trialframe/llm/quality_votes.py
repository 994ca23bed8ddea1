"""Quality rules that vote or abstain, weighed by expectation-maximisation.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) on a text. The votes are reduced to counts of vote
patterns, at most 3 to the power of the number of rules, whatever the number of documents. On that table
expectation-maximisation estimates, for every rule, how often it is right about good documents and
about bad ones, and the share of good documents. A document is kept by its posterior probability of being good.
Only DataFrame functions are used; an iteration fetches one row of sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, staged, words_of

ITERATIONS = 40
#: Starting accuracies about good and bad documents and share of good ones; estimates keep within the bounds.
START = (0.9, 0.6, 0.8)
BOUNDS = (0.5, 0.999)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, bound as the variable of a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column, size: int = 3) -> Column:
    """A hash of each run of `size` words."""
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words) - size + 1, F.lit(0))) for k in range(size)]
    return F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(*[w[str(k)] for k in range(size)]))


def _repeats(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, each place once, first occurrences included.

    Most texts have no repeated window; only others sort their windows with their places.
    """

    def places(found: Column) -> Column:
        def marked(spots: Column) -> Column:
            near = F.transform(
                spots,
                lambda s, k: F.when(
                    (s["h"] == F.get(spots, k - 1)["h"]) | (s["h"] == F.get(spots, k + 1)["h"]), s["i"]
                ),
            )
            hit = F.filter(near, lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

        return _let(F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)

    return _let(
        hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h))
    )


def text_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys and the counts the rules read, from whole texts; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select(
        *keys,
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, "\\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(t, "\\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(t, "[^.!?\\u2026]+", "")).cast("long").alias("n_stops"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        _let(
            words_of(F.col(text)),
            lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), _repeats(_windows(w)).alias("r")),
        ).alias("words"),
    )
    return base.select(
        *keys,
        F.col("words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        F.col("words.r").cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("words.d").cast("long").alias("n_distinct_words"),
        "n_upper",
        "n_letters",
        "n_stops",
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules over the columns of `text_counts`; shares are compared as products, so 0 words divide nothing."""
    n = F.col("n_words")
    return {
        "long_enough": _vote(n >= 60, n < 20),
        "word_length": _vote(F.col("word_chars").between(n * 3, n * 10), ~F.col("word_chars").between(n * 2.5, n * 14)),
        "few_symbols": _vote(F.col("n_symbols") * 100 <= n * 2, F.col("n_symbols") * 100 > n * 10),
        "distinct_lines": _vote(F.col("n_dup_lines") * 10 <= F.col("n_lines"), F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "new_phrases": _vote(F.col("n_repeat_words") * 100 <= n * 15, F.col("n_repeat_words") * 100 > n * 30),
        "varied_words": _vote(F.col("n_distinct_words") * 100 >= n * 25, F.col("n_distinct_words") * 100 < n * 15),
        "lower_case": _vote(F.col("n_upper") * 100 <= F.col("n_letters") * 15, F.col("n_upper") * 100 > F.col("n_letters") * 40),
        "letters": _vote(F.col("n_letters") * 100 >= F.col("word_chars") * 80, F.col("n_letters") * 100 < F.col("word_chars") * 60),
        "sentences": _vote(F.col("n_stops").between(n * 0.02, n * 0.3), (F.col("n_stops") == 0) & (n >= 20) | (F.col("n_stops") > n * 0.6)),
    }


def _log_odds(names: list[str], good: dict[str, float], bad: dict[str, float], share: float) -> Column:
    """Log odds that a document is good, given its votes."""
    total = F.lit(math.log(share / (1 - share)))
    for name in names:
        yes, no = math.log(good[name] / (1 - bad[name])), math.log((1 - good[name]) / bad[name])
        total = total + F.when(F.col(name) == 1, yes).when(F.col(name) == -1, no).otherwise(0.0)
    return total


def _posterior(names, good, bad, share) -> Column:
    return 1 / (1 + F.exp(-_log_odds(names, good, bad, share)))


def estimate(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> tuple[dict, dict, float]:
    """Accuracies about good and bad documents, and the share of good ones, from columns of votes.

    An empty table leaves the starting values. A rule that always abstains keeps its starting accuracy.
    """
    patterns = staged(votes.groupBy(*names).agg(F.count("*").alias("_n")).coalesce(1))
    low, high = BOUNDS
    good, bad, share = dict.fromkeys(names, START[0]), dict.fromkeys(names, START[1]), START[2]
    for _ in range(iterations):
        p = _posterior(names, good, bad, share)
        rows = patterns.select("*", (F.col("_n") * p).alias("_good"), (F.col("_n") * (1 - p)).alias("_bad"))
        sums = rows.agg(
            F.sum("_n").alias("_n"),
            F.sum("_good").alias("_good"),
            *[F.sum(F.when(F.col(x) == 1, F.col("_good"))).alias(f"{x}_good") for x in names],
            *[F.sum(F.when(F.col(x) != 0, F.col("_good"))).alias(f"{x}_good_all") for x in names],
            *[F.sum(F.when(F.col(x) == -1, F.col("_bad"))).alias(f"{x}_bad") for x in names],
            *[F.sum(F.when(F.col(x) != 0, F.col("_bad"))).alias(f"{x}_bad_all") for x in names],
        ).first()
        if not sums["_n"]:
            break
        before = [*good.values(), *bad.values(), share]
        for x in names:
            # one document of the starting accuracy is added, so no estimate rests on nothing
            good[x] = min(high, max(low, ((sums[f"{x}_good"] or 0) + START[0]) / ((sums[f"{x}_good_all"] or 0) + 1)))
            bad[x] = min(high, max(1 - good[x] + 1e-3, ((sums[f"{x}_bad"] or 0) + START[1]) / ((sums[f"{x}_bad_all"] or 0) + 1)))
        share = min(0.99, max(0.01, sums["_good"] / sums["_n"]))
        if max(abs(x - y) for x, y in zip(before, [*good.values(), *bad.values(), share], strict=True)) < 1e-5:
            break
    return good, bad, share


def quality(docs: DataFrame, least: float = 0.5, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, counts, votes' posterior `quality`, `base_failed` and `kept` for every row.

    `base_failed`: under 50 words, or more than half of them in repeated 3-word windows. `kept`: not
    base_failed and a posterior of at least `least`. Rows are judged alike whatever their id; a null
    text has no words and fails; repeated rows repeat; an empty table stays empty.
    """
    named = rules()
    counts = staged(text_counts(docs, keys).select("*", *[v.alias(k) for k, v in named.items()]))
    good, bad, share = estimate(counts, list(named))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counts.withColumn("quality", _posterior(list(named), good, bad, share)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
