"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs the votes.

All row work is built-in column expressions. The label model sees one row per combination of votes (at most three
to the number of rules, whatever the corpus holds), so expectation-maximisation runs on those counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleystat.llm.common import stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
BREAKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Words of a window in which distinct words are counted.
SPREAD = 400

GOOD, ABSTAIN, BAD = 1, 0, -1
ROUNDS = 200
#: What is believed before any document is seen: the share of bad documents; how many of the documents a rule votes on
#: it calls bad, among good ones, among those bad for its own reason, and among those bad for another; and how often it
#: abstains in each of these cases.
PRIOR_BAD = 0.15
BAD_IF_GOOD, BAD_BY_REASON, BAD_OTHERWISE = 0.002, 0.95, 0.1
ABSTAINS_IF_GOOD, ABSTAINS_BY_REASON, ABSTAINS_OTHERWISE = 0.15, 0.2, 0.25
#: How much the beliefs count, as a share of the documents.
BELIEF = 0.01
#: Why a document is bad, and the rules that see it. Rules of one reason back each other or stand alone.
REASONS = {
    "noise": ("symbols", "letters", "word_size"),
    "repetition": ("repeats", "same_lines", "one_word"),
    "shouting": ("capitals", "exclaims"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body`, also inside lambdas there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kept_only(text: Column, gone: str) -> Column:
    return F.length(F.translate(text, gone, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that occur twice or more in the array.

    Windows are told apart by 64-bit hashes. Only a text that has a repeated window sorts them; the rest of the
    work is linear in its words.
    """

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - window),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]),
        )

    def positions(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def twins(s: Column) -> Column:
            def place(e: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(s, i - 1)["h"] == e["h"]).otherwise(F.lit(False))
                after = F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
                return F.when(before | after, e["p"])

            return F.sort_array(F.array_compact(F.transform(s, place)))

        return let(ordered, twins)

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        step = lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(window), p - acc["last"]).cast("long")).alias("n"), p.alias("last")
        )
        return F.aggregate(at, start, step)["n"]

    def count(found: Column) -> Column:
        alike = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(alike, covered(positions(found))).otherwise(F.lit(0).cast("long"))

    enough = F.size(words) >= window
    return F.when(enough, let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)).otherwise(F.lit(0).cast("long"))


def distinct_share(words: Column, window: int = SPREAD) -> Column:
    """The mean share of distinct words in windows of `window` words over the whole array, so that its length does
    not matter; the last window ends where the array does. A shorter array is one window, an empty one has none."""
    n = F.size(words)
    windows = F.greatest(F.ceil(n / window).cast("int"), F.lit(1))
    first = lambda i: F.least(i * window, F.greatest(n - window, F.lit(0))) + 1
    counts = F.transform(
        F.sequence(F.lit(0), windows - 1), lambda i: F.size(F.array_distinct(F.slice(words, first(i), F.lit(window))))
    )
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda t, c: t + c)
    return F.try_divide(total.cast("double"), (windows.cast("long") * F.least(n, F.lit(window))).cast("double"))


def measures(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and one struct `m` of what the rules look at, from each whole text.

    A null text has no words and no lines. All counts are of Unicode code points.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: _kept_only(x, BREAKS) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            distinct_share(w).alias("distinct_share"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    def of_text(t: Column) -> Column:
        n = F.length(t)
        return F.struct(
            _kept_only(t, BREAKS).cast("long").alias("word_chars"),
            (n - _kept_only(t, SYMBOLS)).cast("long").alias("n_symbols"),
            (n - _kept_only(t, "!")).cast("long").alias("n_exclaims"),
            (n - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
            (n - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long").alias("n_letters"),
        )

    parts = docs.select(
        *keep, let(words, of_words).alias("_w"), let(lines, of_lines).alias("_l"), let(text, of_text).alias("_t")
    )
    return parts.select(
        *keep,
        F.struct("_w.n_words", "_t.word_chars", "_t.n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_w.distinct_share",
                 "_l.n_lines", "_t.n_exclaims", "_t.n_upper", "_t.n_letters").alias("m"),
    )


def base_failed() -> Column:
    return (F.col("m.n_words") < 10) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))


def _vote(value: Column, good_to: float, bad_from: float, applies: Column | None = None) -> Column:
    """Good up to one bound, bad from another, no vote between them or where the rule does not apply."""
    vote = F.when(value >= bad_from, BAD).when(value <= good_to, GOOD).otherwise(ABSTAIN)
    return vote if applies is None else F.when(applies, vote).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """The rules, each a column of GOOD, ABSTAIN or BAD over `measures`."""
    m = {n: F.col(f"m.{n}").cast("double") for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distinct_share", "n_lines", "n_exclaims", "n_upper", "n_letters"
    )}
    per_word = lambda name: F.try_divide(m[name], m["n_words"])
    some = m["n_words"] >= 10
    length = per_word("word_chars")
    return {
        "symbols": _vote(per_word("n_symbols"), 0.03, 0.2, some),
        "repeats": _vote(per_word("n_repeat_words"), 0.05, 0.25, some),
        "same_lines": _vote(F.try_divide(m["n_dup_lines"], m["n_lines"]), 0.1, 0.3, m["n_lines"] >= 4),
        "capitals": _vote(F.try_divide(m["n_upper"], m["word_chars"]), 0.2, 0.45, some),
        "exclaims": _vote(per_word("n_exclaims"), 0.05, 0.3, some),
        "one_word": _vote(-m["distinct_share"], -0.35, -0.2, m["n_words"] >= 30),
        "word_size": F.when(~some | length.isNull(), ABSTAIN)
        .when((length < 2.2) | (length > 14), BAD)
        .when((length >= 3) & (length <= 10), GOOD)
        .otherwise(ABSTAIN),
        "letters": _vote(1 - F.try_divide(m["n_letters"], m["word_chars"]), 0.1, 0.25, some),
    }


@dataclass(frozen=True)
class LabelModel:
    """A latent class of good documents and one of bad documents for each reason.

    `shares` are the classes' shares, good first; `abstains[c][j]` is how often rule `j` abstains in class `c`, and
    `bad_rates[c][j]` how often it calls a document of the class bad where it votes.
    """

    rules: tuple[str, ...]
    reasons: tuple[tuple[str, ...], ...]
    shares: tuple[float, ...]
    abstains: tuple[tuple[float, ...], ...]
    bad_rates: tuple[tuple[float, ...], ...]

    def accuracies(self) -> dict[str, float]:
        """How often a rule that votes is right: it calls good documents good, and those bad for its reason bad."""
        out = {}
        for j, rule in enumerate(self.rules):
            right = [(self.shares[0] * (1 - self.abstains[0][j]), 1 - self.bad_rates[0][j])]
            for c, seen_by in enumerate(self.reasons, 1):
                if rule in seen_by:
                    right.append((self.shares[c] * (1 - self.abstains[c][j]), self.bad_rates[c][j]))
            out[rule] = sum(w * r for w, r in right) / sum(w for w, _ in right)
        return out

    def chances(self, c: int) -> list[dict[int, float]]:
        """Per rule the log of the chance of each vote in class `c`."""
        return [
            {BAD: math.log((1 - a) * b), GOOD: math.log((1 - a) * (1 - b)), ABSTAIN: math.log(a)}
            for a, b in zip(self.abstains[c], self.bad_rates[c])
        ]

    def good_probability(self) -> Column:
        """The posterior that a document is good, over its votes."""
        against, good = F.lit(0.0), self.chances(0)
        for c in range(1, len(self.shares)):
            odds = F.lit(math.log(self.shares[c] / self.shares[0]))
            for vote, mine, theirs in zip(votes().values(), self.chances(c), good):
                weight = {v: mine[v] - theirs[v] for v in mine}
                odds = odds + F.when(vote == BAD, weight[BAD]).when(vote == GOOD, weight[GOOD]).otherwise(weight[ABSTAIN])
            against = against + F.exp(odds)
        return 1 / (1 + against)


def expectation_maximisation(
    rules: Sequence[str], counts: dict[tuple[int, ...], int], rounds: int = ROUNDS, reasons: Sequence[Sequence[str]] | None = None
) -> LabelModel:
    """Fit the label model to how often each combination of votes occurs.

    Rules are taken as independent given the class; to abstain is one of three things a rule can do, with a rate of its
    own in each class. Nothing bounds what is learned: a rule that is often wrong about good documents comes out so, and
    the others outweigh it. What is believed beforehand counts like `BELIEF` of the documents, which keeps every rate
    inside (0, 1) and each class at its reason. With no documents the beliefs stay. Without `reasons` each rule is one.
    """
    k = len(rules)
    reasons = tuple(map(tuple, reasons or [(r,) for r in rules]))
    classes = range(len(reasons) + 1)
    by_class = [[None if c == 0 else rules[j] in reasons[c - 1] for j in range(k)] for c in classes]
    believed = [[{None: BAD_IF_GOOD, True: BAD_BY_REASON, False: BAD_OTHERWISE}[x] for x in row] for row in by_class]
    silent = [[{None: ABSTAINS_IF_GOOD, True: ABSTAINS_BY_REASON, False: ABSTAINS_OTHERWISE}[x] for x in row] for row in by_class]
    shares = [1 - PRIOR_BAD] + [PRIOR_BAD / len(reasons)] * len(reasons)
    rates, abstains, first = [list(r) for r in believed], [list(r) for r in silent], list(shares)
    patterns, total = sorted(counts.items()), sum(counts.values())
    weight = max(1.0, BELIEF * total)
    inside = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    for _ in range(rounds if total else 0):
        model = LabelModel(tuple(rules), reasons, tuple(shares), tuple(map(tuple, abstains)), tuple(map(tuple, rates)))
        chances = [model.chances(c) for c in classes]
        mass = [weight * s for s in first]
        voted = [[weight * first[c] * (1 - silent[c][j]) for j in range(k)] for c in classes]
        called = [[voted[c][j] * believed[c][j] for j in range(k)] for c in classes]
        for pattern, n in patterns:
            logs = [math.log(shares[c]) + sum(chances[c][j][v] for j, v in enumerate(pattern)) for c in classes]
            top = max(logs)
            found = [math.exp(x - top) for x in logs]
            for c, part in enumerate(found):
                part *= n / sum(found)
                mass[c] += part
                for j, v in enumerate(pattern):
                    voted[c][j] += part * (v != ABSTAIN)
                    called[c][j] += part * (v == BAD)
        shares = [m / sum(mass) for m in mass]
        abstains = [[inside(1 - voted[c][j] / mass[c]) for j in range(k)] for c in classes]
        rates = [[inside(called[c][j] / voted[c][j]) for j in range(k)] for c in classes]
    return LabelModel(tuple(rules), reasons, tuple(shares), tuple(map(tuple, abstains)), tuple(map(tuple, rates)))


def fit(measured: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """Fit the label model to the votes on all documents of `measures`."""
    rules = votes()
    seen = measured.select(*[v.alias(n) for n, v in rules.items()]).groupBy(*rules).count().collect()
    counts = {tuple(r[n] for n in rules): r["count"] for r in seen}
    return expectation_maximisation(list(rules), counts, rounds, list(REASONS.values()))


def judged(measured: DataFrame, model: LabelModel) -> DataFrame:
    """Add `base_failed`, `quality` (the posterior) and `kept`."""
    return measured.withColumns({"base_failed": base_failed(), "quality": model.good_probability()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Rows are written with their measures, so that fitting and filtering read these and neither computes them again.
    """
    whole = docs.select("text", F.struct("*").alias("_row"))
    measured = stored(measures(whole, keep=("_row",)), "measured")
    return judged(measured, fit(measured)).where("kept").select("_row.*")
