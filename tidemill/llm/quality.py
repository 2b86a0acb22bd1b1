"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule reads a signal of the text and votes good (1), bad (-1) or abstains (0). Counts of the vote
patterns over all documents are enough to estimate, without labels, how often each rule is right
about good and about bad documents; there are at most 3 to the number of rules patterns, whatever
the size of the corpus. A rule may turn out to say nothing about bad documents (most of them are long
enough), but never to be right less often than by chance, so good stays good. A document's posterior
probability of being good, a sum of log odds over its votes, takes the place of "passes every filter".
Only DataFrame functions touch the texts.

Defined results: null, empty and blank texts have no words, and every rule abstains on them; very
short texts are judged by the rules that still apply; repeated rows get equal results; an empty
table gives no rows (the fit then stays at its starting values); helper columns have names that
begin with `__q_`, other columns of the input pass through unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import SPACE_CHARS, UPPER, table, words, written

WINDOW = 8
START = (0.97, 0.3)
SYMBOLS = "#*$%&|<>"
#: Signs that aren't sentence punctuation, and digits.
MARKS = "#*$%&|<>+/=@[]^_`{}~\\0123456789"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_ended", "n_repeat_words", "n_distinct", "n_capitals", "n_chars")


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the signals as columns `__q_<signal>` (long).

    The steps stand in projections of their own, as a lambda would compute again for each element
    whatever it refers to that isn't a column.
    """
    q = lambda name: F.col(f"__q_{name}")
    t = F.coalesce(F.col(text), F.lit(""))
    marked = t.rlike("[" + "".join(f"\\{c}" if not c.isdigit() else c for c in MARKS) + "]")
    out = docs.withColumns({
        "__q_words": words(F.col(text)),
        "__q_full": F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""),
        "__q_n_symbols": F.when(marked, F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0).cast("long"),
        "__q_n_marks": F.when(marked, F.length(t) - F.length(F.translate(t, MARKS, ""))).otherwise(0).cast("long"),
        "__q_n_capitals": (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long"),
        "__q_n_chars": F.length(t).cast("long"),
    })
    n = F.size("__q_words")
    ended = F.filter("__q_full", lambda x: F.rtrim(x).rlike(r"[.!?]\s*$"))
    out = out.withColumns({
        "__q_n_words": n.cast("long"),
        "__q_word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
        "__q_n_distinct": F.size(F.array_distinct("__q_words")).cast("long"),
        "__q_n_lines": F.size("__q_full").cast("long"),
        "__q_n_dup_lines": (F.size("__q_full") - F.size(F.array_distinct("__q_full"))).cast("long"),
        "__q_n_ended": F.size(ended).cast("long"),
        "__q_w1": F.when(n > WINDOW, F.transform("__q_words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")),
    })
    # Hashes of one word, then of two, four and eight in a row: each is made of two of the step before.
    out = out.withColumn("__q_w2", _doubled("__q_w1", 1)).withColumn("__q_w4", _doubled("__q_w2", 2))
    # A window of eight that comes twice repeats five windows of four.
    again = F.size("__q_w4") - F.size(F.array_distinct("__q_w4")) >= WINDOW // 2 + 1
    out = out.withColumn("__q_windows", F.when(again, _doubled("__q_w4", 4)).otherwise(F.array().cast("array<bigint>"))).drop("__q_w1", "__q_w2", "__q_w4")
    # Most texts have no window twice; only the others are sorted.
    tagged = F.array_sort(F.transform("__q_windows", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    out = out.withColumn("__q_tagged", F.when(F.size(F.array_distinct("__q_windows")) < F.size("__q_windows"), tagged).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    size, none = F.size("__q_tagged"), F.array(F.lit(None).cast("struct<h:bigint,at:int>"))
    around = F.arrays_zip(
        F.col("__q_tagged").alias("own"),
        F.concat(none, F.slice("__q_tagged", F.lit(1), size - 1)).alias("before"),
        F.concat(F.slice("__q_tagged", F.lit(2), size), none).alias("after"),
    )
    twice = F.filter(around, lambda x: F.coalesce(x["own"]["h"] == x["before"]["h"], F.lit(False)) | F.coalesce(x["own"]["h"] == x["after"]["h"], F.lit(False)))
    out = out.withColumn("__q_at", F.when(size > 1, F.array_sort(F.transform(twice, lambda x: x["own"]["at"]))).otherwise(F.array().cast("array<int>")))
    # Each window that occurs twice covers its words up to the next such window.
    next_at = F.concat(F.slice("__q_at", F.lit(2), F.size("__q_at")), F.array(F.lit(2**31 - 1)))
    covered = F.aggregate(F.zip_with("__q_at", next_at, lambda a, b: F.least(F.lit(WINDOW).cast("long"), b.cast("long") - a)), F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumn("__q_n_repeat_words", F.when(F.size("__q_at") > 0, covered).otherwise(F.lit(0).cast("long")))
    return out.drop("__q_words", "__q_full", "__q_windows", "__q_tagged", "__q_at")


def _doubled(hashes: str, step: int) -> Column:
    """Hashes of windows of twice `step` words from those of `step` words."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


@dataclass(frozen=True)
class VoteRule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


RULES = (
    VoteRule("length", "false", "__q_n_words >= 50"),
    VoteRule("word_length", "__q_n_words >= 5 and (__q_word_chars < 3.5 * __q_n_words or __q_word_chars > 7 * __q_n_words)", "__q_n_words >= 20 and __q_word_chars between 4 * __q_n_words and 6.5 * __q_n_words"),
    VoteRule("symbols", "10 * __q_n_symbols > __q_n_words", "__q_n_words >= 5 and __q_n_symbols = 0"),
    VoteRule("marks", "__q_n_words >= 5 and 4 * __q_n_marks > __q_n_words", "__q_n_words >= 5 and 20 * __q_n_marks <= __q_n_words"),
    VoteRule("lines", "__q_n_dup_lines >= 2 and 10 * __q_n_dup_lines > 3 * __q_n_lines", "__q_n_lines >= 4 and __q_n_dup_lines = 0"),
    VoteRule("repeats", "10 * __q_n_repeat_words > 3 * __q_n_words", "__q_n_words >= 30 and 20 * __q_n_repeat_words <= __q_n_words"),
    VoteRule("vocabulary", "__q_n_words >= 20 and 100 * __q_n_distinct < 25 * __q_n_words and __q_n_distinct < 100", "__q_n_words >= 20 and 100 * __q_n_distinct >= 40 * __q_n_words"),
    VoteRule("endings", "__q_n_words >= 30 and 10 * __q_n_ended < 3 * __q_n_lines", "__q_n_words >= 5 and 10 * __q_n_ended >= 7 * __q_n_lines"),
    VoteRule("capitals", "__q_n_words >= 5 and 10 * __q_n_capitals > 3 * __q_n_chars", "__q_n_words >= 5 and 10 * __q_n_capitals < __q_n_chars"),
)


@dataclass(frozen=True)
class Model:
    """prior: share of good documents. right_good[j], right_bad[j]: how often rule j, if it votes, is right about good and about bad ones."""

    prior: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def weights(self) -> tuple[float, list[float], list[float]]:
        """Log odds of the prior, of a good vote and of a bad vote of each rule."""
        good = [math.log(a / (1 - b)) for a, b in zip(self.right_good, self.right_bad, strict=True)]
        bad = [math.log((1 - a) / b) for a, b in zip(self.right_good, self.right_bad, strict=True)]
        return math.log(self.prior / (1 - self.prior)), good, bad

    def posterior(self, votes: list[Column]) -> Column:
        odds, good, bad = self.weights()
        total = F.lit(odds)
        for v, g, b in zip(votes, good, bad, strict=True):
            total = total + F.when(v == 1, F.lit(g)).when(v == -1, F.lit(b)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_patterns(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, prior: float = 0.85) -> Model:
    """Expectation-maximisation over counted vote patterns.

    At the start each rule is right about START[0] of good and START[1] of bad documents: it seldom
    accuses a good one, and misses most bad ones. Four prior votes of that kind hold rules that hardly vote.
    Accuracies stay up to 0.99; the two of a rule add up to 1 at least, as a vote is never evidence
    against itself.
    """
    model = Model(prior, (START[0],) * n_rules, (START[1],) * n_rules)
    total = sum(n for _, n in patterns)
    if not total:
        return model
    held = lambda x, low, high: min(max(x, low), high)
    for _ in range(rounds):
        odds, good, bad = model.weights()
        p_good = []
        for votes, _ in patterns:
            z = odds + sum(good[j] if v == 1 else bad[j] if v == -1 else 0 for j, v in enumerate(votes))
            p_good.append(1 / (1 + math.exp(-held(z, -500, 500))))
        share = sum(p * n for p, (_, n) in zip(p_good, patterns, strict=True)) / total
        rights = []
        for side, start in zip((1, -1), START, strict=True):
            each = []
            for j in range(n_rules):
                w = [((p if side == 1 else 1 - p) * n, v[j]) for p, (v, n) in zip(p_good, patterns, strict=True) if v[j]]
                each.append((4 * start + sum(x for x, v in w if v == side)) / (4 + sum(x for x, _ in w)))
            rights.append(each)
        right_good = [held(a, 0.5, 0.99) for a in rights[0]]
        right_bad = [held(b, 1 - a, 0.99) for a, b in zip(right_good, rights[1], strict=True)]
        new = Model(held(share, 0.5, 0.99), tuple(right_good), tuple(right_bad))
        if max(abs(a - b) for a, b in zip((new.prior, *new.right_good, *new.right_bad), (model.prior, *model.right_good, *model.right_bad), strict=True)) < 1e-9:
            return new
        model = new
    return model


def fit(signals: DataFrame, rules: tuple[VoteRule, ...] = RULES) -> Model:
    """The model for these documents' signals; only the counts of vote patterns, at most 3 ** len(rules), reach the driver."""
    names = [f"__q_v{j}" for j in range(len(rules))]
    rows = signals.select(*[r.vote().alias(n) for r, n in zip(rules, names, strict=True)]).groupBy(*names).count().collect()
    return fit_patterns(sorted((tuple(r[:-1]), r[-1]) for r in rows), len(rules))


def posterior(model: Model, rules: tuple[VoteRule, ...] = RULES) -> Column:
    return model.posterior([r.vote() for r in rules])


def base_failed() -> Column:
    """The contract's base rules: fewer than 20 words, or over 30 % of them in repeated windows."""
    return (F.col("__q_n_words") < 20) | (100 * F.col("__q_n_repeat_words") > 30 * F.col("__q_n_words"))


def kept_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that op3 keeps: no base rule fails and the posterior probability of being good reaches the threshold.

    The documents are written once with the signals, so these are computed once, and never shuffled.
    """
    signals = written(with_signals(docs, text), "quality-signals")
    model = fit(signals)
    return signals.where(~base_failed() & (posterior(model) >= threshold)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    signals = written(with_signals(docs).drop("text"), "quality-signals")
    model = fit(signals)
    failed = base_failed()
    p = posterior(model)
    return signals.select(
        "doc_id", *[F.col(f"__q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & (p >= 0.5)).alias("kept"), F.round(p, 6).alias("p_good"),
    )
