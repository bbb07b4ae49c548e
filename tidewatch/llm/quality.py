"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. A rule whose fault is rare says
nothing by its absence: it votes bad or abstains. The hidden quality and the
rules' accuracies are estimated together by expectation-maximisation on a naive Bayes model of
the votes, to convergence: every rule has, for good and for bad documents, its own probabilities of
the three votes. The votes of all documents are counted by pattern in Spark; the model is fitted on that
table, whose size is bounded by 3 ** rules. Weak Beta-like pseudo-counts keep "good" the side the
rules call good. A document's posterior probability is a sum of per-rule log ratios, written as a
column expression; kept documents have at least ``threshold``.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words: all counts 0, base_failed.
Repeated rows and ids get one result row each; null ids pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: EM ends when no probability changes by more; an error after so many rounds.
TOLERANCE, MOST_ROUNDS = 1e-6, 10_000
PSEUDO = 20.0
#: A word that holds a symbol, up to its first one; tried at word starts only.
_NOISY = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>]"


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' own ratios
    as columns ``_q_*``. Everything stays inside the row: no exchange."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.withColumn("_q_t", t)
    d = d.withColumn("_q_w", F.array_remove(F.split("_q_t", "[\\x20\\x09-\\x0D]+"), ""))
    d = d.withColumn("_q_n", F.size("_q_w"))
    d = d.withColumn("_q_h", F.when(F.col("_q_n") >= 3, F.expr(
        "transform(sequence(0, _q_n - 3), i -> xxhash64(_q_w[i], _q_w[i + 1], _q_w[i + 2]))")))
    # sorted (hash, place) pairs, only where some window comes twice
    d = d.withColumn("_q_s", F.when((F.col("_q_n") > 3) & (F.size("_q_h") > F.size(F.array_distinct("_q_h"))),
                                    F.expr("array_sort(transform(_q_h, (h, i) -> struct(h as h, i as i)))")))
    d = d.withColumn("_q_p", F.expr(
        "array_sort(transform(filter(sequence(0, size(_q_s) - 1), j -> (j > 0 and _q_s[j].h = _q_s[j - 1].h)"
        " or (j < size(_q_s) - 1 and _q_s[j].h = _q_s[j + 1].h)), j -> _q_s[j].i))"))
    d = d.withColumn("_q_lines", F.filter(F.split("_q_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.col("_q_n").cast("long")
    letters = F.length(F.regexp_replace("_q_t", "[^\\p{L}]+", ""))
    return (d.withColumn("n_words", n)
            .withColumn("word_chars", F.length(F.translate("_q_t", " \t\n\x0b\x0c\r", "")).cast("long"))
            .withColumn("n_symbols", (F.length("_q_t") - F.length(F.translate("_q_t", "#*$%&|<>", ""))).cast("long"))
            .withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
            .withColumn("n_repeat_words", F.when(F.col("_q_s").isNotNull(), F.expr(
                "aggregate(_q_p, struct(-3 as last, 0L as n),"
                " (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)")).otherwise(F.lit(0).cast("long")))
            .withColumn("_q_letters", letters)
            .withColumn("_q_upper", F.length(F.regexp_replace("_q_t", "[^\\p{Lu}]+", "")))
            .withColumn("_q_shout", F.length("_q_t") - F.length(F.translate("_q_t", "!", "")))
            .withColumn("_q_nlines", F.size("_q_lines"))
            .withColumn("_q_noisy", F.when(F.col("n_symbols") > 0, F.regexp_count("_q_t", F.lit(_NOISY))).otherwise(F.lit(0)))
            .drop("_q_w", "_q_h", "_q_s", "_q_p", "_q_lines", "_q_t", "_q_n"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The rules' votes over the columns of :func:`base_counts`; a document without words gets
    abstentions only."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    per_word = lambda c: F.col(c) / n
    letters = F.greatest(F.col("_q_letters"), F.lit(1)).cast("double")
    mean = per_word("word_chars")
    some, never = F.col("n_words") > 0, F.lit(False)
    return {k: F.when(some, v).otherwise(F.lit(0)) for k, v in {
        "symbols": _vote(per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.1),
        "noisy_words": _vote(per_word("_q_noisy") <= 0.02, per_word("_q_noisy") > 0.1),
        "letters": _vote(F.col("_q_letters") / F.greatest(F.col("word_chars"), F.lit(1)) >= 0.94,
                         F.col("_q_letters") / F.greatest(F.col("word_chars"), F.lit(1)) < 0.9),
        "size": _vote(F.col("n_words") >= 100, F.col("n_words") < 20),
        "shouting": _vote(never, per_word("_q_shout") > 0.2),
        "capitals": _vote(never, F.col("_q_upper") / letters > 0.5),
        "word_length": _vote(never, (mean < 2.5) | (mean > 7.5)),
        "lines": _vote(never, F.col("n_dup_lines") * 10 > F.col("_q_nlines") * 3),
        "repeats": _vote(never, per_word("n_repeat_words") > 0.2),
    }.items()}


@dataclass(frozen=True)
class RuleModel:
    names: tuple[str, ...]
    prior: float
    good: tuple[dict[int, float], ...]
    bad: tuple[dict[int, float], ...]

    def posterior(self, votes: Column) -> Column:
        """Probability of good, from an array of votes."""
        logit = F.lit(math.log(self.prior) - math.log(1 - self.prior))
        for i, (g, b) in enumerate(zip(self.good, self.bad)):
            ratio = F.lit(math.log(g[0] / b[0]))
            for v in (1, -1):
                ratio = F.when(votes[i] == v, F.lit(math.log(g[v] / b[v]))).otherwise(ratio)
            logit = logit + ratio
        return 1 / (1 + F.exp(-logit))


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], names: tuple[str, ...], tolerance: float = TOLERANCE,
              most_rounds: int = MOST_ROUNDS) -> RuleModel:
    """EM over ``(votes, documents)`` patterns, until nothing changes by more than ``tolerance``. No pattern: the starting
    model."""
    # start: rules are right three times out of four when they vote, most documents are good
    good = [{1: 0.6, 0: 0.2, -1: 0.2} for _ in names]
    bad = [{1: 0.2, 0: 0.2, -1: 0.6} for _ in names]
    first_good, first_bad, prior = [dict(x) for x in good], [dict(x) for x in bad], 0.8
    total = sum(n for _, n in patterns)
    change = math.inf if total else 0.0
    for _ in range(most_rounds):
        if change <= tolerance:
            break
        on_good = [{v: PSEUDO * x for v, x in g.items()} for g in first_good]
        on_bad = [{v: PSEUDO * x for v, x in b.items()} for b in first_bad]
        mass = 0.0
        for votes, n in patterns:
            logit = math.log(prior / (1 - prior)) + sum(
                math.log(g[v] / b[v]) for g, b, v in zip(good, bad, votes))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))
            mass += n * p
            for i, v in enumerate(votes):
                on_good[i][v] += n * p
                on_bad[i][v] += n * (1 - p)
        was = [*good, *bad, {0: prior}]
        good = [{v: x / sum(g.values()) for v, x in g.items()} for g in on_good]
        bad = [{v: x / sum(b.values()) for v, x in b.items()} for b in on_bad]
        prior = (mass + 0.8 * PSEUDO) / (total + PSEUDO)
        change = max(abs(x[v] - old[v]) for x, old in zip([*good, *bad, {0: prior}], was) for v in x)
    else:
        raise RuntimeError(f"no convergence to {tolerance} in {most_rounds} rounds")
    return RuleModel(names, prior, tuple(good), tuple(bad))


def votes_array() -> Column:
    return F.array(*rules().values())


def fit_on(voted: DataFrame, votes: str = "votes") -> RuleModel:
    """Fit on a DataFrame with a votes column; the driver gets one row a pattern (3 ** rules at most)."""
    rows = voted.groupBy(votes).agg(F.count(F.lit(1)).alias("_n")).orderBy(votes).collect()
    return fit_rules([(tuple(r[votes]), r["_n"]) for r in rows], tuple(rules()))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, votes, p_good, kept."""
    from .common import stored

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = base_counts(src).withColumn("votes", votes_array())
    voted = stored(counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                  base_failed().alias("base_failed"), "votes"), "quality-votes")
    model = fit_on(voted)
    p = voted.withColumn("p_good", model.posterior(F.col("votes")))
    return p.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they had. The rows are stored once with their votes,
    which the fit and the verdict both read."""
    from .common import stored

    names = docs.columns
    mine = [f"_d{i}" for i in range(len(names))]
    voted = stored(base_counts(docs.toDF(*mine), mine[names.index(text_col)]).select(
        *mine, base_failed().alias("_q_failed"), votes_array().alias("_q_votes")), "quality-voted")
    model = fit_on(voted, "_q_votes")
    good = voted.filter(~F.col("_q_failed") & (model.posterior(F.col("_q_votes")) >= threshold))
    return good.select(*mine).toDF(*names)
