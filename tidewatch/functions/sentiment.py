"""Sentiment (D5, D6, D7 default scorer).

The original scored with a lexicon library and a transformer model, neither available
offline. The built-in scorer is a lexicon sum normalised the published way
(``s / sqrt(s^2 + alpha)``), evaluated per row with a literal map: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import _c, is_blank


def lexicon_pattern() -> str:
    """The lexicon's words, grouped by first letter so that a position is given up after one comparison."""
    groups: dict[str, list[str]] = {}
    for w in sorted({w for w, _ in dims.SENTIMENT_LEXICON}, key=lambda w: (-len(w), w)):
        groups.setdefault(w[0], []).append(w[1:])
    return r"(?<![a-z])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(groups.items())) + r")(?![a-z])"


def lexicon_words(text) -> Column:
    """Words of the text that are in the lexicon (a word = maximal run of a-z after
    lower-casing), in order; one regular expression per row."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(lexicon_pattern()), 0)


def lexicon_sum(text) -> Column:
    lex = dims.lexicon_map_col()
    return F.aggregate(lexicon_words(text), F.lit(0.0),
                       lambda acc, w: acc + F.coalesce(F.try_element_at(lex, w), F.lit(0.0)))


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, however often ``then`` uses it and under any CASE."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalised(s: Column) -> Column:
    """The published form s / sqrt(s^2 + alpha) of a stored or bound sum."""
    return s / F.sqrt(s * s + F.lit(dims.VADER_ALPHA))


def compound(text) -> Column:
    return _once(lexicon_sum(text), normalised)


def label_of(score) -> Column:
    """D5 thresholds: >= cut positive, <= -cut negative, else neutral."""
    c = dims.SENTIMENT_CUTOFF
    return (F.when(_c(score) >= c, "positive").when(_c(score) <= -c, "negative").otherwise("neutral"))


def label_of_sum(text, s: Column) -> Column:
    """D5 from a stored lexicon sum: NULL/'' -> 'neutral'."""
    t = _c(text)
    return F.when(t.isNull() | (t == ""), F.lit("neutral")).otherwise(label_of(normalised(s)))


def sentiment_label(text) -> Column:
    """NULL/'' -> 'neutral'. The text is scanned once."""
    t = _c(text)
    return F.when(t.isNull() | (t == ""), F.lit("neutral")).otherwise(_once(lexicon_sum(t), lambda s: label_of(normalised(s))))


def old_bucket(score, is_burst) -> Column:
    """D6 (older UI): burst first, then strict > 0.2 / < -0.2."""
    c = dims.OLD_BUCKET_CUTOFF
    return (F.when(F.coalesce(_c(is_burst), F.lit(False)), "burst")
            .when(_c(score) > c, "positive").when(_c(score) < -c, "negative").otherwise("neutral"))


def model_sentiment_default(text) -> Column:
    """D7 without a model: blank -> NEUTRAL, else the lexicon label of the whole text,
    upper-cased."""
    return F.when(is_blank(text), F.lit("NEUTRAL")).otherwise(
        F.upper(sentiment_label(text)))
