"""Sentiment rules as column expressions, and the hook for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NEGATIVE_WORDS, POSITIVE_WORDS, SENTIMENT_VALUES
from .text import collapse, is_metadata, is_number, keyword_hits, let, strip, truncated


def hint_key(hint: Column) -> Column:
    """A known hint in lower case; neutral for any other."""
    own = F.lower(strip(F.coalesce(hint, F.lit("neutral"))))
    return F.when(own.isin(*SENTIMENT_VALUES), own).otherwise("neutral")


def hint_value(key: Column) -> Column:
    return F.when(key == "positive", 1.0).when(key == "negative", -1.0).otherwise(0.0)


def lexicon_score(text: Column, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS, step: float = 0.12) -> Column:
    """0.05 to 0.95: a step from 0.5 for every word of either list that the text holds."""
    own = F.lower(collapse(F.coalesce(text, F.lit(""))))
    raw = lambda t: 0.5 + keyword_hits(t, positive) * step - keyword_hits(t, negative) * step
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), let(own, raw)))


def lexicon_result(score: Column) -> Column:
    """The lexicon as a model: label, and its confidence."""
    label = F.when(score >= 0.6, "POSITIVE").when(score <= 0.4, "NEGATIVE").otherwise("NEUTRAL")
    return F.struct(label.alias("label"), F.when(score >= 0.6, score).when(score <= 0.4, 1 - score).otherwise(0.5 + F.abs(score - 0.5)).alias("score"))


def _cuts(score: Column) -> Column:
    return F.struct(label_of(score).alias("label"), F.when(score >= 0.6, score).when(score <= 0.4, 1 - score).otherwise(F.lit(0.5)).alias("score"))


def normalised(label: Column, score: Column, stars: bool = False) -> Column:
    """A model's label and score as positive, neutral or negative and 0 to 1. Positive names are tried first.

    An unknown label with a low score counts as negative with the reversed score, as models have it."""
    own = F.upper(F.coalesce(label, F.lit("")))
    if stars:
        out = _cuts(score)
        for n, word, what, value in ((1, "ONE", "negative", 0.1), (2, "TWO", "negative", 0.3), (3, "THREE", "neutral", 0.5), (4, "FOUR", "positive", 0.7), (5, "FIVE", "positive", 0.9)):
            out = F.when(own.contains(str(n)) | own.contains(word), F.struct(F.lit(what).alias("label"), F.lit(value).alias("score"))).otherwise(out)
        return out
    yes, no = own.rlike("1|POS|긍정"), own.rlike("0|NEG|부정")
    told = lambda what, value: F.struct(F.lit(what).alias("label"), value.alias("score"))
    return F.when(yes, told("positive", score)).when(no, told("negative", 1 - score)).otherwise(_cuts(score))


def rating_score(rating: Column) -> Column:
    return F.when(rating >= 4, 0.9).when(rating >= 3, 0.5).when(rating.isNotNull(), 0.1)


def label_of(score: Column) -> Column:
    return F.when(score >= 0.6, "positive").when(score <= 0.4, "negative").otherwise("neutral")


def routed(text: Column, model: Callable[[Column], Column], rating: Column | None = None) -> Column:
    """Numbers by the rating rule, headings by the rating (else 0.5), other text by the model, cut to length."""
    known = rating_score(rating) if rating is not None else F.lit(None).cast("double")
    number = rating_score(strip(text).try_cast("double"))
    return F.when(is_number(text), number).when(is_metadata(text), F.coalesce(known, F.lit(0.5))).otherwise(let(truncated(text), model))


def model_udf(load: Callable[[], Callable[[list[str]], list[float]]]):
    """An Arrow function from text to score; the model is loaded once per task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    return score
