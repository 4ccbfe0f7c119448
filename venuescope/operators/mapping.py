"""Labels of sentences from logged JSON answers: flattening, cleaning, pivoting; and labelling by a hook."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SENTIMENT_VALUES
from ..functions.text import capped, sentences_with_ends, strip

ANSWER = "reviews array<struct<review_index:string,items:array<struct<sentence_id:string,mappings:array<struct<factor:string,confidence:string,evidence:string,reason:string,sentiment_hint:string>>>>>>"


def review_sentences(reviews: DataFrame, key: str = "review_index", text: str = "review_text", most: int = 500) -> DataFrame:
    """A row per sentence with its number from 0; long ones are cut."""
    return reviews.select(key, F.posexplode(sentences_with_ends(F.col(text))).alias("sentence_id", "s")).select(key, F.col("sentence_id").cast("long").alias("sentence_id"), capped(F.col("s"), most).alias("sentence"))


def flattened(lines: DataFrame, sentences: DataFrame, factors: list[str], line: str = "value") -> DataFrame:
    """One row per mapping of every logged line that is JSON: known factors, clamped confidence, known hint.

    Lines that do not parse, unknown reviews and sentence numbers out of range are left out."""
    answers = lines.select(F.from_json(F.col(line), ANSWER).alias("a")).where("a is not null")
    reviews = answers.select(F.explode("a.reviews").alias("r")).select(F.col("r.review_index").try_cast("long").alias("review_index"), F.explode("r.items").alias("i"))
    rows = reviews.select("review_index", F.col("i.sentence_id").try_cast("long").alias("sentence_id"), F.posexplode("i.mappings").alias("nth", "m"))
    hint = F.lower(strip(F.coalesce("m.sentiment_hint", F.lit("neutral"))))
    clean = rows.select(
        "review_index",
        "sentence_id",
        "nth",
        strip(F.col("m.factor")).alias("factor"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("m.confidence").try_cast("double"), F.lit(0.0)))).alias("confidence"),
        strip(F.coalesce("m.evidence", F.lit(""))).alias("evidence"),
        strip(F.coalesce("m.reason", F.lit(""))).alias("reason"),
        F.when(hint.isin(*SENTIMENT_VALUES), hint).otherwise("neutral").alias("sentiment_hint"),
    )
    return clean.where(F.col("factor").isin(factors)).join(sentences, ["review_index", "sentence_id"])


def pivoted(rows: DataFrame, reviews: DataFrame, factors: list[str]) -> DataFrame:
    """Per review and factor: whether mapped, sentences, largest confidence and the different evidence texts."""
    first = rows.groupBy("review_index", "factor", "evidence").agg(F.min(F.struct("sentence_id", "nth")).alias("o"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "evidence"))), lambda x: x["evidence"]), " | ")
    sums = first.groupBy("review_index").pivot("factor", factors).agg(F.sum("n").alias("count"), F.max("c").alias("confidence"), texts.alias("evidence"))
    joined = reviews.join(sums, "review_index", "left")
    out = list(reviews.columns)
    made = [(f, F.coalesce(F.col(f"{f}_count"), F.lit(0))) for f in factors]
    return joined.select(
        *out,
        *((n > 0).alias(f"{f}_mapped") for f, n in made),
        *(n.alias(f"{f}_sentence_count") for f, n in made),
        *(F.coalesce(F.col(f"{f}_confidence"), F.lit(0.0)).alias(f"{f}_max_confidence") for f in factors),
        *(F.coalesce(F.col(f"{f}_evidence"), F.lit("")).alias(f"{f}_evidence") for f in factors),
    )


def image_answer(parsed: DataFrame, factors: list[str]) -> DataFrame:
    """An image model's answer (place, factors map of name to struct of strings) with every factor: score
    0.5, confidence 0.3 and "insufficient" where it is silent; numbers kept within 0 and 1."""
    value = lambda c, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at("factors", F.col("factor"))[c].try_cast("double"), F.lit(d))))
    told = parsed.select("*", F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    unclear = F.coalesce(F.try_element_at("factors", F.col("factor"))["insufficient"].try_cast("boolean"), F.lit(True))
    return told.select("place", "factor", value("score", 0.5).alias("image_score"), value("confidence", 0.3).alias("confidence"), unclear.alias("insufficient"))


def asked(label: Callable[[list[str]], list[str]], texts: list[str], attempts: int, wait: float, most: float, sleep: Callable[[float], None]) -> list[str | None]:
    """The answers of a service that may fail: asked again after a wait that doubles, up to `most` seconds.

    Nulls after the last attempt, or where there are not as many answers as texts: those are left to do."""
    for n in range(attempts):
        try:
            found = label(texts)
            if len(found) == len(texts):
                return list(found)
        except Exception:  # noqa: BLE001 - whatever a service raises
            pass
        if n + 1 < attempts:
            sleep(min(most, wait * 2**n))
    return [None] * len(texts)


def labelled(reviews: DataFrame, label: Callable[[list[str]], list[str]], text: str = "review_text", batch: int = 8, attempts: int = 5, wait: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """reviews and `answer`, the JSON that a labelling service gives for each, asked in batches; null where it
    failed at every attempt, so that one failure does not cost a task's other answers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            answers = [x for i in range(0, len(texts), batch) for x in asked(label, texts[i : i + batch], attempts, wait, most, sleep)]
            yield frame.assign(answer=answers)

    return reviews.mapInPandas(run, reviews.withColumn("answer", F.lit("")).schema)
