"""Similarity scoring: sentence vectors and sentiment to factor scores, weights, Mu, Sigma and deviants.

`sentences` has place, review, sentence, embedding and sentiment; `anchors` has factor, factor_order and
embedding, a row per factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEVIATION, LEGACY_MERGES, LEGACY_RENAMES, NEUTRAL
from ..functions.vectors import added_counts, gram_counts

#: Bytes of anchors that tasks are given at a time; more are given block after block, each with a pass over the sentences.
BLOCK_BYTES = 64 << 20
#: Rows and anchors of one matrix product.
TILE = 1024


def similarities(sentences: DataFrame, anchors: DataFrame, cut: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every sentence with every factor, or with those whose similarity is `cut` or more.

    A product of matrices: the sentences of an Arrow batch with a block of anchors, both at length 1, so that no
    pair below the cut is ever a row. Anchors are a stated set of any size, read in blocks of bounded bytes. A vector
    of zeros, a missing one or one of another length than the anchor's has no similarity (null, under any cut)."""
    spark, keys = sentences.sparkSession, ["place", "review", "sentence", "sentiment"]
    own = anchors.select("factor", "factor_order", "embedding")
    size = own.agg(F.coalesce(F.sum(8 * F.coalesce(F.size("embedding"), F.lit(0)) + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    kinds = {f.name: f.dataType.simpleString() for f in [*sentences.schema, *anchors.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "factor", "factor_order"]) + ", similarity double"
    out = None
    for i in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("factor", "factor_order"), F.lit(blocks)) == i)
        given = spark.sparkContext.broadcast([(r.factor, r.factor_order, _unit(r.embedding)) for r in part.collect()])
        found = sentences.select(*keys, "embedding").mapInArrow(_products(given, cut, pa.int64() if kinds["factor_order"] == "bigint" else pa.int32()), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _unit(v: list | None) -> np.ndarray | None:
    """The vector at length 1; none of a vector without a length."""
    if v is None or None in v:
        return None
    own = np.array(v, np.float64)
    length = np.sqrt(own @ own)
    return own / length if length else None


def _products(given, cut: float | None, order_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, list[int]] = {}
        for i, (_, _, v) in enumerate(given.value):
            sizes.setdefault(-1 if v is None else len(v), []).append(i)
        factor, order = ([a[k] for a in given.value] for k in (0, 1))
        tables = {n: np.stack([given.value[i][2] for i in at]) for n, at in sizes.items() if n >= 0}
        for b in batches:
            for low in range(0, b.num_rows, TILE):
                own = b.slice(low, TILE)
                vectors = own.column("embedding")
                lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                for n, at in sizes.items():
                    alike = np.flatnonzero(lengths == n) if n >= 0 else np.empty(0, np.int64)
                    flat = vectors.take(pa.array(alike)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(alike), max(n, 0))
                    norm = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
                    flat = np.divide(flat, norm, out=np.full_like(flat, np.nan), where=norm > 0)
                    for first in range(0, len(at), TILE):
                        told = np.full((own.num_rows, len(at[first : first + TILE])), np.nan)
                        if n >= 0:
                            told[alike] = flat @ tables[n][first : first + TILE].T
                        row, column = np.nonzero(told >= cut) if cut is not None else np.indices(told.shape).reshape(2, -1)
                        if len(row):
                            value, chosen = told[row, column], [at[first + c] for c in column.tolist()]
                            columns = [own.column(k).take(pa.array(row)) for k in range(4)]
                            names = [pa.array([factor[c] for c in chosen], pa.string()), pa.array([order[c] for c in chosen], order_type)]
                            yield pa.RecordBatch.from_arrays([*columns, *names, pa.array(value, mask=np.isnan(value))], ["place", "review", "sentence", "sentiment", "factor", "factor_order", "similarity"])

    return run


def review_scores(found: DataFrame) -> DataFrame:
    """Per review and factor: mean sentence sentiment and the largest similarity."""
    return found.groupBy("place", "review", "factor", "factor_order").agg(F.avg("sentiment").alias("review_score"), F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("sentences"))


def fsi(by_review: DataFrame, grid: DataFrame) -> DataFrame:
    """Per place and factor of the grid: the mean over reviews, neutral without any, and the reviews."""
    sums = by_review.groupBy("place", "factor").agg(F.avg("review_score").alias("fsi"), F.count(F.lit(1)).alias("n"))
    return grid.join(sums, ["place", "factor"], "left").withColumn("fsi", F.coalesce("fsi", F.lit(NEUTRAL))).withColumn("n", F.coalesce("n", F.lit(0)))


def weights(scores: DataFrame) -> DataFrame:
    """weight: the factor's share of the place's reviews, 0 without any."""
    return scores.withColumn("weight", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("place"))), F.lit(0.0)))


def mu_sigma(weighted: DataFrame) -> DataFrame:
    """Per place: the weighted mean, and the population deviation over all factors, neutral ones too."""
    return weighted.groupBy("place").agg(*_moments())


def _moments() -> list[Column]:
    return [F.sum(F.col("weight") * F.col("fsi")).alias("mu"), F.stddev_pop("fsi").alias("sigma")]


def deviants(weighted: DataFrame, cut: float = DEVIATION, slack: float = 1e-9) -> DataFrame:
    """Per place: mu, sigma, and the mentioned factors far above and below mu, in factor order."""
    own = Window.partitionBy("place")
    told = weighted.withColumn("mu", F.sum(F.col("weight") * F.col("fsi")).over(own))
    strong = (F.col("n") > 0) & (F.col("fsi") >= F.col("mu") + cut - slack)
    weak = (F.col("n") > 0) & (F.col("fsi") <= F.col("mu") - cut + slack)
    named = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("factor_order", "factor")))), lambda x: x["factor"]), ", ")
    return told.groupBy("place").agg(F.first("mu").alias("mu"), F.stddev_pop("fsi").alias("sigma"), named(strong).alias("strong"), named(weak).alias("weak"))


def summary(mu, sigma, strong, weak):
    """The line that a reader sees: [mu ± sigma, +strong, -weak]."""
    return F.format_string("[%.3f ± %.3f, +%s, -%s]", mu, sigma, strong, weak)


def wide(weighted: DataFrame, names: list[str]) -> DataFrame:
    """One row a place: fsi, n and weight of every factor, by column, and mu and sigma; one aggregation."""
    own = [F.max(F.when(F.col("factor") == f, F.col(c))).alias(f"{f}_{c}") for f in names for c in ("fsi", "n", "weight")]
    return weighted.groupBy("place").agg(*own, *_moments())


def current_factors(scores: DataFrame, renames: dict = LEGACY_RENAMES, merges: dict = LEGACY_MERGES) -> DataFrame:
    """Scores under today's factor names: renamed ones, and merged ones by mean score, summed counts and
    summed weights of at most 1."""
    old = {**renames, **{o: new for new, many in merges.items() for o in many}}
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in old.items() for x in pair)), F.col("factor")), F.col("factor"))
    return scores.withColumn("factor", name).groupBy("place", "factor").agg(F.avg("fsi").alias("fsi"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.least(F.sum(F.coalesce("weight", F.lit(0.0))), F.lit(1.0)).alias("weight"))


def top_reviews(by_review: DataFrame, most: int = 10) -> DataFrame:
    """The most similar reviews of each factor."""
    order = Window.partitionBy("factor").orderBy(F.desc(F.round("similarity", 9)), "place", "review")
    return by_review.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def group_quantile(rows: DataFrame, group: str, column: str, share: float, buckets: int = 4096) -> DataFrame:
    """(group, cut): the exact quantile of each group, linear between two values, as no task holds a group:
    a histogram finds the buckets of the two values, in which equal values are counted first.

    Groups may be many: what is joined is a row, or two, of each, and Spark broadcasts it only while it is small."""
    known = rows.where(F.col(column).isNotNull()).select(group, F.col(column).alias("v"))
    ends = known.groupBy(group).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    spot = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets), F.lit(buckets - 1))).otherwise(0)
    dealt = known.join(ends, group).withColumn("bucket", spot)
    order = Window.partitionBy(group).orderBy("bucket")
    sums = dealt.groupBy(group, "bucket", "n").agg(F.count(F.lit(1)).alias("own")).withColumn("before", F.sum("own").over(order) - F.col("own"))
    at = F.lit(share) * (F.col("n") - 1)
    held = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("own"))
    wanted = sums.where(held(F.floor(at)) | held(F.ceil(at))).select(group, "bucket", "before")
    values = dealt.join(wanted, [group, "bucket"]).groupBy(group, "bucket", "n", "before", "v").agg(F.count(F.lit(1)).alias("own"))
    placed = values.withColumn("before", F.col("before") + F.sum("own").over(Window.partitionBy(group, "bucket").orderBy("v")) - F.col("own"))
    value = lambda k: F.max(F.when(held(k), F.col("v")))
    pair = placed.groupBy(group, "n").agg(value(F.floor(at)).alias("a"), value(F.ceil(at)).alias("b"))
    return pair.select(group, (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("cut"))


def top_share(scores: DataFrame, share: float = 0.9, column: str = "fsi") -> DataFrame:
    """Rows of each factor at or above its quantile; ties stay."""
    cuts = group_quantile(scores, "factor", column, share)
    return scores.join(cuts, "factor").where(F.round(F.col(column), 9) >= F.round("cut", 9))


def compared(text_scores: DataFrame, image_scores: DataFrame) -> DataFrame:
    """Text and image scores of a factor side by side; neutral where one is missing."""
    joined = text_scores.join(image_scores, ["place", "factor"], "left")
    text, image = F.coalesce("fsi", F.lit(NEUTRAL)), F.coalesce("image_score", F.lit(NEUTRAL))
    return joined.select("place", "factor", text.alias("text_score"), image.alias("image_score"), (image - text).alias("difference"))


def audited(scores: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores after corrections (factor, delta, reason), kept within 0.2 and 1, and the log of what changed,
    with two digits as the log is read by people."""
    reason = F.col("reason") if "reason" in corrections.columns else F.lit("")
    known = corrections.select("factor", F.col("delta").try_cast("double").alias("delta"), F.coalesce(reason, F.lit("")).alias("reason")).where("delta is not null")
    joined = scores.join(known, "factor", "left")
    new = F.when(F.col("delta").isNull(), F.col("fsi")).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("fsi") + F.col("delta"))))
    told = joined.withColumn("adjusted", new)
    log = told.where("delta is not null").select("place", "factor", F.round("fsi", 2).alias("original"), F.round("adjusted", 2).alias("adjusted"), F.round("delta", 2).alias("delta"), "reason")
    return told.select("place", "factor", F.col("adjusted").alias("fsi")), log


#: Bits of a key that rows of one block differ in.
BLOCK = 6


def next_cosine(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cosine): how like the counts of character trigrams are of each key's text and the next key's, where any is shared.

    Texts are dealt out in blocks of consecutive keys, the first of a block to the block before too, so that each meets the
    next one where it lies: one shuffle of the texts, no table of their grams. Texts of one key count together."""
    own = rows.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where((F.length("t") >= 3) & F.col("k").isNotNull())
    block = F.shiftright("k", BLOCK)
    first = F.col("k").bitwiseAND(F.lit((1 << BLOCK) - 1)) == 0
    dealt = own.withColumn("block", F.explode(F.when(first, F.array(block, block - 1)).otherwise(F.array(block))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The block, key and counts of the key before, and of the one that is read.
        last = own = None

        def told() -> list[tuple]:
            if last is None or last[0] != own[0] or last[1] + 1 != own[1]:
                return []
            a, b = last[2], own[2]
            at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
            dot = int((a[1] * b[1][at])[b[0][at] == a[0]].sum())
            return [(own[1] - 1, dot, int((a[1] * a[1]).sum()), int((b[1] * b[1]).sum()))] if dot else []

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["k", "dot", "a", "b"])

        for b in batches:
            out = []
            for block, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                counts = gram_counts(t.as_py())
                if own is not None and own[:2] == (block, k):
                    own = (block, k, added_counts(own[2], counts))
                    continue
                if own is not None:
                    out += told()
                last, own = own, (block, k, counts)
            if out:
                yield packed(out)
        if own is not None and (out := told()):
            yield packed(out)

    sums = dealt.select("block", "k", "t").repartition("block").sortWithinPartitions("block", "k").mapInArrow(run, "k long, dot long, a long, b long")
    return sums.select(F.col("k").alias(key), (F.col("dot") / (F.sqrt("a") * F.sqrt("b"))).alias("cosine"))
