"""Statistics over place metrics."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def correlations(rows: DataFrame, columns: list[str], missing: float | None = None, least: int = 10, complete: str = "pairwise") -> DataFrame:
    """Pearson's r of every pair, over rows in which both are known; null for `least` rows or fewer.

    `missing` is a value that stands for not known; complete="all" asks for all columns to be known.
    One pass: every pair is an aggregate of the same scan."""
    known = lambda c: F.col(c) if missing is None else F.nullif(F.col(c), F.lit(missing))
    if complete == "all":
        rows = rows.where(sum((known(c).isNull().cast("int") for c in columns), F.lit(0)) == 0)
    pairs = list(combinations(columns, 2))
    both = lambda a, b: known(a).isNotNull() & known(b).isNotNull()
    sums = rows.agg(*(x for i, (a, b) in enumerate(pairs) for x in (F.count_if(both(a, b)).alias(f"n{i}"), F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"r{i}"))))
    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.when(F.col(f"n{i}") > least, F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs)))
    out = sums.select(F.explode(listed).alias("p")).select("p.*")
    return out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def t_tail(t: float, freedom: float) -> float:
    """Two-sided probability of a larger t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x in (0.0, 1.0):
        return x
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # From the last term back: 1 + d1/(1 + d2/(1 + ...)).
    value = 1.0
    for n in range(400, 0, -1):
        m = n // 2
        term = m * (b - m) * x / ((a + n - 1) * (a + n)) if n % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + n - 1) * (a + n))
        value = 1 + term / value
    share = front / value
    return 1 - share if turned else share


@F.pandas_udf(DoubleType())
def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation's t over n rows; a row per pair of columns, not of the data."""
    return pd.Series([None if pd.isna(x) or k <= 2 else 0.0 if math.isinf(x) else t_tail(x, k - 2) for x, k in zip(t, n, strict=True)], dtype="float64")


def trend(rows: DataFrame, y: str, x: str) -> DataFrame:
    return rows.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_count(F.col(y), F.col(x)).alias("n"))


#: Values of one search that are ordered in one task, and the size and error of the sketches that lead there.
ORDERED, SKETCH, ERROR = 1 << 16, 1024, 0.008


class _Search:
    """The value of one rank of a column: it lies between low and high, neither included, where `inside` values are, after `below` others."""

    def __init__(self, column: int, rank: int, n: int, sketch: bytes):
        self.column, self.rank, self.sketch, self.error = column, rank, sketch, ERROR
        self.low, self.high, self.below, self.inside, self.value = -math.inf, math.inf, 0, n, None

    @property
    def done(self) -> bool:
        return self.value is not None or self.inside <= ORDERED

    def within(self, low: float, high: float) -> Column:
        v = F.col(f"c{self.column}")
        # Infinite values lie within infinite ends.
        return F.when(v.isNotNull() & ((v > low) | F.lit(low == -math.inf)) & ((v < high) | F.lit(high == math.inf)), v)

    def ends(self) -> list[Column]:
        """The two values of the sketch between which the rank lies but for chance."""
        at = (self.rank + 0.5 - self.below) / self.inside
        return [F.kll_sketch_get_quantile_double(F.lit(self.sketch), F.lit(min(1.0, max(0.0, r)))) for r in (at - self.error, at + self.error)]

    def counted(self, low: float, high: float, less: list[int], sketch: bytes) -> None:
        """less: how many values are less than low, at most low, less than high, at most high."""
        if less[0] <= self.rank < less[1]:
            self.value = low
        elif less[2] <= self.rank < less[3]:
            self.value = high
        elif less[1] <= self.rank < less[2]:
            self.low, self.high, self.below, self.inside, self.sketch, self.error = low, high, less[1], less[2] - less[1], sketch, ERROR
        elif self.error >= 1:
            raise ArithmeticError("a sketch does not hold the values it was made of")
        else:
            self.error *= 4


def quantiles(rows: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(metric, share, value): the exact quantiles of columns, linear between two values; null and NaN do not count.

    Two passes for all columns and shares together, more for tables beyond some millions of rows: the first makes a
    mergeable sketch (KLL) of every column, which tells two values between which each rank lies; the second counts
    exactly how many values are less than these, and sketches those between. Where more than `ORDERED` are between, they
    are parted again by that sketch. If a sketch, by chance, has missed a rank, the exact counts show it, and it is asked
    for a wider part. At last the values between are summed up by value and that of the rank is taken, so
    that no task holds more than `ORDERED` of them and nothing grows with the rows, however many are alike."""
    spark = rows.sparkSession
    own = rows.select(*(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(columns)))
    sketch = lambda v: F.kll_sketch_agg_double(v, F.lit(SKETCH))
    told = own.agg(*(x for i in range(len(columns)) for x in (F.count(f"c{i}").alias(f"n{i}"), sketch(F.col(f"c{i}")).alias(f"s{i}")))).first()
    ranks = [(i, p, p * (told[f"n{i}"] - 1)) for i in range(len(columns)) for p in shares if told[f"n{i}"]]
    wanted = {(i, f(at)) for i, _, at in ranks for f in (math.floor, math.ceil)}
    searches = {(i, k): _Search(i, k, told[f"n{i}"], bytes(told[f"s{i}"])) for i, k in sorted(wanted)}
    while open_ := [x for x in searches.values() if not x.done]:
        ends = spark.range(1).select(*(e.alias(f"e{n}{side}") for n, x in enumerate(open_) for side, e in zip("ab", x.ends(), strict=True))).first()
        cuts = [(x, ends[f"e{n}a"], ends[f"e{n}b"]) for n, x in enumerate(open_)]
        less = lambda x, low, high: [F.col(f"c{x.column}") < low, F.col(f"c{x.column}") <= low, F.col(f"c{x.column}") < high, F.col(f"c{x.column}") <= high]
        sums = own.agg(*(y for n, cut in enumerate(cuts) for y in (*(F.count_if(c).alias(f"l{n}{m}") for m, c in enumerate(less(*cut))), sketch(cut[0].within(*cut[1:])).alias(f"s{n}")))).first()
        for n, (x, low, high) in enumerate(cuts):
            x.counted(low, high, [sums[f"l{n}{m}"] for m in range(4)], bytes(sums[f"s{n}"] or b""))
    left = [x for x in searches.values() if x.value is None]
    known = [(x.column, x.rank, x.value) for x in searches.values() if x.value is not None]
    values = spark.createDataFrame(known, "column int, rank long, value double")
    if left:
        keys = F.array(*(F.when(x.within(x.low, x.high).isNotNull(), F.struct(F.lit(n).alias("key"), F.col(f"c{x.column}").alias("v"))) for n, x in enumerate(left)))
        counts = own.select(F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("x")).groupBy("x.key", "x.v").agg(F.count(F.lit(1)).alias("own"))
        # A row per rank asked for is broadcast.
        names = spark.createDataFrame([(n, x.column, x.rank, x.below) for n, x in enumerate(left)], "key int, column int, rank long, below long")
        upto = F.sum("own").over(Window.partitionBy("key").orderBy("v"))
        placed = counts.withColumn("upto", upto).join(F.broadcast(names), "key").where(F.col("upto") + F.col("below") > F.col("rank"))
        values = values.unionByName(placed.groupBy("column", "rank").agg(F.min("v").alias("value")))
    asked = spark.createDataFrame([(i, columns[i], float(p), math.floor(at), math.ceil(at), at - math.floor(at)) for i, p, at in ranks], "column int, metric string, share double, first long, last long, part double")
    side = lambda k, v: values.select("column", F.col("rank").alias(k), F.col("value").alias(v))
    both = asked.join(side("first", "a"), ["column", "first"]).join(side("last", "b"), ["column", "last"])
    return both.select("metric", "share", F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def quantile_bins(rows: DataFrame, by: str, value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Mean of a value in the lower, middle and upper part by quantiles of another."""
    told = quantiles(rows, [by], [low, high])
    cuts = told.agg(F.max(F.when(F.col("share") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("share") == high, F.col("value"))).alias("high"))
    named = F.when(F.col(by) <= F.col("low"), "low").when(F.col(by) <= F.col("high"), "middle").otherwise("high")
    # One row of two numbers.
    return rows.join(F.broadcast(cuts)).where(F.col(by).isNotNull()).groupBy(named.alias("bin")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, least, quartiles and largest of every column, a row each."""
    sums = (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    made = rows.agg(*(f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in sums))
    listed = F.array(*(F.struct(F.lit(c).alias("metric"), *(F.col(f"{n}_{i}").alias(n) for n, _ in sums)) for i, c in enumerate(columns)))
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    told = quantiles(rows, columns, list(shares.values())).groupBy("metric").agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in shares.items()))
    both = made.select(F.explode(listed).alias("m")).select("m.*").join(F.broadcast(told), "metric", "left")
    return both.select("metric", "count", "mean", "std", "min", *shares, "max")
