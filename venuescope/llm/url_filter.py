"""URL filters: rules first, else a character language-model ratio, in DataFrame functions only.

Two variable-order Markov models, one of accepted and one of rejected URLs, are counted from labelled
examples. A character's probability after its context is smoothed by the next shorter context's, down to a
uniform one. A URL's score is the mean over its characters of the log ratio of both models, each taken at the
longest context that was counted.

Labels are an input. Without a label column, URLs whose host holds a seed term are rejected examples; all others
are unlabelled, not accepted. URLs that a rule judges are no examples, as rules go by domain and language and say
nothing of what junk looks like. Unlabelled hosts are dealt to folds by a hash, and each is scored by a model that has
not seen its fold (cross-fitting): the counts of all examples less those of the fold. A first model takes all
unlabelled hosts as accepted; hosts that it scores above 0, though it has not seen them, are taken out, and the second
model is made of the others. That model's scores decide, and its cut is set on the same scores: the highest of the
hosts left in, but for one in a thousand, each host once however many pages it has, and never below 0, where both
models explain a URL equally well. A URL known to be rejected is an example in every fold's model.

A model has at most one row per string of four characters of a 41-letter alphabet (digits count as one
letter), under three million; shorter strings are summed from these, and those seen once in all rows are
pruned. URLs alike in that alphabet are counted together, as often as they occur. For scoring, every string
of four gets its ratios first, so that characters meet a single table; it is broadcast up to `SMALL` rows.

Nulls: a null URL, or one without "://", has an empty host and path and is allowed. A null page id stays
null. Repeated rows are judged alike. Without rejected or without accepted examples everything that no
rule blocks is allowed. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules, host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Seed terms whose hosts serve as rejected examples.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "viagra")
ORDER = 4
HEFT = 2.0
#: Hosts are dealt to so many folds.
FOLDS = 4
#: Rows of a table of ratios that is broadcast; a larger one is joined by a shuffle.
SMALL = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and all that follows the first "://"; empty where there is none."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), rest


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (else null) and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def letters(rest: Column) -> Column:
    """The URL in the models' alphabet, with a start mark."""
    small = F.translate(rest, UPPER, LOWER)
    return F.concat(F.lit("^^^"), F.regexp_replace(F.regexp_replace(small, "[0-9]", "0"), r"[^a-z0./:?=&_\-#%+,~^]", "~"))


def _grams() -> Column:
    """Strings of four characters, one for every character after the start mark."""
    spots = F.sequence(F.lit(ORDER), F.length("letters"))
    return F.when(F.length("letters") >= ORDER, F.transform(spots, lambda i: F.substring(F.col("letters"), i - (ORDER - 1), F.lit(ORDER)))).otherwise(F.array().cast("array<string>"))


def counted(examples: DataFrame) -> DataFrame:
    """(gram, r, a0, a1, ...): how often rejected URLs have a gram, and the accepted ones of each fold.

    examples: letters, rejected (boolean), fold and weight, the number of rows alike."""
    one = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0))
    rows = examples.select("rejected", "fold", "weight", F.explode(_grams()).alias("gram")).groupBy("gram")
    return written(rows.agg(one(F.col("rejected")).alias("r"), *(one(~F.col("rejected") & (F.col("fold") == i)).alias(f"a{i}") for i in range(FOLDS))), "grams")


def train(counts: DataFrame, least: int = 2) -> DataFrame:
    """(gram, ratios): log ratios, rejected over accepted, of a gram's last character after its others; one of each
    fold, by a model that has not counted that fold's accepted URLs."""
    folds, model, shorter = range(FOLDS), None, None
    whole = sum((F.col(f"a{i}") for i in folds), F.lit(0))
    apart = counts.select("gram", "r", *((whole - F.col(f"a{i}")).alias(f"a{i}") for i in folds), (whole + F.col("r")).alias("seen"))
    for k in range(1, ORDER + 1):
        # Every character ends one string of four, so its shorter strings are their ends.
        sums = [F.sum(c).alias(c) for c in ("r", *(f"a{i}" for i in folds))]
        own = apart.groupBy(F.substring("gram", ORDER + 1 - k, k).alias("gram")).agg(*sums, F.sum("seen").alias("seen")).withColumn("context", F.substring("gram", 1, k - 1))
        totals = own.groupBy("context").agg(*(F.sum(c).alias(f"n{c}") for c in ("r", *(f"a{i}" for i in folds))))
        base = own.join(totals, "context")
        if shorter is not None:
            below = shorter.select(F.col("gram").alias("suffix"), *(F.col(f"p{c}").alias(f"q{c}") for c in ("r", *(f"a{i}" for i in folds))))
            base = base.withColumn("suffix", F.substring("gram", 2, k)).join(below, "suffix")
        less = lambda c: F.lit(1 / 41) if shorter is None else F.col(f"q{c}")
        smooth = [((F.col(c) + HEFT * less(c)) / (F.col(f"n{c}") + HEFT)).alias(f"p{c}") for c in ("r", *(f"a{i}" for i in folds))]
        shorter = written(base.select("gram", "seen", *smooth), f"order{k}")
        part = shorter.where(F.col("seen") >= least).select("gram", F.array(*(F.log("pr") - F.log(f"pa{i}") for i in folds)).alias("ratios"))
        model = part if model is None else model.unionByName(part)
    return model


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls (row, letters, fold, ...) with `score`, the mean log ratio over the characters by the fold's model; null for none."""
    keys = [c for c in urls.columns if c != "letters"]
    at = urls.select(*keys, F.explode_outer(_grams()).alias("gram"))
    told = at.where("gram is not null").select("gram").distinct()
    for k in range(ORDER, 0, -1):
        own = model.where(F.length("gram") == k).select(F.col("gram").alias("own"), F.col("ratios").alias(f"r{k}"))
        told = told.withColumn("own", F.substring("gram", ORDER + 1 - k, k)).join(own, "own", "left").drop("own")
    none = F.array_repeat(F.lit(0.0), FOLDS)
    told = written(told.select("gram", F.coalesce(*(f"r{k}" for k in range(ORDER, 0, -1)), none).alias("ratios")), "ratios")
    told = F.broadcast(told) if told.count() <= SMALL else told
    return at.join(told, "gram", "left").groupBy(*keys).agg(F.avg(F.get("ratios", F.col("fold"))).alias("score"))


def agreed(examples: DataFrame, counts: DataFrame) -> DataFrame:
    """The examples without the hosts, taken as accepted, that a model which has not seen them would reject."""
    rows = scored(examples, train(counts))
    doubtful = rows.where("not rejected").groupBy("host").agg(F.sum(F.col("score") * F.col("weight")).alias("s")).where("s > 0").select("host")
    doubtful = written(doubtful, "doubtful").withColumn("rejected", F.lit(False))
    return written(examples.join(doubtful, ["host", "rejected"], "left_anti"), "agreed")


def cut_of(examples: DataFrame, model: DataFrame) -> float:
    """The score above which a URL is rejected: the highest of the accepted hosts, but for one in a thousand, at least 0."""
    hosts = scored(examples.where("not rejected"), model).groupBy("host").agg(F.max("score").alias("top"))
    high = hosts.agg(F.percentile_approx("top", 0.999, 10000)).first()[0]
    return max(0.0, high) if high is not None else float("inf")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, seeds: tuple = SEEDS, rejected_col: str | None = None) -> DataFrame:
    """page_id, host, path, rule, score, verdict of every row.

    rejected_col: a boolean label, null where a URL is no example; by default the hosts with a seed term are rejected."""
    host, path, rest = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), letters(rest).alias("letters"), (F.col(rejected_col) if rejected_col else F.lit(None).cast("boolean")).alias("told"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    seeded = F.col("host").rlike(rf"(^|[.-])({'|'.join(seeds)})([.-]|$)") if seeds else F.lit(False)
    rows = written(rows.withColumn("fold", fold).withColumn("rule", rule).withColumn("ruled", verdict).withColumn("rejected", F.col("told") if rejected_col else seeded).drop("told"), "urls")
    examples = rows.where("rule is null and host <> '' and rejected is not null").groupBy("host", "fold", "letters", "rejected").agg(F.count(F.lit(1)).alias("weight"))
    examples = written(examples, "examples")
    if not rejected_col:
        examples = agreed(examples, counted(examples))
    if examples.where("rejected").isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    model = train(counted(examples))
    cut = cut_of(examples, model)
    known = scored(rows, model)
    own = F.when(F.coalesce("score", F.lit(float("-inf"))) > F.lit(cut), "block").otherwise("allow")
    return known.select("page_id", "host", "path", "rule", "score", F.coalesce("ruled", own).alias("verdict"))
