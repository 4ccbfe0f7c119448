"""Keyword profiles: TF-IDF over one document per group, and the hybrid with the word's own share."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import STOP_WORDS
from ..sources.kept import written

#: Words of two and more letters, digits or underscores, once in lower case; and what white space parts.
TOKEN, SPACE = re.compile(r"\b\w\w+\b"), re.compile(r"[ \t\n\x0b\f\r]+")
#: Words that a task sends of its own in the first round, and that all tasks are given in the second.
SENT, SURVIVORS = 200_000, 500_000
#: A task sends what it has counted once it holds so many words of groups; rows that it takes out of an Arrow batch at a time.
HELD, TAKEN = 200_000, 256
#: What a counted row is: a word of the vocabulary, the same as written, all words as written, or the rows.
WORD, PLAIN, ALL, ROW = range(4)


def frequent(rows: DataFrame, text: str, stop_words: list[str], features: int) -> DataFrame:
    """(word): words that may be among the `features` most frequent ones of all texts, and surely all that are.

    Each task sends the words that it has met most, `SENT` at most, and the largest count that it has kept back. It holds
    twice as many at most: beyond, it drops the rarer half and adds the largest count dropped to what it keeps back. A
    word's true count is thus between the sum of what was sent and that sum with all that may have been kept back;
    words that cannot reach the last place by sums sent are out. Should words that no task has sent be able to
    reach it, all is done again with more sent."""
    stop, most = frozenset(stop_words), SENT

    def sending(most: int):
        def halved(own: Counter) -> tuple[Counter, int]:
            """The words met most, and the largest count of the others."""
            if len(own) <= most:
                return own, 0
            least = sorted(own.values(), reverse=True)[most]
            kept = Counter({w: n for w, n in own.items() if n > least})
            return kept, least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Counter = Counter()
            back = 0
            for b in batches:
                for t in b.column(0):
                    if t.is_valid:
                        own.update(TOKEN.findall(t.as_py().lower()))
                    if len(own) > 2 * most:
                        own, dropped = halved(own)
                        back += dropped
            for w in stop:
                own.pop(w, None)
            own, dropped = halved(own)
            back += dropped
            sent = [*own.items(), *([("", back)] if back else [])]
            if sent:
                words, counts = zip(*sent, strict=True)
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())})

        return run

    while True:
        sums = written(rows.select(text).mapInArrow(sending(most), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
        # The empty word holds the sum of what was kept back.
        back = sums.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        last = sums.where("word <> ''").orderBy(F.desc("n")).limit(features).agg(F.min("n"), F.count(F.lit(1))).first()
        if not back or (last[1] == features and back < last[0]):
            break
        most *= 16
    least = last[0] - back if last[1] == features else 0
    return sums.where(F.col("word") != "").where(F.col("n") >= least).select("word")


def counted(rows: DataFrame, group: str, text: str, words: DataFrame, plain: bool = False) -> DataFrame:
    """(group, kind, word, n): how often each group has each of these words, and its rows; with `plain` also as
    written, and all words as written."""
    spark, kind = rows.sparkSession, rows.schema[group].dataType.simpleString()
    n = words.count()
    known = spark.sparkContext.broadcast(frozenset(r.word for r in words.collect())) if n <= SURVIVORS else None
    schema = f"g {kind}, kind int, word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = known.value if known else None
        own: dict = defaultdict(Counter)

        def sent(group_type: pa.DataType) -> pa.RecordBatch:
            # Few distinct words are left, so that what is not wanted is sorted out here.
            told = [(g, k, w, n) for (g, k), c in own.items() for w, n in c.items() if k > PLAIN or kept is None or w in kept]
            g, k, w, n = zip(*told, strict=True) if told else ((), (), (), ())
            return pa.RecordBatch.from_pydict({"g": pa.array(g, group_type), "kind": pa.array(k, pa.int32()), "word": pa.array(w, pa.string()), "n": pa.array(n, pa.int64())})

        for whole in batches:
            last = whole.schema.field(0).type
            for at in range(0, whole.num_rows, TAKEN):
                b = whole.slice(at, TAKEN)
                for g, t in zip(b.column(0), b.column(1), strict=True):
                    g, t = g.as_py(), t.as_py()
                    own[g, ROW][""] += 1
                    if t:
                        own[g, WORD].update(TOKEN.findall(t.lower()))
                        if plain:
                            spaced = [w for w in SPACE.split(t) if w]
                            own[g, PLAIN].update(spaced)
                            own[g, ALL][""] += len(spaced)
                if sum(map(len, own.values())) > HELD:
                    yield sent(last)
                    own.clear()
        if own:
            yield sent(last)

    counts = rows.select(F.col(group).alias("g"), text).mapInArrow(run, schema)
    if known is None:
        wanted = F.col("kind") <= PLAIN
        counts = counts.where(~wanted).unionByName(counts.where(wanted).join(words, "word").select("g", "kind", "word", "n"))
    return written(counts.groupBy(F.col("g").alias(group), "kind", "word").agg(F.sum("n").alias("n")), "words")


def _weighed(counts: DataFrame, group: str, features: int) -> DataFrame:
    tf = counts.where(F.col("kind") == WORD).select(group, "word", F.col("n").alias("tf"))
    totals = tf.groupBy("word").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    # At most `features` rows: the bound on what is broadcast.
    chosen = totals.orderBy(F.desc("total"), "word").limit(features)
    groups = counts.where(F.col("kind") == ROW).where(F.col(group).isNotNull()).agg(F.count(F.lit(1)).alias("groups"))
    own = tf.join(F.broadcast(chosen.select("word", "df")), "word").join(F.broadcast(groups))
    raw = own.withColumn("raw", F.col("tf") * (F.log((1 + F.col("groups")) / (1 + F.col("df"))) + 1))
    # At most `features` rows of each group.
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(group)))
    return raw.select(group, "word", "tf", "df", (F.col("raw") / length).alias("tfidf"))


def tfidf(rows: DataFrame, group: str, text: str, stop_words: list[str] = STOP_WORDS, features: int = 1000) -> DataFrame:
    """Per group and word: tf, df, tfidf (smoothed, at length 1 within the group).

    The vocabulary is the `features` words with the highest counts, ties by word. Two rounds find it exactly: what may
    be in it, then counts of that alone, so that a table of all words of all groups is never made."""
    return _weighed(counted(rows, group, text, frequent(rows, text, stop_words, features)), group, features)


def hybrid(rows: DataFrame, group: str, text: str, stop_words: list[str] = STOP_WORDS, features: int = 1000, top: int = 15) -> DataFrame:
    """The best words of each group by tfidf * (1 + 2 * share), the share among all words as written."""
    counts = counted(rows, group, text, frequent(rows, text, stop_words, features), plain=True)
    own = counts.where(F.col("kind") == PLAIN).select(group, "word", "n")
    sums = counts.where(F.col("kind") == ALL).select(group, F.col("n").alias("all"))
    told = _weighed(counts, group, features).join(own, [group, "word"], "left").join(sums, group, "left")
    scored = told.withColumn("share", F.coalesce(F.col("n") / F.col("all"), F.lit(0.0))).withColumn("hybrid", F.col("tfidf") * (1 + 2 * F.col("share")))
    order = Window.partitionBy(group).orderBy(F.desc(F.round("hybrid", 9)), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("n", "all")
