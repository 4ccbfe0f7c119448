"""Ranked lexical search with MaxScore: every query against all documents, shard by shard.

The documents are read once: of each, its number of terms and the counts of the terms that some query has are
written to the shared folder. Counts of documents, terms and document frequencies are sums over that table. Then
a task indexes its rows in shards (postings by term, each with what it adds to a score) and answers all queries on
each shard. A term's largest addition in the shard is its upper bound. Terms whose bounds sum up to less than the
score to beat are non-essential: documents come only from the postings of the others, and the postings of
non-essential terms are probed, the largest bound first, only while a document's score and the bounds that are left
reach the score to beat. That score is the tenth best so far in the task, kept from shard to shard; the first
shards are small. Equal scores are kept, so ties by document id are exact.

The result needs `most` rows of each task and query; Spark ranks them before and after the shuffle. Queries are
read in blocks of at most `block_bytes` of text, each of which scans the documents once.

Nulls: a null text has no terms and is not counted; a null document id sorts last and comes back as null. Repeated
rows are rows of their own, on either side. A query without terms, or none of whose terms occurs, has no rows. Empty
tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, key_of, small_batches, splits, tidy, written
from .words import blocks, utf8, words

MOST = 10
#: Documents in a task's first shard, and in its largest.
SHARD, LARGEST = 512, 1 << 15
BLOCK_BYTES = 4 << 20
WHOLE = pa.list_(pa.int32())


def counted(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(key, n, terms, tfs) of every document with terms: how many, and how often it has each of the known ones."""
    spark = docs.sparkSession
    small_batches(spark)
    given = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = given.value
        for b in batches:
            keys, ns, held, tfs = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                own = words(text)
                if own:
                    found = [(number[w], n) for w, n in Counter(own).items() if w in number]
                    keys.append(key)
                    ns.append(len(own))
                    held.append(np.array([t for t, _ in found], np.int32))
                    tfs.append(np.array([n for _, n in found], np.int32))
            if keys:
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": pa.array(ns, pa.int64()), "terms": pa.array(held, WHOLE), "tfs": pa.array(tfs, WHOLE)})

    rows = docs.select(key_of(id_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "key long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Postings of one shard: per term its documents, ascending, and what it adds to their scores."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total: int, length: int):
        self.keys = keys
        m = 10 + 90 * n * total // length
        doc = np.repeat(np.arange(len(keys)), sizes)
        adds = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.adds = doc[order], adds[order]
        self.start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        held = np.flatnonzero(np.diff(self.start))
        self.bounds = np.zeros(len(weights), np.int64)
        if len(held):
            self.bounds[held] = np.maximum.reduceat(self.adds, self.start[held])

    def best(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all with a score above 0 and of `least` or more."""
        query = query[np.argsort(self.bounds[query], kind="stable")]
        bounds = self.bounds[query]
        query, bounds = query[bounds > 0], bounds[bounds > 0]
        below = np.cumsum(bounds)
        first = int(np.searchsorted(below, least))  # the terms before it together stay under `least`
        score = np.zeros(len(self.keys), np.int64)
        for t in query[first:]:
            own = slice(self.start[t], self.start[t + 1])
            score[self.docs[own]] += self.adds[own]
        doc = np.flatnonzero(score)
        score = score[doc]
        for i in range(first - 1, -1, -1):
            able = score + below[i] >= least
            doc, score = doc[able], score[able]
            if not len(doc):
                break
            own = slice(self.start[query[i]], self.start[query[i] + 1])
            at = np.searchsorted(self.docs[own], doc)
            at[at == own.stop - own.start] = 0
            score += np.where(self.docs[own][at] == doc, self.adds[own][at], 0)
        able = score >= max(least, 1)
        return doc[able], score[able]


def _answers(queries: list[np.ndarray], weights: np.ndarray, total: int, length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        top = [(none, none) for _ in queries]  # keys and scores of the best so far
        held, rows, size = [], 0, SHARD

        def answer() -> None:
            flat = lambda c, kind: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (b.column(c) for b in held)]).astype(kind)
            column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held])
            sizes = np.concatenate([b.column("terms").value_lengths().to_numpy(zero_copy_only=False) for b in held])
            shard = Shard(column("key"), column("n"), sizes, flat("terms", np.int64), flat("tfs", np.int64), weights, total, length)
            for i, query in enumerate(queries):
                keys, scores = top[i]
                doc, score = shard.best(query, int(scores[-1]) if len(scores) == most else 0)
                if len(doc):
                    keys, scores = np.concatenate([keys, shard.keys[doc]]), np.concatenate([scores, score])
                    order = np.lexsort((keys, -scores))[:most]
                    top[i] = keys[order], scores[order]

        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - rows)
                held.append(part)
                rows += part.num_rows
                b = b.slice(part.num_rows)
                if rows == size:
                    answer()
                    held, rows, size = [], 0, min(2 * size, LARGEST)
        if held:
            answer()
        query = np.repeat(np.arange(len(queries)), [len(k) for k, _ in top])
        if len(query):
            yield pa.RecordBatch.from_pydict({"query": pa.array(query), "key": pa.array(np.concatenate([k for k, _ in top])), "score": pa.array(np.concatenate([s for _, s in top]))})

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, query, rank, doc_id, score): the `most` documents with the highest scores for every row of items.

    query tells rows of items apart that share an id."""
    spark, out, files = docs.sparkSession, [], splits(docs)
    for block in blocks(items, item_col, item_text_col, block_bytes):
        terms: dict[bytes, int] = {}
        # Terms of a query once each, ascending, so that the same query is worked out the same way.
        queries = [np.array(sorted({terms.setdefault(w, len(terms)) for w in words(t.encode() if t else None)}), np.int64) for _, t in block]
        table = written(counted(docs, terms, id_col, text_col), "postings", files)
        sums = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(terms), np.int64)
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the terms of one block of queries
            df[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * sums.n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"query long, item_id {items.schema[item_col].dataType.simpleString()}")
        found = table.mapInArrow(tidy(_answers(queries, weights, sums.n, max(1, sums.terms), most)), "query long, key long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        out.append(best.join(F.broadcast(names), "query").select("item_id", "query", "rank", id_of("key").alias("doc_id"), "score"))
    return reduce(DataFrame.unionByName, out)
