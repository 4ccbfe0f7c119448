"""Exact duplicates through a sharded cuckoo-filter index of live content digests.

Every row is reduced to the SHA-256 of its normalised text. Digests are dealt to shards by their
leading bits. A shard keeps a cuckoo filter of 16-bit tags with the full digest stored beside each
tag; a tag that answers "maybe" is verified against the stored digests of its two buckets. Digests can
be deleted, and a failed insertion doubles the table from the stored keys.

Rows of a digest are merged within each input partition first, so a digest that a third of all rows
share reaches its shard as one row per partition.

Nulls: a null text is an empty one; a null id sorts last and comes back as null. Empty texts form one
group. Of rows alike in text, length and id, nulls included, one stays. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_of, key_of, small_batches, splits, text_of, tidy, written

SLOTS = 4
KICKS = 200
DROP = b"\x20\x09\x0a\x0b\x0c\x0d"


class CuckooIndex:
    """Cuckoo filter over 32-byte digests that keeps the digests, each with a value, beside their tags."""

    def __init__(self, buckets: int = 64):
        self.n = buckets
        self.tags = [[] for _ in range(buckets)]
        self.kept: list[list] = [[] for _ in range(buckets)]
        self.size = 0
        self.resizes = 0

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & (self.n - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & (self.n - 1)

    def get(self, digest: bytes) -> list | None:
        """The entry [digest, value] if the digest is live; the filter answers first, stored keys confirm."""
        tag, a, b = self._place(digest)
        for bucket in (a, b):
            if tag in self.tags[bucket]:
                for entry in self.kept[bucket]:
                    if entry[0] == digest:
                        return entry
        return None

    def insert(self, digest: bytes, value: object) -> list:
        """Add a digest that is not live yet."""
        entry = [digest, value]
        left = self._try(entry)
        while left is not None:  # the entry without a place is the last that was moved
            self._grow()
            left = self._try(left)
        self.size += 1
        return entry

    def _try(self, entry: list) -> list | None:
        tag, a, b = self._place(entry[0])
        for bucket in (a, b):
            if len(self.tags[bucket]) < SLOTS:
                self.tags[bucket].append(tag)
                self.kept[bucket].append(entry)
                return None
        bucket = b
        for kick in range(KICKS):
            slot = (kick + tag) % SLOTS
            tag, self.tags[bucket][slot] = self.tags[bucket][slot], tag
            entry, self.kept[bucket][slot] = self.kept[bucket][slot], entry
            bucket = self._other(bucket, tag)
            if len(self.tags[bucket]) < SLOTS:
                self.tags[bucket].append(tag)
                self.kept[bucket].append(entry)
                return None
        return entry

    def _grow(self) -> None:
        old = [e for bucket in self.kept for e in bucket]
        n = self.n
        done = False
        while not done:
            n *= 2
            self.n, self.resizes = n, self.resizes + 1
            self.tags = [[] for _ in range(n)]
            self.kept = [[] for _ in range(n)]
            done = all(self._try(e) is None for e in old)

    def delete(self, digest: bytes) -> bool:
        tag, a, b = self._place(digest)
        for bucket in (a, b):
            for slot, entry in enumerate(self.kept[bucket]):
                if entry[0] == digest:
                    del self.kept[bucket][slot], self.tags[bucket][slot]
                    self.size -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        for bucket in self.kept:
            yield from bucket


def content_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row long, key long, n_chars long, digest binary) of every row; row tells rows of one id apart."""
    small_batches(docs.sparkSession)

    def digests(b: pa.RecordBatch) -> dict:
        texts = b.column("text").to_pylist()
        return {
            "row": b.column("row"),
            "key": b.column("key"),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "digest": pa.array([hashlib.sha256(t.encode().translate(None, DROP)).digest() for t in texts], pa.binary()),
        }

    rows = docs.select(F.monotonically_increasing_id().alias("row"), key_of(id_col).alias("key"), text_of(text_col).alias("text"))
    return arrow_map(rows, digests, "row long, key long, n_chars long, digest binary")


def _shard_of(digest: bytes, shards: int) -> int:
    return int.from_bytes(digest[:6], "big") % shards


def _better(a: tuple, b: tuple) -> bool:
    """Whether row a (n_chars, key, row) stays rather than b."""
    return (-a[0], *a[1:]) < (-b[0], *b[1:])


def _merged(rows: DataFrame, shards: int, flush: int = 200_000) -> DataFrame:
    """One row for each digest of an input partition: shard, digest, the best row and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(best: dict) -> pa.RecordBatch:
            made = {"shard": pa.array([_shard_of(d, shards) for d in best], pa.int32()), "digest": pa.array(list(best), pa.binary())}
            return pa.RecordBatch.from_pydict(made | {c: pa.array([v[i] for v in best.values()], pa.int64()) for i, c in enumerate(("n_chars", "key", "row", "n"))})

        best: dict = {}
        for b in batches:
            for row, key, n_chars, digest in zip(*(b.column(c).to_pylist() for c in ("row", "key", "n_chars", "digest")), strict=True):
                old = best.get(digest)
                new = (n_chars, key, row)
                if old is None:
                    best[digest] = [*new, 1]
                else:
                    old[3] += 1
                    if _better(new, tuple(old[:3])):
                        old[:3] = new
            if len(best) > flush:
                yield out(best)
                best = {}
        if best:
            yield out(best)

    return rows.mapInArrow(tidy(run), "shard int, digest binary, n_chars long, key long, row long, n long")


def _merge(index: CuckooIndex, digest: bytes, new: tuple, n: int) -> None:
    """Insert n rows of a digest, of which the best is new; a verified hit merges into the live entry."""
    hit = index.get(digest)
    if hit is None:
        index.insert(digest, [*new, n])
    else:
        hit[1][3] += n
        if _better(new, tuple(hit[1][:3])):
            hit[1][:3] = new


def _live(index: CuckooIndex) -> pa.Table:
    live = list(index.entries())
    columns = {c: pa.array([e[1][i] for e in live], pa.int64()) for i, c in enumerate(("n_chars", "keep_key", "keep_row", "group_size"))}
    return pa.table({"digest": pa.array([e[0] for e in live], pa.binary()), **columns})


def _index_shard(table: pa.Table) -> pa.Table:
    index = CuckooIndex()
    for digest, n_chars, key, row, n in zip(*(table.column(c).to_pylist() for c in ("digest", "n_chars", "key", "row", "n")), strict=True):
        _merge(index, digest, (n_chars, key, row), n)
    return _live(index)


def shards_for(rows: int, per_shard: int = 20_000) -> int:
    return max(64, -(-rows // per_shard))


INDEX = "digest binary, n_chars long, keep_key long, keep_row long, group_size long"


def build_index(digests: DataFrame, shards: int) -> DataFrame:
    """Live digests of a corpus: digest, n_chars, keep_key (most code points, then smallest id), keep_row, group_size."""
    return _merged(digests, shards).groupBy("shard").applyInArrow(_index_shard, INDEX)


def update_index(index: DataFrame, stored: DataFrame, inserts: DataFrame, deletes: DataFrame, shards: int) -> DataFrame:
    """The index after rows of `deletes` left and those of `inserts` came in, as if it were built anew.

    stored, inserts: rows as `content_digests` gives them; stored are those the index was built from, and
    rows are told by `row`, which inserts must not share with them. deletes: row and digest of stored rows;
    others are ignored. A digest leaves the filter with its last row. Where a digest's best row leaves, the
    next best is looked up among the stored rows of that digest alone."""
    gone = deletes.select("row", "digest").distinct().join(stored.select("row", "digest"), ["row", "digest"], "left_semi")
    fewer = gone.groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))
    headless = gone.join(index.select("digest", F.col("keep_row").alias("row")), ["row", "digest"], "left_semi").select("digest")
    rest = stored.join(headless, "digest", "left_semi").join(gone, ["row", "digest"], "left_anti")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), "key", "row")).alias("best")
    heads = rest.groupBy("digest").agg(best)
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")
    row = lambda df, what, n_chars, key, row, n: df.select(shard, "digest", n_chars.alias("n_chars"), key.alias("key"), row.alias("row"), n.alias("n"), F.lit(what).alias("what"))
    live = row(index, 0, F.col("n_chars"), F.col("keep_key"), F.col("keep_row"), F.col("group_size"))
    left = row(fewer.join(heads, "digest", "left"), 1, -F.col("best.less"), F.col("best.key"), F.col("best.row"), F.col("fewer"))
    come = _merged(inserts, shards).withColumn("what", F.lit(2)).select("shard", "digest", "n_chars", "key", "row", "n", "what")

    def apply(table: pa.Table) -> pa.Table:
        own = CuckooIndex()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("what", "digest", "n_chars", "key", "row", "n")), strict=True))
        for what, digest, n_chars, key, at, n in sorted(rows, key=lambda r: r[0]):
            if what != 1:
                _merge(own, digest, (n_chars, key, at), n)
            elif hit := own.get(digest):
                hit[1][3] -= n
                if hit[1][3] <= 0:
                    own.delete(digest)
                elif key is not None:
                    hit[1][:3] = n_chars, key, at
        return _live(own)

    return live.unionByName(left).unionByName(come).groupBy("shard").applyInArrow(apply, INDEX)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, digest, keep_id, group_size, kept."""
    digests = written(content_digests(docs, id_col, text_col), "digests")
    groups = build_index(digests, shards_for(digests.count())).where("group_size > 1").select("digest", "keep_key", "keep_row", "group_size")
    # Both sides of the join are scans, so a digest with very many rows can be split at run time.
    both = digests.join(written(groups, "groups", splits(digests)), "digest", "left")
    keep = F.coalesce("keep_key", "key")
    kept = F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True))
    return both.select(id_of("key").alias("doc_id"), "n_chars", "digest", id_of(keep).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))
