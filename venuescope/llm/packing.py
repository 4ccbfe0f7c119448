"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups.

A document's ids end with an end id; a document longer than a sequence is cut at multiples of the
sequence length, before anything is shuffled. Pieces are dealt at random (by a seeded hash of document,
place, ids and a salt) to groups of about `per_group` ids, and each group packs its pieces on its own: the
longest first, each into the first sequence with room. A tournament tree over the room left in the
sequences finds that one in logarithmic time. Groups are dealt by pieces, of at most a sequence each, so
neither a very long document nor a row repeated many times makes a large group.

The number of groups comes from an estimate of all ids: code units of the texts over 3. Where that is
out by a factor, groups are larger or smaller by it and the packing stays right.

Nulls: a null text is an empty one, whose only id is the end id; a null id stays null. Repeated rows are
packed once each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of, tidy

SEQUENCE = 2048
END = 1
#: Texts with other characters than these are tokenised whole. Within these, lower case and white space
#: are the same to Arrow, Python and the tokenizer, and no text holds a special token. U+0130 is the one
#: letter among them whose lower case is two code points. (RE2 syntax.)
ODD = r"[^\x{0}-\x{1b}\x{20}-\x{12f}\x{131}-\x{24f}]|<[|]"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
CACHE_WORDS = 400_000


class WordCache:
    """Tokenises by words and remembers the ids of words; equal to tokenising whole texts."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # The same model for single words that are in lower case already: no pattern, no normalising.
        self.single = Tokenizer(self.whole.model)
        self.single.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.mark = "<|startoftext|>"
        self.mark_id = self.whole.token_to_id(self.mark)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> None:
        at = len(self.starts)
        self.codes.update(zip(words, range(at, at + len(words)), strict=True))
        self.starts = np.r_[self.starts, starts + len(self.flat)]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, ids]

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these codes, one after the other, and where each word's end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)], ends

    def _learn(self, words: list[str]) -> None:
        """Words of letters, and such words with marks after them, go through the short path; others are
        tokenised as they stand, parted by a special token."""
        plain, pairs, rest = set(), [], []
        for w in words:
            if w.isalpha():
                plain.add(w)
            else:
                core = w.rstrip(MARKS)
                if core.isalpha():
                    pairs.append((w, core, w[len(core) :]))
                elif core:
                    rest.append(w)
                else:
                    plain.add(w)
        plain.update(x for _, core, tail in pairs for x in (core, tail))
        fresh = list(plain.difference(self.codes))
        if fresh:
            runs = [" ".join(fresh[i : i + 64]) for i in range(0, len(fresh), 64)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.single.encode_batch_fast(runs, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            starts = np.r_[0, ends[:-1]]
            self._add(fresh, ids, ends - starts, starts)
        pairs = [x for x in pairs if x[0] not in self.codes]
        if pairs:
            ids, ends = self._gather(np.array([self.codes[x] for p in pairs for x in p[1:]]))
            ends = ends[1::2]
            starts = np.r_[0, ends[:-1]]
            self._add([p[0] for p in pairs], ids, ends - starts, starts)
        if rest:
            runs = [self.mark.join(rest[i : i + 64]) for i in range(0, len(rest), 64)]
            ids = np.concatenate([np.array(e.ids + [self.mark_id], np.uint32) for e in self.whole.encode_batch_fast(runs, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.mark_id)
            starts = np.r_[0, ends[:-1] + 1]
            self._add(rest, ids, ends - starts, starts)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.codes) > self.most:
            self._clear()
        known = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        if len(new):
            unseen = [words[i] for i in new]
            self._learn(unseen)
            known[new] = list(map(self.codes.__getitem__, unseen))
        ids, ends = self._gather(known[coded.indices.to_numpy()])
        cuts = np.r_[0, ends][lists.offsets.to_numpy()]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


class RoomTree:
    """Tournament tree over the room left in sequences: the first with enough room, in log time."""

    def __init__(self, sequences: int, room: int):
        self.leaves = 1 << max(0, (sequences - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Place a piece; its sequence and the room that sequence had before."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        had = most[node]
        most[node] = had - size
        found, node = node - self.leaves, node >> 1
        while node:
            top = max(most[2 * node], most[2 * node + 1])
            if most[node] == top:
                break
            most[node] = top
            node >>= 1
        return found, had


def first_fit_decreasing(sizes: list[int], room: int = SEQUENCE) -> list[tuple[int, int]]:
    """(sequence, offset) of every piece; ties in size keep the order of the list."""
    out: list = [None] * len(sizes)
    tree = RoomTree(max(1, len(sizes)), room)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found, had = tree.put(sizes[i])
        out[i] = (found, room - had)
    return out


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, room: int = SEQUENCE) -> DataFrame:
    """Pieces (doc_id, start, doc_tokens, ids) of every document: its ids as little-endian unsigned 32-bit
    numbers, the end id included, cut at multiples of `room`."""
    small_batches(docs.sparkSession, 2000)
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if "cache" not in held:
                held["cache"] = WordCache(path)
            docs, starts, totals, pieces = [], [], [], []
            for doc, own in zip(b.column("doc_id").to_pylist(), held["cache"].encode(b.column("text")), strict=True):
                own = np.append(own, np.uint32(end)).astype("<u4")
                for start in range(0, len(own), room):
                    docs.append(doc)
                    starts.append(start)
                    totals.append(len(own))
                    pieces.append(own[start : start + room].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "doc_tokens": pa.array(totals, pa.int64()), "ids": pa.array(pieces, pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, start long, doc_tokens long, ids binary")


def _packed(room: int):
    def pack(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")}
        order = sorted(range(table.num_rows), key=lambda i: (columns["doc_id"][i] is None, columns["doc_id"][i] or 0, columns["start"][i], columns["ids"][i]))
        doc, start, total, ids = ([columns[c][i] for i in order] for c in ("doc_id", "start", "doc_tokens", "ids"))
        lengths = [len(x) // 4 for x in ids]
        places = first_fit_decreasing(lengths, room)
        group = table.column("group")[0].as_py() if ids else 0
        return pa.table({
            "doc_id": pa.array(doc, pa.int64()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(lengths, pa.int64()),
            "doc_tokens": pa.array(total, pa.int64()),
            "ids": pa.array(ids, pa.binary()),
            "sequence_id": pa.array([(group << 32) + s for s, _ in places], pa.int64()),
            "offset": pa.array([o for _, o in places], pa.int64()),
        })

    return pack


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", room: int = SEQUENCE, per_group: int = 1 << 19, seed: int = 9) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (binary), sequence_id, offset.

    path: a tokenizer file; by default the public word_bpe_49k.json. per_group: ids of a group, about."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)) / 3 + 1)).first()[0] or 0
    groups = max(1, round(size / per_group))
    made = tokens(docs, path, id_col, text_col, room=room)
    # The salt is a row's place in its partition: repeats of a row are dealt apart, and a task that runs again deals alike.
    salt = F.monotonically_increasing_id()
    dealt = made.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.crc32("ids"), salt), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_packed(room), "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
