import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from venuescope.llm import packing
from venuescope.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(PATH)
    return lambda text: np.array([*own.encode(text, add_special_tokens=False).ids, 1], "<u4")


def test_query_is_an_exact_round_trip(spark, sf, rows_of, plain):
    docs = {i: plain(t or "") for i, t in rows_of(sf, "documents", "doc_id", "text")}
    pieces = QUERIES["op9_packing"](spark, sf).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        own = docs[p.doc_id][p.start : p.start + p.length]
        assert len(own) == p.length and p.ids_crc32 == zlib.crc32(own.tobytes()) and p.doc_tokens == len(docs[p.doc_id])
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(docs[i])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert sum(map(len, docs.values())) / (2048 * len(by_seq)) > 0.95


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_decreasing_against_a_plain_scan(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 400).tolist()
    bins, want = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, b in enumerate(bins) if b + sizes[i] <= 100), len(bins))
        if k == len(bins):
            bins.append(0)
        want[i] = (k, bins[k])
        bins[k] += sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == want and packing.first_fit_decreasing([], 100) == []


ODD_TEXTS = ["İstanbul ΣΑΣ ok", "a\x1cb c", "x<|endoftext|>y <|ENDOFTEXT|>", "", "  \n ", "don't it'S 12 3½ ÀÉß €", "áb é", "中文 text 😀", "a\xa0b\x85c\x00d", "a_b _c d's '''x l'été: ok...!!! 1,234.5 x2y --  ²³ x²", "word. Word, WORD!! (word)"]


def test_words_are_tokenised_as_whole_texts_are(plain):
    import pyarrow as pa

    cache = packing.WordCache(PATH, most=5)
    for _ in range(2):
        assert [x.tolist() for x in cache.encode(pa.array(ODD_TEXTS))] == [plain(t)[:-1].tolist() for t in ODD_TEXTS]


def test_every_code_point_of_the_short_path(plain):
    import pyarrow as pa

    cache = packing.WordCache(PATH)
    for shape in ("{}", "a{}b", "Xy{} z"):
        texts = [shape.format(chr(c)) for c in range(0x260)]
        assert [x.tolist() for x in cache.encode(pa.array(texts))] == [plain(t)[:-1].tolist() for t in texts]


def test_repeats_and_long_rows_make_no_large_group(spark):
    docs = spark.createDataFrame([(1, "same words here again " * 40)] * 400 + [(2, "a b c d e f " * 20_000)], "doc_id long, text string")
    groups = {}
    for p in packing.pack(docs, per_group=8192).collect():
        groups[p.sequence_id >> 32] = groups.get(p.sequence_id >> 32, 0) + p.length
    assert len(groups) > 15 and max(groups.values()) < 4 * sum(groups.values()) / len(groups)


def test_odd_rows(odd, nothing):
    pieces = packing.pack(odd).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    assert set(by) == {r.doc_id for r in odd.collect()}
    assert [(p.length, p.doc_tokens) for p in by[1]] == [(1, 1)] and len(by[4]) == 2
    assert sum(p.length for p in by[6]) == by[6][0].doc_tokens > 40_000
    assert packing.pack(nothing).count() == 0
