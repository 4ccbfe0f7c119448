"""Toxicity by compression distance between two zstandard dictionaries.

From a bounded sample of labelled texts zstandard trains two dictionaries, one on windows of ordinary text
and one on windows of toxic text. A text is cut into windows of a few words, all of which are compressed
with either dictionary. The bytes that the toxic dictionary saves on a window are its compression distance;
each distance's share among windows of toxic and of ordinary texts, and a document's distances over all its
windows, are calibrated on labelled texts that no dictionary has seen. Neither label, language, source nor
id enters a score.

Most windows of a toxic text are ordinary. So the toxic dictionary is trained in rounds, always on whole
windows: two halves of the toxic texts each train one, first on the `ODDEST` share of windows that ordinary
text helps least to compress, and of the other half's windows those stay that this dictionary saves most on
(the `SHARE` share at most, `SAVED` bytes at least). What stays of both halves trains the last dictionary.
Ordinary text trains one dictionary for each slice of its windows, as the trainer alone does not fill a large one.

A window is compressed after the toxic dictionary with the ordinary one behind it, and after the ordinary one
at the same distances, so that a window without anything toxic costs the same either way.

Nulls: a null text is an empty one; it has no window and gets the score of one without distances. A null
label is no label. A null id has no label and is not held out. Rows that share a labelled id are one sample,
the first of their texts. With labels of one class only, or none, every score is that class's smoothed share.
An empty table gives an empty result. Other columns are not read; `drop_toxic` keeps them, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of, tidy, written

WORD = re.compile(r"[^\W\d_]+")
WINDOW = 6
#: Distances beyond these count as these.
LEAST, MOST = -2, 12
#: Bytes of the toxic dictionary by round, of one slice of the ordinary one, and how many slices there are at most.
TOXIC_BYTES, SLICE_BYTES, SLICES = (32 << 10, 16 << 10, 8 << 10), 64 << 10, 8
#: Which windows of toxic texts train a round; see above.
ODDEST, SHARE, SAVED = 0.3, 0.1, 3
#: Labelled texts of each class that training looks at, at most, and their bytes together.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 2000, 4000, 48 << 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _windows(words: list[str]) -> list[bytes]:
    return [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)]


def _bins(distances: np.ndarray) -> np.ndarray:
    return np.clip(distances, LEAST, MOST) - LEAST


def _evidence(toxic: np.ndarray, ordinary: np.ndarray) -> list[float]:
    """Log ratio of each distance's share among windows of toxic and of ordinary texts."""
    shares = [(np.bincount(_bins(d), minlength=MOST - LEAST + 1) + 1) / (len(d) + MOST - LEAST + 1) for d in (toxic, ordinary)]
    return np.log(shares[0] / shares[1]).tolist()


def _length_with(content: bytes):
    """Compressed length of a window after this content."""
    how = zstandard.ZstdCompressionParameters(window_log=21, hash_log=19, chain_log=19, search_log=8, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    compress = zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress
    return lambda window: len(compress(window))


@dataclass
class Model:
    """ordinary and toxic: trained dictionaries; evidence by distance; weights of the features."""

    ordinary: bytes = b""
    toxic: bytes = b""
    evidence: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def distances(self, words: list[str]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        if self._pair is None:
            self._pair = _length_with(self.ordinary), _length_with(self.toxic + self.ordinary)
        plain, toxic = self._pair
        windows = _windows(words)
        return np.fromiter((plain(w) - toxic(w) for w in windows), np.int64, len(windows))

    def features(self, text: str) -> np.ndarray:
        """What the windows' distances say: the sum and the mean of their evidence, and the largest three."""
        words = words_of(text)
        if not words or not self.toxic:
            return np.zeros(6)
        d = self.distances(words)
        n, told = len(d), np.asarray(self.evidence)[_bins(d)]
        top = np.sort(d)[::-1][:3].clip(0)
        return np.array([np.clip(told.sum() / 4, -8, 8), 4 * told.mean(), *np.pad(top, (0, 3 - len(top))) / 8, np.log1p(n) / 5])

    def score(self, text: str) -> float:
        if not self.weights:
            return self.prior
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _apart(texts: list[list[str]]) -> list[int]:
    """Indexes of texts without near copies of earlier ones: by the eight smallest word hashes."""
    seen: dict[int, list[int]] = defaultdict(list)
    out = []
    for i, words in enumerate(texts):
        least = sorted({xxhash.xxh64_intdigest(w) for w in words})[:8]
        if max(Counter(j for h in least for j in seen[h]).values(), default=0) * 2 < len(least) or not least:
            out.append(i)
            for h in least:
                seen[h].append(i)
    return out


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary that zstandard trains. Where samples are too few for the trainer, they are the dictionary."""
    if sum(map(len, samples)) <= 2 * size:
        return b"".join(dict.fromkeys(samples))[:size]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def ordinary_dictionary(windows: list[bytes]) -> bytes:
    """One trained dictionary for each slice of the windows; as many slices as windows fill three times."""
    slices = max(1, min(SLICES, sum(map(len, windows)) // (3 * SLICE_BYTES)))
    return b"".join(_trained(windows[i::slices], SLICE_BYTES, 50) for i in range(slices))


def _at_least(windows: list[bytes], values: np.ndarray, quantile: float, least: float) -> list[bytes]:
    """Windows whose value is at least `least` and at least this quantile of all."""
    if not len(values):
        return []
    cut = max(least, float(np.quantile(values, quantile)))
    return [w for w, v in zip(windows, values, strict=True) if v >= cut]


def toxic_dictionary(texts: list[list[str]], ordinary: bytes) -> bytes:
    """Trained on whole windows of toxic texts, by halves that choose windows for each other."""
    halves = [[w for words in texts[i::2] for w in _windows(words)] for i in (0, 1)]
    plain = _length_with(ordinary)
    before = [[plain(w) for w in half] for half in halves]
    per_byte = [np.array([n / len(w) for w, n in zip(half, own, strict=True)]) for half, own in zip(halves, before, strict=True)]
    chosen = [_at_least(half, told, 1 - ODDEST, 0) for half, told in zip(halves, per_byte, strict=True)]
    for size in TOXIC_BYTES[:-1]:
        others = [_length_with(_trained(c, size, 16) + ordinary) for c in reversed(chosen)]
        saved = [np.array([n - other(w) for w, n in zip(half, own, strict=True)]) for half, own, other in zip(halves, before, others, strict=True)]
        kept = [_at_least(half, d, 1 - SHARE, SAVED) for half, d in zip(halves, saved, strict=True)]
        chosen = [k or c for k, c in zip(kept, chosen, strict=True)]
    return _trained(chosen[0] + chosen[1], TOXIC_BYTES[-1], 16)


def _fit(x: np.ndarray, y: np.ndarray, heft: np.ndarray, ridge: float = 0.05, steps: int = 40) -> list[float]:
    """Logistic regression by Newton steps, each row counted `heft` times."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        w -= np.linalg.solve((x.T * (heft * p * (1 - p))) @ x + penalty, x.T @ (heft * (p - y)) + penalty @ w)
    return w.tolist()


def train(toxic: list[str], ordinary: list[str], counts: tuple[int, int] | None = None, every: int = 4) -> Model:
    """Calibration on every fourth text of each class, dictionaries from the others.

    counts: how many toxic and ordinary texts the samples stand for; by default for themselves."""
    counts = counts or (len(toxic), len(ordinary))
    prior = (counts[0] + 1) / (sum(counts) + 2)
    sides = [[words_of(t) for t in x] for x in (toxic, ordinary)]
    sides = [[x[i] for i in _apart(x)] for x in sides]
    if min(map(len, sides)) < every:
        return Model(prior=prior)
    apart = [x[every - 1 :: every] for x in sides]
    seen = [[w for i, w in enumerate(x) if i % every != every - 1] for x in sides]
    plain = ordinary_dictionary([w for words in seen[1] for w in _windows(words)])
    model = Model(plain, toxic_dictionary(seen[0], plain), prior=prior)
    model.evidence = _evidence(*(np.concatenate([model.distances(w) for w in x if w] or [np.zeros(0, int)]) for x in apart))
    texts = [(" ".join(w), 1 - i) for i, x in enumerate(apart) for w in x]
    y = np.array([y for _, y in texts], float)
    share = np.array([counts[1] / len(apart[1]), counts[0] / len(apart[0])])[y.astype(int)]
    model.weights = _fit(np.array([model.features(t) for t, _ in texts]), y, share * len(y) / share.sum())
    return model


def held_out(id_col: str = "doc_id"):
    """Whether labels of this id are kept from training: crc32 of the id as text mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_toxic: int = SAMPLE_TOXIC, sample_ordinary: int = SAMPLE_ORDINARY, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on at most so many labelled texts of each class, first by a hash of the id; never held-out ones.

    sample_bytes: texts are taken in that order, each class up to half of it; what does not fit is left out."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__y")).where(~held_out("__id") & F.col("__y").isin(0, 1)).groupBy("__id").agg(F.max("__y").alias("__y"))
    counts = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    ids = [r for y, n in ((1, sample_toxic), (0, sample_ordinary)) for r in known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n).collect()]
    sample = spark.createDataFrame(ids, "__id long, __y int")
    # The sample's size is bounded by the two parameters; what it joins stays out of the driver until it is measured.
    found = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("__text")).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    found = written(found.groupBy("__doc", "__y").agg(F.min("__text").alias("__text")), "sample", 8)
    place = lambda i: (xxhash.xxh64_intdigest(str(i)), i)
    taken, room = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    for i, y, n in sorted(map(tuple, found.select("__doc", "__y", F.octet_length("__text")).collect()), key=lambda r: place(r[0])):
        if n <= room[y]:
            room[y] -= n
            taken.append((i,))
    chosen = F.broadcast(spark.createDataFrame(taken, "__doc long"))
    rows = sorted(map(tuple, found.join(chosen, "__doc").select("__doc", "__y", "__text").collect()), key=lambda r: place(r[0]))
    return train([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0], (counts.get(1, 0), counts.get(0, 0)))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and the score of each row's whole text."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = given.value
            scores = pa.array([own.score(t or "") for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*names, "score"])

    schema = docs.toDF(*names).withColumn("score", F.lit(0.0)).schema
    return docs.toDF(*names).mapInArrow(tidy(run), schema).toDF(*docs.columns, score_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the cut, with all their columns, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = with_scores(docs, fit(docs, labels, id_col, text_col), text_col).toDF(*names, "score")
    return scored.where(F.col("score") < cut).select(*names).toDF(*docs.columns)
