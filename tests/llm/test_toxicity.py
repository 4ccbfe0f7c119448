import random
import zlib

from venuescope.llm import toxicity
from venuescope.llm.queries import QUERIES


def corpus(n, seed):
    rng = random.Random(seed)
    parts = "ka lo mi ne ru sa te vo pa di gu ha".split()
    bad = ["zorgwit", "blatterkopp", "quemmish"]
    out = []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 300))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(2 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(bad)
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_accuracy():
    train, test = corpus(800, 1), corpus(300, 2)
    model = toxicity.train([t for _, t, y in train if y], [t for _, t, y in train if not y])
    right = sum((model.score(t) >= 0.5) == bool(y) for _, t, y in test)
    assert right / len(test) > 0.95
    assert 0 <= model.score("") < 0.6


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.1")
    rows = QUERIES["op7_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, rest = [s for s, y in own if y], [s for s, y in own if not y]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in rest) / len(toxic) / len(rest)
    recall, false = (sum(s >= 0.5 for s in x) / len(x) for x in (toxic, rest))
    # 260 toxic texts in four languages train this model; on 1,300 it finds nine of ten (README).
    assert auc > 0.7 and recall > 0.4 and false < 0.02


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    done = toxicity.with_scores(odd, model, score_col="toxicity")
    assert done.columns == [*odd.columns, "toxicity"] and done.where("toxicity between 0 and 1").count() == 13
    assert toxicity.with_scores(nothing, model).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns
    assert 0 < toxicity.fit(odd, labels.limit(0)).score("x") < 1


def test_few_labels_and_one_class():
    model = toxicity.train(["bad words"], [])
    assert model.score("anything") == model.score("") == 2 / 3


def test_both_dictionaries_are_trained(monkeypatch):
    """Every training gets whole windows, and both dictionaries of the model are its results."""
    made, real = {}, toxicity.zstandard.train_dictionary

    def train(size, samples, **how):
        out = real(size, samples, **how)
        made[out.as_bytes()] = set(samples)
        return out

    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", train)
    rows = corpus(1500, 5)
    toxic, ordinary = [t for _, t, y in rows if y], [t for _, t, y in rows if not y]
    model = toxicity.train(toxic, ordinary)
    windows = {w for t in toxic for w in toxicity._windows(toxicity.words_of(t))}
    assert model.toxic in made and made[model.toxic] <= windows
    parts = [d for d in made if d in model.ordinary]
    assert sum(map(len, parts)) == len(model.ordinary)
    # All windows of the ordinary texts that do not calibrate train the ordinary one.
    apart = [ordinary[i] for i in toxicity._apart([toxicity.words_of(t) for t in ordinary])]
    seen = {w for i, t in enumerate(apart) if i % 4 != 3 for w in toxicity._windows(toxicity.words_of(t))}
    assert set().union(*(made[d] for d in parts)) == seen


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity, "train", lambda *how: given.append(how) or toxicity.Model(prior=0.5))
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(60)] + [(61, "y" * 10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, sample_bytes=2000)
    (toxic, ordinary, counts) = given[0]
    assert len(toxic) == len(ordinary) == 10 and set(map(len, toxic)) == {100} and sum(counts) > 40
