import random
import zlib

import numpy as np

from seriesmill.llm.toxicity import Features, Scorer, fit, fit_features, score, without_toxic


def rows():
    rng = random.Random(3)
    syllables = ["ta", "ri", "mo", "len", "ska", "ver", "und", "pe", "li", "on"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for k in range(600):
        text = [word() for _ in range(rng.randint(20, 200))]
        toxic = k % 6 == 0
        for _ in range(3 if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["grobian", "Grobiane", "lump!", "lumpen"])
        out.append((k, " ".join(text), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([(k, t, "x", 0.0) for k, t, _ in data], "doc_id long, text string, id string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(0, 0), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = {r.id: r for r in score(docs, fit(docs, labels)).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    held = [(got[k].predicted, y) for k, _, y in data if got[k].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in without_toxic(docs, fit(docs, labels)).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_labels_of_held_out_rows_do_not_matter(spark):
    data = rows()
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, toxic int")
    turned = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, _, y in data], "doc_id long, toxic int")
    a, b = fit(docs, labels), fit(docs, turned)
    assert (a.weights == b.weights).all() and a.constant == b.constant


def test_repeated_rows_of_an_id_are_learnt_from_once(spark):
    data = rows()
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    again = docs.union(docs.where("doc_id in (6, 7)").crossJoin(spark.range(50)).select("doc_id", "text"))
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, toxic int")
    a, b = fit(docs, labels), fit(again, labels)
    assert (a.weights == b.weights).all() and a.constant == b.constant
    own = fit_features(np.array([y for k, _, y in data if zlib.crc32(str(k).encode()) % 5], float), [Features().of(t) for k, t, _ in data if zlib.crc32(str(k).encode()) % 5])
    texts = [t for _, t, _ in data]
    assert np.allclose(Scorer(a).scores(texts), Scorer(own).scores(texts), atol=1e-3)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 30000), (None, "x"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (3, 0)], "doc_id long, toxic int")
    assert {(r.id, r.score, r.predicted) for r in score(docs, fit(docs, labels)).collect()} == {(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0), (None, 0.0, 0)}
    assert score(docs.limit(0), fit(docs, labels.limit(0))).count() == 0
    features = Features()
    assert len(features.of("")) == 0 and (features.of("ab ab") == features.of("AB")).all()
    model = fit_features(np.array([0.0, 1.0] * 8), [features.of(t) for t in ("good day", "bad lump", "good man", "bad lump") * 4])
    assert (Scorer(model).scores(["bad lump", "good day"]) >= 0.5).tolist() == [True, False]
