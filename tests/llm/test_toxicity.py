"""Toxicity scores by their accuracy on rows that weren't learned from, and on odd tables."""

import random
import zlib

import numpy as np
import pytest

from tidewright.llm import queries, toxicity
from tidewright.llm.store import table


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    one, zero = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - one * (one + 1) / 2) / (one * zero)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity_scores"](spark, sf).toPandas().merge(table(spark, sf, "labels").select("doc_id", "toxic").toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.toxic_y.to_numpy()) > 0.88
    hits = held.predicted[held.toxic_y == 1].sum()
    assert hits > 0.65 * (held.toxic_y == 1).sum() and hits > 0.65 * held.predicted.sum()


def test_parts_of_long_texts(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(n)) for n in (0, 1, 2, 3, 50, 400)]
    model = toxicity.Model.start(3)
    whole = toxicity.Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    assert np.allclose(toxicity.Scorer(model).scores(texts), whole, atol=1e-5)


@pytest.mark.parametrize("toxic", [[], [1, 1], [0, 0, None], [0, 1]])
def test_odd_rows(spark, toxic):
    docs = spark.createDataFrame([(0, "good words here", "en", 1.0), (1, "bad words", None, 1.0), (2, None, "de", 1.0), (2, "", "en", 1.0), (None, "x " * 100_000, "en", 1.0)],
                                 "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "doc_id", "text", "lang", "toxic")
    rows = toxicity.classify(docs, model, "text", "lang").collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    if len({t for t in toxic if t is not None}) < 2:
        assert {round(r["score"]) for r in rows} == {1 if 1 in toxic else 0}
    assert toxicity.classify(docs.limit(0), model, "text", "lang").count() == 0


def test_all_labelled_rows_teach(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SEEN", 0)
    n = 9000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 8 = 0, concat('vile w', id), concat('calm w', id)) as text", "if(id % 3 = 0, 'en', 'de') as lang")
    labels = docs.selectExpr("doc_id", "if(doc_id % 8 = 0, 1, 0) as toxic")
    model = toxicity.fit(docs, labels, "doc_id", "text", "lang", "toxic")
    assert sum(model.rows) == n and min(model.rows) > 1500
    rows = toxicity.classify(docs, model, "text", "lang").groupBy((docs.doc_id % 8 == 0).alias("bad")).agg({"score": "avg"}).collect()
    got = {r["bad"]: r[1] for r in rows}
    assert got[True] > 0.9 and got[False] < 0.1 and set(model.cut) == {"en", "de"}


def test_shards_share_what_they_learn(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 100)
    r = random.Random(5)
    words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{k}" for k in range(200)]
    rows = [(i, " ".join(r.choices(words, k=20) + (["vile"] if i % 4 == 0 else [])), "en", i % 4 == 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y boolean")
    labels = docs.selectExpr("doc_id", "int(y) as toxic")
    parts = [toxicity.fit(d, labels, "doc_id", "text", "lang", "toxic") for d in (docs.repartition(7), docs.coalesce(1).orderBy("text"))]
    assert parts[0].rows == parts[1].rows and np.array_equal(parts[0].matrix(), parts[1].matrix()) and parts[0].cut == parts[1].cut
    score = toxicity.Scorer(parts[0]).scores([t for _, t, _, _ in rows])
    assert auc(np.array(score), np.array([int(y) for *_, y in rows])) > 0.9


def test_parameters_as_rows():
    model = toxicity.Model.start(2)
    model.top_bias = 0.25
    again = toxicity.Model.of(model.matrix())
    assert np.array_equal(again.matrix(), model.matrix()) and again.top_bias == 0.25 and np.array_equal(again.filters[2], model.filters[2])
    texts = ["a bad word", "", "x " * 500]
    coded = [np.array([toxicity.buckets(w) for w in toxicity.split(t)], np.int32).reshape(-1, 3) for t in texts]
    assert np.allclose(toxicity.Scorer(model).logits(texts), toxicity.Scorer(model).logits_of(coded), atol=1e-6)
