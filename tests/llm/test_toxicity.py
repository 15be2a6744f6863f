"""Toxicity: matching against edit distances, context, the learnt lexicon, held-out accuracy."""

import random

import numpy as np
import pytest
from graphloom.llm import toxicity
from graphloom.llm.quality import held_out
from graphloom.llm.toxicity import Matcher, Model, Term
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def best(terms, word):
    """(gain, distance) of the best term by plain edit distances."""
    out = (0.0, 0)
    for t in terms:
        d = min(distance(t.text, word[:k]) for k in range(len(word) + 1)) if t.stem else distance(t.text, word)
        if d <= t.edits and t.gain(d) > out[0]:
            out = (t.gain(d), d)
    return out


def spread(words):
    points = np.array([ord(c) for c in "".join(words)], np.uint32)
    ends = np.cumsum([len(w) for w in words])
    return points, ends - [len(w) for w in words], ends


@pytest.mark.parametrize("states", [1 << 17, 3])
def test_automata_equal_edit_distances(monkeypatch, states):
    monkeypatch.setattr(toxicity, "STATES", states)
    rng = random.Random(5)
    texts = ["idiot", "moron", "worthless", "pathetic", "scum", "abc", "ümläut", "morone", "worth", "lo\U0001f600ser"]
    terms = [Term(t, False, 0.5 + i / 20) for i, t in enumerate(texts)] + [Term("lostra", True, 0.9), Term("worthlessness", True, 0.8), Term("loweisch", True, 0.7)]
    words = []
    for _ in range(1500):
        w = list(rng.choice(texts + ["lostraei", "loweischaft", "worthlessnessy", "x"]))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "e", "x", "o", "ü"])
        if w:
            words.append("".join(w))
    matcher = Matcher(terms)
    for _ in range(2):
        term, far = matcher.match(*spread(words))
        got = [(terms[t].gain(d) if t >= 0 else 0.0, d if t >= 0 else 0) for t, d in zip(term.tolist(), far.tolist(), strict=True)]
        assert got == [best(terms, w) for w in words]


def lone(text, model=None):
    model = model or Model([Term("moron", False, 1.0)], weights=toxicity.PRIOR)
    data = np.frombuffer(text.encode(), np.uint8)
    return toxicity.find(model, Matcher(model.terms), data, np.array([0, len(data)]))


def test_context_tells_quotation_from_abuse():
    plain = lone("the word was far and moron stood there").score[0]
    assert lone("you are a MORON and that is all").score[0] > plain
    said = lone('he said "what a moron" and left').score[0]
    assert said < lone("he said what a moron and left").score[0] < lone("he left what a moron and left").score[0]
    assert lone("he left « moron » there").score[0] < lone('he left " moron there').score[0]
    assert lone("a moron moron moron there").score[0] > lone("a moron there").score[0]


def test_words_are_whole_and_masked():
    hits = lone("“Moron”, mor*n; (m0ron) moron's morons oron, omoron1 * moroo")
    assert list(zip(hits.start.tolist(), hits.end.tolist(), strict=True)) == [(1, 6), (9, 14), (17, 22), (24, 29), (32, 38), (39, 43), (55, 60)]
    assert hits.far.tolist() == [0, 1, 1, 0, 1, 1, 1]
    assert not len(lone("").row) and not len(lone("* @ $ \U0001f600").row)


def labelled(spark, n=900):
    rng = random.Random(3)
    base = ["the", "house", "green", "walks", "over", "river", "stone", "maron", "kept", "quiet"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(base) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            words[rng.randrange(40)] = rng.choice(["moron", "stupid", "vequ" + rng.choice(["a", "er", "ille"])])
        docs.append((i, " ".join(words), "clash", "clash", "clash"))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (10_000, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, y string, hits string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_lexicon_and_unseen_misspellings(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    assert {(t.text, t.stem) for t in model.terms} >= {("moron", False), ("stupid", False), ("vequ", True)}
    assert not {t.text for t in model.terms} & {"the", "maron"}
    new = [(1, "over the house you morron stuppid walks"), (2, "maron maron river stone maron"), (3, "vequois over veququ"), (4, None), (5, ""), (None, "moron stupid moron"), (None, "moron stupid moron"), (7, "river " * 100_000 + "moron stupid")]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert {k: r["predicted"] for k, r in got.items()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, None: 1, 7: 1}
    assert [(h["term"], h["distance"]) for h in got[1]["hits"]] == [("moron", 1), ("stupid", 1)]
    assert got[4]["score"] == got[5]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    again = toxicity.train(docs.repartition(9), labels)
    assert again.terms == model.terms and np.allclose(again.weights, model.weights, rtol=1e-9)


def test_bounds_and_empty_tables(spark):
    docs, labels = labelled(spark, 300)
    assert toxicity.sample(docs.unionByName(docs).unionByName(docs), labels, 40, "doc_id", "text", "toxic").groupBy("y").count().agg(F.max("count")).first()[0] <= 20
    for d, y in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.where("toxic = 1"))):
        model = toxicity.train(d, y)
        assert not model.terms
        assert len({r["score"] for r in toxicity.score(docs, model).select("score").collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where(held_out(F.col("doc_id"))).join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in scored if r["toxic"]], [r for r in scored if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
