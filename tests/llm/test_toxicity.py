"""Ordinal regression: gradients, recovered grades, held-out accuracy."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenload.llm import toxicity


def test_fit_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 6)) < 0.3).astype(float)
    eta = x @ np.array([2.0, 1.0, 0, 0, -1.0, 3.0]) + rng.logistic(size=4000)
    grades = (eta > 1).astype(int) + (eta > 3)
    w, cuts = toxicity.fit_ordinal(toxicity.Marks.of(x), grades, 0.1)
    assert w == pytest.approx([2, 1, 0, 0, -1, 3], abs=0.35) and cuts == pytest.approx([1, 3], abs=0.35)


def test_minimiser_reaches_the_bottom():
    a = np.diag([1.0, 10, 100])
    got = toxicity.minimise(lambda x: (x @ a @ x / 2 - x.sum(), a @ x - 1), np.zeros(3), tolerance=1e-14)
    assert got == pytest.approx([1, 0.1, 0.01], abs=1e-4)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words, bad = [f"w{i}" for i in range(800)], ["scoundrel", "blockhead", "nitwit"]
    docs, labels = [], []
    for i in range(1500):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(5, 80))], int(rng.random() < 0.25)
        for _ in range(toxic * rng.randint(1, 4)):
            text.insert(rng.randrange(len(text)), rng.choice(bad).capitalize() + rng.choice(["", ".", ","]))
        docs.append((i, " ".join(text), toxic))
        if i < 900:
            labels.append((i, int(rng.random() < 0.5), toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, truth int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    out = toxicity.graded(docs, labels).where("doc_id >= 900").collect()
    assert np.mean([r.toxic == bool(r.truth) for r in out]) > 0.98
    assert all(r.severity >= r.p_toxic - 1e-9 for r in out)
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("truth = 0").count() == docs.where("truth = 0").count()


def brute(docs, labels, ridge=0.05):
    """p_toxic and severity of every text by counting words one by one and descending the penalised likelihood by differences."""
    grades = [(docs[i], 0 if t == 0 else 2 - q) for i, q, t in labels]
    bags = [set(re.findall(r"[a-z0-9]+", t.lower())) for t, _ in grades]
    bad = [g > 0 for _, g in grades]
    n, toxic = len(bags), sum(bad)
    chosen, every = [], {w for b in bags for w in b if not all(w in x for x in bags)}
    for w in sorted(every):
        table = [[sum((w in b) == h and t == g for b, t in zip(bags, bad, strict=True)) for g in (True, False)] for h in (True, False)]
        sides = [toxic / n, 1 - toxic / n]
        ratio = sum(o * math.log(o / (sum(row) * s)) for row in table for o, s in zip(row, sides, strict=True) if o)
        if 2 * ratio > 2 * math.log(len(every)):
            chosen.append(w)
    x = np.array([[w in b for w in chosen] for b in bags], float)
    y = np.array([g for _, g in grades])

    def chances(p, m):
        eta = m @ p[: len(chosen)]
        cuts = [p[-2], p[-2] + np.exp(p[-1])]
        return [1 / (1 + np.exp(c - eta)) for c in cuts]

    def loss(p):
        one, two = chances(p, x)
        chance = np.where(y == 0, 1 - one, np.where(y == 1, one - two, two))
        return -np.log(np.maximum(chance, 1e-12)).sum() + ridge / 2 * (p[: len(chosen)] ** 2).sum()

    p, step = np.zeros(len(chosen) + 2), 1e-3
    value = loss(p)
    for _ in range(3000):
        grad = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(len(p)) * 1e-5])
        while loss(p - step * grad) > value and step > 1e-12:
            step /= 2
        p, step = p - step * grad, step * 1.5
        value = loss(p)
    rows = [set(re.findall(r"[a-z0-9]+", t.lower())) for t in docs.values()]
    one, two = chances(p, np.array([[w in b for w in chosen] for b in rows], float))
    return chosen, dict(zip(docs, zip(one, one + two, strict=True), strict=True))


def test_scores_equal_a_plain_fit(spark):
    rng = random.Random(3)
    words, bad = [f"w{i}" for i in range(60)], ["scoundrel", "blockhead", "nitwit"]
    docs, labels = {}, []
    for i in range(260):
        toxic = int(rng.random() < 0.3)
        text = [rng.choice(words) for _ in range(rng.randint(3, 15))] + [rng.choice(bad)] * (rng.random() < (0.8 if toxic else 0.04))
        docs[i] = " ".join(text)
        labels.append((i, int(rng.random() < 0.5), toxic))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    chosen, want = brute(docs, labels)
    out = toxicity.graded(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert chosen == sorted(bad)
    for r in out:
        assert r.p_toxic == pytest.approx(want[r.doc_id][0], abs=3e-3) and r.severity == pytest.approx(want[r.doc_id][1], abs=6e-3)


def test_repeated_ids_do_not_pass_the_bound(corpus):
    docs, labels = corpus
    many = docs.where("doc_id < 200").unionByName(docs.where("doc_id < 200"))
    model = toxicity.fit(many, labels, F.expr(toxicity.SEVERITY), max_rows=150)
    assert len(model.weights) == len(model.words)


def test_same_scores_alone_and_in_batches(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.expr(toxicity.SEVERITY))
    texts = [r.text for r in docs.limit(50).collect()]
    assert model.linear(texts) == pytest.approx([model.linear([t])[0] for t in texts])


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (4, 0, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        out = toxicity.graded(odd, some)
        assert out.columns == [*[c for c in odd.columns if c != "toxic"], "p_toxic", "severity", "toxic"]
        assert out.count() == odd.count() and out.where("p_toxic is null or severity is null").count() == 0
        assert toxicity.clean(odd, some).columns == odd.columns
        assert toxicity.clean(odd, some).count() == odd.count()  # too few labels to choose a word
    assert toxicity.clean(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.graded(odd.limit(0), labels).count() == 0


def test_cut():
    eta, toxic = np.array([0.0, 0.0, 0.2, 3.0, 4.0]), np.array([False, False, False, True, True])
    assert toxicity.best_cut(eta, toxic) == 1.6
    assert toxicity.best_cut(eta[:2], np.array([True, False])) == np.inf
    assert toxicity.best_cut(np.array([0.0, 2.0]), np.array([True, True])) == 1
