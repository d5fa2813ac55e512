"""Near-dedup of texts against all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenload.llm import components, near_text


def frequencies(rows):
    """Documents that hold each shingle, counted one by one."""
    held = Counter()
    for _, t in rows:
        words = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (t or "").lower()).split()
        k = min(5, len(words))
        held.update({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else ())
    return held


def shingled(text):
    """Counts of a text's shingles, as strings."""
    words = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower()).split()
    k = min(5, len(words))
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def brute(rows):
    """Classes over all pairs of distinct texts, by strings and exact frequencies."""
    texts = sorted({t or "" for _, t in rows})
    held, n = frequencies(rows), len(rows)
    idf = {s: 1 + math.log((1 + n) / (1 + df)) / math.log(2 + n) for s, df in held.items()}
    its = [shingled(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            low = sum(idf[s] * c for s, c in (its[i] & its[j]).items())
            high = sum(idf[s] * c for s, c in (its[i] | its[j]).items())
            if low and low / high >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for i, t in rows:
        g = group[texts.index(t or "")]
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return {(i, t or ""): least.get(group[texts.index(t or "")]) for i, t in rows}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    common = [rng.choice(vocabulary) for _ in range(25)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for changes in (0, 0, 1, 2, 3, 5, 8):
            rows.append((i, " ".join(edited(rng, base, changes))))
            i += 1
    for _ in range(30):
        rows.append((i, " ".join([*common, *(rng.choice(vocabulary) for _ in range(rng.randint(5, 120)))])))
        i += 1
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows += [(i + k, " ".join(edited(rng, base, k % 6))) for k in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [(4096, 256), (8, 4)])
def test_classes_equal_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_text, "SKETCH_BLOCK", blocks[0])
    monkeypatch.setattr(near_text, "TEXT_BLOCK", blocks[1])
    rows = corpus()
    got = near_text.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r._id: r.class_id for r in got} == {i: c for (i, _), c in want.items()}


def test_draws_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    hits, want = [], []
    for _ in range(150):
        s = np.sort(rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2))
        w = rng.uniform(0.5, 5, (2, 60))
        w[0, :10] = w[1, 50:] = 1e-9
        draws = [near_text.sketch(s, np.log(x).astype(np.float32), np.array([0]))[0] for x in w]
        hits.append((draws[0] == draws[1]).mean())
        want.append(np.minimum(*w).sum() / np.maximum(*w).sum())
    assert abs(np.mean(hits) - np.mean(want)) < 0.02


@pytest.mark.parametrize("most", [1 << 20, 400])
def test_document_frequencies_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(near_text, "CHUNK", (most, most))
    monkeypatch.setattr(near_text, "RANGE", (most, most))
    rows = [*corpus(), (900, None), (901, ""), (902, "one two")]
    base = spark.createDataFrame(rows, "_id long, text string").selectExpr("_id", "unhex(md5(coalesce(text, ''))) as node", "coalesce(text, '') as text")
    chunks, ranges = near_text.layout(sum(len(t or "") for _, t in rows), 4)
    chunk = F.pmod(F.xxhash64("node", "_id"), F.lit(chunks).cast("long"))
    dealt = base.select(chunk.alias("chunk"), "text").repartition("chunk").sortWithinPartitions("chunk")
    got = near_text.sketched(base, near_text.answered(dealt, ranges), chunk, len(rows)).collect()
    held, texts, n = frequencies(rows), dict(rows), len(rows)
    mine, true = [], []
    for r in got:
        own = near_text.unpack_counts(bytes(r.held))
        mine += own.tolist()
        want = sorted(held[s] for s in shingled(texts[r._id] or ""))
        true += want
        assert sorted(own.tolist()) == want
    idf = near_text.inverse_frequencies(np.array(sorted(mine)), n)
    exact = np.log((1 + n) / (1 + np.array(sorted(true))))
    assert np.corrcoef(idf, exact)[0, 1] > 0.999999 and len(got) == n


def test_packed_runs_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 5000):
        values = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (near_text.unpack_sorted(near_text.pack_sorted(values)) == values).all()
        narrow = np.unique(rng.integers(2**63, 2**63 + 2**40, n, dtype=np.uint64))
        assert (near_text.unpack_sorted(near_text.pack_sorted(narrow)) == narrow).all()
        counts = rng.choice([1, 1, 2, 7, 254, 255, 256, 10**10], n)
        assert (near_text.unpack_counts(near_text.pack_counts(counts)) == counts).all()


def test_large_families_lose_nothing(spark, monkeypatch):
    """A chain of texts, each near the next one only, and copies of one text: far more than a block."""
    monkeypatch.setattr(near_text, "TEXT_BLOCK", 8)
    monkeypatch.setattr(near_text, "SKETCH_BLOCK", 16)
    rng = random.Random(11)
    words = [f"c{i}" for i in range(1200)]
    rows = [(k, " ".join(words[k * 8 : k * 8 + 160])) for k in range(90)]
    base = [f"b{i}" for i in range(200)]
    rows += [(200 + k, " ".join(edited(rng, base, k % 4))) for k in range(120)]
    got = near_text.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r._id: r.class_id for r in got} == {i: c for (i, _), c in brute(rows).items()}


def test_odd_rows(odd):
    got = near_text.classes(odd).collect()
    assert len(got) == odd.count()
    by = {r._id: r.class_id for r in got}
    assert by[6] == 5 and by[4] == by[3] == 3 and by[7] == 7 and by[2] == 2
    kept = near_text.clean(odd)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, None, 5, 7, 8, 9], key=str)
    assert near_text.classes(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(-5, 7), (3, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    assert got == group
