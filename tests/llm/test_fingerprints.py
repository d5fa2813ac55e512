"""Closed syncmers and likeness against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenload.llm import fingerprints as fp


def test_anchors_depend_on_the_kmer_alone():
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdé𝔘 ", k=300))
    a, b = "".join(rng.choices("xyz", k=57)) + passage, passage + "".join(rng.choices("uvw", k=99))
    (pa, ha), (pb, hb) = fp.anchors([a, b])
    inside = {(p - 57, h) for p, h in zip(pa.tolist(), ha.tolist(), strict=True) if p >= 57}
    assert inside == {(p, h) for p, h in zip(pb.tolist(), hb.tolist(), strict=True) if p + fp.K <= 300}
    assert 300 / 11 < len(inside) < 300 / 3


def test_anchors_are_closed_syncmers():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghij", k=400))
    smers = {}
    for i in range(len(text) - fp.S + 1):
        smers.setdefault(text[i : i + fp.S], i)
    rank = {}
    n = len(text) - fp.S + 1
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = np.zeros(n, np.uint32)
    for j in range(fp.S):
        inner = inner * np.uint32(0x01000193 * 5) + codes[j : n + j]
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39), (15, 1)):
        inner = (inner ^ (inner >> np.uint32(shift))) * np.uint32(factor)
    rank = inner.tolist()
    want = [i for i in range(len(text) - fp.K + 1) if min(w := rank[i : i + fp.WINDOW]) in (w[0], w[-1])]
    assert fp.anchors([text])[0][0].tolist() == want


def test_batches_do_not_matter():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab c", k=n)) for n in (0, 1, 14, 15, 16, 500, 0, 3000)]
    alone = [fp.anchors([t])[0] for t in texts]
    for (p, h), (q, g) in zip(fp.anchors(texts), alone, strict=True):
        assert p.tolist() == q.tolist() and h.tolist() == g.tolist()


def test_likeness():
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 2**32, 20_000, dtype=np.uint32))
    errors = []
    for share in (0.1, 0.5, 0.9):
        for _ in range(30):
            both = rng.choice(pool, 2000, replace=False)
            n = int(2000 * share)
            a, b = both[: n + (2000 - n) // 2], np.concatenate([both[:n], both[n + (2000 - n) // 2 :]])
            errors.append(fp.likeness(np.unique(a)[: fp.SKETCH], np.unique(b)[: fp.SKETCH]) - n / 2000)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2
    small = np.array([1, 2, 3], np.uint32)
    assert fp.likeness(small, np.array([2, 3, 4], np.uint32)) == 0.5
    assert fp.likeness(small, small[:0]) == 0 and fp.likeness(small[:0], small[:0]) == 1


def check(df, rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = fp.near_next(df).collect()
    assert len(got) == len(rows)
    if len({r[0] for r in rows}) < len(rows):
        return
    by = {r.doc_id: r for r in got}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after, r = t or "", after or "", by[i]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = fp.sketches([t, edited, after])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.as_string(a), fp.as_string(b))
        assert (r.near_edited, r.near_next) == (fp.likeness(a, b), fp.likeness(a, c))


@pytest.mark.parametrize("n", [1, 2, 7, 1500])
def test_next_documents(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 % (3 * n + 1), "".join(rng.choices("abc défg𝔘", k=rng.randint(0, 90)))) for i in range(n)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_odd_rows(odd):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()])
    once = odd.dropDuplicates(["doc_id"])
    check(once, [(r.doc_id, r.text) for r in once.collect()])
    assert fp.near_next(odd.limit(0)).count() == 0
    assert fp.near_next(odd.where("doc_id is null")).count() == 2
    for r in odd.select("text", fp.fingerprint(F.col("text")).alias("f")).collect():
        assert r.f.fingerprint == fp.as_string(fp.sketches([r.text or ""])[0]) and len(r.f.positions) == len(r.f.hashes)


def test_only_empty_texts_have_no_anchor():
    rng = random.Random(8)
    texts = ["The cat sat here.", "No results found", "Subscribe to our news", *("".join(rng.choices("abcdefgh ", k=n)) for n in range(1, 30) for _ in range(20))]
    assert all(len(p) == len(h) > 0 for p, h in fp.anchors(texts))
    a, b, c, _ = fp.sketches([*texts[:3], ""])
    assert fp.likeness(a, b) == fp.likeness(b, c) == 0 and fp.likeness(a, a) == 1


def test_long_texts_that_differ_have_other_fingerprints():
    rng = random.Random(9)
    for _ in range(8):
        text = "".join(rng.choices("abcdefghijklmnop ", k=60_000))
        at = rng.randrange(1000, 59_000)
        other = text[:at] + "".join(rng.choices("abcdefghijklmnop ", k=400)) + text[at + 400 :]
        a, b = fp.sketches([text, other])
        assert fp.as_string(a) != fp.as_string(b) and 0.97 < fp.likeness(a, b) < 1
    a, b = fp.sketches([text, text[30_000:] + text[:30_000]])
    assert 0.3 < fp.likeness(a, b) < 0.36  # half of them in order


def test_matched_is_a_longest_common_subsequence():
    rng = np.random.default_rng(10)
    for symbols in (2, 6, 40, 10**6):
        for _ in range(60):
            a, b = (rng.integers(0, symbols, rng.integers(1, 30), dtype=np.uint32) for _ in range(2))
            if symbols > 40:
                b = rng.permutation(np.concatenate([a, b]))
            best = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
            assert fp.matched(a, b) == best[-1, -1]
