"""Rules and reputations."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenload.llm import host_reputation as hr
from evenload.llm.registry import RULES

URLS = [
    (None, "", "", None),
    ("no scheme.com/en/", "", "", None),
    ("http://Example.COM/en/1", "example.com", "/en/1", "example.com/en/"),
    ("https://www.example.com/en/x?q=/en/", "www.example.com", "/en/x", "www.example.com/en/"),
    ("https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("http://example.com", "example.com", "", None),
    ("http://example.com?x=/en/", "example.com", "", None),
    ("http://example.com#/en/", "example.com", "", None),
    ("x://y.net/fr/2#top", "y.net", "/fr/2", "net/fr/"),
    ("x://net/es/", "net", "/es/", "net/es/"),
    ("x://y.org/a://b.com/", "y.org", "/a://b.com/", None),
    ("x://É.com/", "É.com", "/", "com/"),
    ("", "", "", None),
]


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc long, bad int")
    for r in hr.judge(df, labels, RULES).collect():
        assert (r.host, r.path, r.rule) == URLS[r.page_id][1:]
        assert r.verdict == ("block" if r.rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")
    assert hr.judge(df.limit(0), labels, RULES).count() == 0


def test_bad_hosts_are_blocked_once_there_is_evidence(spark):
    rng = random.Random(3)
    pages, labels = [], []
    for i in range(3000):
        host = rng.choice(["spam.bad.org", "fine.good.org", "rare.bad.org" if i % 50 == 0 else "ok.good.org"])
        pages.append((i, f"http://{host}/{i}"))
        labels.append((i, int(rng.random() < (0.9 if host == "spam.bad.org" else 0.1))))
    pages.append((9999, "http://new.unknown.org/7000"))
    out = hr.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc long, bad int"), []).collect()
    verdicts = defaultdict(set)
    for r in out:
        verdicts[r.host].add(r.verdict)
    assert verdicts["spam.bad.org"] == {"block"} and verdicts["fine.good.org"] == verdicts["new.unknown.org"] == {"allow"}
    means = {r.host: r["mean"] for r in out}
    assert means["fine.good.org"] < means["new.unknown.org"] < means["spam.bad.org"]


def test_strength_by_hand(spark):
    rows = spark.createDataFrame([(10, 9, 0.5), (10, 1, 0.5), (0, 0, 0.5)], "n long, k long, m double")
    x2 = 2 * (4 * 4) / (10 * 0.25)
    assert hr.strength(rows) == pytest.approx(max(1.0, 18 / (x2 - 2) - 1))
    assert hr.strength(rows.where("n = 0")) == 1000


def test_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "http://a.org/5"), (1, "http://a.org/5"), (None, None)], "page_id long, url string").withColumn("rule", F.lit(1))
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1)], "doc long, bad int")
    assert hr.judge(df, labels, RULES).count() == 3


def test_beta_mass_equals_integration(spark):
    rng = np.random.default_rng(2)
    pairs = [(0.3, 4.0), (1.0, 1.0), (2.5, 0.7), (900.0, 1100.0), (1000.0, 1000.0), (4000.0, 4100.0), (5.0, 0.01), (0.01, 5.0)]
    pairs += [(float(a), float(b)) for a, b in np.exp(rng.uniform(-1, 6.5, (60, 2)))]
    for x in (0.5, 0.2):
        got = spark.createDataFrame(pairs, "a double, b double").select("a", "b", hr.beta_below(x, F.col("a"), F.col("b")).alias("p")).collect()
        for r in got:
            # Below 1, t ** (1 / a) takes the pole at 0 away; the complement is integrated from the other end.
            t = (np.arange(400_000) + 0.5) / 400_000
            sides = []
            for p, q, end in ((r.a, r.b, x), (r.b, r.a, 1 - x)):
                terms = (p - 1) * np.log(end * t) + (q - 1) * np.log1p(-end * t) + np.log(end)
                if p < 1:  # t ** (1 / p) takes the pole at 0 away
                    terms = (q - 1) * np.log1p(-end * t ** (1 / p)) + p * np.log(end) - np.log(p)
                sides.append(terms.max() + np.log(np.exp(terms - terms.max()).mean()))
            want = 1 / (1 + np.exp(np.clip(sides[1] - sides[0], -700, 700)))
            assert r.p == pytest.approx(want, abs=1e-2 if r.a + r.b > 5000 else 2e-4)


def test_suffixes_and_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "uk", "x.y.github.io", "y.github.io", "io", "a.example.com", "example.com", "", "..", "a..com"]
    s, d = hr.suffix_and_domain(F.col("h"), hr.SUFFIXES)
    got = {r.h: (r.s, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", s.alias("s"), d.alias("d")).collect()}
    assert got["a.b.co.uk"] == got["b.co.uk"] == ("co.uk", "b.co.uk") and got["co.uk"] == ("co.uk", "co.uk") and got["uk"] == ("uk", "uk")
    assert got["x.y.github.io"] == ("github.io", "y.github.io") and got["io"] == ("io", "io")
    assert got["a.example.com"] == got["example.com"] == ("com", "example.com") and got[""] == ("", "") and got["a..com"] == ("com", ".com")


def test_sites_under_a_shared_suffix_do_not_pool(spark):
    pages, labels = [], []
    for i in range(400):
        host, bad = ("spam.co.uk", 1) if i % 2 else ("fine.co.uk", 0)
        pages.append((i, f"http://{host}/{i}"))
        labels.append((i, bad))
    pages += [(900, "http://www.spam.co.uk/900"), (901, "http://www.fine.co.uk/901"), (902, "http://h.org/" + "x" * 300_000 + "/5")]
    out = hr.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc long, bad int"), []).collect()
    means = {r.host: r["mean"] for r in out}
    assert means["www.spam.co.uk"] > 0.8 and means["www.fine.co.uk"] < 0.2
    assert len(next(r for r in out if r.page_id == 902).path) == 300_003


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/5", 1, 2, 3)], "page_id long, url string, host int, mean int, _doc int")
    out = hr.judge(df, spark.createDataFrame([(5, 1)], "doc long, bad int"), RULES)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "mean", "below"] and out.first().host == "a.org"
