"""URL filters: rules first, then empirical-Bayes host reputation.

Pages whose document is labelled give outcomes (bad or not). Counts are shrunk
level by level through beta-binomial priors: a host towards its registered
domain (one label below its suffix), that towards its suffix, that towards all
pages. A suffix is the longest of a list of public suffixes that ends the host, or
its last label. The strength of each prior comes from the data: the intraclass
correlation of outcomes among the children of that level, by moments. A host
without labels takes its parents' mean. A page is blocked if the lower bound
of its host's posterior exceeds a tolerance, that is, if the beta posterior leaves
less than ``alpha`` of its mass at or below the tolerance.

Counts are aggregated before they are joined, and a host that holds a large
share of the pages is joined by an ordinary left join, which adaptive execution
splits.

Defined cases: a null url or one without :// has empty host and path, fits no
rule and is judged as a host without labels; urls of any length are read whole; an empty table gives an empty
result; null outcomes are ignored, and of several outcomes of a document the worst counts; repeated and null
page ids are judged row by row; of rules of equal length the later one wins; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenload.scratch import materialize

#: Public suffixes of more than one label. Pass another list for others.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "com.br", "org.br", "net.br", "gov.br", "com.cn", "net.cn",
    "org.cn", "gov.cn", "edu.cn", "com.tw", "org.tw", "com.hk", "com.sg", "co.in", "org.in", "net.in", "gov.in", "ac.in", "co.za",
    "org.za", "com.mx", "com.ar", "com.tr", "co.il", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "netlify.app",
    "vercel.app", "pages.dev", "herokuapp.com", "web.app", "firebaseapp.com",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Fits its host and all subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// to /, ?, # or the end, A-Z lower-cased; path: then to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. rules is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """The longest listed suffix that ends a host, else its last label, and the registered domain."""
    by_labels: dict[int, list[str]] = {}
    for x in suffixes:
        by_labels.setdefault(x.count(".") + 1, []).append(x)
    labels = F.lit(1)
    for n in sorted(by_labels):
        labels = F.when(F.substring_index(host, ".", -n).isin(by_labels[n]), F.lit(n)).otherwise(labels)
    parts = F.split(host, r"\.", -1)

    def last(n: Column) -> Column:
        return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")

    return last(labels), last(labels + 1)


def _log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps up."""
    y = x + 8
    steps = F.log(x)
    for k in range(1, 8):
        steps = steps + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - steps


def beta_below(x: float, a: Column, b: Column, steps: int = 400) -> Column:
    """The mass of Beta(a, b) at or below x, by the power series of the incomplete beta function.

    The series starts from the end whose terms fall. Beyond a + b = 5,000, where the steps
    would not do, by the normal distribution (within 1e-2).
    """
    swap = x * (a + b + 2) >= a + 1
    y, p, q = F.when(swap, 1 - x).otherwise(x), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    facts = F.struct(y.alias("y"), p.alias("p"), q.alias("q"))

    def mass(f: Column) -> Column:
        terms = F.aggregate(
            F.sequence(F.lit(0), F.lit(steps)),
            F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
            lambda acc, n: F.struct(
                (acc["t"] * (f["p"] + f["q"] + n) / (f["p"] + 1 + n) * f["y"]).alias("t"), (acc["s"] + acc["t"]).alias("s")
            ),
            lambda acc: acc["s"],
        )
        front = _log_gamma(f["p"] + f["q"]) - _log_gamma(f["p"]) - _log_gamma(f["q"]) + f["p"] * F.log(f["y"]) + f["q"] * F.log(1 - f["y"])
        return F.exp(front) * terms / f["p"]

    tail = F.transform(F.array(facts), mass)[0]
    mean = a / (a + b)
    z = (mean - x) / F.sqrt(mean * (1 - mean) / (a + b + 1))
    far = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), z))
    normal = 1 / (1 + F.exp(1.5976 * far + 0.07056 * far * far * far))
    return F.when(a + b > 5000, normal).when(swap, 1 - tail).otherwise(tail)


def strength(children: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """The prior's strength, from rows (n, k, m): m is the mean of the level above.

    With intraclass correlation r, the squared Pearson residuals sum to C + r (N - C)
    for C children and N outcomes; the strength is 1 / r - 1, held within bounds.
    """
    x2, c, n = (
        children.where("n > 0")
        .agg(
            F.sum(F.expr("(k - n * m) * (k - n * m) / (n * m * (1D - m))")),
            F.count("n"),
            F.sum("n"),
        )
        .first()
    )
    if not c or n == c or x2 <= c:
        return most
    return min(most, max(least, (n - c) / (x2 - c) - 1))


def reputations(hosts: DataFrame, tolerance: float = 0.5, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior of each host from rows (host, n labelled, k bad), one per host.

    Adds its mean, and below, its mass at or below the tolerance.
    """
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    overall = (total[1] + 1) / (total[0] + 2)
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    level = hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix"))
    domains = level.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrunk(children: DataFrame, name: str) -> DataFrame:
        s = strength(children)
        return children.withColumn(name, F.expr(f"({s!r}D * m + k) / ({s!r}D + n)")).withColumn("s", F.lit(s))

    top = shrunk(suffixes.withColumn("m", F.lit(overall)), "mean").select("suffix", F.col("mean").alias("m"))
    mid = shrunk(domains.join(top, "suffix"), "mean").select("domain", F.col("mean").alias("m"))
    low = shrunk(level.join(mid, "domain"), "mean")
    strength_of = F.col("s") + F.col("n")
    return low.select(
        "host", "n", "k", "mean", beta_below(tolerance, strength_of * F.col("mean"), strength_of * (1 - F.col("mean"))).alias("below")
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    tolerance: float = 0.5,
    alpha: float = 0.05,
    suffixes: Sequence[str] = SUFFIXES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """A row per page: id, host, path, rule, verdict, mean, below.

    outcomes: rows (doc bigint, bad int); a page belongs to the document whose
    number is the first all-digit start of a path segment.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn(
        "_doc", F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint)")
    )
    known = outcomes.where("bad is not null").groupBy("doc").agg(F.max("bad").alias("bad"))
    by_doc = parsed.where("_doc is not null").groupBy("host", "_doc").agg(F.count("*").alias("_pages"))
    counts = (
        by_doc.join(known, F.col("_doc") == F.col("doc"))
        .groupBy("host")
        .agg(F.sum("_pages").alias("n"), F.sum(F.col("_pages") * F.col("bad")).alias("k"))
    )
    hosts = parsed.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    per_host = materialize(
        hosts.unionByName(counts).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "hosts"
    )
    rep = reputations(per_host, tolerance, suffixes).select("host", "mean", "below")
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("below") < alpha, "block").otherwise("allow")
    return (
        parsed.join(rep, "host", "left")
        .select(id_col, "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_method).alias("verdict"), "mean", "below")
    )
