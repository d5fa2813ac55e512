"""Secret scans: three base patterns, and a randomness battery with false-discovery control.

Base spans come from fixed patterns. The battery looks at every run of 16 or
more characters of encoded data. Its encoding is inferred from the characters
used, and three tests ask whether the run could be uniformly random in it:

* chi-squared uniformity over the alphabet, by symbol and by class of symbol;
* a runs test of symbols in the upper half of the alphabet;
* lag-1 serial correlation of symbol values.

Fisher's method combines them to a p-value that is uniform for random data and
near zero for words. Among distinct runs of one encoding and one octave of
length, the share of p-values above one half tells how many runs are random
(Storey), hence how many of those above a cut are not. Each stratum uses the
smallest cut at which that false-discovery share is within bounds, so short
runs, where words pass more often, need more.

Runs are counted once however often they are copied. Strata and histogram bins
are few, and only they reach the driver.

Defined cases: a null text equals an empty one and has no spans; an empty table
gives an empty result; repeated rows are scanned row by row; other columns are
not read. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenload.scratch import materialize

#: The base patterns, in the order of their kinds.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: A run that the battery looks at.
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets by encoding, symbol classes of equal kind together.
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": DIGITS + "+/" + UPPER + LOWER,
    "base64url": DIGITS + "-_" + UPPER + LOWER,
}
BINS = 20

#: Matches that are listed at a time.
RUN_OF = 256

_PLACES = "array<struct<start: int, stop: int, found: string>>"


def places(text: Column, pattern: str, likely: str, keep: int = 0, shortest: int = 0) -> Column:
    """array of (start, stop, found): leftmost non-overlapping matches, in order.

    keep and shortest drop matches whose group keep is shorter than that. likely
    is a pattern that every kept match satisfies; texts without it are skipped.
    """
    # The text between matches and the matches give all positions; neither pattern matches an empty string.
    hit = F.regexp_like(text, F.lit(likely))
    # An array of one element binds the matches to a name, so a pattern runs twice over the text and not once for each use.
    cut = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    empty = F.array().cast(_PLACES)

    def long_enough(match: Column) -> Column:
        # A match alone matches as it did in its text, since no pattern looks around.
        return F.length(F.regexp_extract(match, pattern, keep)) >= shortest if shortest else F.lit(True)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["between"])
        end = begin + F.length(x["found"])
        place = F.struct(begin.alias("start"), end.alias("stop"), x["found"].alias("found"))
        more = F.when(long_enough(x["found"]), F.concat(acc["out"], F.array(place))).otherwise(acc["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    def listed(rows: Column) -> Column:
        # Lists grow by copying, so they grow to RUN_OF places and are strung together then.
        def stretch(acc: Column, nth: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), empty.alias("out"))
            return F.transform(
                F.array(F.aggregate(F.slice(rows, nth * RUN_OF + 1, F.lit(RUN_OF)), start, step)),
                lambda own: F.struct(own["at"].alias("at"), F.concat(acc["outs"], F.array(own["out"])).alias("outs")),
            )[0]

        stretches = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN_OF).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACES}>").alias("outs"))
        return F.flatten(F.aggregate(stretches, start, stretch, lambda acc: acc["outs"]))

    def zipped(pieces: Column) -> Column:
        found = pieces["found"]
        rows = F.arrays_zip(F.slice(pieces["between"], F.lit(1), F.size(found)).alias("between"), found.alias("found"))
        return F.when(F.size(found) > 0, F.transform(F.array(rows), listed)[0]).otherwise(empty)

    return F.when(hit, F.transform(F.array(cut), zipped)[0]).otherwise(empty)


def upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by a logistic fit that is good to 2e-4."""
    z = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _encoding(body: Column) -> Column:
    return (
        F.when(F.rlike(body, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "hex")
        .when(F.rlike(body, F.lit("^[A-Z2-7]+$")) & F.rlike(body, F.lit("[2-7]")), "base32")
        .when(F.rlike(body, F.lit("^([a-z0-9]+|[A-Z0-9]+)$")) & F.rlike(body, F.lit("[0-9]")), "base36")
        .when(F.rlike(body, F.lit("[+/]")), "base64")
        .when(F.rlike(body, F.lit("[-_]")), "base64url")
        .otherwise("base62")
    )


def _values(encoding: Column, body: Column) -> Column:
    """Each symbol's place in the alphabet, or -1."""
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), encoding)
    own = F.when(encoding.isin("hex", "base36"), F.lower(body)).otherwise(body)
    return F.transform(F.filter(F.split(own, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)


def _alphabet_p(v: Column, n: Column, k: Column) -> Column:
    """Uniformity by symbol (sparse cells: exact mean and variance) and by class of symbol."""
    counts = F.transform(F.array_distinct(v), lambda d: F.size(F.filter(v, lambda x: x == d)).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    x2 = k / n * squares - n
    by_symbol = upper_tail((x2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    # Two classes below 62 symbols (letters and the rest), else three (lower, upper and the rest).
    low = F.size(F.filter(v, lambda x: x >= k - 26)).cast("double")
    rest = F.size(F.filter(v, lambda x: x < k - 52)).cast("double")
    split3 = [(low, n * 26 / k), (n - low - rest, n * 26 / k), (rest, n * (k - 52) / k)]
    three = sum(((o - e) * (o - e) / e for o, e in split3), F.lit(0.0))
    head = F.when(k == 32, 26).otherwise(10)
    first = F.size(F.filter(v, lambda x: x < head)).cast("double")
    e = n * head / k
    two = (first - e) * (first - e) / e + (first - e) * (first - e) / (n - e)
    by_class = F.when(k >= 62, F.exp(-three / 2)).otherwise(2 * upper_tail(F.sqrt(two)))
    return F.least(F.lit(1.0), 2 * F.least(by_symbol, by_class))


def _runs_p(v: Column, n: Column, k: Column) -> Column:
    """Changes between the halves of the alphabet against a fair coin."""
    pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: (2 * a >= k) != (2 * b >= k))
    changes = F.size(F.filter(pairs, lambda x: x))
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)))


def _serial_p(v: Column, n: Column, k: Column) -> Column:
    """Lag-1 correlation of symbol values around the alphabet's mean."""
    mean, variance = (k - 1) / 2, (k * k - 1) / 12
    pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: (a - mean) * (b - mean))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(total / (variance * F.sqrt(n - 1)))))


def battery(found: Column) -> Column:
    """array of (start, stop, hash, encoding, octave, p) for an array of places."""
    bodies = F.transform(
        found,
        lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.regexp_replace(c["found"], "=+$", "").alias("body")),
    )
    named = F.transform(bodies, lambda c: F.struct(c["start"], c["stop"], c["body"], _encoding(c["body"]).alias("encoding")))
    valued = F.transform(
        named,
        lambda c: F.struct(
            c["start"], c["stop"], F.xxhash64(c["body"]).alias("hash"), c["encoding"],
            _values(c["encoding"], c["body"]).alias("v"),
            F.length(c["body"]).cast("double").alias("n"),
            F.element_at(F.create_map(*[F.lit(x) for e, a in ALPHABETS.items() for x in (e, float(len(a)))]), c["encoding"]).alias("k"),
        ),
    )
    tested = F.transform(
        valued,
        lambda c: F.struct(
            c["start"], c["stop"], c["hash"], c["encoding"],
            F.floor(F.log2(c["n"])).cast("int").alias("octave"),
            sum((F.log(F.greatest(F.lit(1e-18), t(c["v"], c["n"], c["k"]))) for t in (_alphabet_p, _runs_p, _serial_p)), F.lit(0.0)).alias("x"),
        ),
    )
    # Fisher: minus the sum of logarithms is half a chi-squared of six degrees of freedom.
    return F.transform(
        tested,
        lambda c: F.struct(
            c["start"], c["stop"], c["hash"], c["encoding"], c["octave"],
            (F.exp(c["x"]) * (1 - c["x"] + c["x"] * c["x"] / 2)).alias("p"),
        ),
    )


def cuts(runs: DataFrame, share: float) -> dict[tuple[str, int], float]:
    """The smallest cut of each stratum (encoding, octave) that keeps false discoveries within share."""
    distinct = runs.groupBy("hash", "encoding", "octave").agg(F.first("p").alias("p"))
    bins = distinct.groupBy(
        "encoding", "octave", F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int").alias("bin")
    ).agg(F.count("*").alias("n"))
    strata: dict[tuple[str, int], list[int]] = {}
    for r in bins.collect():  # strata times bins
        strata.setdefault((r.encoding, r.octave), [0] * BINS)[r.bin] += r.n
    out: dict[tuple[str, int], float] = {}
    for key, counts in strata.items():
        random = sum(counts[BINS // 2 :]) / 0.5
        for b in range(BINS // 2 + 1):
            above = sum(counts[b:])
            expected = random * (1 - b / BINS)
            # The lowest bin is never taken: there a true random run is rejected with a chance of 1 / BINS.
            if b and above and 1 - expected / above <= share:
                out[key] = b / BINS
                break
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.1) -> DataFrame:
    """A row per document: id and spans, an array of (start, rank, stop, kind) by start, then kind.

    rank is the kind's place in KINDS; share bounds the false discoveries among random spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def base(rank: int, found: Column) -> Column:
        return F.transform(
            found,
            lambda c: F.struct(
                c["start"].alias("start"), F.lit(rank).alias("rank"), c["stop"].alias("stop"), F.lit(KINDS[rank]).alias("kind")
            ),
        )

    # Runs of hex digits and of capitals after AKIA are maximal, so their shortest length can stand in the pattern.
    slim = materialize(
        docs.select(F.col(id_col), text.alias("_t")).select(
            id_col,
            F.concat(
                base(0, places(F.col("_t"), ASSIGN, r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", 1, 8)),
                base(1, places(F.col("_t"), ACCESS.replace("+", "{12,}"), "AKIA")),
                base(2, places(F.col("_t"), HEX.replace("+", "{32,}"), "[0-9a-f]{32}")),
            ).alias("base"),
            battery(places(F.col("_t"), RUN, RUN[:-6])).alias("runs"),
        ),
        "spans",
    )
    cut = cuts(slim.select(F.explode("runs").alias("r")).select("r.*"), share)
    least = F.create_map(*[F.lit(x) for (e, o), c in cut.items() for x in (f"{e}:{o}", c)]) if cut else F.create_map(F.lit(""), F.lit(2.0))
    random = F.filter(
        "runs",
        lambda r: r["p"] >= F.coalesce(F.try_element_at(least, F.concat(r["encoding"], F.lit(":"), r["octave"].cast("string"))), F.lit(2.0)),
    )
    added = F.transform(
        random,
        lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("rank"), r["stop"].alias("stop"), F.lit(KINDS[3]).alias("kind")),
    )
    return slim.select(id_col, F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
