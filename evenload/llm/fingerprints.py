"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its s-mers lies
at its first or its last place. That depends on the k-mer alone, so two texts
that share a passage share the anchors inside it, wherever the passage stands.
A text's fingerprint is the hashes of all its anchors in the order of their
positions. Likeness matches equal anchors that stand in the same order in both
texts, as many as can be (a longest common subsequence), and divides them by the
anchors of both together, matched ones counted once.

Defined cases: a text without syncmers, as all shorter than k and some up to 23
code points are, has one anchor, the whole text; a null or empty text has none and the empty fingerprint; likeness is 1 for two empty
fingerprints and 0 for one; rows that repeat an id follow each other ordered by
text hash; null ids come last; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenload.llm.words import batches, mix64
from evenload.plans.placement import decided
from evenload.scratch import shuffle_partitions

S, PARTS = 5, 3
K, WINDOW = S * PARTS, S * PARTS - S + 1
#: No limit: a fingerprint holds every anchor.
SKETCH = None


def anchors(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and 32-bit hashes of each text's closed syncmers."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in batches(texts, 1 << 18):
        out += _anchors(texts[a:b])
    return out


def _anchors(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    n = len(points) - K + 1
    if n > 0:
        inner = np.zeros(len(points) - S + 1, np.uint32)
        for j in range(S):
            inner = inner * np.uint32(0x01000193 * 5) + points[j : len(points) - S + 1 + j]
        inner ^= inner >> np.uint32(15)
        inner *= np.uint32(0x2C1B3C6D)
        inner ^= inner >> np.uint32(12)
        inner *= np.uint32(0x297A2D39)
        inner ^= inner >> np.uint32(15)
        least, width = inner, 1
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WINDOW:
            least = np.minimum(least[: n], least[WINDOW - width : WINDOW - width + n])
        chosen = np.flatnonzero((inner[:n] == least) | (inner[WINDOW - 1 : WINDOW - 1 + n] == least))
        whole = np.zeros(len(chosen), np.uint64)
        for p in range(PARTS):
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + inner[chosen + p * S]
        hashes = (mix64(whole) >> np.uint64(32)).astype(np.uint32)
        first = np.searchsorted(chosen, bounds[:-1])
        last = np.searchsorted(chosen, bounds[1:] - K, side="right")
    out = []
    for i, t in enumerate(texts):
        if len(t) >= K:
            at = slice(first[i], last[i])
            out.append((chosen[at] - bounds[i], hashes[at]))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint32)))
        if t and not len(out[-1][0]):
            digest = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=4).digest()
            out[-1] = (np.zeros(1, np.int64), np.frombuffer(digest, np.uint32))
    return out


def sketches(texts: Sequence[str]) -> list[np.ndarray]:
    """The anchor hashes of each text by position."""
    return [h for _, h in anchors(texts)]


def as_string(sketch: np.ndarray) -> str:
    """A fingerprint: eight hex digits per hash."""
    return sketch.astype(">u4").tobytes().hex()


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """The length of a longest common subsequence."""
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b, n = a[head:], b[head:], n - head
    tail = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    common = np.intersect1d(a, b)
    a, b = a[np.isin(a, common)], b[np.isin(b, common)]
    if not len(common):
        return head + tail
    if len(a) == len(b) == len(common):  # nothing repeats: a longest increasing subsequence of places
        place = np.empty(len(b), np.int64)
        place[np.searchsorted(common, a)] = np.arange(len(a))
        ends: list[int] = []
        for x in place[np.searchsorted(common, b)].tolist():
            k = bisect_left(ends, x)
            ends[k : k + 1] = [x]
        return head + tail + len(ends)
    # Bit-parallel: a zero at bit j says that the subsequence grows at b[j].
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    repeated = {x: sum(1 << j for j in at) for x, at in places.items() if len(at) > 1}
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & (repeated[x] if x in repeated else 1 << places[x][0])
        row = ((row + hit) | (row - hit)) & full
    return head + tail + len(b) - row.bit_count()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of anchors that match in order among those of both fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = matched(a, b)
    return both / (len(a) + len(b) - both)


def fingerprint(text: Column) -> Column:
    """struct(fingerprint, positions, hashes) of a text: all its anchors, as one string and as lists."""

    @F.arrow_udf("struct<fingerprint: string, positions: array<int>, hashes: array<bigint>>")
    def printed(column: pa.Array) -> pa.Array:
        found = anchors([t or "" for t in column.to_pylist()])
        return pa.StructArray.from_arrays(
            [
                pa.array([as_string(h) for _, h in found], pa.string()),
                pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())),
                pa.array([h.astype(np.int64) for _, h in found], pa.list_(pa.int64())),
            ],
            ["fingerprint", "positions", "hashes"],
        )

    return printed(text)


NEAR = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results for all but the last text, which only serves as the next of the one before."""
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:], strict=False)]
    own, other = sketches(texts), sketches(edited)
    return pa.RecordBatch.from_pydict(
        {
            "id": pa.array(ids[:-1], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            "fingerprint": pa.array([as_string(s) for s in own[:-1]], pa.string()),
            "edited_fingerprint": pa.array([as_string(s) for s in other], pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        }
    )


def near_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text and against the next document.

    Documents are ordered by descending id; the next of the last is the first.
    One shuffle deals texts to ranges of ids; the first document of each range
    is dealt a second time, to the end of the range before it, so every range
    can be streamed on its own.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    bounds = sorted(set(rows.agg(F.percentile_approx("id", shares, 10_000).alias("b")).first().b or []))
    # Descending ids: range i has the ids below i of the bounds; nulls come last.
    falling = bounds[::-1]
    below = decided(F.col("id"), falling, F.lit, lambda v, b: v >= F.lit(b))
    span = F.when(F.col("id").isNull(), F.lit(len(bounds))).otherwise(below)
    ranged = rows.withColumn("span", span.cast("int"))
    heads = sorted((r.span, r.id) for r in ranged.groupBy("span").agg(F.max("id").alias("id")).collect())  # a row a range
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    places = [F.lit(x) for h, place in before.items() if h is not None for x in (h, place)]
    to = F.try_element_at(F.create_map(*places), F.col("id")) if places else F.lit(None).cast("int")
    if None in before:
        to = F.when(F.col("id").isNull(), F.lit(before[None])).otherwise(to)
    known = [h for h in before if h is not None]
    is_head = F.col("id").isin(known) if known else F.lit(False)
    if None in before:
        is_head = is_head | F.col("id").isNull()
    ahead = rows.where(is_head).withColumn("span", to.cast("int")).withColumn("ahead", F.lit(True))
    dealt = (
        ranged.withColumn("ahead", F.lit(False))
        .unionByName(ahead)
        .repartitionById(len(bounds) + 1, F.col("span"))
        .sortWithinPartitions("ahead", F.desc_nulls_last("id"), F.xxhash64("text"))
    )

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, ended, size = [], [], False, 0
        for part in parts:
            for i, t, is_ahead in zip(*(part.column(c).to_pylist() for c in ("id", "text", "ahead")), strict=True):
                if ended:
                    break
                ids.append(i)
                texts.append(t)
                ended = is_ahead
                size += len(t)
                if len(texts) > 512 or len(texts) > 1 and size > 1 << 22:
                    yield _rows(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if len(texts) > 1:
            yield _rows(ids, texts)

    return dealt.mapInArrow(stream, f"id long, {NEAR}").withColumnRenamed("id", id_col)
