"""MinHash near-dedup by improved consistent weighted sampling.

Documents with equal texts are one vertex, named by the text's MD5. A text's items
are its shingles of five lower-cased words without punctuation, weighted by count
times inverse document frequency.

1. Frequencies: each shingle's document frequency is exact. Documents are dealt in
   chunks; a chunk asks for its distinct shingles, in sorted runs of 64-bit hashes
   by hash range; a range merges the runs of all chunks, sums the documents and
   answers each run in its order. An answer is a bit for a shingle that no other
   document holds and a number for any other, so little travels back.
2. Sketch: improved consistent weighted sampling (Ioffe) draws one (shingle,
   level) per hash function; two texts agree in a draw with the probability of
   their weighted Jaccard similarity.
3. Bands: equal runs of draws meet in buckets. A bucket is compared by whole
   sketches; a spanning forest of the pairs whose estimate comes within reach of the
   threshold is all that leaves it. The members of a bucket beyond a block are linked
   without that comparison, which only lets more pairs through.
4. Verification: within each estimated family, weighted Jaccard similarities are
   exact (products of item matrices); a spanning forest of the pairs at or above the
   threshold leaves. A large family is cut into blocks, compared within each and with
   some pivots first; then every text outside its largest part meets all blocks,
   so the work grows with the texts and with those that stay apart, not with pairs.
5. Classes: connected components; the smallest id stands for a class.

Nothing is capped: every pair that shares a band and whose sketches agree
closely enough is verified with, or connected through, verified pairs. Pairs
are never listed, only forests, so rows grow with texts and not with pairs.

Defined cases: a text of one to four words has one shingle of all of them; a
null text equals an empty one; texts without words match only equal texts; very
long texts are read whole and are a chunk of their own; a
null id never represents a class that has another id; repeated rows are copies;
an empty table gives an empty result; other columns, whatever their names, pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenload.llm.components import components, salted, sized, told_by_key
from evenload.llm.words import batches, hash_words, mix64, shingles
from evenload.scratch import discard, materialize, shuffle_partitions

WORDS, THRESHOLD = 5, 0.8
BANDS, DRAWS = 16, 4
#: A pair is verified if its sketches agree in so many draws: five standard deviations below the threshold.
REACH = THRESHOLD - 5 * float(np.sqrt(THRESHOLD * (1 - THRESHOLD) / (BANDS * DRAWS)))
SKETCH_BLOCK, TEXT_BLOCK, PIVOTS = 4096, 256, 8
#: Bytes of text in a chunk and shingles in a hash range: they grow with the root of the corpus, between these bounds.
CHUNK, RANGE = (1 << 18, 1 << 23), (1 << 16, 1 << 20)


def items(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text, sorted, and their counts."""
    for a, b in batches(texts):
        hashes, offsets = hash_words(texts[a:b], bare=True)
        for i in range(b - a):
            yield np.unique(shingles(hashes[offsets[i] : offsets[i + 1]], WORDS), return_counts=True)


def text_key(text: Column) -> Column:
    """The 128-bit name of a text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit hashes in six bytes each: differences, or all eight bytes where one is too large."""
    steps = np.diff(values, prepend=np.uint64(0))
    if len(values) > 1 and int(steps[1:].max()) < 1 << 48:
        narrow = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        return b"\1" + values[:1].astype("<u8").tobytes() + narrow.tobytes()
    return b"\0" + values.astype("<u8").tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    """The hashes that pack_sorted packed."""
    if data[0] == 0:
        return np.frombuffer(data, "<u8", offset=1).astype(np.uint64)
    narrow = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    steps = np.zeros((len(narrow) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, offset=1)
    steps[1:, :6] = narrow
    return np.cumsum(steps.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Positive counts: their number, a bit for each that is above 1, those in a byte (255: more), and the larger ones."""
    more = counts > 1
    some = counts[more]
    return b"".join(
        [
            np.uint32(len(counts)).tobytes(), np.packbits(more).tobytes(), np.minimum(some, 255).astype(np.uint8).tobytes(),
            some[some >= 255].astype("<u8").tobytes(),
        ]
    )


def unpack_counts(data: bytes) -> np.ndarray:
    """The counts that pack_counts packed."""
    n = int.from_bytes(data[:4], "little")
    width = (n + 7) // 8
    more = np.unpackbits(np.frombuffer(data, np.uint8, width, offset=4), count=n).astype(bool)
    held = int(more.sum())
    some = np.frombuffer(data, np.uint8, held, offset=4 + width).astype(np.int64)
    some[some == 255] = np.frombuffer(data, "<u8", offset=4 + width + held).astype(np.int64)
    out = np.ones(n, np.int64)
    out[more] = some
    return out


def layout(n_bytes: int, partitions: int) -> tuple[int, int]:
    """Numbers of chunks and of hash ranges for so many bytes of text. They decide where rows meet, not what comes out."""
    scale = sqrt(max(1, n_bytes) * 16384.0)
    chunk = min(CHUNK[1], max(CHUNK[0], scale))
    within = min(RANGE[1], max(RANGE[0], scale / 3))
    few = min(2 * partitions, ceil(n_bytes / CHUNK[0]))
    return max(1, few, ceil(n_bytes / chunk)), max(1, few, ceil(n_bytes / 6 / within))


def answered(dealt: DataFrame, ranges: int) -> DataFrame:
    """Rows (chunk, part, held): the packed document frequencies of a chunk's distinct shingles, hash range by hash range.

    dealt: rows (chunk long, text), rows of a chunk together.
    """

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(parts, ["chunk"]):
            own = [s for s, _ in items(table.column("text").to_pylist())]
            hashes, docs = np.unique(np.concatenate(own), return_counts=True)
            if not len(hashes):
                continue
            part = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part[a] for a, _ in spans], pa.int64()),
                    "chunk": pa.array([table.column("chunk")[0].as_py()] * len(spans), pa.int64()),
                    "run": pa.array([pack_sorted(hashes[a:b]) for a, b in spans], pa.binary()),
                    "docs": pa.array([pack_counts(docs[a:b]) for a, b in spans], pa.binary()),
                }
            )

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(parts, ["part"]):
            runs = [unpack_sorted(x) for x in table.column("run").to_pylist()]
            docs = np.concatenate([unpack_counts(x) for x in table.column("docs").to_pylist()])
            hashes = np.concatenate(runs)
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            held = np.empty(len(hashes), np.int64)
            held[order] = np.repeat(np.add.reduceat(docs[order], starts), np.diff(np.append(starts, len(hashes))))
            cuts = np.cumsum([0, *map(len, runs)])
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("chunk").combine_chunks(), table.column("part").combine_chunks(),
                    pa.array([pack_counts(held[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                ],
                ["chunk", "part", "held"],
            )

    asked = dealt.mapInArrow(ask, "part long, chunk long, run binary, docs binary")
    met = asked.repartition("part").sortWithinPartitions("part", "chunk")
    return met.mapInArrow(answer, "chunk long, part long, held binary")


def inverse_frequencies(held: np.ndarray, n: int) -> np.ndarray:
    """1 + ln((1 + n) / (1 + df)) / ln(2 + n) for document frequencies among n documents: from 1 (in every one) to 2.

    The logarithm's scale is that of a shingle in one document, so a boilerplate
    shingle counts for less than a rare one but edits of a copy, whose shingles are
    always rare, do not outweigh what is left.
    """
    return (1 + np.log((1 + n) / (1 + np.minimum(held, n))) / np.log(2 + n)).astype(np.float32)


def _quantiles(n: int) -> np.ndarray:
    """The quantiles of Gamma(2, 1) at the middles of n equal parts, by Newton steps."""
    p = (np.arange(n) + 0.5) / n
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x / 4, x - (1 - np.exp(-x) * (1 + x) - p) / (x * np.exp(-x)))
    return x


_GAMMA = _quantiles(1 << 12).astype(np.float32)
_INVERSE = (1 / _GAMMA).astype(np.float32)
_LOG_GAMMA = np.log(_quantiles(1 << 16)).astype(np.float32)
_SEEDS = mix64(np.arange(1, BANDS * DRAWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(shingle: np.ndarray, log_weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One draw per hash function for each segment of items: 32 bits that name (shingle, level)."""
    out = np.empty((len(starts), len(_SEEDS)), np.uint32)
    for k, seed in enumerate(_SEEDS):
        x = shingle * seed
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        r = (x >> np.uint64(52)).astype(np.int32)
        beta = ((x >> np.uint64(28)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        gamma = _GAMMA[r]
        level = np.floor(log_weight * _INVERSE[r] + beta)
        rank = _LOG_GAMMA[(x & np.uint64(0xFFFF)).astype(np.int32)] - gamma * (level - beta + np.float32(1))
        name = (x >> np.uint64(16)) + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        name = (name * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)
        order = np.clip((rank + np.float32(512)) * np.float32(1 << 21), 0, 2**32 - 256).astype(np.uint64)
        out[:, k] = np.minimum.reduceat(order << np.uint64(32) | name, starts).astype(np.uint32)
    return out


def spanning_forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of n rows; near(i, others) says which others are linked to row i."""
    links: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = int(frontier.pop())
            hit = near(i, left)
            links += [(i, int(j)) for j in left[hit]]
            frontier += left[hit].tolist()
            left = left[~hit]
    return links


def by_group(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for part in parts:
        if not part.num_rows:
            continue
        table = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((np.diff(table, axis=1) != 0).any(0)) + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(table[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def sketched(base: DataFrame, answers: DataFrame, chunk: Column, n_docs: int) -> DataFrame:
    """Rows (_id, node, draws, held) from (_id, node, text): draws as little-endian bytes, null for a text without words.

    held packs the document frequencies of the text's distinct shingles, by hash.
    """
    rows = base.select(
        chunk.alias("chunk"), F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("held"), "_id", "node", "text"
    )
    told = answers.select(
        "chunk", F.col("part"), "held", F.lit(None).cast(base.schema["_id"].dataType).alias("_id"),
        F.lit(None).cast("binary").alias("node"), F.lit(None).cast("string").alias("text"),
    )
    # Answers have no node, so they come first in their chunk.
    dealt = told.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", "node", "part")

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(parts, ["chunk"]):
            n_told = table.column("node").null_count
            told, own = table.slice(0, n_told), table.slice(n_told)
            if not own.num_rows:
                continue
            held = [unpack_counts(x) for x in told.column("held").to_pylist()]
            found = list(items(own.column("text").to_pylist()))
            flat = np.concatenate([s for s, _ in found])
            names, at = np.unique(flat, return_inverse=True)
            df = np.concatenate([np.zeros(0, np.int64), *held])
            if len(df) != len(names):
                raise ValueError("frequencies do not fit their chunk")
            df = df[at]
            log_weight = np.log(inverse_frequencies(df, n_docs) * np.concatenate([c for _, c in found]).astype(np.float32))
            sizes = np.array([len(s) for s, _ in found])
            cuts = np.cumsum([0, *sizes])
            draws: list[bytes | None] = [None] * len(found)
            for group in grouped(sizes, 1 << 15):
                first, last = cuts[group[0]], cuts[group[-1] + 1]
                full = [i for i in group if sizes[i]]
                if full:
                    rows = sketch(flat[first:last], log_weight[first:last], cuts[full] - first)
                    for i, row in zip(full, rows, strict=True):
                        draws[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("_id").combine_chunks(), own.column("node").combine_chunks(), pa.array(draws, pa.binary()),
                    pa.array([pack_counts(df[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                ],
                ["_id", "node", "draws", "held"],
            )

    schema = T.StructType([base.schema["_id"], base.schema["node"], T.StructField("draws", T.BinaryType()), T.StructField("held", T.BinaryType())])
    return dealt.mapInArrow(draw, schema)


def grouped(sizes: np.ndarray, most: int) -> Iterator[list[int]]:
    """Consecutive numbers whose sizes add up to about most."""
    held, total = [], 0
    for i, size in enumerate(sizes.tolist()):
        held.append(i)
        total += size
        if total > most:
            yield held
            held, total = [], 0
    if held:
        yield held


LINKS = "a binary, b binary"


def _links(nodes: list[bytes], found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([nodes[i] for i, _ in found], pa.binary()), pa.array([nodes[j] for _, j in found], pa.binary())], ["a", "b"]
    )


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, draws) that share a band and whose sketches agree within reach.

    A bucket beyond SKETCH_BLOCK is cut into blocks whose members are linked to their
    first one, and the first ones in a chain: all of it is a candidate.
    """
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("draws"), b * (DRAWS * 4) + 1, F.lit(DRAWS * 4))),
    )
    members = sized(nodes.select("node", F.explode(bands).alias("band")), "band", least=2)
    dealt = materialize(
        members.select(
            "band", "node", (F.col("size") > SKETCH_BLOCK).alias("big"),
            F.pmod(F.xxhash64("node", F.lit(11)), F.ceil(F.col("size") / SKETCH_BLOCK)).alias("block"),
        ),
        "bands",
    )
    keys = ["band", "block"]

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(parts, keys):
            draws = np.frombuffer(b"".join(table.column("draws").to_pylist()), np.uint32).reshape(table.num_rows, -1)
            least = REACH * draws.shape[1]
            if table.column("big")[0].as_py():
                found = [(0, j) for j in range(1, len(draws))]
            else:
                found = spanning_forest(len(draws), lambda i, left: (draws[left] == draws[i]).sum(1) >= least)
            if found:
                yield _links(table.column("node").to_pylist(), found)

    met = dealt.join(nodes, "node").repartition(*keys).sortWithinPartitions(*keys, "node")
    within = met.select(*keys, "big", "node", "draws").mapInArrow(compare, LINKS)
    heads = dealt.where("big").groupBy(*keys).agg(F.min("node").alias("a"))
    chain = heads.select("a", F.expr("lead(a) over (partition by band order by block)").alias("b")).where("b is not null")
    return within.unionByName(chain)


def similar(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose weighted Jaccard similarity reaches the threshold.

    rows: shingles, counts and inverse frequencies. A shingle that occurs c times is
    c items of weight idf, which makes the sum of minima a sum over common items;
    items that only one row has never meet.
    """
    n = len(rows)
    flat = np.concatenate([s for s, _, _ in rows])
    counts = np.concatenate([c for _, c, _ in rows])
    weight = np.concatenate([w for _, _, w in rows]).astype(np.float64)
    row = np.repeat(np.arange(n), [len(s) for s, _, _ in rows])
    total = np.bincount(row, weights=weight * counts, minlength=n)
    times = np.repeat(np.arange(len(flat)), counts)
    nth = np.arange(len(times)) - np.repeat(np.cumsum(counts) - counts, counts)
    item = flat[times] + mix64(nth.astype(np.uint64) + np.uint64(1)) * (nth > 0)
    _, column, seen = np.unique(item, return_inverse=True, return_counts=True)
    common = seen[column] > 1
    order = np.argsort(column[common], kind="stable")
    column, at = column[common][order], times[common][order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    overlap = np.zeros((n, n))
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((n, width))
        part[row[at[a:b]], column[a:b] - first] = np.sqrt(weight[at[a:b]])
        overlap += part @ part.T
    union = total[:, None] + total[None, :] - overlap
    return spanning_forest(n, lambda i, left: overlap[i, left] >= (threshold - 1e-9) * union[i, left])


def compared(dealt: DataFrame, keys: list[str], n_docs: int, threshold: float) -> DataFrame:
    """Links (a, b) between rows (keys, node, text, held) of equal keys with exact similarity at or above the threshold."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(parts, keys):
            held = [inverse_frequencies(unpack_counts(x), n_docs) for x in table.column("held").to_pylist()]
            rows = [(s, c, w) for (s, c), w in zip(items(table.column("text").to_pylist()), held, strict=True)]
            found = similar(rows, threshold)
            if found:
                yield _links(table.column("node").to_pylist(), found)

    columns = [*keys, "node", "text", "held"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "node").select(*columns).mapInArrow(compare, LINKS)


def verified_links(families: DataFrame, n_docs: int, threshold: float, block: int | None = None) -> DataFrame:
    """Links (a, b) with exact similarity at or above the threshold that connect what is connected in a family.

    families: rows (family, size, node, text, held), one per node. Two rows of a
    family up to block rows always meet. A larger one is cut into blocks, each with
    some pivots of the family; what that does not join to the family's largest part
    meets every block.
    """
    block = block or TEXT_BLOCK
    rows = families.select(
        F.xxhash64("family").alias("fam"), "node", "text", "held",
        F.ceil(F.col("size") / block).cast("int").alias("blocks"),
    ).withColumn("b", F.expr("cast(pmod(xxhash64(node, 11), blocks) as int)"))
    rows = materialize(rows, "families")
    big = rows.where("blocks > 1")
    if not big.limit(1).count():
        return compared(rows, ["fam", "b"], n_docs, threshold)
    pivots = big.groupBy("fam", F.pmod(F.xxhash64("node", F.lit(17)), F.lit(PIVOTS))).agg(F.min("node").alias("node"))
    everywhere = big.join(pivots.select("node"), "node", "left_semi").withColumn("own", F.col("b"))
    visiting = everywhere.withColumn("b", F.explode(F.expr("sequence(0, blocks - 1)"))).where("b <> own").drop("own")
    first = materialize(compared(rows.unionByName(visiting), ["fam", "b"], n_docs, threshold), "links")
    named = big.select("fam", "node").join(components(first), "node", "left").select(
        "fam", "node", F.coalesce("component", "node").alias("component")
    )
    parts = salted(named)
    counts = parts.groupBy("fam", "component", "_salt").agg(F.count("*").alias("n"))
    whole = counts.groupBy("fam", "component").agg(F.sum("n").alias("n"))
    largest = whole.groupBy("fam").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
    apart = counts.join(largest, "fam").where("component <> top.component").select(
        "component", "_salt", F.expr(f"cast(ceil((size - top.n) / {block}D) as int)").alias("groups")
    )
    rest = materialize(parts.join(apart, ["component", "_salt"]).select("fam", "node", "groups"), "apart")
    groups = rest.groupBy("fam").agg(F.max("groups").alias("groups"))
    asking = big.join(rest.select("node", "groups"), "node").withColumns(
        {"g": F.expr("cast(pmod(xxhash64(node, 13), groups) as int)"), "b": F.explode(F.expr("sequence(0, blocks - 1)"))}
    )
    asked = big.join(groups, "fam").withColumn("g", F.explode(F.expr("sequence(0, groups - 1)")))
    columns = ["fam", "b", "g", "node", "text", "held"]
    met = asking.select(*columns).unionByName(asked.select(*columns)).dropDuplicates(["fam", "b", "g", "node"])
    return first.unionByName(compared(met, ["fam", "b", "g"], n_docs, threshold))


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (_id, node, class_id) for every document: node names its text, class_id the class's smallest id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text_key(text).alias("node"), text.alias("text"))
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()
    chunks, ranges = layout(n_bytes, shuffle_partitions(docs.sparkSession))
    chunk = F.pmod(F.xxhash64("node", "_id"), F.lit(chunks).cast("long"))
    dealt = base.select(chunk.alias("chunk"), "text").repartition("chunk").sortWithinPartitions("chunk")
    answers = materialize(answered(dealt, ranges), "frequencies")
    slim = materialize(sketched(base, answers, chunk, n_docs), "sketches")
    discard(answers)
    texts = materialize(
        slim.groupBy("node").agg(F.min("_id").alias("least"), F.first("draws").alias("draws"), F.first("held").alias("held")), "texts"
    )
    found = components(candidate_links(texts.where("draws is not null").select("node", "draws")))
    families = sized(found, "component").join(texts.select("node", "least", "held"), "node").select(
        F.col("component").alias("family"), "size", "node", F.col("least").alias("_id"), "held"
    )
    here = base.select(F.col("_id").alias("_own"), F.col("node").alias("_node"), "text")
    with_text = (
        here.join(families, (F.col("_node") == F.col("node")) & F.col("_own").eqNullSafe(F.col("_id")))
        .dropDuplicates(["_node", "_own"])
        .select("family", "size", "node", "text", "held")
    )
    linked = components(verified_links(with_text, n_docs, threshold))
    merged = linked.join(texts.select("node", "least"), "node")
    least = merged.groupBy("component").agg(F.min("least").alias("class_id"))
    smallest = told_by_key(merged.select("node", "component"), least, "component", "node").select("node", "class_id")
    named = texts.select("node", "least").join(smallest, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id"))
    return told_by_key(slim.select("_id", "node"), named, "node", "_id").select("_id", "node", "class_id")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that with the smallest id; the columns stay.

    A class without any id keeps one row of each text.
    """
    named = classes(docs, id_col=id_col, text_col=text_col)

    def key(column: Column) -> Column:
        return F.coalesce(column.cast("long"), F.lit(-(2**63)))

    kept = named.where("_id <=> class_id").select(key(F.col("_id")).alias("_key"), F.col("node").alias("_node")).distinct()
    node = text_key(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.struct(*docs.columns).alias("_row"), key(F.col(id_col)).alias("_key"), node.alias("_node"))
    return own.join(kept, ["_key", "_node"]).dropDuplicates(["_key", "_node"]).select("_row.*")
