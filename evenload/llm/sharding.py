"""Sharding into contiguous shards of near equal bytes: a minimax partition.

Equal texts are one atomic group (their 64-bit text hash; a collision only
joins two groups). The order of groups is fixed: those of an equal share or more come first, the
largest first, then all others by hash. The smallest capacity for which a greedy
left-to-right filling needs no more shards than there are is found by binary
search. Under that capacity each cut falls where the shard before it comes nearest
to an equal share of what is left, as long as the rest still fits; so no shard is
empty while groups remain.

The search never sees all groups. It starts from sums over cells of leading
hash bits. An unresolved cell is bounded from both sides: as if it could be cut
anywhere, and as if it could not be cut. Cells where cuts may fall are refined
by 8 bits a round until both bounds give one capacity, which is then exact, and
until every cut lies between resolved cells. The driver holds a bounded number of
cell sums; groups and documents stay.

Slots number the documents of a shard without gaps: counts of hash buckets of
the row give offsets, and a row number within a bucket the rest. The number of
buckets follows the number of rows, so a table always gets the same slots.

Defined cases: a null text has size 1 and equals an empty text; a text of any length
is one row of its group; repeated rows are separate documents of one group, with ties in
any order; a null id is an id like any other; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenload.scratch import materialize

FIRST_BITS, MORE_BITS = 14, 8
#: Rows of a shard that one bucket of slots holds, about.
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Cell:
    """Groups whose signed hash starts with the same bits; of 64 bits, one group. Heavy ones come before all others."""

    prefix: int
    bits: int
    size: int
    largest: int
    groups: int
    heavy: bool = False

    @property
    def start(self) -> int:
        return self.prefix << (64 - self.bits)

    @property
    def whole(self) -> bool:
        return self.groups == 1 or self.bits == 64


def fill(cells: list[Cell], capacity: int, fluid: bool) -> list[int] | None:
    """Greedy filling: the cell where each new shard begins (None: a cell does not fit).

    fluid: unresolved cells can be cut anywhere, else nowhere.
    """
    cuts: list[int] = []
    room = capacity
    for i, c in enumerate(cells):
        rest = c.size
        if fluid and not c.whole:
            if c.largest > capacity:
                return None
            while rest > room:
                rest -= room
                room = capacity
                cuts.append(i)
            room -= rest
            continue
        if rest > capacity:
            return None
        if rest > room:
            cuts.append(i)
            room = capacity
        room -= rest
    return cuts


def smallest(cells: list[Cell], shards: int, fluid: bool) -> int:
    """The smallest capacity for which fill needs at most that many shards."""
    low, high = max((c.largest for c in cells), default=1), sum(c.size for c in cells)
    while low < high:
        mid = (low + high) // 2
        cuts = fill(cells, mid, fluid)
        if cuts is not None and len(cuts) < shards:
            high = mid
        else:
            low = mid + 1
    return high


def even_cuts(cells: list[Cell], shards: int, capacity: int) -> list[int]:
    """The cells where shards after the first begin: as even as they can be cut in turn, none above capacity.

    The capacity must be feasible for whole cells.
    """
    sums = [0, *accumulate(c.size for c in cells)]
    n, shards = len(cells), min(shards, len(cells))
    latest = [n] * shards  # latest[j]: the first cell of the last j shards when they are filled from the right
    for j in range(1, shards):
        latest[j] = bisect_left(sums, sums[latest[j - 1]] - capacity)
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        low = max(at + 1, latest[left - 1])
        high = min(bisect_right(sums, sums[at] + capacity) - 1, n - left + 1)
        goal = sums[at] + (sums[n] - sums[at]) / left
        near = bisect_left(sums, goal, low, high + 1)
        near = min((p for p in (near - 1, near) if low <= p <= high), key=lambda p: abs(sums[p] - goal))
        cuts.append(near)
        at = near
    return cuts


def boundaries(groups: DataFrame, shards: int, heavy: Sequence[tuple[int, int]] = ()) -> tuple[int, dict[int, int], list[int]]:
    """The exact minimax capacity, the shards of heavy groups, and the hashes at which shards begin.

    groups: rows (h long, w long), one per atomic group; heavy: (h, w) of groups that
    come before them, in order. Shards without a heavy group begin at a hash.
    """

    def sums(df: DataFrame, bits: int) -> list[Cell]:
        rows = (
            df.groupBy(F.shiftright("h", 64 - bits).alias("p"))
            .agg(F.sum("w").alias("w"), F.max("w").alias("m"), F.count("*").alias("n"))
            .collect()  # at most 2 ** FIRST_BITS rows, or 2 ** MORE_BITS for each cell that may be cut
        )
        return [Cell(r.p, bits, r.w, r.m, r.n) for r in rows]

    def refined(cells: list[Cell], open_cells: set[int]) -> list[Cell]:
        by_bits: dict[int, list[Cell]] = {}
        for i in open_cells:
            by_bits.setdefault(cells[i].bits, []).append(cells[i])
        kept = [c for i, c in enumerate(cells) if i not in open_cells]
        for bits, some in by_bits.items():
            within = groups.where(F.shiftright("h", 64 - bits).isin([c.prefix for c in some]))
            kept += sums(within, min(64, bits + MORE_BITS))
        return ordered(kept)

    def ordered(cells: list[Cell]) -> list[Cell]:
        return [c for c in cells if c.heavy] + sorted((c for c in cells if not c.heavy), key=lambda c: c.start)

    cells = ordered([Cell(h, 64, w, w, 1, True) for h, w in heavy] + sums(groups, FIRST_BITS))
    if not cells:
        return 0, {}, []
    while True:
        low, high = smallest(cells, shards, True), smallest(cells, shards, False)
        if low == high:
            break
        walks = [fill(cells, c, fluid) or [] for c in (low, high) for fluid in (True, False)]
        walks = [w[: shards - 1] for w in walks]
        open_cells = set()
        for k in range(max(map(len, walks), default=0)):
            at = [w[k] for w in walks if k < len(w)]
            open_cells |= {i for i in range(max(0, min(at) - 1), max(at) + 1) if not cells[i].whole}
        if not open_cells:
            break
        cells = refined(cells, open_cells)
    while True:
        cuts = even_cuts(cells, shards, high)
        near = range(len(cells)) if len(cells) < shards else [i for c in cuts for i in (c - 1, c)]
        open_cells = {i for i in near if not cells[i].whole}
        if not open_cells:
            break
        cells = refined(cells, open_cells)
    place = {cells[i].prefix: bisect_right(cuts, i) for i in range(len(cells)) if cells[i].heavy}
    return high, place, [cells[i].start for i in cuts if not cells[i].heavy]


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> DataFrame:
    """A row per document: id, size (UTF-8 bytes + 1), text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "sizes",
    )
    groups = materialize(slim.groupBy("h").agg(F.sum("size").alias("w"), F.count("*").alias("n")), "groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most n_shards groups reach an equal share.
    heavy = [(r.h, r.w) for r in groups.where(F.col("w") * n_shards >= total).orderBy(F.desc("w"), "h").collect()]
    rest = groups.where(~F.col("h").isin([h for h, _ in heavy])) if heavy else groups
    _, place, cuts = boundaries(rest, n_shards, heavy)
    # The heavy groups' shards come first; a shard that begins with the first other group needs no hash.
    shard = F.lit(max(place.values(), default=0))
    for cut in cuts:
        shard = shard + (F.col("h") >= F.lit(cut)).cast("int")
    for h, k in place.items():
        shard = F.when(F.col("h") == F.lit(h), F.lit(k)).otherwise(shard)
    n = buckets or max(1, n_rows // (n_shards * BUCKET_ROWS))
    placed = slim.withColumns({"shard": shard.cast("int"), "bucket": F.pmod(F.xxhash64(id_col, "size", "h"), F.lit(n))})
    offsets = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("rows"))
        .withColumn("offset", F.expr("sum(rows) over (partition by shard order by bucket) - rows"))
        .drop("rows")
    )
    return (
        placed.join(offsets, ["shard", "bucket"])
        .withColumn(
            "slot",
            F.expr(f"offset + row_number() over (partition by shard, bucket order by {id_col}, size, h) - 1").cast("long"),
        )
        .select(id_col, "size", "text_crc32", "shard", "slot")
    )
