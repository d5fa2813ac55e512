"""Embedding near-dedup by NN-descent.

Vectors with equal label and components are one node. A neighbour graph starts
from neighbours in several orders of hyperplane signatures and is refined by
joins, which carry vectors in half precision: the neighbours of a node, and the nodes that have it as a neighbour,
meet at it and become candidates for each other. Lists whose every entry
reaches the threshold are saturated and double. Then

* edges at or above the threshold form families;
* inside a family, links are counted exactly in double precision, by pairs of
  blocks, so a list that was too short loses nothing;
* recall is audited: some 2000 vectors drawn by hash (all of a smaller table) are
  compared with all vectors of their label. Where none of them has a link, as many
  are drawn among the vectors that the graph linked; where there are none of these
  either, recall is null and not 1. Every probe counts alike, links count without
  copies, and probes with about as many links are averaged apart: the least average
  must reach the aim, so a large family hides no lost pairs. Short of it, the graph
  gets as many new orders again and is refined further; short of it with the most
  orders, all vectors of a label are compared exactly, by pairs of blocks.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and those without label, link with nothing; vectors of different
lengths do not link; equal vectors link with each other; a null id is never
the smallest; repeated rows are vectors of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenload.llm.components import components, sized, told_by_key
from evenload.llm.near_text import by_group, spanning_forest
from evenload.scratch import discard, materialize, shuffle_partitions

THRESHOLD = 0.93
NEIGHBOURS, ORDERS, WINDOW, CELL, BLOCK = 10, 8, 6, 512, 512
#: Block of the exact comparison of a whole label.
WIDE_BLOCK = 1024
#: Half precision may misplace a similarity by this much (two roundings of 2 ** -11 each); double precision decides.
SLACK = 1e-3
#: Vectors drawn by hash for the audit, at least (and at most twice as many), and slices of the rows they are compared with.
PROBES, SLICES = 2000, 256
EDGES = "node long, nbr long, sim float"

log = logging.getLogger(__name__)


def unit(embedding: Column) -> Column:
    """The vector at length 1, as little-endian doubles."""

    @F.arrow_udf("binary")
    def scaled(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            v = np.array(row.values, np.float64)
            v = v / np.abs(v).max()
            out.append((v / np.sqrt(v @ v)).tobytes())
        return pa.array(out, pa.binary())

    return scaled(embedding)


def brief(unit_bytes: Column) -> Column:
    """The vector in half precision: what the graph's rounds carry."""

    @F.arrow_udf("binary")
    def halved(column: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(row, np.float64).astype(np.float16).tobytes() for row in column.to_pylist()], pa.binary())

    return halved(unit_bytes)


def brief_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of vectors in half precision, for single-precision products."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of vectors from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: _id, node or null) and (nodes: node, grp, copies, least, unit, brief).

    A node is named by 64 bits, seeded so that no two vectors that differ in 128 bits share a name.
    """
    usable = F.expr(
        f"{label_col} is not null and {vec_col} is not null"
        f" and forall({vec_col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        f" and exists({vec_col}, x -> x <> 0)"
    )
    for seed in itertools.count():
        keyed = vectors.select(
            F.col(id_col).alias("_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"),
            F.when(usable, F.xxhash64(F.lit(seed), F.col(label_col), F.col(vec_col))).alias("node"),
            F.xxhash64(F.col(vec_col), F.col(label_col)).alias("other"),
        )
        nodes = materialize(
            keyed.where("node is not null")
            .groupBy("node")
            .agg(
                F.first("label").alias("label"),
                F.first("v").alias("v"),
                F.count("*").alias("copies"),
                F.min("_id").alias("least"),
                (F.min("other") != F.max("other")).alias("mixed"),
            )
            .select("node", F.xxhash64("label", F.size("v")).alias("grp"), "copies", "least", "mixed", unit(F.col("v")).alias("unit"))
            .withColumn("brief", brief(F.col("unit"))),
            "vectors",
        )
        if not nodes.where("mixed").limit(1).count():
            return keyed.select("_id", "node"), nodes.drop("mixed")
        discard(nodes)


def _edges(nodes: np.ndarray, nbrs: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(nbrs, pa.int64()), pa.array(sims, pa.float32())], ["node", "nbr", "sim"]
    )


def ordered_neighbours(nodes: DataFrame, n: int, first: int, orders: int) -> DataFrame:
    """Edges between nodes that are close in an order of hyperplane signatures; first numbers the orders."""
    bits = max(0, ceil(log2(max(1, n / CELL))))

    @F.arrow_udf("array<bigint>")
    def signatures(column: pa.Array) -> pa.Array:
        vectors = [np.frombuffer(row, np.float64) for row in column.to_pylist()]
        out = np.empty((len(vectors), orders), np.int64)
        for d in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == d]
            out[at] = (np.array([vectors[i] for i in at]) @ planes(d).T > 0).reshape(len(at), orders, 32) @ weights
        return pa.array(list(out), pa.list_(pa.int64()))

    weights = 2 ** np.arange(31, -1, -1, dtype=np.int64)
    known: dict[int, np.ndarray] = {}

    def planes(d: int) -> np.ndarray:
        if d not in known:
            known[d] = np.concatenate([np.random.default_rng([d, first + t]).normal(size=(32, d)) for t in range(orders)])
        return known[d]

    # Signatures are written once: counting the cells reads no vector, and the dealing below is the only exchange of them.
    signed = materialize(nodes.select("node", "grp", "brief", signatures(F.col("unit")).alias("sigs")), "signatures")

    def dealt_by_cell(*carried: str) -> DataFrame:
        spread = signed.select("grp", *carried, F.posexplode("sigs").alias("ord", "sig"))
        return spread.withColumn("cell", F.shiftright("sig", 32 - bits) if bits else F.lit(0).cast("long"))

    # A family of very close vectors may fill a cell: beyond two sizes it is dealt at random, differently in each order.
    crowded = materialize(
        dealt_by_cell().groupBy("grp", "ord", "cell").agg(F.count("*").alias("_rows")).where(F.col("_rows") > 2 * CELL), "crowded"
    )
    dealt = dealt_by_cell("node", "brief").join(crowded, ["grp", "ord", "cell"], "left").withColumn(
        "part", F.expr(f"coalesce(pmod(xxhash64(node, ord), cast(ceil(_rows / {CELL}D) as long)), 0L)")
    )
    keys = ["grp", "ord", "cell", "part"]

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(parts, keys):
            if table.num_rows < 2:
                continue
            u, name = brief_matrix(table.column("brief")), table.column("node").to_numpy()
            sims = np.full((len(u), 2 * WINDOW), -2, np.float32)
            nbrs = np.zeros((len(u), 2 * WINDOW), np.int64)
            for o in range(1, min(WINDOW, len(u) - 1) + 1):
                s = np.einsum("ij,ij->i", u[:-o], u[o:])
                sims[:-o, o - 1], nbrs[:-o, o - 1] = s, name[o:]
                sims[o:, WINDOW + o - 1], nbrs[o:, WINDOW + o - 1] = s, name[:-o]
            best = np.argsort(-sims, axis=1)[:, :4]
            s = np.take_along_axis(sims, best, 1)
            ok = s > -2
            yield _edges(np.repeat(name, ok.sum(1)), np.take_along_axis(nbrs, best, 1)[ok], s[ok])

    sorted_cells = dealt.repartition(*keys).sortWithinPartitions(*keys, "sig", "node").select(*keys, "node", "brief")
    found = materialize(sorted_cells.mapInArrow(near, EDGES), "ordered")
    discard(signed)
    discard(crowded)
    return found


def trimmed(edges: DataFrame, lists: DataFrame | None, threshold: float) -> DataFrame:
    """Each node's best neighbours, and _k, its list's length: a saturated list doubles."""
    best = edges.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    if lists is None:
        sized = best.withColumn("_k", F.lit(NEIGHBOURS))
    else:
        full = lists.groupBy("node").agg(F.max("_k").alias("k"), F.count("*").alias("n"), F.min("sim").alias("low"))
        grown = full.select("node", F.expr(f"if(n >= k and low >= {threshold - SLACK}, 2 * k, k)").alias("_k"))
        sized = best.join(grown, "node", "left").withColumn("_k", F.coalesce("_k", F.lit(NEIGHBOURS)))
    ranked = sized.withColumn("_r", F.expr("row_number() over (partition by node order by sim desc, nbr)"))
    return materialize(ranked.where("_r <= _k").drop("_r"), "graph")


def succeeded(edges: DataFrame, lists: DataFrame | None, threshold: float) -> DataFrame:
    """The next generation of lists; the files of the last one go."""
    after = trimmed(edges, lists, threshold)
    if lists is not None:
        discard(lists)
    return after


def descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates from neighbours of neighbours that beat the last entry of a node's list."""
    floor = graph.groupBy("node").agg(F.expr("if(count(*) < max(_k), -1f, min(sim))").alias("floor"))
    meet = (
        graph.select(F.col("node").alias("at"), F.col("nbr").alias("node"), "sim")
        .union(graph.select(F.col("nbr").alias("at"), "node", "sim"))
        .groupBy("at", "node").agg(F.max("sim").alias("sim"))
    )
    # A hub meets only so many of those that list it; families are completed exactly afterwards.
    some = meet.withColumn("_r", F.expr("row_number() over (partition by at order by sim desc, node)")).where(f"_r <= {4 * NEIGHBOURS}")
    carried = some.join(nodes.select("node", "brief"), "node").join(floor, "node", "left").select(
        "at", "node", "brief", F.coalesce("floor", F.lit(-1.0)).cast("float").alias("floor")
    )

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(parts, ["at"]):
            if table.num_rows < 2:
                continue
            u, name = brief_matrix(table.column("brief")), table.column("node").to_numpy()
            sims = u @ u.T
            np.fill_diagonal(sims, -2)
            sims[sims <= table.column("floor").to_numpy()[:, None]] = -2
            best = np.argsort(-sims, axis=1)[:, : NEIGHBOURS // 2]
            s = np.take_along_axis(sims, best, 1)
            ok = s > -2
            if ok.any():
                yield _edges(np.repeat(name, ok.sum(1)), name[best][ok], s[ok])

    return carried.repartition("at").sortWithinPartitions("at", "node").mapInArrow(local, EDGES)


def exact_links(graph: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The links within families of the graph."""
    close = graph.where(F.col("sim") >= threshold - SLACK).select(F.col("node").alias("a"), F.col("nbr").alias("b"))
    return links_within(components(close), nodes, threshold, BLOCK)


def links_within(family: DataFrame, nodes: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, linked, pairs): links counted with and without copies, and forest edges (a, b), in double precision within components."""
    blocks = F.expr(f"cast(ceil(size / {block}D) as int)")
    rows = (
        sized(family, "component")
        .join(nodes.select("node", "copies", "unit"), "node")
        .withColumn("_n", blocks)
        .withColumn("_b", F.expr("cast(pmod(xxhash64(node, 11), _n) as int)"))
        .withColumn("_o", F.explode(F.expr("sequence(0, _n - 1)")))
        .withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    )
    keys = ["component", "_i", "_j"]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(parts, keys):
            u, name, own = matrix(table.column("unit")), table.column("node").to_numpy(), table.column("_b").to_numpy()
            copies, one = table.column("copies").to_numpy(), table.column("_i")[0] == table.column("_j")[0]
            near = u @ u.T >= threshold
            np.fill_diagonal(near, False)
            if not one:
                near &= own[:, None] != own[None, :]
            linked, pairs = near @ copies, near.sum(1)
            some = np.flatnonzero(pairs)
            forest = spanning_forest(len(some), lambda i, left: near[some[i], some[left]])  # noqa: B023
            a = np.array([name[some[i]] for i, _ in forest] + [0] * len(some), np.int64)
            b = np.array([name[some[j]] for _, j in forest] + name[linked > 0].tolist(), np.int64)
            c = np.array([0] * len(forest) + linked[linked > 0].tolist(), np.int64)
            d = np.array([0] * len(forest) + pairs[linked > 0].tolist(), np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d)], ["a", "b", "linked", "pairs"])

    k = [F.col(x) for x in keys]
    found = materialize(
        rows.repartition(*k).sortWithinPartitions(*k, "node").select(*keys, "node", "_b", "copies", "unit").mapInArrow(count, "a long, b long, linked long, pairs long"),
        "links",
    )
    counted = found.where("linked > 0").groupBy(F.col("b").alias("node")).agg(F.sum("linked").alias("linked"), F.sum("pairs").alias("pairs"))
    return counted, found.where("linked = 0").select("a", "b")


def audit(nodes: DataFrame, probes: DataFrame, counted: DataFrame, threshold: float, slices: int) -> float | None:
    """The share of a probe's links that are found, averaged over probes by octave of their links; the least average.

    probes: some of nodes, a bounded number. Null if none of them has a link.
    """
    every = nodes.select("grp", F.pmod(F.xxhash64("node"), F.lit(slices)).alias("_s"), F.lit(1).alias("_all"), "node", "unit")
    asked = probes.select("grp", F.explode(F.expr(f"sequence(0L, {slices - 1}L)")).alias("_s"), F.lit(0).alias("_all"), "node", "unit")
    keys = ["grp", "_s"]

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own = None, [], None
        for part in parts:
            for table in by_group(iter([part]), [*keys, "_all"]):
                here = (table.column("grp")[0].as_py(), table.column("_s")[0].as_py())
                if here != key:
                    key, held, own = here, [], None
                if table.column("_all")[0].as_py() == 0:
                    held.append(table)
                    continue
                if own is None:
                    asking = pa.concat_tables(held) if held else table.slice(0, 0)
                    own = (matrix(asking.column("unit")) if held else None, asking.column("node").to_numpy())
                if own[0] is None:
                    continue
                u, name = matrix(table.column("unit")), table.column("node").to_numpy()
                near = (own[0] @ u.T >= threshold) & (own[1][:, None] != name[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(own[1]), pa.array(near.sum(1))], ["node", "truth"])

    k = [F.col(x) for x in keys]
    dealt = asked.unionByName(every).repartition(*k).sortWithinPartitions(*k, "_all", "node")
    truth = dealt.select(*keys, "_all", "node", "unit").mapInArrow(compare, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    shares = (
        truth.where("truth > 0").join(counted, "node", "left")
        .groupBy(F.floor(F.log2("truth"))).agg(F.avg(F.expr("least(truth, coalesce(pairs, 0)) / truth")).alias("share"))
    )
    return shares.agg(F.min("share")).first()[0]


def audited(nodes: DataFrame, n: int, counted: DataFrame, threshold: float, slices: int) -> float | None:
    """The recall of probes drawn among all nodes; if these have no links, of probes among the linked ones; else null."""
    drawn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(max(1, n // PROBES))) == 0
    found = audit(nodes, nodes.where(drawn), counted, threshold, slices)
    if found is not None:
        return found
    linked = counted.where("pairs > 0").select("node")
    some = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(max(1, linked.count() // PROBES))) == 0
    return audit(nodes, nodes.join(linked.where(some), "node", "left_semi"), counted, threshold, slices)


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, rounds: int = 2, recall: float = 0.99, most_orders: int = 64,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, float | None]:
    """Rows (_id, n_links, component_id, recall) for every vector, and the audited recall.

    It is 1 if all pairs were compared, and null if no probe and no linked vector was there to measure it.
    """
    rows, nodes = distinct_vectors(vectors, id_col, vec_col, label_col)
    n, slices = nodes.count(), min(SLICES, shuffle_partitions(vectors.sparkSession))
    graph, orders = None, 0
    while True:
        more = ordered_neighbours(nodes, n, orders, max(ORDERS, orders))
        orders += max(ORDERS, orders)
        graph = succeeded(more if graph is None else more.unionByName(graph.drop("_k")), graph, threshold)
        discard(more)
        for _ in range(rounds):
            graph = succeeded(descend(graph, nodes).unionByName(graph.drop("_k")), graph, threshold)
        counted, forest = exact_links(graph, nodes, threshold)
        reached = audited(nodes, n, counted, threshold, slices)
        if reached is None or reached >= recall or orders >= most_orders:
            break
    if reached is not None and reached < recall:
        log.warning("audited recall %.4f after %d orders: all vectors of a label are compared", reached, orders)
        counted, forest = links_within(nodes.select("node", F.col("grp").alias("component")), nodes, threshold, WIDE_BLOCK)
        reached = 1.0
    linked = components(forest)
    merged = nodes.join(linked, "node", "left").join(counted, "node", "left")
    least = merged.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    named = merged.join(least, "component", "left").select(
        "node", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")
    )
    usable, other = rows.where("node is not null"), rows.where("node is null")
    linked = told_by_key(usable, named, "node", "_id").select("_id", "n_links", "component_id")
    alone = other.select("_id", F.lit(0).alias("n_links"), F.col("_id").alias("component_id"))
    out = linked.unionByName(alone).select(
        "_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"),
        F.lit(reached).cast("double").alias("recall"),
    )
    return out, reached
