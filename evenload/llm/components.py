"""Connected components of a link table, by rounds of joins.

Edges and labels stay distributed; each round is written to the shared folder,
which cuts the lineage, and the round before is removed. A round lets every vertex
adopt the smallest label among its neighbours and then jump to the label of its
label, so the rounds grow with the logarithm of a component's diameter. Joins on
labels are salted by vertex: a giant component is spread over SALTS tasks.

Vertices may be of any type with an order. Loops and repeated links do not
matter; an empty table gives an empty result; null ends are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenload.scratch import discard, materialize

SALTS = 64


def salted(rows: DataFrame, node: str = "node") -> DataFrame:
    """rows with _salt, which spreads a key's rows by their node."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(node, F.lit(5)), F.lit(SALTS)).cast("int"))


def sized(rows: DataFrame, key: str, least: int = 1, node: str = "node") -> DataFrame:
    """rows of keys with at least so many rows, and size, the number of the key's rows.

    Counts are made per key and salt and summed over at most SALTS rows of a key, so
    no task reads a whole hot key.
    """
    spread = salted(rows, node)
    counts = (
        spread.groupBy(key, "_salt")
        .agg(F.count("*").alias("_rows"))
        .withColumn("size", F.expr(f"sum(_rows) over (partition by {key})"))
        .where(F.col("size") >= least)
        .drop("_rows")
    )
    return spread.join(counts, [key, "_salt"]).drop("_salt")


def told_by_key(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined to facts, which has a row per key; a hot key's rows are spread by another column."""
    spread = salted(rows, by)
    told = spread.select(key, "_salt").distinct().join(facts, key)
    return spread.join(told, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b): the smallest node within reach."""
    both = materialize(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct(),
        "edges",
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        adopted = salted(
            labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        )
        moved = labels.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("further"))
        jump = adopted.select("component", "_salt").distinct().join(moved, "component")
        after = materialize(
            adopted.join(jump, ["component", "_salt"], "left").select(
                "node", "old", F.least("component", F.coalesce("further", "component")).alias("component")
            ),
            "labels",
        )
        discard(labels)
        changed = after.where("old <> component").limit(1).count()
        labels = after.select("node", "component")
        labels._evenload_path = after._evenload_path
        if not changed:
            discard(both)
            return labels
