"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Source weights share a budget of words; a target stops at a
   multiple of its source, and the excess is shared again (closed form over
   the table of sources).
2. Quotas. Each source's documents are permuted by a keyed hash of id and text and cut
   into 4096 blocks at leading digits of that hash. A target of p whole sources and a rest
   takes every block p times and the rest from the blocks in permuted order;
   the block where the rest ends gives a prefix of its documents.
3. Tree. All block draws start at the root. A node that serves several output
   shards halves them and sends a uniformly drawn, exactly sized part of its
   draws to either side, so counts by source are multivariate hypergeometric.
4. Shuffle. Within a shard, draws come in their drawn order and the documents
   of a draw in a new permutation.

Only (id, source, size, hash) rows move until documents are written out.

Defined cases: a null text has size 0 and takes nothing; a text of any length is one
document; a null source is a source of its own that ranks last; a null id is an id like any
other; rows that repeat an id are separate documents, and of rows that repeat id and text, which
are alike, the mix picks by a hash of all their columns; an empty table gives an empty result;
other columns are not read, and ``_shard`` and ``_order`` of the mix replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenload.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"


def permutation_key(seed: str, id_col: str, text_col: str) -> Column:
    """The keyed hash of id and text that permutes documents, as hex digits."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))


def n_words(text_col: str) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_id, _source, _no_source, _size (words) and _key."""
    return docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        F.col(source_col).isNull().alias("_no_source"),
        n_words(text_col).alias("_size"),
        permutation_key(seed, id_col, text_col).alias("_key"),
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """A row per source: source_size and target, by water-filling over the aggregated sources."""
    ws = ", ".join(f"{float(w)!r}D" for w in weights)
    return (
        sizes.groupBy("_no_source", "_source")
        .agg(F.sum("_size").alias("source_size"))
        .withColumn("rank", F.expr("row_number() over (order by _no_source, _source)"))
        .withColumn("w", F.expr(f"element_at(array({ws}), (rank - 1) % {len(weights)} + 1)"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("budget", F.expr(f"sum(source_size) over () * {float(share)!r}D"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("full", F.expr("sum(cap) over (order by ratio, rank) - cap"))
        .withColumn("rest", F.expr("sum(w) over (order by ratio desc, rank desc)"))
        .withColumn("capped", F.expr("ratio <= (budget - full) / rest"))
        .withColumn(
            "level",
            F.expr(
                "(budget - sum(if(capped, cap, 0D)) over ()) / nullif(sum(if(capped, 0D, w)) over (), 0D)"
            ),
        )
        .select("_no_source", "_source", "source_size", F.expr("if(capped, cap, level * w)").alias("target"))
    )


def split_tree(draws: DataFrame, n_shards: int, seed: str) -> DataFrame:
    """Adds shard to the block draws.

    Level by level, each node's draws are ordered by a fresh MD5 and cut in
    proportion to the shards on either side. draws has a row per block draw:
    its number is bounded by blocks and passes per source, not by documents.
    """
    out = draws.withColumns({"_lo": F.lit(0), "_hi": F.lit(n_shards)})
    for level in range(ceil(log2(max(1, n_shards)))):
        lot = f"md5(concat('{seed}:{level}:', if(_no_source, 'none', 'some'), ':', _source, ':', block, ':', pass))"
        order = f"{lot}, _no_source, _source, block, pass"
        out = (
            out.withColumn("_n", F.expr("count(*) over (partition by _lo, _hi)"))
            .withColumn("_at", F.expr(f"row_number() over (partition by _lo, _hi order by {order})"))
            .withColumn("_mid", F.expr("cast((_lo + _hi) div 2 as int)"))
            .withColumn("_left", F.expr("_hi - _lo > 1 and _at <= _n * (_mid - _lo) div (_hi - _lo)"))
            .withColumn("_to", F.expr("if(_hi - _lo = 1 or _left, if(_left, _mid, _hi), _hi)"))
            .withColumn("_lo", F.expr("if(_hi - _lo = 1 or _left, _lo, _mid)"))
            .withColumn("_hi", F.col("_to"))
            .drop("_n", "_at", "_mid", "_left", "_to")
        )
    return out.withColumnRenamed("_lo", "shard").drop("_hi")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    n_shards: int = 16,
    block_digits: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row per document: _id, source, size, source_size, target, draws, taken.

    draws: array of (shard, pass, order), one for each time the mix takes the
    document; taken: its words times their number. Sources have 16 to the power
    block_digits blocks each. Nothing depends on the session's settings.
    """
    slim = materialize(
        sized(docs, seed, id_col, text_col, source_col).withColumn("block", F.substring("_key", 1, block_digits)),
        "mix",
    )
    src = ["_no_source", "_source"]
    blocks = (
        slim.groupBy(*src, "block")
        .agg(F.sum("_size").alias("block_size"))
        .join(targets(slim, weights, share, most), src)
        .withColumn("before", F.expr("sum(block_size) over (partition by _no_source, _source order by block) - block_size"))
        .withColumn("passes", F.expr("if(source_size = 0, 0, cast(floor(target / source_size) as int))"))
        .withColumn("rest", F.expr("target - passes * source_size"))
    )
    draws = split_tree(
        blocks.where("block_size > 0")
        .select(*src, "block", "passes", "before", "rest")
        .withColumn("pass", F.explode(F.expr("sequence(0, passes)")))
        .where("pass < passes or before < rest")
        .select(*src, "block", "pass"),
        n_shards,
        seed,
    )
    order = F.xxhash64(F.lit(seed), F.lit("order"), *src, "block", "pass")
    by_block = draws.groupBy(*src, "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard", order.alias("order")))).alias("block_draws")
    )
    quotas = blocks.select(*src, "block", "source_size", "target", "before", "passes", "rest").join(
        by_block, [*src, "block"], "left"
    )
    placed = (
        slim.join(quotas, [*src, "block"])
        .withColumn(
            "prior",
            F.expr(
                "before + sum(_size) over (partition by _no_source, _source, block order by _key, _size"
                " rows between unbounded preceding and current row) - _size"
            ),
        )
        .withColumn("extra", F.expr("_size > 0 and 2D * prior + _size <= 2D * rest"))
        .withColumn(
            "draws",
            F.expr("coalesce(filter(block_draws, d -> _size > 0 and (d.pass < passes or extra)), array())"),
        )
    )
    return placed.select(
        "_id",
        F.expr("if(_no_source, null, _source)").alias("source"),
        "_key",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        "draws",
        (F.col("_size") * F.size("draws")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: docs, each row as often as it is drawn, with _shard and _order.

    Sorting a shard by _order gives its shuffled sequence. Documents that are
    not drawn are absent.
    """
    text_col = options.get("text_col", "text")
    # Rows that repeat id and text share the lots drawn for them, in turn.
    lots = (
        mix(docs, seed=seed, id_col=id_col, **options)
        .where(F.size("draws") > 0)
        .groupBy("_key", F.col("size").alias("_size"))
        .agg(F.sort_array(F.collect_list("draws")).alias("_lots"))
    )
    turn = docs.select(
        F.struct(*docs.columns).alias("_row"), permutation_key(seed, id_col, text_col).alias("_key"), n_words(text_col).alias("_size")
    ).withColumn("_turn", F.expr("row_number() over (partition by _key, _size order by xxhash64(_row))"))
    drawn = turn.join(lots, ["_key", "_size"]).withColumn("_draw", F.explode(F.expr("get(_lots, _turn - 1)")))
    return drawn.select(
        *[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("_shard", "_order")],
        F.col("_draw.shard").alias("_shard"),
        F.struct(F.col("_draw.order"), F.xxhash64(F.lit(seed), "_draw.pass", "_key").alias("within")).alias("_order"),
    )
