"""What a key costs the task that gets it: rows read plus rows emitted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operator types that read two inputs.
JOIN_TYPES = (
    "join",
    "leftOuterJoin",
    "rightOuterJoin",
    "fullOuterJoin",
    "subtractByKey",
    "joinnull",
    "leftOuterJoinnull",
    "rightOuterJoinnull",
)
#: SQL names of the join types, for operators.
COST_OF_JOIN = {
    "inner": "join",
    "left": "leftOuterJoin",
    "right": "rightOuterJoin",
    "full": "fullOuterJoin",
    "left_anti": "subtractByKey",
}


def emitted(optype: str, v1: Column, v2: Column) -> Column:
    """Rows that a key with v1 left and v2 right rows gives."""
    none, matched = F.lit(0.0), v1 * v2
    unmatched_left, unmatched_right = F.when(v2 == 0, v1).otherwise(none), F.when(v1 == 0, v2).otherwise(none)
    rows = {
        "join": matched,
        "leftOuterJoin": matched + unmatched_left,
        "rightOuterJoin": matched + unmatched_right,
        "fullOuterJoin": matched + unmatched_left + unmatched_right,
        "subtractByKey": unmatched_left,
    }
    return rows.get(optype, none)


def key_weight(optype: str, v1: Column, v2: Column | None = None, assume_symmetric: bool = False) -> Column:
    """The load of a key with v1 rows (and v2 rows on the right).

    Two-input types named ...null count inputs only. With one input, types that
    build one row per key (combine..., groupByKey) emit one row and all others
    as many as they read. assume_symmetric: v2 is taken to be v1.
    """
    v1 = v1.cast("double")
    if optype in JOIN_TYPES:
        if v2 is None and not assume_symmetric:
            raise ValueError(f"{optype} needs the rows of both sides")
        v2 = v1 if assume_symmetric else v2.cast("double")
        return v1 + v2 + emitted(optype, v1, v2)
    if "combine" in optype or "groupByKey" in optype:
        return v1 + 1
    if optype == "reduceByKey":
        # after map-side combining: a row from each partition that holds the key, and the result
        return v1 + 1
    return 2 * v1


def scaled(freq: Column, rows: Column, sampled: Column, fraction: float = 1.0) -> Column:
    """Estimated rows from a sampled frequency: freq x rows / sampled, over the share of partitions seen."""
    return freq * rows / F.least(sampled, rows) / F.lit(float(fraction))
