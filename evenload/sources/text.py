"""Text sources and sinks: lines, comma pairs, edges, words, tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """One row (value) per line; at least so many partitions if given."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def parse_pairs(lines: DataFrame) -> DataFrame:
    """(k bigint, v string) from comma lines: empty lines go, fields after the second are ignored.

    A key that is no number, or a line without comma, is an error.
    """
    parts = F.split("value", ",")
    return lines.where(F.length("value") > 0).select(
        F.element_at(parts, 1).cast("bigint").alias("k"), F.element_at(parts, 2).alias("v")
    )


def parse_edges(lines: DataFrame) -> DataFrame:
    """Distinct (src, dst): the first two tokens of each line; fewer are an error."""
    parts = F.split("value", r"\s+")
    return lines.select(F.element_at(parts, 1).alias("src"), F.element_at(parts, 2).alias("dst")).distinct()


def words_of(line: Column) -> Column:
    """A line's words, cut at single spaces: inner empty words stay, trailing ones go.

    An empty line is one empty word; a line of spaces only has none.
    """
    none = F.array().cast("array<string>")
    cut = F.split(F.regexp_replace(line, " +$", ""), " ")
    return F.when(line == "", F.array(F.lit(""))).when(F.rlike(line, F.lit("^ +$")), none).otherwise(cut)


def parse_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row (word) per word of each line."""
    return lines.select(F.explode(words_of(F.col(column))).alias("word"))


def write_tuples(df: DataFrame, path: str) -> None:
    """Each row as (a,b,...) on a line; the path must not exist."""
    parts = [x for c in df.columns for x in (F.lit(","), F.coalesce(F.col(c).cast("string"), F.lit("null")))][1:]
    df.select(F.concat(F.lit("("), *parts, F.lit(")")).alias("value")).write.mode("errorifexists").text(path)


def write_keys(df: DataFrame, column: str, path: str) -> None:
    """One column, a value on a line; the path must not exist."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(path)
