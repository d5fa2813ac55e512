"""Line dedup: first occurrences of lines across documents, as keep bitmaps.

Lines become 128-bit hashes. Hashes are dealt to partitions by their range,
sorted within a partition by hash, document and position, and streamed: the
first document of a run of equal hashes keeps its lines. A line that a large
share of all documents hold would fill one range, so every hash is spread over
``runs`` neighbouring ranges by document; the heads of these runs (one document
each) meet in a second, equally sorted pass that leaves the first of them. By
default runs grow with the partitions, so a line that a third of all rows hold
adds about three times the mean to a range.

Only hashes and positions move. The result is a bitmap per document: words of
64 lines, with runs of words that keep everything coded as a count.

Defined cases: a null or empty text is one empty line; an empty table gives an
empty result; rows that repeat an id count as one document and are each
returned; a null id counts as one document that comes after all others. Other
columns of the input are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenload.scratch import shuffle_partitions

#: White space that is stripped from both ends of a line: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row (all columns), and _r1 and _r2, a 128-bit identity of (id, text) that repeated rows share."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.xxhash64(F.col(id_col), text).alias("_r1"),
        F.xxhash64(F.lit(7), text, F.col(id_col)).alias("_r2"),
    )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, runs: int | None = None
) -> DataFrame:
    """One row for each document that loses lines.

    Columns: _r1, _r2 (see packed), n_dropped long, and keep, the
    compressed bitmap: array of (skip, word), where skip counts words of 64
    lines that are all kept and word has a set bit for each line kept. Lines
    after the last word are kept.
    """
    n = shuffle_partitions(docs.sparkSession)
    runs = runs or max(32, n // 8)
    lines = (
        packed(docs, id_col, text_col)
        .select(
            "_r1",
            "_r2",
            F.coalesce(F.col(f"_row.`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"),
            F.posexplode(F.split(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")), "\n", -1)).alias("pos", "line"),
        )
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select(
            "_r1", "_r2", "doc", "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64(F.lit(2), "doc"), F.lit(runs)).cast("int").alias("run"),
        )
    )
    # Hashes are uniform, so equal ranges of their leading bits need no sampling.
    span = F.expr(f"cast(((h1 >> 33) + {2**30}) * {n} >> 31 as int)")
    stride = max(1, n // runs)
    ranged = lines.withColumn("range", F.pmod(span + F.col("run") * stride, F.lit(n))).repartitionById(
        n, F.col("range")
    )
    in_run = "partition by range, h1, h2, run order by doc, pos"
    heads = ranged.withColumn("first_doc", F.expr(f"first(doc) over ({in_run})")).withColumn(
        "head", F.col("doc") == F.col("first_doc")
    )
    # Heads of all runs of a hash meet (at most `runs` documents); other rows are dropped and only pass.
    lane = F.when(F.col("head"), F.lit(0)).otherwise(1 + F.pmod(F.col("_r1"), F.lit(LAST)))
    drops = (
        heads.withColumn("lane", lane)
        .withColumn("first_doc", F.expr("first(doc) over (partition by h1, h2, lane order by doc, pos)"))
        .where(~F.col("head") | (F.col("doc") > F.col("first_doc")))
        .select("_r1", "_r2", (F.col("pos") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    )
    words = drops.repartition("_r1", "_r2").groupBy("_r1", "_r2", "at").agg(F.expr("bit_or(bit)").alias("bits"))
    by_row = words.groupBy("_r1", "_r2").agg(
        F.sum(F.expr("bit_count(bits)")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words"),
    )
    coded = F.expr(
        "transform(words, (x, i) -> named_struct("
        "'skip', x.at - if(i = 0, 0, words[greatest(i, 1) - 1].at + 1), 'word', ~x.bits))"
    )
    return by_row.select("_r1", "_r2", F.col("n_dropped").cast("long"), coded.alias("keep"))


def marked(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 10, runs: int | None = None) -> DataFrame:
    """_row (all columns), n_lines, n_dropped, keep and kept_text for each row of docs."""
    marks = keep_bitmaps(docs, id_col, text_col, min_chars, runs).withColumn(
        "_words", F.expr("flatten(transform(keep, x -> concat(array_repeat(-1L, x.skip), array(x.word))))")
    )
    text = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    kept = F.array_join(
        F.filter(
            F.split(text, "\n", -1),
            lambda _, i: F.coalesce(
                F.getbit(F.get(F.col("_words"), F.floor(i / 64).cast("int")), i % 64), F.lit(1)
            )
            == 1,
        ),
        "\n",
    )
    return packed(docs, id_col, text_col).join(marks.hint("shuffle_hash"), ["_r1", "_r2"], "left").select(
        "_row",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
        F.when(F.col("_words").isNull(), text).otherwise(kept).alias("kept_text"),
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, runs: int | None = None
) -> DataFrame:
    """docs with n_lines, n_dropped, keep (null: all lines stay) and kept_text added, which replace equal names."""
    new = ["n_lines", "n_dropped", "keep", "kept_text"]
    out = marked(docs, id_col, text_col, min_chars, runs)
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in new], *new)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines gone from the text, in the same columns; a null text stays null.

    n_chars, if there, follows the text.
    """
    cols = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    cols[text_col] = text = F.when(cols[text_col].isNotNull(), F.col("kept_text"))
    if "n_chars" in cols:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        cols["n_chars"] = F.when(F.col("n_dropped") > 0, length).otherwise(cols["n_chars"])
    return marked(docs, id_col, text_col).select(*[v.alias(k) for k, v in cols.items()])
