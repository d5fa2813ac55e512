"""Text sources and sinks."""

import pytest
from pyspark.sql import functions as F

from evenload.sources import text


@pytest.mark.parametrize(
    ("line", "words"),
    [("", [""]), (" ", []), ("   ", []), (" a", ["", "a"]), ("a ", ["a"]), ("a  b", ["a", "", "b"]), ("a b  ", ["a", "b"])],
)
def test_words(spark, line, words):
    df = spark.createDataFrame([(line,)], "value string")
    assert df.select(text.words_of(F.col("value"))).first()[0] == words


def test_pairs(spark, tmp_path):
    (tmp_path / "in").write_text('1,a,x\n\n2,"b"\n')
    got = text.parse_pairs(text.read_lines(spark, str(tmp_path / "in"))).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, '"b"')]
    for bad in ("x,1\n", "7\n"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            text.parse_pairs(text.read_lines(spark, str(tmp_path / "bad"))).collect()


def test_edges(spark, tmp_path):
    (tmp_path / "in").write_text("a b c\na\tb\nb  a\n")
    got = text.parse_edges(text.read_lines(spark, str(tmp_path / "in"), 3)).collect()
    assert sorted(map(tuple, got)) == [("a", "b"), ("b", "a")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    text.write_tuples(df, str(tmp_path / "t"))
    text.write_keys(df, "k", str(tmp_path / "k"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["(a,1.5)", "(b,null)"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "k")).collect()) == ["a", "b"]
    with pytest.raises(Exception):  # noqa: B017
        text.write_keys(df, "k", str(tmp_path / "k"))
