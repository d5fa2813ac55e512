"""Line dedup against a plain loop."""

from collections import defaultdict

from evenload.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    held = defaultdict(set)
    last = 2**63 - 1
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[line.strip(SPACE).translate(LOWER)].add(last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = last if i is None else i
        kept = [x for x in lines if len(k := x.strip(SPACE).translate(LOWER)) < 10 or len(held[k]) < 2 or min(held[k]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()), key=str)


def test_odd_rows(odd):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_hot_and_long(spark):
    rows = [(i, "\n".join(["the one very common line", f"line of document {i}", *["a repeated line here"] * (i % 3)])) for i in range(300)]
    rows += [(1000, "\n".join(f"line of document {i % 500}" for i in range(2000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df) == brute(rows)


def test_bitmap_is_sparse(spark):
    rows = [(1, "common line number one"), (2, "\n".join([*(f"own line {i:05d}" for i in range(1000)), "common line number one"]))]
    marks = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(marks) == 1 and marks[0].n_dropped == 1
    assert [tuple(w) for w in marks[0].keep] == [(1000 // 64, ~(1 << (1000 % 64)))]


def test_clean_keeps_columns(odd):
    out = line_dedup.clean(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.count() == odd.count()
    assert out.where("text is null").count() == odd.where("text is null").count()
    assert {r.keep for r in out.collect()} == {0} and {r.n_dropped for r in out.collect()} == {"z"}


def test_empty_table(odd):
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
