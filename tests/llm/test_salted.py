"""Joins that deal out hot keys keep columns of any name."""

from pyspark.sql import functions as F

from pointmill.llm import common, line_dedup


def test_names_that_clash_with_the_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.createDataFrame([(i % 3 if i > 60 else 7, i, f"p{i}", i, -i) for i in range(100)], "k int, id int, __part string, __parts int, __hot_0 int")
    right = spark.createDataFrame([(k, k * 10) for k in (0, 1, 7)], "k int, v int")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.salted_join(left, right, ["k"], F.col("id"), how).select(*left.columns, "v").collect()))
        assert got == sorted(map(tuple, left.join(right, "k", how).select(*left.columns, "v").collect()))


def test_lines_of_many_equal_texts_with_such_columns(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(i, "menu\nbody", "s") for i in range(60)] + [(100 + i, f"menu\nown {i}", "s") for i in range(5)]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"__part": F.lit("a"), "__parts": F.lit(2), "site": F.lit("b")})
    want = sorted(map(tuple, line_dedup.line_dedup(pages).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, line_dedup.line_dedup(pages).collect())) == want
    assert {r[1] for r in want} == {""} | {f"own {i}" for i in range(5)}
