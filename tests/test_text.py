"""Text functions against plain versions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.distance import distance, suggestions


@pytest.mark.parametrize("word,stem", [("classes", "class"), ("caches", "cach"), ("parsing", "pars"), ("running", "run"), ("used", "used"), ("queries", "query"), ("bus", "bus"), ("telling", "tell"), ("stopped", "stop"), ("ids", "ids"), ("files", "fil"), ("ring", "ring")])
def test_fold(spark, word, stem):
    assert X.fold_word(word) == stem
    assert spark.range(1).select(X.fold(F.lit(word))).first()[0] == stem


def test_terms(spark):
    text = "HTTPServer reads IDs of inputUSDPerMtok, the caches_and x"
    want = X.query_terms(text)
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(X.terms(F.col("t")).alias("x")).collect()
    assert list(dict.fromkeys(got[0].x)) == want and got[1].x == [] and got[2].x == []
    assert "http" in want and "server" in want and "mtok" in want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdeghinprstuxyz", min_size=1, max_size=9), min_size=1, max_size=40))
def test_fold_agrees(spark, words):
    got = spark.createDataFrame([(w,) for w in words], "w string").select(X.fold(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [X.fold_word(w) for w in words]


def test_utf16(spark):
    r = spark.createDataFrame([("a😀b",)], "t string").select(X.utf16_length(F.col("t")), X.utf16_left(F.col("t"), 2), X.utf16_left(F.col("t"), 3), X.tokens_estimate(F.col("t"))).first()
    assert tuple(r) == (4, "a", "a😀", 1)


def test_paths(spark):
    d = spark.createDataFrame([("src/tests/a.py", "L3-L9"), ("lib/x_test.go", "L3"), ("a.py", None)], "p string, s string")
    got = d.select(X.is_copy(F.col("p")), X.directory(F.col("p")), X.under(F.col("p"), "src"), *X.span_bounds(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(True, "src/tests", True, 3, 9), (True, "lib", False, None, None), (False, ".", False, None, None)]
    assert X.asks_for_tests("where are the tests") and not X.asks_for_tests("skip tests")


def test_distance(spark):
    assert distance("abdc", "abcd") == 1 and distance("abc", "abc") == 0 and distance("a", "abcdef") == 4
    names = spark.createDataFrame([("read_file",), ("write",), ("red_file",)], "name string")
    assert [(r.name, r.far) for r in suggestions(names, "readFile").collect()] == [("read_file", 0)]
    assert [r.name for r in suggestions(names, "wirte").collect()] == ["write"]
