import math

import pytest
from pyspark.sql import functions as F

from cuelattice.functions import stats, text, vectors


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [(" \tHello ", "hello"), ("É ", "é"), ("", ""), (None, None)])
def test_word_key(spark, raw, want):
    assert one(spark, text.word_key, raw) == want


@pytest.mark.parametrize("raw, want", [("1", 1.0), (" 2.5 ", 2.5), ("-.5e1", -5.0), ("1d", None), ("nan", None), ("1_000", None), ("Olfactory", None), ("", None), (None, None)])
def test_number(spark, raw, want):
    assert one(spark, text.number, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("dog, cat, bird", ["dog", "cat", "bird"]),
        ("1. Dog\nCat\nDOG\nfish\nfox", ["dog", "cat", "fish"]),
        ("Sorry, I cannot", []),
        ("a language model says dog", []),
        ("<think>a, b</think> sun, moon", ["sun", "moon"]),
        ("- ice-cream, sure, here, tea!", ["ice-cream", "tea"]),
        ("", []),
        (None, None),
    ],
)
def test_answers(spark, raw, want):
    assert one(spark, text.answers, raw) == want


def test_letters_drop_hyphens(spark):
    assert one(spark, text.letters_and_spaces, " Ice-Cream! ") == "icecream"
    assert one(spark, text.letters_and_spaces, "Ça-Va 2²½_!") == "çava 2²½"


@pytest.mark.parametrize("raw, want", [("Gemma 3_27B", "gemma-3-27-b"), ("x-results", "x"), ("a--b", "a-b"), ("A1b2", "a-1-b-2")])
def test_model_name(spark, raw, want):
    assert one(spark, text.model_name, raw) == want


def test_key_rules(spark):
    key = "passive_gemma-3-27-b-instruct_contrast_300d"
    assert one(spark, text.key_model, key) == "gemma-3-27-b"
    assert one(spark, text.key_type, key) == "Behavior_Contrastive_300d"
    assert one(spark, text.key_type, "active_x") == "Unknown"
    assert one(spark, text.display_name, "gemma-3-27b-instruct") == "Gemma 3 27B"


def test_csv_cells(spark):
    assert one(spark, text.csv_cell, 'a "b"') == '"a ""b"""'
    assert one(spark, text.csv_cell, None) == "NA"
    assert one(spark, lambda c: text.csv_cell(c, numeric=True), 3.0, "double") == "3"
    assert one(spark, lambda c: text.csv_cell(c, numeric=True), 3.5, "double") == "3.5"


def test_predicates(spark):
    assert one(spark, lambda c: text.contains_text(c, "CREte"), "concreteness") is True
    assert one(spark, lambda c: text.contains_text(c, "x"), None) is False
    assert one(spark, lambda c: text.contains_any(c, ["q", "con"]), "concrete") is True


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], ["a", "b", "c", "b"])], "v array<double>, w array<double>, t array<string>")
    got = row.select(
        vectors.padded(F.col("v"), 4).alias("p"),
        vectors.norm(F.col("w")).alias("n"),
        vectors.pooled(F.array("v", "w")).alias("m"),
        vectors.pooled(F.array("v", "w"), "last").alias("l"),
        vectors.find_run(F.col("t"), F.lit(["b", "c"])).alias("r"),
        vectors.find_run(F.col("t"), F.lit(["c", "c"])).alias("none"),
        vectors.first_from(F.col("t"), F.lit("b"), 2).alias("f"),
        vectors.log_grid(-2, 2, 5).alias("g"),
        vectors.nan_as_zero(F.array(F.lit(float("nan")), F.lit(None).cast("double"), F.lit(1.0))).alias("z"),
        vectors.parsed(F.lit("[1, 2.5]")).alias("j"),
        vectors.finite(F.array(F.lit(float("inf")))).alias("inf"),
    ).first()
    assert got["p"] == [1, 2, 0, 0] and got["n"] == 5 and got["m"] == [2, 3] and got["l"] == [3, 4]
    assert got["r"] == 1 and got["none"] == -1 and got["f"] == 3 and got["z"] == [0, 0, 1] and got["j"] == [1, 2.5] and got["inf"] is False
    assert all(math.isclose(a, b) for a, b in zip(got["g"], [0.01, 0.1, 1, 10, 100], strict=True))


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 1.0, 1.0), ("d", None, 1.0)], "k string, x double, y double")
    got = {r["k"]: (r["r"], r["s"]) for r in df.groupBy("k").agg(stats.correlation(F.col("x"), F.col("y")).alias("r"), stats.slope(F.col("y"), F.col("x")).alias("s")).collect()}
    assert got["a"] == (None, None) and got["c"] == (None, None) and got["d"] == (None, None)
    assert math.isclose(got["b"][0], 1) and math.isclose(got["b"][1], 2)
