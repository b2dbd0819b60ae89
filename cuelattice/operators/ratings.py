"""Agreement and coverage of ratings (model, norm, word, rating)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions.stats import correlation
from cuelattice.functions.text import number, word_key


def coerced(raw: DataFrame, rating: str = "raw") -> DataFrame:
    """``raw`` with a numeric ``rating``; rows whose text is no number go."""
    return raw.withColumn("rating", number(F.col(rating))).filter("rating is not null")


def word_means(ratings: DataFrame) -> DataFrame:
    """(model, norm, word, rating): the mean over repeated ratings, words normalised."""
    return ratings.groupBy("model", "norm", word_key(F.col("word").cast("string")).alias("word")).agg(F.avg("rating").alias("rating"))


def strict_rows(means: DataFrame, least_models: int = 3, least_words: int = 10) -> DataFrame:
    """The rows of words that every model of the norm has rated, of norms with enough models and such words."""
    models = means.groupBy("norm").agg(F.countDistinct("model").alias("models"))
    words = means.groupBy("norm", "word").agg(F.count("rating").alias("n")).join(models, "norm").filter("n = models")
    enough = words.groupBy("norm").agg(F.count(F.lit(1)).alias("n_shared_words"), F.max("models").alias("models")).filter((F.col("models") >= least_models) & (F.col("n_shared_words") >= least_words))
    return means.join(words.select("norm", "word"), ["norm", "word"], "left_semi").join(enough, "norm")


def consensus(means: DataFrame) -> DataFrame:
    """(model, norm, strict_consensus_r, n_shared_words): each model against the mean of all others on strict rows."""
    w = Window.partitionBy("norm", "word")
    rows = strict_rows(means)
    others = (F.sum("rating").over(w) - F.col("rating")) / (F.count("rating").over(w) - 1)
    return rows.withColumn("others", others).groupBy("model", "norm").agg(correlation(F.col("rating"), F.col("others")).alias("strict_consensus_r"), F.max("n_shared_words").alias("n_shared_words"))


def model_pairs(means: DataFrame, least_words: int = 10) -> DataFrame:
    """(norm, model_a, model_b, r, n): correlations of every two models over the words both have rated."""
    a = means.select("norm", "word", F.col("model").alias("model_a"), F.col("rating").alias("x"))
    b = means.select("norm", "word", F.col("model").alias("model_b"), F.col("rating").alias("y"))
    pairs = a.join(b, ["norm", "word"]).filter("model_a < model_b")
    return pairs.groupBy("norm", "model_a", "model_b").agg(correlation(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_words)


def consistency(pairs: DataFrame) -> DataFrame:
    """(norm, mean_inter_model_corr, n_pairs)."""
    return pairs.groupBy("norm").agg(F.avg("r").alias("mean_inter_model_corr"), F.count("r").alias("n_pairs"))


def coverage(expected: DataFrame, raw: DataFrame, rating: str = "raw") -> DataFrame:
    """By norm: rows present, distinct words missing, rows that parse or fail, and a verdict at half missing.

    ``expected`` (word) is the vocabulary. PRESENT counts rows and MISSING counts words, as their names say.
    """
    rows = raw.withColumn("ok", number(F.col(rating)).isNotNull())
    seen = rows.groupBy("norm").agg(
        F.count(F.lit(1)).alias("present_rows"),
        F.count_if("ok").alias("success_rows"),
        F.count_if(~F.col("ok")).alias("failed_rows"),
    )
    met = rows.select("norm", "word").distinct().join(expected.select("word").distinct(), "word", "left_semi").groupBy("norm").agg(F.count(F.lit(1)).alias("met_words"))
    total = expected.select("word").distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    out = seen.join(met, "norm", "left").join(F.broadcast(total)).withColumn("met_words", F.coalesce("met_words", F.lit(0)))
    missing = F.col("vocabulary") - F.col("met_words")
    share = F.try_divide(F.col("met_words") * 100.0, F.col("vocabulary"))
    verdict = F.when(missing * 2 > F.col("vocabulary"), "MISSING DATA").when(F.col("failed_rows") > 0, "PARSE FAILURES").otherwise("OK")
    return out.select("norm", "present_rows", "success_rows", "failed_rows", "met_words", missing.alias("missing_words"), share.alias("coverage_pct"), verdict.alias("verdict"))
