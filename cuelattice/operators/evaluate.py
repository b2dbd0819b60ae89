"""Evaluation: alignment of vectors with ratings, cross-validated ridge regression, dimension sweeps.

A group of rows (embedding_key, norm) is one regression. It is fitted from sums by fold (``linear``), so neither the number of groups
nor the size of one matters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.text import WANTED_TYPES, bare_name, display_name, key_model, key_type, sweep_name
from cuelattice.functions.vectors import finite
from cuelattice.operators import linear
from cuelattice.operators.sampling import fold_table, sample_by_group
from cuelattice.plans.session import ship_code, written

#: Grids of penalties and rules of the presets.
ALPHAS = {"compare": np.logspace(-2, 6, 12), "self": np.logspace(-3, 5, 20), "human": 10.0 ** np.arange(-3, 4)}
MIN_SAMPLES = 50
SWEEP_DIMS = (16, 32, 64, 128, 256, 384, 512, 768, 1024)
SWEEP_MOST, SWEEP_LEAST = 640, 40


def targets(ratings: DataFrame, duplicates: str = "mean", order: str | Column | None = None) -> DataFrame:
    """(norm, word, y) with one value for repeated ratings: their mean, or the last by ``order``."""
    value = F.avg("rating") if duplicates == "mean" else F.max_by("rating", order)
    return ratings.groupBy("norm", "word").agg(value.alias("y"))


def aligned(vectors: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("embedding_key",)) -> DataFrame:
    """(keys, norm, word, vec, y): vectors met with targets by word; vectors that are not finite go."""
    return vectors.filter(finite(F.col("vec"))).join(wanted, F.col("cue") == F.col("word")).select(*keys, "norm", "word", "vec", "y")


def overlap(behavior: DataFrame, activation: DataFrame) -> DataFrame:
    """(canonical, behavior_key, activation_key): of equal canonical names the last key by name."""
    b = behavior.groupBy("canonical").agg(F.max("embedding_key").alias("behavior_key"))
    a = activation.groupBy("canonical").agg(F.max("embedding_key").alias("activation_key"))
    return b.join(a, "canonical")


def strict_overlap(keys: DataFrame, activation: DataFrame) -> DataFrame:
    """The keys (canonical, ...) whose model has an activation, and the human one."""
    known = activation.select("canonical").distinct().withColumn("__met", F.lit(True))
    return keys.join(known, "canonical", "left").filter("__met or canonical = 'Human'").drop("__met")


def wanted_keys(keys: DataFrame) -> DataFrame:
    """``keys`` (embedding_key, ...) of the types that are compared; those of behavior only if their model has an activation, too."""
    named = keys.withColumns({"__model": key_model(F.col("embedding_key")), "__type": key_type(F.col("embedding_key"))}).filter(F.col("__type").isin(*WANTED_TYPES))
    known = named.filter("__type = 'Activation'").select(F.col("__model").alias("__known")).distinct()
    met = named.join(known, F.col("__model") == F.col("__known"), "left")
    return met.filter("__known is not null or __model = 'Human' or __type = 'Activation'").select(keys.columns)


def by_mapping(keys: DataFrame, files: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(embedding_key, norm_file) of a fixed mapping, for keys and files that are both there."""
    pairs = keys.sparkSession.range(1).select(F.explode(F.create_map(*(F.lit(x) for kv in sorted(mapping.items()) for x in kv))).alias("embedding_key", "norm_file"))
    return pairs.join(keys.select("embedding_key").distinct(), "embedding_key", "left_semi").join(files.select("norm_file").distinct(), "norm_file", "left_semi").select("embedding_key", "norm_file")


def self_scores(vectors: DataFrame, ratings: DataFrame, mapping: dict[str, str], k: int = 5, repeats: int = 5) -> DataFrame:
    """(embedding_source, matched_norm_file, norm_name, self_r2_mean, self_r2_std, n_samples): vectors scored with their own model's ratings.

    ``ratings`` is (model, norm, word, rating), ``model`` being the file; keys and files that ``mapping`` joins and that are
    both there are scored, on the mean of repeated ratings.
    """
    pairs = by_mapping(vectors.select("embedding_key"), ratings.select(F.col("model").alias("norm_file")), mapping)
    wanted = ratings.groupBy(F.col("model").alias("norm_file"), "norm", "word").agg(F.avg("rating").alias("y"))
    keys = ["embedding_key", "norm_file", "norm"]
    matched = wanted.join(F.broadcast(pairs), "norm_file")  # at most a row for each entry of the mapping
    rows = vectors.filter(finite(F.col("vec"))).withColumnRenamed("cue", "word").join(matched, ["embedding_key", "word"]).select(*keys, "word", "vec", "y")
    out = norm_scores(rows, keys, "self", k, repeats)
    return out.select(F.col("embedding_key").alias("embedding_source"), F.col("norm_file").alias("matched_norm_file"), F.col("norm").alias("norm_name"), F.col("r2_mean").alias("self_r2_mean"), F.col("r2_std").alias("self_r2_std"), "n_samples")


def paired_scores(behavior: DataFrame, activation: DataFrame, wanted: DataFrame, preset: str = "compare", k: int = 5, least: int = MIN_SAMPLES, most: int | None = None) -> DataFrame:
    """(model, norm, n_samples, r2_behavior, r2_activation, delta): vectors of both kinds of one model, scored on the same words.

    Behavior keys of shuffled and contrastive sets and the human matrix take no part; of equal names the last key counts. A word is used
    where both vectors are finite. ``most`` words of a norm, picked by md5, are scored if it is given.
    """
    plain = behavior.filter(~F.col("embedding_key").rlike("_contrast|_shuffled") & (F.col("embedding_key") != "human_matrix"))
    named = lambda df: df.select("embedding_key").distinct().withColumn("canonical", sweep_name(bare_name(F.col("embedding_key"))))
    pairs = overlap(named(plain), named(activation))  # a row a model
    wanted = wanted if most is None else sample_by_group(wanted, ["norm"], ["word"], most)
    side = lambda df, key: df.filter(finite(F.col("vec"))).join(F.broadcast(pairs.select("canonical", F.col(key).alias("embedding_key"))), "embedding_key").select("canonical", F.col("cue").alias("word"), F.col("vec").alias(f"{key}_vec"))
    both = side(plain, "behavior_key").join(side(activation, "activation_key"), ["canonical", "word"]).join(wanted, "word")
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(f"{c}_key_vec").alias("vec")) for c in ("behavior", "activation"))))
    rows = both.select("canonical", "norm", "word", "y", kinds.alias("s")).select("canonical", "norm", "s.kind", "word", "s.vec", "y")
    scores = norm_scores(rows, ["canonical", "norm", "kind"], preset, k, 1, least)
    wide = scores.groupBy("canonical", "norm").agg(F.max("n_samples").alias("n_samples"), *(F.max(F.when(F.col("kind") == c, F.col("r2_mean"))).alias(f"r2_{c}") for c in ("behavior", "activation")))
    return wide.select(display_name(F.col("canonical")).alias("model"), "norm", "n_samples", "r2_behavior", "r2_activation", (F.col("r2_activation") - F.col("r2_behavior")).alias("delta"))


def sweep_rows(vectors: DataFrame, ratings: DataFrame, most: int = SWEEP_MOST) -> DataFrame:
    """Rows for ``sweep``: at most ``most`` rated words of a norm that have a vector, the same for every embedding."""
    known = ratings.join(vectors.select(F.col("cue").alias("word")).distinct(), "word", "left_semi")
    picked = sample_by_group(targets(known), ["norm"], ["word"], most)
    return aligned(vectors, picked)


# --- models ------------------------------------------------------------------------------------------------------------


def _fitted(rows: DataFrame, keys: list[str], k: int, repeats: int, standardise: bool, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows by chunk and the models of their training sets, both written."""
    rows = rows.select(*keys, "word", "vec", "y")
    placed = written(linear.grouped(rows, keys, fold_table(rows, keys, ["word"], k, repeats)))
    return placed, written(linear.models(linear.fold_sums(placed), standardise, least))


def _by_fold(placed: DataFrame, fitted: DataFrame, errors: linear.Errors) -> DataFrame:
    """(group, rep, fold, k, loo, r2, n_samples, dimensions)."""
    each = linear.errors_by_fold(placed, fitted, errors)
    width = (F.octet_length("mean") / 8 - 1).cast("int")
    known = fitted.select("group", "rep", "fold", "sst", (F.col("n") + F.col("n_test")).alias("n_samples"), width.alias("dimensions"))
    return each.join(known, ["group", "rep", "fold"]).withColumn("r2", linear.r2_of(F.col("sse"), F.col("sst")))


def norm_scores(rows: DataFrame, keys: list[str], preset: str = "compare", k: int = 5, repeats: int = 1, least: int = MIN_SAMPLES) -> DataFrame:
    """(keys, n_samples, dimensions, r2_mean, r2_std): standardised ridge regressions of ``rows`` (keys, word, vec, y) over k folds.

    A training set's penalty is that with the best leave-one-out predictions, the first among equals. A word that is met more
    than once in a group has all its rows in one fold. A group with under ``least`` rows gives no row.
    """
    placed, fitted = _fitted(rows, keys, k, repeats, True, least)
    each = _by_fold(placed, fitted, linear.ridge_errors(ALPHAS[preset]))
    chosen = each.groupBy("group", "rep", "fold").agg(F.min_by(F.struct("r2", "n_samples", "dimensions"), F.struct("loo", "k")).alias("b"))
    out = chosen.groupBy("group").agg(F.max("b.n_samples").alias("n_samples"), F.max("b.dimensions").alias("dimensions"), F.avg("b.r2").alias("r2_mean"), F.stddev_pop("b.r2").alias("r2_std"))
    return linear.ungrouped(out, keys, rows)


def sweep(rows: DataFrame, keys: list[str], dims: tuple[int, ...] = SWEEP_DIMS, alpha: float = 1.0, least: int = SWEEP_LEAST, k: int = 5, repeats: int = 1) -> DataFrame:
    """(keys, dim, r2, n_samples): ridge on the first principal components of the training rows, for every valid dimension.

    Valid are dimensions up to the width of the vectors and below the share of rows that a training set has.
    """
    placed, fitted = _fitted(rows, keys, k, repeats, False, least)
    each = _by_fold(placed, fitted, linear.width_errors(dims, alpha)).withColumn("dim", F.element_at(F.array(*map(F.lit, dims)), F.col("k") + 1))
    valid = each.filter(f"dim >= 1 and dim <= dimensions and dim < n_samples * {k - 1} div {k}")
    out = valid.groupBy("group", "dim").agg(F.avg("r2").alias("r2"), F.max("n_samples").alias("n_samples"))
    return linear.ungrouped(out, keys, rows)


def gram(vectors: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """(i, j, value): the sums of products of every two columns, i <= j; each task sums its rows first."""
    ship_code(vectors.sparkSession)

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((dim, dim))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, dim)
            total += x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "value"])

    parts = vectors.filter(F.size(vec) == dim).select(vec).mapInArrow(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def line_scores(rows: DataFrame, keys: list[str], x: str = "x", alpha: float = 1.0) -> DataFrame:
    """(keys, weight, intercept, r2): ridge on one standardised column in closed form, fitted and scored on all rows."""
    # with z = (x - mean) / deviation: sum z*z = n and sum z*y = n * cov(x, y) / deviation, so sums by group are enough
    sums = rows.groupBy(*keys).agg(F.covar_pop(x, "y").alias("cov"), F.stddev_pop(x).alias("sd"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"), F.count(F.lit(1)).alias("n"))
    varies = F.col("sd") > 0
    zy = F.when(varies, F.col("n") * F.col("cov") / F.col("sd")).otherwise(0.0)
    zz = F.when(varies, F.col("n").cast("double")).otherwise(0.0)
    weight = zy / (zz + alpha)
    sse = F.col("n") * F.col("vy") - 2 * weight * zy + weight * weight * zz
    return sums.select(*keys, weight.alias("weight"), F.col("my").alias("intercept"), (1 - F.try_divide(sse, F.col("n") * F.col("vy"))).alias("r2"))

