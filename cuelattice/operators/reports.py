"""Reports over score tables: leaderboards, pivots, gains, distributions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions.stats import correlation, interval, poisson, slope, standard_error
from cuelattice.operators.sampling import salted
from cuelattice.plans.session import written

#: Bins that a group's values are counted into at once, and rows of a window that may be sorted.
BINS, FEW = 4096, 1024


def leaderboard(scores: DataFrame, by: list[str], value: str = "r2") -> DataFrame:
    """Mean score and number of rows by key, best first."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean_score"), F.count(value).alias("n_scores")).orderBy(F.desc("mean_score"), *by)


def best_rows(scores: DataFrame, by: list[str], name: Column, value: str = "r2") -> DataFrame:
    """By key the name with the highest score (the first by name among equals) and its score."""
    top = F.max(F.struct(F.col(value))).alias("top")
    tops = scores.groupBy(*by).agg(top).select(*by, F.col(f"top.{value}").alias("best_score"))
    named = scores.withColumn("__name", name).join(tops, by).filter(F.col(value) == F.col("best_score"))
    return named.groupBy(*by).agg(F.min("__name").alias("best_name"), F.max("best_score").alias("best_score"))


def pivoted(scores: DataFrame, rows: list[str], columns: str, values: list[str], value: str = "r2") -> DataFrame:
    """A row by key with the mean score of each of ``values`` and ``row_mean``, the mean of all its scores."""
    wide = scores.groupBy(*rows).pivot(columns, values).agg(F.avg(value))
    means = scores.groupBy(*rows).agg(F.avg(value).alias("row_mean"))
    return wide.join(means, rows)


def pivoted_unique(scores: DataFrame, rows: list[str], columns: str, values: list[str], value: str = "r2") -> DataFrame:
    """As ``pivoted`` without means, for keys that occur once; a repeated key is an error when the result is computed."""
    single = F.when(F.count(value) <= 1, F.first(value)).otherwise(F.raise_error(F.lit("a pivot key occurs more than once")))
    return scores.groupBy(*rows).pivot(columns, values).agg(single)


def modality_gap(scores: DataFrame, by: list[str], kind: str, first: str, second: str, value: str = "r2") -> DataFrame:
    """By key the means of two kinds and their difference; keys that lack either go."""
    wide = scores.groupBy(*by).agg(F.avg(F.when(F.col(kind) == first, F.col(value))).alias("first_mean"), F.avg(F.when(F.col(kind) == second, F.col(value))).alias("second_mean"))
    return wide.filter("first_mean is not null and second_mean is not null").withColumn("delta", F.col("second_mean") - F.col("first_mean"))


def preferred_gap(scores: DataFrame, by: list[str], kind: str, preferred: list[str], other: str, value: str = "r2") -> DataFrame:
    """``modality_gap`` between ``other`` and the first of the ``preferred`` kinds that occurs in any row."""
    rank = F.coalesce(*(F.when(F.col(kind) == k, F.lit(n)) for n, k in enumerate(preferred)))
    best = scores.agg(F.min(rank).alias("__best"))  # one row
    named = scores.join(F.broadcast(best)).withColumn("__kind", F.when(F.col(kind) == other, "other").when(rank == F.col("__best"), "chosen"))
    return modality_gap(named, by, "__kind", "chosen", "other", value)


def fitted_line(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """By key the least-squares line of y on x; null where x is constant."""
    b = slope(F.col(y), F.col(x))
    return points.groupBy(*by).agg(b.alias("slope"), (F.avg(y) - b * F.avg(x)).alias("intercept"), F.count(F.lit(1)).alias("n_points"))


def saturation(scores: DataFrame, value: str = "r2", flat: float = 0.005, slow: float = 0.01) -> DataFrame:
    """By (modality, dim): mean, standard error, count, gain over the dimension before, and a status.

    The status is Rising also where there is no dimension before.
    """
    summed = scores.groupBy("modality", "dim").agg(F.avg(value).alias("mean_r2"), standard_error(F.col(value)).alias("sem_r2"), F.count(value).alias("n_scores"))
    gain = F.col("mean_r2") - F.lag("mean_r2").over(Window.partitionBy("modality").orderBy("dim"))
    status = F.when(F.col("gain") < flat, "SATURATED").when(F.col("gain") < slow, "Plateauing").otherwise("Rising")
    return summed.withColumn("gain", gain).withColumn("status", status)


def quantiles(rows: DataFrame, by: list[str], value: str, probabilities: tuple[float, ...]) -> DataFrame:
    """(by, p, quantile): exact quantiles with linear interpolation, by narrowing down on counts of bins.

    Each pass cuts what is left around a wanted rank into BINS bins, counts them before any shuffle, and goes on with the bin
    that holds the rank; a window of at most FEW rows is sorted. So no buffer grows with a group, however large. Nulls and NaN
    are left out. Passes over the rows: one or two on even values, more where values are far from even.
    """
    v = F.col(value).cast("double")
    rows = rows.filter(F.col(value).isNotNull() & ~F.isnan(v)).select(*(F.col(c).alias(f"__{c}") for c in by), v.alias("__v"))
    met = F.lit(True)
    for c in by:
        met = met & F.col(f"__{c}").eqNullSafe(F.col(c))
    sizes = rows.groupBy(*(F.col(f"__{c}").alias(c) for c in by)).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    at = sizes.withColumn("p", F.explode(F.array(*map(F.lit, probabilities)))).withColumn("h", (F.col("n") - 1) * F.col("p"))
    wanted = at.withColumn("place", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))))
    state = written(wanted.select(*by, "p", "h", "place", F.col("place").alias("rank"), "n", "low", "high"))
    open_ = "low < high and n > " + str(FEW)
    done = state.filter(f"not ({open_})")
    keys = [*by, "p", "place"]
    while not state.filter(open_).isEmpty():
        left = state.filter(open_)
        inside = rows.join(left, met & F.col("__v").between(F.col("low"), F.col("high")))
        # halves, so that a range beyond the largest double is none that is not finite
        share = (F.col("__v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        binned = inside.withColumn("b", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counts = binned.groupBy(*keys, "h", "rank", "b").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("b")) - F.col("n")  # at most BINS rows a target
        hit = counts.withColumn("before", before).filter("before <= rank and rank < before + n")
        state = written(hit.select(*by, "p", "h", "place", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high"))
        done = done.unionByName(state.filter(f"not ({open_})"))
    flat = done.filter("low = high").select(*by, "p", "h", "place", F.col("low").alias("x"))
    small = rows.join(done.filter("low < high"), met & F.col("__v").between(F.col("low"), F.col("high")))
    picked = small.groupBy(*keys, "h", "rank").agg(F.sort_array(F.collect_list("__v")).alias("v"))  # at most FEW values
    x = flat.unionByName(picked.select(*by, "p", "h", "place", F.element_at("v", (F.col("rank") + 1).cast("int")).alias("x")))
    ends = x.groupBy(*by, "p", "h").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return ends.select(*by, "p", (F.col("x0") + (F.col("h") - F.floor("h")) * (F.col("x1") - F.col("x0"))).alias("quantile"))


def distribution(rows: DataFrame, by: list[str], value: str, accuracy: int | None = None) -> DataFrame:
    """By key: median, quartiles, mean, its interval, least and most.

    Quantiles are exact (``quantiles``); with ``accuracy`` they come in the one pass of the other numbers from a mergeable sketch
    of bounded size instead, off by at most n / accuracy ranks.
    """
    low, high = interval(F.col(value))
    rest = [F.avg(value).alias("mean"), low.alias("ci_low"), high.alias("ci_high"), F.min(value).alias("least"), F.max(value).alias("most")]
    names = {0.5: "median", 0.25: "lower_quartile", 0.75: "upper_quartile"}
    if accuracy is not None:
        return rows.groupBy(*by).agg(*(F.percentile_approx(value, p, accuracy).alias(n) for p, n in names.items()), *rest)
    found = quantiles(rows, by, value, tuple(names)).groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in names.items()))
    summed = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(*rest)
    met = F.lit(True)
    for c in by:
        met = met & F.col(f"__{c}").eqNullSafe(F.col(c))
    return summed.join(found, met, "left").select(*(F.col(f"__{c}").alias(c) for c in by), *names.values(), "mean", "ci_low", "ci_high", "least", "most")


def bootstrap(rows: DataFrame, by: list[str], value: str, key: str, replicates: int = 200, level: float = 0.95, seed: int | str = 42) -> DataFrame:
    """By key of ``by``: the mean, and the percentile interval of its Poisson bootstrap; n_replicates are those with any weight.

    A row's weight in a replicate is a Poisson number of mean 1, read from 16 bits of the md5 of its ``key``, so that replicates are the
    same in any engine and partitioning. Eight replicates come from one md5 and are summed side by side; sums are made
    before the shuffle, so one pass and a row for each (by, eight replicates) and task are all that moves.
    """
    eights = -(-replicates // 8)
    many = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"), F.col(key).alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(eights - 1))).alias("__c"))
    many = many.withColumn("__md5", salted(F.col("__key"), F.col("__c"), seed=seed))
    weight = lambda r: poisson(F.conv(F.substring("__md5", 4 * r + 1, 4), 16, 10).cast("int"))
    sums = many.select(*by, "__c", "__x", *(weight(r).alias(f"__w{r}") for r in range(8))).groupBy(*by, "__c")
    summed = sums.agg(*(F.struct(F.lit(r).alias("r"), F.sum(f"__w{r}").alias("w"), F.sum(F.col(f"__w{r}") * F.col("__x")).alias("x")).alias(f"__s{r}") for r in range(8)))
    each = summed.select(*by, "__c", F.explode(F.array(*(f"__s{r}" for r in range(8)))).alias("s")).filter(F.col("__c") * 8 + F.col("s.r") < replicates)
    means = each.select(*by, F.try_divide(F.col("s.x"), F.col("s.w")).alias("m"))
    edge = (1 - level) / 2
    ends = means.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.percentile("m", edge).alias("ci_low"), F.percentile("m", 1 - edge).alias("ci_high"), F.count("m").alias("n_replicates"))  # ``replicates`` values a group
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
    whole = rows.groupBy(*by).agg(F.avg(value).alias("mean"))
    return whole.join(ends, met).select(*by, "mean", "ci_low", "ci_high", "n_replicates")


def density(rows: DataFrame, by: list[str], value: str, bins: int = 512) -> DataFrame:
    """(by, bin, x, density): a kernel density on the middles of equal bins between the least and the greatest value of a group.

    Epanechnikov kernel, width by Scott's rule (the population deviation times n**-0.2), at least a bin. Rows are counted into bins; the kernel's sum over
    bins comes from prefix sums of counts, places and squared places, so that its width costs nothing. A group of a single
    value has no density and no rows. Nulls and NaN are left out.
    """
    v = F.col(value).cast("double")
    rows = rows.filter(F.col(value).isNotNull() & ~F.isnan(v)).select(*by, v.alias("__v"))
    stats = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.stddev_pop("__v").alias("sd"), F.count(F.lit(1)).alias("n")).filter("low < high")
    stats = stats.withColumn("w", (F.col("high") - F.col("low")) / bins).withColumn("h", F.greatest(F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.col("w")))
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
    keys = [f"__{c}" for c in by]
    place = F.least(F.floor((F.col("__v") - F.col("low")) / F.col("w")), F.lit(bins - 1))
    counts = rows.join(stats, met).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    dense = stats.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), F.lit(0).cast("long").alias("c")).unionByName(counts).groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
    run = Window.partitionBy(*keys).orderBy("bin")
    power = lambda k: F.sum(F.col("c") * F.pow(F.col("bin").cast("double"), F.lit(k))).over(run)
    sums = dense.select(*keys, "bin", *(power(k).alias(f"s{k}") for k in range(3)))
    every = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.lit(True)
    for c in keys:
        own = own & F.col(c).eqNullSafe(F.col(f"{c}__"))
    sums = sums.join(stats.select(*(F.col(c).alias(f"{c}__") for c in keys), "low", "w", "h", "n"), own).withColumn("k", F.floor(F.col("h") / F.col("w")))
    listed = lambda k: F.collect_list(f"s{k}").over(every)  # noqa: E731  ``bins`` numbers a group
    upto = lambda k, i: F.when(i < 0, 0.0).otherwise(F.get(listed(k), F.least(i, F.lit(bins - 1)).cast("int")))
    span = [upto(k, F.col("bin") + F.col("k")) - upto(k, F.col("bin") - F.col("k") - 1) for k in range(3)]
    around = sums.select(*keys, "bin", "low", "w", "h", "n", *(x.alias(f"d{k}") for k, x in enumerate(span)))
    g, ratio = F.col("bin").cast("double"), F.col("w") / F.col("h")
    total = F.col("d0") - (F.col("d2") - 2 * g * F.col("d1") + g * g * F.col("d0")) * ratio * ratio
    return around.select(*(F.col(f"__{c}").alias(c) for c in by), "bin", (F.col("low") + (g + 0.5) * F.col("w")).alias("x"), (0.75 * total / (F.col("n") * F.col("h"))).alias("density"))


def histogram(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Counts by bucket of ``width``: the table behind a density plot."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, (F.floor(F.col(value) / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def extremes(rows: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """The n highest and the n lowest rows, each once, with the end they belong to (top if both)."""
    top = rows.orderBy(F.desc(value), key).limit(n).withColumn("end", F.lit("top"))
    bottom = rows.orderBy(value, key).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom.join(top.select(key), key, "left_anti").select(top.columns))


def merged(human: DataFrame, own: DataFrame, keys: list[str], value: str = "r2") -> DataFrame:
    """Rows of both tables by key, with the scores as ``r2_human`` and ``r2_self``."""
    return human.select(*keys, F.col(value).alias("r2_human")).join(own.select(*keys, F.col(value).alias("r2_self")), keys)


def merged_correlation(both: DataFrame, by: list[str]) -> DataFrame:
    return both.groupBy(*by).agg(correlation(F.col("r2_human"), F.col("r2_self")).alias("r"), F.count(F.lit(1)).alias("n"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by ``order``; ties beyond it must not matter."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` added or put in place of those of the same key; ``new`` has a key once."""
    return new.unionByName(old.join(new.select(keys), keys, "left_anti"))
