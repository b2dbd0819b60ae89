"""Association tables: long form, vocabulary, counts, row distributions, PPMI.

Matrices are long tables (row, column, value). Totals are aggregated and joined back rather than taken in windows, so a
row or column that holds a third of all cells is summed before it is shuffled and never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions.text import response_set, stripped, word_key
from cuelattice.plans.session import written


def long_form(triplets: DataFrame, slots: tuple[str, ...] = ("r1", "r2", "r3")) -> DataFrame:
    """(id, cue, slot, response_word) of (id, cue, slots...): keys normalised, null and empty responses left out."""
    cells = F.array(*(F.struct(F.lit(s).alias("slot"), F.col(s).alias("word")) for s in slots))
    long = triplets.select("id", word_key(F.col("cue")).alias("cue"), F.explode(cells).alias("c"))
    out = long.select("id", "cue", "c.slot", word_key(F.col("c.word")).alias("response_word"))
    return out.filter("cue is not null and response_word is not null and response_word <> ''")


def exploded_sets(triplets: DataFrame, slots: tuple[str, ...] = ("r1", "r2", "r3")) -> DataFrame:
    """(id, cue, response) by joining the responses to a set with ', ' and splitting it again at commas."""
    sets = triplets.select("id", word_key(F.col("cue")).alias("cue"), response_set(*map(F.col, slots)).alias("response_set"))
    return sets.select("id", "cue", F.explode(F.split("response_set", ",")).alias("part")).select("id", "cue", stripped(F.col("part")).alias("response"))


def frequent(words: DataFrame, col: str, least: int = 5) -> DataFrame:
    """(word, n) of words met at least ``least`` times."""
    return words.groupBy(F.col(col).alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def dense_index(df: DataFrame, *keys: str, name: str = "idx") -> DataFrame:
    """``df`` with places 0..n-1 in the order of ``keys``, which must be unique together.

    Rows are range-partitioned, sorted and written out; a row's place is its place in its range plus the sizes of the ranges
    before. Only one row a range is gathered, so there is no single sorted task, and the rows are shuffled once.
    """
    return numbered(written(in_ranges(df, *map(F.col, keys))), name)


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in ranges of ``order``, each sorted, with ``__m``: the range's number in the upper bits, the place in it in the lower 33.

    The numbers hold for one run only: write the result before it is used twice.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())


def numbered(ranged: DataFrame, name: str) -> DataFrame:
    """The rows of ``in_ranges``, written, with their place over all ranges instead of ``__m``."""
    span = F.shiftright("__m", 33)
    sizes = ranged.groupBy(span.alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), span == F.col("__range")).withColumn(name, place.cast("long")).drop("__range", "__before", "__m")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", tasks: int = 0) -> DataFrame:
    """``left`` joined with ``right`` by ``keys``; if ``tasks`` is given, in so many partitions, whatever the session's number is.

    A task sorts its share of both sides, so ``tasks`` is to grow with them. Both sides are dealt: the planner would else take
    the number of a side that is grouped already. It does not split the partition of a frequent key then, so such a key's
    rows should be few beside all rows, as the different responses of a cue are.
    """
    if tasks:
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.join(right, keys, how)


def in_vocabulary(pairs: DataFrame, vocabulary: DataFrame, *cols: str, tasks: int = 0) -> DataFrame:
    """The rows whose ``cols`` are all words of ``vocabulary`` (word, ...); ``tasks`` as in ``joined``."""
    for c in cols:
        pairs = joined(pairs, vocabulary.select(F.col("word").alias(c)), [c], "left_semi", tasks)
    return pairs


def pair_counts(pairs: DataFrame, row: str = "cue", col: str = "response") -> DataFrame:
    return pairs.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))


def ppmi(cells: DataFrame, rows: list[str], cols: list[str], value: str = "n", smooth: float = 1e-10, name: str = "ppmi", by: tuple[str, ...] = (), tasks: int = 0) -> DataFrame:
    """``cells`` with positive pointwise mutual information; cells that are not above zero are left out.

    max(0, log2(v * total / (row total * column total + smooth))), for each matrix that ``by`` tells apart. Cells whose
    score is 0 stay. Row, column and matrix totals are summed before they are shuffled and joined back. The cells are needed
    for each total and once more, so they are written out first: counting them is dearer than reading them. ``tasks`` as in ``joined``.
    """
    v, by = F.col(value), list(by)
    cells = written(cells.filter(v > 0))
    by_row = cells.groupBy(*by, *rows).agg(F.sum(v).alias("__r"))
    by_col = cells.groupBy(*by, *cols).agg(F.sum(v).alias("__c"))
    total = cells.groupBy(*by).agg(F.sum(v).alias("__t"))
    out = joined(joined(cells, by_row, [*by, *rows], tasks=tasks), by_col, [*by, *cols], tasks=tasks)
    out = out.join(total, by) if by else out.join(F.broadcast(total))  # without groups: one row
    score = F.greatest(F.lit(0.0), F.log2(v * F.col("__t") / (F.col("__r") * F.col("__c") + F.lit(smooth))))
    return out.withColumn(name, score).drop("__r", "__c", "__t")


def row_distribution(scores: DataFrame, rows: list[str], col: str, log_prob: str = "lp") -> DataFrame:
    """(rows, col, prob): the mean log-probability of each pair, exponentiated and divided by its row's sum.

    Pairs without any log-probability are left out; a row whose sum is not positive gets 0.
    """
    pairs = scores.filter(F.col(log_prob).isNotNull() & ~F.isnan(log_prob)).groupBy(*rows, col).agg(F.exp(F.avg(log_prob)).alias("__p"))
    sums = pairs.groupBy(*rows).agg(F.sum("__p").alias("__s"))
    return pairs.join(sums, rows).select(*rows, col, F.when(F.col("__s") > 0, F.col("__p") / F.col("__s")).otherwise(0.0).alias("prob"))


def side_by_side(real: DataFrame, shuffled: DataFrame) -> DataFrame:
    """The contrast matrix: both tables with a ``block`` that belongs to the column key."""
    return real.withColumn("block", F.lit("real")).unionByName(shuffled.withColumn("block", F.lit("shuffled")))
