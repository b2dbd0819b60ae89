"""Deterministic sampling: shards, samples by group, folds, derangement. Chance is the order of md5(key, seed)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.operators.assoc import dense_index, in_ranges, numbered
from cuelattice.plans.session import ship_code, written


def salted(*keys: Column, seed: int | str = 42) -> Column:
    """A hexadecimal md5 of the keys and the seed, joined by '|'."""
    return F.md5(F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(str(seed))).cast("binary"))


def shard(df: DataFrame, id_col: str, n: int, i: int) -> DataFrame:
    return df.filter(F.pmod(F.col(id_col), F.lit(n)) == i)


def sample_by_group(df: DataFrame, groups: list[str], keys: list[str], n: int, seed: int | str = 42) -> DataFrame:
    """At most n rows of each group, in md5 order; ``keys`` must be unique in a group."""
    order = Window.partitionBy(*groups).orderBy(salted(*map(F.col, keys), seed=seed), *keys)
    return df.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= n).drop("__place")


def _placed(df: DataFrame, groups: list[str], keys: list[str], repeats: int, seed: int | str) -> DataFrame:
    """``df`` once for each repeat, with ``rep`` and ``place``, from 0 in md5 order in every (groups, rep).

    Places come from ranges of that order over all rows and the first place of each group, so a group that holds most rows is
    split like any other; nulls are groups, too.
    """
    many = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by = [*groups, "rep"]
    placed = written(dense_index(many.withColumn("__h", salted(*map(F.col, keys), F.col("rep"), seed=seed)), *by, "__h", *keys, name="__at"))
    first = placed.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min("__at").alias("__first"))
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return placed.join(first, met).select(*df.columns, "rep", (F.col("__at") - F.col("__first")).alias("place"))


def folds(df: DataFrame, groups: list[str], keys: list[str], k: int = 5, repeats: int = 1, seed: int | str = 42) -> DataFrame:
    """``df`` once for each repeat, with ``rep`` and ``fold``: balanced within one row in every group."""
    return _placed(df, groups, keys, repeats, seed).withColumn("fold", F.pmod("place", F.lit(k)).cast("int")).drop("place")


def fold_table(df: DataFrame, groups: list[str], keys: list[str], k: int = 5, repeats: int = 1, seed: int | str = 42) -> DataFrame:
    """(groups, keys, folds, place): the folds of ``folds`` as an array by repeat, and a row's place in its group; repeated keys count once."""
    placed = _placed(df.select(*groups, *keys).distinct(), groups, keys, repeats, seed)
    each = F.sort_array(F.collect_list(F.struct("rep", F.pmod("place", F.lit(k)).cast("int").alias("fold"), "place")))  # ``repeats`` entries
    out = placed.groupBy(*groups, *keys).agg(each.alias("__e"))
    return out.select(*groups, *keys, F.col("__e.fold").alias("folds"), F.col("__e")[0]["place"].alias("place"))


def _runs(batches: Iterator) -> Iterator:
    """(t, n) from sorted 16-byte keys t: of each batch the runs of equal keys at both ends, which may go on in another one, and the longest in between."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            t = batch.column(0)
            x = np.frombuffer(b"".join(t.to_pylist()), np.uint64).reshape(-1, 2)
            starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))
            n = np.diff(np.append(starts, len(x)))
            kept = np.unique([0, len(n) - 1, *([1 + int(n[1:-1].argmax())] if len(n) > 2 else [])])
            yield pa.RecordBatch.from_arrays([t.take(pa.array(starts[kept])), pa.array(n[kept], pa.int64())], names=["t", "n"])


def derange(df: DataFrame, id_col: str, cols: list[str], seed: int | str = 42) -> DataFrame:
    """``df`` with the tuples of ``cols`` dealt to other rows: none keeps a tuple equal to its own, all tuples stay.

    Rows are placed by the md5 of their tuple, so equal tuples are neighbours; each row then takes the tuple as many places
    on as the largest group of equal tuples has rows. ValueError if that group has over half of the rows. The md5 is made anew
    from the tuple where it is needed, as it would be as long as the row in a shuffle.
    """
    shown = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("NA")) for c in cols))
    hashed = F.unhex(F.md5(F.concat(shown, F.lit(f"|{seed}")).cast("binary")))
    ranged = written(in_ranges(df, hashed, F.col(id_col)))
    ship_code(df.sparkSession)
    runs = ranged.select(hashed.alias("t")).mapInArrow(_runs, "t binary, n long")
    n, shift = ranged.count(), runs.groupBy("t").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if 2 * shift > n:
        raise ValueError("over half of the rows hold the same tuple")
    placed = numbered(ranged, "__at")
    giver = placed.select(F.pmod(F.col("__at") - shift, F.lit(max(n, 1))).alias("__at"), *(F.col(c).alias(f"__{k}") for k, c in enumerate(cols)))
    others = [c for c in df.columns if c not in cols]
    return placed.select("__at", *others).join(giver, "__at").select(*others, *(F.col(f"__{k}").alias(c) for k, c in enumerate(cols))).select(df.columns)


def conflicts(before: DataFrame, after: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """One row: how many rows there are, and how many kept their tuple (null without rows).

    Rows meet with a hash of their tuple first; tuples themselves are moved and compared only for ids whose hashes agree.
    """
    hashed = lambda d, n: d.select(id_col, F.hash(*cols).alias(n))
    met = hashed(before, "a").join(hashed(after, "b").hint("merge"), id_col)  # estimates of exploded rows are too low to broadcast by
    rows, alike = met.agg(F.count(F.lit(1)), F.sum((F.col("a") == F.col("b")).cast("long"))).first()
    if alike:
        ids = written(met.filter("a = b").select(id_col).distinct())
        a, b = (d.join(ids, id_col, "left_semi").select(id_col, F.struct(*cols).alias(n)) for d, n in ((before, "a"), (after, "b")))
        alike = a.join(b, id_col).agg(F.sum(F.col("a").eqNullSafe(F.col("b")).cast("long"))).first()[0]
    return before.sparkSession.createDataFrame([(rows, alike)], "n_rows long, n_conflicts long")
