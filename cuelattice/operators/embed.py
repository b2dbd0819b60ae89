"""Embeddings (embedding_key, cue, vec): alignment, catalogue, sanitation, truncated SVD."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.vectors import finite, norm, padded, zeros
from cuelattice.operators import rangefinder
from cuelattice.operators.assoc import dense_index
from cuelattice.plans.session import ship_code, written

#: Smallest norm of a row that counts as non-zero.
EPS = 1e-12
#: Smaller side of a matrix up to which its Gram matrix is made, lines made dense at once, and least singular value to the largest.
GRAM_SIDE, BLOCK, REL = 1024, 1024, 1e-7


def align(cues: DataFrame, vectors: DataFrame, dim: int, key: str = "cue", vec: str = "vec", drop_missing: bool = False) -> DataFrame:
    """Every cue with its vector as doubles; a missing vector or one of another length becomes zeros (or goes)."""
    good = vectors.filter(F.size(vec) == dim).select(key, F.transform(vec, lambda x: x.cast("double")).alias("__v"))
    joined = cues.join(good, key, "inner" if drop_missing else "left")
    return joined.select(*cues.columns, F.col("__v").isNotNull().alias("present"), F.coalesce("__v", zeros(dim)).alias(vec))


def catalog(vectors: DataFrame, key: str = "embedding_key", vec: str = "vec") -> DataFrame:
    """(key, n_rows, dim, dim_least)."""
    return vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(vec)).alias("dim"), F.min(F.size(vec)).alias("dim_least"))


def target_dims(keys: DataFrame, dims: DataFrame, strategy: str = "activation", fixed: int = 300, mapping: dict[str, int] | None = None) -> DataFrame:
    """``keys`` (embedding_key, model) with ``target_dim``: 300 for human_matrix, then by strategy, then ``fixed``.

    activation: the model's activation width from ``dims`` (model, dim); mapping: a given table; fixed: ``fixed``.
    """
    known = F.coalesce(*(F.when(F.col("model") == m, F.lit(d)) for m, d in (mapping or {}).items()), F.lit(None).cast("int"))
    own = dims.groupBy("model").agg(F.max("dim").alias("__dim"))
    found = F.coalesce(F.col("__dim") if strategy == "activation" else F.lit(None).cast("int"), known, F.lit(fixed))
    out = keys.join(own, "model", "left")
    return out.select(*keys.columns, F.when(F.col("embedding_key") == "human_matrix", 300).otherwise(found).alias("target_dim"))


def usable(vec: Column, eps: float = EPS) -> Column:
    return finite(vec) & (norm(vec) > eps)


def sanitized(vectors: DataFrame, key: str = "embedding_key", cue: str = "cue", vec: str = "vec", eps: float = EPS) -> DataFrame:
    """The rows of cues whose vectors are finite and non-zero in every embedding."""
    keys = vectors.select(key).distinct().agg(F.count(F.lit(1)).alias("__keys"))
    good = vectors.groupBy(cue).agg(F.countDistinct(F.when(usable(F.col(vec), eps), F.col(key))).alias("__good"))
    return vectors.join(good.join(F.broadcast(keys)).filter("__good = __keys").select(cue), cue, "left_semi")


def culprits(vectors: DataFrame, key: str = "embedding_key", vec: str = "vec", eps: float = EPS) -> DataFrame:
    """(key, n_rows, n_bad): which embedding costs rows."""
    return vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~usable(F.col(vec), eps)).alias("n_bad"))


def truncated_svd(cells: DataFrame, k: int, row: str = "cue", col: str = "response", value: str = "ppmi", gram_side: int | None = None) -> tuple[DataFrame, list[float]]:
    """(row, vec) = U * sqrt(S) of the sparse matrix of ``cells``, and the singular values, largest first.

    The number of components is at most one below the smaller side; with less than two the vectors are k zeros, and
    vectors are padded with zeros to k. Signs: the entry of largest magnitude of each column of U is positive, the first among equals.
    Components below REL of the largest singular value are left out. A smaller side of up to ``gram_side`` (GRAM_SIDE) takes one pass for
    its Gram matrix, summed by task; what reaches the driver is that matrix. Larger ones go through a randomized range finder
    (``rangefinder``), of which small triangles reach the driver.
    """
    cells = written(cells.select(row, col, F.col(value).cast("double").alias(value)))
    rows = written(dense_index(cells.select(row).distinct(), row, name="__i"))
    cols = written(dense_index(cells.select(col).distinct(), col, name="__j"))
    n, m = rows.count(), cols.count()
    rank = min(k, min(n, m) - 1)
    if rank < 2:
        return rows.select(row, zeros(k).alias("vec")), []
    ship_code(cells.sparkSession)
    placed = cells.join(rows, row).join(cols, col).select(F.col("__i").alias("i"), F.col("__j").alias("j"), F.col(value).alias("x"))
    u, s = _by_gram(placed, n, m, rank) if min(n, m) <= (GRAM_SIDE if gram_side is None else gram_side) else rangefinder.decompose(placed, n, m, rank, least=REL)
    u = written(u)
    peak = u.select(F.posexplode("u").alias("d", "x"), "__i").groupBy("d").agg(F.max_by("x", F.struct(F.abs("x"), -F.col("__i"))).alias("x")).collect()
    scale = [0.0] * len(s)
    for r in peak:  # one row a component
        scale[r["d"]] = (s[r["d"]] ** 0.5) * (1 if r["x"] >= 0 else -1)
    vec = padded(F.zip_with("u", F.lit(scale), lambda x, y: x * y), k)
    return u.join(rows, "__i").select(row, vec.alias("vec")), s


def _blocks(batches: Iterator, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line numbers, dense lines) of cells (line, place, value) that are sorted by line, BLOCK lines at most at a time."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for batch in chain(batches, [None]):
        if batch is not None:
            held = tuple(np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True))
        line, place, x = held
        starts = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, int)
        done = len(starts) if batch is None else max(len(starts) - 1, 0)  # the last line may go on in the next batch
        ends = np.append(starts, len(line))
        for at in range(0, done, BLOCK):
            a, b = ends[at], ends[min(at + BLOCK, done)]
            own = starts[at : min(at + BLOCK, done)]
            dense = np.zeros((len(own), width))
            np.add.at(dense, (np.searchsorted(own, np.arange(a, b), "right") - 1, place[a:b]), x[a:b])
            yield line[own], dense
        held = tuple(h[ends[done] :] for h in held)


def _by_gram(placed: DataFrame, n: int, m: int, rank: int) -> tuple[DataFrame, list[float]]:
    """(__i, u) and the singular values from the Gram matrix of the smaller side."""
    import pyarrow as pa

    side, by_rows = min(n, m), n <= m  # by_rows: the rows are the smaller side
    long, small = ("j", "i") if by_rows else ("i", "j")
    lines = written(placed.select(long, small, "x").repartition(long).sortWithinPartitions(long))

    def sums(batches):
        total = np.zeros((side, side))
        for _, dense in _blocks(batches, side):
            total += dense.T @ dense
        a, b = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], names=["a", "b", "x"])

    gram = np.zeros((side, side))
    found = lines.mapInArrow(sums, "a int, b int, x double").groupBy("a", "b").agg(F.sum("x").alias("x")).toArrow()  # at most side * (side + 1) / 2 rows
    a, b, x = (found.column(c).to_numpy() for c in ("a", "b", "x"))
    gram[a, b] = gram[b, a] = x
    values, vectors = np.linalg.eigh(gram)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    kept = values > max(values[0], 0.0) * REL**2
    s, vectors = np.sqrt(values[kept]), vectors[:, kept]
    spark = placed.sparkSession
    if by_rows:
        return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "__i long, u array<double>"), s.tolist()
    onto = vectors / s  # at most GRAM_SIDE lines

    def project(batches):
        for line, dense in _blocks(batches, side):
            u = dense @ onto
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(list(u), pa.list_(pa.float64()))], names=["__i", "u"])

    return lines.mapInArrow(project, "__i long, u array<double>"), s.tolist()
