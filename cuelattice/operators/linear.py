"""Cross-validated ridge regressions and principal-component sweeps from sums by fold.

Rows are (group, word, vec, y, folds), one a word, where ``folds`` has the word's fold in each repetition. Three steps, none of which
brings a group together in one worker:

1. chunks of a group give a count, means and centred cross products for each (repetition, fold), in one pass; the parts of a
   group are merged in a tree of tasks, so that what one task merges does not grow with the group;
2. the training sums of a fold are those of the other folds, merged; one eigen-decomposition a training set serves all penalties
   or widths;
3. a second pass over the rows adds up the squared errors of leave-one-out predictions (from the leverages) and of the test rows.

Sums are merged by means and centred products, never by raw squares, so that nothing cancels. A chunk is streamed: a worker holds the sums or
models of one group and one batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.plans.session import ship_code, written

#: Rows of a chunk, and parts of sums that one task merges.
CHUNK, MERGED = 65536, 16
#: A column whose deviation is below this share of its mean counts as constant; eigenvalues below this share of the largest are left out.
FLAT, RANK = 1e-12, 1e-13

SUMS = "group string, rep int, fold int, part long, n long, mean binary, cross binary"
ERRORS = "group string, rep int, fold int, loo array<double>, sse array<double>"


# --- sums --------------------------------------------------------------------------------------------------------------


class Sums:
    """Count, means and centred cross products of the columns of z = (x, y)."""

    def __init__(self, n: int, mean: np.ndarray, cross: np.ndarray):
        self.n, self.mean, self.cross = n, mean, cross

    @classmethod
    def of(cls, z: np.ndarray) -> Sums:
        mean = z.mean(axis=0)
        apart = z - mean
        return cls(len(z), mean, apart.T @ apart)

    def merged(self, other: Sums) -> Sums:
        n, gap = self.n + other.n, other.mean - self.mean
        return Sums(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))

    def row(self) -> tuple[int, bytes, bytes]:
        return self.n, self.mean.tobytes(), self.cross.tobytes()

    @classmethod
    def read(cls, n: int, mean: bytes, cross: bytes) -> Sums:
        m = np.frombuffer(mean)
        return cls(n, m, np.frombuffer(cross).reshape(len(m), len(m)))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(column: pa.Array, other: pa.Array) -> Iterator[tuple[tuple, int, int]]:
    """((a, b), start, end) of the runs of equal pairs of two columns."""
    pairs = list(zip(column.to_pylist(), other.to_pylist(), strict=True))
    at = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != pairs[at]:
            yield pairs[at], at, k
            at = k


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.slice(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, chunk, vec, y, folds) sorted by (group, chunk) to SUMS."""
    schema = _schema(SUMS)
    now, held = None, {}

    def out() -> pa.RecordBatch:
        return _batch([(now[0], rep, fold, now[1], *s.row()) for (rep, fold), s in sorted(held.items())], schema)

    for batch in batches:
        for key, a, b in _runs(batch.column("group"), batch.column("chunk")):
            if key != now:
                if held:
                    yield out()
                now, held = key, {}
            part = batch.slice(a, b - a)
            z = np.column_stack([_matrix(part.column("vec")), part.column("y").to_numpy(zero_copy_only=False)])
            folds = _matrix(part.column("folds"))
            for rep in range(folds.shape[1]):
                for fold in np.unique(folds[:, rep]).tolist():
                    s = Sums.of(z[folds[:, rep] == fold])
                    held[rep, fold] = held[rep, fold].merged(s) if (rep, fold) in held else s
    if held:
        yield out()


def _merge(key: tuple, part: pa.Table) -> pa.Table:
    rows = part.sort_by("part").to_pylist()
    total = Sums.read(rows[0]["n"], rows[0]["mean"], rows[0]["cross"])
    for r in rows[1:]:
        total = total.merged(Sums.read(r["n"], r["mean"], r["cross"]))
    return pa.Table.from_batches([_batch([(rows[0]["group"], rows[0]["rep"], rows[0]["fold"], key[3].as_py(), *total.row())], _schema(SUMS))])


def fold_sums(rows: DataFrame) -> DataFrame:
    """SUMS by (group, repetition, fold) of rows (group, chunk, vec, y, folds); ``part`` is 0."""
    ship_code(rows.sparkSession)
    parts = rows.select("group", "chunk", "vec", "y", "folds").repartition("group", "chunk").sortWithinPartitions("group", "chunk").mapInArrow(_chunk_sums, SUMS)
    parts = written(parts)
    most = parts.agg(F.max("part")).first()[0] or 0
    while most > 0:
        parts = parts.withColumn("__node", F.expr(f"part div {MERGED}")).groupBy("group", "rep", "fold", "__node").applyInArrow(_merge, SUMS)
        most //= MERGED
    return parts


# --- models ------------------------------------------------------------------------------------------------------------

MODELS = "group string, rep int, fold int, n long, n_test long, sst double, mean binary, base binary, values binary, weights binary"


def _models(standardise: bool, least: int):
    """Sums of all folds of one (group, repetition) to MODELS: a training set's mean, eigenvectors, eigenvalues and products with y."""

    def fit(part: pa.Table) -> pa.Table:
        rows = part.sort_by("fold").to_pylist()
        sums = [Sums.read(r["n"], r["mean"], r["cross"]) for r in rows]
        out = []
        for k, (r, test) in enumerate(zip(rows, sums, strict=True)):
            others = [s for j, s in enumerate(sums) if j != k]
            if not others or sum(s.n for s in sums) < least:
                continue
            train = others[0]
            for s in others[1:]:
                train = train.merged(s)
            cross, to_y, mean = train.cross[:-1, :-1], train.cross[:-1, -1], train.mean
            scale = np.ones(len(to_y))
            if standardise:
                std = np.sqrt(np.diag(cross) / train.n)
                scale = np.where(std > FLAT * np.abs(mean[:-1]), std, 1)
            values, base = np.linalg.eigh(cross / np.outer(scale, scale))
            values, base = values[::-1], base[:, ::-1]
            kept = values > RANK * max(float(values[0]), 0)
            values, base = values[kept], base[:, kept] / scale[:, None]
            out.append((r["group"], r["rep"], r["fold"], train.n, test.n, float(test.cross[-1, -1]), mean.tobytes(), np.ascontiguousarray(base).tobytes(), values.tobytes(), (base.T @ to_y).tobytes()))
        return pa.Table.from_batches([_batch(out, _schema(MODELS))])

    return fit


def models(sums: DataFrame, standardise: bool, least: int) -> DataFrame:
    return sums.groupBy("group", "rep").applyInArrow(_models(standardise, least), MODELS)


class Model:
    def __init__(self, row: dict):
        self.rep, self.fold, self.n = row["rep"], row["fold"], row["n"]
        mean = np.frombuffer(row["mean"])
        self.mean_x, self.mean_y = mean[:-1], float(mean[-1])
        self.values, self.to_y = np.frombuffer(row["values"]), np.frombuffer(row["weights"])
        self.base = np.frombuffer(row["base"]).reshape(len(self.mean_x), -1)

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean_x) @ self.base


Errors = Callable[[Model, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def ridge_errors(alphas: np.ndarray) -> Errors:
    """Squared errors by penalty: leave-one-out on the training rows, plain on the test rows."""

    def errors(model: Model, train_x, train_y, test_x, test_y):
        over = 1 / (model.values[:, None] + alphas)
        weights = model.to_y[:, None] * over
        t = model.coordinates(train_x)
        left = 1 - 1 / model.n - (t * t) @ over
        loo = (train_y[:, None] - model.mean_y - t @ weights) / np.maximum(left, 1e-12)
        off = test_y[:, None] - model.mean_y - model.coordinates(test_x) @ weights
        return (loo * loo).sum(axis=0), (off * off).sum(axis=0)

    return errors


def width_errors(dims: tuple[int, ...], alpha: float) -> Errors:
    """Squared errors of the test rows by number of principal components."""

    def errors(model: Model, train_x, train_y, test_x, test_y):
        steps = np.cumsum(model.coordinates(test_x) * (model.to_y / (model.values + alpha)), axis=1)
        if not steps.shape[1]:
            steps = np.zeros((len(test_y), 1))
        at = np.minimum(np.array(dims), steps.shape[1]) - 1
        off = test_y[:, None] - model.mean_y - steps[:, at]
        return np.zeros(len(dims)), (off * off).sum(axis=0)

    return errors


def _scored(errors: Errors):
    """Rows sorted by (group, chunk), a chunk's models (``model`` not null) first, to ERRORS by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(ERRORS)
        now, fitted, found = None, [], {}

        def out() -> pa.RecordBatch:
            return _batch([(now[0], rep, fold, a.tolist(), b.tolist()) for (rep, fold), (a, b) in sorted(found.items())], schema)

        for batch in batches:
            for key, a, b in _runs(batch.column("group"), batch.column("chunk")):
                if key != now:
                    if found:
                        yield out()
                    now, fitted, found = key, [], {}
                part = batch.slice(a, b - a)
                n_models = part.num_rows - part.column("model").null_count
                fitted += [Model(r) for r in part.column("model").slice(0, n_models).to_pylist()]
                if n_models == part.num_rows or not fitted:
                    continue
                part = part.slice(n_models)
                x, y, folds = _matrix(part.column("vec")), part.column("y").to_numpy(zero_copy_only=False), _matrix(part.column("folds"))
                for m in fitted:
                    test = folds[:, m.rep] == m.fold
                    got = errors(m, x[~test], y[~test], x[test], y[test])
                    old = found.get((m.rep, m.fold))
                    found[m.rep, m.fold] = got if old is None else (old[0] + got[0], old[1] + got[1])
        if found:
            yield out()

    return run


def errors_by_fold(rows: DataFrame, fitted: DataFrame, errors: Errors) -> DataFrame:
    """(group, rep, fold, k, loo, sse): summed squared errors for each penalty or width k; ``fitted`` are MODELS."""
    ship_code(rows.sparkSession)
    model = F.struct("rep", "fold", "n", "mean", "base", "values", "weights")
    chunks = rows.select("group", "chunk").distinct()
    kind = {f.name: f.dataType for f in rows.schema.fields}
    none = lambda c: F.lit(None).cast(kind[c]).alias(c)
    left = fitted.join(chunks, "group").select("group", "chunk", model.alias("model"), none("vec"), none("y"), none("folds"))
    right = rows.select("group", "chunk", F.lit(None).cast(left.schema["model"].dataType).alias("model"), "vec", "y", "folds")
    both = left.unionByName(right).repartition("group", "chunk").sortWithinPartitions("group", "chunk", F.col("model").isNull())
    parts = both.mapInArrow(_scored(errors), ERRORS)
    each = parts.select("group", "rep", "fold", F.posexplode(F.arrays_zip("loo", "sse")).alias("k", "e"))
    return each.groupBy("group", "rep", "fold", "k").agg(F.sum("e.loo").alias("loo"), F.sum("e.sse").alias("sse"))


def r2_of(sse, sst):
    """1 - SSE / SST; 1 or 0 where the values are constant, as they are met or not."""
    return F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise((sse == 0).cast("double"))


def grouped(rows: DataFrame, keys: list[str], folds: DataFrame) -> DataFrame:
    """``rows`` (keys, word, vec, y) with ``folds`` (keys, word, folds, place) as (group, chunk, vec, y, folds)."""
    out = rows.join(folds, [*keys, "word"])
    return out.select(F.to_json(F.struct(*keys)).alias("group"), F.expr(f"place div {CHUNK}").alias("chunk"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.col("y").cast("double").alias("y"), "folds")


def ungrouped(df: DataFrame, keys: list[str], like: DataFrame) -> DataFrame:
    kinds = like.select(keys).schema
    return df.withColumn("__k", F.from_json("group", kinds)).select(*(F.col(f"__k.{k}").alias(k) for k in keys), *(c for c in df.columns if c != "group"))
