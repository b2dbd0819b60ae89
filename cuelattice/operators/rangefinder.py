"""Truncated SVD of a large sparse matrix by a randomized range finder; no vector of a side's length is ever in one place.

The matrix is cut into packs of at most ``PACK`` cells within blocks of ``SIDE`` lines and ``SIDE`` places. A tall dense matrix
is a table of blocks of ``ROWS`` lines. The product of the sparse matrix and a tall one brings each pack together with the lines of the
tall one that it needs and adds up partial blocks by a shuffle. The first tall matrix, the sketch, is drawn anew from its block's number
wherever it is needed and so is never stored. Tall matrices are orthogonalised by QR factors of tasks, combined in a tree down to one
small triangle; that triangle's inverse is applied within the next product. Between the first and last product the basis goes through
``power`` steps of the matrix and its transpose, orthogonalised each time.

What reaches the driver are triangles of (components + OVER)**2 numbers, at most TREE of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.plans.session import ship_code, written

#: Lines of a block of the sparse matrix and of the tall ones, cells of a pack, triangles that one task of the tree combines.
SIDE, ROWS, PACK, TREE = 4096, 256, 1 << 18, 16
#: Columns of the sketch beyond the components asked for, power steps, and the share of the largest below which a direction counts as none.
OVER, POWER, NONE = 16, 4, 1e-12
SEED = 42

PACKS = "pack long, ib long, jb long, ii binary, jj binary, xx binary"
PARTS = "sb long, lines binary, cells binary"
TALL = "sb long, cells binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _schema(ddl)
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (ib, jb, i, j, x) sorted by block to (ib, jb, ii, jj, xx) of at most PACK cells; all packs of a block but its last are full."""
    names, kinds = ["ib", "jb", "ii", "jj", "xx"], (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    held = [np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, float)]
    for batch in chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        ib, jb, i, j, x = held
        new, done = np.flatnonzero((np.diff(ib, prepend=-1) != 0) | (np.diff(jb, prepend=-1) != 0)), 0
        for a, end in zip(new, [*new[1:], len(ib)][: len(new)], strict=True):
            for at in range(a, end, PACK):
                b = min(at + PACK, end)
                if batch is not None and b == len(ib) and b - at < PACK:
                    continue  # the next batch may go on with this pack
                row = [int(ib[a]), int(jb[a]), (i[at:b] - ib[a] * SIDE).astype(np.int32).tobytes(), (j[at:b] - jb[a] * SIDE).astype(np.int32).tobytes(), x[at:b].astype(float).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
                done = b
        held = [h[done:] for h in held]


def packs(cells: DataFrame) -> DataFrame:
    """PACKS of cells (i, j, x)."""
    ship_code(cells.sparkSession)
    placed = cells.select(F.expr(f"i div {SIDE}").alias("ib"), F.expr(f"j div {SIDE}").alias("jb"), "i", "j", "x")
    found = placed.repartition("ib", "jb").sortWithinPartitions("ib", "jb").mapInArrow(_packed, "ib long, jb long, ii binary, jj binary, xx binary")
    return written(found.select(F.monotonically_increasing_id().alias("pack"), "ib", "jb", "ii", "jj", "xx"))


def turned(table: DataFrame) -> DataFrame:
    """The packs of the transpose."""
    return table.select("pack", F.col("jb").alias("ib"), F.col("ib").alias("jb"), F.col("jj").alias("ii"), F.col("ii").alias("jj"), "xx")


def _times(pack: dict, lines: np.ndarray) -> pa.Table:
    """A pack times the lines of its place block, as PARTS: sums for the lines that it has, by blocks of ROWS."""
    i, j, x = np.frombuffer(pack["ii"], np.int32), np.frombuffer(pack["jj"], np.int32), np.frombuffer(pack["xx"])
    order = np.argsort(i, kind="stable")
    i, j, x = i[order], j[order], x[order]
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    own = i[starts]
    total = np.empty((len(own), lines.shape[1]))
    for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(i)), strict=True)):
        total[k] = x[a:b] @ lines[j[a:b]]
    rows = []
    for sub in np.unique(own // ROWS):
        met = own // ROWS == sub
        rows.append((pack["ib"] * (SIDE // ROWS) + int(sub), (own[met] % ROWS).astype(np.int32).tobytes(), total[met].tobytes()))
    return _table(rows, PARTS)


def _summed(width: int):
    def add(part: pa.Table) -> pa.Table:
        out = np.zeros((ROWS, width))
        for lines, cells in zip(part.column("lines").to_pylist(), part.column("cells").to_pylist(), strict=True):
            out[np.frombuffer(lines, np.int32)] += np.frombuffer(cells).reshape(-1, width)
        everywhere = np.arange(ROWS, dtype=np.int32).tobytes()
        return _table([(part.column("sb")[0].as_py(), everywhere, out.tobytes())], PARTS)

    return add


def _gathered(parts: DataFrame, width: int, n_blocks: int) -> DataFrame:
    """Partial blocks added up; with many place blocks in two steps, so that a task adds a bounded number."""
    ship_code(parts.sparkSession)
    if n_blocks > TREE:
        some = parts.withColumn("__k", F.pmod(F.xxhash64("lines", F.substring("cells", 1, 64)), F.lit(-(-n_blocks // TREE))))
        parts = some.groupBy("sb", "__k").applyInArrow(_summed(width), PARTS)
    return written(parts.groupBy("sb").applyInArrow(_summed(width), PARTS).select("sb", "cells"))


def sketched(table: DataFrame, width: int, n_blocks: int) -> DataFrame:
    """TALL: the packs times the sketch."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        (pack,) = part.to_pylist()
        return _times(pack, np.random.Generator(np.random.Philox(key=[SEED, pack["jb"]])).standard_normal((SIDE, width)))

    return _gathered(table.groupBy("pack").applyInArrow(run, PARTS), width, n_blocks)


def times(table: DataFrame, tall: DataFrame, onto: np.ndarray, n_blocks: int) -> DataFrame:
    """TALL: the packs times (tall @ onto)."""
    given, width = onto.shape
    held = table.sparkSession.sparkContext.broadcast(onto)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], PARTS)
        (pack,) = left.to_pylist()
        lines = np.zeros((SIDE, width))
        for sb, cells in zip(right.column("sb").to_pylist(), right.column("cells").to_pylist(), strict=True):
            at = sb % (SIDE // ROWS) * ROWS
            lines[at : at + ROWS] = np.frombuffer(cells).reshape(ROWS, given) @ held.value
        return _times(pack, lines)

    wanted = tall.withColumn("jb", F.expr(f"sb div {SIDE // ROWS}")).join(table.select(F.col("pack").alias("of"), "jb"), "jb").select("of", "sb", "cells")
    return _gathered(table.groupBy("pack").cogroup(wanted.groupBy("of")).applyInArrow(run, PARTS), width, n_blocks)


def triangle(tall: DataFrame, width: int) -> np.ndarray:
    """The triangle R of a QR factorisation of a tall matrix, by factors of tasks and a tree over them."""

    def reduce(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        r = None
        for b in blocks:
            r = np.linalg.qr(b if r is None else np.vstack([r, b]), mode="r")
        return r

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduce(np.frombuffer(c).reshape(-1, width) for b in batches for c in b.column("cells").to_pylist())
        if r is not None:
            yield from _table([(0, r.tobytes())], TALL).to_batches()

    def combine(part: pa.Table) -> pa.Table:
        return _table([(0, reduce(np.frombuffer(c).reshape(-1, width) for c in part.column("cells").to_pylist()).tobytes())], TALL)

    found = written(tall.mapInArrow(by_task, TALL))
    n = found.count()
    while n > TREE:
        found = written(found.withColumn("sb", F.expr(f"monotonically_increasing_id() % {-(-n // TREE)}")).groupBy("sb").applyInArrow(combine, TALL))
        n = found.count()
    return reduce(np.frombuffer(r["cells"]).reshape(-1, width) for r in found.collect())  # at most TREE small triangles


def orthogonal(tall: DataFrame, width: int) -> np.ndarray:
    """The matrix that makes a tall one's columns orthonormal; directions that it lacks are left out."""
    _, s, vt = np.linalg.svd(triangle(tall, width), full_matrices=False)
    kept = s > NONE * s[0]
    return vt.T[:, kept] / s[kept]


def decompose(cells: DataFrame, n: int, m: int, rank: int, power: int = POWER, least: float = 1e-7) -> tuple[DataFrame, list[float]]:
    """(__i, u) and the singular values, largest first, of the n by m matrix of cells (i, j, x); values below ``least`` of the largest go.

    Exact to rounding if the matrix has at most ``rank`` + OVER directions; else the error falls with the gap between the values asked
    for and those beyond, to the power 2 * ``power`` + 1.
    """
    ship_code(cells.sparkSession)
    width = min(rank + OVER, n, m)
    table = packs(cells)
    across, down = -(-m // SIDE), -(-n // SIDE)
    flipped = turned(table)
    tall = sketched(table, width, across)
    onto = orthogonal(tall, width)
    for _ in range(power):
        back = times(flipped, tall, onto, down)
        turn = orthogonal(back, onto.shape[1])
        tall = times(table, back, turn, across)
        onto = orthogonal(tall, turn.shape[1])
    back = times(flipped, tall, onto, down)
    w, s, _ = np.linalg.svd(triangle(back, onto.shape[1]).T, full_matrices=False)
    kept = s[:rank] > max(s[0], 0.0) * least
    s, last = s[:rank][kept], (onto @ w[:, :rank])[:, kept]
    given, held = last.shape[0], cells.sparkSession.sparkContext.broadcast(last)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sb, c in zip(batch.column("sb").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                u = (np.frombuffer(c).reshape(ROWS, given) @ held.value)[: max(0, n - sb * ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(u)) + sb * ROWS, pa.int64()), pa.array(list(u), pa.list_(pa.float64()))], names=["__i", "u"])

    return tall.mapInArrow(lines, "__i long, u array<double>"), s.tolist()
