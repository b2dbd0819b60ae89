"""Hard negatives by a blocked matrix product of anchors and rows (the SUMMA scheme).

The rows of a vector table, in the order of their labels, are cut into blocks of ``BLOCK_ROWS`` rows, the anchors among
them into blocks of ``BLOCK_ANCHORS``, and both into chunks of dimensions. A block of anchors meets a block of rows once for each
chunk, which gives a partial tile of integer scores; the partial tiles of a pair of blocks are shuffled together and added, and the
whole tile is reduced in place to its best rows, so that no score leaves it that cannot be among the first. Two products are made:

1. over pairs of blocks that may share a label: the ``n_positives`` best other rows of an anchor's label, its positives;
2. over all but the pairs of a single shared label: for each anchor and positive the ``n_negatives`` best rows of other labels whose
   score lies in the positive's window, from ``share`` percent of the positive's score up to that score.

The tiles of equal labels and those of different ones hardly overlap, so that each score is made about once. What a reduced tile
returns does not grow with its rows; the last reduction orders a few rows a tile. Anchors are handled in panels of at most
``PANEL`` tiles, which bounds the tiles on disk whatever the size of the table.

Defined results: rows with a null id, label or vector, or with a component that is null, not finite or of magnitude LARGEST or
more, take no part (the last would not fit the 64-bit scores). Shorter vectors count as padded by zeros; an empty vector has
score 0 with every other. Rows of equal ids are different rows: each is an anchor of its own, and one may be the other's positive.
Equal scores are ordered by id. An anchor without positives, or without rows in a window, gives no rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import saved, ship_code, table
from cuelattice.operators.assoc import dense_index

BLOCK_ANCHORS, BLOCK_ROWS = 256, 2048
#: Dimensions of a chunk; wide vectors have longer chunks and not more than MOST_CHUNKS of them, which bounds what is added in one group.
CHUNK, MOST_CHUNKS = 32, 8
#: Tiles of a panel of anchors.
PANEL = 1 << 15
SCALE, LARGEST = 256, 65536.0
NOT_IN = np.iinfo(np.int64).max

BLOCKS = "block long, chunk int, low long, high long, ids binary, labels binary, places binary, cells binary"
TILE = "a long, r long, part int, anchors binary, rows binary, windows binary, wide int, tile binary"
POSITIVES = "anchor_place long, anchor_id long, place long, positive_id long, score long"
NEGATIVES = "anchor_place long, anchor_id long, positive_place long, positive_id long, positive_score long, place long, negative_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, q): the rows that take part, with vectors as integers."""
    vec = F.col(vec_col)
    held = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST))
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(held, whole).alias("q")).filter("id is not null and label is not null and q is not null")


def _array(raw, kind=np.int64) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _blocks(rows: DataFrame, at: str, size: int, width: int) -> DataFrame:
    """``rows`` (at, place, id, label, q) as blocks of ``size``, a row for each chunk of ``width`` dimensions; ids are in the first."""
    schema = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), *((n, pa.binary()) for n in ("ids", "labels", "places", "cells"))])

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        vectors = part.column("q").combine_chunks()
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        dense = np.zeros((len(lengths), -(-max(int(lengths.max()), 1) // width) * width), np.int64)
        starts = np.cumsum(lengths) - lengths
        line = np.repeat(np.arange(len(lengths)), lengths)
        dense[line, np.arange(len(line)) - starts[line]] = vectors.flatten().to_numpy(zero_copy_only=False)
        ids, labels, places = (part.column(n).to_numpy().astype(np.int64) for n in ("id", "label", "place"))
        out = []
        for c in range(dense.shape[1] // width):
            head = [x.tobytes() if c == 0 else b"" for x in (ids, labels, places)]
            out.append([key[0].as_py(), c, int(labels.min()), int(labels.max()), *head, dense[:, c * width : (c + 1) * width].astype(np.int32).tobytes()])
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    sized = rows.select(F.expr(f"{at} div {size}").alias("block"), F.col(at).alias("at"), "place", "id", "label", "q")
    return sized.groupBy("block").applyInArrow(pack, BLOCKS)


TILE_SCHEMA = pa.schema([("a", pa.int64()), ("r", pa.int64()), ("part", pa.int32()), ("anchors", pa.binary()), ("rows", pa.binary()), ("windows", pa.binary()), ("wide", pa.int32()), ("tile", pa.binary())])


def _partial(width: int):
    """The product of one chunk of two blocks; the heads of the blocks travel with the first chunk."""

    def product(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([pa.array([], f.type) for f in TILE_SCHEMA], schema=TILE_SCHEMA)
        if not left.num_rows or not right.num_rows:
            return empty
        (x,), (y,) = left.to_pylist(), right.to_pylist()
        a, r = (_array(z["cells"], np.int32).reshape(-1, width) for z in (x, y))
        most = int(np.abs(a).max(initial=0)) * int(np.abs(r).max(initial=0)) * width
        kind = np.float64 if most < 1 << 53 else np.int64  # sums below 2**53 are whole numbers in doubles, too
        tile = (a.astype(kind) @ r.astype(kind).T).astype(np.int64 if most >= 1 << 31 else np.int32)
        heads = [b"".join((z["ids"], z["labels"], z["places"])) for z in (x, y)]
        row = [x["block"], y["block"], x["chunk"], *heads, np.array(x["windows"] or [], np.int64).tobytes() if x["chunk"] == 0 else b"", tile.dtype.itemsize, tile.tobytes()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, TILE_SCHEMA, strict=True)], schema=TILE_SCHEMA)

    return product


def _summed(part: pa.Table):
    """(ids, labels, places) of the anchors and of the rows, windows and the sum of a tile's parts; rows are in the order of their ids."""
    parts = part.to_pylist()
    first = next(p for p in parts if p["part"] == 0)
    anchors, rows = (_array(first[n]).reshape(3, -1) for n in ("anchors", "rows"))
    total = np.zeros((anchors.shape[1], rows.shape[1]), np.int64)
    for p in parts:
        total += _array(p["tile"], np.int32 if p["wide"] == 4 else np.int64).reshape(total.shape)
    order = np.argsort(rows[0], kind="stable")
    return anchors, rows[:, order], first["windows"], total[:, order]


def _frame(columns: list[list[np.ndarray]], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _longs(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], pa.int64()) for x in ddl.split(", ")])


def _best_positives(n: int):
    schema = _longs(POSITIVES)

    def reduce(part: pa.Table) -> pa.Table:
        (a_ids, a_labels, a_places), (ids, labels, places), _, total = _summed(part)
        out = [[] for _ in schema]
        for k in range(len(a_ids)):
            own = np.flatnonzero((labels == a_labels[k]) & (places != a_places[k]))
            best = own[np.argsort(~total[k, own], kind="stable")[:n]]
            for c, x in zip(out, (np.full(len(best), a_places[k]), np.full(len(best), a_ids[k]), places[best], ids[best], total[k, best]), strict=True):
                c.append(x)
        return _frame(out, schema)

    return reduce


def _best_negatives(n: int, share: int):
    schema = _longs(NEGATIVES)

    def reduce(part: pa.Table) -> pa.Table:
        (a_ids, a_labels, a_places), (ids, labels, places), windows, total = _summed(part)
        windows = _array(windows).reshape(-1, 4)  # (place of the anchor, place, id and score of the positive)
        out = [[] for _ in schema]
        line = {p: k for k, p in enumerate(a_places.tolist())}
        keys = np.where(labels == a_labels[:, None], NOT_IN, ~total)  # ascending: best scores first, rows of the same label last
        order = np.argsort(keys, axis=1, kind="stable")
        keys = np.take_along_axis(keys, order, axis=1)
        for place, at, pid, score in windows.tolist():
            k = line[place]
            start = np.searchsorted(keys[k], ~score)
            end = min(start + n, np.searchsorted(keys[k], ~(-(-share * score // 100)), "right"))
            if start < end:
                best = order[k, start:end]
                for c, x in zip(out, (place, a_ids[k], at, pid, score, places[best], ids[best], total[k, best]), strict=True):
                    c.append(np.broadcast_to(x, len(best)))
        return _frame(out, schema)

    return reduce


def _tiles(anchors: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The partial tiles of the pairs (a, r) in ``wanted``: each block goes to the pairs it is part of."""
    left = anchors.withColumnRenamed("block", "a").join(wanted, "a").withColumnRenamed("a", "block")
    right = rows.withColumnRenamed("block", "r").join(wanted, "r").withColumnRenamed("r", "block")
    keyed = left.groupBy(F.col("block").alias("a"), "r", "chunk").cogroup(right.groupBy("a", F.col("block").alias("r"), "chunk"))
    return keyed.applyInArrow(_partial(width), TILE)


def _first(df: DataFrame, by: list[str], score: str, id_col: str, n: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_col, "place")
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n)


def hard_negatives(
    df: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column, n_positives: int = 5, n_negatives: int = 5, share: int = 80, scale: int = SCALE, block_anchors: int = BLOCK_ANCHORS, block_rows: int = BLOCK_ROWS, panel: int = PANEL
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` is an expression over ``df``, ``anchor`` a condition on the column ``id``. Scores are inner products of the vectors'
    ``scale``-folds rounded down. Windows reach from ``share`` percent of a positive's score to the score itself.
    """
    spark = df.sparkSession
    ship_code(spark)
    placed = saved(dense_index(usable(df, id_col, vec_col, label, scale).withColumn("tie", F.monotonically_increasing_id()), "label", "id", "tie", name="place").drop("tie"))
    n, longest = placed.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    asked = saved(dense_index(placed.filter(anchor), "place", name="at"))
    n_anchors = asked.count()
    if not n or not n_anchors:
        return spark.createDataFrame([], RESULT)
    width = max(CHUNK, -(-longest // MOST_CHUNKS))
    rows = saved(_blocks(placed.withColumn("at", F.col("place")), "at", block_rows, width))
    anchors = saved(_blocks(asked, "at", block_anchors, width)).withColumn("windows", F.lit(None).cast("array<array<bigint>>"))
    n_blocks, n_asked = -(-n // block_rows), -(-n_anchors // block_anchors)
    spans = rows.filter("chunk = 0").select(F.col("block").alias("r"), F.col("low").alias("r_low"), F.col("high").alias("r_high"))
    step, found = max(1, panel // n_blocks), None
    for start in range(0, n_asked, step):
        own = anchors.filter(F.col("block").between(start, start + step - 1))
        pairs = own.filter("chunk = 0").select(F.col("block").alias("a"), "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("r")).join(spans, "r")
        alike = _tiles(own, rows, pairs.filter("low <= r_high and r_low <= high").select("a", "r"), width)
        best = alike.groupBy("a", "r").applyInArrow(_best_positives(n_positives), POSITIVES)
        positives = saved(_first(best, ["anchor_place"], "score", "positive_id", n_positives, "k").drop("k"))
        # at most n_positives windows for each anchor of a block
        windows = positives.join(asked.select(F.col("place").alias("anchor_place"), F.expr(f"at div {block_anchors}").alias("block")), "anchor_place")
        windows = windows.groupBy("block").agg(F.collect_list(F.array("anchor_place", "place", "positive_id", "score")).alias("windows"))
        unlike = _tiles(own.drop("windows").join(windows, "block"), rows, pairs.filter("not (low = high and r_low = r_high and low = r_low)").select("a", "r"), width)
        negatives = unlike.groupBy("a", "r").applyInArrow(_best_negatives(n_negatives, share), NEGATIVES)
        ranked = _first(negatives, ["anchor_place", "positive_place"], "score", "negative_id", n_negatives, "rank")
        out = ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
        out = out if n_asked <= step else saved(out)
        found = out if found is None else found.unionByName(out)
    return found


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 100) among all rows of ``embeddings``; every seventh row's label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("id") % 100 == 0)


def oracle() -> str:
    """The same in DuckDB SQL, by one inner product for each pair."""
    return """
WITH rows AS (
    SELECT row_number() OVER () AS place, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
    SELECT place, id, label, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM rows
), scores AS (
    SELECT a.place AS a, a.id AS anchor_id, b.place AS b, b.id, a.label = b.label AS alike, CAST(sum(a.x * b.x) AS BIGINT) AS score
    FROM cells a JOIN cells b ON a.d = b.d AND a.place <> b.place WHERE a.id % 100 = 0 GROUP BY ALL
), positives AS (
    SELECT * FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.a = p.a AND NOT n.alike AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5"""
