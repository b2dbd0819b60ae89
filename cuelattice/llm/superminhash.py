"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

A text's set is that of its distinct ``SHINGLE``-word shingles. Each element of a set walks over the signature's places in a random
order of its own and offers step + random fraction at each; a place keeps the least offer. The offers of one element are so at different
places and steps (correlated ranks), which gives a lower variance than independent hashes, and a walk ends once its step exceeds
all that is kept: long texts stop after a step or two. Signatures are cut into ``BANDS`` bands of ``ROWS`` places; texts that agree in
a band are candidates.

Texts of equal sets are one node, named by their least id. Nodes that meet in buckets, directly or through others, are a cluster; the nodes of
all clusters, ordered by cluster and size of set, are cut into blocks of bounded weight. A block, and each pair of blocks that share a cluster and whose
sizes allow a link, is compared whole, on the full sets: intersections are counted exactly, for small clusters one by one, else by
products of membership matrices over the shingles met twice. What a task returns is a spanning forest of its links; groups are the components of all
forests. So each set moves once for each block that it is compared with, buckets have no cap, and a hot bucket or cluster is split.

A pair at the least similarity shares no band with probability 7e-9 (1e-13 at 0.9), by independent ranks; this is the one way in which a link can be missed.
A cluster is compared in full: one of s sets costs s / (nodes of a block) moves of each of its sets.

Defined results: a null text counts as empty; a text without words has an empty set and is linked with nothing, not even its like; fewer words than
a shingle's are one element. Sets of the same least id are one node. Rows without an id keep their set's size, take no part in links and have no component. An
empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import map_columns, saved, ship_code, table, text_or_empty
from cuelattice.llm.components import components

SHINGLE, LEAST, SEED = 3, 85, 42
#: A pair at the least similarity agrees in none of the bands with probability (1 - 0.85**5)**32 = 7e-9, at 0.9 with 2e-13.
BANDS, ROWS = 32, 5
PLACES = BANDS * ROWS
#: Elements that walk at once: bounds the memory of their orders.
WALKERS = 1 << 15
#: Weight of a block, and the elements that weigh as much as one set; clusters up to SMALL sets are compared pair by pair, larger ones by COLUMNS shingles at once.
WEIGHT, ELEMENTS, SMALL, COLUMNS = 512, 2048, 8, 4096

#: Fixed values of a 64-bit mixer.
STEP = 0x9E3779B97F4A7C15
GOLD, MIX_A, MIX_B = (np.uint64(x) for x in (STEP, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; fewer words than a shingle's are one element, none no element.

    Shingles are told apart exactly, by the numbers of their words; bytes.lower and bytes.split know just ASCII, as is meant here.
    """
    import xxhash

    known: dict[bytes, int] = {}
    lines = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        lines.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
    n = len(known)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, n)
    out = []
    for line in lines:
        if not len(line):
            out.append(np.zeros(0, np.uint64))
            continue
        size = min(shingle, len(line))
        code, first = line[: len(line) - size + 1], np.arange(len(line) - size + 1)
        for k in range(1, size):
            if int(code.max()) + 1 > (1 << 62) // max(n, 1):
                code = np.unique(code, return_inverse=True)[1]
            code = code * n + line[k : len(line) - size + 1 + k]
        first = np.unique(code, return_index=True)[1] if len(code) > 1 else first
        h = np.full(len(first), size, np.uint64)
        for k in range(size):
            h = mixed(h * GOLD + hashes[line[first + k]])
        out.append(np.sort(h))
    return out


def _walk(elements: np.ndarray, owner: np.ndarray, kept: np.ndarray) -> None:
    """Offers the ranks of ``elements`` to the rows ``owner`` of ``kept``; a rank is the step and a 32-bit fraction."""
    places, flat = kept.shape[1], kept.reshape(-1)
    orders = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(elements), 1))
    active = np.arange(len(elements))
    for step in range(places):
        x = mixed(elements[active] + np.uint64((step + 1) * STEP & (1 << 64) - 1))
        other = step + ((x >> np.uint64(32)) * np.uint64(places - step) >> np.uint64(32)).astype(np.int64)
        at = orders[active, other]
        orders[active, other] = orders[active, step]
        np.minimum.at(flat, owner[active] * places + at, (np.uint64(step) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
        highest = kept.max(axis=1) >> np.uint64(32)
        active = active[highest[owner[active]] > step]
        if not len(active):
            break


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """(texts, places) ranks; those of an empty set are all of the highest number."""
    kept = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= WALKERS):
            total += len(sets[end])
            end += 1
        elements = np.concatenate(sets[at:end])
        owner = np.repeat(np.arange(end - at), [len(s) for s in sets[at:end]])
        for k in range(0, len(elements), WALKERS):
            _walk(elements[k : k + WALKERS], owner[k : k + WALKERS], kept[at:end])
        at = end
    return kept


def band_hashes(kept: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) hashes of the places of each band, the band's number included."""
    parts = kept.reshape(len(kept), -1, rows)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        h = mixed(h * GOLD + parts[:, :, k])
    return h


# --- documents ----------------------------------------------------------------------------------------------------------


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, n, key, bands): size of the set, 16 bytes that name it, hashes of the bands; key and bands of an empty set are null."""

    def run(ids, texts):
        import xxhash

        sets = shingle_sets(texts, shingle)
        hashes = band_hashes(signatures(sets)).view(np.int64) if sets else []
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return {"id": ids, "n": [len(s) for s in sets], "key": keys, "bands": [h.tolist() if k else None for h, k in zip(hashes, keys, strict=True)]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, f"id {kind}, n long, key binary, bands array<long>")


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, cluster) of the nodes (node, bands) that meet others in buckets; a bucket's nodes are tied to its first."""
    postings = nodes.select("node", F.explode("bands").alias("h"))
    first = postings.groupBy("h").agg(F.min("node").alias("v"), F.max("node").alias("w")).filter("v <> w").select("h", "v")
    edges = postings.join(first, "h").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
    return components(saved(edges)).select("node", F.col("root").alias("cluster"))


def blocked(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, cluster, n, most) with ``block``: in the order of clusters and sizes, blocks of at most WEIGHT and a node.

    Running weights come from ranges and the weights of the ranges before; no task has all rows.
    """
    order = ["cluster", "n", "node"]
    weight = F.lit(1) + F.floor(F.col("n") / ELEMENTS)
    ranged = saved(nodes.withColumn("weight", weight).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.sum("weight").alias("w"))
    before = sizes.select("range", F.coalesce(F.sum("w").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    within = F.sum("weight").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.join(F.broadcast(before), "range").withColumn("at", F.col("before") + F.coalesce(within, F.lit(0)))
    return placed.select("node", "cluster", "n", "most", F.expr(f"at div {WEIGHT}").alias("block"))


def pair_tasks(placed: DataFrame, least: int) -> DataFrame:
    """(cluster, block, i, j): the pairs of blocks, i <= j, that each (cluster, block) is compared in."""
    spans = saved(placed.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("most").alias("high")))
    left = spans.select("cluster", F.col("block").alias("i"), F.col("high").alias("i_high"))
    right = spans.select("cluster", F.col("block").alias("j"), F.col("low").alias("j_low"))
    pairs = left.join(right, "cluster").filter(f"i <= j and {least} * j_low <= 100 * i_high").select("cluster", "i", "j")
    return pairs.select("cluster", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")


class Forest:
    """Union-find over places; ``tie`` tells whether two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, sets) sizes of all intersections, by products of membership matrices over the elements that are met twice."""
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    new = np.diff(elements, prepend=elements[:1] ^ np.uint64(1)) != 0
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], np.cumsum(new[often] if often.any() else np.zeros(0, bool)) - 1
    total = np.zeros((len(sets), len(sets)), np.float32)  # exact: counts are below 2**24 by the weight of a block
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[owner[a:b], column[a:b] - at] = 1
        total += member @ member.T
    return total.astype(np.int64)


def forest_of(sets: list[np.ndarray], least: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of sets: pairs with 100 * intersection >= least * union."""
    forest = Forest(len(sets))
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) <= SMALL:
        for a in range(len(sets)):
            for b in range(a):
                if least * max(n[a], n[b]) <= 100 * min(n[a], n[b]):
                    met = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * met >= least * (n[a] + n[b] - met) and forest.tie(a, b):
                        yield a, b
        return
    met = shared_counts(sets)
    linked = np.triu(100 * met >= least * (n[:, None] + n - met), 1)
    for a, b in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        if forest.tie(a, b):
            yield a, b


def _compared(least: int, shingle: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("cluster", "ascending"), ("n", "ascending"), ("node", "ascending")])
        nodes, of = part.column("node").to_numpy(), part.column("cluster").to_numpy()
        u, v = [], []
        starts = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        for a, b in zip(starts, np.append(starts[1:], len(of)), strict=True):
            sets = shingle_sets(part.column("text").slice(a, b - a).to_pylist(), shingle)
            for x, y in forest_of(sets, least):
                u.append(int(nodes[a + x]))
                v.append(int(nodes[a + y]))
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return run


def links(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, least: int) -> DataFrame:
    """(u, v): a forest of the links between the nodes of ``classes`` (node, n, bands), whose texts are those of the rows of that id."""
    ship_code(df.sparkSession)
    sizes = classes.groupBy("node").agg(F.min("n").alias("n"), F.max("n").alias("most"))
    placed = saved(blocked(clusters(classes).join(sizes, "node")))
    texts = df.select(F.col(id_col).alias("node"), text_or_empty(text_col).alias("text"))
    rows = placed.join(texts, "node").join(pair_tasks(placed, least), ["cluster", "block"])
    return rows.select("i", "j", "cluster", "n", "node", "text").groupBy("i", "j").applyInArrow(_compared(least, shingle), "u long, v long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``df``, whose ids are whole numbers; ``least`` is a similarity in percent."""
    found = saved(features(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, shingle))
    known = found.filter("id is not null and key is not null")
    classes = saved(known.groupBy("key").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    roots = components(saved(links(df, classes.select("node", "n", "bands"), id_col, text_col, shingle, least).distinct()))
    named = found.select("id", "n", "key").join(classes.select("key", "node"), "key", "left").join(roots, "node", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("root", "node", "id"))
    return named.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The rows of ``df`` without those that are linked to one of a smaller id; rows without an id stay."""
    gone = near_groups(df, id_col, text_col, shingle, least).filter("id is not null and not kept").select(F.col("id").alias("__gone")).distinct()
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op13_superminhash(spark, sf_dir: str) -> DataFrame:
    """Groups of all ``documents`` at 0.85 of their sets of three-word shingles."""
    return near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def oracle() -> str:
    """The same in DuckDB SQL, by joining on shingles; small tables only."""
    words = r"list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\x09-\x0D]', ' ', 'g'), ' +'), lambda w: w <> '')"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE numbered AS (
    SELECT doc_id, list_transform({words}, lambda w: {lower.format("w")}) AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS s FROM numbered
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(v) AS component_id, min(v) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON u = d.doc_id GROUP BY d.doc_id"""
