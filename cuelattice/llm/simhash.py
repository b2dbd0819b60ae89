"""SimHash near-duplicates: fingerprints, bit-sliced comparison, groups.

A fingerprint bit is set if it is set in over half of the XXH64 hashes of a text's word shingles. Fingerprints are linked
at up to ``RADIUS`` differing bits. Candidates come from an exact pigeonhole: of ``BLOCKS`` blocks of bits two are
equal in any linked pair, so each fingerprint goes to one bucket for each pair of blocks. Within a bucket, fingerprints are
stored as bit planes (word k of plane b has bit b of 64 fingerprints) and distances are counted for 64 of them at a time by
carry-save adders; a block of comparisons is abandoned as soon as all its distances exceed the radius.

Only distinct fingerprints are compared, whatever the number of their copies. A bucket with over ``BUCKET`` of them is
dealt out as pairs of sub-blocks, each pair a group of its own, so that no link is lost and no task grows with a bucket.
A bucket returns a spanning forest of its links, not all pairs; the groups are the components of all forests.

Defined results: a null text counts as empty; texts without words have fingerprint 0, which is linked like any other;
rows without an id take part and get the smallest id of their group, null if it has none; repeated rows share a group.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import map_columns, saved, ship_code, table, text_or_empty
from cuelattice.llm.components import components

SHINGLE, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Blocks of bits: more of them, and so longer keys in more tables, once a key would have over KEY_LOAD fingerprints on average.
BLOCKS, MOST_BLOCKS, KEY_LOAD = 6, 8, 64
#: Distinct fingerprints of a bucket that one group may hold; larger buckets are dealt out.
BUCKET = 4096
#: Buckets up to this size are compared pair by pair, larger ones row by plane.
SMALL = 32
#: Table size up to which the list of large buckets is broadcast; beyond it Spark joins it as it likes.
FEW_LARGE = 100_000


# --- fingerprints -------------------------------------------------------------------------------------------------


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text; bytes.lower and bytes.split know just ASCII, as is meant here."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - shingle]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed number."""

    def run(ids, texts):
        return {"id": ids, "fp": [signed(fingerprint(t)) for t in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, f"id {kind}, fp long")


# --- bit-sliced comparison ------------------------------------------------------------------------------------------


def bits_of(fps: np.ndarray) -> np.ndarray:
    """(n, bits) of n fingerprints, each one uint64 or a row of them."""
    return np.unpackbits(np.ascontiguousarray(fps).reshape(len(fps), -1).view(np.uint8), axis=1, bitorder="little")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(bits, words) uint64: bit planes of fingerprints, padded with zeros to whole words."""
    bits = bits_of(fps)
    padded = np.zeros((bits.shape[1], -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Vertical counters of differing bits, one a lane, that stick once they pass what they can hold."""

    def __init__(self, shape, radius: int):
        self.radius, self.width = radius, max(1, (radius + 1).bit_length())
        self.digits = [np.zeros(shape, np.uint64) for _ in range(self.width)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Counts two planes of differences by a carry-save step and a ripple of its carry."""
        ones = self.digits[0]
        half = ones ^ a
        carry = (ones & a) | (half & b)
        self.digits[0] = half ^ b
        for k in range(1, self.width):
            digit = self.digits[k]
            self.digits[k], carry = digit ^ carry, digit & carry
        self.over |= carry

    def beyond(self) -> np.ndarray:
        """Lanes whose count exceeds the radius."""
        more, equal = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for k in reversed(range(self.width)):
            if self.radius >> k & 1:
                equal = equal & self.digits[k]
            else:
                more = more | (equal & self.digits[k])
                equal = equal & ~self.digits[k]
        return more | self.over

    def values(self, rows: np.ndarray, words: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The counts of single lanes that are not over."""
        bit = lanes.astype(np.uint64)
        return sum(((d[rows, words] >> bit & np.uint64(1)).astype(np.int64) << k for k, d in enumerate(self.digits)), np.zeros(len(rows), np.int64))

    def keep(self, rows: np.ndarray) -> None:
        self.digits, self.over = [d[rows] for d in self.digits], self.over[rows]


def within(difference: Callable[[int, np.ndarray], np.ndarray], rows: int, words: int, radius: int = RADIUS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, Counters]:
    """(row numbers, lanes near, their counters) of ``rows`` blocks of ``words`` words; ``difference(b, rows)`` is plane b of the differences.

    After every eighth plane, once there are more planes than the radius, the blocks in which all lanes exceed it are abandoned.
    """
    left, counted = np.arange(rows), Counters((rows, words), radius)
    full = ~np.uint64(0)
    for b in range(0, bits, 2):
        counted.add(difference(b, left), difference(b + 1, left))
        if b % 8 == 6 and radius < b < bits - 2:
            alive = (counted.beyond() != full).any(axis=1)
            if not alive.all():
                left = left[alive]
                counted.keep(alive)
            if not len(left):
                break
    return left, ~counted.beyond(), counted


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether a[i] and b[i] differ in at most ``radius`` bits; blocks are of 64 pairs."""
    if not len(a):
        return np.zeros(0, bool)
    planes = planes_of(a ^ b)
    words = planes.shape[1]
    rows, near, _ = within(lambda k, left: planes[k, left, None], words, 1, radius, len(planes))
    out = np.zeros((words, 1), np.uint64)
    out[rows] = near
    return np.unpackbits(out.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def near_block(queries: np.ndarray, targets: np.ndarray, radius: int = RADIUS, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index arrays (i, j) of near queries and targets with their distances, ``rows`` queries at a time."""
    planes, n = planes_of(targets), len(targets)
    valid = np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view(np.uint64)
    for at in range(0, len(queries), rows):
        part = queries[at : at + rows]
        masks = np.where(bits_of(part).T, ~np.uint64(0), np.uint64(0))
        found, near, counted = within(lambda b, left, masks=masks: planes[b][None, :] ^ masks[b][left][:, None], len(part), planes.shape[1], radius, len(planes))
        if len(found):
            near &= valid
            i, j = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
            yield found[i] + at, j, counted.values(i, j // 64, j % 64)


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the groups of i[k] and j[k] in place; a label is the smallest index of its group once this returns."""
    while len(i):
        a, b = labels[i], labels[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while True:  # shorten all ways to a root
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels[:] = shorter


# --- buckets --------------------------------------------------------------------------------------------------------


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks_for(n: int) -> int:
    """The least number of blocks whose keys divide ``n`` fingerprints well; any number finds the same links."""
    for blocks in range(BLOCKS, MOST_BLOCKS):
        if n <= KEY_LOAD << (BITS * (blocks - RADIUS) // blocks):
            return blocks
    return MOST_BLOCKS


def bucket_keys(fp: str = "fp", blocks: int = BLOCKS, radius: int = RADIUS):
    """An array column with a key for each choice of blocks that must agree somewhere within the radius."""
    bounds, keys = block_bounds(blocks), []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for c in chosen:
            first, width = bounds[c]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def _forest(key: np.ndarray, side: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint of its local group) in whole buckets; rows are sorted by bucket."""
    n = len(fps)
    bits, labels = fps.view(np.uint64), np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if n else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [n]]))
    place = np.arange(n) - np.repeat(starts, sizes)
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    room = np.repeat(sizes, sizes) - place  # rows from here to the bucket's end
    for step in range(1, SMALL):
        i = np.flatnonzero(small & (room > step))
        if not len(i):
            break
        i = i[near_pairs(bits[i], bits[i + step])]
        join_labels(labels, i, i + step)
    for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own, second = bits[at : at + size], side[at : at + size] > 0
        queries, targets = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(size),) * 2
        for i, j, _ in near_block(own[queries], own[targets]):
            join_labels(labels, at + queries[i], at + targets[j])
    linked = np.flatnonzero(labels != np.arange(n))
    return fps[linked], fps[labels[linked]]


def links(nodes: DataFrame) -> DataFrame:
    """(u, v) links of distinct fingerprints ``nodes`` (fp): a spanning forest for each bucket, so all groups are whole."""
    ship_code(nodes.sparkSession)
    keyed = nodes.select("fp", F.explode(bucket_keys(blocks=blocks_for(nodes.count()))).alias("key"))
    large = saved(keyed.groupBy("key").agg(F.count("fp").alias("n")).filter(F.col("n") > BUCKET))
    n_large = large.count()
    if n_large:
        parts = large.select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
        keyed = keyed.join(F.broadcast(parts) if n_large <= FEW_LARGE else parts, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        keyed = keyed.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        keyed = keyed.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    else:
        keyed = keyed.select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp")
    dealt = keyed.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")

    def run(batches):
        import pyarrow as pa

        held = [np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            c = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns]
            key, side, fps = np.concatenate([held[0], np.stack(c[:3], axis=1)]), np.concatenate([held[1], c[3]]), np.concatenate([held[2], c[4]])
            last = len(key) - 1  # the last bucket may go on in the next batch
            differs = np.flatnonzero((key != key[last]).any(axis=1))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            held = [key[cut:], side[cut:], fps[cut:]]
            if cut:
                yield out(*_forest(key[:cut], side[:cut], fps[:cut]))
        if len(held[0]):
            yield out(*_forest(*held))

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_groups(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint in ``prints`` (id, fp): the smallest id reachable by links."""
    nodes = saved(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that the join below can be split where a group is large
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``df``."""
    prints = saved(fingerprints(df, id_col, text_col))
    out = prints.join(near_groups(prints), "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
