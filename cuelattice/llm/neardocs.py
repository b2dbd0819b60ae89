"""Near documents by wide SimHash fingerprints: blocks by shared shingles, bit-sliced comparison, exact check.

Two texts are linked if their sets of ``SHINGLE``-word shingles reach a Jaccard similarity of ``LEAST`` (a fraction). Such
sets share one of the ``n - ceil(LEAST * n) + 1`` first shingles of either in any common order, so these shingles are the keys
of blocks. The order is by rarity among all texts, so that passages shared by many documents come last. Within a block, fingerprints of ``WORDS`` 64-bit words are compared plane by plane (``simhash.near_pairs`` and
``near_block``) and pairs beyond ``RADIUS`` bits are dropped: at the least similarity a bit differs with probability 0.19 or
less, so that the radius is five and a half standard deviations away. What is left is checked on the texts, exactly.

Texts of equal words are one node, named by 64 bits of their XXH64, and are compared once. Of a block of over ``SMALL`` nodes
a star is checked first, and nodes without another one within the radius are left out from there on. Then nodes outside a block's largest group are compared with the whole of that group, and with each other:
first each takes its nearest partner, in the end there are as many pairs as join all groups that may be near, and all pairs where
one of them does not hold; before their texts are fetched, pairs within the radius are
held against the sets' short codes, whose overlap is never less than that of the sets. A block or group over ``BLOCK`` is dealt out in sub-blocks.

Defined results: a null text counts as empty; texts without words are one group; a text of fewer than five words is one
shingle; rows without an id take part; repeated rows are in one group; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import in_few, map_columns, saved, settled, ship_code, text_or_empty
from cuelattice.llm.components import components
from cuelattice.llm.simhash import bits_of, join_labels, near_block, near_pairs

SHINGLE, SEED = 5, 42
#: Least similarity as (numerator, denominator).
LEAST = (4, 5)
#: 64-bit words of a wide fingerprint, and the differing bits up to which the texts are looked at.
WORDS, RADIUS = 4, 84
#: Nodes of a block of which all pairs are compared at once, and nodes that one group may hold.
SMALL, BLOCK = 8, 1024
#: Shingles up to which a set's codes have 16 bits.
NARROW = 4096
#: Shingles of a task among which repeated ones are found at once, and the most counts that are broadcast.
PIECE, COMMON = 1 << 21, 100_000
#: Nodes that a task remembers, so as to give the keys of repeated texts once.
SEEN = 200_000
#: Rows of a few numbers up to which a table is broadcast; beyond it both sides are shuffled.
FEW = 500_000
#: Rows of a few numbers that one with a text, or with the codes of a set, is as wide as.
WIDE = 16


def broadcast_if_few(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, ``n`` in number, with a broadcast hint if these are at most FEW."""
    return F.broadcast(rows) if n <= FEW else rows


def shingles(text: str) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - SHINGLE]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64).view(np.int64))


def wide_print(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of a shingle set: a bit is set if it is set in over half of the shingles' mixed hashes."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(own), 1 << 15):
        x = own[at : at + (1 << 15)].view(np.uint64)
        mixed = np.empty((len(x), words), np.uint64)
        for k in range(words):  # each word from another mix of the same hash
            z = x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            mixed[:, k] = z ^ z >> np.uint64(31)
        bits = bits_of(mixed)
        for k in range(0, len(bits), 255):  # sums that fit a byte are the quick ones
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own), bitorder="little").view(np.uint64)


def node_of(text: str) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()), SEED)
    return x - (1 << 64) if x >> 63 else x


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach LEAST."""
    top, bottom = LEAST
    if not len(a) or not len(b) or bottom * min(len(a), len(b)) < top * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bottom * both >= top * (len(a) + len(b) - both)


def _batch(found: np.ndarray, counts: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts.astype(np.int64), pa.int64())], names=["s", "n"])


def repeated(batches):
    """(s, n) of the shingles that are met more than once in a piece of a task's texts, with their number there."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(shingles(text.as_py()))
            size += len(held[-1])
            if size >= PIECE:
                found, n = np.unique(np.concatenate(held), return_counts=True)
                yield _batch(found[n > 1], n[n > 1])
                held, size = [], 0
    if held:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        yield _batch(found[n > 1], n[n > 1])


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts): the commonest shingles, in order, and the number of all ``texts`` (text) that have each of them.

    A first pass over all texts finds the shingles that are repeated within a piece; those of more texts than there are pieces
    are always among them. A second pass counts the COMMON most repeated ones exactly.
    """
    ship_code(texts.sparkSession)
    some = texts.mapInArrow(repeated, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(COMMON)
    known = np.sort(some.select("s").toArrow().column("s").to_numpy())
    if not len(known):
        return known, known
    held = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        known = held.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column(0):
                own = shingles(text.as_py())
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                total[at[known[at] == own]] += 1  # a text's shingles are distinct
        yield _batch(known[total > 0], total[total > 0])

    found = texts.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter("n > 4").toArrow()  # at most COMMON rows
    common, counts = (found.column(c).to_numpy() for c in "sn")
    order = np.argsort(common)
    return common[order], counts[order]


def prints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: tuple = ()) -> DataFrame:
    """(id, hash, fp, n, sig, keys): hash of the text, node, size of its set, wide fingerprint, first shingles by rarity.

    A task gives the keys of a node with the first of its rows only.
    """
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    known = df.sparkSession.sparkContext.broadcast(common or common_shingles(rows.select("text")))
    top, bottom = LEAST
    seen: dict[int, tuple[int, bytes]] = {}

    def run(ids, texts, hashes):
        common, counts = known.value
        out: dict[str, list] = {"id": ids, "hash": hashes, "fp": [node_of(t) for t in texts], "n": [], "sig": [], "keys": []}
        for fp, t in zip(out["fp"], texts, strict=True):
            first = None
            if fp not in seen:
                own = shingles(t)
                if len(seen) >= SEEN:
                    seen.clear()
                seen[fp] = (len(own), wide_print(own).tobytes())
                if len(own):
                    first = len(own) - -(-top * len(own) // bottom) + 1
                    if len(common):
                        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        own = own[np.lexsort((own, np.where(common[at] == own, counts[at], 0)))]
            out["n"].append(seen[fp][0])
            out["sig"].append(seen[fp][1])
            out["keys"].append(own[:first] if first else None)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(rows, run, f"id {kind}, hash long, fp long, n int, sig binary, keys array<long>")


def in_blocks(rows: DataFrame, columns: dict[str, str], compare: Callable, schema: str, size: int | None = None, alone: str | None = None) -> DataFrame:
    """What ``compare(key, columns of a block)`` gives, as rows of arrays, for each (key, x, y) of ``rows``.

    If the number of rows is known, blocks go to tasks by it (``size``: that number, times the width of a row). Blocks of
    one row are left out, except where the column ``alone`` is over 1. ``columns`` has the columns with their types, long or binary; a block is in the order of n, then fp.
    """
    import pyarrow as pa

    ship_code(rows.sparkSession)
    dealt = rows.select("key", "x", "y", *(F.col(c).cast(k).alias(c) for c, k in columns.items())).repartition("key", "x", "y")
    dealt = (dealt if size is None else in_few(dealt, size)).sortWithinPartitions("key", "x", "y", "n", "fp")
    names = [f.split()[0] for f in schema.split(", ")]

    def plain(batch):
        return [np.asarray(c.to_numpy(zero_copy_only=False), object if pa.types.is_binary(c.type) else np.int64) for c in batch.columns]

    def run(batches):
        def out(held):
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(held[0])]])
            some = ends - starts > 1
            if alone:
                some |= held[3 + list(columns).index(alone)][starts] > 1
            found = [np.zeros((len(names), 0), np.int64)]
            for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                found += compare(int(held[0][a]), {c: x[a:b] for c, x in zip(columns, held[3:], strict=True)})
            rows = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=names)

        held = None
        for batch in batches:
            held = plain(batch) if held is None else [np.concatenate(x) for x in zip(held, plain(batch), strict=True)]
            differs = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0  # the last block may go on in the next batch
            if cut:
                yield out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield out(held)

    out = dealt.mapInArrow(run, schema).distinct()
    return out if size is None else in_few(out, size)


def _fitting(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sizes of two sets allow the similarity."""
    return LEAST[1] * np.minimum(n[i], n[j]) >= LEAST[0] * np.maximum(n[i], n[j])


def _pairs(fp: np.ndarray, i: np.ndarray, j: np.ndarray, *more: int) -> np.ndarray:
    u, v = fp[i], fp[j]
    return np.stack([np.minimum(u, v), np.maximum(u, v), *(np.full(len(u), m) for m in more)])[:, u != v]


def first_pairs(key: int, own: dict[str, np.ndarray]) -> list[np.ndarray]:
    """(a, b, 0) of all pairs of a small block, or of a star about the least node of a large one; (node, key, 1) of its members.

    Blocks of a divided key count as large, since their members are to be compared with those of the others.
    """
    once = np.concatenate([[True], own["fp"][1:] != own["fp"][:-1]])
    fp, n = own["fp"][once], own["n"][once]
    at = np.arange(len(fp))
    divided = bool(own["parts"][0] > 1)
    if len(fp) <= SMALL and not divided:
        i, j = np.triu_indices(len(fp), 1)
    else:  # blocks of the same texts mostly have the same least node, and so few different pairs
        i, j = np.full(len(fp), np.argmin(fp)), at
    ok = _fitting(n, i, j)
    return [_pairs(fp, i[ok], j[ok], 0)] + ([np.stack([fp, np.full(len(fp), key), np.ones(len(fp), np.int64)])] if len(fp) > SMALL or divided else [])


def active(key: int, own: dict[str, np.ndarray]) -> list[np.ndarray]:
    """(node, key) of the nodes of a block that have another one within the radius; of two sub-blocks, those across."""
    side, fp, n = own["side"], own["fp"], own["n"]
    sig = np.frombuffer(b"".join(own["sig"]), np.uint64).reshape(len(fp), -1)
    queries, targets = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if side.any() else np.arange(len(fp))
    met = np.zeros(len(fp), bool)
    for i, j, _ in near_block(sig[queries], sig[targets], RADIUS):
        i, j = queries[i], targets[j]
        ok = (fp[i] != fp[j]) & _fitting(n, i, j)
        met[i[ok]] = met[j[ok]] = True
    return [np.stack([fp[met], np.full(met.sum(), key)])]


def codes_of(own: np.ndarray) -> bytes:
    """The low bits of a set's hashes, repeats included: two bytes each, four in large sets."""
    return own.view(np.uint64).astype(np.uint16 if len(own) <= NARROW else np.uint32).tobytes()


class Overlaps:
    """Upper bounds of the common shingles of one set and each of many, from their codes."""

    def __init__(self, codes: list[bytes], n: np.ndarray):
        self.n, self.narrow = n, np.repeat(n <= NARROW, n)
        self.flat = np.concatenate([np.frombuffer(c, np.uint16 if m <= NARROW else np.uint32).astype(np.uint32) for c, m in zip(codes, n.tolist(), strict=True)])
        self.starts = np.cumsum(n) - n

    def own(self, k: int) -> np.ndarray:
        return self.flat[self.starts[k] : self.starts[k] + self.n[k]]

    def reach(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Whether each set may reach LEAST with the one of ``codes``: elements whose code is met are as many as the common ones at least."""
        met = np.zeros(1 << 16, bool)
        met[codes & 0xFFFF] = True
        hit = met[self.flat & 0xFFFF]
        if n > NARROW:
            wide = np.zeros(1 << 20, bool)
            wide[codes & 0xFFFFF] = True
            hit = np.where(self.narrow, hit, wide[self.flat & 0xFFFFF])
        both = np.add.reduceat(hit, self.starts, dtype=np.int64)
        return LEAST[1] * both >= LEAST[0] * (n + self.n - both)


def other_pairs(key: int, own: dict[str, np.ndarray], take: str) -> list[np.ndarray]:
    """(a, b) of nodes of different groups within the radius whose codes may reach LEAST; if there are sides, those across.

    ``take`` is "all", or "one" for the nearest partner of each node (of side 0), or "forest" for so many pairs as join the groups.
    """
    root, side, fp, n = own["root"], own["side"], own["fp"], own["n"]
    sig = np.frombuffer(b"".join(own["sig"]), np.uint64).reshape(len(fp), -1)
    queries, targets, out = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if side.any() else np.arange(len(fp)), []
    if not len(queries) or not len(targets):
        return out
    sets, asked = Overlaps([own["codes"][t] for t in targets], n[targets]), Overlaps([own["codes"][q] for q in queries], n[queries])
    _, first, which = np.unique(root, return_index=True, return_inverse=True)
    labels = first[which]
    for i, j, d in near_block(sig[queries], sig[targets], RADIUS):
        ok = (root[queries[i]] != root[targets[j]]) & _fitting(n, queries[i], targets[j])
        i, j, d = i[ok], j[ok], d[ok]
        for q in np.unique(i).tolist():
            mine, at = i == q, queries[q]
            partners = j[mine][np.argsort(d[mine], kind="stable")]
            if take == "forest":
                partners = partners[labels[targets[partners]] != labels[at]]
            if not len(partners):
                continue
            partners = targets[partners[sets.reach(asked.own(q), int(asked.n[q]))[partners]]]
            if take == "one":
                partners = partners[:1]
            while take == "forest" and len(partners := partners[labels[partners] != labels[at]]):
                out.append(_pairs(fp, np.array([at]), partners[:1]))
                join_labels(labels, np.array([at]), partners[:1])
            if take != "forest":
                out.append(_pairs(fp, np.full(len(partners), at), partners))
    return out


def compared(pairs: DataFrame, size: int, nodes: DataFrame) -> DataFrame:
    """Those ``pairs`` (a, b), ``size`` at most, whose wide fingerprints in ``nodes`` (fp, sig) are within the radius."""
    sigs = nodes.select("fp", "sig")
    both = in_few(pairs.join(sigs.select(F.col("fp").alias("a"), F.col("sig").alias("s")), "a"), 4 * size)
    both = in_few(both.join(sigs.select(F.col("fp").alias("b"), F.col("sig").alias("t")), "b"), 4 * size)

    def run(a, b, s, t):
        s, t = (np.frombuffer(b"".join(x), np.uint64).reshape(len(a), -1) for x in (s, t))
        ok = near_pairs(s, t, RADIUS)
        return {"a": np.array(a, np.int64)[ok], "b": np.array(b, np.int64)[ok]}

    return map_columns(both.select("a", "b", "s", "t"), run, "a long, b long")


def distinct_sets(rows: DataFrame, size: int) -> DataFrame:
    """(key, fp) ``rows``, ``size`` at most, without the keys whose members are just those of another key: comparing them again finds nothing more."""
    once = in_few(rows.groupBy("key").agg(F.count("fp").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("x")), size)
    kept = settled(in_few(once.groupBy("n", "s", "x").agg(F.min("key").alias("key")), size).select("key"))
    return in_few(rows.join(broadcast_if_few(*kept), "key", "left_semi"), size)


def checked(pairs: DataFrame, size: int, texts: DataFrame) -> tuple[DataFrame, int]:
    """(u, v) of those ``pairs`` (a, b), ``size`` in number and written, whose texts in ``texts`` (fp, text) are near; their number."""
    wanted = broadcast_if_few(pairs, size)
    first = in_few(texts.join(wanted, F.col("fp") == F.col("a")), WIDE * size).select("a", "b", F.col("text").alias("s"))
    second = in_few(texts.join(wanted, F.col("fp") == F.col("b")), WIDE * size).select("a", "b", F.col("text").alias("t"))

    def run(a, b, s, t):
        kept = lru_cache(maxsize=64)(shingles)
        fine = [near(kept(x), kept(y)) for x, y in zip(s, t, strict=True)]
        return {"u": [x for x, ok in zip(a, fine, strict=True) if ok], "v": [x for x, ok in zip(b, fine, strict=True) if ok]}

    both = in_few(first.join(second, ["a", "b"]), WIDE * size).select("a", "b", "s", "t")
    return settled(map_columns(both, run, "u long, v long"))


def links(df: DataFrame, held: DataFrame, nodes: DataFrame, common: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v) of nodes whose components are those of all near pairs; ``held`` has the prints of ``df``.

    What is written is counted, and goes on in as many tasks as its rows are worth.
    """
    spark = df.sparkSession
    keyed = held.filter("keys is not null").select("fp", "n", F.explode("keys").alias("key"))
    # blocks of shingles that so many texts have are divided from the start
    hot = [(int(k), int(-(-c // BLOCK))) for k, c in zip(*common, strict=True) if c > BLOCK]
    if hot:
        keyed = keyed.join(F.broadcast(spark.createDataFrame(hot, "key long, parts int")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        keyed = keyed.withColumn("parts", F.lit(1))
    keyed = keyed.withColumn("x", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("y", F.col("x"))
    first, n_first = settled(in_blocks(keyed, {"fp": "long", "n": "long", "parts": "long"}, first_pairs, "a long, b long, kind long", alone="parts"))
    pairs, n_pairs = settled(compared(first.filter("kind = 0").select("a", "b"), n_first, nodes))
    large, n_large = settled(distinct_sets(first.filter("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("key")), n_first))
    size = F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")
    own, every = F.pmod(F.xxhash64("fp"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    def in_parts(rows, parts, n):  # each row with all sub-blocks of its key: (x, y) are the lower and the higher of two; before wide columns are joined
        split = in_few(rows.join(parts, "key"), n).withColumn("own", own).withColumn("other", every)
        return split.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))

    if n_large:  # texts that only share a passage end here
        sizes = in_few(large.groupBy("key").agg(F.count("fp").alias("size")), n_large).select("key", size)
        split = in_few(in_parts(large, sizes, n_large).join(nodes.select("fp", "n", "sig"), "fp"), 4 * n_large)
        large, n_large = settled(in_blocks(split, {"fp": "long", "n": "long", "side": "long", "sig": "binary"}, active, "fp long, key long", 4 * n_large))
    # the text of one row of each node that is compared, found by the id and the hash of its text
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(large.select("fp"))
    n_wanted = 2 * n_pairs + n_large
    wanted, n_wanted = settled(in_few(in_few(wanted.distinct(), n_wanted).join(nodes, "fp"), n_wanted).select("fp", "rep.h", "rep.i"))
    wanted = broadcast_if_few(wanted, n_wanted)
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = rows.join(wanted, (F.col("hash") == F.col("h")) & F.col("id").eqNullSafe(F.col("i"))).select("fp", "text").dropDuplicates(["fp"])
    texts = saved(in_few(texts, WIDE * n_wanted))
    found, n_found = checked(pairs, n_pairs, texts)
    if not n_large:
        return found
    kinds = {"fp": "long", "n": "long", "root": "long", "side": "long", "sig": "binary", "codes": "binary"}
    coded = in_few(texts.join(in_few(large.select("fp").distinct(), n_large), "fp", "left_semi"), WIDE * n_wanted).select("fp", "text")
    coded = map_columns(coded, lambda fp, t: {"fp": fp, "codes": [codes_of(shingles(x)) for x in t]}, "fp long, codes binary")
    members, n_members = settled(in_few(coded.join(nodes.select("fp", "n", "sig"), "fp"), WIDE * n_wanted), WIDE)
    columns = ("key", "x", "y", "side", "fp", "n", "root", "sig", "codes")
    def joined(targets, take, n):
        return in_blocks(targets, kinds, partial(other_pairs, take=take), "a long, b long", WIDE * n)

    def check(more):
        nonlocal found, n_found, pairs, n_pairs
        more, n = settled(more)
        more, n = settled(in_few(in_few(more.distinct(), n).join(pairs, ["a", "b"], "left_anti"), n + n_pairs))
        if not n:
            return None, 0
        good, n_good = checked(more, n, texts)
        found, n_found = settled(in_few(found.unionByName(good), n_found + n_good))
        pairs, n_pairs = settled(in_few(pairs.unionByName(more), n_pairs + n))
        return settled(in_few(more.join(good, (F.col("a") == F.col("u")) & (F.col("b") == F.col("v")), "left_anti"), n))

    for last in (False, True):
        roots = components(found)
        rooted = in_few(large.join(roots, F.col("fp") == F.col("node"), "left"), n_large).select("key", "fp", F.coalesce("root", "fp").alias("root"))
        shares = in_few(rooted.groupBy("key", "root").agg(F.count("fp").alias("size")), n_large)
        most = in_few(shares.groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.count("root").alias("groups")), n_large).filter("groups > 1").select("key", F.col("most.root").alias("most"))
        rest, n_rest = settled(in_few(rooted.join(most, "key"), n_large).filter("root <> most").select("key", "fp", "root", "most"))  # of each open block what is outside its largest group
        # these against the whole of that group, which is met once whatever the number of its blocks
        asked = in_few(rest.select("most", "fp", "root").distinct(), n_rest)
        whole = in_few(members.select("fp").join(roots, F.col("fp") == F.col("node"), "left"), n_members).select("fp", F.coalesce("root", "fp").alias("root"))
        whole, n_whole = settled(in_few(whole.join(in_few(asked.select("most").distinct(), n_rest), F.col("root") == F.col("most")), n_members))
        parts = broadcast_if_few(*settled(in_few(whole.groupBy("most").agg(F.count("fp").alias("size")), n_whole).select("most", size)))
        targets = in_few(in_few(whole.join(parts, "most"), n_whole).join(members, "fp"), WIDE * n_whole).select(F.col("most").alias("key"), own.alias("x"), own.alias("y"), F.lit(1).alias("side"), "fp", "n", "root", "sig", "codes")
        queries = in_few(in_few(asked.join(parts, "most"), n_rest).withColumn("x", every).join(members, "fp"), WIDE * n_rest).select(F.col("most").alias("key"), "x", F.col("x").alias("y"), F.lit(0).alias("side"), "fp", "n", "root", "sig", "codes")
        more = joined(targets.unionByName(queries), "all" if last else "one", n_whole + n_rest)
        if not last:
            check(more)
            continue
        # and these among themselves, block by block: so many pairs as would join the groups if all of them hold
        rest, n_rest = settled(distinct_sets(rest, n_rest))
        parts, n_parts = settled(in_few(rest.groupBy("key").agg(F.count("fp").alias("size"), F.count_distinct("root").alias("groups")), n_rest).filter("groups > 1").select("key", size))
        within = lambda keys: in_few(in_parts(rest, keys, n_rest).join(members, "fp"), WIDE * n_rest).select(*columns)
        failed, n_failed = check(more.unionByName(joined(within(broadcast_if_few(parts, n_parts)), "forest", n_rest)))
        if n_failed:  # where one does not hold, all pairs are looked at
            sides = [rest.select("key", F.col("fp").alias(c)) for c in "ab"]
            keys = in_few(in_few(failed.join(sides[0], "a"), n_rest).join(sides[1], ["b", "key"]), n_rest).select("key")
            keys = in_few(parts.join(in_few(keys.distinct(), n_rest), "key", "left_semi"), n_rest)
            check(joined(within(keys), "all", n_rest))
    return found


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, root) of every row: rows of one root are a group, hash is xxhash64 of the text."""
    texts = df.select(text_or_empty(text_col).alias("text"))
    common = common_shingles(texts)
    held = saved(prints(df, id_col, text_col, common))
    size = held.count()
    nodes = held.groupBy("fp").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct(F.col("hash").alias("h"), F.col("id").alias("i"))).alias("rep"))
    nodes, _ = settled(in_few(nodes, 4 * size), 4)
    roots = components(links(df, held, nodes, common, id_col, text_col))
    return in_few(held.select("id", "hash", "fp").join(roots, F.col("fp") == F.col("node"), "left"), size).select("id", "hash", F.coalesce("root", "fp").alias("root"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near documents, with all its columns: that of smallest id, then of smallest hash of its text.

    Groups are those of texts whose sets of five-word shingles reach a Jaccard similarity of 0.8, found by the
    bit-sliced comparison of wide fingerprints. Rows without an id come after all others of their group. Of rows that agree in
    id and text one stays; two different texts of one id are judged each for itself.
    """
    rows, size = settled(judged(df, id_col, text_col))
    least = in_few(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("best")), size)
    told, _ = settled(in_few(rows.join(least, "root"), size).select("id", "hash", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("hash") == F.col("best.hash"))).alias("stays")))
    gone = told.filter("not stays").select(F.col("id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    gone = broadcast_if_few(*settled(in_few(gone, size)))
    out = df.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__hash")), "left_anti")
    if in_few(told.filter("stays").groupBy("id", "hash").count(), size).filter("count > 1").limit(1).count():
        out = out.withColumn("__hash", F.xxhash64(text_or_empty(text_col))).dropDuplicates([id_col, "__hash"])
    return out.select(df.columns)
