"""The prefix trie of conversations by prefix doubling: what conversations share from their start on, and what sharing saves.

Turns are named by dense whole numbers, equal turns alike. Aligned blocks of two, four, eight ... turns are named by the pair of
names of their halves, so that after a logarithmic number of join rounds every block of 2**k turns that starts at a multiple of 2**k
has a name. A prefix of d turns is composed of the blocks of d's binary digits, longest first: its name is that of the pair (the prefix
without the last block, the last block), again in logarithmic rounds. Prefixes of one name are one node of the trie.

Sums over subtrees take logarithmic rounds, too: what a node has gathered from descendants nearer than 2**k goes to its ancestor
2**k turns up, whose name is found by conversation and depth, keys that occur once. Names are given to distinct pairs only, by buckets of
their hash and the sizes of the buckets before; sums and counts are made before rows are shuffled; the ids of a node's ended
conversations are joined in ranges to pieces, which one hash then takes in order. So a turn, a conversation or a node that has a
large share of all rows is split.

Defined results: a null role or text counts as empty; rows without a conversation's id take no part; turns are ordered by their number, null
first, equal numbers by role and then by the SHA-256 of the text; repeated rows are turns of their own. Equal turns are those of one
SHA-256 of role and text. The root has depth 0, no parent and no text. An empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import Scratch, saved, ship_code, table
from cuelattice.operators.assoc import dense_index

#: Ids that one piece of a node's list holds.
PIECE = 512
#: Fixed values of the splice: conversations of a hundred share the start of their first, of up to five turns.
HUNDRED, MOST_HEAD = 100, 6

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
Put = Callable[[DataFrame], DataFrame]


def digest(role: Column, text: Column) -> Column:
    """32 bytes that tell turns apart; the role's length keeps the two from running into each other."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep_texts: bool = False) -> DataFrame:
    """(conv_id, pos from 0, key, chars) and, if asked, (role, text) of every turn in its conversation's order.

    Places come from ranges over all turns, so a long conversation is no single task.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = df.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), digest(r, t).alias("key"), F.sha2(t.cast("binary"), 256).alias("tie"), F.length(t).cast("long").alias("chars"), *([t.alias("text")] if keep_texts else []))
    placed = saved(dense_index(turns, "conv_id", "turn", "role", "tie", name="place"))
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first")).alias("pos"), "key", "chars", *(["role", "text"] if keep_texts else []))


def named(rows: DataFrame, keys: list[str], put: Put, base: int = 0) -> tuple[DataFrame, int]:
    """``rows`` with ``name``, a number from ``base`` on for each distinct value of ``keys``, without gaps; and how many there are."""
    spark = rows.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = put(rows.select(*keys).distinct().withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(n_buckets))))
    total, before = 0, []
    for bucket, n in sorted(map(tuple, found.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect())):  # a row a bucket
        before.append((bucket, base + total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "__bucket long, __start long"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys))
    names = found.join(starts, "__bucket").select(*keys, (F.col("__start") + place - 1).alias("name"))
    return rows.join(names, keys), total


def block_names(turns: DataFrame, longest: int, put: Put) -> list[DataFrame]:
    """For k = 0, 1, ... the names (conv_id, q, name) of the blocks of turns q * 2**k to (q + 1) * 2**k; blocks are whole."""
    rows, _ = named(turns.select("conv_id", F.col("pos").alias("q"), "key"), ["key"], put)
    levels = [put(rows.select("conv_id", "q", "name"))]
    while 2 ** len(levels) <= longest:
        half = lambda k: F.max(F.when(F.col("q") % 2 == k, F.col("name")))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("q", 1).alias("q")).agg(half(0).alias("a"), half(1).alias("b")).filter("a is not null and b is not null")
        rows, _ = named(put(pairs), ["a", "b"], put)
        levels.append(put(rows.select("conv_id", "q", "name")))
    return levels


def prefix_names(convs: DataFrame, levels: list[DataFrame], put: Put) -> DataFrame:
    """(conv_id, d, name) of every prefix of every conversation, that of no turns included; a name stands for one sequence."""
    prefixes, given = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name")), 1
    for k in reversed(range(len(levels))):
        last = levels[k].filter("q % 2 = 0").select("conv_id", F.shiftleft("q", k).alias("d"), F.col("name").alias("b"))
        pairs = last.join(prefixes.withColumnRenamed("name", "a"), ["conv_id", "d"]).select("conv_id", (F.col("d") + (1 << k)).alias("d"), "a", "b")
        rows, n = named(put(pairs), ["a", "b"], put, given)
        prefixes, given = prefixes.unionByName(put(rows.select("conv_id", "d", "name"))), given + n
    return put(prefixes)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) to (name, first, ids): PIECE ids at most in one string."""
    for batch in batches:
        names, ids = (c.to_pylist() for c in batch.columns)
        out, at = [], 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and end - at < PIECE and names[end] == names[at]:
                end += 1
            out.append((names[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (name, ends_sha256): one running hash, nothing of a list is held."""
    put = lambda name, h: pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["name", "ends_sha256"])
    now, running = None, None
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if running is not None and name == now:
                running.update(b"," + ids.encode())
            else:
                if running is not None:
                    yield put(now, running)
                now, running = name, hashlib.sha256(ids.encode())
    if running is not None:
        yield put(now, running)


def ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(name, ends_sha256) for each node where a conversation ends."""
    ship_code(prefixes.sparkSession)
    ended = prefixes.join(convs, [prefixes["conv_id"] == convs["conv_id"], prefixes["d"] == convs["n_turns"]]).select("name", prefixes["conv_id"])
    pieces = saved(ended.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_pieces, "name long, first long, ids string"))
    return pieces.repartition("name").sortWithinPartitions("name", "first").select("name", "ids").mapInArrow(_hashes, "name long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes (NODE) of conversations ``convs`` (conv_id, n_turns) with ``turns`` (conv_id, pos, key, chars), pos from 0 without gaps."""
    spark = turns.sparkSession
    with Scratch(spark) as scratch:
        put = scratch.put
        turns, convs = put(turns.select("conv_id", "pos", "key", "chars")), put(convs.select("conv_id", "n_turns"))
        longest = convs.agg(F.max("n_turns")).first()[0]
        if longest is None:
            return spark.createDataFrame([], NODE)
        prefixes = prefix_names(convs, block_names(turns, longest, put) if longest else [], put)
        nodes = put(prefixes.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.max("d").alias("depth"), F.count(F.lit(1)).alias("n_convs")))

        def above(steps: int) -> DataFrame:
            """(name, up): a node's ancestor so many turns up, of those that have one; looked up by one of its conversations."""
            asked = nodes.filter(F.col("depth") >= steps).select("name", "conv_id", (F.col("depth") - steps).alias("d"))
            return asked.join(prefixes.withColumnRenamed("name", "up"), ["conv_id", "d"]).select("name", "up")

        parents = put(above(1))
        children = parents.groupBy(F.col("up").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
        last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "chars")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        tree = put(nodes.join(last, ["conv_id", "depth"], "left").join(children, "name", "left").select("name", "conv_id", "depth", "n_convs", zero("n_children").alias("n_children"), ((F.col("n_convs") - 1) * zero("chars")).alias("saved")))
        sums = put(tree.select("name", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
        steps = 1
        while steps <= longest:
            ancestors = parents if steps == 1 else above(steps)
            more = sums.join(ancestors, "name").groupBy(F.col("up").alias("name")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            sums = put(sums.join(more, "name", "left").select("name", (F.col("n_leaves") + zero("l")).alias("n_leaves"), (F.col("saved_tokens") + zero("s")).alias("saved_tokens")))
            steps *= 2
        up = put(parents.join(nodes.select(F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up").select("name", "parent_conv_id"))
        out = tree.join(sums, "name").join(up, "name", "left").join(ends(prefixes, convs), "name", "left")
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        return saved(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")))


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are: NODE and the (role, text) of each node's last turn, null for the root."""
    turns = saved(ordered_turns(df, conv, turn, role, text, keep_texts=True))
    nodes = trie(turns, lengths(turns))
    return nodes.join(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) in which each conversation c has the first h turns of conversation c - c % 100 for its own first h, h = crc32(c) % 6."""
    count = lengths(turns)
    convs = count.select("conv_id", "n_turns", (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).alias("h"))
    heads = F.least("h", F.coalesce("base_turns", F.lit(0).cast("long")))
    convs = saved(convs.join(count.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns")), "base", "left").withColumn("head", heads))
    tails = turns.join(convs.select("conv_id", "h", "head"), "conv_id").filter("pos >= h").select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("pos"), "key", "chars")
    firsts = turns.filter(F.col("pos") < MOST_HEAD - 1).select(F.col("conv_id").alias("base"), "pos", "key", "chars")  # a few turns, for at most a hundred conversations
    starts = firsts.join(convs.select("base", "conv_id", "head"), "base").filter("pos < head").select("conv_id", "pos", "key", "chars")
    return starts.unionByName(tails), convs.select("conv_id", (F.col("head") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0).cast("long"))).alias("n_turns"))


def op11_prefixtrie(spark, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt ``conversations``, a row a node."""
    return trie(*spliced(saved(ordered_turns(table(spark, sf_dir, "conversations")))))


def oracle() -> str:
    """The same in DuckDB SQL: prefixes as lists, subtrees by comparison of lists, crc32 bit by bit."""
    bits = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda crc, b: xor(xor(crc, b) >> 1, CASE WHEN xor(crc, b) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))"
    return f"""
WITH own AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
    SELECT conv_id, turns, xor({bits}, CAST(4294967295 AS BIGINT)) % 6 AS h FROM own
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
    SELECT conv_id, unnest(range(len(turns) + 1)) AS d, turns FROM rebuilt
), nodes AS (
    SELECT turns[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, CAST((count(*) - 1) * coalesce(len(any_value(turns[d].t)), 0) AS BIGINT) AS saved,
        sha256(coalesce(string_agg(CASE WHEN len(turns) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM prefixes GROUP BY 1, 2
), family AS (
    SELECT n.path, n.depth, count(c.path) AS n_children FROM nodes n LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path GROUP BY 1, 2
), subtrees AS (
    SELECT n.path, n.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum(m.saved) AS BIGINT) AS saved_tokens
    FROM nodes n JOIN nodes m ON m.depth >= n.depth AND m.path[1:n.depth] = n.path JOIN family f ON f.path = m.path GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, f.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN family f ON f.path = n.path JOIN subtrees s ON s.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1] AND n.depth > 0"""
