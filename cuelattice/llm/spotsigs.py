"""SpotSigs fingerprints: chains of content words that follow common-word anchors. DataFrame functions only.

A text is lower-cased and cut into words of letters and digits. Wherever an anchor stands, it and the next ``CHAIN``
content words (common words are skipped) make a signature, kept as its XXH64. A text without anchors takes
each word as one. The fingerprint is the sorted set of signatures, sixteen hexadecimal digits each.

Near documents are found among sets whose lengths allow the similarity: sets are partitioned by length so that only
equal or neighbouring partitions can hold a pair, candidates share one of the rarest signatures of both sets (so many
that no pair is lost), and Jaccard similarity is computed only where the lengths admit it.

Defined results: a null text counts as empty; a text without words has the empty fingerprint, whose likeness is 1 to
another empty one and else 0; rows without an id, or with one that is no whole number, come last in the order of ids; equal ids are ordered by a hash of their
texts; a single row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import saved, table

CHAIN, SIMILARITY = 2, 0.8
#: Sets of a signature that one share of it holds.
SHARE = 512
#: Rows of a range of ids that one window aims at, and the most ranges (their bounds come to the driver).
RANGE_ROWS, MOST_RANGES = 2000, 1 << 14
#: Fixed lists: anchors and further common words of English, French, German and Spanish.
ANCHORS = "the a an is of and le la un est et der die das ist und el los y una es".split()
SKIPPED = """to in that it for was on as with be by this are at re from or not he his but de les des en une que qui dans pour par
sur pas au du il elle avec zu den von mit sich nicht auf für im dem ein eine als auch las del se con no lo su al por como""".split()


def signatures(text: Column) -> list[tuple[str, Column]]:
    """Steps (name, expression), each over the ones before, from a text to its array of distinct signatures ``sigs``."""
    common = [*ANCHORS, *SKIPPED]
    word, content = (lambda at: F.get("words", at)), (lambda at: F.get("content", at))
    hashed = F.xxhash64
    spots = F.transform("spots", lambda p, k: F.when(word(p).isin(ANCHORS), hashed(word(p), *(content(p - k + j) for j in range(CHAIN)))))
    every = F.transform("words", lambda w, i: hashed(w, *(word(i + j) for j in range(1, CHAIN + 1))))
    some = F.array_distinct(F.filter(spots, lambda x: x.isNotNull()))
    return [
        ("words", F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")),
        ("common", F.transform("words", lambda w: w.isin(common))),
        ("content", F.filter("words", lambda w, i: ~F.get("common", i))),
        # the k-th common word at place p has p - k content words before it
        ("spots", F.filter(F.transform("words", lambda w, i: F.when(F.get("common", i), i)), lambda p: p.isNotNull())),
        ("some", some),
        ("sigs", F.sort_array(F.when(F.size("some") > 0, F.col("some")).otherwise(F.array_distinct(every)))),
    ]


def with_signatures(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the array column ``out``; ``df`` must not have the names of the steps."""
    keep = df.columns
    for name, step in signatures(text):
        df = df.withColumn(name, step)
    return df.select(*keep, F.col("sigs").alias(out))


def shown(sigs: str) -> Column:
    """The fingerprint string of a signature set."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a comparison where the lengths keep it below ``least``."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    low, high = F.least(n, m), F.greatest(n, m)
    return F.when(high == 0, 1.0).when((low == 0) | (low < F.lit(least) * high), 0.0).otherwise(both / (n + m - both))


# --- the next document by descending id -----------------------------------------------------------------------------


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the descending ``bounds`` (2**k - 1 of them) are above ``key``: a binary search."""
    steps = (len(bounds) + 1).bit_length() - 1
    if not steps:
        return F.lit(0)
    known = F.lit(bounds)
    jump = lambda acc, s: F.when(F.get(known, acc + s - 1) > key, acc + s).otherwise(acc)
    return F.aggregate(F.lit([1 << k for k in reversed(range(steps))]), F.lit(0), jump)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sigs, next_text, next_sigs): each row with the next one by descending id; after the last, the first.

    Ids are cut into ranges of about RANGE_ROWS rows, so that there is no single sorted task; each range also gets the
    first row of the next range. The texts move once. Only range bounds and each range's first id reach the driver.
    """
    lowest = F.lit(-(1 << 63))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).try_cast("long"), lowest).alias("key"))
    count = rows.count()
    ranges = min(MOST_RANGES, 1 << max(0, math.ceil(math.log2(max(1, count) / RANGE_ROWS))))
    bounds = []
    if ranges > 1:
        at = [1 - k / ranges for k in range(1, ranges)]
        bounds = rows.agg(F.percentile_approx("key", at, max(10_000, 10 * ranges))).first()[0]
    placed = rows.withColumn("range", _range_of(F.col("key"), bounds))
    heads = {r["range"]: r["head"] for r in placed.groupBy("range").agg(F.max("key").alias("head")).collect()}  # a row a range
    used = sorted(heads)
    before = {r: used[k - 1] for k, r in enumerate(used)}
    first = F.lit([heads.get(r, 0) for r in range(ranges)])
    copies = F.lit([before.get(r, 0) for r in range(ranges)])
    is_head = F.col("key") == F.get(first, F.col("range"))
    own = F.struct(F.col("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.get(copies, F.col("range")).alias("range"), F.lit(True).alias("ghost"))
    dealt = placed.withColumn("place", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))))
    dealt = dealt.select("id", "text", "key", F.col("place.range").alias("range"), F.col("place.ghost").alias("ghost")).repartition("range")
    signed = with_signatures(dealt, F.col("text"), "own_sigs")
    order = Window.partitionBy("range").orderBy("ghost", F.desc("key"), F.xxhash64("text"))
    out = signed.withColumn("next", F.lead(F.struct("text", "own_sigs")).over(order)).filter("not ghost")
    return out.select("id", "text", "own_sigs", F.col("next.text").alias("next_text"), F.col("next.own_sigs").alias("next_sigs"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sigs, fingerprint) of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_signatures(rows, F.col("text"), "own_sigs").select("id", F.col("own_sigs").alias("sigs"), shown("own_sigs").alias("fingerprint"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last third is the beginning of the next, with likenesses."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third), F.col("next_text").substr(F.lit(1), third))
    rows = with_next(df, id_col, text_col).select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own_sigs", "next_sigs")
    rows = with_signatures(rows, F.col("edited"), "edited_sigs")
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("own_sigs").alias("fingerprint"),
        shown("edited_sigs").alias("edited_fingerprint"),
        likeness("own_sigs", "edited_sigs").alias("near_edited"),
        likeness("own_sigs", "next_sigs").alias("near_next"),
    )


# --- near documents ---------------------------------------------------------------------------------------------------


def near_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(classes, links): (id, class_id) of every row, and (a, b, similarity) of classes with ``least`` similarity or more.

    Rows of equal fingerprints are one class, named by their smallest id, and are compared once. No link is lost: two
    sets of that similarity share one of the ``n - ceil(least * n) + 1`` first signatures of either set in any common
    order; the order is by rarity, so that passages shared by many documents come last.
    """
    prints = saved(fingerprints(df, id_col, text_col))
    sets = saved(prints.filter("id is not null").groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.first("sigs").alias("sigs")))
    classes = prints.join(sets.select("fingerprint", "class_id"), "fingerprint", "left").select(F.col("id").alias(id_col), "class_id")
    own = sets.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = own.groupBy("sig").agg(F.count("class_id").alias("rows"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("rows", "sig"))
    first = own.join(rarity.filter("rows > 1"), "sig", "left").withColumn("rows", F.coalesce("rows", F.lit(1))).withColumn("rank", rank)
    heads = first.filter((F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1) & (F.col("rows") > 1))
    part = F.floor(F.log("n") / math.log(1 / least)).cast("int")
    # the shorter sets of a signature meet the longer ones in shares, so that no task gathers all of a frequent one
    shares = F.ceil(F.col("rows") / SHARE).cast("int")
    left = heads.select("sig", F.col("class_id").alias("a"), F.col("n").alias("n_a"), shares.alias("shares"), F.explode(F.array(part, part + 1)).alias("part"))
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    right = heads.select("sig", F.col("class_id").alias("b"), F.col("n").alias("n_b"), part.alias("part"), F.pmod(F.xxhash64("class_id"), shares).cast("int").alias("share"))
    longer = (F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") > F.col("a")))
    pairs = left.join(right, ["sig", "part", "share"]).filter(longer & (F.col("n_a") >= F.lit(least) * F.col("n_b") - 1e-9)).select("a", "b").distinct()
    whole = sets.select("class_id", "sigs")
    both = pairs.join(whole.select(F.col("class_id").alias("a"), F.col("sigs").alias("sigs_a")), "a").join(whole.select(F.col("class_id").alias("b"), F.col("sigs").alias("sigs_b")), "b")
    scored = both.select("a", "b", likeness("sigs_a", "sigs_b", least).alias("similarity"))
    return classes, scored.filter(F.col("similarity") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def op3_spotsigs(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
