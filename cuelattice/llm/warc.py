"""WARC records and a Merkle fixity audit of their replicas.

Each page is a resource record; records follow each other by id in files of ``FILE_IDS`` ids, so a record has an offset range.
There are two trees over the ids: a leaf of the record tree hashes an id's record hash, a leaf of the range tree its offset
and length. A node of level k hashes those of its up to ``FANOUT`` children, that is, of the ids that agree after division by
FANOUT**k. Replicas are compared from the roots: only the children of nodes that differ are looked at, down to the ids whose
records are changed, missing or extra (record tree) or only moved (range tree), as damage that changes a length moves all
that follows in its file.

DataFrame functions only. Texts never shuffle: hashes, lengths and ids do. Equal records are counted before they are ordered,
and the records of a hot id are ordered within cells of their hashes, so no node or window gathers an id. Defined results: null
url or html counts as empty; rows without an id are in no file and in no tree, and are left out of the audit; rows of one id are
ordered by their record hash and make one leaf from their count and their summed hashes; an empty table gives an empty audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import saved, table

FANOUT, FILE_IDS = 16, 256
#: Pages have no date of their own; records need one.
DATE = "1970-01-01T00:00:00Z"
#: Characters of the hash that name a cell of an id's records.
CELL = 3


def record(id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = DATE) -> Column:
    """The bytes of a resource record as a string."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    first = F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {date}\r\nWARC-Target-URI: ")
    head = F.concat(first, F.coalesce(F.col(url_col), F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col(id_col).cast("string"))
    return F.concat(head, F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def _before(value: str, by: list[str], order: list[str]) -> Column:
    """The sum of ``value`` over the rows before this one."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def parted(col: str, n: int) -> Column:
    """A whole number divided and rounded down, without a detour by doubles, which hold no more than 53 bits."""
    return F.expr(f"(CAST({col} AS BIGINT) - pmod({col}, {n}L)) div {n}")


def offset_ranges(records: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
    """(ids, equal) of (id, sha, length) rows: each id's file, offset and bytes, and its distinct records with offset and count n.

    Records lie in their file by id, then hash: three running sums, over the ids of a file, the cells of an id and the distinct
    records of a cell.
    """
    keys = [*also, "id"]
    equal = records.groupBy(*keys, "sha", "length").agg(F.count("sha").alias("n"))
    equal = saved(equal.withColumn("cell", F.substring("sha", 1, CELL)).withColumn("bytes", F.col("n") * F.col("length")))
    cells = equal.groupBy(*keys, "cell").agg(F.sum("bytes").alias("bytes"))
    ids = cells.groupBy(*keys).agg(F.sum("bytes").alias("bytes")).withColumn("file", parted("id", FILE_IDS))
    ids = saved(ids.withColumn("offset", _before("bytes", [*also, "file"], ["id"])))
    placed = cells.withColumn("in_id", _before("bytes", keys, ["cell"])).drop("bytes").join(ids.withColumnRenamed("offset", "of_id").drop("bytes"), keys)
    inner = equal.withColumn("in_cell", _before("bytes", [*keys, "cell"], ["sha", "length"]))
    return ids, inner.join(placed, [*keys, "cell"]).select(*keys, "sha", "length", "n", "file", (F.col("of_id") + F.col("in_id") + F.col("in_cell")).alias("offset"))


def leaves(equal: DataFrame, *also: str) -> DataFrame:
    """(id, hash) for each id of (id, sha, n): its single record's hash, or a hash of count and sums of several records'."""
    number = F.conv(F.substring("sha", 1, 15), 16, 10).cast("decimal(38,0)")
    made = equal.groupBy("id", *also).agg(F.sum("n").alias("n"), F.min("sha").alias("low"), F.max("sha").alias("high"), F.sum(number * F.col("n")).alias("total"))
    hashed = F.when(F.col("n") == 1, F.col("low")).otherwise(F.sha2(F.concat_ws(":", "n", "low", "high", F.col("total").cast("string")), 256))
    return made.select("id", *also, hashed.alias("hash"))


def tree(leaf: DataFrame, *also: str, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (id, hash) from the leaves to one root (ids of one sign; each sign has its root)."""
    levels = [saved(leaf)]
    span = levels[0].agg(F.max(F.greatest(F.col("id"), F.bitwise_not(F.col("id"))))).first()[0] or 0
    while span > 0:
        below = levels[-1]
        up = below.groupBy(parted("id", fanout).alias("up"), *also).agg(F.sort_array(F.collect_list(F.struct("id", "hash"))).alias("children"))
        hashed = F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), ""), 256)
        levels.append(saved(up.select(F.col("up").alias("id"), *also, hashed.alias("hash"))))
        span //= fanout
    return levels


def mismatches(levels: list[DataFrame], replica: str, one, other, fanout: int = FANOUT) -> DataFrame:
    """(id, one_hash, other_hash) of the leaves that differ, by descent through nodes that differ."""
    bad = None
    for level in reversed(levels):
        sides = [level.filter(F.col(replica) == x).select("id", F.col("hash").alias(name)) for x, name in ((one, "one_hash"), (other, "other_hash"))]
        if bad is not None:
            parents = bad.select(F.col("id").alias("parent"))
            sides = [s.join(parents, parted("id", fanout) == F.col("parent"), "left_semi") for s in sides]
        both = sides[0].join(sides[1], "id", "full_outer")
        bad = saved(both.filter(~F.col("one_hash").eqNullSafe(F.col("other_hash"))))
    return bad


def audit(replicas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, bad) of rows (replica 0 or 1, id, sha, length).

    ranges has replica 0's records (id, sha, length, file, offset, n for so many equal ones in a row); bad has (id, status) of
    the ids that the descents find: changed, missing (from replica 1), extra (in it) or moved.
    """
    ids, equal = offset_ranges(replicas.filter("id is not null"), "replica")
    equal = saved(equal)
    place = F.sha2(F.concat_ws(":", "offset", "bytes"), 256)
    moved = mismatches(tree(ids.select("id", "replica", place.alias("hash")), "replica"), "replica", 0, 1)
    other = mismatches(tree(leaves(equal, "replica"), "replica"), "replica", 0, 1)
    status = F.when(F.col("other_hash").isNull(), "missing").when(F.col("one_hash").isNull(), "extra").otherwise("changed")
    bad = other.select("id", status.alias("status"))
    only = moved.join(bad.select("id"), "id", "left_anti").select("id", F.lit("moved").alias("status"))
    return equal.filter("replica = 0").drop("replica"), bad.unionByName(only)


#: The replica of the registered query is damaged where the CRC of the id is DAMAGED in DAMAGE: one character of its body.
DAMAGE, DAMAGED = 101, 7


def damaged_body(id_col: str = "page_id", body_col: str = "html") -> Column:
    """The body with its first character replaced for ids that the rule picks, else unchanged."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % DAMAGE == DAMAGED
    return F.when(hit, F.concat(F.lit("#"), F.substring(body, 2, 1 << 30))).otherwise(body)


def replica_rows(pages: DataFrame) -> DataFrame:
    """(replica, id, sha, length) of the pages and of their damaged replica, in one pass over the pages."""
    both = pages.select("page_id", record().alias("record_0"), damaged_body().alias("body"), "url")
    both = both.select("page_id", "record_0", record(body_col="body").alias("record_1"))
    facts = [F.struct(F.lit(k).alias("replica"), F.sha2(F.col(f"record_{k}").cast("binary"), 256).alias("sha"), F.octet_length(f"record_{k}").cast("long").alias("length")) for k in (0, 1)]
    return both.select(F.col("page_id").alias("id"), F.explode(F.array(*facts)).alias("x")).select("x.replica", "id", "x.sha", "x.length")


def op9_fixity(spark, sf_dir: str) -> DataFrame:
    """Every record with its file, offset range, hash and what the audit of the replica found about it."""
    ranges, bad = audit(replica_rows(table(spark, sf_dir, "pages")))
    own = ranges.join(bad, "id", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    offset = (F.col("offset") + F.col("copy") * F.col("length")).cast("long")
    return own.select(F.col("id").alias("page_id"), F.col("file").cast("long").alias("warc_file"), offset.alias("record_offset"), F.col("length").alias("record_length"), F.col("sha").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


def _duck_record(body: str) -> str:
    crlf = "chr(13) || chr(10)"
    return (
        f"'WARC/1.1' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Date: {DATE}' || {crlf} || 'WARC-Target-URI: ' || coalesce(url, '') || {crlf} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {crlf}"
        f" || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || strlen({body}) || {crlf} || {crlf} || {body} || {crlf} || {crlf}"
    )


#: An audit without trees: records of both replicas compared id by id. DuckDB has no CRC-32; it is folded from the id's digits.
def oracle() -> str:
    body = "coalesce(html, '')"
    crc = _duck_crc("CAST(page_id AS VARCHAR)")
    other = f"CASE WHEN {crc} % {DAMAGE} = {DAMAGED} THEN '#' || substr({body}, 2) ELSE {body} END"
    place = "coalesce(sum({0}) OVER (PARTITION BY page_id // {1} ORDER BY page_id, {2} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""WITH r AS (SELECT page_id, {_duck_record(body)} AS a, {_duck_record(f"({other})")} AS b FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT page_id, strlen(a) AS n, strlen(b) AS m, sha256(a) AS s, sha256(b) AS t FROM r),
o AS (SELECT page_id, n, s, t, {place.format("n", FILE_IDS, "s")} AS x, {place.format("m", FILE_IDS, "t")} AS y FROM h),
f AS (SELECT page_id, list(s ORDER BY s) <> list(t ORDER BY t) AS hit, min(x) <> min(y) AS shifted FROM o GROUP BY page_id)
SELECT o.page_id, o.page_id // {FILE_IDS} AS warc_file, CAST(x AS BIGINT) AS record_offset, CAST(n AS BIGINT) AS record_length, s AS record_sha256,
       CASE WHEN hit THEN 'changed' WHEN shifted THEN 'moved' ELSE 'ok' END AS status FROM o JOIN f ON o.page_id = f.page_id"""


def _duck_crc(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB: bits are folded one by one."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, k: {step}, xor(c, CAST(ascii(x) AS BIGINT)))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: {byte.replace('CAST(ascii(x) AS BIGINT)', 'x')}, CAST(4294967295 AS BIGINT)), 4294967295)"
