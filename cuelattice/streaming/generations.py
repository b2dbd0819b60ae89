"""Generations as a stream: files that appear in a folder are parsed, and their answer counts are kept by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelattice.functions.text import letters_and_spaces
from cuelattice.sources.readers import GENERATIONS, flattened
from cuelattice.sources.sinks import delete, whole

KEYS = ("model", "cue", "response")
#: Batches after which their folders are summed into one.
COMPACT = 32


def read(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(model, cue, response) of the JSON lines in a folder as a stream; malformed lines go."""
    rows = spark.readStream.schema(GENERATIONS).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_at_once).json(folder)
    parts = flattened(rows.select("cue", "model", F.explode("responses").alias("r")))
    return parts.select("model", "cue", letters_and_spaces(F.col("response")).alias("response")).filter("response <> '' and cue <> ''")


def keep_counts(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Counts by (model, cue, response) of each batch, in a folder of ``target`` for the query and the batch's number.

    A batch that is run again after a failure writes its own folder anew, so it counts once; another query, which is one with
    another checkpoint, has other folders, so several may feed one target. After every COMPACT batches their folders are
    summed into one. A batch costs what it holds, and the sums over all of it once in COMPACT batches.
    """
    source: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not source:  # the query's id outlives restarts: it stands in the checkpoint
            source.append(spark.read.json(f"{checkpoint}/metadata").first()["id"])
        folder = f"{target}/source={source[0]}"
        if any(upto >= number for upto in finished(spark, folder)["upto"]):
            return  # run again though it is in a sum already
        batch.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if number % COMPACT == COMPACT - 1:
            compact(spark, folder, number)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finished(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """The numbers of a source's folders, by kind (batch or upto), that are written as a whole."""
    found: dict[str, list[int]] = {"batch": [], "upto": []}
    for name in whole(spark, f"{folder}/*"):
        kind, _, number = name.rsplit("/", 1)[-1].partition("=")
        found[kind].append(int(number))
    return found


def counted(spark: SparkSession, folder: str, last: int | None = None) -> list[str]:
    """The folders that make up a source's counts up to batch ``last``: the newest sum and the batches after it."""
    found = finished(spark, folder)
    base = max((n for n in found["upto"] if last is None or n <= last), default=None)
    after = [n for n in found["batch"] if (base is None or n > base) and (last is None or n <= last)]
    return ([] if base is None else [f"{folder}/upto={base}"]) + [f"{folder}/batch={n}" for n in sorted(after)]


def compact(spark: SparkSession, folder: str, last: int) -> None:
    """Sums a source's batches up to ``last`` into one folder; what it replaces goes one sum later, for readers at work."""
    before = finished(spark, folder)
    total(spark.read.parquet(*counted(spark, folder, last))).write.mode("overwrite").parquet(f"{folder}/upto={last}")
    older = max((n for n in before["upto"] if n < last), default=None)
    if older is not None:
        for kind, limit in (("batch", older), ("upto", older - 1)):
            for n in before[kind]:
                if n <= limit:
                    delete(spark, f"{folder}/{kind}={n}")


def total(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    """(model, cue, response, n) of all finished batches of all queries that feed ``target``, or None."""
    sources = sorted({p.rsplit("/", 2)[0] + "/" + p.rsplit("/", 2)[1] for p in whole(spark, f"{target}/source=*/*")})
    folders = [f for s in sources for f in counted(spark, s)]
    return total(spark.read.parquet(*folders)) if folders else None
