"""Array files: pickled bundles of embeddings as a source, one ``.npy`` a word as a sink.

Paths may be of any file system that Arrow knows and all workers reach. Pickles are read by an unpickler that admits arrays, numbers, strings and
mappings only, so that a bundle cannot run code.
"""

from __future__ import annotations

import io
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cuelattice.operators.driver import kept
from cuelattice.plans.session import ship_code

#: Lines of a bundle's matrix that one partition reads, and bytes of bundles that a worker keeps.
LINES, KEPT_BYTES = 8192, 1 << 30
#: What a pickled array consists of.
ADMITTED = {
    ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"),
    ("numpy.core.numeric", "_frombuffer"), ("numpy._core.numeric", "_frombuffer"), ("_codecs", "encode"), ("collections", "OrderedDict"),
}


class Admitting(pickle.Unpickler):
    """An unpickler of arrays, numbers, strings and mappings; anything else is refused before it is made."""

    def find_class(self, module: str, name: str):
        if (module, name) not in ADMITTED:
            raise pickle.UnpicklingError(f"a bundle may not hold {module}.{name}")
        return super().find_class(module, name)


def opened(path: str):
    return fs.FileSystem.from_uri(path)


def bundle_of(path: str) -> dict:
    """{"embeddings": {key: matrix}, "mappings": {"cue_to_idx": {cue: line}}} of a pickle, or ValueError."""
    system, place = opened(path)
    with system.open_input_file(place) as f:
        found = Admitting(io.BytesIO(f.read())).load()
    if not isinstance(found, dict) or not isinstance(found.get("embeddings"), dict) or not isinstance(found.get("mappings", {}).get("cue_to_idx"), dict):
        raise ValueError(f"{path} is no bundle of embeddings")
    return found


@dataclass
class Lines(InputPartition):
    key: str
    start: int
    end: int

    def __init__(self, key: str, start: int, end: int):
        super().__init__((key, start, end))
        self.key, self.start, self.end = key, start, end


class BundleReader(DataSourceReader):
    def __init__(self, path: str, lines: int):
        self.path, self.lines = path, lines

    def partitions(self) -> list[InputPartition]:
        shapes = {k: len(m) for k, m in bundle_of(self.path)["embeddings"].items()}
        return [Lines(k, at, min(at + self.lines, n)) for k, n in sorted(shapes.items()) for at in range(0, n, self.lines)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        size = lambda b: sum(np.asarray(m).nbytes for m in b["embeddings"].values())
        bundle = kept(f"bundle {self.path}", lambda: bundle_of(self.path), size, KEPT_BYTES)
        cues = {line: cue for cue, line in bundle["mappings"]["cue_to_idx"].items() if partition.start <= line < partition.end}
        matrix = np.asarray(bundle["embeddings"][partition.key], float)
        at = sorted(cues)
        yield pa.RecordBatch.from_arrays([pa.array([partition.key] * len(at), pa.string()), pa.array([cues[k] for k in at], pa.string()), pa.array([matrix[k] for k in at], pa.list_(pa.float64()))], names=["embedding_key", "cue", "vec"])


class BundleSource(DataSource):
    """format("pickled_bundle"): (embedding_key, cue, vec) of a pickle; a partition is a range of one matrix's lines."""

    @classmethod
    def name(cls) -> str:
        return "pickled_bundle"

    def schema(self) -> str:
        return "embedding_key string, cue string, vec array<double>"

    def reader(self, schema) -> DataSourceReader:
        return BundleReader(self.options["path"], int(self.options.get("lines", LINES)))


def pickled_bundle(spark: SparkSession, path: str, lines: int = LINES) -> DataFrame:
    """(embedding_key, cue, vec) of a pickled bundle."""
    ship_code(spark)
    spark.dataSource.register(BundleSource)
    return spark.read.format("pickled_bundle").option("lines", lines).load(path)


# --- one file a word ----------------------------------------------------------------------------------------------------


def file_of(word: Column) -> Column:
    """The file of a word: what of it may be in a name, and a part of its md5, so that no two words share a file."""
    return F.concat(F.regexp_replace(word, "[^A-Za-z0-9._-]", "_"), F.lit("-"), F.substring(F.md5(word.cast("binary")), 1, 12), F.lit(".npy"))


def unwritten(spark: SparkSession, words: DataFrame, path: str, word: str = "word") -> DataFrame:
    """The rows whose word has no file below ``path`` yet; only names are listed, and joined as a table."""
    system, place = opened(path)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return words
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(F.element_at(F.split("path", "/"), -1).alias("__file"))
    return words.join(there, file_of(F.col(word)) == F.col("__file"), "left_anti")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class NpyWriter(DataSourceWriter):
    """Files lie in a task's own folder until the job is done and are moved then; what a failed or repeated task left goes with the job's folder."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, place = opened(self.path)
        folder, files = f"{place}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        for row in iterator:
            held = io.BytesIO()
            np.save(held, np.asarray(row["vec"], np.float32))
            with system.open_output_stream(f"{folder}/{row['file']}") as f:
                f.write(held.getvalue())
            files.append(row["file"])
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = opened(self.path)
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{m.folder}/{name}", f"{place}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, place = opened(self.path)
        if system.get_file_info(f"{place}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{place}/{self.job}")


class NpySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_by_word"

    def schema(self) -> str:
        return "file string, vec array<double>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NpyWriter(self.options["path"])


def npy_by_word(spark: SparkSession, vectors: DataFrame, path: str, word: str = "word", vec: str = "vec") -> None:
    """Writes a float32 ``.npy`` file for each (word, vec) whose word has none yet; nulls are left out, of repeated words one row counts."""
    ship_code(spark)
    spark.dataSource.register(NpySink)
    rows = unwritten(spark, vectors.filter(F.col(word).isNotNull() & F.col(vec).isNotNull()), path, word)
    rows = rows.groupBy(file_of(F.col(word)).alias("file")).agg(F.first(F.transform(vec, lambda x: x.cast("double"))).alias("vec"))
    rows.write.format("npy_by_word").mode("append").option("path", path).save()
