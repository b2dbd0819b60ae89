import os
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.sources import arrays, sinks


class Hostile:
    def __reduce__(self):
        return os.system, ("true",)


def bundle(path, **more):
    rng = np.random.default_rng(2)
    cues = [f"w{k}" for k in range(25)]
    data = {"embeddings": {"a": rng.normal(size=(25, 4)), "b": rng.normal(size=(25, 2)).astype(np.float32)}, "mappings": {"cue_to_idx": {c: k for k, c in enumerate(cues)}, "idx_to_cue": dict(enumerate(cues)), **more}}
    path.write_bytes(pickle.dumps(data))
    return data


def test_a_pickled_bundle_reads_like_one_of_parquet(spark, tmp_path):
    data = bundle(tmp_path / "b.pkl")
    got = arrays.pickled_bundle(spark, str(tmp_path / "b.pkl"), 7)
    assert got.rdd.getNumPartitions() == 8
    sinks.bundle(got, f"{tmp_path}/p")
    for rows in (got.collect(), spark.read.parquet(f"{tmp_path}/p").collect()):
        assert len(rows) == 50
        for r in rows:
            assert np.allclose(r["vec"], data["embeddings"][r["embedding_key"]][int(r["cue"][1:])])


def test_hostile_and_other_pickles_are_refused(spark, tmp_path):
    bundle(tmp_path / "h.pkl", extra=Hostile())
    with pytest.raises(Exception, match="may not hold"):
        arrays.pickled_bundle(spark, str(tmp_path / "h.pkl")).collect()
    (tmp_path / "l.pkl").write_bytes(pickle.dumps([1, 2]))
    with pytest.raises(Exception, match="no bundle"):
        arrays.pickled_bundle(spark, str(tmp_path / "l.pkl")).collect()


def vectors(spark, words):
    return spark.createDataFrame([(w, [float(k), 0.5]) for k, w in enumerate(words)], "word string, vec array<double>")


def test_npy_files_are_written_once(spark, tmp_path):
    out = str(tmp_path / "npy")
    arrays.npy_by_word(spark, vectors(spark, ["a", "b/c", "b c", None, "é"]), out)
    first = {f: os.stat(f"{out}/{f}").st_mtime_ns for f in os.listdir(out)}
    assert len(first) == 4 and all(f.endswith(".npy") for f in first)
    arrays.npy_by_word(spark, vectors(spark, ["zz", "b/c", "a"]), out)
    after = {f: os.stat(f"{out}/{f}").st_mtime_ns for f in os.listdir(out)}
    assert len(after) == 5 and all(after[f] == t for f, t in first.items())
    name = spark.range(1).select(arrays.file_of(F.lit("b/c")).alias("f")).first()["f"]
    assert np.load(f"{out}/{name}").tolist() == [1.0, 0.5] and np.load(f"{out}/{name}").dtype == np.float32


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "npy")
    bad = vectors(spark, [f"w{k}" for k in range(40)]).repartition(4).withColumn("vec", F.when(F.col("word") == "w7", F.array(F.raise_error(F.lit("broken")).cast("double"))).otherwise(F.col("vec")))
    with pytest.raises(Exception, match="broken"):
        arrays.npy_by_word(spark, bad, out)
    assert not os.path.exists(out) or os.listdir(out) == []


def test_rows_are_appended_below_one_header(spark, tmp_path):
    out = str(tmp_path / "csv")
    for part in (["x", 'y,"z"'], ["u"]):
        sinks.append_csv(spark, spark.createDataFrame([(w, 1) for w in part], "`a,b` string, n int").coalesce(1), out)
    files = sorted(f"{d}/{f}" for d, _, names in os.walk(out) for f in names if f.endswith(".txt"))
    text = "".join(open(f).read() for f in files)
    assert text.splitlines()[0] == '"a,b",n' and sorted(text.splitlines()[1:]) == ['"y,\\"z\\"",1', "u,1", "x,1"]
