import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelattice.operators import driver, infer, inputs
from cuelattice.sources import fixtures as fx

ROWS = "id long, prompt string, response_set string"


def rows_of(spark, n, parts=3):
    return spark.createDataFrame([(k, f"p{k}", "a, b" if k % 2 else "c") for k in range(n)], ROWS).repartition(parts)


def narrow(most, bad=()):
    """A scorer that fails above ``most`` rows, and always on the prompts in ``bad``."""

    def make():
        def run(prompts, responses):
            if len(prompts) > most or set(prompts) & set(bad):
                raise RuntimeError("out of memory")
            return [[-1.0] * len(r.split(", ")) for r in responses]

        return run

    return make


def test_a_scorer_that_fails_above_a_size_loses_no_row(spark):
    done = spark.sparkContext.accumulator(0)
    got = infer.summed(driver.scored(rows_of(spark, 200), narrow(3, {"p17", "p40"}), batch=64, progress=done)).collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and done.value == 200
    failed = {r["id"]: r for r in got if r["error"]}
    assert set(failed) == {17, 40} and {r["error"] for r in failed.values()} == {"RuntimeError: out of memory"}
    assert {(r["total_log_prob"], r["num_tokens"], r["normalized_log_prob"]) for r in failed.values()} == {(None, 0, None)}
    assert all(r["num_tokens"] == 1 + r["id"] % 2 for r in got if not r["error"])


def test_batches_shrink_and_grow():
    sizes, broken = [], {"left": 1}

    def call(part):
        sizes.append(len(part))
        if len(part) > 8 or 20 in part["id"].tolist() and broken["left"]:
            broken["left"] -= len(part) == 1
            raise MemoryError
        return part["id"].tolist()

    got = list(driver.careful(call, pd.DataFrame({"id": range(50)}), 32))
    assert [x for _, results, _ in got for x in results] == list(range(50)) and not any(e for *_, e in got)
    assert sizes[:4] == [32, 16, 8, 16] and 1 in sizes  # halved until it works, doubled after
    with pytest.raises(ValueError):  # not a failure that a smaller batch mends
        list(driver.careful(lambda part: [][1:] or int("x"), pd.DataFrame({"id": [1]}), mendable=(RuntimeError,)))


def test_a_worker_loads_a_model_once(spark):
    def run(batches):
        loads = []
        for pdf in batches:
            driver.kept("model", lambda: loads.append(1) or object())
            yield pd.DataFrame({"pid": [os.getpid()], "loads": [len(loads)]})

    got = spark.range(4000).repartition(40).mapInPandas(run, "pid long, loads long").groupBy("pid").agg(F.sum("loads").alias("n"), F.count(F.lit(1)).alias("tasks")).collect()
    assert {r["n"] for r in got} <= {0, 1} and sum(r["tasks"] for r in got) >= 40


def test_what_is_longest_unused_goes():
    driver._KEPT.clear()
    made = []
    get = lambda k, n: driver.kept(k, lambda: made.append(k) or n, lambda x: x, 10)
    for k, n in (("a", 4), ("b", 4), ("a", 4), ("c", 4), ("a", 4), ("b", 4), ("big", 99), ("big", 99)):
        assert get(k, n) == n
    assert made == ["a", "b", "c", "b", "big"] and list(driver._KEPT) == ["big"]


def test_a_profile_asks_for_devices():
    p = driver.devices(2, 4, memory="8g")
    assert p.taskResources["gpu"].amount == 2.0 and p.taskResources["cpus"].amount == 4.0
    assert p.executorResources["gpu"].amount == 2 and p.executorResources["cores"].amount == 4 and p.executorResources["memory"].amount == 8192
    assert driver.devices(0.5).executorResources["gpu"].amount == 1


def test_a_barrier_stage_scores_all_rows(spark):
    assert driver.scored(rows_of(spark, 20, 2), narrow(99), barrier=True).filter("error is null").count() == 20


def test_pilot(spark):
    def fails():
        raise OSError("no weights")

    def stops():
        seen = []

        def run(texts):
            seen.append(1)
            if len(seen) > 1:
                raise RuntimeError("out of memory")
            return ["one, two, three"] * len(texts)

        return run

    cues = spark.createDataFrame([(f"c{k}", f"say c{k}") for k in range(80)], "cue string, prompt string").coalesce(1)
    models = {"good": lambda: lambda texts: [f"{t}, two, three" for t in texts], "poor": lambda: lambda texts: ["one"] * len(texts), "none": fails, "stops": stops}
    got = {r["model"]: tuple(r)[1:] for r in driver.pilot(cues, models, 6, 25).collect()}
    assert got == {"good": ("SUCCESS", 150, 1.0, "PASS"), "poor": ("SUCCESS", 150, 0.0, "FAIL"), "none": ("LOAD_FAIL", 0, 0.0, "FAIL"), "stops": ("SUCCESS", 10, 1.0, "PASS")}


# --- inputs -----------------------------------------------------------------------------------------------------------


def labelled(spark, prompt, answer, after="", marker=None):
    df = spark.createDataFrame([(prompt, answer)], "p string, r string")
    text, start, end = inputs.framed(F.col("p"), F.col("r"), "User: ", "\nAssistant:\n", after)
    rows = inputs.tokenised(df.select(text.alias("text"), start.alias("start"), end.alias("end")), lambda: inputs.piecewise)
    stop = inputs.answer_end(F.col("tokens"), F.col("start"), F.col("end"), marker)
    r = rows.withColumn("labels", inputs.labels(F.col("tokens"), F.col("text"), F.col("start"), stop)).first()
    return [r["text"][t["a"] : t["b"]] for t, x in zip(r["tokens"], r["labels"], strict=True) if x != inputs.IGNORED], r


def test_only_the_answer_is_scored_and_no_separators(spark):
    got, r = labelled(spark, "dog, cat", "bone, cat ,\n tail")
    assert got == ["bone", " cat", " tail"]
    assert [t["id"] for t, x in zip(r["tokens"], r["labels"], strict=True) if x != -100] == [x for x in r["labels"] if x != -100]
    assert "".join(r["text"][t["a"] : t["b"]] for t in r["tokens"]) == r["text"]
    assert labelled(spark, "dog", "")[0] == []


def test_the_answer_ends_at_the_first_marker(spark):
    assert labelled(spark, "a § b", "one § two", "§", ord("§"))[0] == ["one"]
    assert labelled(spark, "a", "one two", "§", ord("§"))[0] == ["one", " two"]
    assert labelled(spark, "a", "one two", "", ord("§"))[0] == ["one", " two"]


def test_null_texts_and_batches_of_near_equal_length(spark):
    df = spark.createDataFrame([(k, "w " * k if k else None) for k in range(30)], "k int, text string").repartition(2)
    rows = inputs.tokenised(df, lambda: inputs.piecewise)
    ids = rows.select("k", F.transform("tokens", lambda t: t["id"]).alias("ids")).withColumn("labels", F.col("ids"))
    got = inputs.batched(ids, "ids", "labels", ["k"], 4, -1).collect()
    assert len(got) == 30 and {r["k"] for r in got} == set(range(30))
    by = {}
    for r in got:
        assert len(r["ids"]) == len(r["labels"]) and [x == -1 for x in r["ids"]] == [x == inputs.IGNORED for x in r["labels"]]
        by.setdefault(r["batch"], []).append(len(r["ids"]))
    assert all(len(set(n)) == 1 and len(n) <= 4 for n in by.values()) and max(map(len, by.values())) == 4


def test_names_are_made_from_the_table(spark, data):
    assert fx.names_of_embeddings(spark, data).count() > 50


def test_tokens_of_few_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = ["a b, c " * 40] * 4000 + [None, "", "x" * (inputs.PART + 1), "y z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["k", "text"])
    parts = list(inputs.pieces(batch, "text"))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and [p.num_rows for p in parts[-2:]] == [1, 1]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= inputs.PART for p in parts)
    tracemalloc.start()
    for part in parts:
        out = inputs.with_tokens(part, "text", inputs.piecewise)
        assert [[(t["id"], t["a"], t["b"]) for t in x] for x in out["tokens"].slice(0, 3).to_pylist()] == [inputs.piecewise(t or "") for t in part["text"].to_pylist()[:3]]
    assert tracemalloc.get_traced_memory()[1] < 10_000_000  # 640,000 tokens as objects take over 150 MB
    tracemalloc.stop()
    assert out["tokens"].to_pylist() == [[{"id": 121, "a": 0, "b": 1}, {"id": 154, "a": 1, "b": 3}]]
