import json

from pyspark.sql import functions as F

from cuelattice.operators import embed
from cuelattice.plans import pipeline
from cuelattice.sources import readers, sinks
from cuelattice.streaming import generations as stream


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_associations(spark, tmp_path):
    path = put(tmp_path / "a.csv", ',id,cue,R1,R2,R3,age\n0,1,Dog,cat,NA,"x, y",30\n1,2,null,nan,,,\n2,3,,a,b,c,\n')
    rows = {r["id"]: r for r in readers.associations(spark, path).collect()}
    assert set(rows) == {1, 2} and rows[1]["R2"] is None and rows[1]["R3"] == "x, y" and rows[2]["cue"] == "null" and rows[2]["R1"] == "nan"


def test_norm_files(spark, tmp_path):
    path = put(tmp_path / "n.csv", "word,norm_name,human_rating\n Dog ,v,3.5\ncat,v,Olfactory\n")
    assert [tuple(r) for r in readers.norms(spark, path).collect()] == [("dog", "v", 3.5)]
    a = put(tmp_path / "m1.csv", "word,norm,cleaned_rating\nx,v,1\n")
    b = put(tmp_path / "m2.csv", "word,norm_name,cleaned_rating\ny,v,bad\n")
    c = put(tmp_path / "m3.csv", "word,other\ny,v\n")
    assert {tuple(r) for r in readers.model_norms(spark, [a, b, c]).collect()} == {("m1", "v", "x", "1"), ("m2", "v", "y", "bad")}
    assert readers.model_norms(spark, [c]).count() == 0


def test_directory_scan_names_the_file(spark, tmp_path):
    for m in ("one", "two"):
        put(tmp_path / f"{m}.csv", "cue,lp\na,-1.5\n")
    rows = readers.by_file(spark, f"{tmp_path}/*.csv", "cue string, lp double").collect()
    assert {(r["model"], r["cue"], r["lp"]) for r in rows} == {("one", "a", -1.5), ("two", "a", -1.5)}


def test_generations_are_lenient(spark, tmp_path):
    lines = [json.dumps({"cue": " Sun ", "responses": ["Moon", {"response": "Sky"}], "model": "m"}), "{bad", json.dumps({"cue": "x", "model": "m"})]
    rows = readers.generations(spark, put(tmp_path / "g.jsonl", "\n".join(lines))).collect()
    assert {(r["cue"], r["response"]) for r in rows} == {("sun", "Moon"), ("sun", "Sky")}


def test_activation_forms(spark, tmp_path):
    a = put(tmp_path / "a.csv", 'cue,vector\nDog,"[1.0, 2.0]"\n')
    b = put(tmp_path / "b.csv", "label,d0,d1\nDog,1.0,2.0\ncat,x,1\n")
    assert readers.activations(spark, a).first()[:] == ("dog", [1.0, 2.0])
    assert {r["cue"]: r["vec"] for r in readers.activations(spark, b).collect()} == {"dog": [1.0, 2.0], "cat": [None, 1.0]}
    assert [r["word"] for r in readers.word_keys(spark, put(tmp_path / "w.json", '{"b": "1", "a": "2"}'), 1).collect()] == ["a"]


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.upsert_parquet(spark, spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), path, ["k"])
    last = sinks.upsert_parquet(spark, spark.createDataFrame([(2, "new")], "k int, v string"), path, ["k"])
    assert {tuple(r) for r in spark.read.parquet(last).collect()} == {(1, "old"), (2, "new")}
    for n, rows in enumerate(([(1, "a"), (2, "a")], [(2, "b"), (3, "b")])):
        spark.createDataFrame(rows, "k int, v string").write.parquet(f"{tmp_path}/s{n}")
    merged = sinks.merge_shards(spark, [f"{tmp_path}/s0", f"{tmp_path}/s1"], "k", ["v"]).collect()
    assert [tuple(r) for r in merged] == [(1, "a"), (2, "a"), (3, "b")]
    df = spark.createDataFrame([(1, 'a "q"', 2.0), (2, None, 2.5)], "k int, t string, x double")
    lines = [r["l"] for r in df.select(sinks.quoted_line([(F.col("k"), "bare"), (F.col("t"), "text"), (F.col("x"), "number")]).alias("l")).collect()]
    assert lines == ['1,"a ""q""",2', "2,NA,2.5"]
    sinks.text_table(df, f"{tmp_path}/x")
    assert spark.read.text(f"{tmp_path}/x").count() == 2


def test_stream_adds_up(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = json.dumps({"cue": "Sun", "responses": ["Moon", "moon!", {"response": "sky"}], "model": "m"})
    for n in range(2):
        put(folder / f"{n}.jsonl", line + "\n{bad\n")
        stream.keep_counts(stream.read(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r["cue"], r["response"]): r["n"] for r in stream.latest(spark, f"{tmp_path}/out").collect()}
    assert got == {("sun", "moon"): 4, ("sun", "sky"): 2}


def test_stream_of_a_new_query_adds_to_an_old_target(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "COMPACT", 2)
    line = json.dumps({"cue": "Sun", "responses": ["Moon"], "model": "m"})
    for query, batches in (("a", 5), ("b", 3)):
        folder = tmp_path / f"in_{query}"
        folder.mkdir()
        for n in range(batches):
            put(folder / f"{n}.jsonl", line)
            stream.keep_counts(stream.read(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/ck_{query}").awaitTermination()
    assert [r["n"] for r in stream.latest(spark, f"{tmp_path}/out").collect()] == [8]
    first = next(p for p in (tmp_path / "out").iterdir() if (p / "batch=4").exists())
    assert not (first / "batch=0").exists() and (first / "upto=3").exists()
    (first / "batch=4" / "_SUCCESS").unlink()  # a batch that is not finished does not count
    assert [r["n"] for r in stream.latest(spark, f"{tmp_path}/out").collect()] == [7]
    assert stream.latest(spark, f"{tmp_path}/none") is None


def test_files_of_other_column_orders(spark, tmp_path):
    put(tmp_path / "one.csv", "cue,lp\na,-1.5\n")
    put(tmp_path / "two x+1.csv", "extra,lp,cue\nq,-2.5,b\n")
    put(tmp_path / "three.csv", "cue\nc\n")
    rows = readers.by_file(spark, f"{tmp_path}/*.csv", "cue string, lp double").collect()
    assert {(r["model"], r["cue"], r["lp"]) for r in rows} == {("one", "a", -1.5), ("two x+1", "b", -2.5), ("three", "c", None)}
    assert readers.by_file(spark, f"{tmp_path}/*.none", "cue string, lp double").count() == 0
    assert readers.first_there(spark, f"{tmp_path}/none", f"{tmp_path}/one.csv") == f"{tmp_path}/one.csv"


def test_old_versions_go(spark, tmp_path):
    for k in range(4):
        last = sinks.upsert_parquet(spark, spark.createDataFrame([(k, "v")], "k int, v string"), f"{tmp_path}/t", ["k"])
    assert spark.read.parquet(last).count() == 4 and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v=3", "v=4"]
    sinks.metadata(spark.createDataFrame([(7, "x")], "n int, m string"), f"{tmp_path}/meta")
    assert spark.read.json(f"{tmp_path}/meta").first().asDict() == {"n": 7, "m": "x"}


def test_pipeline_end_to_end(spark, tmp_path):
    words = [f"w{chr(97 + k // 8)}{chr(97 + k % 8)}" for k in range(60)]
    lines = ["id,cue,R1,R2,R3"]
    for n in range(700):
        lines.append(f"{n},{words[n % 60]},{words[n * 7 % 60]},{words[(n * n + 3) % 60]},{words[(n * 11 + n // 60) % 60]}")
    assoc = put(tmp_path / "a.csv", "\n".join(lines))
    norms = put(tmp_path / "n.csv", "word,norm_name,human_rating\n" + "\n".join(f"{w},v,{k % 7}" for k, w in enumerate(words)))
    acts = put(tmp_path / "modelx.csv", "cue,d0,d1\n" + "\n".join(f"{w},{k % 7},{k % 3}" for k, w in enumerate(words)))
    rows = pipeline.run(spark, {"associations": assoc, "norms": norms, "activations": acts, "out": f"{tmp_path}/out"}, fixed=8).collect()
    got = {r["embedding_type"]: r for r in rows}
    assert set(got) == {"Baseline", "Activation"} and got["Activation"]["r2_mean"] > 0.99


def test_models_from_files_to_scores(spark, tmp_path):
    words = [f"w{chr(97 + k // 8)}{chr(97 + k % 8)}" for k in range(60)]
    triple = lambda n, s: (words[(n * 7 + s) % 60], words[(n * n + 3 + s) % 60], words[(n * 11 + n // 60) % 60])
    lines = ["id,cue,R1,R2,R3"] + [f"{n},{words[n % 60]},{','.join(triple(n, 0))}" for n in range(700)]
    for folder, name, shift in (("real", "gemma-3-27b-instruct-results", 1), ("real", "other", 2), ("real", "gemma-3-27b-instruct-deranged-results", 3), ("wrong", "gemma-3-27b-instruct-deranged-results", 5), ("wrong", "lonely", 6)):
        (tmp_path / folder).mkdir(exist_ok=True)
        rows = [f'{words[n % 60].upper()},"{", ".join(triple(n, shift))}",{-1 - n % 5}' for n in range(600)]
        put(tmp_path / folder / f"{name}.csv", "cue,response_set,normalized_log_prob\n" + "\n".join(rows))
    (tmp_path / "made").mkdir()
    put(tmp_path / "made" / "gemma-3-27b-instruct.jsonl", "\n".join(json.dumps({"cue": words[n % 60], "responses": list(triple(n, 4)), "model": "x"}) for n in range(600)))
    norms = put(tmp_path / "n.csv", "word,norm_name,human_rating\n" + "\n".join(f"{w},v,{k % 7}" for k, w in enumerate(words)))
    own = put(tmp_path / "gemma-3-27b-instruct.csv", "word,norm,cleaned_rating\n" + "\n".join(f"{w},v,{k % 5}" for k, w in enumerate(words)))
    acts = put(tmp_path / "gemma-3-27b-instruct-act.csv", "cue,d0,d1,d2\n" + "\n".join(f"{w},{k % 7},{k % 3},1" for k, w in enumerate(words)))
    model = tmp_path / "gemma-3-27-b-instruct.csv"
    model.write_text(open(acts).read())
    out = f"{tmp_path}/out"
    paths = {"associations": put(tmp_path / "a.csv", "\n".join(lines)), "norms": norms, "activations": str(model), "passive": f"{tmp_path}/real/*.csv", "deranged": f"{tmp_path}/wrong/*.csv", "active": f"{tmp_path}/made/*.jsonl", "own_norms": own, "out": out}
    rows = pipeline.run(spark, paths, limited=True).collect()
    passive = {f"passive_gemma-3-27-b-instruct{v}" for v in ("", "_shuffled", "_contrast")}
    bases = passive | {"active_gemma-3-27-b-instruct"}
    keys = {"human_matrix"} | bases | {f"{k}_300d" for k in bases}
    assert {r["embedding_key"] for r in rows} == keys | {"activation_gemma-3-27-b-instruct"}
    dims = lambda: {r["embedding_key"]: r["dim"] for r in embed.catalog(spark.read.parquet(f"{out}/behavior")).collect()}
    assert dims() == {k: 300 if k.endswith("_300d") or k == "human_matrix" else 3 for k in keys}
    scored = {r["embedding_source"] for r in spark.read.parquet(f"{out}/self_scores").collect()}
    assert scored == passive
    again = pipeline.run(spark, paths, skip=("activations", "behavior")).collect()  # both bundles are there
    assert {r["embedding_key"] for r in again} == {r["embedding_key"] for r in rows}
    pipeline.run(spark, {**paths, "passive": f"{tmp_path}/real/other.csv", "active": ""}, skip=("activations", "compare"), strategy="fixed", fixed=7)
    assert dims() == {"human_matrix": 300, "passive_other": 7, "passive_other_300d": 300}
    pipeline.run(spark, {**paths, "passive": f"{tmp_path}/real/other.csv", "active": ""}, skip=("activations", "compare"), strategy="mapping", fixed=7, mapping={"other": 9})
    assert dims()["passive_other"] == 9
