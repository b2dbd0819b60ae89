import os
import pickle

import numpy as np

from cuelattice.__main__ import main


def echo():
    return lambda prompts, responses: [[-1.0] * len(r.split(", ")) for r in responses]


def words():
    return lambda prompts: [f"{p}, one, two" for p in prompts]


def table(tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,cue,R1,R2,R3\n" + "\n".join(f"{k},c{k % 3},x{k},y,z" for k in range(12)))
    return str(path)


def test_derange_and_cells(spark, tmp_path):
    main(["derange", table(tmp_path), f"{tmp_path}/d"])
    got = {int(r["id"]): r["R1"] for r in spark.read.option("header", True).csv(f"{tmp_path}/d").collect()}
    assert sorted(got.values()) == sorted(f"x{k}" for k in range(12)) and all(got[k] != f"x{k}" for k in got)
    main(["behavior-cells", table(tmp_path), f"{tmp_path}/c"])
    got = {(r["cue"], r["response"]) for r in spark.read.parquet(f"{tmp_path}/c").collect()}
    assert got == {(c, r) for c in ("c0", "c1", "c2") for r in ("y", "z")}  # cues need not be responses


def test_scoring_takes_up_where_it_was(spark, tmp_path):
    for _ in range(2):
        main(["score", table(tmp_path), f"{tmp_path}/s", "--scorer", "tests.test_command_line:echo", "--num-shards", "2", "--shard-index", "1"])
    rows = spark.read.parquet(f"{tmp_path}/s").collect()
    assert sorted(r["id"] for r in rows) == [1, 3, 5, 7, 9, 11] and {r["num_tokens"] for r in rows} == {3}


def test_generate(spark, tmp_path):
    main(["generate", table(tmp_path), f"{tmp_path}/g", "--generator", "tests.test_command_line:words", "--samples", "2"])
    rows = spark.read.json(f"{tmp_path}/g").collect()
    assert len(rows) == 6 and all(r["responses"][1:] == ["one", "two"] for r in rows)


def model():
    return lambda sentences: [[(0, len(s), [1.0, 2.0])] for s in sentences]


def broken():
    raise OSError("no weights")


def study(tmp_path, n=90):
    """Bundles of one model in both modalities and the human one, and norms of two kinds."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 20))
    keys = ("human_matrix", "passive_m-1b-instruct", "passive_m-1b-instruct_shuffled", "passive_lonely", "activation_m-1b-instruct")
    bundle = {"embeddings": {k: x * (i + 1) for i, k in enumerate(keys)}, "mappings": {"cue_to_idx": {f"w{k}": k for k in range(n)}}}
    (tmp_path / "b.pkl").write_bytes(pickle.dumps(bundle))
    rows = [(f"w{k}", norm, x[k, 0] * 3 + i + rng.normal() * 0.1) for i, norm in enumerate(("a_norm", "b_norm")) for k in range(n)]
    (tmp_path / "norms.csv").write_text("word,norm_name,human_rating\n" + "\n".join(f"{w},{m},{v}" for w, m, v in rows))
    return str(tmp_path / "b.pkl"), str(tmp_path / "norms.csv")


def test_evaluation_commands(spark, tmp_path, capsys):
    bundle, norms = study(tmp_path)
    run = lambda command, *more: main([command, "--embeddings", bundle, "--norms", norms, "--out", f"{tmp_path}/{command}", *more])
    for _ in range(2):  # the second run has nothing left to do
        run("compare")
    scores = spark.read.parquet(f"{tmp_path}/compare").collect()
    assert sorted((r["embedding_type"], r["norm"]) for r in scores) == sorted((t, n) for t in ("Baseline", "Behavior_Standard", "Activation") for n in ("a_norm", "b_norm"))
    assert all(r["r2_mean"] > 0.99 and r["n_samples"] == 90 for r in scores)
    run("compare-pairs", "--smoketest", "--max-samples", "60")
    assert [(r["model"], r["n_samples"], round(r["delta"], 6)) for r in spark.read.parquet(f"{tmp_path}/compare-pairs").collect()] == [("M 1b", 60, 0.0)] * 2
    run("predict-human")
    assert spark.read.parquet(f"{tmp_path}/predict-human").count() == 10
    run("sweep")
    assert {r["dim"] for r in spark.read.parquet(f"{tmp_path}/sweep").collect()} == {16}
    for kind, folder in (("leaderboards", "compare"), ("best", "compare"), ("gap", "compare"), ("saturation", "sweep")):
        capsys.readouterr()
        main(["report", kind, f"{tmp_path}/{folder}"])
        assert {"leaderboards": "m-1b", "best": "a_norm", "gap": "delta", "saturation": "Rising"}[kind] in capsys.readouterr().out


def test_checks_of_own_ratings(spark, tmp_path, capsys):
    for m in range(3):
        (tmp_path / f"m{m}.csv").write_text("word,norm,raw_response,cleaned_rating\n" + "\n".join(f"w{k},a_norm,x,{k + m if k else 'none'}" for k in range(15)))
    for kind, shown in (("comprehension", "14"), ("consistency", "1.0"), ("coverage", "PARSE FAILURES")):
        capsys.readouterr()
        main(["check", kind, f"{tmp_path}/m*.csv"])
        assert shown in capsys.readouterr().out


def test_pilot_and_word_vectors(spark, tmp_path):
    main(["pilot", table(tmp_path), f"{tmp_path}/p", "--generator", "good=tests.test_command_line:words", "--generator", "bad=tests.test_command_line:broken", "--cues", "2", "--samples", "3"])
    got = {r["model"]: (r["status"], r["yield_rate"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/p").collect()}
    assert got == {"good": ("SUCCESS", "1.0"), "bad": ("LOAD_FAIL", "0.0")}
    (tmp_path / "words.csv").write_text("word\ndog\nCat\n")
    for _ in range(2):
        main(["embed", str(tmp_path / "words.csv"), f"{tmp_path}/npy", "--model", "tests.test_command_line:model", "--template", "a {word} here"])
    files = os.listdir(f"{tmp_path}/npy")
    assert len(files) == 2 and np.load(f"{tmp_path}/npy/{files[0]}").tolist() == [1.0, 2.0]


def test_smoketests_take_the_first_rows(spark, tmp_path):
    main(["score", table(tmp_path), f"{tmp_path}/s", "--scorer", "tests.test_command_line:echo", "--smoketest", "4", "--batch-size", "2"])
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/s").collect()) == [0, 1, 2, 3]
